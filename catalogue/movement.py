"""SRC, SNK and STR: what is read, written and streamed, checked on what came out at the other end."""

import dataclasses
import re

from pyspark.sql import functions as F

from attestor.functions import scalars as S
from attestor.operators import audits, mapping, order, packets, reconcile, rules
from attestor.sources import documents, ledger, manifest, publish
from attestor.sources.ledger import from_derived
from attestor.streaming import streams
from catalogue import LIBRARY, query
from catalogue.evidence import extracted
from catalogue.mapping_queries import lot_rows
from catalogue.reconciliation import books
from catalogue.rules import assessment


@query("src_01", "SELECT c.claim_id, coalesce(string_agg(r.requirement, ',' ORDER BY r.requirement), '') AS requirements FROM {f_claim} AS c LEFT JOIN {f_claim_requirement} AS r ON r.claim_id = c.claim_id GROUP BY 1")
def src_01(fr):
    return ledger.fold_requirements(fr["f_claim"], fr["f_claim_requirement"].select("claim_id", "requirement")).select("claim_id", F.concat_ws(",", "requirements").alias("requirements"))


STORED = ("fund", "holding", "period", "lot", "conversion", "mark", "claim", "claim_requirement", "fact", "gap", "component", "support", "decision", "decision_evidence", "policy_decision", "document")


def stored_ledger(fr):
    """A ledger as a house would hold it: a folder a table, columns as the reader's schema states them, one column more than it asks for."""

    def write(path: str) -> None:
        for name in STORED:
            columns = [F.col(c.split()[0]).cast(c.split(None, 1)[1]).alias(c.split()[0]) for c in re.split(r", (?=[a-z])", ledger.SCHEMAS[name])]
            fr[f"f_{name}"].select(*columns, F.lit("x").alias("not_asked_for")).write.option("compression", "zstd").parquet(f"{path}/{name}")

    return ledger.read(fr.spark, fr.written("stored_ledger", write))


@query("src_01_stored", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {{f_{n}}}" for n in STORED if n != "claim_requirement") + " UNION ALL SELECT 'requirements', count(*) FROM {f_claim_requirement}")
def src_01_stored(fr):
    """Every table of a stored ledger, read under its stated schema."""
    held = stored_ledger(fr)
    out = held.claim.agg(F.lit("requirements").alias("table_name"), F.sum(F.size("requirements")).alias("rows"))
    for name in STORED:
        if name != "claim_requirement":
            out = out.unionByName(getattr(held, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")))
    return out


@query("src_01_rows", "SELECT holding_id, period_id, row_verdict, unsupported = '' AS supported FROM {o_row}")
def src_01_rows(fr):
    """The rows of a packet assessed from the stored ledger are those of the ledger it was written from."""
    return rules.Assessment(stored_ledger(fr)).rows.select("holding_id", "period_id", "row_verdict", "supported")


def incoming(fr):
    text = F.when(F.col("document_no") % 50 == 0, " \n ").otherwise(F.col("canonical_text"))
    return documents.hashed(fr["f_paged"].withColumn("canonical_text", text).withColumn("extractor", F.lit("plain")))


LIBRARY["o_incoming"] = r"""
SELECT document_id, document_no, canonical_text, CASE WHEN trim(regexp_replace(canonical_text, '\s', '', 'g')) = '' THEN 'the text is empty' END AS refusal FROM (SELECT document_id, document_no, CASE WHEN document_no % 50 = 0 THEN ' ' || chr(10) || ' ' ELSE canonical_text END AS canonical_text FROM {f_paged})"""


@query("src_07", "SELECT i.document_id, sha256(i.canonical_text) AS content_hash, length(i.canonical_text) AS text_length, CASE WHEN i.refusal IS NULL THEN p.pages ELSE 1 END AS page_count, i.refusal FROM {o_incoming} AS i JOIN (SELECT document_id, count(*) AS pages FROM {o_page} GROUP BY 1) AS p ON p.document_id = i.document_id")
def src_07(fr):
    return incoming(fr).select("document_id", "content_hash", "text_length", "page_count", "refusal")


@query("src_07_files", """SELECT source, sha256(body) AS content_hash, length(body) AS text_length, strlen(body) AS byte_size, 1 + length(body) - length(replace(body, chr(12), '')) AS page_count, CAST(NULL AS VARCHAR) AS refusal FROM (
 SELECT source, string_agg(replace(canonical_text, chr(10), chr(12)), chr(10) ORDER BY document_no) || chr(10) AS body FROM {f_document} GROUP BY 1)""")
def src_07_files(fr):
    """Files of a folder, each read as one document: the texts of a source, a line each."""

    def write(path: str) -> None:
        line = F.replace("canonical_text", F.lit("\n"), F.lit("\f"))
        fr["f_document"].select("source", "document_no", line.alias("line")).repartition("source").sortWithinPartitions("source", "document_no").select("source", "line").write.partitionBy("source").text(path)

    read = documents.read_files(fr.spark, fr.written("incoming_files", write))
    return read.select(F.regexp_extract("document_id", "/source=([^/]*)/", 1).alias("source"), "content_hash", "text_length", "byte_size", "page_count", "refusal")


@query("src_08", """SELECT i.document_id, CASE WHEN s.h IS NOT NULL AND s.h <> i.h THEN 'collision' WHEN s.h IS NOT NULL THEN 'already_stored' WHEN i.h IN (SELECT sha256(canonical_text) FROM {f_stored_document}) THEN 'same_content_elsewhere' ELSE 'new' END AS arrival
 FROM (SELECT document_id, sha256(canonical_text) AS h FROM {f_document}) AS i LEFT JOIN (SELECT document_id, sha256(canonical_text) AS h FROM {f_stored_document}) AS s ON s.document_id = i.document_id""")
def src_08(fr):
    """Every document is stored already; some under another id, some with other content."""
    return documents.arrivals(documents.hashed(fr["f_document"]), documents.hashed(fr["f_stored_document"].withColumn("extractor", F.lit("plain")))).select("document_id", "arrival")


@query("src_09", "SELECT claim_id, field_name, CASE WHEN part_key % 23 = 1 THEN 'not_a_proposal' WHEN part_key % 7 = 2 THEN 'stale_recording' WHEN part_key % 11 = 3 THEN 'undeclared_field' END AS refusal FROM {f_fact_raw}")
def src_09(fr):
    p = F.col("part_key")
    body = F.to_json(F.struct(F.when(p % 11 == 3, "mystery").otherwise(F.col("field_name")).alias("field"), F.col("value_text").alias("value"), "quote", F.when(p % 7 == 2, "old").otherwise("now").alias("fingerprint")))
    recordings = fr["f_fact_raw"].select("claim_id", "field_name", F.when(p % 23 == 1, "{}").otherwise(body).alias("body"), F.lit("now").alias("expected"))
    return documents.recorded_proposals(recordings, "body", "expected").select("claim_id", "field_name", "refusal")


@query("src_10", """SELECT t.table_name, t.rows, d.declared, d.declared = t.rows AS agrees FROM (SELECT 'period' AS table_name, count(*) AS rows FROM {f_period} UNION ALL SELECT 'lot', count(*) FROM {f_lot}
 UNION ALL SELECT 'claim', count(*) FROM {f_claim} UNION ALL SELECT 'link', count(*) FROM {f_link}) AS t LEFT JOIN {f_declared} AS d ON d.table_name = t.table_name""")
def src_10(fr):
    return documents.declared_counts({"period": fr["f_period"], "lot": fr["f_lot"], "claim": fr["f_claim"], "link": fr["f_link"]}, fr["f_declared"])


@query("src_11", "SELECT kind, count(*) AS findings, count(stated) AS with_stated FROM {o_findings} GROUP BY 1")
def src_11(fr):
    found = reconcile.all_findings(books(fr))
    again = documents.findings_snapshot(found, publish.staging_path(fr.spark, "findings"))
    return again.groupBy("kind").agg(F.count("*").alias("findings"), F.count("stated").alias("with_stated"))


@query("snk_01", """SELECT table_name, count(*) FILTER (ok) AS landed, count(*) FILTER (NOT ok) AS refused FROM (SELECT 'lot' AS table_name, (shares IS NULL) = (entry_pps IS NULL) AS ok FROM {f_lot} UNION ALL SELECT 'claim', source_class <> 'blog' FROM {o_spoilt_claim}) GROUP BY 1""")
def snk_01(fr):
    claims = fr["f_claim"].withColumn("source_class", F.when(F.col("order_key") % 500 == 0, "blog").otherwise(F.col("source_class")))
    counts = None
    for table, df, checks in (("lot", fr["f_lot"], audits.lot_rules()), ("claim", claims, audits.claim_rules())):
        good, bad = publish.split_rows(df, table, checks)
        landed = good.agg(F.lit(table).alias("table_name"), F.count("*").alias("landed"))
        refused = bad.agg(F.lit(table).alias("table_name"), F.count("*").alias("refused"))
        one = landed.join(refused, "table_name")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query("snk_02", "SELECT claim_id, count(*) FILTER (outcome = 'cited') AS facts, count(*) FILTER (outcome <> 'cited') AS refused, CASE WHEN count(*) FILTER (outcome = 'cited') = 0 THEN 'nothing was cited' END AS error FROM {o_extracted} GROUP BY 1")
def snk_02(fr):
    return publish.document_outcomes(fr["f_claim"], extracted(fr), "claim_id")


@query("snk_03", "SELECT fund || '/' || company || '/' || CAST(lot_no AS VARCHAR) AS lot_id, security_class, CAST(cost_amount AS DECIMAL(24,4)) AS cost_amount, 'USD' AS cost_currency FROM {o_mapped_lot}", text="cost_amount")
def snk_03(fr):
    return lot_rows(fr).select(F.concat_ws("/", "fund", "company", F.col("lot_no").cast("string")).alias("lot_id"), "security_class",
                               F.col("cost_amount").cast("decimal(24,4)").alias("cost_amount"), F.lit(mapping.ASSUMED_CURRENCY).alias("cost_currency"))


@query("snk_04", "SELECT holding_id, period_id, finding, requirement, kind, basis FROM {o_gap_report}")
def snk_04(fr):
    """Read back from the CSV that was written."""
    path = publish.csv_table(packets.gap_report(assessment(fr)).select("holding_id", "period_id", "finding", "requirement", "kind", "basis"), "gap_report")
    schema = "holding_id string, period_id string, finding string, requirement string, kind string, basis string"
    return fr.spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


#: Whole names; some holdings are renamed, so that several of a fund have one safe name.
LIBRARY["o_folder"] = r"""
SELECT holding_id, fund_id, name, regexp_replace(replace(regexp_replace(name, '[/\\:*?"<>|\x00-\x1f]+', '_', 'g'), '..', '__'), '^[ .]+|[ .]+$', '', 'g') AS safe FROM (SELECT holding_id, fund_id, CASE WHEN cust_key % 40 = 3 THEN 'Shared Holding' ELSE replace(company_name, '#', '/:') END || '..' || CASE WHEN cust_key % 2 = 0 THEN ' Ltd.' ELSE ' LTD' END AS name FROM {f_holding})"""


@query("snk_06", """SELECT f.holding_id, 'companies/' || CASE WHEN g.first_id = f.holding_id THEN f.safe ELSE f.safe || ' (' || f.holding_id || ')' END AS directory FROM {o_folder} AS f
 JOIN (SELECT fund_id, lower(safe) AS folded, arg_min(holding_id, struct_pack(a := name, b := holding_id)) AS first_id FROM {o_folder} GROUP BY 1, 2) AS g ON g.fund_id = f.fund_id AND g.folded = lower(f.safe)""")
def snk_06(fr):
    return folder_plan(fr).select("holding_id", "directory")


def folder_plan(fr):
    whole = F.when(F.col("cust_key") % 40 == 3, "Shared Holding").otherwise(F.replace("company_name", F.lit("#"), F.lit("/:")))
    name = F.concat(whole, F.lit(".."), F.when(F.col("cust_key") % 2 == 0, " Ltd.").otherwise(" LTD"))
    return publish.path_plan(fr["f_holding"].select("holding_id", "fund_id", name.alias("name")), ["fund_id"], "name", "holding_id")


LIBRARY["o_directory"] = """
SELECT f.holding_id, f.fund_id, 'companies/' || CASE WHEN g.first_id = f.holding_id THEN f.safe ELSE f.safe || ' (' || f.holding_id || ')' END AS directory FROM {o_folder} AS f
 JOIN (SELECT fund_id, lower(safe) AS folded, arg_min(holding_id, struct_pack(a := name, b := holding_id)) AS first_id FROM {o_folder} GROUP BY 1, 2) AS g ON g.fund_id = f.fund_id AND g.folded = lower(f.safe)"""


@query("snk_05", """SELECT h.fund_id || '/' || h.directory AS folder, count(DISTINCT h.holding_id) AS positions, count(d.document_id) AS documents, count(*) FILTER (d.document_id IS NULL) AS notes FROM {o_directory} AS h
 LEFT JOIN (SELECT DISTINCT c.holding_id, x.document_id FROM {f_claim} AS c JOIN {f_document} AS x ON x.document_no = c.document_no) AS d ON d.holding_id = h.holding_id GROUP BY 1""")
def snk_05(fr):
    """A folder of its own for every position, as the path plan names it."""
    cited = fr["f_claim"].join(fr["f_document"].select("document_no", "document_id"), "document_no").select("holding_id", "document_id").distinct()
    folders = folder_plan(fr).select("holding_id", F.concat_ws("/", "fund_id", "directory").alias("folder"))
    path = publish.evidence_folders(folders, cited, "bundle", slices=1)
    written = publish.read_folders(fr.spark, path, "holding_id string, document_id string, note string, folder string")
    return written.groupBy("folder").agg(F.countDistinct("holding_id").alias("positions"), F.count("document_id").alias("documents"), F.count("note").alias("notes"))


@query("snk_07", "SELECT fund_id, period_id, count(*) AS rows FROM {o_member} GROUP BY 1, 2")
def snk_07(fr):
    """Published only after every check on the written copy came back empty; a second run that fails leaves readers the first."""
    members = assessment(fr).members.select("fund_id", "period_id", "holding_id", "held", "mark_id")
    checks = {"no_row_twice": lambda t: audits.duplicates(t["member"], ["period_id", "holding_id"], "twice")}
    target = publish.staging_path(fr.spark, "published")
    publish.publish(fr.spark, {"member": members}, checks, target)
    try:
        publish.publish(fr.spark, {"member": members.unionByName(members)}, checks, target)
    except ValueError:
        pass
    return publish.read_published(fr.spark, target, "member", members.schema).groupBy("fund_id", "period_id").agg(F.count("*").alias("rows"))


@query("snk_08", "SELECT packet_id, count(*) AS entries, min(ordinal) AS low, max(ordinal) AS high FROM {f_manifest} GROUP BY 1")
def snk_08(fr):
    """Two appends, as two exports would make them."""
    path = publish.staging_path(fr.spark, "manifest")
    rows = fr["f_manifest"].select("packet_id", "path", "ordinal")
    rows.filter("packet_id < 'pk_fund_2'").write.mode("append").parquet(path)
    rows.filter("packet_id >= 'pk_fund_2'").write.mode("append").parquet(path)
    return fr.spark.read.schema(rows.schema).parquet(path).groupBy("packet_id").agg(F.count("*").alias("entries"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"))


LANES = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 16 * n}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)" for n in range(4))


@query("snk_09", f"""SELECT period_id, count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {LANES})) AS digest FROM (
 SELECT period_id, sha256(CAST(json_object('holding_id', holding_id, 'mark_id', mark_id, 'reported_amount', CAST(reported_amount AS VARCHAR), 'revision', CAST(revision AS VARCHAR)) AS VARCHAR)) AS h FROM {{f_mark}}) GROUP BY 1""")
def snk_09(fr):
    return publish.table_digest(fr["f_mark"].select("period_id", "holding_id", "mark_id", "reported_amount", "revision"), ["period_id"])


@query("snk_10", "SELECT packet_id, count(*) AS entries, min(ordinal) = 1 AND max(ordinal) = count(*) AND count(DISTINCT ordinal) = count(*) AS contiguous FROM {f_manifest} GROUP BY 1")
def snk_10(fr):
    return publish.ordinals(fr["f_manifest"]).select("packet_id", "entries", "contiguous")


def digest_sql(rows: str, columns: str, name: str) -> str:
    """Rows and digest of a relation for each packet, as `publish.hash_sum` defines them. ``columns`` in alphabetical order."""
    cells = ", ".join(f"'{c}', CAST({c} AS VARCHAR)" for c in columns.split())
    return f"""SELECT fund_id, period_id, count(*) AS {name}_rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {LANES})) AS {name}_digest FROM (
 SELECT fund_id, period_id, sha256(CAST(json_object({cells}) AS VARCHAR)) AS h FROM {rows}) GROUP BY 1, 2"""


LIBRARY["o_mark_revision"] = digest_sql("{o_member} WHERE mark_id IS NOT NULL", "holding_id mark_id reported_amount reported_currency revision", "mark_revision")
LIBRARY["o_document_version"] = digest_sql("""(SELECT DISTINCT m.fund_id, m.period_id, d.document_id, d.filename, d.extractor, sha256(d.canonical_text) AS content_hash, strlen(d.canonical_text) AS byte_size,
 sha256(d.extractor || chr(0) || d.canonical_text) AS text_hash, 1 + length(d.canonical_text) - length(replace(d.canonical_text, chr(12), '')) AS page_count
 FROM {o_member} AS m JOIN {f_claim} AS c ON c.holding_id = m.holding_id JOIN {f_document} AS d ON d.document_no = c.document_no)""", "byte_size content_hash document_id extractor filename page_count text_hash", "document_version")
LIBRARY["o_requirement_digest"] = digest_sql("{o_requirement_row}", "applicable category evidence_claims holding_id includes_subsequent next_actions pro_forma reason_codes requirement verdict", "requirement")
LIBRARY["o_gap_digest"] = digest_sql("{o_gap_report}", "basis finding holding_id kind remediation requirement", "gap")
LIBRARY["o_totals_json"] = """
SELECT p.fund_id, p.period_id, CAST(json_object('kind', 'held_at_date_reported', 'amount', CAST(t.amount AS VARCHAR), 'unsupported_amount', CAST(t.unsupported_amount AS VARCHAR), 'unsupported_positions', t.unsupported_positions,
  'packet_gap_positions', t.packet_gap_positions, 'contains_unsupported_inputs', t.unsupported_positions > 0) AS VARCHAR) AS held_total,
 CAST(json_object('kind', 'approved', 'amount', CAST(p.amount AS VARCHAR), 'unsupported_amount', CAST(p.unsupported AS VARCHAR), 'unsupported_positions', p.positions, 'contains_unsupported_inputs', p.positions > 0) AS VARCHAR) AS approved_total
FROM (SELECT fund_id, period_id, CAST(coalesce(sum(reported_amount) FILTER (approved AND held), 0) AS DECIMAL(34,4)) AS amount, CAST(coalesce(sum(reported_amount) FILTER (approved AND held AND NOT supported), 0) AS DECIMAL(34,4)) AS unsupported,
  count(*) FILTER (approved AND held AND reported_amount IS NOT NULL AND NOT supported) AS positions FROM {o_packet} GROUP BY 1, 2) AS p
JOIN {o_held_total} AS t ON t.fund_id = p.fund_id AND t.period_id = p.period_id"""
MANIFEST = "approved_total document_version_digest document_version_rows fund_id gap_digest gap_rows held_total mark_revision_digest mark_revision_rows period_id policy_version requirement_digest requirement_rows"


@query("snk_09_manifest", f"""SELECT *, sha256(CAST(json_object({", ".join(f"'{c}', CAST({c} AS VARCHAR)" for c in MANIFEST.split())}) AS VARCHAR)) AS manifest_hash FROM (
 SELECT t.*, 'policy-1' AS policy_version, coalesce(r.requirement_rows, 0) AS requirement_rows, r.requirement_digest, coalesce(g.gap_rows, 0) AS gap_rows, g.gap_digest, coalesce(m.mark_revision_rows, 0) AS mark_revision_rows, m.mark_revision_digest,
  coalesce(d.document_version_rows, 0) AS document_version_rows, d.document_version_digest FROM {{o_totals_json}} AS t LEFT JOIN {{o_requirement_digest}} AS r USING (fund_id, period_id) LEFT JOIN {{o_gap_digest}} AS g USING (fund_id, period_id)
 LEFT JOIN {{o_mark_revision}} AS m USING (fund_id, period_id) LEFT JOIN {{o_document_version}} AS d USING (fund_id, period_id))""")
def snk_09_manifest(fr):
    """Counts and digests of the tables, mark revisions and document versions of every packet, its totals, and a hash over all."""
    a = assessment(fr)
    text, extractor = F.col("canonical_text"), F.col("extractor")
    pages = 1 + F.length(text) - F.length(F.replace(text, F.lit("\f"), F.lit("")))
    documents_ = fr["f_document"].select("document_no", "document_id", "filename", "extractor", S.content_hash(text).alias("content_hash"), F.octet_length(text).alias("byte_size"), S.text_hash(extractor, text).alias("text_hash"), pages.alias("page_count"))
    tables = {"requirement": packets.requirements_table(a), "gap": packets.gap_report(a)}
    return manifest.packet_manifest(tables, manifest.mark_revisions(a), manifest.document_versions(a, documents_), packets.totals_json(a), "policy-1")


def lines_of_funds(fr, changed: bool):
    """Lines of text for a folder a fund and period; the changed copy misses one folder, has one more, and differs in some lines."""
    amount = F.col("reported_amount").cast("string")
    hit = (F.col("cust_key") % 300 == 7) & (F.col("fund_id") == "fund_2") if changed else F.lit(False)
    folder = F.concat("fund_id", F.lit("_"), "label")
    rows = fr["f_latest_mark"].filter("audit_scope = 'packet'").select(folder.alias("folder"), F.concat_ws(",", F.when(hit, F.upper("holding_id")).otherwise(F.col("holding_id")), "period_id", amount).alias("line"))
    if not changed:
        return rows
    return rows.filter("folder <> 'fund_1_FY1998'").unionByName(rows.filter("folder = 'fund_3_FY1999'").select(F.lit("fund_9_FY1999").alias("folder"), "line"))


def written_lines(fr, changed: bool) -> str:
    """One file a folder, its lines in order."""
    path = publish.staging_path(fr.spark, "lines")
    lines_of_funds(fr, changed).repartition("folder").sortWithinPartitions("folder", "line").write.partitionBy("folder").text(path)
    return path


def folder_blocks(fr, path: str, **sizes):
    """Blocks by folder: each holds one file, whose name the writer chose."""
    return manifest.file_blocks(fr.spark, path, **sizes).withColumn("path", F.regexp_extract("path", "^folder=([^/]*)/", 1))


LIBRARY["o_stated_line"] = "SELECT fund_id || '_' || label AS folder, holding_id || ',' || period_id || ',' || CAST(reported_amount AS VARCHAR) AS line, fund_id, cust_key FROM {f_latest_mark} WHERE audit_scope = 'packet'"
LIBRARY["o_found_line"] = """
SELECT folder, CASE WHEN cust_key % 300 = 7 AND fund_id = 'fund_2' THEN upper(substr(line, 1, 1)) || substr(line, 2) ELSE line END AS line FROM {o_stated_line} WHERE folder <> 'fund_1_FY1998'
UNION ALL SELECT 'fund_9_FY1999', line FROM {o_stated_line} WHERE folder = 'fund_3_FY1999'"""


@query("snk_09_files", """SELECT folder, row_number() OVER (ORDER BY folder) AS ordinal, sum(strlen(line) + 1)::BIGINT AS byte_size, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS content_hash FROM {o_stated_line} GROUP BY 1""")
def snk_09_files(fr):
    """Entries of files as they were written, by the SHA-256 that any tool gives them."""
    entries = manifest.file_entries(folder_blocks(fr, written_lines(fr, False)))
    return entries.select(F.col("path").alias("folder"), "ordinal", "byte_size", "content_hash")


@query("snk_10_files", """SELECT folder AS path, CASE WHEN f.h IS NULL THEN 'file_missing' WHEN s.h IS NULL THEN 'file_not_listed' ELSE 'hash_differs' END AS problem, CASE WHEN f.h IS NOT NULL AND s.h IS NOT NULL THEN CAST(0 AS BIGINT) END AS block
 FROM (SELECT folder, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS h FROM {o_stated_line} GROUP BY 1) AS s FULL JOIN (SELECT folder, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS h FROM {o_found_line} GROUP BY 1) AS f USING (folder) WHERE s.h IS DISTINCT FROM f.h""")
def snk_10_files(fr):
    """The manifest of a written export against a copy in which a file is missing, one is added and some are changed."""
    stated = publish.staged_copy(folder_blocks(fr, written_lines(fr, False)), "file-manifest")
    return manifest.damage(stated, folder_blocks(fr, written_lines(fr, True)))


def blocks_sql(lines: str) -> str:
    return f"""SELECT folder, block, CASE WHEN block = max(block) OVER (PARTITION BY folder) THEN sha256(d || ':' || CAST(sum(bytes) OVER (PARTITION BY folder) AS VARCHAR)) ELSE d END AS d FROM (
 SELECT folder, block, sum(bytes) AS bytes, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {LANES})) AS d FROM (
 SELECT folder, pos // 4096 AS block, strlen(line) + 1 AS bytes, sha256(CAST(pos AS VARCHAR) || ':' || sha256(line)) AS h FROM (
  SELECT folder, line, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY folder ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM {lines})) GROUP BY 1, 2)"""


LIBRARY["o_stated_block"] = blocks_sql("{o_stated_line}")
LIBRARY["o_found_block"] = blocks_sql("{o_found_line}")


@query("snk_10_blocks", """SELECT folder AS path, 'hash_differs' AS problem, block FROM {o_stated_block} AS s FULL JOIN {o_found_block} AS f USING (folder, block) WHERE s.d IS DISTINCT FROM f.d AND folder NOT IN ('fund_1_FY1998', 'fund_9_FY1999')
 UNION ALL SELECT DISTINCT folder, 'file_missing', CAST(NULL AS BIGINT) FROM {o_stated_block} WHERE folder = 'fund_1_FY1998' UNION ALL SELECT DISTINCT folder, 'file_not_listed', CAST(NULL AS BIGINT) FROM {o_found_block} WHERE folder = 'fund_9_FY1999'""")
def snk_10_blocks(fr):
    """The same by blocks: files above a limit (here one byte) are read in pieces, and verification names the damaged ones."""
    sizes = {"whole_bytes": 0, "block_bytes": 4096}
    stated = publish.staged_copy(folder_blocks(fr, written_lines(fr, False), **sizes), "block-manifest")
    return manifest.damage(stated, folder_blocks(fr, written_lines(fr, True), **sizes))


def sliced_entries(fr):
    plan = folder_plan(fr).select("holding_id", "fund_id", "directory")
    entries = fr["f_manifest"].join(plan, "holding_id").select("packet_id", "holding_id", "fund_id", F.concat("directory", F.lit("/marks.csv")).alias("path"))
    packets_ = entries.select("packet_id", "fund_id").distinct()
    return publish.company_slice(entries.drop("fund_id"), packets_.join(plan, "fund_id").select("packet_id", "holding_id", "directory"), "h3")


@query("snk_11", "SELECT packet_id, holding_id, CASE WHEN holding_id = 'h3' THEN 'present' ELSE 'withheld' END AS part FROM {f_manifest}")
def snk_11(fr):
    """The position whose name is shared by others keeps its own folder, and only its entries are in the slice."""
    return sliced_entries(fr).select("packet_id", "holding_id", "part")


@query("snk_11_note", """SELECT packet_id, present, withheld, 'This is part of packet ' || packet_id || ': ' || present || ' of its ' || present + withheld || ' files, those in ' || coalesce(directory, 'no folder') || '. The other ' || withheld || ' are withheld, not absent; no total of the packet can be checked from this part.' AS note FROM (
 SELECT m.packet_id, count(*) FILTER (m.holding_id = 'h3') AS present, count(*) FILTER (m.holding_id <> 'h3') AS withheld, max(d.directory) AS directory FROM {f_manifest} AS m JOIN {f_holding} AS h ON h.holding_id = m.holding_id LEFT JOIN {o_directory} AS d ON d.holding_id = 'h3' AND d.fund_id = h.fund_id GROUP BY 1)""")
def snk_11_note(fr):
    return publish.scope_note(sliced_entries(fr)).select("packet_id", "present", "withheld", "note")


@query("snk_12", """SELECT 'requirement' AS table_name, count(*) AS rows FROM {o_outcome} UNION ALL SELECT 'assessment', count(*) FROM {o_outcome} UNION ALL SELECT 'evidence_link', count(*) FROM {o_link}""")
def snk_12(fr):
    a = assessment(fr)
    out = None
    for name, df in publish.assessment_tables(a.outcomes, rules.links(a), "policy-1").items():
        one = publish.staged_copy(df, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("snk_13", """SELECT claim_id, requirement, CASE WHEN d.side IS NULL THEN 'stored' ELSE 'declared' END AS only_on FROM (SELECT claim_id, requirement, 1 AS side FROM {f_declared_reliance}) AS d
 FULL JOIN (SELECT claim_id, requirement, 1 AS side FROM {f_stored_reliance}) AS s USING (claim_id, requirement) WHERE d.side IS NULL OR s.side IS NULL""")
def snk_13(fr):
    differing = publish.differing_claims(fr["f_declared_reliance"], fr["f_stored_reliance"])
    return differing.select("claim_id", "requirement", F.when(F.col("declared").isNull(), "stored").otherwise("declared").alias("only_on"))


@query("win_13", "SELECT period_id, requirement, claim_id, CAST(row_number() OVER (PARTITION BY holding_id, period_id, requirement ORDER BY issued_date, claim_id) AS BIGINT) AS place FROM {o_app}")
def win_13(fr):
    a = assessment(fr)
    scoped = rules.applicable_claims(a.ledger, a.periods).select("holding_id", "period_id", "requirement", "claim_id", "issued_date")
    return order.numbered(scoped, ["holding_id", "period_id", "requirement"], ["issued_date", "claim_id"], "place").select("period_id", "requirement", "claim_id", "place")


def stream_of(fr, name: str, files: int = 4, **columns):
    """A staged table replayed file by file, as its rows would have arrived."""
    frame = fr[name].select(*[c.alias(n) for n, c in columns.items()]) if columns else fr[name]
    path = publish.staging_path(fr.spark, f"arriving-{name}")
    frame.repartition(files).write.parquet(path)
    return fr.spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("str_01", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id, props AS idempotency_key FROM events")
def str_01(fr):
    events = stream_of(fr, "events", run_id=F.col("user_id").cast("string"), idempotency_key=F.col("props"), occurred_at=F.col("ts").cast("timestamp"))
    root = publish.staging_path(fr.spark, "stream-events")
    streams.log_to_end(streams.store_events(events), root)
    return fr.spark.read.schema("run_id string, idempotency_key string, occurred_at timestamp").parquet(f"{root}/log").select("run_id", "idempotency_key")


@query("str_02", "SELECT sha256(canonical_text) AS content_hash, count(*) AS arrivals, 1 AS stored FROM {f_document} GROUP BY 1")
def str_02(fr):
    docs = stream_of(fr, "f_document", document_id=F.col("document_id"), content_hash=S.content_hash(F.col("canonical_text")))
    kept = streams.store_documents(docs, publish.staging_path(fr.spark, "stream-documents"))
    return kept.groupBy("content_hash").agg(F.count("*").alias("arrivals"), F.count_if(F.col("arrival") == "new").cast("int").alias("stored"))


@query("str_03", "SELECT mark_id, decision_id, status FROM (SELECT *, row_number() OVER (PARTITION BY mark_id ORDER BY decided_at DESC, decision_id DESC) AS rn FROM {f_decision}) WHERE rn = 1")
def str_03(fr):
    arriving = stream_of(fr, "f_decision", mark_id=F.col("mark_id"), decision_id=F.col("decision_id"), decided_at=F.col("decided_at"), status=F.col("status"))
    log = streams.run_to_end(arriving, "decisions", streams.latest_decisions)
    kept = fr.spark.read.schema("mark_id string, decision_id bigint, decided_at timestamp, status string, batch int").parquet(log)
    return streams.current_decisions(kept).select("mark_id", "decision_id", "status")


CHANGED_PRICE = "part_key % 197 = 3 AND price_per_share IS NOT NULL"
CHANGED_STATUS = "part_key % 31 = 1 AND source_class = 'company_cap_table' AND execution_status = 'pro_forma'"
CHANGED_POLICY = "cust_key % 50 = 0"


@query("str_04", f"""SELECT d.decision_id FROM {{f_decision}} AS d JOIN {{f_latest_mark}} AS m ON m.mark_id = d.mark_id WHERE d.decision_type = 'valuation' AND d.status = 'approved' AND (
  EXISTS (SELECT 1 FROM {{f_mark_arrival}} AS a WHERE a.holding_id = m.holding_id AND a.period_id = m.period_id AND a.revision > m.revision)
  OR EXISTS (SELECT 1 FROM {{o_relied}} AS c WHERE c.holding_id = m.holding_id AND c.period_id = m.period_id AND (({CHANGED_PRICE}) OR ({CHANGED_STATUS})))
  OR EXISTS (SELECT 1 FROM {{f_policy_decision}} AS p JOIN {{f_holding}} AS h ON h.holding_id = p.holding_id WHERE p.holding_id = m.holding_id AND p.period_id = m.period_id AND {CHANGED_POLICY}))""")
def str_04(fr):
    """A revised mark, a changed price, another status and a changed policy decision arrive; exactly the approvals that rest on one are stale."""
    then = from_derived(fr)
    told = rules.Assessment(then, store=fr.store)
    approvals = fr["f_decision"].filter("decision_type = 'valuation' AND status = 'approved'").select("decision_id", "holding_id", "period_id", "mark_id").join(
        packets.approval_fingerprints(told, "policy-1").select("holding_id", "period_id", "mark_id", F.col("fingerprint").alias("recorded")), ["holding_id", "period_id", "mark_id"])
    approvals = publish.staged_copy(approvals.drop("mark_id"), "approvals")
    arrived = fr["f_mark_arrival"].select("holding_id", "period_id", F.col("mark_id").alias("arriving"), F.col("revision").alias("newer"), F.col("reported_amount").alias("restated"))
    revised = then.mark.join(arrived.withColumn("last", F.endswith("arriving", F.lit("+"))).filter("last"), ["holding_id", "period_id"]).filter("newer = revision + 1").withColumn(
        "mark_id", F.col("arriving")).withColumn("revision", F.col("newer")).withColumn("reported_amount", F.col("restated").cast("decimal(24,4)")).select(then.mark.columns)
    price = F.when(F.expr(CHANGED_PRICE), F.col("price_per_share") + 1).otherwise(F.col("price_per_share")).cast("decimal(18,6)")
    status = F.when(F.expr(CHANGED_STATUS), "unexecuted_referenced").otherwise(F.col("execution_status"))
    other = F.substring("holding_id", 2, 20).cast("bigint") % 50 == 0
    now = dataclasses.replace(
        then, mark=publish.staged_copy(then.mark.unionByName(revised), "marks"), claim=then.claim.withColumn("price_per_share", price).withColumn("execution_status", status),
        policy_decision=then.policy_decision.withColumn("to_class", F.when(other, "y").otherwise(F.col("to_class"))))
    whole = F.lit(None).cast("string").alias("period_id")
    changes = revised.select("holding_id", "period_id").unionByName(fr["f_claim"].filter(f"({CHANGED_PRICE}) OR ({CHANGED_STATUS})").select("holding_id", whole)).unionByName(
        fr["f_policy_decision"].filter(other).select("holding_id", "period_id"))
    path = publish.staging_path(fr.spark, "arriving-changes")
    changes.repartition(1).write.parquet(path)
    arriving = fr.spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(path)
    log = streams.run_to_end(arriving, "stale", streams.moving_prints(lambda: now, approvals, "policy-1"))
    kept = fr.spark.read.schema("decision_id bigint, holding_id string, period_id string, fingerprint string, current boolean, batch int").parquet(log)
    return streams.stale_now(kept).select("decision_id")
