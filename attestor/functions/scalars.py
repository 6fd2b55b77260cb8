"""Scalar expressions: every function takes and returns a Column, nothing runs per row in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor import model

# Wide enough for any stated figure, narrow enough that a difference of two keeps all six decimals.
NUMBER = "decimal(34,6)"
SPACE = r"[ \t\n\r\f\x0B]"
# Anything but white space, of any script.
VISIBLE = r"(?U)\S"


# A digit other than 0 beyond the sixth decimal: such a figure is refused, never rounded.
FINER = r"\.[0-9]{6}[0-9]*[1-9]"


def exact_number(text: Column) -> Column:
    """The figure a plain text states, null when it does not read or has more decimals than can be kept."""
    number = text.try_cast(NUMBER)
    return F.when(~text.rlike(FINER) & ~(text.rlike("[eE]") & (text.try_cast("double") != number.cast("double"))), number)


def number_from_cell(cell: Column) -> Column:
    """FN-01: a figure typed into a cell; parentheses mean negative, anything else is null."""
    text = F.regexp_replace(F.trim(cell), "[,$]", "")
    inside = F.regexp_extract(text, r"^\((.*)\)$", 1)
    signed = F.when(text.startswith("(") & text.endswith(")"), F.concat(F.lit("-"), inside)).otherwise(text)
    return exact_number(signed)


def exact_day(cell: Column) -> Column:
    """FN-03: month/day/year only; a cell that could mean several days is null."""
    text = F.trim(cell)
    strict = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), text)
    return F.to_date(F.try_to_timestamp(strict, F.lit("M/d/yyyy")))


def day_range(cell: Column) -> Column:
    """FN-02: the earliest and latest day a cell could mean, as struct<lo,hi>."""
    text = F.trim(cell)
    day = exact_day(cell)
    month_text = F.when(text.rlike(r"^\d{1,2}/\d{4}$"), F.concat(F.lit("1/"), text))
    month = F.to_date(F.try_to_timestamp(month_text, F.lit("d/M/yyyy")))
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    first = F.when(F.size(years) > 0, F.make_date(F.array_min(years), F.lit(1), F.lit(1)))
    last = F.when(F.size(years) > 0, F.make_date(F.array_max(years), F.lit(12), F.lit(31)))
    return F.struct(
        F.coalesce(day, month, first).alias("lo"),
        F.coalesce(day, F.last_day(month), last).alias("hi"),
    )


def company_key(label: Column) -> Column:
    """FN-04: the part of a label before its first parenthesis."""
    return F.trim(F.substring_index(label, " (", 1))


def fund_key(label: Column) -> Column:
    """FN-05: one fund named at the start becomes its key; two funds in one label stay as written."""
    text = F.trim(label)
    one = r"Fund\s+(?:[IVXLCDM]+|\d+)(?![\w'])"
    several = rf"(?i){one}\s*(?:[/&,]|\band\b)\s*(?:Fund\s+)?(?:[IVXLCDM]+|\d+)(?![\w'])"
    numeral = F.regexp_extract(text, r"(?i)^Fund\s+([IVXLCDM]+|\d+)(?![\w'])", 1)
    return (
        F.when(label.isNull() | (label == ""), F.lit(None))
        .when(text.rlike(several), text)
        .when(numeral != "", F.concat(F.lit("Fund "), F.upper(numeral)))
        .otherwise(text)
    )


def period_end(label: Column) -> Column:
    """FN-06: last day of FYyyyy or yyQn (n in 1..4), else null."""
    text = F.upper(F.trim(label))
    fiscal = F.regexp_extract(text, r"^FY(\d{4})$", 1)
    year = F.regexp_extract(text, r"^(\d{2})Q[1-4]$", 1)
    quarter = F.regexp_extract(text, r"^\d{2}Q([1-4])$", 1)
    return F.when(fiscal != "", F.make_date(fiscal.cast("int"), F.lit(12), F.lit(31))).when(
        year != "", F.last_day(F.make_date(2000 + year.cast("int"), quarter.cast("int") * 3, F.lit(1)))
    )


def period_scope(fund: Column, label: Column, packet_periods: dict[str, tuple[str, ...]]) -> Column:
    """FN-07: packet when the fund declares this label, lineage_only otherwise."""
    hit = F.lit(False)
    for name, labels in packet_periods.items():
        hit = hit | ((F.coalesce(fund, F.lit("")) == name) & label.isin(*labels))
    return F.when(hit, "packet").otherwise("lineage_only")


def is_material(gap: Column, reference: Column) -> Column:
    """FN-08: at least the smaller of 0.1% of the reference and 1000; a zero gap never is."""
    share = F.abs(reference).cast("decimal(28,6)") * F.lit(model.MATERIALITY_RELATIVE).cast("decimal(4,3)")
    threshold = F.least(share, F.lit(model.MATERIALITY_ABSOLUTE).cast("decimal(33,9)"))
    return (gap != 0) & (F.abs(gap).cast("decimal(28,6)") >= threshold)


def is_exit(kind: Column) -> Column:
    return F.trim(kind).rlike("(?i)^(exit|realis|realiz|distrib)")


def is_investment(kind: Column) -> Column:
    return kind.rlike(r"(?i)\bfund\b") & ~is_exit(kind)


def row_kind(kind: Column) -> Column:
    """FN-09: exits are told first, because an exit row may also name a fund."""
    return F.when(is_exit(kind), "exit").when(is_investment(kind), "investment").otherwise("unrecognised")


def implied_cost(price: Column, count: Column) -> Column:
    """FN-10: price times count, every decimal of both kept; unknown when either is."""
    return price.cast("decimal(18,6)") * count.cast("decimal(18,6)")


def cited_numeral(text: Column) -> Column:
    """FN-11: the one figure a text states, or null; grouped thousands only, no dangling separators."""
    s = SPACE
    whole = r"(?:0|[1-9][0-9]{0,2}(?:,[0-9]{3})+|[1-9][0-9]*)"
    grammar = rf"\A{s}*\(?{s}*-?{s}*\$?{s}*{whole}(?:\.[0-9]+)?{s}*%?{s}*\)?{s}*\z"
    magnitude = exact_number(F.regexp_replace(text, r"[^0-9.]", ""))
    return F.when(text.rlike(grammar), F.when(text.rlike(rf"\A{s}*[(-]"), -magnitude).otherwise(magnitude))


def value_token_occurrences(quote: Column, value: Column) -> Column:
    """FN-12: how often a value stands in a quote as a whole figure, overlapping hits included."""
    literal = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"(?<![0-9,.\-])(?="), literal, F.lit(r"(?![0-9,.])(?![eE][\p{Nd}+\-]))"))
    return F.when(value == "", 0).otherwise(F.regexp_count(quote, pattern))


def supports_value(quote: Column, value: Column) -> Column:
    """FN-13: the quote states the value exactly once."""
    return value_token_occurrences(quote, value) == 1


def occurrences(text: Column, quote: Column) -> Column:
    """Non-overlapping hits of a literal."""
    gone = F.length(text) - F.length(F.replace(text, quote, F.lit("")))
    return F.when(F.length(quote) > 0, (gone / F.length(quote)).cast("int")).otherwise(0)


def span_resolves(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """FN-16: half-open code-point span inside the text whose slice is the quote."""
    return (end <= F.length(text)) & (F.substring(text, start + 1, end - start) == quote)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def text_hash(extractor: Column, text: Column) -> Column:
    """FN-17: the extractor is part of the identity, a NUL keeps the two parts apart."""
    return F.sha2(F.concat(extractor, F.char(F.lit(0)), text), 256)


def months_back(day: Column, months: int) -> Column:
    """FN-20: the same day of an earlier month, clamped to its last day."""
    return F.add_months(day, -months)


def fits_scale(value: Column, scale: int) -> Column:
    """FN-21: true when nothing is lost at this scale; the caller refuses the rest, never rounds."""
    return value.cast(f"decimal(26,{scale})").cast("decimal(38,12)") == value.cast("decimal(38,12)")


def plain_figure(value: Column) -> Column:
    """FN-23: a decimal as text without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def rounds_to(value: Column, stated: Column, unit: Column) -> Column:
    """FN-22: the stated figure is the value rounded half-even to a whole number of units."""
    usable = F.when(unit != 0, unit).cast("decimal(12,4)")
    units = F.bround((value.cast("decimal(26,8)") / usable).cast("decimal(30,12)"), 0).cast("decimal(20,0)")
    return F.coalesce(stated.cast("decimal(34,8)") == (units * usable).cast("decimal(34,8)"), F.lit(False))


def money_text(amount: Column, currency: Column) -> Column:
    return F.concat(F.format_number(amount, 2), F.lit(" "), currency)


def figure_tokens(text: Column) -> Column:
    """FN-24: the distinct figures of a text, thousands separators dropped."""
    raw = F.regexp_extract_all(text, F.lit(r"(\d[\d,.]*)"), F.lit(1))
    clean = F.transform(raw, lambda t: F.replace(F.regexp_replace(t, "[.,]+$", ""), F.lit(","), F.lit("")))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def dated(text: Column) -> Column:
    """FN-25: the (year, month) a line names; month is null when only a year is named."""
    names = "|".join(MONTHS)
    found = rf"(?i)(?:({names})|(\d{{1,2}}))[\s./]*(\d{{4}})"
    name, digits, year = (F.regexp_extract(text, found, n) for n in (1, 2, 3))
    month = F.when(name != "", F.array_position(F.lit(list(MONTHS)), F.lower(name)).cast("int")).otherwise(digits.try_cast("int"))
    bare = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    whole = (year != "") & month.between(1, 12)
    return F.struct(
        F.when(whole, year.try_cast("int")).otherwise(bare).alias("year"),
        F.when(whole, month).alias("month"),
    )


def class_slug(series: Column) -> Column:
    return F.concat(F.lit("series_"), F.lower(F.replace(series, F.lit("-"), F.lit(""))))


def sentences(text: Column) -> Column:
    """FN-26: whitespace flattened, cut after . or ; before a capital or an opening parenthesis."""
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?<=[.;])\s+(?=[A-Z(])")


def effective_date(issued: Column, received: Column) -> Column:
    """FN-27: the later of the two; a claim cannot be known before it arrives."""
    return F.greatest(issued, F.coalesce(received, issued))


def record_digest(*columns: Column) -> Column:
    """FN-31: digest of a record; callers pass the columns in name order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def fingerprint(*parts: Column) -> Column:
    """FN-36: everything that decided a recording, parts kept apart by NUL."""
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.char(F.lit(0)), part)
    return F.sha2(joined, 256)


def refusal_outcome(reason: Column) -> Column:
    """FN-33: each enumerated refusal has one outcome; an unknown one stays null for the audit."""
    return (
        F.when(reason.startswith("NO_PRICE_FOR_CLASS:"), "unconfirmable")
        .when(reason.isin("NO_APPLICABLE_EVIDENCE", "NO_PRICE_IN_EVIDENCE"), "unconfirmable")
        .when(reason.isin("COMPONENT_WITHOUT_SHARE_COUNT", "NO_VALUE_FIELD_CITED"), "blocked_incomplete")
    )


def gap_verdict(kind: Column) -> Column:
    """FN-34: verdict of a recorded gap; no gap at all has its own row of the table."""
    return _gap_field(kind, 1)


def gap_reason(kind: Column, prefix: str = "") -> Column:
    """FN-34: reason code of a gap; with a prefix the kind itself is spelled out."""
    if prefix:
        return F.concat(F.lit(prefix + "_"), F.upper(F.coalesce(kind, F.lit("none"))))
    return _gap_field(kind, 2)


def gap_action(kind: Column) -> Column:
    return _gap_field(kind, 3)


def _gap_field(kind: Column, position: int) -> Column:
    out = F
    for row in model.GAP_VERDICTS:
        out = out.when(F.coalesce(kind, F.lit("none")) == row[0], row[position])
    return out


def variance_class(concluded: Column, recomputed: Column) -> Column:
    """FN-35: exact, a rounding at some power of ten within 0.1% of the value, or for review."""
    limit = F.abs(concluded).cast("decimal(28,6)") * F.lit("0.001").cast("decimal(4,3)")
    scales = F.filter(
        F.lit([10**n for n in range(12)]),
        lambda s: (s.cast("decimal(20,0)") <= limit)
        & ((F.bround((recomputed.cast("decimal(26,6)") / s.cast("decimal(12,0)")).cast("decimal(30,12)"), 0).cast("decimal(18,0)")
            * s.cast("decimal(12,0)")).cast("decimal(30,6)") == concluded.cast("decimal(30,6)")),
    )
    return (
        F.when(recomputed.isNull(), "NO_RECOMPUTATION")
        .when(concluded.cast("decimal(30,6)") == recomputed.cast("decimal(30,6)"), "EXACT")
        .when(F.size(scales) > 0, "ROUNDING_VARIANCE")
        .otherwise("UNRECOGNISED_VARIANCE_REVIEW_REQUIRED")
    )
