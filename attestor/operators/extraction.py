"""CIT-04 and CIT-16 to 20: figures read out of documents by rules, each rule one literal expression.

A rule belongs to a document family and states a pattern with several groups: which group gives which field, which groups
must equal a parameter of the document (its purchaser, its date), and which group tells claims of one document apart.
Patterns are literals of the plan, so each is compiled once a task, and a document meets the rules of its own family
only, in one pass. Nothing is guessed: a rule that matches twice where it should match once is refused.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = "array<struct<rule:string,field_name:string,claim_key:string,hits:int,outcome:string,value_text:string,quote:string,span_start:int,span_end:int>>"


@dataclass(frozen=True)
class Rule:
    """``fields``: (field, group); ``where``: (group, column of the document) that must be equal, white space aside; ``claim_group``: each
    value of the group is a claim of its own; ``required``: a document without a match is refused, else it states nothing."""

    family: str
    name: str
    pattern: str
    fields: tuple[tuple[str, int], ...]
    where: tuple[tuple[int, str], ...] = ()
    claim_group: int | None = None
    required: bool = True
    groups: tuple[int, ...] = field(init=False)

    def __post_init__(self):
        used = {g for _, g in self.fields} | {g for g, _ in self.where} | ({self.claim_group} if self.claim_group else set())
        object.__setattr__(self, "groups", tuple(sorted(used | {0})))


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def matches(text: Column, rule: Rule) -> Column:
    """Every match of the pattern: its groups (g0 is the whole match) and where it begins.

    Java's split and find meet the same matches, so a match begins behind the pieces and matches before it.
    """
    found = {g: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in rule.groups}
    pieces = F.split(text, rule.pattern, -1)
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))
    starts = F.transform(found[0], lambda _, i: length(F.slice(pieces, F.lit(1), i + 1)) + length(F.slice(found[0], F.lit(1), i)))
    return F.arrays_zip(*[found[g].alias(f"g{g}") for g in rule.groups], starts.alias("start"))


def outcomes(text: Column, rule: Rule) -> Column:
    """What the rule gives for a text, as an array of SHAPE: a row for each field and claim."""

    def equal(group: int, parameter: str):
        return lambda m: flat(m[f"g{group}"]) == flat(F.col(parameter))

    def of(every: Column) -> Column:
        fits = every
        for group, parameter in rule.where:
            fits = F.filter(fits, equal(group, parameter))
        one = lambda own, claim: F.array(*[row(own, claim, *f) for f in rule.fields])
        if rule.claim_group is None:
            return one(fits, F.lit(None).cast("string"))
        name = f"g{rule.claim_group}"
        keys = F.array_distinct(F.transform(fits, lambda m: flat(m[name])))
        each = F.flatten(F.transform(keys, lambda k: one(F.filter(fits, lambda m: flat(m[name]) == k), k)))
        return F.when(F.size(fits) > 0, each).otherwise(one(fits, F.lit(None).cast("string")))

    def row(own: Column, claim: Column, field_name: str, group: int) -> Column:
        hits, first = F.size(own), F.get(own, F.lit(0))
        cited = hits == 1
        nothing = "pattern_matched_nothing" if rule.required else "not_stated"
        outcome = F.when(cited, "cited").when(hits == 0, nothing).otherwise("pattern_is_ambiguous")
        quote = F.when(cited, first["g0"])
        start = F.when(cited, first["start"])
        return F.struct(F.lit(rule.name).alias("rule"), F.lit(field_name).alias("field_name"), claim.alias("claim_key"), hits.alias("hits"), outcome.alias("outcome"),
                        F.when(cited, flat(first[f"g{group}"])).alias("value_text"), quote.alias("quote"), start.alias("span_start"), (start + F.length(quote)).alias("span_end"))

    # The matches are found once: a lambda over a one-element array binds them.
    return F.element_at(F.transform(F.array(matches(text, rule)), of), 1).cast(SHAPE)


def extract(documents: DataFrame, rules: tuple[Rule, ...], key: str = "claim_id", text: str = "canonical_text") -> DataFrame:
    """Rows (key, family, rule, field_name, claim_key, hits, outcome, value_text, quote, span_start, span_end) of every document and
    rule of its family. A document of a family without rules gives none."""
    families = sorted({r.family for r in rules})
    none = F.array().cast(SHAPE)
    own = reduce(lambda rest, name: F.when(F.col("family") == name, F.concat(*[outcomes(F.col(text), r) for r in rules if r.family == name])).otherwise(rest), families, none)
    return documents.filter(F.col("family").isin(families)).select(key, "family", F.explode(own).alias("_row")).select(key, "family", "_row.*")


def refused(extracted: DataFrame, key: str = "claim_id") -> DataFrame:
    """Documents that a required rule refuses, with what was wrong; all of a refused document's figures are open to doubt."""
    wrong = extracted.filter(F.col("outcome").isin("pattern_matched_nothing", "pattern_is_ambiguous"))
    return wrong.groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws(": ", "field_name", "outcome"))).alias("refusals"))
