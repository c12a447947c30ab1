"""Secrets in texts, with an incremental ledger of scanned blobs. DataFrame functions only.

A version is a text at a path. Its content address is the SHA-256 of the text, and equal
texts are one blob, whatever path or time they come from. The ledger has a row for each pair
of blob and rule version that was ever scanned, with its findings, also if it has none. A
scan takes only the pairs that the ledger lacks and joins the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableset.llm.common import stored

LEDGER = "blob string, rule_version string, findings array<struct<start:int,rule:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and without overlap; those where the ``part`` group
    (0: the match) is shorter than ``least`` code points are dropped, not searched again."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 1


# The kinds of secrets in their order.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
RULE_VERSION = "1"


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, rule, kind, end) in code points, end exclusive.

    The text between matches is what splitting at the pattern leaves, so positions are sums
    of lengths. A rule without groups that matches runs of one class finds the same spans when
    short runs don't match at all, which saves listing them.
    """
    pattern = F.lit(rule.pattern)
    if rule.pattern.endswith("]+") and rule.part == 0:
        fixed = len(rule.pattern[: rule.pattern.index("[")])
        pattern = F.lit(f"{rule.pattern[:-1]}{{{rule.least - fixed},}}")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)

    def walk(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        part = F.length(F.regexp_extract(pair["match"], rule.pattern, rule.part)) if rule.part else F.length(pair["match"])
        span = F.struct(start.alias("start"), F.lit(number).alias("rule"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(part >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,rule:int,kind:string,end:int>>")
    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    all_spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), walk)["spans"]
    return F.when(text.rlike(pattern_text(rule)), all_spans).otherwise(none)


def pattern_text(rule: Rule) -> str:
    """What a text must contain for the rule to find anything; cheap to search for."""
    if rule.part == 0 and rule.pattern.endswith("]+"):
        fixed = len(rule.pattern[: rule.pattern.index("[")])
        return f"{rule.pattern[:-1]}{{{rule.least - fixed}}}"
    return rule.pattern


def scan(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan the blobs of ``versions`` that ``ledger`` lacks under ``rule_version``.

    Returns the findings (``row``: the version's row with all its columns, paths among them; ``blob``;
    ``findings``: spans by start, then by the rules' order) and the new ledger rows, written
    to the shared folder, to be added to the ledger. NULL texts count as empty. Repeated rows
    are versions of one blob. With an empty table both are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blob = F.sha2(text.cast("binary"), 256)
    blobs = versions.select(blob.alias("blob"), text.alias("text"))
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(known, "blob", "left_anti")
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    found = F.array_sort(F.concat(*(spans(F.col("text"), r, i) for i, r in enumerate(rules))))
    fresh = stored(unseen.select("blob", F.lit(rule_version).alias("rule_version"), found.alias("findings")), "ledger")
    now = fresh if ledger is None else fresh.union(ledger.filter(F.col("rule_version") == rule_version).select("blob", "rule_version", "findings"))
    rows = versions.select(F.struct("*").alias("row"), blob.alias("blob"))
    return rows.join(now.select("blob", "findings"), "blob", "left").select("row", "blob", "findings"), fresh
