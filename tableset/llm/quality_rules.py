"""Quality rules by a ledger of rule bits: texts are read once, policies are applied to bits.

``ledger`` evaluates every rule once for each document and stores its measurements and one
long whose bit i says that rule i fails. What is asked later reads the ledger and no text:
``rejects`` applies a version of a policy, ``decisions`` several of them, ``rejudged``
other rules over the stored measurements, and ``ablations`` what each rule of a policy adds,
from the counts of the bit patterns that occur. A rule keeps its bit for good; a changed
limit is a rule of another name with the next bit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableset.llm.common import stored

MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")
SPACE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL condition over the measurements, in whole numbers so that it is exact."""

    name: str
    fails: str


#: Bit i of a pattern is the i-th rule.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "100 * word_chars < 250 * n_words"),
    Rule("long_words", "100 * word_chars > 1200 * n_words"),
    Rule("upper_case", "100 * n_upper > 50 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """Rejects what fails any rule of ``hard``, or more than ``allowed`` rules of ``soft``."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0


BASE = Policy("base", ("few_words", "repeated_words"))
POLICY = Policy("1", (*BASE.hard, "symbols", "repeated_lines", "upper_case"), ("short_words", "long_words"), 0)


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text. Words are runs of anything but ASCII white space; NULL has none.

    A repeated line has a word and equals an earlier line. A repeated word lies in a window
    of three words that the text has twice or more.
    """
    text = text or ""
    raw = text.encode()
    words, lines, seen, repeated = raw.split(), raw.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            repeated += bool(line.strip())
        else:
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(raw) - len(raw.translate(None, UPPER)),
        len(lines),
        repeated,
        repeated_words(words),
    )


def repeated_words(words: list[bytes]) -> int:
    n, known = len(words), {}
    if n < 3:
        return 0
    code = np.fromiter(map(known.setdefault, words, count()), np.int64, n)
    pair = np.unique(code[:-1] * n + code[1:], return_inverse=True)[1]
    _, window, times = np.unique(pair[:-1] * n + code[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return int(covered.sum())


def _measured(texts: pa.Array) -> pa.Array:
    rows = [measure(t.as_py()) for t in texts]
    columns = zip(*rows) if rows else [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


def pattern(rules: Sequence[Rule] = RULES) -> Column:
    """Bits of the failed rules, from columns of the measurements' names."""
    return reduce(Column.bitwiseOR, (F.when(F.expr(r.fails), 1 << i).otherwise(0).cast("long") for i, r in enumerate(rules)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row for each row of ``docs``, written to the shared folder.

    Columns ``id``, ``text_hash`` (of the text that was read), the measurements and
    ``failed``. NULL texts count as empty, with all measurements 0 but one line; repeated rows
    and rows without id have a row each; an empty table has an empty ledger. Other columns
    of ``docs`` are not read.
    """
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    measures = ", ".join(f"{m}: bigint" for m in MEASURES)
    read = thin.select("id", F.xxhash64("text").alias("text_hash"), F.arrow_udf(_measured, f"struct<{measures}>")("text").alias("m"))
    return rejudged(stored(read.select("id", "text_hash", "m.*"), "measures"), rules)


def rejudged(measured: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The ledger under other rules, from its measurements."""
    return measured.select("id", "text_hash", *MEASURES, pattern(rules).alias("failed"))


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in set(names))


def rejects(failed: Column, policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """Whether the policy rejects a pattern."""
    hard, soft = (F.lit(mask(names, rules)).cast("long") for names in (policy.hard, policy.soft))
    return (failed.bitwiseAND(hard) != 0) | (F.bit_count(failed.bitwiseAND(soft)) > policy.allowed)


def decisions(entries: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES) -> DataFrame:
    """``id``, ``text_hash``, ``policy`` and ``kept`` of every row under every version, in one pass over the ledger."""
    versions = F.array(*(F.struct(F.lit(p.version).alias("policy"), (~rejects(F.col("failed"), p, rules)).alias("kept")) for p in policies))
    return entries.select("id", "text_hash", F.inline(versions))


def ablations(entries: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES) -> DataFrame:
    """What each rule does in each policy: a row for each policy and rule of it.

    ``n_failed`` documents that fail the rule, ``kept`` by the policy, ``kept_without`` by the
    policy without this rule, ``sole`` that fail nothing else of the policy. Only the number of
    documents of each pattern is shuffled, and ``also`` (bits that some document failing the
    rule fails too) and ``always`` (bits that all of them fail) come from bitwise aggregates.
    """
    patterns = entries.groupBy("failed").agg(F.count("*").alias("n"))
    failed, cases = F.col("failed"), []
    for p in policies:
        whole = F.lit(mask(p.hard + p.soft, rules)).cast("long")
        for name in (r.name for r in rules if r.name in p.hard + p.soft):
            bit = F.lit(mask((name,), rules)).cast("long")
            cases.append(F.struct(
                F.lit(p.version).alias("policy"), F.lit(name).alias("rule"), (failed.bitwiseAND(bit) != 0).alias("fails"),
                (~rejects(failed, p, rules)).alias("kept"),
                (~rejects(failed.bitwiseAND(F.bitwise_not(bit)), p, rules)).alias("kept_without"),
                (failed.bitwiseAND(whole) == bit).alias("sole"),
            ))
    if not cases:
        return patterns.sparkSession.createDataFrame([], "policy string, rule string, n_failed long, kept long, kept_without long, sole long, also long, always long")
    each = patterns.select("failed", "n", F.inline(F.array(*cases)))

    def documents(condition: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(condition), F.col("n"))), F.lit(0)).alias("n_failed" if condition == "fails" else condition)

    mine = F.when(F.col("fails"), failed)
    return each.groupBy("policy", "rule").agg(
        *map(documents, ("fails", "kept", "kept_without", "sole")), F.bit_or(mine).alias("also"), F.bit_and(mine).alias("always")
    )
