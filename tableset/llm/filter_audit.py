"""What filters do to one another: metrics of every step of every order of them.

Documents become cells first: a part, the mask of the filters that its documents fail, and
their counts. The orders are then enumerated by a recursive common table expression: a
prefix of filters, with the bits of those applied, is extended by each unused letter, meets the
cells of its part, and carries the new bits on. A level of the recursion emits the metrics
of that step; orders share the prefixes they have in common, so n filters take as many rows
as there are prefixes (325 for five), not n steps for each order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableset.llm.common import stored
from tableset.session import fresh_path, setting

SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Filter:
    """``fails`` is a condition over ``text`` and ``words``, or None for texts that a smaller id has too."""

    letter: str
    fails: Column | None


def filters() -> tuple[Filter, ...]:
    words, text = F.col("words"), F.col("text")
    return (
        Filter("A", F.size(words) < 50),
        Filter("B", 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)),
        Filter("C", 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 5 * F.length(text)),
        Filter("D", text.rlike(r"[#$%&*|]")),
        Filter("E", None),
    )


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order."""
    inner = F.btrim(text, F.lit(" \t\n\v\f\r"))
    return F.when(inner != "", F.split(inner, SPACE)).otherwise(F.array().cast("array<string>"))


def cells(docs: DataFrame, labels: DataFrame, chosen: Sequence[Filter], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``part``, ``mask`` and the numbers ``n``, ``good`` and ``toxic`` of its documents, zero counts left out.

    Texts are reduced to a digest and bits where they are read. Rows of one id, text and part are
    counted together before they meet the labels, and equal texts of a part before the
    smallest id of a text is looked up, so a text that a third of all rows have is a row
    for each task, then one for each part and label.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), words_of(text).alias("words")
    )
    bits = sum((F.when(f.fails, 1 << i).otherwise(0) for i, f in enumerate(chosen) if f.fails is not None), F.lit(0))
    same = sum(1 << i for i, f in enumerate(chosen) if f.fails is None)
    thin = thin.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), bits.cast("int").alias("bits"))
    rows = thin.groupBy("id", "part", "digest", "bits").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        *(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic")))
    )
    rows = rows.join(marks, "id", "left")
    own = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    groups = rows.groupBy("digest", "bits", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.min(own).alias("first"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless")
    )
    groups = stored(groups, "texts")
    first = groups.groupBy("digest").agg(F.min("first.id").alias("smallest"))
    # Rows of the smallest id, and rows without id, pass the filter of repeated texts.
    passing = F.col("nameless") + F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = groups.join(first, "digest").withColumn("passing", passing)
    sides = F.array(
        F.struct(F.col("bits").alias("mask"), F.col("passing").alias("m")),
        F.struct(F.col("bits").bitwiseOR(F.lit(same)).alias("mask"), (F.col("n") - F.col("passing")).alias("m")),
    )
    counted = both.select("part", "good", "toxic", F.inline(sides)) if same else both.select("part", "good", "toxic", F.col("bits").alias("mask"), F.col("n").alias("m"))

    def number(condition: Column | None) -> Column:
        return F.sum(F.col("m") if condition is None else F.when(condition, F.col("m")).otherwise(0))

    out = counted.filter("m > 0").groupBy("part", "mask")
    return out.agg(number(None).alias("n"), number(F.col("good")).alias("good"), number(F.col("toxic")).alias("toxic"))


_WALK = """
WITH RECURSIVE walk(part, prefix, letter, step, applied, cells, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', '', 0, 0, cells, 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT part, prefix || f.letter, f.letter, step + 1, applied | f.bit, cells,
    aggregate(cells, 0L, (s, c) -> s + IF(c.mask & (applied | f.bit) = 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + IF(c.mask & applied = 0 AND c.mask & f.bit <> 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + IF(c.mask & applied <> 0 AND c.mask & f.bit <> 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + IF(c.mask = f.bit, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + IF(c.mask & applied = 0 AND c.mask & f.bit <> 0, c.good, 0L)),
    aggregate(cells, 0L, (s, c) -> s + IF(c.mask & applied = 0 AND c.mask & f.bit <> 0, c.toxic, 0L))
  FROM walk LATERAL VIEW inline(array({letters})) f AS letter, bit
  WHERE applied & f.bit = 0
)
SELECT part, prefix, letter, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM walk WHERE step > 0
"""


def prefixes(counted: DataFrame, letters: Sequence[str]) -> DataFrame:
    """Metrics of the last step of every prefix of every order, for each part; written to the shared folder.

    A part has at most a cell for each mask, so the array that its rows carry is bounded.
    The recursion reads the cells as a written table, once.
    """
    spark = counted.sparkSession
    arrays = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    source = stored(arrays, "cells")
    letters_sql = ", ".join(f"struct('{x}', {1 << i})" for i, x in enumerate(letters))
    # The rows are bounded by the parts, not by a number.
    path = fresh_path(spark, "prefixes")
    with setting(spark, "spark.sql.cteRecursionRowLimit", "-1"):
        walked = spark.sql(_WALK.format(cells="{cells}", letters=letters_sql), cells=source)
        walked.write.parquet(path)
    return spark.read.schema(walked.schema).parquet(path)


def audit(
    docs: DataFrame, labels: DataFrame, chosen: Sequence[Filter] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row for each part, order of the filters and step, also where all counts are zero.

    ``kept`` documents after the step, ``removed`` by it, ``redundant`` ones that fail its filter but
    went earlier, ``unique_fails`` that fail its filter only, ``good_lost`` and ``toxic_lost`` among
    the removed by ``labels`` (doc_id, quality, toxic; several rows of an id count as one that has
    the largest values), ``shapley`` what its filter removes, summed over all orders.

    NULL texts count as empty, a NULL part is the empty one. Rows are documents: repeated rows of an
    id count each, none repeats another's text. A row without id repeats no text and none
    repeats it. An empty table has no part and no row.
    """
    chosen = filters() if chosen is None else chosen
    letters, n = [f.letter for f in chosen], len(chosen)
    steps = prefixes(cells(docs, labels, chosen, id_col, text_col, part_col), letters)
    orders = F.element_at(F.array(*(F.lit(math.factorial(n - i)).cast("long") for i in range(1, n + 1))), F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    steps = steps.join(shapley, ["part", "letter"])
    whole = steps.filter(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    whole = whole.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step")))
    return whole.join(steps, ["part", "prefix", "step"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
