"""Filter interaction audit: what each filter removes in every order, by multilinear extensions.

Every document gets a mask: bit i is set if filter i fails it. The documents of a part that a set S of filters removes
are those whose mask meets S. Over probabilities x of applying the filters that count becomes the part's removal
polynomial, which is linear in each x:

    f(x) = sum over masks m of n(m) * (1 - product over i in m of (1 - x_i)) = sum over sets T of a(T) * product over i in T of x_i

Its values at the corners of the cube are what sets of filters remove, so they give the survivors of every order and
step; the integral of its i-th partial derivative along the diagonal from 0 to 1 is filter i's Shapley value, the mean
over all orders of what i removes. Coefficients are integers and integrals exact fractions, so values scaled by the
number of orders are integers.

Masks are counted in Spark, one row per part and mask (at most 2^filters per part, combined on the map side); a part's
polynomials come from those counts alone.

Defined results: a null text is empty, a null lang the part ``''`` (as is an empty one); a text is a repeat if a row
with a smaller id has the same text, so rows without an id are never repeats and make none, and rows that repeat an id
and text don't repeat each other; a label counts if any row of ``labels`` for the id holds it, rows without an id have
none; an empty table has no parts and so no rows; long texts are split into words in memory, so one text must fit a
task several times; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The filters in order of bit: letter and failure condition over the measures; the last is the table-wide repeat.
CONDITIONS = (
    ("A", "n_words < 200"),
    ("B", "100 * n_distinct < 50 * n_words"),
    ("C", "100 * n_upper > 3 * n_chars"),
    ("D", "has_symbol"),
)
REPEAT = "E"
FILTERS = tuple(name for name, _ in CONDITIONS) + (REPEAT,)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the input row as a struct) and what the conditions need of its whole text."""
    d = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    words = F.array_remove(F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " "), "")
    d = d.select("row", "text", words.alias("words"))
    # Behind a generator, the optimizer can't repeat these for every condition.
    return d.select("row", F.inline(F.array(F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.col("text").rlike("[#$%&*|]").alias("has_symbol"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    ))))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and failure mask, and those of them labelled so."""
    bits: Column = F.lit(0)
    for k, (_, condition) in enumerate(CONDITIONS):
        bits = bits + F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0))
    narrow = measured(docs).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.lang").cast("string"), F.lit("")).alias("part"), bits.cast("int").alias("bits"), "digest")
    # Equal rows are one entry before anything is joined, so no text, id or part is hot below.
    entries = written(narrow.groupBy("digest", "doc_id", "part", "bits").agg(F.count("*").alias("n")), "audit-entries")
    first = entries.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.filter("doc_id IS NOT NULL AND (good OR toxic)").groupBy("doc_id").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    known = entries.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    repeat = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.lit(1 << len(CONDITIONS))).otherwise(F.lit(0))
    return known.groupBy("part", (F.col("bits") + repeat).alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


class Removal:
    """The removal polynomial of counts by mask: ``coefficients[T]`` belongs to the product of the x_i with i in T."""

    def __init__(self, counts: dict[int, int], n_filters: int):
        self.n_filters = n_filters
        holding = [counts.get(m, 0) for m in range(1 << n_filters)]
        for i in range(n_filters):  # sums over all masks that hold T
            for t in range(1 << n_filters):
                if not t >> i & 1:
                    holding[t] += holding[t | 1 << i]
        self.coefficients = [0] + [holding[t] if t.bit_count() % 2 else -holding[t] for t in range(1, 1 << n_filters)]
        self.corners = list(self.coefficients)
        for i in range(n_filters):  # f at a corner: sums over all T inside it
            for s in range(1 << n_filters):
                if s >> i & 1:
                    self.corners[s] += self.corners[s ^ 1 << i]

    def at(self, x: list[Fraction]) -> Fraction:
        total = Fraction(0)
        for t, a in enumerate(self.coefficients):
            product = Fraction(a)
            for i in range(self.n_filters):
                if t >> i & 1:
                    product *= x[i]
            total += product
        return total

    def shapley(self, i: int) -> Fraction:
        """The integral over t from 0 to 1 of the i-th partial derivative at (t, ..., t): a(T) * t^(|T| - 1) for T with i."""
        return sum((Fraction(a, t.bit_count()) for t, a in enumerate(self.coefficients) if t >> i & 1), Fraction(0))


ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _orders(filters: tuple[str, ...]):
    n, full = len(filters), (1 << len(filters)) - 1

    def of_part(part: str, counts: pd.DataFrame) -> Iterator[tuple]:
        total = sum(map(int, counts["n"]))
        everything, good, toxic = (Removal({int(m): int(v) for m, v in zip(counts["mask"], counts[c], strict=True)}, n) for c in ("n", "good", "toxic"))
        shapley = [int(everything.shapley(i) * factorial(n)) for i in range(n)]
        for order in permutations(range(n)):
            before = 0
            for step, i in enumerate(order, 1):
                after = before | 1 << i
                removed = everything.corners[after] - everything.corners[before]
                yield (
                    part, "".join(filters[k] for k in order), step, total - everything.corners[after], removed, everything.corners[1 << i] - removed,
                    everything.corners[full] - everything.corners[full ^ 1 << i], good.corners[after] - good.corners[before], toxic.corners[after] - toxic.corners[before], shapley[i])
                before = after

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for part, masks in zip(rows["part"], rows["masks"], strict=True):
                yield pd.DataFrame(of_part(part, pd.DataFrame([x.asDict() if hasattr(x, "asDict") else x for x in masks])), columns=[c.split()[0] for c in ROWS.split(", ")])

    return run


def audit(counts: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``mask_counts``."""
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 2^filters at most
    return by_part.mapInPandas(_orders(filters), ROWS)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(mask_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLE = {
    "op11_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
firsts AS (SELECT text AS t, min(doc_id) AS least FROM t GROUP BY text),
marks AS (SELECT doc_id AS id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
         'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
         'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS f
      FROM w JOIN firsts ON text = t LEFT JOIN marks ON doc_id = id),
k AS (SELECT part, f.A::INT + 2 * f.B::INT + 4 * f.C::INT + 8 * f.D::INT + 16 * f.E::INT AS mask, count(*) AS n,
        count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM l AS a, l AS b, l AS c, l AS d, l AS e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step])::INT - bits[step] AS before FROM o, range(1, 6) AS r(step)),
x AS (SELECT part, filter_order, step, bit,
        sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
        sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
      FROM k, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x""",
}
