"""Quality rules: every rule is evaluated once into a bitmask ledger; policies and ablations read only the ledger.

Built-in DataFrame functions only. Words are runs of bytes other than ASCII white space.

Defined results: a null or empty text has no words, so every measure is 0 and the length rule fails; null ids and
other columns pass through untouched; repeated rows are judged row by row; an empty table gives an empty ledger;
input columns may have any names, because the input row travels as one struct.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measures) holds. Integer arithmetic keeps engines in agreement."""

    name: str
    fails: str


#: The position of a rule is its bit. Rules are only ever appended, so stored ledgers stay readable.
RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "100 * n_symbols > 20 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("shouting", "100 * n_upper > 50 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """A versioned reading of the ledger: a document is rejected if any rule named here failed."""

    version: str
    rejects: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(n) for n in self.rejects)


BASE = Policy("base-1", ("too_short", "repeated_trigrams"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the input row as a struct) and the measures of its whole text."""
    d = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Words by a literal split: the other white space becomes a space first, empty strings go.
    words = F.array_remove(F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " "), "")
    d = d.select("row", "text", F.split("text", "\n").alias("lines"), words.alias("words"))
    d = d.select(
        "row", "text", "words",
        F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.size("words").alias("n"),
    )
    # A 3-word window is named by a 64-bit hash of its words, comparable within its own document only.
    d = d.select(
        "*",
        F.when(F.col("n") >= 3, F.transform(
            F.slice("words", 1, F.col("n") - 2),
            lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
        )).otherwise(F.array().cast("array<bigint>")).alias("tri"),
    )
    d = d.select("*", (F.size(F.array_distinct("tri")) < F.size("tri")).alias("repeats"))
    # Only texts with a repeat sort their windows; equal neighbours are the repeated windows, in text order again.
    pairs = F.array_sort(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select("*", F.when(F.col("repeats"), pairs).alias("pairs"))
    d = d.select("*", F.when(F.col("repeats"), F.sort_array(F.transform(
        F.filter("pairs", lambda p, k: (
            ((k > 0) & (F.get("pairs", k - 1)["h"] == p["h"]))
            | F.coalesce(F.get("pairs", k + 1)["h"] == p["h"], F.lit(False))
        )),
        lambda p: p["i"],
    ))).alias("hits"))
    covered = F.when(F.col("repeats"), F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )).otherwise(F.lit(0).cast("bigint"))
    # The optimizer moves filters below projections, which would repeat the expressions above for every use of a
    # measure; it cannot move them below a generator.
    return d.select("row", F.inline(F.array(F.struct(
        F.col("n").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
    ))))


def ledger(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row``, the measures and ``fail_bits``: bit k is set if rule k failed."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, r in enumerate(rules)]
    return measure(docs, text_col).withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def fails(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row is rejected by the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("bigint")) != 0


def ablations(entries: DataFrame, policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that only it rejects, rows kept without it.

    The ledger is first counted by mask (at most 2^rules rows, combined on the map side); the rest is bit arithmetic.
    """
    mask = policy.mask(rules)
    by_mask = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    named = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("bigint").alias("bit")) for k, r in enumerate(rules) if r.name in policy.rejects]
    each = by_mask.select("n", "bits", F.inline(F.array(*named)))
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(mask).cast("bigint") - F.col("bit")) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )


def keep_rows(docs: DataFrame, policy: Policy = STANDARD, text_col: str = "text") -> DataFrame:
    """The documents the policy keeps, with their own columns."""
    return ledger(docs, text_col).filter(~fails(policy)).select("row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    entries = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return entries.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails(BASE).alias("base_failed"), (~fails(STANDARD)).alias("kept"), "fail_bits",
    )


def op1_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of the standard policy rejects, alone and together, over all documents."""
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_MEASURED_SQL = r"""
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT *, len(words) AS n, CASE WHEN len(words) >= 3 THEN
        list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
        ELSE [] END AS tri FROM w),
x AS (SELECT doc_id, unnest(tri) AS tri, unnest(range(0, len(tri))) AS i FROM g),
r AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 3) AS q(k) GROUP BY doc_id),
m AS (SELECT g.doc_id, g.n::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS wc,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(regexp_extract_all(text, '\p{Lu}'))::BIGINT AS n_upper,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(lines)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM g LEFT JOIN (SELECT doc_id AS id, n FROM c) AS c ON g.doc_id = c.id),
b AS (SELECT *, coalesce(wc, 0)::BIGINT AS word_chars FROM m),
l AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
        + 4 * (100 * n_symbols > 20 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
        + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT
        + 32 * (100 * n_upper > 50 * word_chars)::BIGINT)::BIGINT AS fail_bits FROM b)
"""

QUERIES = {"op1_quality_rules": op1_quality_rules, "op1_ablations": op1_ablations}
ORACLE = {
    "op1_quality_rules": f"""WITH {_MEASURED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM l""",
    "op1_ablations": f"""WITH {_MEASURED_SQL},
rules AS (SELECT * FROM (VALUES ('too_short', 1), ('repeated_trigrams', 2), ('symbol_heavy', 4), ('repeated_lines', 8), ('word_length', 16), ('shouting', 32)) AS v(rule, bit))
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_only_this,
  count(*) FILTER (fail_bits & (63 - bit) = 0) AS n_kept_without FROM l, rules GROUP BY rule""",
}
