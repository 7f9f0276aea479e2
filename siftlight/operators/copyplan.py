"""Copy planning, include lists, the shaping of process output, and retention of cached files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def copy_plan(source: DataFrame, names: DataFrame, destination: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """Chosen files and what happens to each: ``create``, ``update`` (the source is newer) or ``skip``.

    ``by`` is what files, chosen names and the destination have in common: the name where one catalog is copied into one
    folder, catalog and name where many are. A file that the destination lists twice counts once, with its newest time.
    """
    by = list(by)
    chosen = source.join(names.select(*by).distinct(), by, "left_semi")
    there = destination.groupBy(*by).agg(F.max("modified").alias("there"))
    action = F.when(F.col("there").isNull(), "create").when(F.col("modified") > F.col("there"), "update").otherwise("skip")
    return chosen.join(there, by, "left").withColumn("action", action).drop("there")


def copy_summary(plan: DataFrame, *by: str) -> DataFrame:
    """Files and bytes per kind of action, of each group of ``by`` or of all."""
    moved = F.col("action") != "skip"
    return plan.groupBy(*by).agg(
        F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count_if(moved).alias("n_transferred"),
        F.coalesce(F.sum(F.when(moved, F.col("size"))), F.lit(0)).alias("transferred_bytes"),
        F.count_if(F.col("action") == "create").alias("n_created"), F.count_if(F.col("action") == "update").alias("n_updated"))


def status_text(n_transferred, transferred_bytes):
    """Two lines on what a copy transfers, or one that there is nothing to do."""
    files = F.when(n_transferred == 1, "1 file changed").otherwise(F.concat(n_transferred.cast("string"), F.lit(" files changed")))
    size = F.when(transferred_bytes == 1, "byte for transfer").otherwise(F.concat(transferred_bytes.cast("string"), F.lit(" bytes for transfer")))
    return F.when(n_transferred > 0, F.concat(files, F.lit("\n"), size)).otherwise("No data to synchronize")


def write_include_list(names: DataFrame, path: str) -> None:
    """One name per line, ended by a newline. The list is one file by contract: the copy tool takes a single path."""
    names.select("name").orderBy("name").coalesce(1).write.mode("overwrite").text(path)


def _from_end(lines: DataFrame, key: str) -> DataFrame:
    """Lines with the number of their output's lines, counted apart: no output is gathered in one task."""
    total = lines.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_total"))
    return lines.join(total, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def tail(lines: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The last n lines (line_no from 1, without gaps) of each output; all of a shorter one."""
    return _from_end(lines, key).filter(F.col("line_no") > F.col("_total") - n).drop("_total")


def drop_last(lines: DataFrame, key: str, n: int = 11) -> DataFrame:
    return _from_end(lines, key).filter(F.col("line_no") <= F.greatest(F.col("_total") - n, F.lit(0))).drop("_total")


def without_directories(lines: DataFrame) -> DataFrame:
    """Lines that end in a slash name directories; empty lines stay."""
    return lines.filter(~F.col("record").endswith("/"))


def output_rows(values: DataFrame, column: str, as_set: bool = False) -> DataFrame:
    rows = values.select(F.col(column).alias("record"))
    return rows.distinct() if as_set else rows


def prune_candidates(files: DataFrame, now, days: int) -> DataFrame:
    """Files modified before now minus the days; files without a time stay."""
    return files.filter(F.col("modified") < now - F.make_dt_interval(F.lit(days)))


def retained(files: DataFrame, now, days: int) -> DataFrame:
    return files.filter(F.col("modified").isNull() | (F.col("modified") >= now - F.make_dt_interval(F.lit(days))))


#: The labels of the copy tool's closing statistics, and what its summary says where they are missing.
STATISTICS = {
    "n_files": "Number of files", "n_created": "Number of created files", "n_deleted": "Number of deleted files",
    "n_transferred": "Number of (?:regular )?files transferred", "total_bytes": "Total file size", "transferred_bytes": "Total transferred file size",
}
NO_STATISTICS = "0 files : 0.00 MB in 0.00 seconds"
SUMMARY = "output string, n_lines long, n_files long, n_directories long, n_created long, n_deleted long, n_transferred long, total_bytes long, transferred_bytes long, parsed boolean, data_to_synchronize boolean, stats string"
_NUMBER = r"([0-9][0-9,.]*)"


def _number(record: Column, pattern: str) -> Column:
    """The digits behind a label, whatever separates their groups; null where the label is not."""
    return F.nullif(F.regexp_replace(F.regexp_extract(record, pattern, 1), "[,.]", ""), F.lit("")).try_cast("long")


def parsed_summary(lines: DataFrame, key: str) -> DataFrame:
    """The closing statistics of each output (see ``SUMMARY``), from its last 20 lines (line_no, record).

    Files and directories are told apart where the tool does ("reg:", "dir:"). Without the numbers of files transferred
    and of bytes in all, nothing is parsed: numbers are 0, the text is the default, and there may be data to synchronize.
    """
    c = F.col("record")
    found = {name: _number(c, rf"^{label}: {_NUMBER}") for name, label in STATISTICS.items()}
    found |= {"n_regular": _number(c, rf"^Number of files: .*reg: {_NUMBER}"), "n_directories": _number(c, rf"^Number of files: .*dir: {_NUMBER}")}
    found |= {"sent": _number(c, rf"^sent {_NUMBER} bytes"), "received": _number(c, rf"^sent .*received {_NUMBER} bytes"), "rate": _number(c, rf"^sent .* {_NUMBER} bytes/sec")}
    last = tail(lines.select(key, "line_no", "record"), key)
    n_lines = lines.groupBy(key).agg(F.max("line_no").alias("n_lines"))
    got = last.groupBy(key).agg(*[F.max(v).alias(name) for name, v in found.items()])
    whole = F.col("n_transferred").isNotNull() & F.col("total_bytes").isNotNull()
    value = lambda name: F.when(whole, F.coalesce(F.col(name), F.lit(0))).otherwise(F.lit(0)).cast("long")
    seconds = F.coalesce(F.floor(F.try_divide((F.col("sent") + F.col("received")) * 10_000, F.col("rate"))), F.lit(0)).cast("long")
    stats = F.concat(value("n_transferred").cast("string"), F.lit(" files : "), _two_decimals(F.floor(value("transferred_bytes") / 10_000).cast("long")), F.lit(" MB in "), _two_decimals(seconds), F.lit(" seconds"))
    out = got.join(n_lines, key).select(
        F.col(key).cast("string").alias("output"), "n_lines", F.when(whole, F.coalesce("n_regular", "n_files", F.lit(0))).otherwise(0).cast("long").alias("n_files"), value("n_directories").alias("n_directories"),
        value("n_created").alias("n_created"), value("n_deleted").alias("n_deleted"), value("n_transferred").alias("n_transferred"), value("total_bytes").alias("total_bytes"), value("transferred_bytes").alias("transferred_bytes"),
        whole.alias("parsed"), F.when(whole, value("n_transferred") + value("n_created") + value("n_deleted") > 0).otherwise(True).alias("data_to_synchronize"), F.when(whole, stats).otherwise(NO_STATISTICS).alias("stats"))
    return out


def _two_decimals(hundredths: Column) -> Column:
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def grouped_digits(n: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(n, 0)


def summary_lines(summary: DataFrame, key: str) -> DataFrame:
    """(key, k, record): the closing statistics as the copy tool prints them, from rows of ``copy_summary``."""
    g = lambda c: grouped_digits(F.col(c))
    text = F.array(
        F.lit(""), F.concat(F.lit("Number of files: "), g("n_files"), F.lit(" (reg: "), g("n_files"), F.lit(")")), F.concat(F.lit("Number of created files: "), g("n_created")), F.lit("Number of deleted files: 0"),
        F.concat(F.lit("Number of regular files transferred: "), g("n_transferred")), F.concat(F.lit("Total file size: "), g("total_bytes"), F.lit(" bytes")),
        F.concat(F.lit("Total transferred file size: "), g("transferred_bytes"), F.lit(" bytes")), F.lit(""),
        F.concat(F.lit("sent "), g("transferred_bytes"), F.lit(" bytes  received 0 bytes  1,000.00 bytes/sec")), F.concat(F.lit("total size is "), g("total_bytes"), F.lit("  speedup is 1.00")))
    return summary.select(key, F.posexplode(text).alias("k", "record"))
