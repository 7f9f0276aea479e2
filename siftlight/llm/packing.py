"""Best-fit packing of token sequences by bulk-synchronous sweeps.

Documents are tokenised and cut into pieces once, into a written table; from there on only slim rows move. As many
sequences are opened as the tokens need at least, each a gap of ``capacity``. Then rounds repeat:

1. documents and gaps are range-sorted by size into one line, gaps after documents of their size. A gap that holds the
   longest document left k times takes part k times;
2. sweep: along the line every document waits until a gap takes it, and a gap takes the longest that waits, so it is the
   document's successor and conflicts are settled by rank. Read as brackets, a document opens and a gap closes; a pair
   meets at one depth. Range partitions settle their own pairs, what is left of them meets in a shuffle by depth, for
   which the driver adds up two counts of each partition;
3. gaps shrink by what they took, and gaps too small for the shortest document left drop out.

When a round places nothing, the least number of sequences for what is left is opened. The driver sees counts and the
lengths' bounds, never documents.

Defined results: a null text is an empty one, which packs its end token; repeated rows and ids are packed each; null
ids stay null; texts longer than the capacity are cut into full pieces and a rest; an empty table gives no pieces;
other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, parallelism, scratch_path, written
from .textkit import pad, ranges, same_words, text_buffers, trimmed, word_names, words

CAPACITY = 4096
END_ID = 1
#: Words of one generation of a worker's cache; a full generation becomes the old one, from which used words return.
CACHE_WORDS = 500_000
#: This special token never occurs inside a word handed to it; it separates words.
SEPARATOR, SEPARATOR_ID = "<|endoftext|>", 49407
#: Rows of a round that one task sweeps: at least, and at most beyond the session's partitions.
SWEEP_ROWS, MOST_SWEEP_ROWS = 20_000, 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"
# The normalizers and the pattern of a tokenizer that lower-cases and cuts words into runs of letters,
# single digits and runs of other signs.
SIMPLE_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SIMPLE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: With these signs a word's runs are plain to see: Latin-1 letters, digits, and ASCII signs but the apostrophe.
_SIGNS = r"!-&(-/:-@\[-`{-~"
_SIMPLE_WORD, _RUNS = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ0-9{_SIGNS}]+"), re.compile(f"[a-zß-öø-ÿ]+|[0-9]|[{_SIGNS}]+")


class WordTokenizer:
    """Ids of whole texts, word by word: the tokenizer drops white space and never joins across it.

    If the tokenizer cuts words into runs by the pattern above, simple words are put together from the ids of their
    runs, which many words share.
    """

    _of: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.ids, self.old, self.runs = Tokenizer.from_file(path), {}, {}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cutters = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        suffix = spec["model"].get("end_of_word_suffix")
        self.simple = bool(suffix) and normal == SIMPLE_NORMALIZERS and [c["type"] for c in cutters] == ["Split", "ByteLevel"] and cutters[0]["pattern"] == {"Regex": SIMPLE_PATTERN}
        if self.simple:
            self.by_run = Tokenizer(self.tokenizer.model)
            self.by_run.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = spec["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for p, i in vocab.items() if p.endswith(suffix)]] = True

    @classmethod
    def at(cls, path: str) -> WordTokenizer:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def learn_runs(self, runs: list[str]) -> None:
        """A run's last token, and no other, ends a word."""
        groups = [runs[lo:lo + 1000] for lo in range(0, len(runs), 1000)]
        for g, e in zip(groups, self.by_run.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.uint32)
            raw, at = got.tobytes(), 0
            for r, end in zip(g, ((np.flatnonzero(self.last[got]) + 1) * 4).tolist(), strict=True):
                self.runs[r] = raw[at:end]
                at = end

    def learn(self, new: list[bytes]) -> None:
        plain, odd = [], []
        for w in new:
            text = w.decode()
            if "<|" in text:
                self.ids[w] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
            elif self.simple and _SIMPLE_WORD.fullmatch(text):
                plain.append((w, _RUNS.findall(text.lower())))
            else:
                odd.append((w, text))
        if len(self.runs) > CACHE_WORDS:
            self.runs = {}
        self.learn_runs(list({r for _, runs in plain for r in runs}.difference(self.runs)))
        get = self.runs.__getitem__
        for w, runs in plain:
            self.ids[w] = get(runs[0]) if len(runs) == 1 else b"".join(map(get, runs))
        groups = [odd[lo:lo + 200] for lo in range(0, len(odd), 200)]
        for lo in range(0, len(groups), 50):
            some = groups[lo:lo + 50]
            texts = [SEPARATOR.join([t for _, t in g]) for g in some]
            for g, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                got = np.array(e.ids, np.uint32)
                raw, ends, at = got.tobytes(), [*(np.flatnonzero(got == SEPARATOR_ID) * 4).tolist(), 4 * len(got)], 0
                for (w, _), end in zip(g, ends, strict=True):
                    self.ids[w] = raw[at:end]
                    at = end + 4

    def known(self, distinct: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        if len(self.ids) > CACHE_WORDS:
            self.old, self.ids = self.ids, {}
        new = []
        for w in distinct:
            if w not in self.ids:
                old = self.old.get(w)
                if old is None:
                    new.append(w)
                else:
                    self.ids[w] = old
        self.learn(new)
        return list(map(self.ids.__getitem__, distinct))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, end to end, and the texts' bounds in them. Each distinct word is looked up once."""
        padded, bounds = pad(data, offsets)
        starts, ends = words(padded)
        _, first, kind = np.unique(word_names(padded, starts, ends), return_index=True, return_inverse=True)
        if not same_words(padded, starts, ends, first[kind]).all():  # two words with one name
            of: dict[bytes, int] = {}
            kind = np.array([of.setdefault(padded[a:b].tobytes(), len(of)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
            first = np.unique(kind, return_index=True)[1]
        raw = padded.tobytes()
        ids = self.known([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin, size = np.cumsum(sizes) - sizes, sizes[kind]
        tokens = np.frombuffer(b"".join(ids), np.uint32)[ranges(begin[kind], size)]
        return tokens, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, bounds)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Every document as pieces of at most ``capacity`` tokens: see ``PIECES``; ``ids`` adds their bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, tok = TaskContext.get().partitionId() << 40, WordTokenizer.at(tokenizer)
        tail = np.uint32(end_id).tobytes()
        for b in parts:
            data, offs = text_buffers(b.column(1))
            doc_ids, n = b.column(0).to_pylist(), b.num_rows
            lo = 0
            while lo < n:
                hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + (1 << 20), "right")) - 1), n)
                rows = []
                tokens, at_doc = tok.encode(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                raw, cuts = tokens.tobytes(), (4 * at_doc).tolist()
                for doc, first, end in zip(doc_ids[lo:hi], cuts, cuts[1:], strict=False):
                    buf = raw[first:end] + tail
                    for k, at in enumerate(range(0, len(buf), 4 * capacity)):
                        own = buf[at:at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), uid) + ((own,) if ids else ()))
                        uid += 1
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
                names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names[:6 + ids])
                lo = hi

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    with bounded_batches(docs.sparkSession):
        return written(rows.mapInArrow(trimmed(run), PIECES + ", ids binary" * ids), "pieces")


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """A plan on one machine, which the tests hold the sweeps against: rows (length, first rank, number, first sequence, offset), sorted; and the number of sequences.

    Item ``first rank + i`` of the length goes to sequence ``first sequence + i``.
    """
    left = {int(n): int(c) for n, c in zip(lengths, counts, strict=True)}
    given = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, number)
    rows, total = [], 0

    def place(length: int, gap: int, most: int) -> int:
        """Fill up to ``most`` gaps of this size; how many were filled."""
        nonlocal rows
        done, ranges = 0, gaps[gap]
        while ranges and done < most:
            first, n = ranges.pop()
            take = min(n, most - done)
            if take < n:
                ranges.append((first + take, n - take))
            rows.append((length, given[length], take, first, capacity - gap))
            given[length] += take
            done += take
            if gap > length:
                gaps.setdefault(gap - length, []).append((first, take))
        if not ranges:
            del gaps[gap]
        return done

    while left:
        moved = True
        while moved:
            moved, sizes = False, sorted(gaps)
            longest = max(left, default=0)
            floor = longest // 2  # shorter classes wait, so that they do not take what longer ones need
            for length in sorted((n for n in left if n > floor), reverse=True):
                k = bisect.bisect_left(sizes, length)
                if k < len(sizes) and sizes[k] in gaps:
                    left[length] -= place(length, sizes[k], left[length])
                    moved = True
                    if not left[length]:
                        del left[length]
        if left:
            longest = max(left)
            if any(g >= longest for g in gaps):
                continue
            n = -(-left[longest] // (capacity // longest))
            gaps.setdefault(capacity, []).append((total, n))
            total += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5), total


LINE = "part int, place long, gives boolean, uid long, length long, seq long, nth int, gap long"


def _pairs(gives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the documents and gaps of a line that meet at one depth."""
    depth = np.cumsum(np.where(gives, -1, 1))
    level = depth + gives  # a document's depth after it, a gap's before it
    order = np.argsort(level, kind="stable")
    meet = np.flatnonzero((level[order[1:]] == level[order[:-1]]) & gives[order[1:]] & ~gives[order[:-1]])
    return order[meet], order[meet + 1]


def _sweep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the line: gaps with what they took (place null), and what is left, with its place among its kind."""
    held = [b for b in parts if b.num_rows]
    if not held:
        return
    gives, uid, length, seq, nth, gap = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("gives", "uid", "length", "seq", "nth", "gap"))
    took, giver = _pairs(gives)
    uid[giver], length[giver] = uid[took], length[took]
    left, settled = np.ones(len(gives), bool), np.zeros(len(gives), bool)
    left[took] = left[giver] = False
    settled[giver] = True
    place = np.zeros(len(gives), np.int64)
    for kind in (gives & left, ~gives & left):
        place[kind] = np.arange(int(kind.sum()))
    at = np.flatnonzero(left | settled)
    for lo in range(0, len(at), 20_000):
        k = at[lo:lo + 20_000]
        none = gives[k] & left[k]
        cols = [
            pa.array(np.full(len(k), TaskContext.get().partitionId(), np.int32)), pa.array(place[k], mask=settled[k]), pa.array(gives[k]), pa.array(uid[k], mask=none), pa.array(length[k], mask=none),
            pa.array(seq[k]), pa.array(nth[k].astype(np.int32)), pa.array(gap[k]),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in LINE.split(", ")])


def _round(items: DataFrame, gaps: DataFrame, rows: int, longest: int, shortest: int) -> DataFrame:
    """(gives, uid, length, seq, nth, gap): gaps with what they took (uid null: nothing), and documents left (gives false)."""
    spark = items.sparkSession
    none = [F.lit(0).cast("long").alias(c) for c in ("seq", "gap")]
    waiting = items.select(F.col("length").alias("size"), F.lit(False).alias("gives"), "uid", "length", none[0], F.lit(0).alias("nth"), none[1])
    takers = gaps.filter(F.col("gap") >= shortest).withColumn("nth", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("gap") / longest)).cast("int"))))
    takers = takers.select(F.least("gap", F.lit(longest)).alias("size"), F.lit(True).alias("gives"), F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("length"), "seq", "nth", "gap")
    most = parallelism(spark)
    n = max(min(most, -(-rows // SWEEP_ROWS)), -(-rows // MOST_SWEEP_ROWS), 1)
    order = ["size", "gives", "gap", "seq", "nth", "uid"]
    line = waiting.union(takers).repartitionByRange(n, *order).sortWithinPartitions(*order)
    swept = written(line.select("gives", "uid", "length", "seq", "nth", "gap").mapInArrow(_sweep, LINE), "packing-line")
    counts = swept.filter("place is not null").groupBy("part").agg(F.count_if("gives").alias("gaps"), F.count_if(~F.col("gives")).alias("docs")).orderBy("part").collect()  # a row for each task
    depth, bases = 0, []
    for c in counts:
        bases.append((c.part, depth, depth - c.gaps))
        depth += c.docs - c.gaps
    base = F.broadcast(spark.createDataFrame(bases, "part int, before long, after long"))
    left = swept.filter("place is not null").join(base, "part").withColumn("depth", F.expr("if(gives, before - place, after + place + 1)"))
    at_depth = Window.partitionBy("depth").orderBy("part", F.desc("gives"))
    there = left.select(
        "*", *[F.lag(c).over(at_depth).alias("own_" + c) for c in ("uid", "length", "gives")], F.lead("gives").over(at_depth).alias("taken"))
    there = there.filter("gives or not coalesce(taken, false)").select(
        "gives", *[F.expr(f"if(gives, if(not own_gives, own_{c}, null), {c})").alias(c) for c in ("uid", "length")], "seq", "nth", "gap")
    return swept.filter("place is null").select(*there.columns).union(there)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    spark, root = cut.sparkSession, scratch_path(cut.sparkSession, "packing-rounds")
    stats = [F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.max("length").alias("longest"), F.min("length").alias("shortest")]
    items, opened, rounds = cut.select("uid", "length"), 0, 0
    gaps, n_gaps, rest = spark.createDataFrame([], "seq long, gap long"), 0, items.agg(*stats).first()
    while rest.n:
        if not n_gaps:
            n_gaps = -(-rest.tokens // capacity)
            gaps = spark.range(opened, opened + n_gaps).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
            opened += n_gaps
        path = f"{root}/round={rounds}"
        _round(items, gaps, rest.n + n_gaps, rest.longest, rest.shortest).write.option("compression", "zstd").parquet(path)
        done, rounds = spark.read.parquet(path), rounds + 1
        items = done.filter("not gives").select("uid", "length")
        before, rest = rest.n, items.agg(*stats).first()
        gaps = done.filter("gives").groupBy("seq").agg((F.first("gap") - F.coalesce(F.sum("length"), F.lit(0))).alias("gap"))
        n_gaps = gaps.filter(F.col("gap") >= rest.shortest).count() if rest.n and rest.n < before else 0
    if not rounds:
        return cut.drop("uid").select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = spark.read.parquet(root).filter("gives and uid is not null")
    inside = Window.partitionBy("round", "seq").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("uid", F.col("seq").alias("sequence_id"), (capacity - F.col("gap") + F.coalesce(F.sum("length").over(inside), F.lit(0))).alias("offset"))
    return cut.join(placed, "uid").drop("uid")


def word_bpe() -> str:
    """The default tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe()))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
