"""Suffix-array dedup: bucket-pointer refinement over sampled suffixes finds repeated byte strings across all texts.

Initial buckets name the 25-byte gram at every offset. A refinement gives a suffix the pair (its bucket, the bucket of
the suffix ``depth`` bytes later), so the depth doubles: 50, 100, 200, 400; every step reuses the buckets of the one
before. Bucket names are 64-bit mixes, equal for equal strings in every batch.

Not every suffix is exchanged. Each 400-byte string picks one sampled suffix, the smallest 50-byte bucket inside it, so
copies of a string pick the same place. Strings with one sample are neighbours; up to 64 of them form a block with two
names: its core (the bytes common to all) and its extent (all bytes they cover). Spark round one sorts blocks by core and
extent, and each batch's cores by core: a core of its own settles the block as unique, an extent seen twice settles it as
repeated. Only blocks that share a
core but not an extent, and one block of every extent beside them, send the buckets of their single 400-byte strings in
round two. So long copies cost a few names, and only the ends of repeats are looked at byte by byte.

Defined results: a null or empty text has no bytes and one empty rest; bytes that are no UTF-8 count as they are, and
are replacement characters in texts that are given back; a long text is unpacked in one task, with some eighty bytes of
working memory for each of its bytes; shorter texts than ``length`` lose nothing;
repeated rows and ids are separate documents; null ids stay null; an empty table gives an empty result; other columns
are not read. Strings never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import ASKED, Texts, answered, carried, exchange, group_size, id_column, messages, n_buckets, own, pack, rows_of, split, with_replies
from .common import written
from .textkit import BYTE_NAMES, U, Spans, mix2, pad, ranges, squeeze, trimmed, unsqueeze

LENGTH = 400
BLOCK = 64
#: What a block is told in round one.
UNIQUE, REPEATED, ASK, REPEATED_ASK = 0, 1, 2, 3


def refine(bucket: np.ndarray, depth: int) -> np.ndarray:
    """Buckets at twice the depth: each suffix's bucket with that of the suffix ``depth`` later."""
    return mix2(bucket[:-depth], bucket[depth:], depth) if len(bucket) > depth else np.empty(0, U)


def window_argmin(key: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest key in every window of this width (the first of equal ones)."""
    n = len(key) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    packed = (key & U(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=U)
    full = -(-len(packed) // width) * width
    p = np.full(full, U(0xFFFFFFFFFFFFFFFF), U)
    p[:len(packed)] = packed
    grid = p.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & U(0xFFFFFFFF)).astype(np.int64)


class Blocks:
    """Strings of ``length`` bytes of a batch, as blocks that share a sampled suffix."""

    def __init__(self, batch: Texts, length: int):
        self.padded, self.bounds = pad(batch.data, batch.offsets)
        quarter = length // 16  # 25 for 400
        self.length = length
        b = Spans(BYTE_NAMES[self.padded]).fixed(quarter)
        b = refine(b, quarter)
        sample, depth = b, 2 * quarter
        while depth < length // 2:
            b = refine(b, depth)
            depth *= 2
        self.half, self.whole = b, refine(b, depth)
        sizes = np.maximum(np.diff(self.bounds) - 1 - length + 1, 0)
        self.at = ranges(self.bounds[:-1], sizes)  # where a string starts
        if len(self.at):
            width = length - 2 * quarter + 1
            pick = window_argmin(sample, width)[self.at]
            group = (pick - self.at) // BLOCK
            new = np.ones(len(self.at), bool)
            new[1:] = (pick[1:] != pick[:-1]) | (group[1:] != group[:-1]) | (self.at[1:] != self.at[:-1] + 1)
            self.head = np.flatnonzero(new)
            self.size = np.diff(np.append(self.head, len(self.at)))
            first, last, pick, group = self.at[self.head], self.at[self.head] + self.size - 1, pick[self.head], group[self.head]
            core = pick - BLOCK * group  # the last possible start; the core ends with the first possible string
            end = core - BLOCK + 1 + length
            half = length // 2
            self.core = mix2(self.half[core], self.half[end - half], 11) ^ mix2(sample[pick], group.astype(U), 12)
            shape = (pick - first).astype(U) << U(32) | (pick - last).astype(U)
            self.extent = mix2(mix2(self.whole[first], self.whole[last], 13), shape, 14)
        else:
            self.head = self.size = np.empty(0, np.int64)
            self.core = self.extent = np.empty(0, U)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (core, extent): the cores, the extents, whether each occurs again here, and the kind of each block."""
        order = np.lexsort((self.extent, self.core))
        c, e = self.core[order], self.extent[order]
        new = np.ones(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (e[1:] != e[:-1])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        count = np.bincount(kind, minlength=int(new.sum())) if len(order) else np.empty(0, np.int64)
        return c[new], e[new], count > 1, kind

    def singles(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these blocks' strings: place, bucket at full depth, and core."""
        places = self.at[ranges(self.head[blocks], self.size[blocks])]
        return places, self.whole[places], np.repeat(self.core[blocks], self.size[blocks])


def _questions(p: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a batch asks in round one: its distinct pairs of core and extent, by their common name, then its distinct
    cores, each with an extent.

    Names, extents (of cores), flags (bit 0: a pair occurs again here, or a core has more extents here; bit 1: a core),
    and for each distinct pair its core's number, and for each block its pair's number.
    """
    c, e, again, kind = p.distinct()
    cores, first, core_of, count = np.unique(c, return_index=True, return_inverse=True, return_counts=True)
    flags = np.concatenate([again.astype(np.uint8), 2 + (count > 1).astype(np.uint8)])
    return np.concatenate([mix2(c, e, 16), cores]), np.concatenate([np.zeros(len(c), U), e[first]]), flags, core_of, kind


def _state(answers: np.ndarray, core_of: np.ndarray) -> np.ndarray:
    """What each distinct pair is told, from its own answer (0: unique, 1: repeated, 2: the first of repeated ones) and its
    core's (1: it has several extents)."""
    own, mixed = answers[:len(core_of)], answers[len(core_of):].astype(bool)[core_of]
    return np.where(own == 0, np.where(mixed, ASK, UNIQUE), np.where((own == 2) & mixed, REPEATED_ASK, REPEATED)).astype(np.uint8)


def _judge_blocks(rows: pd.DataFrame) -> list[bytes]:
    """Pairs are dealt by core and extent, so a core that many documents hold sends one name for each batch here."""
    names, extents, flags, sizes = [], [], [], rows["n"].tolist()
    for body, n in zip(rows["body"], sizes, strict=True):
        p = unsqueeze(body, np.uint8)
        names.append(p[:8 * n].view(np.uint64))
        extents.append(p[8 * n:16 * n].view(np.uint64))
        flags.append(p[16 * n:])
    name, extent, flag = np.concatenate(names), np.concatenate(extents), np.concatenate(flags)
    out = np.zeros(len(name), np.uint8)
    pairs = np.flatnonzero(flag < 2)
    pairs = pairs[np.argsort(name[pairs], kind="stable")]
    if len(pairs):
        s = name[pairs]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        kind = np.cumsum(new) - 1
        repeated = np.bincount(kind, weights=1 + flag[pairs])[kind] >= 2
        out[pairs] = repeated * (1 + new)
    cores = np.flatnonzero(flag >= 2)
    cores = cores[np.lexsort((extent[cores], name[cores]))]
    if len(cores):
        s, e = name[cores], extent[cores]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        other = ~new & np.concatenate([[False], e[1:] != e[:-1]])
        kind = np.cumsum(new) - 1
        out[cores] = np.bincount(kind, weights=other | (flag[cores] == 3))[kind] > 0
    return [squeeze(p) for p in np.split(out, np.cumsum(sizes)[:-1])]


def _judge_strings(rows: pd.DataFrame) -> list[bytes]:
    names, multi, sizes = [], [], rows["n"].tolist()
    for body, n in zip(rows["body"], sizes, strict=True):
        p = unsqueeze(body, np.uint8)
        names.append(p[:8 * n].view(np.uint64))
        multi.append(p[8 * n:])
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    s = every[order]
    kind = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]])) - 1
    seen = np.bincount(kind, weights=1 + np.concatenate(multi)[order])
    out = np.empty(len(every), np.uint8)
    out[order] = seen[kind] >= 2
    return [squeeze(p) for p in np.split(out, np.cumsum(sizes)[:-1])]


def _strings(p: Blocks, replies: bytes | None, n: int) -> tuple:
    """State of each block, and the distinct strings that the unsettled ones ask about.

    The strings come with the keys that choose their buckets: mixed from core and name, so equal for equal strings, and
    a core that many documents hold is spread over all buckets.
    """
    names, _, _, core_of, kind = _questions(p)
    state = _state(answered(replies, names, n), core_of)[kind] if len(kind) else np.empty(0, np.uint8)
    _, first = np.unique(kind, return_index=True)
    asking = np.zeros(len(kind), bool)
    asking[first] = True  # equal blocks of a batch ask once
    asking &= state >= ASK
    places, names, core = p.singles(np.flatnonzero(asking))
    distinct, at, inverse, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
    return state, places, distinct, mix2(core[at], distinct, 15), inverse, counts > 1


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left, joined) and, if asked, kept_text.

    kept_text has the bytes left as text; a character that lost a byte goes whole. A byte goes if a string of ``length`` bytes (a multiple of 16, above 128) that covers it also starts anywhere else.
    """

    def digest(row: dict, batch: Texts, p: Blocks, gone: np.ndarray) -> pa.RecordBatch:
        edge = np.diff(gone.astype(np.int8), prepend=0) == 1
        total = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[p.bounds])
        hashes = [hashlib.sha256(k).hexdigest() for k in _rests(p, gone)]
        cols = [id_column(batch.ids), pa.array(np.diff(batch.offsets), pa.int64()), pa.array(total(gone), pa.int64()), pa.array(total(edge), pa.int64()), pa.array(hashes, pa.string())]
        if texts:
            cols.append(_kept_text(p, gone))
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][:len(cols)])

    return _judged(docs, id_col, text_col, length, False, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with their own columns and the text that is left; a character that lost a byte goes whole.

    A text that loses everything stays as an empty one; a null text becomes empty.
    """
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema])

    def texts(row: dict, batch: Texts, p: Blocks, gone: np.ndarray) -> pa.RecordBatch:
        cols = carried(row) | {text_col: _kept_text(p, gone)}
        return pa.RecordBatch.from_arrays([cols[f.name] for f in schema], names=schema.names)

    return _judged(docs, id_col, text_col, length, True, texts, schema)


def _kept_text(p: Blocks, gone: np.ndarray) -> pa.Array:
    """What is left of each text in whole characters; bytes that are no UTF-8 become replacement characters."""
    character = np.cumsum((p.padded & 0xC0) != 0x80)
    broken = np.zeros(int(character[-1]) + 1 if len(character) else 1, bool)
    broken[character[gone]] = True
    rests = list(_rests(p, broken[character]))
    try:
        return pa.array(rests, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # Spark strings may hold any bytes
        return pa.array([r.decode("utf-8", "replace") for r in rests], pa.string())


def _rests(p: Blocks, gone: np.ndarray) -> Iterator[bytes]:
    """What is left of each text."""
    inside = np.ones(len(gone), bool)
    inside[p.bounds[1:] - 1] = False
    take = ~gone & inside
    out = p.padded[take].tobytes()
    at = np.concatenate([[0], np.cumsum(take)])[p.bounds].tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield out[a:b]


def _judged(docs: DataFrame, id_col: str, text_col: str, length: int, carry: bool, result, schema) -> DataFrame:
    """``result`` of every batch and its removed bytes."""
    if length % 16 or length <= 2 * BLOCK:
        raise ValueError("length: a multiple of 16 above 128")
    batches = pack(docs, id_col, text_col, name="suffix-batches", carry=carry)
    n = n_buckets(batches, 0.08)
    group = group_size(n, 0.08)

    def ask_blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gather(row: dict) -> Iterator:
            names, extents, flags, _, _ = _questions(Blocks(Texts(row), length))
            return split(names, n, names, extents, flags)

        return messages(parts, group, gather, lambda a, b, x: squeeze(a.tobytes() + b.tobytes() + x.tobytes()))

    def ask_strings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gather(row: dict) -> Iterator:
            _, _, names, key, _, multi = _strings(Blocks(Texts(row), length), own(row), n)
            return split(key, n, names, multi)

        return messages(parts, group, gather, lambda a, x: squeeze(a.tobytes() + x.astype(np.uint8).tobytes()))

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            batch = Texts(row)
            p = Blocks(batch, length)
            state, places, names, key, inverse, _ = _strings(p, own(row), n)
            hit = places[answered(own(row, "later"), key, n).astype(bool)[inverse]] if len(places) else places
            cover = np.zeros(len(p.padded) + 1, np.int32)
            sure = np.flatnonzero((state == REPEATED) | (state == REPEATED_ASK))
            np.add.at(cover, p.at[p.head[sure]], 1)
            np.add.at(cover, p.at[p.head[sure]] + p.size[sure] - 1 + length, -1)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + length, -1)
            gone = np.cumsum(cover)[:-1] > 0
            yield result(row, batch, p, gone)

    first = written(exchange(batches.mapInArrow(trimmed(ask_blocks), ASKED), _judge_blocks), "suffix-blocks")
    later = exchange(with_replies(batches, group, first).mapInArrow(trimmed(ask_strings), ASKED), _judge_strings).withColumnRenamed("replies", "later")
    joined = with_replies(batches, group, first, later)
    return joined.mapInArrow(trimmed(finish), schema)


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=True)


QUERIES = {"op10_suffix_array_dedup": op10_suffix_array_dedup}
ORACLE = {
    "op10_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, unnest(range(1, len(h) // 2 - 398)) AS k, unnest(list_transform(range(1, len(h) // 2 - 398), lambda k: md5(substr(h, 2 * k - 1, 800)))) AS name FROM d WHERE len(h) >= 800),
hit AS (SELECT doc_id, k FROM strings QUALIFY count(*) OVER (PARTITION BY name) > 1),
runs AS (SELECT doc_id, k, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) > 400 AS apart FROM hit),
numbered AS (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM runs),
spans AS (SELECT doc_id, min(k) AS first, max(k) + 399 AS last FROM numbered GROUP BY doc_id, run),
bytes AS (SELECT doc_id, unnest(range(1, len(h) // 2 + 1)) AS k, unnest(list_transform(range(1, len(h) // 2 + 1), lambda k: substr(h, 2 * k - 1, 2))) AS b FROM d),
marked AS (SELECT *, count(*) FILTER (b < '80' OR b >= 'C0') OVER (PARTITION BY doc_id ORDER BY k) AS c FROM bytes),
judged AS (SELECT m.*, coalesce(m.k <= s.last, false) AS gone FROM marked AS m ASOF LEFT JOIN spans AS s ON m.doc_id = s.doc_id AND m.k >= s.first),
whole AS (SELECT *, bool_or(gone) OVER (PARTITION BY doc_id, c) AS broken FROM judged),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(b, '' ORDER BY k) FILTER (NOT gone) AS h, string_agg(b, '' ORDER BY k) FILTER (NOT broken) AS t FROM whole GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce((SELECT count(*) FROM spans AS s WHERE s.doc_id = d.doc_id), 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256, decode(unhex(coalesce(kept.t, ''))) AS kept_text FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
}
