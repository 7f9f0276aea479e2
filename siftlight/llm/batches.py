"""Documents packed into batches, and the exchange of names between batches.

A batch is one row with some megabytes of whole texts, compressed. Operators that ask "which of my names occur
elsewhere?" send each batch's distinct names, split by name range into buckets, through one shuffle; a bucket task
answers for its range with one byte per name, and the answers come back to the batch by its id. A name that every
document holds costs one entry per batch, so hot names are combined before the shuffle. Successive batches share their
messages, the more of them the more buckets there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, parallelism, written, written_by
from .textkit import squeeze, text_buffers, trimmed, unsqueeze

BATCH_BYTES = 1 << 20
BATCH = "bid long, n_bytes long, n_docs long, ids binary, offsets binary, texts binary, rest binary"
#: Stands for a null id in order comparisons: after every other.
NULL_ID = np.iinfo(np.int64).max


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, name: str = "batches", carry: bool = False, coded: Callable[[bytes, np.ndarray], tuple[bytes, bytes]] | None = None, buckets: int = 0) -> DataFrame:
    """The texts as a written table of batches; inside a batch, texts stand in the order of their ids, nulls last.

    ``carry`` keeps the other columns beside them, for ``carried``; ``coded`` makes of texts and their offsets what
    stands in ``texts`` and ``rest`` instead; ``buckets`` (if any) lay the table out by bid, for joins that leave it in
    place.
    """

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal count, held, size
            ids = np.concatenate([h[0] for h in held])
            null = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            data = np.concatenate([h[3] for h in held])
            starts = np.cumsum(lengths) - lengths
            order = np.lexsort((ids, null))
            texts = b"".join(data[starts[i]:starts[i] + lengths[i]].tobytes() for i in order)
            offsets = np.concatenate([[0], np.cumsum(lengths[order])]).astype(np.int64)
            kept = np.where(null, NULL_ID, ids)[order].astype(np.int64)
            rest = b""
            if carry:
                table = pa.Table.from_struct_array(pa.chunked_array([h[4] for h in held])).take(pa.array(order)).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                rest = squeeze(sink.getvalue().to_pybytes())
            body, rest = coded(texts, offsets) if coded else (squeeze(texts), rest)
            row = {"rest": [rest], "bid": [(part << 32) | count], "n_bytes": [len(texts)], "n_docs": [len(ids)], "ids": [squeeze(kept)], "offsets": [squeeze(offsets)], "texts": [body]}
            count, held, size = count + 1, [], 0
            return pa.RecordBatch.from_pydict(row, schema)

        for b in parts:
            ids = b.column(0)
            null = np.array(ids.is_null())
            plain = np.asarray(ids.fill_null(0)).astype(np.int64)
            data, offs = text_buffers(b.column(1))
            lengths = np.diff(offs)
            at = 0
            while at < len(plain):
                upto = int(np.searchsorted(offs, offs[at] + max(1, batch_bytes - size), "left"))
                upto = min(max(upto, at + 1), len(plain))
                held.append((plain[at:upto], null[at:upto], lengths[at:upto], data[offs[at]:offs[upto]], b.column(2)[at:upto] if carry else None))
                size += int(offs[upto] - offs[at])
                at = upto
                if size >= batch_bytes or sum(len(h[0]) for h in held) >= 20_000:
                    yield close()
        if held:
            yield close()

    schema = pa.schema([("bid", pa.int64()), ("n_bytes", pa.int64()), ("n_docs", pa.int64()), ("ids", pa.binary()), ("offsets", pa.binary()), ("texts", pa.binary()), ("rest", pa.binary())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")] * carry))
    out = rows.mapInArrow(trimmed(fold), BATCH)
    with bounded_batches(docs.sparkSession):
        return written_by(out, name, "bid", buckets) if buckets else written(out, name)


class Texts:
    """A batch row, unpacked: ``ids`` (NULL_ID: null), ``offsets`` into ``data``."""

    def __init__(self, row: dict):
        self.bid = row["bid"]
        self.ids = unsqueeze(row["ids"], np.int64)
        self.offsets = unsqueeze(row["offsets"], np.int64)
        self.data = unsqueeze(row["texts"])


def carried(row: dict) -> dict[str, pa.Array]:
    """The other columns of a batch, in the order of its texts."""
    table = pa.ipc.open_stream(unsqueeze(row["rest"]).tobytes()).read_all().combine_chunks()
    return {n: table.column(n).combine_chunks() for n in table.column_names}


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def rows_of(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that only one batch is unpacked at a time."""
    for b in parts:
        for i in range(b.num_rows):
            yield {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}


def n_buckets(batches: DataFrame, per_byte: float, per_bucket: float = 1.2e6) -> int:
    """Enough buckets that one holds about ``per_bucket`` names; never fewer than the session's partitions."""
    total = batches.agg(F.sum("n_bytes")).first()[0] or 0
    return max(parallelism(batches.sparkSession), int(np.ceil(total * per_byte / per_bucket)))


def bucket_of(names: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each name: equal ranges of the upper 32 bits."""
    return ((names >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def split(names: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each bucket, in ascending order of bucket; order inside a bucket is kept."""
    b = bucket_of(names, n)
    order = np.argsort(b, kind="stable")
    ends = np.searchsorted(b[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(ends)):
        part = order[ends[k]:ends[k + 1]]
        yield int(k), [c[part] for c in columns]


ASKED = "bucket long, gid long, n long, segs binary, body binary"
ANSWERED = "gid long, bucket long, segs binary, body binary"
#: Names that a message shall hold on average, and the batches that may share messages.
MESSAGE_NAMES, FEWEST_BATCHES, MOST_BATCHES = 256, 8, 256


def group_size(n: int, per_byte: float, batch_bytes: int = BATCH_BYTES) -> int:
    """Batches that send to ``n`` buckets together. It grows with the buckets, so that messages grow with the input and
    not with its square, up to ``MOST_BATCHES``."""
    return min(MOST_BATCHES, max(FEWEST_BATCHES, math.ceil(MESSAGE_NAMES * n / (per_byte * batch_bytes))))


def messages(parts: Iterator[pa.RecordBatch], group: int, gather: Callable[[dict], Iterator[tuple[int, list[np.ndarray]]]], encode: Callable[..., bytes]) -> Iterator[pa.RecordBatch]:
    """One message (see ``ASKED``) for each bucket and group of successive batches.

    ``gather`` gives a batch's columns by bucket, ``encode`` the body of a message from its columns. ``segs`` tells
    whose names a message holds, in order: pairs (bid, number).
    """
    held: dict[int, list[tuple[int, list[np.ndarray]]]] = {}
    gid = -1

    def flush() -> pa.RecordBatch:
        cols = ([], [], [], [], [])
        for k in sorted(held):
            held[k].sort(key=lambda h: h[0])
            segs = np.array([(bid, len(c[0])) for bid, c in held[k]], np.int64)
            body = encode(*[np.concatenate(c) for c in zip(*(c for _, c in held[k]), strict=True)])
            for col, v in zip(cols, (k, gid, int(segs[:, 1].sum()), segs.tobytes(), body), strict=True):
                col.append(v)
        held.clear()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in ASKED.split(", ")])

    for row in rows_of(parts):
        own = row["bid"] >> 32 << 32 | (row["bid"] & 0xFFFFFFFF) // group
        if own != gid and held:
            yield flush()
        gid = own
        for k, cols in gather(row):
            held.setdefault(k, []).append((row["bid"], cols))
    if held:
        yield flush()


def exchange(sent: DataFrame, answer: Callable[[pd.DataFrame], list[bytes]]) -> DataFrame:
    """``answer`` gets all messages of one bucket (in order of bid) and returns one body for each, a byte for a name; one
    row (gid, replies) per group of batches comes out: each batch's bytes in order of bucket."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        first = [np.frombuffer(b, np.int64, 1)[0] for b in rows["segs"]]
        rows = rows.iloc[np.argsort(first, kind="stable")]
        return pd.DataFrame({"gid": rows["gid"], "bucket": rows["bucket"], "segs": rows["segs"], "body": answer(rows)})

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        of: dict[int, list[np.ndarray]] = {}
        rows = rows.sort_values("bucket", kind="stable")
        for segs, body in zip(rows["segs"], rows["body"], strict=True):
            segs = np.frombuffer(segs, np.int64).reshape(-1, 2)
            for bid, part in zip(segs[:, 0].tolist(), np.split(unsqueeze(body), np.cumsum(segs[:-1, 1])), strict=True):
                of.setdefault(bid, []).append(part)
        return pd.DataFrame({"gid": [rows["gid"].iloc[0]], "replies": [[{"bid": bid, "body": squeeze(np.concatenate(p))} for bid, p in of.items()]]})

    replies = sent.groupBy("bucket").applyInPandas(one, ANSWERED)
    return replies.groupBy("gid").applyInPandas(deal, "gid long, replies array<struct<bid: long, body: binary>>")


def with_replies(batches: DataFrame, group: int, *replies: DataFrame) -> DataFrame:
    """Batches beside the replies to their group: joined by group, so that a group's batches stay together."""
    out = batches.withColumn("gid", F.expr(f"shiftleft(shiftright(bid, 32), 32) | ((bid & 4294967295L) div {group})"))
    for r in replies:
        out = out.join(r, "gid", "left")
    return out


def own(row: dict, column: str = "replies") -> bytes | None:
    """What a batch finds for itself among the replies to its group."""
    return next((r["body"] for r in row[column] or [] if r["bid"] == row["bid"]), None)


def answered(replies: bytes | None, names: np.ndarray, n: int) -> np.ndarray:
    """The reply byte of each name, in the order in which they were sent."""
    out = np.zeros(len(names), np.uint8)
    if replies:
        out[np.argsort(bucket_of(names, n), kind="stable")] = unsqueeze(replies)
    return out
