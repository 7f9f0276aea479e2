"""SentencePiece encoding and decoding through a relational lattice.

The model is BPE with byte fallback; a text becomes its characters with every space written as U+2581 and one in front.
A text is cut between any two characters that stand together in no piece, for no merge goes across: the units are encoded
by themselves. No piece holds U+2581 after another character, so they are found in the distinct words, each a run of
U+2581 and what follows; a mark behind a word mostly is a unit of its own. Each distinct unit is encoded once:

1. batches send their distinct units, by hash, to buckets, which number them; both tables are laid out by bucket, so
   nothing below moves units again;
2. the lattice of a unit: its substrings from two characters up to the longest piece are exploded and equi-joined to the
   piece table (a broadcast bounded by the vocabulary), and the edges are grouped by unit, in order of rank, then place;
3. a higher-order aggregate folds over the edges. The state is the set of token boundaries as a bit mask: an edge whose
   two ends are still boundaries drops those between them. For that order of the edges this is the path BPE takes,
   because the edges before a piece leave it as two tokens (``Model`` checks that for every piece). A sum of piece
   scores, as Viterbi maximises it for unigram models, gives other tokens than a BPE model's own;
4. the buckets answer each batch with the ids of its units, and the batch puts its documents together.

Units beyond the 62 characters of the mask have the same lattice; their edges are folded by the same rule over a byte
for each boundary, in the bucket.

Defined results: a null or empty text has no ids; null ids stay; repeated rows are encoded each; an empty table gives an
empty result; other columns are not read. U+2581 in a text is a space to the model, and decodes as one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import id_column, pack, rows_of
from .common import parallelism, written_by
from .textkit import ranges, squeeze, trimmed, uncollected, unsqueeze

SPACE = "▁"
#: Characters of a unit whose boundaries fit a bit mask.
MASK = 62
BATCH_BYTES = 16 << 20
#: Bytes of text for each bucket of units.
BUCKET_BYTES = 6 << 20
#: Bytes of input for each file of the tables that are laid out by bucket, and the most files there can be.
FILE_BYTES, MOST_FILES = 256 << 20, 100_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """What the model file holds: pieces by id, with scores; kinds as in the file format."""

    NORMAL, BYTE = 1, 6

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.pieces = [(p.piece, i, p.score, p.type) for i, p in enumerate(proto.pieces)]
        self.longest = max(len(p[0]) for p in self.pieces if p[3] == self.NORMAL)
        self.first_byte = next(i for p, i, _, kind in self.pieces if kind == self.BYTE)
        raw = [bytes([i - self.first_byte]) if kind == self.BYTE else p.encode() if kind == self.NORMAL else b"" for p, i, _, kind in self.pieces]
        self.sizes = np.array([len(b) for b in raw])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        normal = [p for p in self.pieces if p[3] == self.NORMAL]
        #: Rank 0 is the best score; equal scores share a rank.
        self.rank = {s: k for k, s in enumerate(sorted({p[2] for p in normal}, reverse=True))}
        self.known = {p: (self.rank[s], i) for p, i, s, _ in normal}
        self.neighbours = {p[k:k + 2] for p in self.known for k in range(len(p) - 1)}
        self.single = {p: i for p, (_, i) in self.known.items() if len(p) == 1}
        if len(self.pieces) >= 1 << 20 or self.longest > 31 or len(self.rank) >= 1 << 17:
            raise ValueError("the vocabulary does not fit the packed edges")
        runs = {p[0] for p in self.known if len(p) > 1 and p == p[0] * len(p)}
        odd = next((p for p in self.known if len(p) > 1 and p != p[0] * len(p) and self._tokens_below(p) != 2), None)
        odd = odd or next((c * n for c in runs for n in range(2, 3 * self.longest) if self._swept(c * n) != self._merged(c * n)), None)
        if odd is not None:
            raise ValueError(f"not a vocabulary of merges: {odd!r} is not made of two better pieces")

    def _edges(self, text: str) -> list[tuple[int, int, int]]:
        """(rank, start, end) of the pieces in a text, in the order of the fold."""
        n = len(text)
        return sorted((self.known[text[a:b]][0], a, b) for a in range(n) for b in range(a + 2, min(n, a + self.longest) + 1) if text[a:b] in self.known)

    def _tokens_below(self, piece: str) -> int:
        """Tokens that the edges before it leave of a piece: better-ranked ones, and shorter ones of its rank and start."""
        top, n = self.known[piece][0], len(piece)
        return len(self._swept(piece, (top, 0, n))) - 1

    def _swept(self, text: str, upto: tuple | None = None) -> list[int]:
        """Boundaries after a pass over the edges (before ``upto``)."""
        alive = bytearray([1]) * (len(text) + 1)
        for e in self._edges(text):
            if (upto is None or e < upto) and alive[e[1]] and alive[e[2]]:
                alive[e[1] + 1:e[2]] = bytes(e[2] - e[1] - 1)
        return [k for k, x in enumerate(alive) if x]

    def _merged(self, text: str) -> list[int]:
        """Boundaries after merging the best neighbours, leftmost first, again and again: only for the check above."""
        at = list(range(len(text) + 1))
        while True:
            found = [(self.known[text[a:b]][0], a, b) for a, b in zip(at[:-2], at[2:], strict=False) if text[a:b] in self.known]
            if not found:
                return at
            _, a, b = min(found)
            at = [k for k in at if not a < k < b]

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, rank) of the pieces of two characters and more."""
        return spark.createDataFrame([(p, i, r) for p, (r, i) in self.known.items() if len(p) > 1], "piece string, id int, rank int")

    def reaches(self, spark: SparkSession) -> DataFrame:
        """(head, lengths): the first three characters of pieces, and the lengths from there on of those that begin so."""
        by: dict[str, set[int]] = {}
        for p in self.known:
            if len(p) > 2:
                by.setdefault(p[:3], set()).add(len(p))
        return spark.createDataFrame([(h, sorted(m)) for h, m in by.items()], "head string, lengths array<int>")

    @cached_property
    def together(self) -> tuple[np.ndarray, np.ndarray]:
        """A class for each character (0: it stands beside another in no piece), and by two classes whether they stand together."""
        letters = {c: k for k, c in enumerate(sorted(set("".join(self.neighbours))), 1)}
        classes, pairs = np.zeros(0x110000, np.int32), np.zeros((len(letters) + 1, len(letters) + 1), bool)
        classes[[ord(c) for c in letters]] = list(letters.values())
        first, second = zip(*[(letters[p[0]], letters[p[1]]) for p in self.neighbours], strict=True)
        pairs[first, second] = True
        return classes, pairs

    @cached_property
    def ids_alone(self) -> np.ndarray:
        """Id of each character by itself; -1: it is its bytes."""
        out = np.full(0x110000, -1, np.int64)
        out[[ord(c) for c in self.single]] = list(self.single.values())
        return out

    def units(self, words: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct units of some words, the number of each unit of all words end to end, and how many units each has."""
        space = SPACE.encode()
        marked = [space + (w.replace(b" ", space) if b" " in w else w) for w in words]
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))])
        raw = b"".join(marked)
        del marked
        at, code = places(raw)
        classes, pairs = self.together
        kind = classes[code]
        new = np.zeros(len(raw), bool)
        new[at[1:]] = ~pairs[kind[:-1], kind[1:]]
        new[begins[:-1]] = True
        cut = np.append(np.flatnonzero(new), len(raw))
        coded = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(raw)]).dictionary_encode()
        return coded.dictionary, np.asarray(coded.indices), np.diff(np.searchsorted(cut, begins))

    def long_path(self, n: int, bases: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, length, id) of the pieces on the path of a unit beyond the mask, from the edges of all its blocks (where
        they begin, and how many edges each has): folded in the same order, by rank and then by place in the unit."""
        start = np.repeat(bases, counts) + (edges >> 25 & 63)
        order = np.lexsort((start, edges >> 46))  # edges of one rank and start keep their order
        alive, path = bytearray([1]) * (n + 1), {}
        for s, x in zip(start[order].tolist(), edges[order].tolist(), strict=True):
            m = x >> 20 & 31
            if alive[s] and alive[s + m]:
                alive[s + 1:s + m] = bytes(m - 1)
                path[s] = (m, x & (1 << 20) - 1)
        return [(s, *path[s]) for s in sorted(path) if alive[s] and not any(alive[s + 1:s + path[s][0]])]

    def ids(self, raw: bytes, begins: np.ndarray, start: np.ndarray, length: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units end to end, and how many each has, from the pieces on their paths (place among all characters,
        characters, id); what no piece covers is characters by themselves, or else their bytes. ``begins``: in characters."""
        at, code = places(raw)
        size = np.diff(at, append=len(raw))
        value = self.ids_alone[code]
        width = np.where(value < 0, size, 1)
        inside = np.zeros(len(code) + 1, np.int64)
        inside[start] += 1  # pieces on a path don't overlap
        np.subtract.at(inside, start + length, 1)
        width[np.cumsum(inside[:-1]) > 0] = 0
        width[start], value[start] = 1, piece
        upto = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(value, width)
        as_bytes = np.flatnonzero((value < 0) & (width > 0))
        out[ranges(upto[as_bytes], width[as_bytes])] = np.frombuffer(raw, np.uint8)[ranges(at[as_bytes], size[as_bytes])].astype(np.int64) + self.first_byte
        return out, np.diff(upto[begins])

    def pieces_of(self, ids: np.ndarray) -> bytes:
        """The pieces of the ids, UTF-8, with spaces."""
        return self.bytes[ranges(self.starts[ids], self.sizes[ids])].tobytes().replace(SPACE.encode(), b" ")

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids, UTF-8, without the space in front."""
        out = self.pieces_of(ids)
        return out[1:] if out[:1] == b" " else out


def places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of UTF-8 begin, and their code points."""
    return np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)


#: Starts in one block of a long unit: a substring costs its distance from the block's beginning.
BLOCK = 64
BLOCKS = "bucket long, k int, n int, starts int, block string"
#: ``n`` of a block of a long unit: this and where the block begins.
LONG = MASK + 1


def blocks(k: int, unit: str, longest: int) -> list[tuple[int, int, int, str]]:
    """A unit's rows of ``BLOCKS`` (n: its length): of a long one, blocks that overlap by what a piece may reach beyond
    them, so edges are gathered by block and no start needs more bits than a block's."""
    n = len(unit)
    if n <= MASK:
        return [(k, n, n - 1, unit)] if n > 1 else []
    return [(k, LONG + at, min(BLOCK, n - 1 - at), unit[at:at + BLOCK + longest - 1]) for at in range(0, n - 1, BLOCK)]


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """(bucket, k, n, edges) of distinct units (rows of ``BLOCKS``) that have an edge; see ``Model.ids``.

    Exploding and the broadcast join leave a partitioning by bucket in place, so grouping the edges moves nothing.
    """
    spark = units.sparkSession
    cut = units.select("bucket", "k", "n", "block", F.explode(F.sequence(F.lit(0), F.col("starts") - 1)).alias("s"))
    cut = cut.withColumn("head", F.expr("substring(block, s + 1, 3)")).join(F.broadcast(model.reaches(spark)), "head", "left")
    # Two characters always; of longer substrings those of a length that a piece with these first three characters has.
    cut = cut.select("bucket", "k", "n", "block", "s", F.explode(F.expr("if(lengths is null, array(2), array_prepend(lengths, 2))")).alias("m"))
    cut = cut.filter("m = 2 or s + m <= char_length(block)").select("bucket", "k", "n", "s", "m", F.expr("substring(block, s + 1, m)").alias("piece"))
    edges = cut.join(F.broadcast(model.table(spark)), "piece")
    # An edge is one number, so that it sorts by rank, then place in its block: rank (17 bits), start (21), length (5), id (20).
    packed = "shiftleft(cast(rank as bigint), 46) | shiftleft(cast(s as bigint), 25) | shiftleft(cast(m as bigint), 20) | id"
    lattice = edges.select("bucket", "k", "n", F.expr(packed).alias("e")).groupBy("bucket", "k", "n").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    s, t = "cast(shiftright(e, 25) & 63 as int)", "cast((shiftright(e, 25) & 63) + (shiftright(e, 20) & 31) as int)"
    ends, between = f"(shiftleft(1L, {s}) | shiftleft(1L, {t}))", f"((shiftleft(1L, {t}) - 1) ^ (shiftleft(2L, {s}) - 1))"
    folded = lattice.select("bucket", "k", "n", "edges", F.expr(f"""if(n > {MASK}, 0L, aggregate(
        edges, -1L, (b, e) -> if((b & {ends}) = {ends}, b & ~{between}, b)))""").alias("b"))
    # Without the rank an edge sorts by its place.
    path = F.expr(f"sort_array(transform(filter(edges, e -> (b & {ends}) = {ends} and (b & {between}) = 0), e -> e & {(1 << 46) - 1}L))")
    return folded.select("bucket", "k", "n", F.when(F.col("n") > MASK, F.col("edges")).otherwise(path).alias("edges"))


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(data)


def _unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _numbers(*columns: np.ndarray, rest: bytes = b"") -> bytes:
    """Columns of numbers below 2^32, each byte of them by itself as it compresses best, and what follows."""
    parts = [np.ascontiguousarray(np.array(c, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]
    return squeeze(np.array([len(columns), *map(len, columns)], "<i8").tobytes() + b"".join(parts) + rest, 3)


def _columns(data: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = _unsqueeze(data)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 * (count + 1), []
    for size in np.frombuffer(raw, "<i8", count, 8).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4").ravel().astype(np.int64))
        at += 4 * size
    return out, raw[at:]


def _words(text: bytes) -> list[bytes]:
    """What stands between single spaces; further spaces stay in front of the word they precede."""
    words = text.split(b" ") if text else []
    if b"" not in words[:-1]:
        return words
    out, spaces = [], b""
    for w in words[:-1]:
        if w:
            out.append(spaces + w)
            spaces = b""
        else:
            spaces += b" "
    return [*out, spaces + words[-1]]


def _indexed(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the number of each word of all texts end to end, and how many words each has."""
    odd = [i for i, x in enumerate(texts) if x[:1] == b" " or b"  " in x]  # their words are more than a split by spaces
    plain = list(texts)
    for i in odd:
        plain[i] = b""
    lists = pc.split_pattern(pa.array(plain, pa.large_binary()), b" ")
    coded = lists.flatten().dictionary_encode()
    _, offsets, data = coded.dictionary.buffers()
    raw, at = data.to_pybytes() if data else b"", np.frombuffer(offsets, np.int64)[:len(coded.dictionary) + 1].tolist()
    words = [raw[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
    index, counts = np.array(coded.indices, np.int32), np.asarray(lists.value_lengths()).astype(np.int64)
    del lists, coded, raw, data, offsets, at
    pa.default_memory_pool().release_unused()  # the split words go back before the ids come
    empty = np.array([not x for x in plain], bool)  # a split leaves one empty word of them
    if empty.any():
        index, counts = index[np.repeat(~empty, counts)], np.where(empty, 0, counts)
    if odd:
        number = {w: k for k, w in enumerate(words)}
        own = {i: np.array([number.setdefault(w, len(number)) for w in _words(texts[i])], np.int32) for i in odd}
        parts = np.split(index, np.cumsum(counts)[:-1])
        index = np.concatenate([own.get(i, part) for i, part in enumerate(parts)])
        counts[odd] = [len(own[i]) for i in odd]
        words = list(number)
    return words, index, counts


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (unsigned 32-bit little-endian), round_trip and (if asked) ids as array<int>."""
    shuffles = parallelism(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    files = max(shuffles, min(size // FILE_BYTES, MOST_FILES))
    n = max(files, size // BUCKET_BYTES)
    model = Model(model_path)
    width = np.uint16 if len(model.pieces) < 1 << 16 else np.uint32
    space = SPACE.encode()

    def texts_of(raw: bytes, offsets: np.ndarray) -> list[bytes]:
        offs = offsets.tolist()
        texts = [raw[x:y] for x, y in zip(offs[:-1], offs[1:], strict=True)]
        try:
            raw.decode()
        except UnicodeDecodeError:
            texts = [x.decode("utf-8", "replace").encode() for x in texts]
        return [x.replace(space, b" ") for x in texts] if space in raw else texts

    def coded(raw: bytes, offsets: np.ndarray) -> tuple[bytes, bytes]:
        """Texts as numbers: words of each text, the word at each place, units of each distinct word, the unit at each
        place. And the distinct units by bucket (sorted inside): the buckets, how many units and bytes each has, and they
        themselves with a space between; the units are numbered in this order."""
        words, index, counts = _indexed(texts_of(raw, offsets))
        units, own, many = model.units(words)
        del words
        bucket = np.fromiter(map(zlib.crc32, units.to_pylist()), np.int64, len(units)) % n
        order = np.asarray(pc.sort_indices(units)).astype(np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        names = units.take(pa.array(order)).to_pylist()
        bodies = [b" ".join(names[a:z]) for a, z in zip(np.append(0, ends)[:-1].tolist(), ends.tolist(), strict=True)]
        return _numbers(counts, index, many, number[own]), _numbers(bucket[order[ends - 1]], np.diff(ends, prepend=0), [len(b) for b in bodies], rest=b" ".join(bodies))

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            (buckets, _, sizes), units = _columns(row["rest"])
            ends = np.cumsum(sizes + 1).tolist()
            bodies = [_squeeze(units[a:z - 1]) for a, z in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array([row["bid"]] * len(bodies), pa.int64()), pa.array(bodies, pa.binary())], names=["bucket", "bid", "body"])

    def wrong(units: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Units that their ids do not decode to. A text is its units in a row, its ids are theirs."""
        out, upto = np.zeros(len(units), bool), np.concatenate([[0], np.cumsum(sizes)])
        for lo in range(0, len(units), 50_000):
            some = [u.replace(space, b" ") for u in units[lo:lo + 50_000]]
            if model.pieces_of(ids[upto[lo]:upto[lo + len(some)]]) != b"".join(some):
                out[lo:lo + len(some)] = [model.pieces_of(ids[upto[lo + i]:upto[lo + i + 1]]) != u for i, u in enumerate(some)]
        return out

    def numbered(bodies: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
        """The distinct units of a bucket, sorted; their order numbers them. And the numbers of each message's units."""
        raw = [_unsqueeze(b.as_py()) for b in bodies]
        coded = pc.split_pattern(pa.array([b" ".join(raw)], pa.large_binary()), b" ").flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        number = np.empty(len(order), np.int64)
        number[np.asarray(order)] = np.arange(len(order))
        return coded.dictionary.take(order), np.split(number[np.asarray(coded.indices)], np.cumsum([r.count(b" ") + 1 for r in raw])[:-1])

    def distinct(rows: pa.Table) -> pa.Table:
        with uncollected():
            units = numbered(rows.column("body"))[0].cast(pa.large_string()).cast(pa.string())
            n = pc.utf8_length(units)
            short = np.flatnonzero((np.asarray(n) > 1) & (np.asarray(n) <= MASK))
            made = [row for k in np.flatnonzero(np.asarray(n) > MASK).tolist() for row in blocks(k, units[k].as_py(), model.longest)]
            n, names = n.take(pa.array(short)), [f.split()[0] for f in BLOCKS.split(", ")]
            few = [pa.array(short.astype(np.int32)), n, pc.subtract(n, pa.scalar(1, pa.int32())), units.take(pa.array(short))]
            cols = [pa.concat_arrays([a, pa.array(c, a.type)]) for a, c in zip(few, list(zip(*made, strict=True)) or [[]] * 4, strict=True)]
            return pa.table([pa.repeat(rows.column("bucket")[0], len(cols[0])), *cols], names=names)

    def reply(sent: pa.Table, paths: pa.Table) -> pa.Table:
        with uncollected():
            k_of, n_of = (np.asarray(paths.column(c)).astype(np.int64) for c in ("k", "n"))
            order = np.lexsort((n_of, k_of))
            lists = paths.column("edges").combine_chunks().take(pa.array(order))
            counts = np.asarray(lists.value_lengths()).astype(np.int64)
            flat, ends, k_of, n_of = np.asarray(lists.flatten()).astype(np.int64), np.cumsum(counts), k_of[order], n_of[order]
            units, asked = numbered(sent.column("body"))
            begins = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(units.cast(pa.large_string()))))])
            short = n_of < LONG
            e = flat[np.repeat(short, counts)]
            found = [(np.repeat(begins[k_of[short]], counts[short]) + (e >> 25 & 63), e >> 20 & 31, e & (1 << 20) - 1)]
            long = np.flatnonzero(~short)  # a unit's blocks stand in a row
            for part in np.split(long, np.flatnonzero(np.diff(k_of[long])) + 1) if len(long) else []:
                k, a, z = int(k_of[part[0]]), int(ends[part[0]] - counts[part[0]]), int(ends[part[-1]])
                path = model.long_path(int(begins[k + 1] - begins[k]), n_of[part] - LONG, counts[part], flat[a:z])
                found.append(tuple(np.array(path, np.int64).reshape(-1, 3).T + np.array([[begins[k]], [0], [0]])))
            got, sizes = model.ids(b"".join(units.to_pylist()), begins, *[np.concatenate(c) for c in zip(*found, strict=True)])
            starts, bodies = np.cumsum(sizes) - sizes, []
            for k in asked:
                bodies.append(_squeeze(sizes[k].astype(np.uint32).tobytes() + got[ranges(starts[k], sizes[k])].astype(width).tobytes()))
            return pa.table({"bid": sent.column("bid"), "bucket": sent.column("bucket"), "body": pa.array(bodies, pa.binary())})

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            (buckets, held, _), units = _columns(row["rest"])
            (counts, index, many, own), _ = _columns(row["texts"])
            raw, found = {r["bucket"]: r["body"] for r in row["replies"] or []}, []
            for b, k in zip(buckets.tolist(), held.tolist(), strict=True):
                body = _unsqueeze(raw.pop(b))
                found.append((np.frombuffer(body, np.uint32, k), np.frombuffer(body, width, offset=4 * k)))
            sizes, flat = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.uint32), np.empty(0, width))
            sizes = sizes.astype(np.int64)
            bad = wrong(units.split(b" ") if len(sizes) else [], sizes, flat)
            starts, doc_ids, faulty = np.cumsum(sizes) - sizes, id_column(unsqueeze(row["ids"], np.int64)), None
            del raw, found, units
            # From here on by word: the ids of its units in a row.
            flat, last = flat[ranges(starts[own], sizes[own])].astype(np.uint32), np.cumsum(many)
            if bad.any():
                upto = np.concatenate([[0], np.cumsum(bad[own])])
                faulty = np.concatenate([[0], np.cumsum((upto[last] > upto[last - many])[index])])
            upto = np.concatenate([[0], np.cumsum(sizes[own])])
            starts, sizes = upto[last - many], upto[last] - upto[last - many]
            ends = np.cumsum(counts)
            for lo in range(0, len(counts), 250):
                hi, out = min(lo + 250, len(counts)), []
                first = int(ends[lo] - counts[lo])
                of = index[first:int(ends[hi - 1])]
                got = flat[ranges(starts[of], sizes[of])]
                upto = np.concatenate([[0], np.cumsum(sizes[of])])
                for i in range(lo, hi):
                    a, z = int(ends[i] - counts[i]), int(ends[i])
                    mine = got[upto[a - first]:upto[z - first]]
                    right = faulty is None or faulty[a] == faulty[z]
                    out.append((doc_ids[i].as_py(), len(mine), hashlib.sha256(mine.tobytes()).hexdigest(), bool(right)) + ((mine.astype(np.int32).tolist(),) if ids else ()))
                yield _docs(out, ids)

    batches = pack(docs, id_col, text_col, batch_bytes=BATCH_BYTES, name="lattice-batches", coded=coded, buckets=files)
    sent = batches.select("bid", "rest").mapInArrow(trimmed(send), "bucket long, bid long, body binary").repartition(files, "bucket")
    sent = written_by(sent, "lattice-units", "bucket", files)
    unique = written_by(sent.groupBy("bucket").applyInArrow(distinct, BLOCKS), "lattice-distinct", "bucket", files)
    replies = sent.groupBy("bucket").cogroup(encode_units(unique, model).groupBy("bucket")).applyInArrow(reply, "bid long, bucket long, body binary")
    by_batch = replies.groupBy("bid").agg(F.collect_list(F.struct("bucket", "body")).alias("replies"))
    return batches.join(by_batch, "bid", "left").mapInArrow(trimmed(finish), "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * ids)


def _docs(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32())][:4 + ids]
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "round_trip", "ids"][:len(kinds)])


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model(), ids=False)


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
