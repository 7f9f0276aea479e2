"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction keeps a state h; a byte x gives an update gate z = sigmoid(W[x] + h U) and a candidate c = tanh(W'[x] +
h U'), and h moves by z (c - h). Both states label every byte with a distribution over the languages; a document's
probabilities are the mean over all its bytes. Texts are read whole, in stretches of ``STRETCH`` bytes.

Training: numpy, backpropagation through time, on at most ``TRAIN_DOCS`` labelled documents (those with the smallest
hash of their id among the training rows, one row for each id) and ``TRAIN_STRETCHES`` stretches of each; the bounds are
parameters. A shorter text is learned from whole: what pads it moves no state and counts for nothing.

Defined results: a null text or one without a letter is ``und`` with score 0, as is everything if no row is labelled;
null ids are never held out and never learned from; repeated rows are judged alike; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import text_buffers, trimmed

HIDDEN = 8
STRETCH = 128
TRAIN_DOCS, TRAIN_STRETCHES, TRAIN_BYTES = 1200, 4, 64
EPOCHS, RATE, MINIBATCH = 30, 0.01, 480
UNKNOWN = "und"
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Network:
    """Weights: per direction w (256, 2H), u (H, 2H), v (H, L); and b (L). Gates stand first in 2H, at half scale, so
    that one tanh serves both: sigmoid(2a) = (1 + tanh(a)) / 2."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5):
        r = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        n = len(languages)
        self.p = {f"w{d}": r.normal(0, 0.3, (256, 2 * hidden)).astype(np.float32) for d in "fb"}
        self.p |= {f"u{d}": r.normal(0, 0.3, (hidden, 2 * hidden)).astype(np.float32) for d in "fb"}
        self.p |= {f"v{d}": r.normal(0, 0.3, (hidden, n)).astype(np.float32) for d in "fb"}
        self.p["b"] = np.zeros(n, np.float32)

    def states(self, x: np.ndarray, d: str, keep: list | None = None, inside: np.ndarray | None = None) -> np.ndarray:
        """States (T, B, H) after each byte of x (T, B), read forwards or backwards; bytes not ``inside`` change none."""
        w, u, h = self.p["w" + d], self.p["u" + d], self.h
        out = np.empty((*x.shape, h), np.float32)
        s = np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = w[x[t]]
            a += s @ u
            np.tanh(a, out=a)
            z = a[:, :h] * 0.5
            z += 0.5
            if inside is not None:
                z *= inside[t][:, None]
            step = a[:, h:] - s
            if keep is not None:
                keep.append((t, s, a, z, step))
            step = step * z
            s = np.add(s, step, out=out[t])
        return out

    def shares(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The label distribution of every byte."""
        y = f.reshape(-1, self.h) @ self.p["vf"]
        y += b.reshape(-1, self.h) @ self.p["vb"]
        y += self.p["b"]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, label: np.ndarray, inside: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all bytes (T, B), or those ``inside``."""
        kept = {"f": [], "b": []}
        s = {d: self.states(x, d, kept[d], inside) for d in "fb"}
        y = self.shares(s["f"], s["b"])
        y[np.arange(len(y)), np.tile(label, len(x))] -= 1
        if inside is not None:
            y *= inside.reshape(-1, 1)
        y /= len(y) if inside is None else max(1, int(inside.sum()))
        g = {"b": y.sum(0)}
        h = self.h
        for d in "fb":
            g["v" + d] = s[d].reshape(-1, h).T @ y
            into = (y @ self.p["v" + d].T).reshape(*x.shape, h)
            gw, gu = np.zeros_like(self.p["w" + d]), np.zeros_like(self.p["u" + d])
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, before, a, z, step in reversed(kept[d]):
                ds = into[t] + carry
                da = np.empty_like(a)
                da[:, :h] = ds * step * 0.5
                if inside is not None:
                    da[:, :h] *= inside[t][:, None]
                da[:, h:] = ds * z
                da *= 1 - a * a
                carry = ds * (1 - z) + da @ self.p["u" + d].T
                gu += before.T @ da
                np.add.at(gw, x[t], da)
            g["w" + d], g["u" + d] = gw, gu
        return g

    def fit(self, x: np.ndarray, label: np.ndarray, size: np.ndarray | None = None, epochs: int = EPOCHS, rate: float = RATE, seed: int = 6) -> Network:
        """Adam over minibatches; x (N, T) bytes, label (N), size (N): how many of a row's bytes count."""
        r, first, second, n = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            step = rate * (1 - epoch / epochs) + 1e-4
            for lo in range(0, len(x), MINIBATCH):
                some = order[lo:lo + MINIBATCH]
                n += 1
                inside = None if size is None or size[some].min() == x.shape[1] else (np.arange(x.shape[1])[:, None] < size[some]).astype(np.float32)
                for k, g in self.gradients(np.ascontiguousarray(x[some].T), label[some], inside).items():
                    m = first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    q = second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (step * (m / (1 - 0.9**n)) / (np.sqrt(q / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, data: np.ndarray, offsets: np.ndarray, width: int = STRETCH) -> np.ndarray:
        """Mean label distribution over all bytes of each text (empty: zeros)."""
        sizes = np.diff(offsets)
        parts = -(-sizes // width)
        doc = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = offsets[:-1][doc] + nth * width
        length = np.minimum(width, offsets[1:][doc] - start)
        total = np.zeros((len(sizes), len(self.languages)))
        # equal lengths stand together, so that short stretches are not padded to long ones
        order = np.argsort(-length, kind="stable")
        for lo in range(0, len(order), 2048):
            some = order[lo:lo + 2048]
            t = int(length[some[0]])
            at = start[some][:, None] + np.arange(t)
            inside = np.arange(t) < length[some][:, None]
            x = np.ascontiguousarray(np.where(inside, data[np.minimum(at, len(data) - 1)], 0).T)
            short = None if inside.all() else inside.T.astype(np.float32)
            y = self.shares(self.states(x, "f"), self.states(x, "b", inside=short)).reshape(t, len(some), -1)
            y *= inside.T[:, :, None]
            np.add.at(total, doc[some], y.sum(0, dtype=np.float64))
        return total / np.maximum(sizes, 1)[:, None]


def train(labelled: DataFrame, max_docs: int = TRAIN_DOCS, stretches: int = TRAIN_STRETCHES, width: int = TRAIN_BYTES) -> Network | None:
    """A network fitted to at most ``max_docs`` rows of (doc_id, text, lang), chosen by a hash of doc_id.

    Rows without text teach nothing; without any other, there is no network.
    """
    named = labelled.filter("doc_id is not null and octet_length(text) > 0 and lang is not null")
    # Ids are chosen first, so the ordering moves no texts; of the chosen rows, one for each id, only the stretches
    # reach the driver.
    ids = named.select("doc_id", F.xxhash64("doc_id").alias("o")).distinct().orderBy("o", "doc_id").limit(max_docs).select("doc_id")
    raw, n = F.col("text").cast("binary"), F.octet_length("text")
    starts = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(n - width + 1, F.lit(1))).cast("int") + 1 for k in range(stretches)]
    cut = F.array(*[F.substring(raw, p, F.lit(width)) for p in starts])
    chosen = named.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", F.struct("lang", cut.alias("cut")).alias("r"))
    rows = chosen.groupBy("doc_id").agg(F.min("r").alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    cuts = [(c, languages.index(r.lang)) for r in rows for c in r.cut]
    x = np.frombuffer(b"".join(bytes(c).ljust(width, b"\0") for c, _ in cuts), np.uint8).reshape(-1, width)
    return Network(languages).fit(x, np.array([k for _, k in cuts]), np.array([len(c) for c, _ in cuts]))


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score: one row per document; ``carry`` adds the input row as the struct ``row``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            n = b.num_rows
            best, score, letter = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
            data, offs = text_buffers(b.column(1))
            hits = np.concatenate([[0], np.cumsum(_LETTERS[data])])[offs]
            letter = hits[1:] > hits[:-1]
            for i in np.flatnonzero(~letter & (np.diff(offs) > 0)):
                letter[i] = any(c.isalpha() for c in data[offs[i]:offs[i + 1]].tobytes().decode("utf-8", "replace"))
            if network is not None:
                lo = 0
                while lo < n:  # about a megabyte at a time
                    hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + (1 << 20), "right")) - 1), n)
                    share = network.pooled(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                    best[lo:hi], score[lo:hi] = share.argmax(1), share.max(1)
                    lo = hi
            known = letter & (network is not None)
            names = np.array([*(network.languages if network else []), UNKNOWN], object)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(names[np.where(known, best, len(names) - 1)], pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0)),
                *([b.column(2)] if carry else []),
            ], names=["doc_id", "lang_pred", "score", "row"][:3 + carry])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct("*").alias("row")] * carry))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if carry:
        schema.add("row", docs.schema)
    return rows.mapInArrow(trimmed(run), schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), network)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
