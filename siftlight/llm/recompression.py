"""Substring dedup by recompression: repeated word windows are found through symbols that equal texts must share.

A text starts as one symbol per word. Each round first joins runs of one symbol, then pairs of neighbours of which the
left one has bit 0 and the right one bit 1 (the bit is a hash of the symbol and the round). A new symbol's name is a
64-bit mix of the names it is made of, so equal strings get equal names in every batch without a dictionary. Whether a
boundary survives a round depends on its two neighbours alone; each boundary therefore carries the words ("certificate")
that decide it, and a symbol whose certificates lie inside a window appears in every copy of that window.

Two Spark rounds settle the windows. First, each window picks its anchor: the smallest name among the certified symbols
of its highest round that has any; batches ask which anchors occur elsewhere, and windows with an anchor of their own
are unique. Second, the remaining windows are verified by a second, independent name of all their words: a bucket tells
each window whether an equal one starts in an earlier document. Buckets are chosen by anchor and second name mixed, so
equal windows meet and an anchor that many documents hold is spread over all buckets. Effective width: 64 bits, plus the
logarithm of the number of buckets for windows whose anchors differ.

Defined results: a null or empty text has no words and keeps the empty string; texts shorter than a window lose
nothing; rows that repeat a document id are ordered by their place in the input; null ids come after all others; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import ASKED, Texts, answered, exchange, group_size, id_column, messages, n_buckets, own, pack, rows_of, split, with_replies
from .common import written
from .textkit import U, Spans, mix, mix2, pad, squeeze, trimmed, unsqueeze, word_names, words

WINDOW = 20
ROUNDS = 3
NEVER = np.int64(1) << 60


def recompress(names: np.ndarray, first_word: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per round (0: words): names of the certified symbols, and start and end of the words that certify them.

    ``first_word``: index of the first word of each document (documents never share a symbol).
    """
    n = len(names)
    at = np.arange(n + 1, dtype=np.int64)
    left, right, edge = at.copy(), at.copy(), np.zeros(n + 1, bool)
    edge[first_word], edge[n] = True, True
    sym = names
    levels = [(sym, at[:-1], at[1:])]
    for r in range(1, rounds + 1):
        bit = (mix(sym ^ U(r * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) & U(1)).astype(bool)
        joint = np.empty(len(sym) + 1, bool)  # whether the boundary before symbol i goes
        joint[0] = joint[-1] = False
        same = sym[1:] == sym[:-1]
        joint[1:-1] = (same | (~bit[:-1] & bit[1:])) & ~edge[1:-1]
        run_cut = np.ones(len(sym) + 1, bool)
        run_cut[1:-1] = ~(same & ~edge[1:-1])
        at_run = np.flatnonzero(run_cut)
        length = np.diff(at_run)
        letter = sym[at_run[:-1]]
        run = np.where(length > 1, mix2(letter, length.astype(U), 3), letter)
        cut_run = ~joint[at_run]  # boundaries that stay, among those between runs
        heads = np.flatnonzero(cut_run[:-1])
        paired = np.zeros(len(heads), bool)
        paired[:] = np.diff(np.append(heads, len(run))) == 2
        sym2 = run[heads]
        sym2[paired] = mix2(run[heads[paired]], run[heads[paired] + 1], 5)
        stay = at_run[cut_run]
        before, after = np.maximum(stay - 1, 0), np.minimum(stay + 1, len(sym))
        new_left = np.where(edge[stay], -NEVER, left[before])
        new_right = np.where(edge[stay], NEVER, right[after])
        sym, left, right, edge = sym2, new_left, new_right, edge[stay]
        lo, hi = left[:-1], right[1:]
        ok = (lo >= 0) & (hi < NEVER)
        levels.append((sym[ok], lo[ok], hi[ok]))
    return levels


def anchors(levels: list, starts: np.ndarray, window: int) -> np.ndarray:
    """The anchor of the window that begins at each start: the smallest name among its certified symbols, by the
    highest round that certifies one."""
    out = np.zeros(len(starts), U)
    todo = np.arange(len(starts))
    for r in range(len(levels) - 1, -1, -1):
        if not len(todo):
            break
        names, lo, hi = levels[r]
        if not len(names):
            continue
        w = starts[todo]
        a = np.searchsorted(lo, w, "left")
        b = np.searchsorted(hi, w + window, "right")
        found = b > a
        if not found.any():
            continue
        a, b, rows = a[found], b[found], todo[found]
        tables, span = [names], 1
        while span * 2 <= int((b - a).max()):
            t = tables[-1]
            nxt = t.copy()
            nxt[:len(t) - span] = np.minimum(t[:len(t) - span], t[span:])
            tables.append(nxt)
            span *= 2
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        got = np.empty(len(rows), U)
        for k, t in enumerate(tables):
            m = level == k
            got[m] = np.minimum(t[a[m]], t[b[m] - (1 << k)])
        out[rows] = mix2(got, np.full(len(got), r, U), 7)
        todo = todo[~found]
    return out


class Parsed:
    """Words, windows and names of a batch."""

    def __init__(self, batch: Texts, window: int, rounds: int):
        self.padded, self.bounds = pad(batch.data, batch.offsets)
        self.starts, self.ends = words(self.padded)
        n = len(self.starts)
        self.first = np.searchsorted(self.starts, self.bounds)  # first word of each document, and the end
        names = word_names(self.padded, self.starts, self.ends)
        self.n_words = np.diff(self.first)
        per_doc = np.maximum(self.n_words - window + 1, 0)
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)
        begin = np.repeat(self.first[:-1] - (np.cumsum(per_doc) - per_doc), per_doc)
        self.window_at = np.arange(int(per_doc.sum())) + begin
        heads = self.first[:-1][self.n_words > 0]
        self.anchor = anchors(recompress(names, heads, rounds), self.window_at, window) if n and len(self.window_at) else np.empty(0, U)
        self.names = names

    def verify(self, chosen: np.ndarray | slice, window: int) -> np.ndarray:
        """The second name of the chosen windows."""
        return Spans(mix(self.names ^ U(0xA5A5F00DDEADBEEF))).fixed(window)[self.window_at[chosen]]


def _shared(rows: pd.DataFrame) -> list[bytes]:
    """1 for each name that another batch, or its own batch twice, holds."""
    parts = [unsqueeze(b, np.uint64) for b in rows["body"]]
    names = [p[:n] for p, n in zip(parts, rows["n"], strict=True)]
    multi = [p[n:] for p, n in zip(parts, rows["n"], strict=True)]
    every, twice = np.concatenate(names), np.concatenate(multi)
    order = np.sort(every)
    common = np.unique(np.concatenate([order[1:][order[1:] == order[:-1]], twice]))
    return [squeeze(np.isin(p, common).astype(np.uint8)) for p in names]


def _earlier(rows: pd.DataFrame) -> list[bytes]:
    """1 for each window of which an equal one stands in an earlier document (by id, then by batch)."""
    names, docs, sizes = [], [], []
    for body, n in zip(rows["body"], rows["n"], strict=True):
        p = unsqueeze(body, np.uint64)
        names.append(p[:n])
        docs.append(p[n:].view(np.int64))
        sizes.append(n)
    every, ids = np.concatenate(names), np.concatenate(docs)
    order = np.lexsort((ids, every))  # stable: rows are in the order of their batch
    late = np.zeros(len(every), np.uint8)
    late[order[1:]] = every[order[1:]] == every[order[:-1]]
    return [squeeze(p) for p in np.split(late, np.cumsum(sizes)[:-1])]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (if asked) kept_text: the words left, joined by one space.

    A word goes if a window of ``window`` consecutive words that covers it equals one that starts earlier.
    """
    batches = pack(docs, id_col, text_col, name="recompression-batches")
    n = n_buckets(batches, 0.035)
    group = group_size(n, 0.035)

    def ask_anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gather(row: dict) -> Iterator:
            p = Parsed(Texts(row), window, rounds)
            names = np.unique(p.anchor)
            # One symbol serves a run of neighbouring windows. It occurs twice in the batch if its windows lie apart,
            # form a run longer than a window, or equal one another at a distance below that (short periods).
            again = np.zeros(len(names), bool)
            if len(names):
                order = np.argsort(p.anchor, kind="stable")
                s, w = p.anchor[order], p.window_at[order]
                for d in (1, window):
                    far = (s[d:] == s[:-d]) & ((w[d:] - w[:-d] > 1) | (d > 1))
                    again[np.searchsorted(names, s[d:][far])] = True
                second = p.verify(slice(None), window)
                for d in range(1, window + 1):
                    again[np.searchsorted(names, p.anchor[d:][second[d:] == second[:-d]])] = True
            return split(names, n, names, again)

        return messages(parts, group, gather, lambda a, m: squeeze(np.concatenate([a, a[m]])))

    def chosen_of(p: Parsed, replies: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows with a shared anchor: the first of each kind in its batch with its second name and the key of its
        bucket, and those that follow another."""
        names = np.unique(p.anchor)
        hit = answered(replies, names, n).astype(bool)
        chosen = np.flatnonzero(hit[np.searchsorted(names, p.anchor)]) if len(names) else np.empty(0, np.int64)
        second = p.verify(chosen, window)
        _, first = np.unique(second, return_index=True)
        first = np.sort(first)
        again = np.ones(len(chosen), bool)
        again[first] = False
        return chosen[first], second[first], mix2(p.anchor[chosen[first]], second[first], 17), chosen[again]

    def ask_windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def gather(row: dict) -> Iterator:
            batch = Texts(row)
            p = Parsed(batch, window, rounds)
            chosen, second, key, _ = chosen_of(p, own(row))
            ids = batch.ids[p.doc[chosen]].view(np.uint64) if len(chosen) else np.empty(0, U)
            return split(key, n, second, ids)

        return messages(parts, group, gather, lambda a, d: squeeze(np.concatenate([a, d])))

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(parts):
            batch = Texts(row)
            p = Parsed(batch, window, rounds)
            chosen, _, key, again = chosen_of(p, own(row))
            late = chosen[answered(own(row, "later"), key, n).astype(bool)]
            cover = np.zeros(len(p.starts) + 1, np.int32)
            for w in (p.window_at[late], p.window_at[again]):
                np.add.at(cover, w, 1)
                np.add.at(cover, w + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            # bytes of the kept words, each with the byte after it turned into a space
            mark = np.zeros(len(p.padded) + 1, np.int8)
            keep = ~gone
            mark[p.starts[keep]] += 1
            mark[p.ends[keep] + 1] -= 1
            taken = np.cumsum(mark[:-1], dtype=np.int8) > 0
            spaced = p.padded.copy()
            spaced[p.ends] = 32
            out = spaced[taken].tobytes()
            place = np.concatenate([[0], np.cumsum(taken)])[p.bounds]
            removed = np.concatenate([[0], np.cumsum(gone)])
            kept = [out[a:max(a, b - 1)] for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
            cols = [
                id_column(batch.ids), pa.array(p.n_words, pa.int64()), pa.array(removed[p.first[1:]] - removed[p.first[:-1]], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            ]
            if texts:
                cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][:len(cols)])

    replies = exchange(batches.mapInArrow(trimmed(ask_anchors), ASKED), _shared)
    first = written(replies, "recompression-anchors")
    later = exchange(with_replies(batches, group, first).mapInArrow(trimmed(ask_windows), ASKED), _earlier).withColumnRenamed("replies", "later")
    joined = with_replies(batches, group, first, later)
    return joined.mapInArrow(trimmed(finish), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE = {
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS k, unnest(list_transform(range(1, len(ws) - 18), lambda k: md5(array_to_string(ws[k:k + 19], ' ')))) AS name FROM d WHERE len(ws) >= 20),
late AS (SELECT doc_id, k FROM windows QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM late, range(20) AS t(j)),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d),
kept AS (SELECT w.doc_id, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY w.k) FILTER (gone.k IS NULL) AS text FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.k = gone.k GROUP BY w.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
}
