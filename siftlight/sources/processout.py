"""Output of processes as a streaming source: files that grow, line by line.

``spark.readStream.format("process_output").load(folder)`` gives (output, line_no, record, done). An output is a file
with the suffix of the option ``suffix``; offsets are bytes of each file up to its last whole line, so a line is read once
it is whole, once, and with its number, across batches and restarts. When ``<file>.done`` appears the output is complete:
what stands after its last newline is a line too, and a row with ``done`` and no record carries the number of its lines.

New bytes beyond ``SPLIT`` are dealt to several tasks; a task counts the newlines before its part in its file. Small
outputs share a task, a file counting as ``OPEN`` bytes at least, so tasks grow with what is new and not by the file.
Outputs only grow; folders are read where they are mounted.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "output string, line_no long, record string, done boolean"
COLUMNS = pa.schema([("output", pa.string()), ("line_no", pa.int64()), ("record", pa.string()), ("done", pa.bool_())])
SPLIT, CHUNK, BATCH, OPEN = 32 << 20, 1 << 20, 8192, 1 << 16


class ProcessOutput(DataSource):
    @classmethod
    def name(cls) -> str:
        return "process_output"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return OutputReader(self.options)


@dataclass
class Piece:
    """Bytes of one output; ``first`` of what is new, ``ends`` if they complete it."""

    output: str
    start: int
    end: int
    first: bool
    ends: bool


class Share(InputPartition):
    """Pieces that one task reads."""

    def __init__(self, pieces: list[Piece]):
        super().__init__(pieces[0].output)
        self.pieces = pieces


def whole_lines(path: str, size: int) -> int:
    """Bytes up to and including the last newline."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            start = max(0, at - CHUNK)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


def newlines(path: str, upto: int) -> int:
    n, left = 0, upto
    with open(path, "rb") as f:
        while left > 0 and (data := f.read(min(CHUNK, left))):
            n += data.count(b"\n")
            left -= len(data)
    return n


class OutputReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.suffix, self.split = options.get("path", ""), options.get("suffix", ".txt"), int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """{output: bytes}, negative (-1 - bytes) once it is complete."""
        out = {}
        try:
            with os.scandir(self.folder) as found:
                entries = [e for e in found if e.name.endswith((self.suffix, f"{self.suffix}.done"))]
        except OSError:
            return {}
        marks = {e.name for e in entries if e.name.endswith(".done")}  # looked at first: what was written before one is there now
        sizes = [(e.name, e.stat().st_size) for e in entries if e.name.endswith(self.suffix) and e.is_file()]
        for name, size in sorted(sizes):
            out[name] = -1 - size if f"{name}.done" in marks else whole_lines(f"{self.folder}/{name}", size)
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        shares, held, size = [], [], 0
        for name, to in end.items():
            since = start.get(name, 0)
            if since < 0 or 0 <= to <= since:  # complete already, or nothing new
                continue
            upto, ends = (-1 - to, True) if to < 0 else (to, False)
            cuts = [*range(since, upto, self.split), upto] if upto > since else [since, since]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                cost = max(b - a, OPEN)
                if held and size + cost > self.split:
                    shares.append(Share(held))
                    held, size = [], 0
                held.append(Piece(name, a, b, a == since, ends and b == upto))
                size += cost
        return shares + ([Share(held)] if held else [])

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        held = []
        for piece in partition.pieces:
            for row in self._lines(piece):
                held.append(row)
                if len(held) == BATCH:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    def _lines(self, piece: Piece) -> Iterator[tuple]:
        """The lines that begin in a piece (the first: at its start; others: behind a newline)."""
        path = f"{self.folder}/{piece.output}"
        with open(path, "rb") as f:
            if piece.first:
                f.seek(piece.start)
            else:
                f.seek(piece.start - 1)
                f.readline()  # the line that began in the piece before
            number = newlines(path, f.tell())
            while f.tell() < piece.end:
                line = f.readline()
                number += 1
                yield piece.output, number, line.removesuffix(b"\n").decode("utf-8", "replace"), False
            if piece.ends:  # a last line without a newline may have begun in the piece before
                f.seek(max(0, piece.end - 1))
                yield piece.output, newlines(path, piece.end) + (f.read(1) not in (b"\n", b"")), None, True


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COLUMNS, strict=True)], schema=COLUMNS)


def output_lines(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """The lines of all outputs in a folder as a stream (see ``SCHEMA``)."""
    spark.dataSource.register(ProcessOutput)
    return spark.readStream.format("process_output").option("suffix", suffix).load(folder)
