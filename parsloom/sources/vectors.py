"""Loaders of word vectors: text and binary files of word vectors, binary subword models."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsloom.functions.vectors import unit
from parsloom.operators.embeddings import normalized
from parsloom.operators.tables import written
from parsloom.sources import text

SCHEMA = "ix bigint, word string, vec array<float>"


def read_text_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(ix, word, vec) of `word f1 .. fd` lines after a header `n d`. Rows of fewer numbers are skipped, what is no number is
    dropped, more numbers are cut off; vectors have length one; of a repeated word the last line counts. A file splits over tasks."""
    rows = text.numbered_lines(spark, path)
    d = int(rows.where("line_no = 0").select(F.split(F.trim("line"), r"\s+")[1]).head()[0])
    parts = rows.where("line_no > 0").select("line_no", F.split(F.regexp_replace("line", r"\s+\z", ""), " ").alias("p"))
    numbers = F.filter(F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x.try_cast("float")), lambda x: x.isNotNull())
    made = parts.select((F.col("line_no") - 1).cast("bigint").alias("ix"), F.col("p")[0].alias("word"), F.slice(numbers, 1, d).alias("vec")).where(F.size("vec") == d)
    return normalized(made)


#: Records, or rows of a matrix, that are read at once; characters of a word and bytes of a head that are looked at first.
PIECE, WORD, BLOCK = 5_000, 4_096, 1 << 23


class _File:
    """Ranged reads of a file by its path or address, on whatever machine."""

    def __init__(self, path: str) -> None:
        system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))
        self.file, self.size = system.open_input_file(at), system.get_file_info(at).size
        self.at, self.held = 0, b""

    def read(self, at: int, size: int) -> bytes:
        """size bytes from at on, fewer at the end; read ahead in blocks."""
        if at < self.at or at + size > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(size, BLOCK), at)
        return self.held[at - self.at : at - self.at + size]

    def until(self, end: bytes, at: int, most: int) -> bytes:
        """What stands before the first end from at on; ValueError where there is none within most bytes."""
        size = 64
        while True:
            got = self.read(at, size)
            if end in got:
                return got[: got.index(end)]
            if size >= most or len(got) < size:
                raise ValueError("the file ends within a record")
            size *= 4


def _paths(spark: SparkSession, path: str) -> list[str]:
    """The files at a path, as addresses."""
    return [unquote(p) if p.startswith("file:") else p for p in spark.read.format("binaryFile").load(path).inputFiles()]


def _spread(spark: SparkSession, pieces: DataFrame, read, schema: str) -> DataFrame:
    """The rows of all pieces, dealt out to a task for each piece, or 2,000."""
    pieces = written(pieces)
    return pieces.repartition(max(1, min(pieces.count(), 2_000))).mapInPandas(read, schema)


def read_binary_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(ix, word, vec) of the binary format: header `n d`, then each word, a blank and d little-endian floats.

    One task for each file finds where every PIECE records begin, holding a block of the file; the pieces are then read by ranges,
    each where it falls. Files may be of any size. Raises ValueError where a file ends within a vector."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                f = _File(p)
                head = f.until(b"\n", 0, WORD)
                n, d = map(int, head.split()[:2])
                at, starts = len(head) + 1, []
                for i in range(n):
                    if i % PIECE == 0:
                        starts.append((p, i, min(PIECE, n - i), d, at))
                    at = _next_word(f, at)[1] + 4 * d
                    if at > f.size:
                        raise ValueError("the file ends within a vector")
                yield pd.DataFrame(starts, columns=["path", "first", "n", "d", "at"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, first, n, d, at in b.itertuples(index=False):
                f, rows = _File(p), []
                for i in range(first, first + n):
                    word, at = _next_word(f, at)
                    rows.append((i, word.decode("utf-8", "replace"), np.frombuffer(f.read(at, 4 * d), dtype="<f4")))
                    at += 4 * d
                yield pd.DataFrame(rows, columns=["ix", "word", "vec"])

    files = spark.createDataFrame([(p,) for p in _paths(spark, path)], "path string")
    pieces = files.repartition(max(1, files.count())).mapInPandas(index, "path string, first bigint, n int, d int, at bigint")
    return normalized(_spread(spark, pieces, read, SCHEMA))


def _next_word(f: _File, at: int) -> tuple[bytes, int]:
    """The word at a place, without line ends before it, and where its vector begins."""
    while f.read(at, 1) == b"\n":
        at += 1
    word = f.until(b" ", at, WORD)
    return word, at + len(word) + 1


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """By the file's name: .bin is binary, else text."""
    return read_binary_vectors(spark, path) if path.endswith(".bin") else read_text_vectors(spark, path)


#: The mark and the version of subword model files, and the size of their block of arguments.
MAGIC, VERSION, ARGS = 793712314, 12, 72


@dataclass(frozen=True)
class SubwordModel:
    """vectors (ix, word, vec) as they stand in the file, buckets (bucket, vec) and what the subwords are."""

    vectors: DataFrame
    buckets: DataFrame
    dim: int
    minn: int
    maxn: int
    bucket: int


def _header(raw: bytes) -> tuple[int, int, int, int]:
    magic, version = struct.unpack_from("<II", raw, 0)
    if magic != MAGIC:
        raise ValueError(f"no subword model: it begins with {magic:#010x}")
    if version != VERSION:
        raise ValueError(f"subword model of version {version}, not {VERSION}")
    return tuple(struct.unpack_from("<i", raw, 8 + at)[0] for at in (12, 48, 52, 56))


def _dictionary(f: _File, d: int) -> tuple[list[tuple[int, str]], int, int, int]:
    """(words by index, number of words, rows of the matrix, where it begins)."""
    at = 8 + ARGS
    size, nwords, _, _, pruned = struct.unpack("<iiiqq", f.read(at, 28))
    at += 28
    words = []
    for i in range(size):
        word = f.until(b"\0", at, WORD)
        if f.read(at + len(word) + 9, 1) == b"\0":
            words.append((i, word.decode("utf-8", "replace")))
        at += len(word) + 10
    at += 8 * max(0, pruned)
    if f.read(at, 1) != b"\0":
        raise ValueError("quantized subword models can't be read")
    rows, columns = struct.unpack("<qq", f.read(at + 1, 16))
    if columns != d:
        raise ValueError(f"the matrix has {columns} columns, not {d}")
    if at + 17 + 4 * rows * d > f.size:
        raise ValueError("the file ends within its matrix")
    return words, nwords, rows, at + 17


def read_subword_model(spark: SparkSession, path: str) -> SubwordModel:
    """A binary subword model. Only its head comes to the driver; one task reads its dictionary, the rows of the matrix are read by
    ranges, PIECE at a time, where they fall. The file may be of any size."""
    files = _paths(spark, path)
    head = spark.createDataFrame([(files[0],)], "path string").mapInPandas(lambda batches: (pd.DataFrame({"h": [_File(p).read(0, 8 + ARGS) for p in b["path"]]}) for b in batches), "h binary").head()[0]
    d, bucket, minn, maxn = _header(bytes(head))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                words, n, rows, at = _dictionary(_File(p), d)
                for lo in range(0, len(words), PIECE):
                    part = words[lo : lo + PIECE]
                    yield pd.DataFrame({"path": [p], "at": [at], "rows": [[i for i, _ in part]], "words": [[w for _, w in part]], "less": [0]})
                for lo in range(n, rows, PIECE):
                    yield pd.DataFrame({"path": [p], "at": [at], "rows": [list(range(lo, min(lo + PIECE, rows)))], "words": [None], "less": [n]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, at, rows, words, less in b.itertuples(index=False):
                low, high = int(rows[0]), int(rows[-1]) + 1
                m = np.frombuffer(_File(p).file.read_at(4 * d * (high - low), at + 4 * d * low), dtype="<f4").reshape(-1, d)
                yield pd.DataFrame({"ix": [int(i) - less for i in rows], "word": [None] * len(rows) if words is None else list(words), "vec": [m[int(i) - low] for i in rows]})

    pieces = written(spark.createDataFrame([(p,) for p in files], "path string").mapInPandas(index, "path string, at bigint, rows array<bigint>, words array<string>, less bigint"))
    vectors = _spread(spark, pieces.where("words is not null"), read, SCHEMA)
    buckets = _spread(spark, pieces.where("words is null"), read, SCHEMA).select(F.col("ix").cast("int").alias("bucket"), "vec")
    return SubwordModel(vectors, buckets, d, minn, maxn, bucket)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vec", unit(F.col("vec")))
