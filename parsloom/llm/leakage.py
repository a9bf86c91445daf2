"""Evaluation passages inside training documents (problem 7).

A document holds a window of an item's consecutive words only if it holds the window's rarest shingle. Documents are
first bounded by length: only runs of as many words as a window, all of them words of some item, can hold one. The
runs' shingles are counted, each window's rarest shingle is its prefix, prefixes and shingles are joined, the window
must fit into the run where the shingle's place puts it, and the words are compared one by one.

Words are known by a 64-bit hash. Windows are a distributed table, each different one once, whatever number of items
have it; the items are joined to what was found. Which words and shingles the items have travels to the documents as
two bit tables of a fixed size; a bit that several share only lets more through to the joins. So the documents are
read once, whatever number of items there are.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsloom.llm.common import written

WINDOW, SHINGLE = 13, 3
#: Bits of the tables of words and shingles (2 MB each), and tasks that make them.
BITS, TASKS = 1 << 24, 16
#: Words whose hashes a task remembers.
REMEMBERED = 500_000


class _Dress(dict):
    """Code point to what it counts as: a small letter or ASCII digit, nothing (a mark), or a blank."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        kind = ud.category(c)
        if kind[0] == "M":
            out = ""
        elif kind == "Nd":
            out = str(ud.decimal(c))
        elif kind[0] == "L":
            plain = "".join(x for x in ud.normalize("NFD", c) if ud.category(x)[0] != "M")
            out = {"ي": "ی", "ى": "ی", "ك": "ک"}.get(plain, plain).casefold()
        elif kind[0] == "N":
            out = c
        else:
            out = " "
        self[o] = out
        return out


_DRESS = _Dress()


def words_of(text: str | None) -> list[str]:
    """The words of a text: unbroken runs of letters and digits without marks, in one case, one digit script, one yeh and kaf."""
    return text.translate(_DRESS).split() if text else []


class _Hashes(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _hashed(text: str | None, hashes: _Hashes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each size consecutive values."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = (out ^ h[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (bits - 1)


def _windows(items: DataFrame) -> DataFrame:
    """(item_id, window, words, shingles) of every window of every item, window being a hash of its words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = _hashed(t, hashes)
                n, k = len(h) - WINDOW + 1, WINDOW - SHINGLE + 1
                if n <= 0:
                    continue
                view = np.lib.stride_tricks.sliding_window_view
                words, shingles = view(h, WINDOW).reshape(-1).view(np.int64), view(_mixed(h, SHINGLE), k).reshape(-1).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(x)) for size, x in ((WINDOW, words), (k, shingles))]
                yield pa.record_batch([pa.array(np.full(n, item, dtype=np.int64)), pa.array(_mixed(h, WINDOW).view(np.int64)), *lists], ["item_id", "window", "words", "shingles"])

    return items.mapInArrow(cut, "item_id bigint, window bigint, words array<bigint>, shingles array<bigint>")


def _bits(windows: DataFrame, column: str) -> np.ndarray:
    """The bit table of an array column's values: made by at most TASKS tasks, so that the driver gets a fixed size."""

    bits = BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, dtype=bool)
        for b in batches:
            table[_bit(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), bits)] = True
        yield pa.record_batch([pa.array([np.packbits(table).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in windows.select(column).coalesce(TASKS).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _found(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _bit(h, 8 * len(table))
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _runs(docs: DataFrame, words: np.ndarray, shingles: np.ndarray) -> DataFrame:
    """(doc_id, run, words, at, shingles): the runs of at least WINDOW words that may all be words of items, and where which of their
    shingles may be items' shingles."""
    shared = docs.sparkSession.sparkContext.broadcast((words, shingles))
    integers = pa.list_(pa.int64())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, of_shingles = shared.value
        hashes = _Hashes()
        for b in batches:
            ids, runs, kept, places, found = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if d is None or not t or len(t) < 2 * WINDOW - 1:
                    continue
                h = _hashed(t, hashes)
                if len(h) < WINDOW:
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], _found(of_words, h).view(np.int8), [0]))))
                for a, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if e - a >= WINDOW:
                        s = _mixed(h[a:e], SHINGLE)
                        at = np.flatnonzero(_found(of_shingles, s))
                        # a window is a row of shingles of which none is missing
                        if len(at) >= WINDOW - SHINGLE + 1:
                            ids.append(d), runs.append(a), kept.append(h[a:e].view(np.int64)), places.append(at), found.append(s[at].view(np.int64))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(runs, pa.int32()), *(pa.array(x, integers) for x in (kept, places, found))], ["doc_id", "run", "words", "at", "shingles"])

    return docs.mapInArrow(find, "doc_id bigint, run int, words array<bigint>, at array<bigint>, shingles array<bigint>")


def leaked_windows(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, word_no) of every window of WINDOW consecutive words of an item that a document holds, word_no being
    the document's word with which it begins.

    Null and empty texts hold nothing, items of fewer words than a window are in nothing, null ids are left out. Documents are
    read once; a window that many items have is looked for once, and a shingle of very many runs is split by adaptive execution."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    items = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("item_id is not null and text is not null").distinct()
    windows = written(_windows(items))
    different = windows.groupBy("window", "words").agg(F.first("shingles").alias("shingles"))
    runs = written(_runs(docs, _bits(windows, "words"), _bits(windows, "shingles")))

    found = runs.select("doc_id", "run", F.explode(F.arrays_zip("at", "shingles")).alias("z")).select("doc_id", "run", "z.at", F.col("z.shingles").alias("shingle"))
    rarity = found.groupBy("shingle").agg(F.count("*").alias("n"))
    # a window is there only if all its shingles are; its rarest one is a sufficient prefix
    ordered = different.select("window", "words", F.posexplode("shingles").alias("offset", "shingle"))
    prefixes = ordered.join(rarity, "shingle", "left").groupBy("window", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("rarest")).where(F.col("rarest.n") > 0)
    prefixes = prefixes.select("window", F.col("words").alias("wanted"), F.col("rarest.offset").alias("offset"), F.col("rarest.shingle").alias("shingle"))
    candidates = found.join(prefixes, "shingle").withColumn("start", (F.col("at") - F.col("offset")).cast("int")).where("start >= 0").select("doc_id", "run", "start", "window", "wanted")
    held = (
        candidates.join(runs.select("doc_id", "run", "words"), ["doc_id", "run"])
        .where(F.col("start") + WINDOW <= F.size("words"))
        .where(F.slice("words", F.col("start") + 1, WINDOW) == F.col("wanted"))
        .select("doc_id", (F.col("run") + F.col("start")).alias("word_no"), "window", F.col("wanted").alias("words"))
    )
    return held.join(windows.select("window", "words", "item_id").distinct(), ["window", "words"]).select("doc_id", "item_id", "word_no")


def leaks(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, item_id), once for each document that holds a window of the item."""
    return leaked_windows(docs, items, **columns).select("doc_id", "item_id").distinct()


def leak_report(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, items, windows): of each document with a leak, how many items and windows of items it holds."""
    return leaked_windows(docs, items, **columns).distinct().groupBy("doc_id").agg(F.countDistinct("item_id").alias("items"), F.count("*").alias("windows"))
