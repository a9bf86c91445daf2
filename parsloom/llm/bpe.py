"""A public byte-level BPE tokenizer as a streaming transducer (problem 6).

Text comes in chunks and is cut into pre-tokens. What a pre-token is depends on its own characters, on the one behind it
and, for the contractions, on the three from its beginning on; so a pre-token is stable once all these have been seen, and
the few that aren't are held back. A run that outgrows what is held is handed on while it is still going on.

Inside a pre-token the encoding of every prefix ends in exactly one token, and a token may follow another only if the two,
written together, are encoded as just these two. So the last tokens of all prefixes are found from left to right. A token
that still can change begins at most one longest token before the end: the longest token is the merge list's sufficient
lookahead, and what all those prefixes have in common is stable and emitted. Memory is bounded by the lookahead and the
chunk, however long the text or a pre-token is. Every pre-token takes this way; encodings of short ones are remembered, in
a bounded memory. Decoding feeds the tokens' bytes to an incremental decoder, which holds back an unfinished character.
"""

from __future__ import annotations

import base64
import codecs
import importlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of at most so many characters are remembered, and so many of them.
SHORT, REMEMBERED = 64, 400_000
#: Characters that are fed at once, and those of an unfinished pre-token from which on it is handed on.
CHUNK, HELD = 65_536, 256
#: Ids that are decoded at once.
IDS = 4_096
#: Characters from a pre-token's beginning on that the pattern looks at beside its run: those of the contractions 're, 've, 'll.
CONTRACTION = 3
#: The runs of characters the pattern's pre-tokens are made of, apart from contractions and a leading blank.
RUNS = r"\p{L}+|\p{N}+|\s+|[^\s\p{L}\p{N}]+"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary lies; the file is never copied."""
    return str(importlib.import_module("public_tokenizers").path(name))


class Transducer:
    """Encodes and decodes with one vocabulary of ranked byte strings."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.runs = regex.compile(RUNS)
        #: How far behind the end of the input a token may begin that later input can still change, in bytes.
        self.lookahead = max(map(len, self.ranks))
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.memo = _Memo(self)

    def merge(self, word: bytes) -> list[bytes]:
        """The plain merges of a short byte string, lowest rank first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            a, b = parts[at], parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens stand side by side in an encoding."""
        got = self.follows.get((a, b))
        if got is None:
            got = self.merge(a + b) == [a, b]
            if len(self.follows) > REMEMBERED:
                self.follows.clear()
            self.follows[a, b] = got
        return got

    def word(self, text: str) -> bytes:
        """The ids of one pre-token, four bytes each."""
        state = Word(self)
        return array("i", [*state.feed(text.encode("utf-8", "replace")), *state.finish()]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, four bytes each; nothing for an empty and for a null text."""
        if not text:
            return b""
        state = Encoder(self)
        return b"".join([*(state.feed(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)), state.finish()])

    def encode_stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """The ids of a text that comes in chunks, each as soon as it is stable."""
        state = Encoder(self)
        for chunk in chunks:
            yield from array("i", state.feed(chunk))
        yield from array("i", state.finish())

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of ids, each character as soon as its bytes are complete; bytes of no character become a replacement character."""
        state, ids = codecs.getincrementaldecoder("utf-8")("replace"), iter(ids)
        while some := list(islice(ids, IDS)):
            yield state.decode(b"".join(map(self.tokens.__getitem__, some)))
        yield state.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


class Encoder:
    """One text on its way through the transducer: what is held back, and the pre-token that is going on."""

    def __init__(self, of: Transducer) -> None:
        self.of, self.held, self.going, self.run = of, "", None, ""

    def feed(self, chunk: str) -> bytes:
        """Takes the next characters; gives the ids that have become stable, four bytes each."""
        out = []
        if self.going is not None:
            chunk = self._go_on(chunk, out)
        if chunk:
            self._cut(self.held + chunk, out)
        return b"".join(out)

    def finish(self) -> bytes:
        out = []
        if self.going is not None:
            self._close(self.held, out)
        elif self.held:
            out += map(self.of.memo.__getitem__, self.of.pattern.findall(self.held))
        self.held = ""
        return b"".join(out)

    def _cut(self, text: str, out: list[bytes]) -> None:
        words = self.of.pattern.findall(text)
        size, at, stable = len(text), len(text), len(words)
        while stable:  # from the end back to the last word that nothing can change any more
            end, begin = at, at - len(words[stable - 1])
            if end < size and begin + CONTRACTION <= size:
                break
            at, stable = begin, stable - 1
        if len(self.of.memo) > REMEMBERED:
            self.of.memo.clear()
        out += map(self.of.memo.__getitem__, words[:stable])
        self.held = text[at:]
        if len(words) - stable == 1 and len(self.held) > HELD:
            self.going, run = Word(self.of), self.held
            self.run = "space" if run[-1].isspace() else self.of.runs.match(run, len(run) - 1)[0]
            self.held = run[-1] if self.run == "space" else ""
            out.append(self._fed(run[:-1] if self.held else run))

    def _go_on(self, chunk: str, out: list[bytes]) -> str:
        """Feeds what belongs to the pre-token that is going on; gives what comes after it, "" while it may still go on.

        The last blank of a run belongs to what follows it, if that is no blank: it is held back."""
        found = self.of.runs.match(chunk)
        same = found and (chunk[0].isspace() if self.run == "space" else self.of.runs.fullmatch(self.run + chunk[0]) is not None)
        size = found.end() if same else 0
        if size == len(chunk):
            mine = self.held + chunk
            self.held = mine[-1] if self.run == "space" else ""
            out.append(self._fed(mine[:-1] if self.held else mine))
            return ""
        mine = self.held + chunk[:size]
        rest = mine[-1:] if self.run == "space" else ""
        self._close(mine[: len(mine) - len(rest)], out)
        self.held = ""
        return rest + chunk[size:]

    def _fed(self, text: str) -> bytes:
        return array("i", self.going.feed(text.encode("utf-8", "replace"))).tobytes()

    def _close(self, text: str, out: list[bytes]) -> None:
        out.append(self._fed(text))
        out.append(array("i", self.going.finish()).tobytes())
        self.going = None


class Word:
    """One pre-token on its way through the transducer."""

    def __init__(self, of: Transducer) -> None:
        self.of, self.text, self.before = of, b"", None
        self.last: list[bytes] = []  # the last token of each prefix of text

    def feed(self, piece: bytes) -> Iterator[int]:
        """Takes the next bytes; gives the ids that have become stable."""
        look = self.of.lookahead
        for at in range(0, len(piece), look):
            self.text += piece[at : at + look]
            self._extend()
            if len(self.text) >= 2 * look:
                yield from self._emit(self._common())

    def finish(self) -> Iterator[int]:
        yield from self._emit(len(self.text))

    def _extend(self) -> None:
        of, text, last = self.of, self.text, self.last
        for end in range(len(last) + 1, len(text) + 1):
            for size in range(min(of.lookahead, end), 0, -1):
                t = text[end - size : end]
                if t in of.ranks:
                    left = last[end - size - 1] if end > size else self.before
                    if left is None or of.may_follow(left, t):
                        last.append(t)
                        break
            else:
                raise ValueError("no token fits: the vocabulary isn't a merge list with all single bytes")

    def _common(self) -> int:
        """The furthest boundary through which all prefixes pass that later bytes can build on."""
        n = len(self.text)
        at = set(range(n - self.of.lookahead + 1, n + 1))
        while len(at) > 1:
            p = max(at)
            at.remove(p)
            at.add(p - len(self.last[p - 1]))
        return at.pop()

    def _emit(self, cut: int) -> Iterator[int]:
        if not cut:
            return
        tokens, p = [], cut
        while p > 0:
            tokens.append(self.last[p - 1])
            p -= len(self.last[p - 1])
        yield from (self.of.ranks[t] for t in reversed(tokens))
        self.before, self.text, self.last = tokens[0], self.text[cut:], self.last[cut:]


class _Memo(dict):
    def __init__(self, of: Transducer) -> None:
        self.of = of

    def __missing__(self, text: str) -> bytes:
        ids = self.of.word(text)
        if len(text) <= SHORT:
            self[text] = ids
        return ids


@lru_cache(4)
def transducer(path: str, pattern: str) -> Transducer:
    return Transducer(path, pattern)


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids) for every row of df: the ids of the whole text without special tokens, whose strings are ordinary text.

    Null and empty texts have the empty list; repeated rows come out as often as they go in, null keys included. path and
    pattern name another vocabulary of ranked byte strings, by default byte_bpe_50k. Nothing is shuffled."""
    path = path or vocabulary_path()
    pattern = pattern or importlib.import_module("public_tokenizers").PATTERN

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path, pattern)
        for b in batches:
            parts = [t.encode(s) for s in b.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            values = np.frombuffer(b"".join(parts), dtype=np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(encode, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def decode_column(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with the text of its ids: "" for the empty list, null for null."""
    if into.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column {into} exists already")
    path = path or vocabulary_path()
    pattern = pattern or importlib.import_module("public_tokenizers").PATTERN

    @F.pandas_udf("string")
    def decode(lists):
        import pandas as pd

        t = transducer(path, pattern)
        return pd.Series([None if x is None else t.decode(x.tolist()) for x in lists], dtype=object)

    return df.withColumn(into, decode(F.col(f"`{ids}`")))
