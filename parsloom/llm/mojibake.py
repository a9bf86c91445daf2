"""Text decoded with the wrong character encoding (problem 3).

A hidden Markov model labels the characters of a field: one clean state and one state for each encoding pair
(what the bytes were, what they were read as) and script of the text before. A state's emissions are learned from
text of its script sent through its pair, the clean state's from the shape of ordinary words. Viterbi's path alone
decides, whatever a field's length: a field may be damaged from its first character on, a stretch inside it has to
pay for entering and leaving its state. Each labelled span gets its state's inverse transform. A stretch is left
unlabelled only where the sum of all that any state could gain on it is below the cost of entering one.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (name, encodings in the order in which text was written, what those bytes were read as in turn)
PAIRS = [
    ("utf8_as_cp1252", (("utf-8", "cp1252"),)),
    ("utf8_as_latin1", (("utf-8", "latin-1"),)),
    ("utf8_as_cp1252_twice", (("utf-8", "cp1252"), ("utf-8", "cp1252"))),
    ("utf8_as_latin1_twice", (("utf-8", "latin-1"), ("utf-8", "latin-1"))),
    ("utf8_as_cp1256", (("utf-8", "cp1256"),)),
    ("utf8_as_cp1251", (("utf-8", "cp1251"),)),
    ("utf8_as_cp1250", (("utf-8", "cp1250"),)),
    ("utf8_as_cp437", (("utf-8", "cp437"),)),
    ("utf8_as_cp850", (("utf-8", "cp850"),)),
    ("utf8_as_cp866", (("utf-8", "cp866"),)),
    ("utf8_as_koi8r", (("utf-8", "koi8-r"),)),
    ("utf8_as_macroman", (("utf-8", "mac-roman"),)),
    ("cp1256_as_cp1252", (("cp1256", "cp1252"),)),
    ("cp1256_as_cp1251", (("cp1256", "cp1251"),)),
    ("cp1256_as_cp1250", (("cp1256", "cp1250"),)),
    ("cp1256_as_macroman", (("cp1256", "mac-roman"),)),
    ("cp1256_as_cp437", (("cp1256", "cp437"),)),
    ("cp1256_as_koi8r", (("cp1256", "koi8-r"),)),
    ("iso6_as_latin1", (("iso8859-6", "latin-1"),)),
    ("cp1251_as_cp1252", (("cp1251", "cp1252"),)),
    ("koi8r_as_cp1252", (("koi8-r", "cp1252"),)),
    ("lost_as_question_marks", (("ascii", "ascii"),)),  # nothing is left to restore
]
#: The scripts that were written: those of UTF-8 are all three, those of the other encodings the one they are made for.
SCRIPTS = ("arabic", "latin", "cyrillic")


def _written(steps: tuple) -> tuple[str, ...]:
    to = steps[0][0]
    return SCRIPTS if to == "utf-8" else ("cyrillic",) if to in ("cp1251", "koi8-r") else ("arabic",)


#: (pair, script) of each state but the clean one, the last one being the lost letters.
STATES = [(i, script) for script in SCRIPTS for i, (_, steps) in enumerate(PAIRS[:-1]) if script in _written(steps)] + [(len(PAIRS) - 1, "lost")]
#: Persian letters and marks in the order of their frequency, as in any Persian text.
LETTERS = "ایرندهمتوسبشزکگلفجخقپعصحغچطآذضژظئثء"
#: Foreign words of other alphabets, as stand in Persian text.
FOREIGN = ["Москва", "Россия", "Дунай", "Киев", "Волга", "Αθήνα", "Κρήτη", "Λαμία", "Σύρος", "Grün", "Malmö", "Ærø", "Orléans", "Besançon", "Ångström", "Œuvre", "Straße", "Skåne"]
#: Letters of further scripts in the order of their frequency, and what stands among accented Latin ones.
ACCENTED, CYRILLIC = "éèàüöäßñáóíçêôúåøæîûùœâëïãõ’“”–ÉÜÖÄÀ", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэф"
LOST = "�"
#: What the inverse of a span holds that is no ASCII must be text by this share.
LEAST_SHARE = 0.8
#: Characters beside a trace that are labelled too, how many texts are labelled side by side, and how many characters at most (100 MB).
MARGIN, SIDE_BY_SIDE, LONGEST = 40, 64, 300_000
#: The cost of leaving or entering a pair's state, of a field that begins in one, and what is added for question marks, which
#: authors write too, in nats.
STAY, FIELD, ASKED = 14.0, 6.0, 1.5


def _read(text: str, steps: tuple, control: bool = False) -> str:
    """What text becomes when its bytes are read wrongly; what can't be written or read becomes a lost letter or a control character."""
    for to, as_ in steps:
        read = {c: "".join(chr(b) if control and 0x80 <= b < 0xA0 else _char(b, as_) for b in _bytes(c, to)) for c in set(text)}
        text = "".join(map(read.__getitem__, text))
    return text


_KIN = {"ی": "ي", "ک": "ک", **{chr(0x6F0 + i): str(i) for i in range(10)}}


@lru_cache(100_000)
def _bytes(c: str, to: str) -> bytes:
    if to != "utf-8" and c in _KIN and c != "ک":
        c = _KIN[c]
    for x in (c, {"ک": "ك", "پ": "ب", "چ": "ج", "گ": "ك", "ژ": "ز"}.get(c, c)):
        try:
            return x.encode(to)
        except UnicodeEncodeError:
            continue
    return b"?"


@lru_cache(10_000)
def _char(b: int, as_: str) -> str:
    try:
        return bytes([b]).decode(as_)
    except UnicodeDecodeError:
        return chr(b)


@lru_cache(None)
def _back(as_: str) -> dict[str, int]:
    """The byte behind each character of an encoding, undefined ones as control characters."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(256):
        out[_char(b, as_)] = b
    return out


def inverse(span: str, steps: tuple) -> str:
    """The text before it was read wrongly; what is gone for good stays a replacement character."""
    for to, as_ in reversed(steps):
        back = _back(as_)
        raw = bytearray()
        for c in span:
            b = back.get(c)
            if b is None:
                raw += b"\x00" if c == LOST else c.encode("utf-8", "replace") if to == "utf-8" else b"\x00"
            else:
                raw.append(b)
        span = bytes(raw).decode(to, "replace").replace("\x00", LOST)
        if to == "cp1256":  # it has no Persian yeh
            span = span.replace("ي", "ی")
    return span


def _sample() -> str:
    """A text of 40,000 characters with Persian letter frequencies, the same in every process."""
    rng = np.random.default_rng(7)
    weights = 1.0 / (np.arange(len(LETTERS)) + 3.0)
    words = []
    letters = rng.choice(list(LETTERS), size=36_000, p=weights / weights.sum())
    letters = letters[np.append(True, letters[1:] != letters[:-1])]  # doubled letters aren't written twice
    at = 0
    for n in rng.integers(1, 8, size=7_000):
        w = "".join(letters[at : at + n])
        at += n
        u = rng.random()
        if u < 0.1:
            w += "‌" + "".join(letters[at : at + 2])
        elif u < 0.16:
            w += "؛،.:؟!"[int(rng.integers(0, 6))]
        elif u < 0.19:
            w = "«" + w + "»"
        elif u < 0.23:
            w = "".join("۰۱۲۳۴۵۶۷۸۹"[int(i)] for i in rng.integers(0, 10, size=3))
        elif u < 0.24:
            w += "…ًé"[int(rng.integers(0, 3))]
        elif u < 0.27:
            w = FOREIGN[int(rng.integers(0, len(FOREIGN)))]
        words.append(w)
        if at > len(letters) - 20:
            break
    return " ".join(words)


def _other_sample(script: str) -> str:
    """A text of 10,000 characters in Latin letters, a twentieth of them accented, or in Cyrillic ones."""
    rng = np.random.default_rng(11)
    letters = ACCENTED if script == "latin" else CYRILLIC
    weights = 1.0 / (np.arange(len(letters)) + 3.0)
    drawn = iter(rng.choice(list(letters), size=10_000, p=weights / weights.sum()).tolist())
    words: list[str] = []
    for n in rng.integers(1, 9, size=1_700).tolist():
        w = "".join(next(drawn) if script == "cyrillic" or rng.random() < 0.25 else "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(0, 26))] for _ in range(n))
        words.append(w.capitalize() if rng.random() < 0.15 else w)
    return " ".join(words)


class Model:
    """Emissions of every state given the character and the one before it, as tables over classes of characters."""

    def __init__(self) -> None:
        samples = {"arabic": _sample(), **{k: _other_sample(k) for k in SCRIPTS[1:]}}
        # bytes 0x80 to 0x9f come as the encoding has them, or as control characters
        streams = []
        for i, script in STATES[:-1]:
            steps, text = PAIRS[i][1], samples[script]
            streams.append(_read(text, steps) + (_read(text[:15_000], steps, True) if steps[-1][1].startswith("cp125") else ""))
        text = samples["arabic"]
        streams.append(re.sub(r"[^\x00-\x7f]", "?", text) + re.sub(r"[^\x00-\x7f]", LOST, text))
        chars = sorted({c for c in set().union(*streams) if ord(c) >= 0x80} | {LOST})
        self.alone = [c for c in chars if not ("؀" <= c <= "ۿ" or c in "«»،؛؟…–‌")]
        #: The characters that some pair leaves behind; without any of them nothing is damaged.
        self.trace = re.compile("[" + "".join(map(re.escape, self.alone)) + "\x80-\x9f]|(?:^|\\s)\\?\\?+\\s+\\?\\?|^[^\\w?]*\\?\\?[^\\w]*$")
        self.odd = re.compile("[" + "".join(map(re.escape, self.alone)) + "\x80-\x9f?]")
        ids = {c: i for i, c in enumerate(chars)}
        self.n = n = len(chars) + 4  # + the question mark, ASCII letters, other ASCII, all else
        self.mark = n - 4
        self.index = np.full(0x10000, n - 1, dtype=np.int32)
        self.index[:128] = n - 2
        for o in [*range(65, 91), *range(97, 123)]:
            self.index[o] = n - 3
        self.index[ord("?")] = n - 4
        for c, i in ids.items():
            self.index[ord(c)] = i
        tables = [self._clean(chars)]
        for (_, script), s in zip(STATES, streams):
            k = self.index[np.frombuffer(s.encode("utf-16-le"), dtype=np.uint16)]
            uni = np.bincount(k, minlength=n).astype(float)
            uni[ids[LOST]] += 0.01 * len(k)
            uni[n - 3] += 0.03 * len(k)  # words in Latin letters
            uni /= uni.sum()
            uni = 0.9995 * uni + 0.0005 / n
            two = np.zeros((n, n))
            np.add.at(two, (k[:-1], k[1:]), 1.0)
            strength = 3.0
            table = np.log((two + strength * uni[None, :]) / (two.sum(1, keepdims=True) + strength))
            if script == "latin":  # its plain letters and blanks are those of clean text and say nothing
                table[:, [n - 3, n - 2]] = tables[0][:, [n - 3, n - 2]]
            tables.append(table)
        self.tables = np.ascontiguousarray(np.stack(tables, axis=-1).astype(np.float32))  # character before, character, state
        #: What the best state gains on a character over the clean one, at most.
        self.gain = np.maximum(self.tables[:, :, 1:].max(-1) - self.tables[:, :, 0], 0)

    def _clean(self, chars: list[str]) -> np.ndarray:
        """The clean state: ordinary words of one alphabet, small letters after small ones, few symbols."""
        kinds = []
        for c in chars:
            o, cat = ord(c), ud.category(c)
            if 0x600 <= o <= 0x6FF or c in "«»،؛؟…–‌":
                kinds.append("arabic")
            elif cat[0] == "L" and o < 0x250:
                kinds.append("Latin" if cat == "Lu" else "latin")
            elif cat[0] == "L" and 0x370 <= o < 0x400:
                kinds.append("Greek" if cat == "Lu" else "greek")
            elif cat[0] == "L" and 0x400 <= o < 0x530:
                kinds.append("Cyr" if cat == "Lu" else "cyr")
            elif o < 0xA0:
                kinds.append("control")
            else:
                kinds.append("symbol")
        kinds += ["ascii", "plain", "ascii", "else"]
        first = {"arabic": 1 / 60, "Latin": 1 / 900, "latin": 1 / 1500, "Greek": 1 / 600, "greek": 1 / 3000, "Cyr": 1 / 600, "cyr": 1 / 9000, "control": 1e-6, "symbol": 1 / 5000, "ascii": 0.2, "plain": 0.2, "else": 1 / 60}
        after = {
            ("plain", "latin"): 1 / 60, ("Latin", "latin"): 1 / 1500, ("latin", "latin"): 1 / 1500, ("Latin", "Latin"): 1 / 3000, ("latin", "Latin"): 1e-5, ("plain", "Latin"): 1e-5,
            ("Greek", "greek"): 1 / 28, ("greek", "greek"): 1 / 28, ("Greek", "Greek"): 1 / 2000, ("greek", "Greek"): 1e-5,
            ("Cyr", "cyr"): 1 / 33, ("cyr", "cyr"): 1 / 33, ("Cyr", "Cyr"): 1 / 1000, ("cyr", "Cyr"): 1e-5,
            ("arabic", "Latin"): 1e-5, ("arabic", "latin"): 1e-5, ("arabic", "symbol"): 1 / 20000, ("arabic", "arabic"): 1 / 40,
        }
        out = np.empty((self.n, self.n))
        for i, a in enumerate(kinds):
            for j, b in enumerate(kinds):
                out[i, j] = after.get((a, b), first[b])
        share = 1.0 / (np.arange(len(CYRILLIC)) + 3.0)
        for c, p in zip(CYRILLIC, (share / share.sum()).tolist()):
            if c in chars:
                out[:, chars.index(c)] *= 33 * p
        ascii_letters = self.n - 3
        out[:, ascii_letters] = 0.2
        out[:, self.mark] = 1 / 200
        out[self.mark, self.mark] = 0.3
        return np.log(out)

    def windows(self, text: str) -> list[tuple[int, int]]:
        """The stretches around characters that a pair may have left; elsewhere every path is clean.

        A stretch on which no path can gain what the entering of a state costs is left out: the clean path is its best."""
        if not self.trace.search(text):
            return []
        out: list[list[int]] = []
        for m in self.odd.finditer(text):
            i = m.start()
            if out and i - out[-1][1] <= 2 * MARGIN:
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1])
        found = []
        for a, b in out:
            a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
            before, k = self.codes(text[a:b])
            if self.gain[before, k].sum() <= (STAY if a else FIELD):
                continue
            while b - a > LONGEST:  # cut at a blank, which no pair tears apart
                cut = text.rfind(" ", a + LONGEST // 2, a + LONGEST) + 1 or a + LONGEST
                found.append((a, cut))
                a = cut
            found.append((a, b))
        return found

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The classes of the characters before and of the characters of a text."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        k = self.index[np.minimum(codes, 0xFFFF)]
        before = np.empty_like(k)
        before[:1], before[1:] = self.n - 2, k[:-1]
        return before, k

    def labels(self, texts: list[str], begin: list[bool]) -> list[np.ndarray]:
        """The state of each character on the most likely path (Viterbi; leaving a state costs the same for all), side by side for texts of like length.

        begin tells which texts are the beginning of a field, not a stretch inside it."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            group = order[at : at + SIDE_BY_SIDE]
            while len(group) > 1 and len(group) * len(texts[group[-1]]) > LONGEST:
                group = group[: len(group) // 2]
            at += len(group)
            longest, rows = len(texts[group[-1]]), len(group)
            scores = np.zeros((longest, rows, self.tables.shape[2]), dtype=np.float32)  # padding says nothing
            for r, i in enumerate(group):
                before, k = self.codes(texts[i])
                scores[: len(k), r] = self.tables[before, k]
            own = np.arange(scores.shape[2], dtype=np.int8)[None, :]
            each = np.arange(rows)
            best = scores[0].copy()
            best[:, 1:] -= np.array([FIELD if begin[i] else STAY for i in group], dtype=np.float32)[:, None]
            best[:, -1] -= ASKED
            came = np.empty(scores.shape, dtype=np.int8)
            for t in range(1, longest):
                top = best.argmax(1)
                jump = (best[each, top] - STAY)[:, None]
                stay = best >= jump
                came[t] = np.where(stay, own, top[:, None])
                best = np.maximum(best, jump)
                best += scores[t]
            state = best.argmax(1)
            path = np.empty((longest, rows), dtype=np.int8)
            for t in range(longest - 1, 0, -1):
                path[t] = state
                state = came[t, each, state]
            path[0] = state
            for r, i in enumerate(group):
                out[i] = path[: len(texts[i]), r]
        return out


@lru_cache(None)
def model() -> Model:
    return Model()


_LETTERS = {"arabic": re.compile("[ء-غف-يپچژکگیٱ-ۓ]"), "latin": re.compile("[À-ÖØ-öø-ɏ’“”–‘€«»°]"), "cyrillic": re.compile("[Ѐ-ԯ]")}
_ODD = re.compile("[^\x00-\x7f]")
_MARKS = re.compile(r"(?:(?<=\s)|(?<=^))[«(]?[?�]+[.:!»)]*(?=\s|$)")
_FINE = re.compile("[؀-ۿ‌«»…–—²°‍‎‏﻿À-ɏͰ-ԯ’“”‘€�]")


def _judged(text: str, offset: int, lab: np.ndarray) -> list[tuple[int, int, str, str]]:
    """The labelled stretches of a window whose inverse transform gives text."""
    cuts = np.flatnonzero(np.diff(lab)) + 1
    runs: list[list[int]] = []  # start, end, pair; states of one pair side by side are one stretch
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lab)]):
        s = int(lab[a])
        a, b = a + offset, b + offset
        pair = STATES[s - 1][0] if s else -1
        if s and 2 * text.count("?", a, b) > sum(not c.isspace() for c in text[a:b]):
            pair = len(PAIRS) - 1  # letters lost on the way into an encoding
        if runs and runs[-1][2] == pair:
            runs[-1][1] = b
        else:
            runs.append([a, b, pair])
    out = []
    for a, b, pair in runs:
        if pair < 0:
            continue
        name, steps = PAIRS[pair]
        span = text[a:b]
        if pair == len(PAIRS) - 1:
            if len(_MARKS.findall(span)) >= 2 or span.strip() == text.strip():
                out.append((a, b, name, span))
            continue
        plain = inverse(span, steps)
        letters, odd = sum(len(_LETTERS[x].findall(plain)) for x in _written(steps)), _ODD.findall(plain)
        if letters and plain != span and len(_FINE.findall("".join(odd))) >= LEAST_SHARE * len(odd) and letters >= 0.6 * len(odd):
            out.append((a, b, name, plain))
    return out


def all_spans(texts: list[str | None]) -> list[list[tuple[int, int, str, str]]]:
    """For each text (start, end, pair, restored) of each damaged span; [] for null, blank and clean text."""
    m = model()
    out: list[list[tuple[int, int, str, str]]] = [[] for _ in texts]
    places, pieces = [], []
    for i, t in enumerate(texts):
        if t:
            for a, b in m.windows(t):
                places.append((i, a))
                pieces.append(t[a:b])
    for (i, a), lab in zip(places, m.labels(pieces, [a == 0 for _, a in places])):
        out[i] += _judged(texts[i], a, lab)
    return out


def spans(text: str | None) -> list[tuple[int, int, str, str]]:
    return all_spans([text])[0]


def damaged(text: str | None) -> bool:
    return bool(spans(text))


def put_back(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for a, b, _, plain in found:
        out += (text[at:a], plain)
        at = b
    return "".join(out) + text[at:]


def restored(text: str | None) -> str | None:
    """The text with its damaged spans put back; null for null."""
    return text and put_back(text, spans(text))


def is_damaged(text):
    """Whether a text column's value holds a damaged span; false for null. Characters are labelled in Python, batch by batch."""
    @F.pandas_udf("boolean")
    def flag(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(found) for found in all_spans(texts.tolist())], dtype=bool)

    return flag(text)


def damaged_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df whose text holds a damaged span. Null, empty and blank texts are never damaged."""
    return df.where(is_damaged(F.col(f"`{text}`")))


def repair(df: DataFrame, text: str = "text") -> DataFrame:
    """df with restored (the text with its damaged spans put back) and pairs (the encoding pairs found, null where none).

    Null stays null. Raises ValueError where df has a column restored or pairs already."""
    taken = {"restored", "pairs", "_repair"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")

    @F.pandas_udf("restored string, pairs array<string>")
    def back(texts: pd.Series) -> pd.DataFrame:
        texts = texts.tolist()
        rows = [(s and put_back(s, found), sorted({n for _, _, n, _ in found}) or None) for s, found in zip(texts, all_spans(texts))]
        return pd.DataFrame(rows, columns=["restored", "pairs"])

    # else a filter on a result would run the labelling a second time
    back = back.asNondeterministic()
    return df.withColumn("_repair", back(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in df.columns], "_repair.*")
