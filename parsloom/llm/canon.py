"""One consistent form for text that looks the same (problem 5).

Look-alikes are strings as well as single code points: a letter and its mark beside the joined letter, a
positional shape beside the letter, a wide letter beside the narrow one. Pairs of look-alikes come from rules
over the character database; union-find closes them into classes. Where the definition names a class's
representative (in Persian records the Persian letter, the joined letter, the plain blank) it is that one, however
the corpus writes; a multi-pattern automaton rewrites every other member to it, always taking the longest match.
Letters of several alphabets that look alike are classes too, with a member for each alphabet: a word is written with
the members of one alphabet, that of most of its letters, and where these are equal the one that the corpus writes
most. Width in Chinese and Japanese and the zero-width non-joiner depend on their surroundings and are settled beside it.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZWNJ = "‌"
#: Arabic-script characters that look like a Persian one, by that Persian one.
PERSIAN_KIN = {"ی": "يىېۍ", "ک": "كڪ", "ه": "ہھەۀ"[:3], "ۀ": "ۂ", "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩"}
#: Letters of other alphabets that look like a Latin one.
LATIN_KIN = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "іι", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υ", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
    "ï": "ї", "ë": "ё", "Ë": "Ё", "Ï": "Ї", "è": "ѐ", "ó": "ό", "k": "κ", "t": "τ", "n": "η",
}
#: Format characters that show: they are no invisible characters.
SHOWING = set("؀؁؂؃؄؅۝܏࣢")
BLANK_MEMBER = " "


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[b] = a

    def groups(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def _is_invisible(c: str) -> bool:
    o = ord(c)
    if c in SHOWING or c == ZWNJ:
        return False
    return ud.category(c) == "Cf" or 0xFE00 <= o <= 0xFE0F or o in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180E) or (ud.category(c) == "Cc" and c not in "\t\n\r\x0b\x0c\x85") or 0xE0100 <= o <= 0xE01EF


@lru_cache(None)
def look_alikes(persian: bool) -> tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]:
    """Classes of look-alike strings, each with its eligible representatives, of which the first one is taken."""
    classes, plain = Classes(), set()
    for o in [*range(0x80, 0x3000), *range(0xA640, 0xAC00), *range(0xF900, 0xFFF0), *range(0x1D15E, 0x1D1C1)]:
        c = chr(o)
        kind = ud.category(c)
        if kind == "Cn":
            continue
        d = ud.decomposition(c)
        if kind == "Zs":
            classes.join(BLANK_MEMBER, c)
        elif d and not d.startswith("<"):
            if " " in d:  # a letter and a mark
                classes.join(c, ud.normalize("NFD", c))
                classes.join(c, "".join(chr(int(x, 16)) for x in d.split()))
                plain.add(c)
            elif not 0xF900 <= o <= 0xFAFF:
                classes.join(ud.normalize("NFC", c), c)
                plain.add(ud.normalize("NFC", c))
        elif 0xFB00 <= o <= 0xFB06 or 0xFB50 <= o <= 0xFBFF or 0xFE70 <= o <= 0xFEFC:
            k = ud.normalize("NFKC", c)
            if kind[0] == "L" and not any(ud.category(x)[0] == "Z" for x in k):
                classes.join(k, c)
                plain.add(k)
    for c in "‐‑":
        classes.join("-", c)
    for c in "\x0b\x0c\x85  ":
        classes.join("\n", c)
    plain |= {BLANK_MEMBER, "-", "\n"}
    if persian:
        for c, kin in PERSIAN_KIN.items():
            for k in kin:
                classes.join(c, k)
            plain.add(c)
    out = []
    for members in classes.groups():
        # a Persian letter and its kin, or one of the plain forms, where the class has any; a letter without its mark never
        own = [m for m in members if persian and m in PERSIAN_KIN]
        if own:
            out.append((tuple(members), (own[0],)))
            continue
        best = [m for m in members if m in plain] or [m for m in members if len(m) == 1]
        least = min(map(len, best))
        out.append((tuple(members), tuple(sorted(m for m in best if len(m) == least))))
    return tuple(out)


WIDE = {chr(o): ud.normalize("NFKC", chr(o)) for o in [*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFBF), *range(0xFFE0, 0xFFE7), *range(0xFFE8, 0xFFEF)] if ud.category(chr(o)) != "Cn" and chr(o) not in "￣"}
WIDE["　"] = " "
ALPHABETS = ("latin", "cyrillic", "greek")


def alphabet(c: str) -> str | None:
    """The alphabet of a letter that has look-alikes in others; None for a mark and for any other character."""
    if "Ѐ" <= c <= "ԯ":
        return "cyrillic"
    if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
        return "greek"
    return "latin" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else None


@lru_cache(None)
def kin() -> dict[str, tuple[str, ...]]:
    """Of each letter with look-alikes in other alphabets its class, closed by union-find."""
    classes = Classes()
    for latin, others in LATIN_KIN.items():
        for c in others:
            classes.join(latin, c)
    return {c: tuple(sorted(members, key=lambda m: (ALPHABETS.index(alphabet(m)), ord(m)))) for members in classes.groups() for c in members}


_ARABIC = "ء-غف-ٟٮ-ۓەۮۯۺ-ۿݐ-ݿࡰ-ࢇࢠ-ࣉﭐ-﷿ﹰ-ﻼ"
_WORD = re.compile("[A-Za-zªºÀ-ɏͰ-ϿЀ-ԯḀ-῿̀-ͯ]+")
_MIXED = re.compile("[A-Za-zÀ-ɏ̀-ͯ][Ͱ-ϿЀ-ԯ]|[Ͱ-ϿЀ-ԯ][A-Za-zÀ-ɏ]|[Ͱ-Ͽ][Ѐ-ԯ]|[Ѐ-ԯ][Ͱ-Ͽ]")
_CJK = re.compile("[ぁ-ゖゝ-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_BAD_JOINER = re.compile(f"(?<![{_ARABIC}]){ZWNJ}+|{ZWNJ}+(?![{_ARABIC}])|{ZWNJ}{{2,}}")


def _set(chars: Iterable[str]) -> str:
    """A regular expression's set of these characters."""
    points = sorted({ord(c) for c in chars})
    parts, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        parts.append(re.escape(chr(points[i])) + (f"-{re.escape(chr(points[j]))}" if j > i else ""))
        i = j + 1
    return "[" + "".join(parts) + "]"


class Canon:
    """Rewrites text to the consistent form. counts: how often each contested letter stands in the corpus."""

    def __init__(self, persian: bool, counts: dict[str, int] | None = None) -> None:
        counts = counts or {}
        self.rewrite: dict[str, str] = {}
        for members, best in look_alikes(persian):
            self.rewrite |= {m: best[0] for m in members if m != best[0]}
        #: How often the corpus writes letters with look-alikes in each alphabet, and each letter's most frequent look-alike there.
        self.written = {x: sum(counts.get(c, 0) for c in kin() if alphabet(c) == x) for x in ALPHABETS}
        self.member = {(c, x): max((m for m in members if alphabet(m) == x), key=lambda m: counts.get(m, 0), default=None) for c, members in kin().items() for x in ALPHABETS}
        self.invisible = {chr(o): "" for o in [*range(0x3000), *range(0xFE00, 0x10000), *range(0xE0000, 0xE0200)] if _is_invisible(chr(o))}
        self.automaton = ahocorasick.Automaton()
        for m, to in self.rewrite.items():
            if m not in ("-", " "):
                self.automaton.add_word(m, (len(m), to))
        self.automaton.make_automaton()
        single = [m for m in self.rewrite if len(m) == 1]
        marks = {m[-1] for m in self.rewrite if len(m) > 1 and ud.category(m[-1])[0] == "M"}
        self.unplain = re.compile(_set([*single, *marks, *self.invisible, *(c for c in WIDE)]))
        self.width = re.compile(_set(WIDE))
        self.hidden = re.compile(_set(self.invisible))

    def narrow(self, text: str) -> str:
        """Ordinary width for each line that isn't Chinese or Japanese."""
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if self.width.search(line):
                asian = len(_CJK.findall(line))
                if not asian or asian < sum(map(str.isalpha, line)) - asian:
                    lines[i] = self.width.sub(lambda m: WIDE[m[0]], line)
        return "\n".join(lines)

    def alphabets(self, text: str) -> str:
        """One alphabet in each word of look-alike letters."""

        def one(m: re.Match) -> str:
            w = m[0]
            of = [alphabet(c) for c in w]
            sizes = {x: of.count(x) for x in ALPHABETS}
            if sum(n > 0 for n in sizes.values()) < 2:
                return w
            for x in sorted((x for x in ALPHABETS if sizes[x]), key=lambda x: (-sizes[x], -self.written[x])):
                out = [c if own in (x, None) else self.member.get((c, x)) for c, own in zip(w, of)]
                if None not in out:
                    return "".join(out)
            return w

        return _WORD.sub(one, text)

    def greedy(self, text: str) -> str:
        """Every longest match of the automaton rewritten, from left to right."""
        out, at = [], 0
        for end, (n, to) in self.automaton.iter_long(text):
            out += (text[at : end + 1 - n], to)
            at = end + 1
        return "".join(out) + text[at:]

    def __call__(self, text: str) -> str:
        if text.isascii() and not self.hidden.search(text) and "\x0b" not in text and "\x0c" not in text:
            return text
        mixed = _MIXED.search(text)
        if not mixed and not self.unplain.search(text) and not (ZWNJ in text and _BAD_JOINER.search(text)):
            return text
        before = None
        while text != before:  # what is rewritten may join its new neighbours; each round leaves fewer members that aren't representatives
            before, text = text, self.once(text)
        return text

    def once(self, text: str) -> str:
        text = self.hidden.sub("", text)
        if ZWNJ in text:
            text = _BAD_JOINER.sub("", re.sub(f"{ZWNJ}{{2,}}", ZWNJ, text))
        if self.width.search(text):
            text = self.narrow(text)
        if not ud.is_normalized("NFC", text):
            text = ud.normalize("NFC", text)
        text = self.greedy(text)
        return self.alphabets(text) if _MIXED.search(text) else text


@lru_cache(8)
def _canon(persian: bool, counts: tuple[tuple[str, int], ...]) -> Canon:
    return Canon(persian, dict(counts))


def canon(persian: bool = True, counts: dict[str, int] | None = None) -> Canon:
    return _canon(persian, tuple(sorted((counts or {}).items())))


@lru_cache(None)
def contested() -> tuple[str, ...]:
    """The letters among whose look-alikes the definition leaves the choice to the corpus: those of several alphabets."""
    return tuple(sorted(kin()))


def member_counts(df: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each contested letter stands in df, counted over all rows.

    The letters are a fixed table, so the driver gets a bounded number of rows. Null texts count nothing."""
    members = contested()
    points = np.array([ord(m) for m in members])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(members), dtype=np.int64)
        for b in batches:
            for s in b.column(0).to_pylist():
                if s:
                    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                    total += np.bincount(codes[codes < 0x600], minlength=0x600)[points]
        yield pa.record_batch({"member": pa.array(members), "n": pa.array(total)})

    rows = df.select(F.col(f"`{text}`").alias("t")).mapInArrow(count, "member string, n bigint").groupBy("member").agg(F.sum("n").alias("n")).collect()
    return {r["member"]: r["n"] for r in rows if r["n"]}


def wiki_is_persian(url: Column) -> Column:
    """False where the url's first host label names another language than Persian."""
    label = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:www\.)?([^./:]+)\.", 1))
    return ~label.rlike("^[a-z]{2,3}$") | (label == "fa")


def consistent(df: DataFrame, text: str = "text", persian: Column | None = None, counts: dict[str, int] | None = None, into: str = "consistent") -> DataFrame:
    """df with the consistent form of a text column as a new column (null for null, "" for "").

    persian: whether a row is a Persian record (default: all are). Raises ValueError if the new column's name is taken."""
    if into.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column {into} exists already")
    counts = counts or {}

    @F.pandas_udf("string")
    def form(texts, fa):
        forms = {True: canon(True, counts), False: canon(False, counts)}
        return pd.Series([None if s is None else forms[bool(p)](s) for s, p in zip(texts, fa)], dtype=object)

    return df.withColumn(into, form(F.col(f"`{text}`"), F.coalesce(persian if persian is not None else F.lit(True), F.lit(True))))


def unlike(df: DataFrame, text: str = "text", persian: Column | None = None, counts: dict[str, int] | None = None, skip_damaged: Column | None = None) -> DataFrame:
    """The rows of df whose text isn't in consistent form yet; null and empty texts never are among them.

    skip_damaged: for which rows texts damaged by a wrong encoding are left out (default: none)."""
    from parsloom.llm.mojibake import all_spans

    counts = counts or {}

    @F.pandas_udf("boolean")
    def differs(texts, fa, skip):
        forms = {True: canon(True, counts), False: canon(False, counts)}
        odd = [bool(s) and forms[bool(p)](s) != s for s, p in zip(texts, fa)]
        bad = all_spans([s if o and k else None for s, o, k in zip(texts, odd, skip)])
        return pd.Series([o and not b for o, b in zip(odd, bad)], dtype=bool)

    yes = lambda c, d: F.coalesce(c, F.lit(d)) if c is not None else F.lit(d)
    return df.where(differs(F.col(f"`{text}`"), yes(persian, True), yes(skip_damaged, False)))
