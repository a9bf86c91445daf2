"""Text statistics per document and what is no prose (problem 1).

Every document's statistics and those of its units are taken in one pass. For each language a mergeable quantile sketch
(KLL) of every statistic is built on the executors and merged. A unit that runs on as words becomes robust z-scores
against its language's units that close with an end mark, and a unit in a tail (symbols, word length, too few common
words) is no prose; units that are no run of words (cells, entries, one phrase again) need no score. What share of a
document's characters is left decides. The units with an end mark stand for prose whatever the records around are like:
tables and lists, however many, are none of them. Documents become z-scores too, as report.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsloom.llm.canon import canon
from parsloom.llm.common import written
from parsloom.llm.mojibake import all_spans, put_back
from parsloom.llm.sentences import unit_ends

STATISTICS = ("words", "mean_word_length", "symbol_share", "end_mark_share", "common_word_share", "prose_share")
#: Of units: 1 less the share of letters, the logarithm of the mean word length, the root of the share of common words (whose
#: spread is alike for all shares). In one tail of the first and last, in both of the other, a unit is no prose.
UNIT_STATISTICS = ("symbols", "length", "common")
UNIT_SPREAD = {"symbols": (0.07, 0.085), "length": (0.25, 0.35), "common": (0.075, 0.12)}
SCHEMA = (
    "language string, words double, mean_word_length double, symbol_share double, end_mark_share double, common_word_share double, "
    "chars int, sure int, units array<struct<n:int,ended:boolean,symbols:float,length:float,common:float>>"
)
#: The least spread of a statistic, so that a language of equal documents has no tails by rounding.
LEAST_SPREAD = {"words": 40.0, "mean_word_length": 0.5, "symbol_share": 0.02, "end_mark_share": 0.1, "common_word_share": 0.04, "prose_share": 0.06}
TAIL = 3.5

_WORD = re.compile(r"[^\W\d_]+(?:[‌'’̀-ًͯ-ٟั-๎ऀ-ॏ-]*[^\W\d_]+)*")
_SCRIPTS = [
    ("thai", re.compile("[฀-๿]")),
    ("hindi", re.compile("[ऀ-ॿ]")),
    ("japanese", re.compile("[぀-ヿ]")),
    ("chinese", re.compile("[一-鿿]")),
    ("arabic", re.compile("[؀-ۿ]")),
    ("latin", re.compile("[A-Za-zÀ-ɏ]")),
    ("cyrillic", re.compile("[Ѐ-ӿ]")),
    ("greek", re.compile("[Ͱ-Ͽ]")),
]
_END = re.compile("[.!?؟。！？．｡۔।…][»”\"’'」』）)\\]\\s]*\\Z")
_BULLET = re.compile(r"\s*(?:[•◦▪●‣*+–—-]\s+|(?:\(?\d{1,4}|[A-Za-zآ-ی])[.)\-]\s+)")
_MARKUP = re.compile(r"https?://|www\.|<(?:/?[A-Za-z][^>]*>?)?|[{}>\[\]=|\\\t]|function\b|var\b|;(?=\S)|[،,](?=[^\s،,;]+[،,;]\S)|@(?=\S)")
_CELLS = re.compile(r"\s[|/\-–—•◦·»›*+]\s+|[|\t•◦▪●‣]\s*|(?:(?<=\s)|^)\(?\d{1,3}[.)\-]\s+")
_OTHER = re.compile(r"[\W\d_]+")
_SYMBOL = re.compile(r"[^\w\s‌̀-ًͯ-ٟ]|_")
#: Frequent words by which languages of one script are told apart.
FUNCTION_WORDS = {
    "german": "der die das und den dem von zu mit auf ist im ein eine einen für nicht sich des am als",
    "french": "le la les de des et un une du en à est dans près que qui pour sur au aux il elle",
    "english": "the of and to in a is was for on with at by from that it as an or not his her were be this who after before during while until",
    "spanish": "el la los las de y que en un una por con para del es se no su como más",
    "arabic": "في من على إلى عن ثم هل قال أن هذا هذه التي الذي قبل بعد عند منذ كان و ما لا مع",
    "urdu": "نے کے کی کا کو سے میں ہے اور کیا پر یہ وہ تھا تھے گیا ایک",
    "persian": "رو تو اصلاً این اون یه داره چی که می‌شه نمی‌شه بود شد کرد است را و در به از با برای نیز اما",
}
_SCRIPT_OF = {"german": "latin", "french": "latin", "english": "latin", "spanish": "latin", "arabic": "arabic", "urdu": "arabic", "persian": "arabic"}
#: The language of a text without any of these words: it is judged by all languages merged.
UNKNOWN = "unknown"


@lru_cache(4)
def _common(words: tuple[str, ...]) -> frozenset[str]:
    form = canon(True)
    return frozenset(form(w).lower() for w in words)


@lru_cache(None)
def _telling() -> dict[str, frozenset[str]]:
    form = canon(True)
    return {name: frozenset(form(w) for w in words.split()) for name, words in FUNCTION_WORDS.items()}


@lru_cache(4)
def _frequent(common: frozenset[str]) -> frozenset[str]:
    return common.union(*_telling().values())


#: What a character is: a letter, a mark on one (or a joiner), a blank, a letter of a script without blanks, Devanagari, lost, a digit.
_LETTER, _MARK, _BLANK, _DENSE, _HINDI, _LOST, _DIGIT = (bytes([k]) for k in range(1, 8))


@lru_cache(None)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first plane its kind and its script's number (0 for none)."""
    kinds, scripts = np.zeros(0x10000, dtype=np.uint8), np.zeros(0x10000, dtype=np.uint8)
    for o in range(0x10000):
        c = chr(o)
        if c == "‌" or re.match("[̀-ًͯ-ٟั-๎ऀ-ःऺ-ॏ]", c):
            kinds[o] = 2
        elif re.match("[฀-๿぀-ヿ一-鿿]", c):
            kinds[o] = 4
        elif re.match("[ऀ-ॿ]", c):
            kinds[o] = 5
        elif c in "?\ufffd":
            kinds[o] = 6
        elif c.isspace():
            kinds[o] = 3
        elif c.isalpha():
            kinds[o] = 1
        elif c != "_" and re.match(r"\w", c):
            kinds[o] = 7
        for i, (_, p) in enumerate(_SCRIPTS, 1):
            if p.match(c):
                scripts[o] = i
    return kinds, scripts


def _times_said(words: str, seen: dict[int, int]) -> int:
    """How often the unit's words were said so far, each time in the unit counted; a phrase said over and over is one, however
    often each unit says it and wherever it breaks off. Units that only open alike are different ones."""
    times, half = 1, words[: (len(words) + 1) // 2]
    p = words.find(half, 1)
    if p > 0:
        words, times = words[:p], (len(words) if words[p:] == words[:-p] else p + len(half)) // p
    key = hash(words)
    seen[key] = seen.get(key, 0) + times
    return seen[key]


#: A unit that is no run of words, and one of which only the shape is left that prose has.
NONE, SHAPE = 0, 1
_THAI = re.compile("[฀-๿]")  # it writes no end marks


def _unit(unit: str, kinds: bytes, frequent: frozenset[str], seen: dict[int, int], marked: bool) -> int | tuple[bool, float, float | None, float | None]:
    """NONE, SHAPE, or whether a run of words closes as its script's sentences do, and its UNIT_STATISTICS (null where its script
    has no words between blanks, or none of its words are listed). marked: whether there is any markup in the unit's text."""
    text = unit.strip()
    n = len(kinds) - kinds.count(_BLANK)
    lost, dense, hindi = kinds.count(_LOST), kinds.count(_DENSE), kinds.count(_HINDI)
    if lost * 2 > n:  # its letters are lost: only its shape is left
        sizes = [len(w) for w in text.split()]
        return SHAPE if len(sizes) >= 5 and 2 < sum(sizes) / len(sizes) < 8 and not _BULLET.match(text) and not re.search(r"[|;{}<>=]", text) else NONE
    letters = kinds.count(_LETTER) + kinds.count(_MARK) + dense + hindi
    if not letters:
        return NONE
    ended = bool(_END.search(text, max(0, len(text) - 12)))
    symbols = 1 - letters / n
    if dense > 0.5 * n:
        if dense < 8 or len(set(text)) < min(12, 0.25 * dense) or _times_said(_OTHER.sub("", text), seen) > 3:
            return NONE
        return ended or bool(_THAI.search(text)), symbols, None, None
    words = _WORD.findall(text.lower())
    many = len(words)
    if many < (3 if ended else 4 if hindi > 0.5 * n else 6) or many > 5 and len(set(words)) < 0.5 * many:
        return NONE
    if _times_said(" ".join(words) + " ", seen) > 3:
        return NONE
    if marked and sum(1 for _ in _MARKUP.finditer(text)) * 6 > many:
        return NONE
    if _BULLET.match(text) and not (ended and many >= 6):
        return NONE
    return ended, symbols, math.log(letters / many), None if hindi > 0.5 * n else math.sqrt(sum(map(frequent.__contains__, words)) / many)


def _pieces(unit: str) -> list[str]:
    """A unit that holds a row of cells, entries or numbered items is judged by its pieces."""
    if sum(1 for _ in _CELLS.finditer(unit)) >= 3:
        out, at = [], 0
        for m in _CELLS.finditer(unit):
            if m.end() > at:
                out.append(unit[at : m.end()])
                at = m.end()
        out.append(unit[at:])
        return out
    return [unit]


def _language(script: str, words: list[str]) -> str:
    """The language of a script's words; of a script that several languages here write, the one with most of its frequent words."""
    if script not in _SCRIPT_OF.values():
        return script
    votes = {name: sum(map(known.__contains__, words)) for name, known in _telling().items() if _SCRIPT_OF[name] == script}
    best = max(votes, key=lambda name: votes[name])
    return best if votes[best] else UNKNOWN


def describe(text: str | None, common: frozenset[str]) -> tuple:
    """(language, words, mean word length, symbol share, end-mark share of lines, common-word share, characters in units, those in
    units that only have the shape of prose, the other units that may be prose with their statistics).

    Nulls for null and blank text."""
    if text is None or not text.strip():
        return (None,) * 9
    text = canon(True)(text)
    if not text.strip():
        return (None,) * 9
    kinds, scripts = _kinds()
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)
    kind = kinds[codes].tobytes()
    of = dict(zip([name for name, _ in _SCRIPTS], np.bincount(scripts[codes], minlength=len(_SCRIPTS) + 1)[1:].tolist()))
    if of["japanese"] > 0.1 * of["chinese"]:
        of["japanese"] += of.pop("chinese")
    script = max(of, key=lambda k: of[k])
    words = _WORD.findall(text.lower())
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    solid = len(kind) - kind.count(_BLANK)
    total, sure, at = 0, 0, 0
    units = []
    seen: dict[int, int] = {}
    frequent = _frequent(common)
    cells, marked = bool(_CELLS.search(text)), bool(_MARKUP.search(text))  # most texts have none: their units needn't be searched
    for end in unit_ends(text):
        unit = text[at:end]
        for piece in _pieces(unit) if cells else (unit,):
            n = len(piece.strip())
            total += n
            if n:
                found = _unit(piece, kind[at : at + len(piece)], frequent, seen, marked)
                if found == SHAPE:
                    sure += n
                elif found != NONE:
                    units.append((n, *found))
            at += len(piece)
        at = end
    return (
        _language(script, words) if of[script] else UNKNOWN,
        float(len(words)),
        sum(map(len, words)) / len(words) if words else 0.0,
        (kind.count(b"\0") + kind.count(_LOST)) / max(1, solid),
        sum(bool(_END.search(x, max(0, len(x) - 12))) for x in lines) / max(1, len(lines)),
        sum(map(common.__contains__, words)) / max(1, len(words)),
        total,
        sure,
        units,
    )


def text_statistics(df: DataFrame, common_words: list[str], text: str = "text", into: str = "stats") -> DataFrame:
    """df with one struct column of its text's statistics and units (all null for null and blank text). Text damaged by a wrong
    encoding counts as what it was before.

    common_words is a fixed list of a language's most common words and travels with the plan."""
    if into.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column {into} exists already")
    common = tuple(sorted({w for w in common_words if w}))
    kinds = [pa.string(), *[pa.float64()] * 5, pa.int32(), pa.int32()]
    names = ["language", *STATISTICS[:-1], "chars", "sure", "units"]

    @F.arrow_udf(SCHEMA)
    def stats(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        rows = [describe(s and put_back(s, found), _common(common)) for s, found in zip(texts, all_spans(texts))]
        columns = list(zip(*rows)) if rows else [()] * 9
        lists = columns.pop()
        flat = list(zip(*(u for units in lists for u in units or ()))) or [()] * 5
        units = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(flat, [pa.int32(), pa.bool_(), *[pa.float32()] * 3])], ["n", "ended", *UNIT_STATISTICS])
        ends = np.cumsum([0, *(len(u or ()) for u in lists)]).astype(np.int32)
        parts = [pa.array(x, k) for x, k in zip(columns, kinds)]
        return pa.StructArray.from_arrays([*parts, pa.ListArray.from_arrays(pa.array(ends), units)], names)

    # else a filter on a statistic would take them all a second time
    stats = stats.asNondeterministic()
    return df.withColumn(into, stats(F.col(f"`{text}`")))


def _unit_middles(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The median and spread of each statistic of the units with an end mark, by language and over all languages merged."""
    closed = units.select("language", F.explode("units").alias("u")).where("u.ended").select("language", "u.*")
    counted = [F.count(s).alias(f"n_{s}") for s in UNIT_STATISTICS]  # an empty sketch has no quantiles
    sketches = closed.groupBy("language").agg(*counted, *[F.kll_sketch_agg_double(F.col(s).cast("double")).alias(s) for s in UNIT_STATISTICS])
    summed = [F.sum(f"n_{s}").alias(f"n_{s}") for s in UNIT_STATISTICS]
    merged = sketches.agg(F.count("*").alias("n"), *summed, *[F.kll_merge_agg_double(F.col(s)).alias(s) for s in UNIT_STATISTICS]).where("n > 0")

    def middle(s: str):
        least, most = UNIT_SPREAD[s]
        spread = (_quantile(s, 0.75) - _quantile(s, 0.25)) / 1.349
        both = F.struct(_quantile(s, 0.5).alias("mid"), F.least(F.greatest(spread, F.lit(least)), F.lit(most)).alias("spread"))
        return F.when(F.col(f"n_{s}") > 0, both)

    own = sketches.where(F.col("language") != UNKNOWN).select("language", F.struct(*[middle(s).alias(s) for s in UNIT_STATISTICS]).alias("_own"))
    return own, merged.select(F.struct(*[middle(s).alias(s) for s in UNIT_STATISTICS]).alias("_all"))


def prose_shares(taken: DataFrame, tail: float = TAIL) -> DataFrame:
    """taken (statistics and units as columns) with prose_share instead of its units: the share of a text's characters in units that
    are in no tail of their language. A language without any unit that closes with an end mark, and an unknown one, is judged by
    all languages merged; where no unit at all does, nothing is in a tail. A unit without an end mark has half the room in the common
    words' tail.

    The sketches are one row per language, whose number is fixed by the languages that are told apart, so they are broadcast."""
    own, merged = _unit_middles(taken.select("language", "units"))
    joined = taken.join(F.broadcast(own), "language", "left").join(F.broadcast(merged), F.lit(True), "left").withColumn("_by", F.coalesce("_own", "_all"))
    z = lambda u, s: (u[s] - F.col(f"_by.{s}.mid")) / F.col(f"_by.{s}.spread")
    prose = lambda u: F.coalesce((z(u, "symbols") <= tail) & (F.abs(z(u, "length")) <= tail) & (z(u, "common") >= F.when(u["ended"], -tail).otherwise(-tail / 2)), F.lit(True))
    left = F.aggregate(F.filter("units", prose), F.lit(0), lambda total, u: total + u["n"])
    share = ((F.col("sure") + left) / F.greatest("chars", F.lit(1))).alias("prose_share")
    return joined.select(*[c for c in taken.columns if c not in ("chars", "sure", "units")], share)


def language_sketches(stats: DataFrame, k: int = 200) -> DataFrame:
    """One KLL sketch for each language and statistic: built per partition, merged per language. stats has the statistics as columns."""
    return stats.where(F.col("language").isNotNull()).groupBy("language").agg(*[F.kll_sketch_agg_double(F.col(s), F.lit(k)).alias(s) for s in STATISTICS])


def _quantile(sketch: str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(q))


def _middle(sketches: DataFrame, name: str) -> list[Column]:
    """Median and spread of each statistic; the spread is held between bounds, as a language may be half junk or all alike."""
    out = []
    for s in STATISTICS:
        spread = (_quantile(s, 0.75) - _quantile(s, 0.25)) / 1.349
        out.append(F.struct(_quantile(s, 0.5).alias("mid"), F.least(F.greatest(spread, F.lit(LEAST_SPREAD[s])), F.lit(2 * LEAST_SPREAD[s])).alias("spread")).alias(f"_{name}_{s}"))
    return out


def flag_tails(stats: DataFrame, tail: float = TAIL) -> DataFrame:
    """stats (with the statistics as columns) and for each statistic its robust z-score against its language (z_) and against
    the sketches of all languages merged (all_z_), and tails: the statistics beyond the tail in either.

    The merged sketches judge languages of which most records are junk. A row without statistics has null scores and no tails.
    The sketches are one row per language, whose number is fixed by the scripts that are told apart, so they are broadcast."""
    sketches = language_sketches(stats)
    merged = sketches.agg(F.count("*").alias("n"), *[F.kll_merge_agg_double(F.col(s)).alias(s) for s in STATISTICS]).where("n > 0")
    by_language, overall = sketches.select("language", *_middle(sketches, "own")), merged.select(*_middle(merged, "all"))
    joined = stats.join(F.broadcast(by_language), "language", "left").join(F.broadcast(overall), F.lit(True), "left")
    score = lambda name, s: (F.col(s) - F.col(f"_{name}_{s}.mid")) / F.col(f"_{name}_{s}.spread")
    out = joined.select(*stats.columns, *[score("own", s).alias(f"z_{s}") for s in STATISTICS], *[score("all", s).alias(f"all_z_{s}") for s in STATISTICS])
    return out.withColumn("tails", F.array_compact(F.array(*[F.when(F.greatest(F.abs(F.col(f"z_{s}")), F.abs(F.col(f"all_z_{s}"))) > tail, F.lit(s)) for s in STATISTICS])))


def not_prose(stats: DataFrame, least_share: float = 0.5) -> DataFrame:
    """The rows of whose text less than least_share belongs to running sentences. stats is what prose_shares gives."""
    return stats.where(F.col("prose_share") < least_share)


def taken_once(df: DataFrame, common_words: list[str], key: list[str], text: str = "text") -> DataFrame:
    """key, statistics and prose_share of every row with text. Statistics and units are written to the shared folder: the sketches and the scores both read them."""
    return prose_shares(written(text_statistics(df, common_words, text).select(*key, "stats.*").where(F.col("language").isNotNull())))
