"""Sentence and word tokenization as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from parsloom.functions.chars import trim

SENTENCE_END = r"([!.?⸮؟]+)[ \n]+"
WORD_SPLIT = r'(?U)([؟!?]+|[\d.:]+|[:.،؛»\])}"«\[({/\\])'
EMAIL = r"[a-zA-Z0-9._+\-]+@(?:[a-zA-Z0-9\-]+\.)+[A-Za-z]{2,}"
LINK = r"(?U)(?:(?:https?|ftp)://)?(?<!@)(?:(?:[a-zA-Z0-9\-]+\.)+[a-zA-Z]{2,})[-\w@:%_.+/~#?=&]*"
ACCOUNT = r"(?U)(?<![\w._])(@[\w_]+)"
FLOAT = r"(?U)\b(?<!\.)([\d۰-۹,٬]+[.٫٬][\d۰-۹]+)\b(?!\.)"
INTEGER = r"(?U)\b(?<![\d۰-۹][.٫٬,])([\d۰-۹]+)(?![.٫٬,][\d۰-۹])\b"
#: Auxiliaries before and after a participle.
_WILL = ["خواهم", "خواهی", "خواهد", "خواهیم", "خواهید", "خواهند"]
BEFORE_VERBS = _WILL + ["ن" + w for w in _WILL]
_AM, _WAS, _BE = "ام ای است ایم اید اند".split(), "بودم بودی بود بودیم بودید بودند".split(), "باشم باشی باشد باشیم باشید باشند".split()
_BECOME, _BECAME = "شوم شوی شود شویم شوید شوند".split(), "شدم شدی شد شدیم شدید شدند".split()
AFTER_VERBS = [
    *_AM, *_WAS, *_BE,
    *(f"{p}_{w}" for p in ("شده", "نشده") for group in (_AM, _WAS, _BE) for w in group),
    *_BECOME, *_BECAME,
    *(p + w for p in ("ن", "می‌", "نمی‌") for group in (_BECOME, _BECAME) for w in group),
    *(w + "_شد" for w in BEFORE_VERBS),
]


@dataclass(frozen=True)
class WordOptions:
    """What the word tokenizer masks and joins; masks are off by default, joining is on."""

    join_verb_parts: bool = True
    keep_dangling: bool = False  # True keeps a sentence-final auxiliary that joining would drop
    emails: bool = False
    links: bool = False
    accounts: bool = False
    hashtags: bool = False
    numbers: bool = False


def sentences(text: Column) -> Column:
    """The sentences of a text as an array: a run of end marks before blanks ends one, and so does a blank line."""
    parts = F.split(F.regexp_replace(text, SENTENCE_END, "$1\n\n"), "\n\n", -1)
    return F.filter(F.transform(parts, lambda s: trim(F.replace(s, F.lit("\n"), F.lit(" ")))), lambda s: s != "")


def mask_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, " EMAIL ")


def mask_links(text: Column) -> Column:
    return F.regexp_replace(text, LINK, " LINK ")


def mask_accounts(text: Column) -> Column:
    return F.regexp_replace(text, ACCOUNT, " ID ")


def mask_hashtags(text: Column) -> Column:
    """#a_b becomes TAG a b; the underscores of a tag become blanks, those beside it stay."""

    def one(piece: Column) -> Column:
        at = F.instr(piece, "#")
        tag = F.substring(piece, at + 1, F.length(piece))
        return F.when((at > 0) & (tag != ""), F.concat(F.substring(piece, F.lit(1), at - 1), F.lit("TAG "), F.translate(tag, "_", " "))).otherwise(piece)

    return F.array_join(F.transform(F.split(text, r"(?U)(?=\s)"), one), "")


def mask_numbers(text: Column) -> Column:
    """Floats become NUMF, integers NUM and their number of digits."""
    marked = F.regexp_replace(F.regexp_replace(text, FLOAT, " NUMF "), INTEGER, " NUM\x01$1\x02 ")

    def one(piece: Column) -> Column:
        return F.when(piece.rlike("^NUM\x01.*\x02$"), F.concat(F.lit("NUM"), (F.length(piece) - 5).cast("string"))).otherwise(piece)

    return F.array_join(F.transform(F.split(marked, " ", -1), one), " ")


def words(text: Column, options: WordOptions = WordOptions(join_verb_parts=False), participles: Iterable[str] = ()) -> Column:
    """The words of a text as an array; null for null. participles are needed for joining verb parts."""
    text = F.translate(text, "\n\t", "  ")
    for on, mask in ((options.emails, mask_emails), (options.links, mask_links), (options.accounts, mask_accounts), (options.hashtags, mask_hashtags), (options.numbers, mask_numbers)):
        if on:
            text = mask(text)
    out = F.filter(F.split(F.regexp_replace(text, WORD_SPLIT, " $1 "), " "), lambda t: t != "")
    return join_verb_parts(out, participles, options.keep_dangling) if options.join_verb_parts else out


def join_verb_parts(tokens: Column, participles: Iterable[str], keep_dangling: bool = False) -> Column:
    """Parts of one verb joined by _, from the right: an auxiliary before it, or a participle before an auxiliary.

    A fold over one sentence's or line's tokens. An auxiliary at the very end has nothing to join with and is lost, as in
    the behaviour this follows; keep_dangling keeps it."""
    parts = sorted(set(participles))

    def step(done: Column, token: Column) -> Column:
        last = F.element_at(done, 1)
        joins = token.isin(BEFORE_VERBS) | (last.isin(AFTER_VERBS) & token.isin(parts) if parts else F.lit(False))
        if keep_dangling:
            joins = joins & (last != "")
        return F.when(joins, F.concat(F.array(F.concat(token, F.lit("_"), last)), F.slice(done, F.lit(2), F.size(done)))).otherwise(F.concat(F.array(token), done))

    folded = F.aggregate(F.reverse(tokens), F.array(F.lit("")), step)
    return F.when(F.size(tokens) <= 1, tokens).otherwise(F.slice(folded, F.lit(1), F.greatest(F.size(folded) - 1, F.lit(0))))


def participles_of(past_roots: Iterable[str]) -> list[str]:
    """The participles of past roots and their negatives; an empty root gives the bare endings."""
    return sorted({f for p in past_roots for f in (p + "ه", "ن" + p + "ه")})
