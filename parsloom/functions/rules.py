"""Ordered rules of the normalizer as chained regexp_replace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parsloom.functions.chars import LETTERS

_END = r"[ \n\.:!،؛؟»\]\)\}«\[\(\{]|\z"
#: Fixed values: (pattern, replacement), applied in this order. A leading (?U) makes classes cover all scripts; \z is the very end.
STYLE = [(r'"([^\n"]+)"', "«$1»"), (r"(?U)([\d+])\.([\d+])", "$1٫$2"), (r" ?\.\.\.", " …")]
EXTRA_SPACE = [
    (r"\A +| +\z", ""),
    (r" {2,}", " "),
    (r"\n{3,}", "\n\n"),
    (r"\x{200C}{2,}", "‌"),
    (r"\x{200C}{1,} ", " "),
    (r" \x{200C}{1,}", " "),
    (r"(?U)\b\x{200C}*\B", ""),
    (r"(?U)\B\x{200C}*\b", ""),
    (r"[ـ\r]", ""),
]
PUNCTUATION = [
    (r'" ([^\n"]+) "', '"$1"'),
    (r" ([\.:!،؛؟»\]\)\}])", "$1"),
    (r"([«\[\(\{]) ", "$1"),
    (r"(?U)([\.:])([^ \.:!،؛؟»\]\)\}\d۰-۹])", "$1 $2"),
    (r"([!،؛؟»\]\)\}])([^ \.:!،؛؟»\]\)\}])", "$1 $2"),
    (r"([^ «\[\(\{])([«\[\(\{])", "$1 $2"),
    (rf"(?U)(\d)([{LETTERS}])", "$1 $2"),
    (rf"(?U)([{LETTERS}])(\d)", "$1 $2"),
]
AFFIXES = [
    (r"([^ ]ه) ی ", "$1‌ی "),
    (r"(\A| )(ن?می) ", "$1$2‌"),
    (rf"(?U)(?<=[^\n\d \.:!،؛؟»\]\)\}}«\[\(\{{]{{2}}) (تر(?:ین?)?|گری?|های?)(?={_END})", "‌$1"),
    (r"([^ ]ه) (ا(?:م|یم|ش|ند|ی|ید|ت))(?=[ \n\.:!،؛؟»\]\)\}]|\z)", "$1‌$2"),
    (r"(ه)(ها)", "$1‌$2"),
]


def apply(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, text)


def persian_style(text: Column) -> Column:
    return apply(text, STYLE)


def extra_space(text: Column) -> Column:
    return apply(text, EXTRA_SPACE)


def affix_space(text: Column) -> Column:
    return apply(text, AFFIXES)


def punctuation_space(text: Column) -> Column:
    return apply(text, PUNCTUATION)


def fewer_repeats(text: Column) -> Column:
    """Letters that come three or more times in a row come twice: the form without a lexicon."""
    return F.regexp_replace(text, rf"([{LETTERS}])\1{{2,}}", "$1$1")
