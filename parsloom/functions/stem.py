"""The rule-based stemmer as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes; of equal length in bytes the earlier one is tried first.
SUFFIXES = ["هایمان", "هایتان", "هایشان", "هایی", "های", "ترین", "تری", "تر", "گری", "گر", "مان", "تان", "شان", "ها", "ای", "ان", "ین", "ام", "ات", "اش", "یم", "ید", "ند", "م", "ت", "ش", "ی", "ٔ", "‌ا", "‌"]
ORDER = sorted(SUFFIXES, key=lambda s: -len(s.encode()))


def stem(word: Column) -> Column:
    """One suffix taken off, the longest in bytes first; a suffix of one character only where three stay. Then ۀ becomes ه
    and one final joiner goes. "" for "", null for null; a word that is a suffix comes out empty."""
    out = None
    for s in ORDER:
        hit = word.endswith(s)
        if len(s) == 1:
            hit = hit & (F.length(word) >= 4)
        cut = F.substring(word, F.lit(1), F.length(word) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    out = out.otherwise(word)
    out = F.regexp_replace(out, "ۀ\\z", "ه")
    return F.regexp_replace(out, "\\x{200C}\\z", "")
