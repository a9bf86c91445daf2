"""Character maps as Column expressions: unification, digits, diacritics, ligatures, special characters."""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ZWNJ = "‌"
#: The Persian alphabet as it stands in letter classes.
LETTERS = "آابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهی"
#: Digits and the percent sign, and what they become.
DIGITS_FROM, DIGITS_TO = "0123456789%٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹٪۰۱۲۳۴۵۶۷۸۹"
#: Ligatures and the words they stand for.
LIGATURES = [
    ("﷽", "بسم الله الرحمن الرحیم"), ("﷼", "ریال"), ("ﷰ", "صلی"), ("ﷹ", "صلی"), ("ﷲ", "الله"), ("ﷳ", "اکبر"), ("ﷴ", "محمد"), ("ﷵ", "صلعم"),
    ("ﷶ", "رسول"), ("ﷷ", "علیه"), ("ﷸ", "وسلم"), *((chr(o), "لا") for o in range(0xFEF5, 0xFEFD)),
]
#: Code points (as ranges) that are deleted.
SPECIAL_RANGES = [
    (0x605, 0x605), (0x653, 0x65F), (0x670, 0x670), (0x610, 0x616), (0x618, 0x61A), (0x61E, 0x61E), (0x6D4, 0x6D4), (0x6D6, 0x6ED), (0x6FD, 0x6FE), (0x8AD, 0x8AD), (0x8D4, 0x8FF),
    (0xFBB2, 0xFBC1), (0xFC5E, 0xFC63), (0xFCF2, 0xFCF4), (0xFD3E, 0xFD3F), (0xFE70, 0xFE72), (0xFE76, 0xFE7F), (0xFDFA, 0xFDFB),
]
SPECIALS = "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in SPECIAL_RANGES) + "]"
DIACRITICS = "[\\x{64B}-\\x{652}]"
#: The letter behind each base name of the character database.
_BASES = {
    "ALEF": "ا", "BEH": "ب", "PEH": "پ", "TEH": "ت", "THEH": "ث", "JEEM": "ج", "TCHEH": "چ", "HAH": "ح", "KHAH": "خ", "DAL": "د", "THAL": "ذ", "REH": "ر", "ZAIN": "ز", "JEH": "ژ", "SEEN": "س",
    "SHEEN": "ش", "SAD": "ص", "DAD": "ض", "TAH": "ط", "ZAH": "ظ", "AIN": "ع", "GHAIN": "غ", "FEH": "ف", "QAF": "ق", "KAF": "ک", "KEHEH": "ک", "SWASH KAF": "ک", "GAF": "گ", "LAM": "ل", "MEEM": "م", "NOON": "ن",
    "WAW": "و", "HEH": "ه", "YEH": "ی", "FARSI YEH": "ی", "KASHMIRI YEH": "ی", "ALEF MAKSURA": "ی",
    "TTEHEH": "ت", "TTEH": "ت", "TEHEH": "ت", "BEEH": "ب", "BEHEH": "ب", "NYEH": "ح", "DYEH": "ح", "TCHEHEH": "چ", "DDAL": "د", "DAHAL": "د", "DDAHAL": "د", "DUL": "د", "RREH": "ر", "VEH": "ف", "PEHEH": "ف", "NG": "ک", "NGOEH": "گ", "GUEH": "گ",
    "NOON GHUNNA": "ن", "RNOON": "ن", "HEH DOACHASHMEE": "ه", "HEH GOAL": "ه", "TEH MARBUTA GOAL": "ه", "KIRGHIZ OE": "و", "OE": "و", "U": "و", "YU": "و", "KIRGHIZ YU": "و", "VE": "و", "E": "ی", "YEH BARREE": "ی", "AE": "ه",
    "HIGH HAMZA ALEF": "ا", "HIGH HAMZA WAW": "و", "U WITH HAMZA ABOVE": "و", "HIGH HAMZA YEH": "ی", "DOTLESS BEH": "ب", "DOTLESS QAF": "ق", "DOTLESS FEH": "ف", "ROHINGYA YEH": "ی", "LOW ALEF": "ا", "BURUSHASKI YEH BARREE": "ی", "STRAIGHT WAW": "و", "HAMZA ON HIGH": "ء", "AFRICAN FEH": "ف", "AFRICAN QAF": "ق", "AFRICAN NOON": "ن",
}
_STAY = set(LETTERS) | set("ءأؤإئةۀ")


@lru_cache(None)
def unification() -> dict[str, str]:
    """The aligned character map: variants of letters, positional shapes and quotation marks, each to one Persian character.

    Positional shapes follow the character database; letters with further dots or marks follow their name's base letter.
    Arabic kaf and yeh become the Persian ones."""
    out = {"“": '"', "”": '"', "ك": "ک", "ي": "ی", "ى": "ی"}
    for o in [*range(0x620, 0x700), *range(0x750, 0x780), *range(0x8A0, 0x8B5), *range(0x8B6, 0x8BE)]:
        c = chr(o)
        if ud.category(c) != "Lo" or c in _STAY or c in out:
            continue
        name = ud.name(c, "").removeprefix("ARABIC LETTER ")
        to = _BASES.get(name) or _BASES.get(re.split(" WITH ", name)[0])
        if to and to != c:
            out[c] = to
    for o in [*range(0xFB50, 0xFBB2), *range(0xFBD3, 0xFC00), *range(0xFE80, 0xFEF5)]:
        form = ud.normalize("NFKC", chr(o))
        if len(form) == 1 and ud.category(chr(o)) != "Cn":
            out[chr(o)] = out.get(form, form)
    return out


def make_trans(source: str, target: str) -> dict[str, str]:
    """A character map of two strings: the shorter one ends it, of a repeated source the last pair counts."""
    return dict(zip(source, target))


def translate(text: Column, table: dict[str, str]) -> Column:
    """Every mapped character replaced, all others kept; null stays null."""
    return F.translate(text, "".join(table), "".join(table.values()))


def unify(text: Column, table: dict[str, str] | None = None) -> Column:
    """Character unification; table replaces the aligned map, e.g. to read a corpus made with another one."""
    return translate(text, unification() if table is None else table)


def persian_digits(text: Column) -> Column:
    return translate(text, make_trans(DIGITS_FROM, DIGITS_TO))


def strip_diacritics(text: Column) -> Column:
    return F.regexp_replace(text, DIACRITICS, "")


def spell_out_ligatures(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), LIGATURES, text)


def strip_specials(text: Column) -> Column:
    return F.regexp_replace(text, SPECIALS, "")


def strip_html(text: Column) -> Column:
    """Text outside of tags: an unclosed < takes the rest away, a stray > goes."""
    return F.regexp_replace(text, "<[^>]*>?|>", "")


def trim(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
