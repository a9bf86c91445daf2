"""Expressions against golden cases and against plain Python."""

import pytest
from pyspark.sql import functions as F

from parsloom.functions import chars, rules, vectors
from parsloom.functions import tokens as tk
from parsloom.functions.stem import stem
from parsloom.plans import samples

Z = "‌"


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_unification_is_aligned(spark):
    assert one(spark, chars.unify, "كتاب يك “نقل”", "ﺗﻬﺮﺍﻥ", "ۍڪ", "", None) == ["کتاب یک \"نقل\"", "تهران", "یک", "", None]
    assert all(len(a) == len(b) == 1 for a, b in chars.unification().items())


def test_make_trans_last_wins_and_shorter_ends():
    assert chars.make_trans("aab", "xy") == {"a": "y"}


def test_digits_diacritics_specials_ligatures(spark):
    assert one(spark, chars.persian_digits, "5 درصد %٣", None) == ["۵ درصد ٪۳", None]
    assert one(spark, chars.strip_diacritics, "حَذفِ اِعراب") == ["حذف اعراب"]
    assert one(spark, chars.strip_specials, "پیامبر اکرم ﷺ") == ["پیامبر اکرم "]
    assert one(spark, chars.spell_out_ligatures, "۱۰ ﷼ ﷲ ﻻ") == ["۱۰ ریال الله لا"]
    for f in (chars.persian_digits, chars.strip_diacritics, chars.strip_specials):
        a = one(spark, f, "۱ 2 مِتن ﷺ")
        assert one(spark, f, *a) == a


def test_style_and_spacing(spark):
    assert one(spark, rules.persian_style, '"نرمال‌سازی"', "و ...", "3.14") == ["«نرمال‌سازی»", "و …", "3٫14"]
    assert one(spark, rules.extra_space, " الف  ب\r\n\n\n\nج ", "ab \n") == ["الف ب\n\nج", "ab \n"]
    assert one(spark, rules.affix_space, "کتاب های من", "خانه ی ما", "می روم", "خانه ام.") == ["کتاب‌های من", "خانه‌ی ما", "می‌روم", "خانه‌ام."]
    assert one(spark, rules.punctuation_space, "سلام ، خوبی؟بله", "( متن )", "۵کتاب") == ["سلام، خوبی؟ بله", "(متن)", "۵ کتاب"]
    assert one(spark, rules.fewer_repeats, "سلاممممم", "aaaa") == ["سلامم", "aaaa"]


def test_html(spark):
    assert one(spark, chars.strip_html, "<b>الف</b> > ب <unclosed", None) == ["الف  ب ", None]


def test_sentences(spark):
    assert one(spark, tk.sentences, "جدا کردن ساده است. تقریبا البته!", "چطوری؟ خوبم.", "", "الف\n\nب\nج", None) == [["جدا کردن ساده است.", "تقریبا البته!"], ["چطوری؟", "خوبم."], [], ["الف", "ب ج"], None]


def test_words(spark):
    out = one(spark, tk.words, "این جمله (خیلی) پیچیده نیست!!!", "1.5 12:30 a,b", "الف\rب", "", None)
    assert out[0] == ["این", "جمله", "(", "خیلی", ")", "پیچیده", "نیست", "!!!"]
    assert out[1:] == [["1.5", "12:30", "a,b"], ["الف\rب"], [], None]


@pytest.mark.parametrize(
    ("tokens", "joined"),
    [
        ("رفته است", "رفته_است"),
        ("گفته شده است", "گفته_شده_است"),
        ("خواهد رفت", "خواهد_رفت"),
        ("او رفته بود .", "او رفته_بود ."),
        ("او خواهد", "او"),  # a dangling auxiliary is lost
        ("خواهد", "خواهد"),
        ("", ""),
    ],
)
def test_verb_parts(spark, tokens, joined):
    parts = tk.participles_of(p for p, _ in samples.VERBS)
    assert one(spark, lambda c: F.array_join(tk.join_verb_parts(F.filter(F.split(c, " "), lambda t: t != ""), parts), " "), tokens) == [joined]


def test_dangling_auxiliary_can_be_kept(spark):
    assert one(spark, lambda c: F.array_join(tk.join_verb_parts(F.split(c, " "), ["رفته"], True), " "), "او خواهد") == ["او خواهد"]


def test_masks(spark):
    assert one(spark, tk.mask_emails, "به a.b@x.org!") == ["به  EMAIL !"]
    assert one(spark, tk.mask_hashtags, "#الف_ب ج_د", "a # b") == ["TAG الف ب ج_د", "a # b"]
    assert one(spark, tk.mask_numbers, "۱۲۳ و 4.5") == [" NUM3  و  NUMF "]
    assert one(spark, tk.mask_accounts, "@u_1 x@y") == [" ID  x@y"]


@pytest.mark.parametrize(("word", "out"), [("کتاب‌ها", "کتاب"), ("کتابی", "کتاب"), ("کتاب‌هایی", "کتاب"), ("اندیشه‌اش", "اندیشه"), ("خانۀ", "خانه"), ("دم", "دم"), ("ها", ""), ("", ""), (None, None)])
def test_stem(spark, word, out):
    assert one(spark, stem, word) == [out]


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, 0.0, None]
