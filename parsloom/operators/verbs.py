"""Verb conjugation and the table of verb forms.

A template holds P for the past root, R for the present root and one or two of the ending marks: e past endings,
d present endings, g the same without the second person's, f the seven endings of the perfect."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsloom.functions.tokens import AFTER_VERBS, BEFORE_VERBS

ENDINGS = {
    "e": ["م", "ی", "", "یم", "ید", "ند"],
    "d": ["م", "ی", "د", "یم", "ید", "ند"],
    "g": ["م", "", "د", "یم", "ید", "ند"],
    "f": ["ه‌ام", "ه‌ای", "ه است", "ه", "ه‌ایم", "ه‌اید", "ه‌اند"],
}
#: The paradigm in its order. {e} and the like stand for endings.
PARADIGM = """
perfective_past P{e}
negative_perfective_past نP{e}
passive_perfective_past Pه شد{e}
negative_passive_perfective_past Pه نشد{e}
imperfective_past می‌P{e}
negative_imperfective_past نمی‌P{e}
passive_imperfective_past Pه می‌شد{e}
negative_passive_imperfective_past Pه نمی‌شد{e}
past_progressive داشت{e} می‌P{e}
passive_past_progressive داشت{e} Pه می‌شد{e}
present_perfect P{f}
negative_present_perfect نP{f}
subjunctive_present_perfect Pه باش{d}
negative_subjunctive_present_perfect نPه باش{d}
grammatical_present_perfect Pه باش{g}
negative_grammatical_present_perfect نPه باش{g}
passive_present_perfect Pه شد{f}
negative_passive_present_perfect Pه نشد{f}
passive_subjunctive_present_perfect Pه شده باش{d}
negative_passive_subjunctive_present_perfect Pه نشده باش{d}
passive_grammatical_present_perfect Pه شده باش{g}
negative_passive_grammatical_present_perfect Pه نشده باش{g}
imperfective_present_perfect می‌P{f}
negative_imperfective_present_perfect نمی‌P{f}
subjunctive_imperfective_present_perfect می‌Pه باش{d}
negative_subjunctive_imperfective_present_perfect نمی‌Pه باش{d}
passive_imperfective_present_perfect Pه می‌شد{f}
negative_passive_imperfective_present_perfect Pه نمی‌شد{f}
passive_subjunctive_imperfective_present_perfect Pه می‌شده باش{d}
negative_passive_subjunctive_imperfective_present_perfect Pه نمی‌شده باش{d}
present_perfect_progressive داشت{f} می‌P{f}
passive_present_perfect_progressive داشت{f} Pه می‌شد{f}
past_precedent Pه بود{e}
negative_past_precedent نPه بود{e}
passive_past_precedent Pه شده بود{e}
negative_passive_past_precedent Pه نشده بود{e}
imperfective_past_precedent می‌Pه بود{e}
negative_imperfective_past_precedent نمی‌Pه بود{e}
passive_imperfective_past_precedent Pه می‌شده بود{e}
negative_passive_imperfective_past_precedent Pه نمی‌شده بود{e}
past_precedent_progressive داشت{e} می‌Pه بود{e}
passive_past_precedent_progressive داشت{e} Pه می‌شده بود{e}
past_precedent_perfect Pه بود{f}
negative_past_precedent_perfect نPه بود{f}
subjunctive_past_precedent_perfect Pه بوده باش{d}
negative_subjunctive_past_precedent_perfect نPه بوده باش{d}
grammatical_past_precedent_perfect Pه بوده باش{g}
negative_grammatical_past_precedent_perfect نPه بوده باش{g}
passive_past_precedent_perfect Pه شده بود{f}
negative_passive_past_precedent_perfect Pه نشده بود{f}
passive_subjunctive_past_precedent_perfect Pه شده بوده باش{d}
negative_passive_subjunctive_past_precedent_perfect Pه نشده بوده باش{d}
passive_grammatical_past_precedent_perfect Pه شده بوده باش{g}
negative_passive_grammatical_past_precedent_perfect Pه نشده بوده باش{g}
imperfective_past_precedent_perfect می‌Pه بود{f}
negative_imperfective_past_precedent_perfect نمی‌Pه بود{f}
subjunctive_imperfective_past_precedent_perfect می‌Pه بوده باش{d}
negative_subjunctive_imperfective_past_precedent_perfect نمی‌Pه بوده باش{d}
passive_imperfective_past_precedent_perfect Pه می‌شده بود{f}
negative_passive_imperfective_past_precedent_perfect Pه نمی‌شده بود{f}
passive_subjunctive_imperfective_past_precedent_perfect Pه می‌شده بوده باش{d}
negative_passive_subjunctive_imperfective_past_precedent_perfect Pه نمی‌شده بوده باش{d}
past_precedent_perfect_progressive داشت{f} می‌Pه بود{f}
passive_past_precedent_perfect_progressive داشت{f} Pه می‌شده بود{f}
perfective_present R{d}
negative_perfective_present نR{d}
subjunctive_perfective_present بR{d}
negative_subjunctive_perfective_present نR{d}
grammatical_perfective_present بR{g}
negative_grammatical_perfective_present نR{g}
passive_perfective_present Pه شو{d}
negative_passive_perfective_present Pه نشو{d}
passive_subjunctive_perfective_present Pه بشو{d}
negative_passive_subjunctive_perfective_present Pه نشو{d}
passive_grammatical_perfective_present Pه بشو{g}
negative_passive_grammatical_perfective_present Pه نشو{g}
imperfective_present می‌R{d}
negative_imperfective_present نمی‌R{d}
passive_imperfective_present Pه می‌شو{d}
negative_passive_imperfective_present Pه نمی‌شو{d}
present_progressive دار{d} می‌R{d}
passive_present_progressive دار{d} Pه می‌شو{d}
perfective_future خواه{d} P
negative_perfective_future نخواه{d} P
passive_perfective_future Pه خواه{d} شد
negative_passive_perfective_future Pه نخواه{d} شد
imperfective_future می‌خواه{d} P
negative_imperfective_future نمی‌خواه{d} P
passive_imperfective_future Pه می‌خواه{d} شد
negative_passive_imperfective_future Pه نمی‌خواه{d} شد
future_precedent Pه خواه{d} بود
negative_future_precedent نPه خواه{d} بود
passive_future_precedent Pه شده خواه{d} بود
negative_passive_future_precedent Pه نشده خواه{d} بود
future_precedent_imperfective می‌Pه خواه{d} بود
negative_future_precedent_imperfective نمی‌Pه خواه{d} بود
passive_future_precedent_imperfective Pه می‌شده خواه{d} بود
negative_passive_future_precedent_imperfective Pه نمی‌شده خواه{d} بود
"""


def templates() -> list[tuple[int, str, int, str]]:
    """(index, tense, person, template) of all forms of a verb in their order; index 0 is the infinitive."""
    out = [(0, "infinitive", 0, "Pن")]
    for line in PARADIGM.strip().split("\n"):
        tense, pattern = line.split(" ", 1)
        kind = re.search(r"\{(\w)\}", pattern)[1]
        for person, ending in enumerate(ENDINGS[kind]):
            out.append((len(out), tense, person, re.sub(r"\{\w\}", ending, pattern)))
    return out


def conjugation_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(templates(), "ix int, tense string, person int, template string")


def conjugate(roots: DataFrame, tenses: list[str] | None = None) -> DataFrame:
    """roots (ix, past, present) with form_ix, tense, person, form: every form of every root, or those of some tenses.

    The templates are a fixed list and travel as one literal array, so nothing is joined. Null roots give null forms."""
    chosen = [t for t in templates() if tenses is None or t[1] in tenses]
    if not chosen:
        raise ValueError(f"no such tense: {tenses}")
    each = F.explode(F.from_json(F.lit(_json(chosen)), "array<struct<i:int,t:string,p:int,f:string>>")).alias("_t")
    form = F.replace(F.replace(F.col("_t.f"), F.lit("P"), F.col("past")), F.lit("R"), F.col("present"))
    return roots.select("ix", "past", "present", each).select("ix", "past", "present", F.col("_t.i").alias("form_ix"), F.col("_t.t").alias("tense"), F.col("_t.p").alias("person"), form.alias("form"))


def _json(rows: list[tuple]) -> str:
    import json

    return json.dumps([dict(zip("itpf", r)) for r in rows], ensure_ascii=False)


def verb_forms(roots: DataFrame, joined: bool = True, keep_empty_past: bool = True) -> DataFrame:
    """(form, lemma): each verb form and its past#present; of a shared form the earliest root counts.

    joined adds participles and roots joined to auxiliaries by _, which come before plain forms. keep_empty_past leaves the
    root without a past (and its bare endings as forms) in. One shuffle by form with partial aggregation."""
    if not keep_empty_past:
        roots = roots.where("past <> ''")
    lemma = F.concat("past", F.lit("#"), "present").alias("lemma")
    plain = conjugate(roots).select("form", lemma, F.struct(F.lit(1).alias("turn"), "ix").alias("rank"))
    every = plain
    if joined:
        after = F.explode(F.array(*map(F.lit, AFTER_VERBS))).alias("aux")
        before = F.explode(F.array(*map(F.lit, BEFORE_VERBS))).alias("aux")
        rank = F.struct(F.lit(0).alias("turn"), "ix").alias("rank")
        for prefix in ("", "ن"):
            every = every.unionByName(roots.select("ix", "past", "present", after).select(F.concat(F.lit(prefix), "past", F.lit("ه_"), "aux").alias("form"), lemma, rank))
        every = every.unionByName(roots.select("ix", "past", "present", before).select(F.concat("aux", F.lit("_"), "past").alias("form"), lemma, rank))
    seed = roots.sparkSession.createDataFrame([("است", "#است")], "form string, lemma string").select("form", "lemma", F.struct(F.lit(2).alias("turn"), F.lit(-1).alias("ix")).alias("rank"))
    return every.unionByName(seed).where("form is not null").groupBy("form").agg(F.min_by("lemma", "rank").alias("lemma"))
