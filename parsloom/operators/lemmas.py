"""Lemmatization and compound splitting by joins with dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsloom.functions.chars import ZWNJ
from parsloom.functions.stem import stem
from parsloom.operators.dims import sized


def lemmatize(df: DataFrame, lexicon: DataFrame, verb_forms: DataFrame, word: str = "word", pos: str | None = None, into: str = "lemma", map_tags: bool = False) -> DataFrame:
    """df with the lemma of a word column.

    In this order: a word of the lexicon without a tag stays; a verb form (tag empty or VERB) becomes past#present; an
    adjective in ی and a pronoun stay; a word of the lexicon stays; a stem of the lexicon is taken; else the word stays.
    A null tag counts as empty, a null word has a null lemma; repeated rows stay. map_tags reads V as VERB. Each probe is a
    left join on distinct keys, broadcast where the table's size is checked to be small. Raises ValueError where df has a
    column of the new one's name."""
    if into.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column {into} exists already")
    tag = F.coalesce(F.col(f"`{pos}`"), F.lit("")) if pos else F.lit("")
    if map_tags:
        tag = F.when(tag == "V", "VERB").otherwise(tag)
    w = F.col(f"`{word}`")
    base = df.select("*", w.alias("_w"), stem(w).alias("_s"), tag.alias("_t"))
    words = sized(lexicon.select("word").where("word is not null").distinct())
    out = (
        base.join(words.select(F.col("word").alias("_w"), F.lit(True).alias("_in")), "_w", "left")
        .join(words.select(F.col("word").alias("_s"), F.lit(True).alias("_stem_in")), "_s", "left")
        .join(sized(verb_forms.select(F.col("form").alias("_w"), F.col("lemma").alias("_verb"))), "_w", "left")
    )
    known = F.col("_in").isNotNull()
    lemma = (
        F.when((F.col("_t") == "") & known, F.col("_w"))
        .when(F.col("_t").isin("", "VERB") & F.col("_verb").isNotNull(), F.col("_verb"))
        .when(F.col("_t").startswith("ADJ") & F.col("_w").endswith("ی"), F.col("_w"))
        .when(F.col("_t") == "PRON", F.col("_w"))
        .when(known, F.col("_w"))
        .when(F.col("_stem_in").isNotNull(), F.col("_s"))
        .otherwise(F.col("_w"))
    )
    return out.select(*[F.col(f"`{c}`") for c in df.columns], lemma.alias(into))


def split_candidates(token: Column) -> Column:
    """The ways to cut a token, in order: at all its joiners, in two anywhere beside a joiner, and whole."""
    n = F.length(token)
    at = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    free = F.filter(at, lambda i: (F.substring(token, i, F.lit(1)) != ZWNJ) & (F.substring(token, i + 1, F.lit(1)) != ZWNJ))
    pairs = F.transform(free, lambda i: F.array(F.substring(token, F.lit(1), i), F.substring(token, i + 1, n)))
    joined = F.when(token.contains(ZWNJ), F.array(F.split(token, ZWNJ, -1))).otherwise(F.array().cast("array<array<string>>"))
    return F.concat(joined, pairs, F.array(F.array(token)))


def split_tokens(df: DataFrame, lexicon: DataFrame, verb_forms: DataFrame, token: str = "token", into: str = "splits") -> DataFrame:
    """(token, splits) for every distinct token: the cuts of which each part, or its lemma, is in the lexicon.

    Null tokens are left out; a token without such a cut has the empty array. Tokens are made distinct first, parts are
    judged once each, and a cut stands if as many parts as it has are found."""
    tokens = df.select(F.col(f"`{token}`").alias("token")).where("token is not null").distinct()
    cuts = tokens.select("token", F.posexplode(split_candidates(F.col("token"))).alias("cut", "parts"))
    parts = cuts.select("token", "cut", "parts", F.explode("parts").alias("part"))
    distinct = parts.select(F.col("part").alias("word")).distinct()
    judged = lemmatize(distinct, lexicon, verb_forms)
    words = sized(lexicon.select("word").where("word is not null").distinct())
    good = judged.join(words.select(F.col("word").alias("lemma"), F.lit(True).alias("_l")), "lemma", "left").join(words.select("word", F.lit(True).alias("_w")), "word", "left")
    good = good.where("_l is not null or _w is not null").select(F.col("word").alias("part"))
    whole = parts.join(sized(good), "part").groupBy("token", "cut", "parts").agg(F.count("*").alias("n")).where(F.col("n") == F.size("parts"))
    per_token = whole.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("cut", "parts"))).alias("c"))
    kept = F.transform(F.col("c"), lambda s: s["parts"])
    # the whole token once, even where cutting gives it again
    return tokens.join(per_token, "token", "left").select("token", F.coalesce(F.array_distinct(kept), F.array().cast("array<array<string>>")).alias(into))
