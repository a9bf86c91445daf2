"""Informal Persian: conjugated forms, lemmas and formal candidates of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsloom.functions.chars import ZWNJ
from parsloom.functions.tokens import sentences, words
from parsloom.operators.dims import sized
from parsloom.operators.lemmas import lemmatize
from parsloom.operators.normalize import normalize
from parsloom.operators.verbs import templates

#: Suffixes of informal words in the order in which they are tried.
SUFFIXES = [
    "هاست", "هایی", "هایم", "ترین", "ایی", "انی", "شان", "شون", "است", "تان", "تون", "مان", "مون", "هام", "هاش", "های", "طور", "ها", "تر",
    "ئی", "یی", "یم", "ام", "ای", "ان", "هم", "رو", "یت", "ه", "ی", "ش", "و", "ا", "ت", "م",
]
#: Letters that need a joiner before a plural ending.
ADHESIVE = "بپتثجچحخسشصضعغفقکگلمنهی"


def informal_forms(stem: Column) -> Column:
    """The 36 informal present forms of a stem: simple, negated, imperfective and its negative, subjunctive, negated again."""
    third = F.when(stem.endswith("ا"), F.concat(stem, F.lit("د"))).otherwise(F.concat(stem, F.lit("ه")))
    simple = F.array(F.concat(stem, F.lit("م")), F.concat(stem, F.lit("ی")), third, *[F.concat(stem, F.lit(e)) for e in ("یم", "ین", "ن")])
    put = lambda p: F.transform(simple, lambda f: F.concat(F.lit(p), f))
    subjunctive = F.transform(simple, lambda f: F.when(f.startswith("ب"), f).otherwise(F.concat(F.lit("ب"), f)))
    return F.concat(simple, put("ن"), put("می" + ZWNJ), put("نمی" + ZWNJ), subjunctive, put("ن"))


#: Formal tenses of the six blocks of informal forms, where they are paired by meaning.
MEANING = ["perfective_present", "negative_perfective_present", "imperfective_present", "negative_imperfective_present", "subjunctive_perfective_present", "negative_subjunctive_perfective_present"]


def _formal_index(literal: bool) -> list[tuple[int, int, int]]:
    """(flag, informal place, index of the formal form). Literal: both ranges run side by side from fixed places, as the
    behaviour this follows does by mistake."""
    out = []
    first = {}
    for i, tense, person, _ in templates():
        first.setdefault(tense, i)
    for flag, a, b in ((1, 0, 48), (0, 8, 56)):
        for k in range(36):
            if literal:
                if k >= a:
                    out.append((flag, k, b + k - a))
            elif flag or k >= 6:
                out.append((flag, k, first[MEANING[k // 6]] + k % 6))
    return out


def informal_verb_map(informal_verbs: DataFrame, literal: bool = False) -> DataFrame:
    """(form, formal): informal verb forms and the formal ones they stand for.

    By default tense goes to tense and person to person; literal pairs by position instead. Forms with a joiner also come
    without it and with a blank, forms in ین also in د. Of a form met twice the later verb, and the later place, counts.
    informal_verbs: (ix, past, present, informal_present, flag)."""
    spark = informal_verbs.sparkSession
    formal = spark.createDataFrame([(i, t) for i, _, _, t in templates()], "j int, template string")
    places = spark.createDataFrame([(bool(f), k, j) for f, k, j in _formal_index(literal)], "flag boolean, k int, j int")
    pairs = F.broadcast(places.join(formal, "j").select("flag", "k", "template"))  # 66 rows
    forms = informal_verbs.select("ix", "past", "present", "flag", F.posexplode(informal_forms(F.col("informal_present"))).alias("k", "form"))
    rows = forms.join(pairs, ["flag", "k"]).select("ix", "k", "form", F.replace(F.replace("template", F.lit("P"), F.col("past")), F.lit("R"), F.col("present")).alias("formal"))
    has = F.col("form").contains(ZWNJ)
    kinds = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("turn"), F.col("form").alias("f")),
            F.when(has, F.struct(F.lit(1).alias("turn"), F.replace("form", F.lit(ZWNJ), F.lit("")).alias("f"))),
            F.when(has, F.struct(F.lit(2).alias("turn"), F.replace("form", F.lit(ZWNJ), F.lit(" ")).alias("f"))),
            F.when(F.col("form").endswith("ین"), F.struct(F.lit(3).alias("turn"), F.regexp_replace("form", "ین\\z", "د").alias("f"))),
        )
    )
    every = rows.select("ix", "k", "formal", F.explode(kinds).alias("v")).select(F.col("v.f").alias("form"), "formal", F.struct("ix", "k", F.col("v.turn").alias("turn")).alias("rank"))
    return every.groupBy("form").agg(F.max_by("formal", "rank").alias("formal"))


def informal_lexicon(lexicon: DataFrame, informal_words: DataFrame) -> DataFrame:
    """The lexicon with informal words under their formal word's frequency (0 where that is unknown); words it had stay."""
    formal = lexicon.select(F.col("word").alias("formal"), "frequency")
    extra = informal_words.join(sized(formal), "formal", "left").select(F.col("informal").alias("word"), F.coalesce("frequency", F.lit(0)).alias("frequency"))
    every = lexicon.select("word", "frequency", F.lit(0).alias("turn")).unionByName(extra.withColumn("turn", F.lit(1)))
    return every.groupBy("word").agg(F.min_by("frequency", "turn").alias("frequency")).withColumn("pos_tags", F.array().cast("array<string>"))


def informal_forms_table(verb_forms: DataFrame, informal_verbs: DataFrame) -> DataFrame:
    """verb_forms with forms in د also in ن, then informal conjugations; forms that were there stay."""
    spoken = verb_forms.where(F.col("form").endswith("د")).select(F.regexp_replace("form", "د\\z", "ن").alias("form"), "lemma", F.struct(F.lit(1).alias("turn"), F.lit(0).alias("ix")).alias("rank"))
    conjugated = informal_verbs.select("ix", F.concat("past", F.lit("#"), "present").alias("lemma"), F.explode(informal_forms(F.col("informal_present"))).alias("form")).select("form", "lemma", F.struct(F.lit(2).alias("turn"), "ix").alias("rank"))
    base = verb_forms.select("form", "lemma", F.struct(F.lit(0).alias("turn"), F.lit(0).alias("ix")).alias("rank"))
    # among equals of one turn the lesser lemma, so that the result doesn't depend on the order
    return base.unionByName(spoken).unionByName(conjugated).groupBy("form").agg(F.min_by("lemma", F.struct("rank", "lemma")).alias("lemma"))


def informal_surfaces(lexicon: DataFrame, informal_words: DataFrame) -> DataFrame:
    """Surfaces that count as known beside the lexicon: informal words, and words without a final tanwin."""
    tanwin = lexicon.where(F.col("word").endswith("ً")).select(F.regexp_replace("word", "ً\\z", "").alias("word"))
    return informal_words.select(F.col("informal").alias("word")).unionByName(tanwin).distinct()


def lemmatize_informal(df: DataFrame, lexicon: DataFrame, verb_forms: DataFrame, informal_words: DataFrame, informal_verbs: DataFrame, **columns) -> DataFrame:
    """lemmatize with informal words and verb forms known too."""
    return lemmatize(df, informal_lexicon(lexicon, informal_words), informal_forms_table(verb_forms, informal_verbs), **columns)


def stem_maps(roots: DataFrame, informal_verbs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(past map, present map) of (informal, formal): informal stems and the formal ones; formal stems stand for themselves."""
    past = informal_verbs.select(F.col("past").alias("informal"), F.col("past").alias("formal")).unionByName(roots.select(F.col("past").alias("informal"), F.col("past").alias("formal"))).distinct()
    both = informal_verbs.select(F.col("informal_present").alias("informal"), F.col("present").alias("formal"), F.struct(F.lit(0).alias("t"), "ix").alias("rank")).unionByName(
        roots.select(F.col("present").alias("informal"), F.col("present").alias("formal"), F.struct(F.lit(1).alias("t"), "ix").alias("rank"))
    )
    return past, both.groupBy("informal").agg(F.max_by("formal", "rank").alias("formal"))


def _attached(stem: Column, suffix: Column) -> Column:
    """The forms that a stem and a suffix stand for, as an array."""
    last = F.right(stem, F.lit(1))
    joiner = F.when(last.isin(list(ADHESIVE)), F.lit(ZWNJ)).otherwise(F.lit(""))
    plus = lambda s: F.concat(stem, F.lit(s))
    return (
        F.when(suffix == "شون", F.array(plus("شان")))
        .when(suffix == "تون", F.array(plus("تان")))
        .when(suffix == "مون", F.array(plus("مان")))
        .when(suffix == "هام", F.array(F.concat(stem, joiner, F.lit("هایم"))))
        .when(suffix.isin("ها", "ا"), F.array(F.concat(stem, joiner, F.lit("ها"))))
        .when(suffix == "رو", F.array(plus(" را")))
        .when(suffix == "و", F.array(plus(" را"), plus(" و")))
        .when(suffix == "ه", F.array(plus("ه"), plus("ه است"), plus(" است")))
        .otherwise(F.array(F.concat(stem, suffix)))
    )


def formal_candidates(words: DataFrame, verb_map: DataFrame, informal_words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """(word, candidates) of every distinct word: formal words it may stand for, best first.

    A known informal verb form gives one, a known informal word its formal word and itself, a word of the lexicon itself,
    else the suffixes are tried in order, else itself. Null words are left out."""
    distinct = words.select(F.col(f"`{word}`").alias("word")).where("word is not null").distinct()
    known = sized(lexicon.select("word").where("word is not null").distinct())
    iwords = sized(informal_words.select("informal", "formal"))
    probed = (
        distinct.join(sized(verb_map.select(F.col("form").alias("word"), F.col("formal").alias("_verb"))), "word", "left")
        .join(iwords.select(F.col("informal").alias("word"), F.col("formal").alias("_formal")), "word", "left")
        .join(known.withColumn("_in", F.lit(True)), "word", "left")
    )
    rest = probed.where("_verb is null and _formal is null and _in is null").select("word")
    tried = rest.select("word", F.posexplode(F.filter(F.array(*map(F.lit, SUFFIXES)), lambda s: F.endswith(F.col("word"), s) & (F.length("word") > F.length(s)))).alias("_i", "suffix"))
    rank = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.col("suffix"))
    stems = tried.select("word", "suffix", rank.alias("_i"), F.expr("substring(word, 1, length(word) - length(suffix))").alias("stem"))
    found = (
        stems.join(iwords.select(F.col("informal").alias("stem"), F.col("formal").alias("_formal")), "stem", "left")
        .join(known.select(F.col("word").alias("stem"), F.lit(True).alias("_in")), "stem", "left")
        .where("_formal is not null or _in is not null")
        .select("word", "_i", _attached(F.coalesce("_formal", "stem"), F.col("suffix")).alias("forms"))
    )
    analysed = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("_i", "forms"))).alias("a")).select("word", F.array_distinct(F.flatten(F.transform("a", lambda s: s["forms"]))).alias("_analysed"))
    out = probed.join(analysed, "word", "left")
    candidates = (
        F.when(F.col("_verb").isNotNull(), F.array("_verb"))
        .when(F.col("_formal").isNotNull(), F.array("_formal", "word"))
        .when(F.col("_in").isNotNull(), F.array("word"))
        .otherwise(F.coalesce("_analysed", F.array("word")))
    )
    return out.select("word", candidates.alias("candidates"))


def normalize_informal(tokens: DataFrame, verb_map: DataFrame, informal_words: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    """tokens with their candidates; each distinct token is resolved once. Null tokens have null candidates."""
    resolved = formal_candidates(tokens.select(F.col(f"`{token}`").alias("word")), verb_map, informal_words, lexicon)
    return tokens.join(resolved.withColumnRenamed("word", token), token, "left")


def normalize_text(texts: DataFrame, verb_map: DataFrame, informal_words: DataFrame, lexicon: DataFrame, verb_forms: DataFrame, text: str = "text") -> DataFrame:
    """One row for each word of each sentence of the normalized text, in three steps: the normalizer, the cut into sentences and words,
    and the formal words that each may stand for. Adds sent_ix, tok_ix, token and candidates (best first) in place of the text.

    Null and empty texts have no rows. Each distinct token is resolved once. Raises ValueError where df has a column of a new one's name."""
    taken = {"sent_ix", "tok_ix", "token", "candidates", "_normal", "_s"} & {c.lower() for c in texts.columns}
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    kept = [F.col(f"`{c}`") for c in texts.columns if c != text]
    clean = normalize(texts, lexicon, verb_forms, text, "_normal")
    sents = clean.select(*kept, F.posexplode(sentences(F.col("_normal"))).alias("sent_ix", "_s"))
    tokens = sents.select(*kept, "sent_ix", F.posexplode(words(F.col("_s"))).alias("tok_ix", "token"))
    return normalize_informal(tokens, verb_map, informal_words, lexicon).select(*kept, "sent_ix", "tok_ix", "token", "candidates")
