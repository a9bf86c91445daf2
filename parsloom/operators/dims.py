"""Dimension tables: lexicon, verb roots, stopwords, abbreviations, informal words and verbs; and how they travel.

The tables are parameters: they come from files in the usual formats, from a corpus, or from literal rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsloom.functions.chars import trim

#: Bytes, in files or rows at hand, up to which a dimension table is broadcast, and rows up to which one may travel as sets.
BROADCAST_BYTES, BROADCAST_ROWS = 16 * 1024 * 1024, 2_000_000
#: Steps of a plan that may give more bytes than they take.
_GROWING = ("Generate", "Join", "Expand", "InPandas", "InArrow", "Union", "Python", "Window")

LEXICON = "word string, frequency bigint, pos_tags array<string>"


def sized(dim: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """dim with a broadcast hint where its plan proves its size: files or rows of at most limit bytes, and steps that only make them
    fewer. All else is left to adaptive execution, which broadcasts what turns out to be small. Nothing runs for it."""
    plan = dim._jdf.queryExecution().optimizedPlan()
    if int(plan.stats().sizeInBytes()) > limit or any(step in plan.toString() for step in _GROWING):
        return dim
    return F.broadcast(dim)


def lexicon_from_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """A lexicon of (word, frequency) or (word, frequency, tags) rows."""
    return spark.createDataFrame([(r[0], int(r[1]), list(r[2]) if len(r) > 2 else []) for r in rows], LEXICON)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon file: word, frequency and comma-separated tags by tab. Lines of other shapes or without a number are
    skipped; of a repeated word the last line counts."""
    lines = spark.read.text(path).select(F.split("value", "\t", -1).alias("c"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    rows = lines.where(F.size("c") == 3).select(F.col("c")[0].alias("word"), F.expr("try_cast(c[1] as bigint)").alias("frequency"), F.split(F.col("c")[2], ",").alias("pos_tags"), "f", "i").where("frequency >= 0")
    return rows.groupBy("word").agg(F.max_by(F.struct("frequency", "pos_tags"), F.struct("f", "i")).alias("r")).select("word", "r.*")


def lexicon_from(tokens: DataFrame, token: str = "token") -> DataFrame:
    """A lexicon counted from a table of tokens; null and empty tokens are left out."""
    t = F.col(f"`{token}`")
    return tokens.where(t.isNotNull() & (t != "")).groupBy(t.alias("word")).agg(F.count("*").alias("frequency")).withColumn("pos_tags", F.array().cast("array<string>"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ix", "line")).where("line <> ''")


def read_verb_roots(spark: SparkSession, path: str) -> DataFrame:
    """(ix, past, present) of a file of past#present lines, ix being the order of the lines; an empty past root is kept."""
    parts = _lines(spark, path).select("ix", F.split("line", "#", 2).alias("p")).where(F.size("p") == 2)
    return parts.select("ix", trim(F.col("p")[0]).alias("past"), trim(F.col("p")[1]).alias("present"))


def verb_roots_from_rows(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "ix int, past string, present string")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A file of one word a line (stopwords, abbreviations): trimmed, once each."""
    return spark.read.text(path).select(trim(F.col("value")).alias("word")).where("word <> ''").distinct()


def sorted_words(words: DataFrame) -> DataFrame:
    """Distinct words in code point order."""
    return words.select("word").distinct().orderBy("word")


def read_informal_words(spark: SparkSession, path: str) -> DataFrame:
    """(informal, formal): split at the first blank; of a repeated word the last line counts."""
    parts = _lines(spark, path).select("ix", F.split(trim(F.col("line")), " ", 2).alias("p")).where(F.size("p") == 2)
    rows = parts.select("ix", F.col("p")[0].alias("informal"), F.col("p")[1].alias("formal"))
    return rows.groupBy("informal").agg(F.max_by("formal", "ix").alias("formal"))


def read_informal_verbs(spark: SparkSession, path: str) -> DataFrame:
    """(ix, past, present, informal_present, flag) of lines past#present informal_present flag."""
    parts = _lines(spark, path).select("ix", F.split(trim(F.col("line")), " ").alias("p")).where(F.size("p") >= 3)
    root = F.split(F.col("p")[0], "#")
    return parts.select("ix", root[0].alias("past"), root[1].alias("present"), F.col("p")[1].alias("informal_present"), (F.col("p")[2] == "1").alias("flag"))


def past_roots(roots: DataFrame) -> DataFrame:
    return roots.select("ix", F.col("past").alias("root"))


def present_roots(roots: DataFrame) -> DataFrame:
    return roots.select("ix", F.col("present").alias("root"))


def known(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """The rows whose word is in the lexicon (semi join)."""
    return words.join(sized(lexicon.select(F.col("word").alias(word))), word, "left_semi")


def unknown(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """The rows whose word isn't in the lexicon (anti join); null words stay."""
    return words.join(sized(lexicon.select(F.col("word").alias(word))), word, "left_anti")
