"""The same text operators on streams, and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parsloom.functions.tokens import sentences, words


def stream_tokens(stream: DataFrame, text: str = "text") -> DataFrame:
    """One row per word of each arriving text; stateless, so it runs on a stream as on a table."""
    return stream.select("*", F.explode(sentences(F.col(f"`{text}`"))).alias("_s")).select("*", F.explode(words(F.col("_s"))).alias("token")).drop("_s")


def running_counts(stream: DataFrame, text: str = "text") -> DataFrame:
    """(token, c) over all that has arrived: written in update mode it is the unigram table, kept up to date."""
    return stream_tokens(stream, text).groupBy("token").agg(F.count("*").alias("c"))


def running_bigrams(stream: DataFrame, text: str = "text") -> DataFrame:
    from parsloom.operators.ngrams import _pairs

    sents = stream.select(F.explode(sentences(F.col(f"`{text}`"))).alias("s"))
    return sents.select(F.explode(_pairs(words(F.col("s")))).alias("p")).groupBy("p.prev", "p.w").agg(F.count("*").alias("c"))


def windowed_counts(stream: DataFrame, at: str, window: str = "1 hour", late: str = "1 day", text: str = "text") -> DataFrame:
    """(window, token, c) by event time; texts later than `late` behind the newest are left out, and their state is let go."""
    return stream_tokens(stream.withWatermark(at, late), text).groupBy(F.window(at, window), "token").agg(F.count("*").alias("c"))
