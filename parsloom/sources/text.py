"""How text files come in: whole, by line, in blocks; always with the file they are from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def from_file() -> Column:
    return F.col("_metadata.file_path").alias("file")


def _read(spark: SparkSession, path: str | list[str], glob: str | None, recursive: bool):
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.option("recursiveFileLookup", str(recursive).lower()), path


def whole(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, value): one row for each file. For formats whose records lean on the lines before them; a file is one task's work."""
    r, p = _read(spark, path, glob, recursive)
    return r.text(p, wholetext=True).select(from_file(), F.col("value"))


def lines(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, value) by line, for formats of one record a line: files split over tasks at any size."""
    r, p = _read(spark, path, glob, recursive)
    return r.text(p).select(from_file(), F.col("value"))


def numbered_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, line_no, line) like numbered, of files that split over tasks at any size.

    The lines of a split are counted first; a split's lines are numbered from the sum of those before it in its file, which are
    as many rows as there are splits. A carriage return before a line end goes."""
    r, p = _read(spark, path, glob, recursive)
    placed = r.option("lineSep", "\n").text(p).select(from_file(), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"), F.regexp_replace("value", "\r\\z", "").alias("line"))
    splits = placed.groupBy("file", "_at").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = W.partitionBy("file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), ["file", "_at"]).select("file", (F.col("_i") - F.col("_first") + F.col("_before")).cast("int").alias("line_no"), "line")


def numbered(df: DataFrame, value: str = "value") -> DataFrame:
    """(file, line_no, line) of whole files, numbered from 0; a final line end begins no line, and a carriage return before a line end goes."""
    body = F.regexp_replace(F.col(value), "\n\\z", "")
    return df.select("file", F.posexplode(F.when(F.col(value) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\r?\n", -1))).alias("line_no", "line"))


def blocks(df: DataFrame, clean: Column | None = None) -> DataFrame:
    """(file, block, lines) of whole files, cut at blank lines; blocks without a line are none. Blocks are numbered within the file."""
    body = F.regexp_replace(clean if clean is not None else F.col("value"), "\r\n", "\n")
    parts = F.filter(F.split(body, r"(?U)\n[^\S\n]*(?:\n[^\S\n]*)+", -1), lambda b: ~b.rlike(r"(?U)\A\s*\z"))
    return df.select("file", F.posexplode(parts).alias("block", "_b")).select("file", "block", F.filter(F.split("_b", "\n", -1), lambda x: ~x.rlike(r"(?U)\A\s*\z")).alias("lines"))


def as_sentences(df: DataFrame) -> DataFrame:
    """(file, sent_ix, tokens) with tokens as an array of (token, tag), without empty sentences."""
    return df.where(F.size("tokens") > 0).select("file", F.col("block").cast("int").alias("sent_ix"), "tokens")


def words(sentences: DataFrame) -> DataFrame:
    """(file, sent_ix, tok_ix, token) of a corpus of tagged sentences."""
    return tagged_words(sentences).drop("tag")


def tagged_words(sentences: DataFrame) -> DataFrame:
    """(file, sent_ix, tok_ix, token, tag)."""
    return sentences.select("file", "sent_ix", F.posexplode("tokens").alias("tok_ix", "t")).select("file", "sent_ix", "tok_ix", "t.token", "t.tag")


def has_name(prefix: str) -> Column:
    """Whether the file's name begins with a subset's name; all takes every file."""
    return F.lit(True) if prefix == "all" else F.regexp_extract(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), "[^/]*$", 0).startswith(prefix)


def file_name() -> Column:
    return F.regexp_extract("file", "[^/]*$", 0)
