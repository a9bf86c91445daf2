"""Lines repeated in excess within one source (problem 4).

Each line is compared by its consistent form. The lines that meet the exact shares of their source are removed by an
anti-join and the rest put together by position. A line's frequency within its source is set against its frequency in
the other sources by a log-likelihood ratio; the false-discovery rate over all tests is held by Benjamini and
Hochberg's step-up rule, taken from a histogram of the p-values so that no task or driver sees all of them. The test
says which of the lines are more than chance; it drops none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parsloom.llm.canon import Canon, canon
from parsloom.llm.common import few, written

LEAST_DOCS, LEAST_SHARE, FALSE_DISCOVERY = 3, 0.05, 0.01
#: Bins of the histogram of p-values; each is a quarter of a power of e wide, down to e**-750.
BINS = 3000
_BLANKS = re.compile(r"\s+")


def line_hash(line: str, form: Canon) -> int | None:
    """A 64-bit hash of a line's consistent form, white space runs made one blank; None for a blank line."""
    form = _BLANKS.sub(" ", form(line)).strip()
    return int.from_bytes(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if form else None


def network(name: Column) -> Column:
    """A network, ignoring case and outer blanks; null for null and blank."""
    clean = F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+\z", ""))
    return F.when(clean != "", clean)


def host(url: Column) -> Column:
    """The url's host in lower case without port and a leading www.; null for null and for what has no host."""
    found = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    found = F.regexp_replace(found, r"^www\.", "")
    return F.when(found != "", found)


def lines_of(df: DataFrame, key: Column, source: Column, text: Column, table: str, counts: dict[str, int] | None = None) -> DataFrame:
    """(source_table, source, doc_key, line_no, line) of every line that isn't blank, line as a hash, and one row with a null
    line_no for each text with any character, by which the texts are counted. counts are those the consistent form is made with.

    Rows without source, and null, empty and blank texts, have no lines. Null keys are left out."""
    cols = df.select(key.cast("string").alias("k"), source.alias("s"), text.alias("t")).where(F.col("k").isNotNull() & F.col("s").isNotNull() & F.col("t").isNotNull() & (F.col("t") != ""))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int | None] = {}
        form = canon(True, counts)
        for b in batches:
            which, no, line = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if t.strip():
                    which.append(i), no.append(None), line.append(None)
                for j, x in enumerate(t.split("\n")):
                    if x and not x.isspace():
                        h = memo.get(x, 0)
                        if h == 0:
                            h = line_hash(x, form)
                            if len(x) < 200:
                                if len(memo) > 50_000:
                                    memo.clear()
                                memo[x] = h
                        if h is not None:
                            which.append(i), no.append(j), line.append(h)
            take = pa.array(which, pa.int32())
            yield pa.record_batch([b.column(1).take(take), b.column(0).take(take), pa.array(no, pa.int64()), pa.array(line, pa.int64())], ["source", "doc_key", "line_no", "line"])

    return cols.mapInArrow(cut, "source string, doc_key string, line_no bigint, line bigint").withColumn("source_table", F.lit(table))


def _g2(k: str, n: str, ko: str, no: str) -> Column:
    """Twice the log-likelihood ratio of k of n within against ko of no outside, with half a line added outside."""
    k, n = F.col(k).cast("double"), F.col(n).cast("double")
    ko, no = F.col(ko) + F.lit(0.5), F.col(no) + F.lit(1.0)
    p = (k + ko) / (n + no)
    term = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(F.lit(0.0))
    return 2 * (term(k, n * p) + term(n - k, n * (1 - p)) + term(ko, no * p) + term(no - ko, no * (1 - p)))


def _minus_log_p(g2: Column) -> Column:
    """-ln of the upper tail of chi-square with one degree of freedom, by the normal tail's continued bound."""
    z = F.sqrt(g2)
    return F.when(g2 <= 0, F.lit(0.0)).otherwise(g2 / 2 + F.log(z * 0.5 + F.sqrt(z * z / 4 + F.lit(2 / 3.141592653589793))) + F.lit(0.5 * 0.4515827052894548))


def excess_lines(lines: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """(source_table, source, line, docs, texts, g2, significant) of the lines repeated in excess within their source.

    The exact shares alone decide which lines those are; significant tells whether the test finds the line above what the
    other sources have, which it can't where all sources repeat it or there is no other. docs counts distinct keys. A line outside its source counts where it isn't itself in that share of a source, so that a
    phrase which every source repeats isn't excused by the others. Every line of every source is a test and counts outside the
    others, those of a single text too. Rows are pre-aggregated by (source, line, key), so one
    source with a third of all rows is spread over its lines; the totals of a source come from partial counts."""
    group = ["source_table", "source"]
    once = lines.where(F.col("line").isNotNull()).groupBy(*group, "line", "doc_key").agg(F.lit(1).alias("one"))
    within = once.groupBy(*group, "line").agg(F.count("one").alias("docs"))
    texts = lines.where(F.col("line").isNull()).groupBy(*group, "doc_key").agg(F.lit(1).alias("one")).groupBy(*group).agg(F.count("one").alias("texts"))
    texts = few(texts)  # a row for each source: a source with a third of all lines isn't brought into one task
    share = F.col("docs") >= F.greatest(F.lit(float(least_docs)), F.col("texts") * F.lit(least_share))
    tested = within.join(texts, group).withColumn("much", share)
    # outside a source: the other sources' documents, without the sources that repeat the line themselves
    total = texts.groupBy("source_table").agg(F.sum("texts").alias("all_texts"))
    everywhere = Window.partitionBy("source_table", "line")  # a row for each source that has the line
    scored = (
        tested.withColumn("ordinary", F.sum(F.when(~F.col("much"), F.col("docs")).otherwise(0)).over(everywhere))
        .withColumn("excessive", F.sum(F.when(F.col("much"), F.col("texts")).otherwise(0)).over(everywhere))
        .join(F.broadcast(total), "source_table")  # one row for each table
        .withColumn("out_docs", F.col("ordinary") - F.when(F.col("much"), F.lit(0)).otherwise(F.col("docs")))
        .withColumn("out_texts", F.greatest(F.col("all_texts") - F.col("excessive") - F.when(F.col("much"), F.lit(0)).otherwise(F.col("texts")), F.col("out_docs")))
        .withColumn("g2", F.when(F.col("docs") * (F.col("out_texts") + 1) > (F.col("out_docs") + 0.5) * F.col("texts"), _g2("docs", "texts", "out_docs", "out_texts")).otherwise(F.lit(0.0)))
        .withColumn("bin", F.least(F.floor(_minus_log_p(F.col("g2")) * 4), F.lit(BINS)).cast("int"))
    )
    scored = written(scored.select(*group, "line", "docs", "texts", "g2", "bin", "much"))
    histogram = {r["bin"]: r["n"] for r in scored.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # BINS + 1 rows at most
    tests, rank, cut = sum(histogram.values()), 0, BINS + 1
    for b in sorted(histogram, reverse=True):
        rank += histogram[b]
        # every p-value of the bin is at most e**(-b/4): the step-up rule holds for the bin's last rank
        if -b / 4 <= _log(rank * false_discovery / max(1, tests)):
            cut = b
    return scored.where("much").select(*group, "line", "docs", "texts", "g2", (F.col("bin") >= cut).alias("significant"))


def _log(x: float) -> float:
    import math

    return math.log(x) if x > 0 else -math.inf


def repeated_lines(lines: DataFrame, **limits: float) -> DataFrame:
    """(source_table, doc_key, line_no) of every line in excess. lines is read twice: hand it over written."""
    # a line of most records is met where it lies, not in one task
    found = few(excess_lines(lines, **limits).select("source_table", "source", "line"))
    return lines.where(F.col("line").isNotNull()).join(found, ["source_table", "source", "line"], "left_semi").select("source_table", "doc_key", "line_no").distinct()


def without_lines(df: DataFrame, key: Column, text: Column, found: DataFrame) -> DataFrame:
    """(doc_key, text) of df's rows, one for each key, without the found (doc_key, line_no): the other lines in their order.

    Null texts stay null, empty ones empty; a text of found lines only becomes empty. Texts with a found line are taken apart,
    anti-joined on key and position and put together by position; the others stay where they are."""
    docs = df.select(key.cast("string").alias("doc_key"), text.alias("text"))
    touched = found.select("doc_key").distinct()
    lines = docs.join(touched, "doc_key", "left_semi").select("doc_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    left = lines.join(found.select("doc_key", F.col("line_no").cast("int").alias("line_no")), ["doc_key", "line_no"], "left_anti")
    again = left.groupBy("doc_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("left"))
    out = docs.join(touched.withColumn("_touched", F.lit(True)), "doc_key", "left").join(again, "doc_key", "left")
    return out.select("doc_key", F.when(F.col("_touched"), F.coalesce("left", F.lit(""))).otherwise(F.col("text")).alias("text"))
