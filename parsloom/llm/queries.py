"""The queries of the corpus-preparation operators, for the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsloom.llm import bpe, canon, leakage, mojibake, quality, repeats, sentences, spans
from parsloom.llm.common import deliveries_once, table, written
from parsloom.operators.tables import over_all_cores


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _common_words(spark: SparkSession, sf_dir: str) -> list[str]:
    """The fixed table of common words (71 rows)."""
    return [r["word"] for r in table(spark, sf_dir, "stopwords").where(F.col("word").isNotNull()).collect()]


def _filled(column: str):
    return F.col(column).isNotNull() & F.col(column).rlike(r"\S")


# 1: statistics and what is no prose
def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = _common_words(spark, sf_dir)
    parts = [
        over_all_cores(table(spark, sf_dir, name).where(_filled("text")).select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("doc_key"), "text"))
        for name, key in (("miras_doc", "line_no"), ("wiki_doc", "id"))
    ]
    return quality.taken_once(_union(parts), common, ["source_table", "doc_key"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(_statistics(spark, sf_dir)).select("source_table", "doc_key").distinct()


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flag_tails(_statistics(spark, sf_dir)).dropDuplicates(["source_table", "doc_key"])


# 2: sentence units
def _units(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    parts = []
    for name in ("wiki_doc", "hamshahri_doc", "persica_doc"):
        docs = table(spark, sf_dir, name).where(_filled("text")).select(F.lit(name).alias("source_table"), F.col("id").cast("string").alias("doc_key"), "text")
        parts.append(sentences.sentence_units(docs, skip_damaged=name == "hamshahri_doc", units="unit" in columns).select("source_table", "doc_key", "end_pos", *columns))
    return _union(parts).dropDuplicates(["source_table", "doc_key", "end_pos"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir, [])


def p2_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir, ["unit"])


# 3: wrong encodings
def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, name).where(_filled(field)).select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("doc_key"), F.lit(field).alias("field"), F.col(field).alias("value"))
        for name, key, field in (("hamshahri_doc", "id", "title"), ("hamshahri_doc", "id", "text"), ("miras_doc", "line_no", "text"))
    ]
    return _union(parts)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.damaged_rows(_fields(spark, sf_dir), "value").select("source_table", "doc_key", "field").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair(_fields(spark, sf_dir), "value").where(F.col("pairs").isNotNull()).select("source_table", "doc_key", "field", "restored", "pairs").dropDuplicates(["source_table", "doc_key", "field"])


# 4: repeated lines
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pn, tn = table(spark, sf_dir, "pn_summary_doc"), table(spark, sf_dir, "tnews_doc")
    counts = _counts(_shown(spark, sf_dir))  # one consistent form for problems 4 and 5
    return written(
        repeats.lines_of(pn, F.col("id"), repeats.network(F.col("network")), F.col("article"), "pn_summary_doc", counts).unionByName(
            repeats.lines_of(tn, F.col("id"), repeats.host(F.col("url")), F.col("text"), "tnews_doc", counts)
        )
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_lines(_lines(spark, sf_dir))


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(p4_found(spark, sf_dir))
    parts = []
    for name, text in (("pn_summary_doc", "article"), ("tnews_doc", "text")):
        docs = deliveries_once(table(spark, sf_dir, name).select("id", text), "id")
        parts.append(repeats.without_lines(docs, F.col("id"), F.col(text), found.where(F.col("source_table") == name)).select(F.lit(name).alias("source_table"), "doc_key", "text"))
    return _union(parts)


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line in excess with its counts, ratio and whether the test finds it above what other sources have."""
    return repeats.excess_lines(_lines(spark, sf_dir))


# 5: one consistent form
def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, key, field in (("hamshahri_doc", "id", "text"), ("wiki_doc", "id", "text"), ("tnews_doc", "id", "text"), ("spell_entry", "entry_id", "misspelled")):
        df = table(spark, sf_dir, name)
        persian = canon.wiki_is_persian(F.col("url")) if name == "wiki_doc" else F.lit(True)
        parts.append(df.where(_filled(field)).select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("doc_key"), F.col(field).alias("shown"), persian.alias("persian")))
    return _union(parts)


def _counts(shown: DataFrame) -> dict[str, int]:
    return canon.member_counts(shown.where("persian"), "shown")


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _shown(spark, sf_dir)
    counts = _counts(shown)
    formed = canon.consistent(shown, "shown", F.col("persian"), counts)
    return formed.where((F.col("source_table") != "hamshahri_doc") | ~mojibake.is_damaged(F.col("shown")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _shown(spark, sf_dir)
    counts = _counts(shown)
    return canon.unlike(shown, "shown", F.col("persian"), counts, skip_damaged=F.col("source_table") == "hamshahri_doc").select("source_table", "doc_key").distinct()


def p5_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir).select("source_table", "doc_key", "consistent").dropDuplicates(["source_table", "doc_key"])


# 6: token ids
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus there and back."""
    return bpe.decode_column(p6_ids(spark, sf_dir)).select("doc_id", F.size("ids").alias("n_ids"), "decoded")


# 7: leaked evaluation texts
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))


# 8: shared spans
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_amounts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_statistics, p2_found, p2_units, p3_found, p3_restored, p4_found, p4_cleaned, p4_report, p5_found, p5_consistent, p6_ids, p6_decoded, p7_found, p7_report, p8_found, p8_shared, p8_passages, p8_classes)}


def _plain_words(text: str) -> str:
    """The words of problem 7 in SQL: one case, no marks, ASCII digits, Persian yeh and kaf."""
    digits = "".join(chr(o + i) for o in (0x6F0, 0x660, 0x966, 0xFF10) for i in range(10))
    plain = f"translate({text}, '{digits}يىك', '{'0123456789' * 4}ییک')"
    plain = f"translate(regexp_replace(nfc_normalize(regexp_replace({plain}, '\\p{{M}}', '', 'g')), '\\p{{M}}', '', 'g'), 'آأإؤئۀ', 'اااویه')"
    return f"regexp_extract_all(lower(strip_accents({plain})), '[\\p{{L}}\\p{{Nd}}]+')"


def oracle_sql() -> dict[str, str]:
    """Problems 7 and 8 by brute force, for small tables: all windows of words, all spans of 300 characters. The others are no SQL."""
    grams = lambda key, table: (
        f"SELECT DISTINCT {key}, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {key}, {_plain_words('text')} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 13)"
    )
    spans_300 = "SELECT DISTINCT doc_id, md5(substr(text, i, 300)) AS span FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)"
    return {
        "p7_found": f"WITH d AS ({grams('doc_id', 'documents')}), q AS ({grams('item_id', 'eval_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN q USING (gram)",
        "p8_found": f"WITH s AS ({spans_300}), many AS (SELECT span FROM s GROUP BY span HAVING count(*) > 1), k AS (SELECT doc_id, span FROM s SEMI JOIN many USING (span)) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.span = b.span AND a.doc_id < b.doc_id",
    }
