"""Readers of annotated and plain corpora. Every reader gives a lazily evaluated DataFrame; rows carry their file and place.

Missing files raise, as everywhere in Spark; malformed rows are skipped as each reader says."""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parsloom.functions import tokens as tk
from parsloom.functions.chars import strip_html, translate, trim
from parsloom.operators.normalize import NormalizerOptions, normalize
from parsloom.sources import text

ZWNJ = "‌"


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """table's value for the key, the key itself where it has none."""
    if not table:
        return key
    return F.coalesce(F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key], key)


def _pair(token: Column, tag: Column) -> Column:
    return F.struct(token.alias("token"), tag.alias("tag"))


def _labelled_blocks(df: DataFrame, sep: str) -> DataFrame:
    """Blocks of token and label by line, cut at the first separator; lines without a label are dropped."""
    cut = F.transform(F.col("lines"), lambda x: F.split(x, sep, 2))
    good = F.filter(cut, lambda p: F.size(p) == 2)
    return text.as_sentences(text.blocks(df).withColumn("tokens", F.transform(good, lambda p: _pair(p[0], p[1]))))


def arman(spark: SparkSession, path: str, subset: str = "all") -> DataFrame:
    """Named-entity sentences of `token label` lines; a blank line ends a sentence, and so does the end of a file. Empty files
    have none and don't stop the others."""
    return _labelled_blocks(text.whole(spark, path, "*.txt").where(text.has_name(subset)), " ")


def ner(spark: SparkSession, path: str) -> DataFrame:
    """As arman with tabs, from all folders below."""
    return _labelled_blocks(text.whole(spark, path, "*.txt", True), "\t")


#: Fine tags and the coarse ones they belong to.
BIJANKHAN_TAGS = {
    "ADJ": "ADJ", "ADJ_CMPR": "ADJ", "ADJ_INO": "V", "ADJ_ORD": "ADJ", "ADJ_SIM": "ADJ", "ADJ_SUP": "ADJ", "ADV": "ADV", "ADV_EXM": "ADV", "ADV_I": "ADV", "ADV_NEGG": "ADV", "ADV_NI": "ADV", "ADV_TIME": "ADV",
    "AR": "AR", "CON": "CONJ", "DEFAULT": "DEFAULT", "DELM": "PUNC", "DET": "DET", "IF": "CONJ", "INT": "INT", "MORP": "MORP", "MQUA": "ADV", "MS": "MS", "N_PL": "N", "N_SING": "N", "NN": "NN", "NP": "NP",
    "OH": "OH", "OHH": "N", "P": "PREP", "PP": "PP", "PRO": "PR", "PS": "PS", "QUA": "DET", "SPEC": "SPEC", "V_AUX": "V", "V_IMP": "V", "V_PA": "V", "V_PRE": "V", "V_PRS": "V", "V_SUB": "V",
}


def bijankhan(spark: SparkSession, path: str, join_verb_parts: bool = True, tags: dict[str, str] | None = None) -> DataFrame:
    """Tagged sentences of `word  TAG` lines. Words # and * are dropped and, as delimiters, end a sentence; so do . ؟ !.
    Words are normalized without the lexicon's steps; an empty word becomes _. Neighbouring verbs are joined by _."""
    rows = text.numbered(text.whole(spark, path)).select("file", "line_no", F.split(trim(F.col("line")), "  ", 2).alias("p")).where(F.size("p") == 2)
    rows = rows.select("file", "line_no", trim(F.col("p")[0]).alias("w"), trim(F.col("p")[1]).alias("t"))
    rows = normalize(rows, text="w", into="n", options=NormalizerOptions.without_lexicon()).withColumn("n", F.when(F.col("n") == "", "_").otherwise(F.col("n")))
    mute = F.col("w").isin("#", "*")
    ends = (F.col("t") == "DELM") & (mute | F.col("n").isin(".", "؟", "!"))
    before = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("block", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0))).where(~mute)
    placed = placed.withColumn("tag", _lookup(F.col("t"), BIJANKHAN_TAGS if tags is None else tags))
    if join_verb_parts:
        w = W.partitionBy("file", "block").orderBy("line_no")
        placed = placed.withColumn("_new", F.when((F.col("tag") == "V") & (F.lag("tag").over(w) == "V"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
        grouped = placed.groupBy("file", "block", "_run").agg(F.array_sort(F.collect_list(F.struct("line_no", "n"))).alias("p"), F.min("line_no").alias("line_no"), F.first("tag").alias("tag"))
        placed = grouped.withColumn("n", F.array_join(F.transform("p", lambda s: s["n"]), "_"))
    sents = placed.groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("n").alias("token"), "tag"))).alias("s"))
    order = W.partitionBy("file").orderBy("block")
    return sents.select("file", (F.row_number().over(order) - 1).alias("sent_ix"), F.transform("s", lambda s: _pair(s["token"], s["tag"])).alias("tokens"))


#: Treebank tags and the coarse and universal ones.
DADEGAN_COARSE = {"N": "N", "V": "V", "ADJ": "AJ", "ADV": "ADV", "PR": "PRO", "PREM": "DET", "PREP": "P", "POSTP": "POSTP", "PRENUM": "NUM", "CONJ": "CONJ", "PUNC": "PUNC", "SUBR": "CONJ"}
DADEGAN_UNIVERSAL = {"N": "NOUN", "V": "VERB", "ADJ": "ADJ", "ADV": "ADV", "PR": "PRON", "PREM": "DET", "PREP": "ADP", "POSTP": "ADP", "PRENUM": "NUM", "CONJ": "CCONJ", "PUNC": "PUNCT", "SUBR": "SCONJ", "IDEN": "PROPN", "POSTNUM": "NUM", "PSUS": "INTJ", "PART": "PART", "ADR": "INTJ"}
#: Further names of tags in the universal edition.
UD_COARSE = {"NOUN": "N", "VERB": "V", "PRON": "PRO", "DET": "DET", "ADP": "P", "NUM": "NUM", "CCONJ": "CONJ", "PUNCT": "PUNC", "SCONJ": "CONJ"}
UD_UNIVERSAL = {"NOUN": "NOUN", "VERB": "VERB", "PRON": "PRON", "DET": "DET", "ADP": "ADP", "NUM": "NUM", "CCONJ": "CCONJ", "PUNCT": "PUNCT", "SCONJ": "SCONJ", "PROPN": "PROPN", "INTJ": "INTJ"}
#: Words that as particles count as adpositions.
ADPOSITIONS = ["را", "خوب", "آخر"]


def _universal(base: Column, word: Column) -> Column:
    return F.when((base == "PART") & word.isin(ADPOSITIONS), F.lit("ADP")).otherwise(base)


def _conll(df: DataFrame, mode: str, coarse: dict[str, str], universal: dict[str, str], ezafe: str, strip: bool, underscore: bool) -> DataFrame:
    def one(c: Column) -> Column:
        word = F.translate(c[1], " ", "_") if underscore else c[1]
        if mode == "coarse":
            tag = F.concat(_lookup(c[3], coarse), F.when(c[5].contains(ezafe), "e").otherwise(""))
        elif mode == "universal":
            tag = _universal(_lookup(c[3], universal), word)
        else:
            tag = F.concat(c[3], F.lit(","), c[5])
        return _pair(word, tag)

    kept = F.filter("lines", lambda x: ~(trim(x) if strip else x).startswith("#"))
    columns = F.transform(kept, lambda x: F.split(trim(x) if strip else x, "\t", -1))
    good = F.filter(columns, lambda c: (F.size(c) >= 6) & ~c[0].contains("-"))
    return text.as_sentences(df.withColumn("tokens", F.transform(good, one)))


def _mode(mode: str) -> str:
    if mode not in ("coarse", "universal", "raw"):
        raise ValueError(f"no such mode: {mode}")
    return mode


def dadegan(spark: SparkSession, path: str, mode: str = "coarse") -> DataFrame:
    """Dependency treebank sentences of tab-separated rows; mode coarse (with e for ezafe), universal or raw (tag,features).
    Comments, rows of fewer than six columns and of ranges are skipped; blanks in words become _."""
    z = "\\x{200C}"
    clean = F.regexp_replace("value", "\r", "")
    for a, b in (("\\x{2029}", ZWNJ), (f"\t{z}", "\t"), (f"{z}\t", "\t"), (" \t", "\t"), ("\t ", "\t"), (z + z, ZWNJ)):
        clean = F.regexp_replace(clean, a, b)
    return _conll(text.blocks(text.whole(spark, path), clean), _mode(mode), DADEGAN_COARSE, DADEGAN_UNIVERSAL, "ezafe", False, True)


def universal_dadegan(spark: SparkSession, path: str, mode: str = "coarse") -> DataFrame:
    """The treebank's universal edition; lines are trimmed, words keep their blanks."""
    return _conll(text.blocks(text.whole(spark, path)), _mode(mode), {**DADEGAN_COARSE, **UD_COARSE}, {**DADEGAN_UNIVERSAL, **UD_UNIVERSAL}, "Ezafe", True, False)


def _xml(spark: SparkSession, path: str | list[str], row: str, schema: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("xml").option("rowTag", row).option("attributePrefix", "_").option("ignoreSurroundingSpaces", "true").option("recursiveFileLookup", "true").schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def _text_of(c: str) -> Column:
    return F.coalesce(trim(F.col(c)), F.lit(""))


def degarbayan(spark: SparkSession, path: str, two_class: bool = False) -> DataFrame:
    """Paraphrase pairs of corpus_pair.xml; judge 1, 0 and -1 become labels, other values stay. two_class counts 0 as a paraphrase."""
    fields = ["PairId", "NewsSource1", "NewsSource2", "Sentence1", "Sentence2", "MethodType", "judge"]
    df = _xml(spark, path, "Pair", ", ".join(f"{f} string" for f in fields), "corpus_pair.xml")
    judge = _text_of("judge")
    label = F.when(judge == "1", "Paraphrase").when(judge == "0", "Paraphrase" if two_class else "SemiParaphrase").when(judge == "-1", "NotParaphrase").otherwise(judge)
    names = ["id", "source1", "source2", "sentence1", "sentence2", "method_type"]
    return df.select(*[_text_of(f).alias(n) for f, n in zip(fields, names)], label.alias("judge"))


def degarbayan_pairs(spark: SparkSession, path: str, two_class: bool = False) -> DataFrame:
    return degarbayan(spark, path, two_class).select("sentence1", "sentence2", "judge")


def _faspell(spark: SparkSession, path: str, name: str, category: bool) -> DataFrame:
    rows = text.numbered(text.whole(spark, f"{path}/{name}")).where("line_no > 0").select("line_no", F.split("line", "\t", 3).alias("c")).where(F.size("c") >= 2)
    number = F.expr("try_cast(trim(get(c, 2)) as int)") if category else F.lit(None).cast("int")
    return rows.select("line_no", F.col("c")[0].alias("misspelled"), F.col("c")[1].alias("corrected"), F.when(number >= 0, number).alias("error_category"))


def faspell_main(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, misspelled, corrected, error_category): the header is skipped, a category that is no number is null."""
    return _faspell(spark, path, "faspell_main.txt", True)


def faspell_ocr(spark: SparkSession, path: str) -> DataFrame:
    return _faspell(spark, path, "faspell_ocr.txt", False)


#: Files that can't be read, by the day in their name.
_BROKEN_DAYS = (
    "960622 960630 960701 960709 960710 960711 960817 960818 960819 960820 961019 961112 961113 961114 970414 970415 970612 970614 970710 970712 970713 970717 970719 980317 "
    "040820 040824 040825 040901 040917 040918 040920 041025 041026 041027 041230 041231 050101 050102 050223 050224 050406 050407 050416"
).split()
HAMSHAHRI_SKIPPED = [f"HAM2-{d}.xml" for d in _BROKEN_DAYS]


def hamshahri(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, title, text, issue, date, categories) of the DOC elements of all XML files below but the known broken ones."""
    schema = "_id string, TITLE string, TEXT string, ISSUE string, DATE string, CAT array<struct<_name: string, ITEM: array<string>>>, _metadata_file string"
    df = _xml(spark, path, "DOC", schema.replace(", _metadata_file string", ""), "*.xml").select("*", text.from_file()).where(~text.file_name().isin(HAMSHAHRI_SKIPPED))
    cats = F.transform(F.coalesce("CAT", F.array().cast("array<struct<_name: string, ITEM: array<string>>>")), lambda c: F.struct(F.coalesce(c["_name"], F.lit("")).alias("name"), F.coalesce(c["ITEM"], F.array().cast("array<string>")).alias("items")))
    return df.select("file", F.coalesce("_id", F.lit("")).alias("id"), _text_of("TITLE").alias("title"), _text_of("TEXT").alias("text"), _text_of("ISSUE").alias("issue"), _text_of("DATE").alias("date"), cats.alias("categories"))


def mirastext(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): what stands before the first *** of a line; lines with nothing there are dropped."""
    return text.lines(spark, path).select("file", trim(F.split("value", r"\*\*\*", 2)[0]).alias("text")).where("text <> ''")


def _by_line(spark: SparkSession, path: str) -> DataFrame:
    return text.numbered_lines(spark, path).select("line_no", "line")


def mizan_persian(spark: SparkSession, path: str) -> DataFrame:
    return _by_line(spark, f"{path}/mizan_fa.txt").withColumnRenamed("line", "sentence")


def mizan_english(spark: SparkSession, path: str) -> DataFrame:
    return _by_line(spark, f"{path}/mizan_en.txt").withColumnRenamed("line", "sentence")


def mizan_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, english, persian) by line, as far as both files go."""
    return mizan_english(spark, path).withColumnRenamed("sentence", "english").join(mizan_persian(spark, path).withColumnRenamed("sentence", "persian"), "line_no")


def naab(spark: SparkSession, path: str, subset: str = "all") -> DataFrame:
    """(file, sentence) of the non-empty lines of the files of a subset."""
    return text.lines(spark, path).where(text.has_name(subset)).select("file", trim(F.col("value")).alias("sentence")).where("sentence <> ''")


def plain_text(spark: SparkSession, path: str, participles: tuple[str, ...] = ()) -> DataFrame:
    """(file, sent_ix, sentence, words) of whole files through the sentence and word tokenizers; verb parts are joined where participles are given."""
    sents = text.whole(spark, path).select("file", F.posexplode(tk.sentences(F.col("value"))).alias("sent_ix", "sentence"))
    return sents.withColumn("words", tk.words(F.col("sentence"), tk.WordOptions(join_verb_parts=bool(participles)), participles))


def persica(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, id, title, text, date, time, category, category2) of records of seven lines; final commas go, an id that is
    no number is 0, a record of fewer lines at the end is dropped."""
    lines = text.numbered_lines(spark, path).withColumn("line", F.when(F.col("line_no") == 0, F.regexp_replace("line", "\\A\\x{FEFF}+", "")).otherwise(F.col("line")))
    names = ["id", "title", "text", "date", "time", "category", "category2"]
    value = F.regexp_replace(trim(F.col("line")), ",+\\z", "")
    rows = lines.select("file", (F.col("line_no") / 7).cast("int").alias("record"), (F.col("line_no") % 7).alias("i"), value.alias("v"))
    wide = rows.groupBy("file", "record").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(c) for i, c in enumerate(names)]).where("n = 7")
    return wide.select("file", "record", F.coalesce(F.expr("try_cast(id as bigint)"), F.lit(0)).alias("id"), *names[1:])


#: Tags that stand for a word's class, and the universal ones.
PEYKARE_UNIVERSAL = {"N": "NOUN", "V": "VERB", "AJ": "ADJ", "ADV": "ADV", "PRO": "PRON", "DET": "DET", "P": "ADP", "POSTP": "ADP", "NUM": "NUM", "CONJ": "CCONJ", "PUNC": "PUNCT", "CL": "PART", "INT": "INTJ", "RES": "X"}


def peykare(spark: SparkSession, path: str, universal: bool = False, table: str | None = None) -> DataFrame:
    """Tagged sentences of files in Windows-1256: `.. .. class tags word parts`. table: 256 characters to decode with instead.
    Words # are dropped, sentences of one word too; punctuation . ؟ ! # ends a sentence."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return pd.Series([b.decode("cp1256", "replace") if table is None else "".join(table[x] for x in b) for b in raw], dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), decode("content").alias("value"))
    rows = text.numbered(files).select("file", "line_no", F.filter(F.split("line", " "), lambda x: x != "").alias("c")).where(F.size("c") >= 4)
    tags = F.split(F.col("c")[3], ",", -1)
    valid = F.filter(tags, lambda t: t.isin(list(PEYKARE_UNIVERSAL)))
    first = F.coalesce(F.get(valid, F.lit(0)), F.lit("N"))
    word = F.array_join(F.slice("c", F.lit(5), F.size("c")), ZWNJ)
    tag = _universal(_lookup(first, PEYKARE_UNIVERSAL), F.col("w")) if universal else F.concat(first, F.when(F.array_contains(tags, "EZ"), ",EZ").otherwise(""))
    rows = rows.withColumn("w", word).where("w <> '#'").withColumn("tag", tag)
    ends = (F.col("c")[2] == "PUNC") & F.col("w").isin(".", "؟", "!")
    before = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("block", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)))
    sents = placed.groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", F.col("w").alias("token"), "tag"))).alias("s")).where(F.size("s") > 1)
    order = W.partitionBy("file").orderBy("block")
    return sents.select("file", (F.row_number().over(order) - 1).alias("sent_ix"), F.transform("s", lambda s: _pair(s["token"], s["tag"])).alias("tokens"))


def pn_summary(spark: SparkSession, path: str, subset: str = "all") -> DataFrame:
    """(file, id, title, article, summary, category, categories, network, link) of tab-separated rows of eight columns; headers are skipped."""
    rows = text.numbered_lines(spark, path, "*.csv").where(text.has_name(subset)).where("line_no > 0").select("file", F.split("line", "\t", 8).alias("c")).where(F.size("c") >= 8)
    names = ["id", "title", "article", "summary", "category"]
    return rows.select("file", *[F.col("c")[i].alias(n) for i, n in enumerate(names)], F.split(F.col("c")[4], r"\+", -1).alias("categories"), F.col("c")[5].alias("network"), F.col("c")[6].alias("link"))


#: The public ASCII transliteration of Arabic and its letters.
BUCKWALTER = dict(zip("'|>&<}AbptvjHxd*rzs$SDTZEg_fqklmnhwYy~oaiuFKN`{PJVG", "ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىيّْ" + "َِ" + "ُ" + "ًٌٍ" + "ٰ" + "ٱپچژگ"))


def quran_parts(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, chapter, verse, word, part, text, tag, lem, root) of lines (c:v:w:p), form, tag and features by tab."""
    rows = text.numbered(text.whole(spark, path)).where(F.col("line").startswith("(")).select("file", "line_no", F.split("line", "\t", 4).alias("c")).where(F.size("c") >= 4)
    place = F.split(F.regexp_replace(F.col("c")[0], r"\A\(+|\)+\z", ""), ":")
    number = lambda i: F.coalesce(F.get(place, F.lit(i)).try_cast("int"), F.lit(0))
    features = F.split(F.col("c")[3], r"\|", -1)

    def last(name: str) -> Column:
        found = F.filter(features, lambda f: f.startswith(name))
        value = F.substring(F.element_at(found, F.lit(-1)), F.lit(len(name) + 1), F.lit(10_000))
        return F.when(F.size(found) > 0, translate(trim(value), BUCKWALTER))

    return rows.select(
        "file", "line_no", number(0).alias("chapter"), number(1).alias("verse"), number(2).alias("word"), number(3).alias("part"),
        translate(F.col("c")[1], BUCKWALTER).alias("text"), F.col("c")[2].alias("tag"), last("LEM:").alias("lem"), last("ROOT:").alias("root"),
    )


def quran_words(spark: SparkSession, path: str) -> DataFrame:
    """(file, loc, text, tag, lem, root, parts): neighbouring parts of one word together, with the first part's tag; loc is chapter:verse."""
    parts = quran_parts(spark, path)
    w = W.partitionBy("file").orderBy("line_no")
    key = F.struct("chapter", "verse", "word")
    run = parts.withColumn("_new", (~F.coalesce(F.lag(key).over(w) == key, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    grouped = run.groupBy("file", "_run").agg(F.array_sort(F.collect_list(F.struct("line_no", "chapter", "verse", "word", "part", "text", "tag", "lem", "root"))).alias("parts"))
    first = F.col("parts")[0]
    return grouped.select(
        "file", F.col("_run").alias("word_ix"), F.concat_ws(":", first["chapter"].cast("string"), first["verse"].cast("string")).alias("loc"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), first["tag"].alias("tag"), first["lem"].alias("lem"), first["root"].alias("root"), "parts",
    )


def sentipers(spark: SparkSession, path: str) -> DataFrame:
    """(title, product_type, comments) of Product elements; comments are opinions and criticisms with their sentences."""
    one = "array<struct<_id: string, _holder: string, _value: string, Sentence: array<struct<_id: string, _value: string, _VALUE: string>>>>"
    one = one.replace("_VALUE: string", "body: string")
    r = spark.read.format("xml").option("rowTag", "Product").option("attributePrefix", "_").option("valueTag", "body").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml")
    df = r.schema(f"_Title string, _Type string, Opinion {one}, Criticism {one}").load(path)
    blank = lambda c: F.coalesce(c, F.lit(""))
    sentence = lambda s: F.struct(blank(s["_id"]).alias("id"), blank(s["_value"]).alias("value"), blank(trim(s["body"])).alias("text"))
    none = F.array().cast("array<struct<id: string, value: string, text: string>>")

    def comments(name: str) -> Column:
        made = F.transform(F.col(name), lambda c: F.struct(blank(c["_id"]).alias("id"), blank(c["_holder"]).alias("holder"), blank(c["_value"]).alias("value"), F.coalesce(F.transform(c["Sentence"], sentence), none).alias("sentences")))
        return F.coalesce(made, F.array().cast("array<struct<id: string, holder: string, value: string, sentences: array<struct<id: string, value: string, text: string>>>>"))

    return df.select(blank(F.col("_Title")).alias("title"), blank(F.col("_Type")).alias("product_type"), F.concat(comments("Opinion"), comments("Criticism")).alias("comments"))


def sentipers_comments(spark: SparkSession, path: str) -> DataFrame:
    return sentipers(spark, path).select("title", F.explode("comments").alias("c")).select("title", "c.*")


def tnews(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, url, datetime, category, pre_title, title, post_title, brief, text) of NEWS elements, without control characters and tags."""
    names = {"URL": "url", "DATETIME": "datetime", "CATEGORY": "category", "PRETITLE": "pre_title", "TITLE": "title", "POSTTITLE": "post_title", "BRIEF": "brief", "TEXT": "text"}
    files = text.whole(spark, path, "*.xml", True).withColumn("value", F.regexp_replace("value", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    news = files.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<NEWS\b[^>]*>.*?</NEWS>"), F.lit(0))).alias("news_ix", "x"))
    unescape = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))

    def field(tag: str) -> Column:
        raw = F.regexp_extract("x", rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
        data = F.regexp_extract(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", 1)
        return strip_html(trim(F.when(raw.contains("<![CDATA["), data).otherwise(unescape(raw))))

    return news.select("file", "news_ix", F.regexp_extract("x", r'<NEWS\b[^>]*?\bid="([^"]*)"', 1).alias("id"), *[field(t).alias(n) for t, n in names.items()])


#: The word class behind the first letter of a word's code.
TREEBANK_CLASSES = {"N": "N", "V": "V", "A": "AJ", "D": "ADV", "Z": "PRO", "T": "DET", "E": "P", "P": "POSTP", "U": "NUM", "J": "CONJ", "O": "PUNC", "R": "RES", "L": "CL", "I": "INT"}


def treebank(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent_ix, tokens) of S elements and the w elements anywhere within; e marks ezafe, an unknown class is empty."""
    files = text.whole(spark, path, "*.xml", True)
    sents = files.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<S\b[^>]*>.*?</S>"), F.lit(0))).alias("block", "x"))
    found = F.regexp_extract_all("x", F.lit(r"(?s)<w\b(?:[^>]*[^/>])?>.*?</w>"), F.lit(0))

    def one(w: Column) -> Column:
        code = F.left(F.regexp_extract(w, r'<w\b[^>]*?\blc="([^"]*)"', 1), F.lit(1))
        base = F.coalesce(F.create_map(*map(F.lit, chain.from_iterable(TREEBANK_CLASSES.items())))[code], F.lit(""))
        body = trim(F.regexp_replace(w, r"(?s)<[^>]*>", ""))
        return _pair(body, F.concat(base, F.when(w.rlike(r'<w\b[^>]*\bclitic="ezafe"'), "e").otherwise("")))

    return text.as_sentences(sents.withColumn("tokens", F.transform(found, one)))


def verb_valency(spark: SparkSession, path: str) -> DataFrame:
    """(past_light_verb, present_light_verb, prefix, nonverbal_element, preposition, valency) of rows of six columns and more; the header
    is known by its words, a - that is a cell's end goes."""
    names = ["past_light_verb", "present_light_verb", "prefix", "nonverbal_element", "preposition", "valency"]
    rows = text.lines(spark, path).where(~F.col("value").contains("بن ماضی")).select(F.split(F.replace("value", F.lit("-\t"), F.lit("\t")), "\t", -1).alias("c")).where(F.size("c") >= 6)
    return rows.select(*[F.col("c")[i].alias(n) for i, n in enumerate(names)])


def wikipedia(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_ix, id, url, title, text) of <doc ..> blocks that a line </doc> ends; unended ones are dropped."""
    files = text.whole(spark, path).withColumn("value", F.regexp_replace("value", "\r\n", "\n"))
    docs = files.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?ms)^<doc [^\n]*\n(?:(?!^<doc ).*?\n)??</doc>$"), F.lit(0))).alias("doc_ix", "x"))
    head = F.regexp_extract("x", r"\A[^\n]*", 0)
    attribute = lambda a: F.regexp_extract(head, rf'\b{a}="([^"]*)"', 1)
    body = F.regexp_replace(F.regexp_replace("x", r"\A[^\n]*\n", ""), r"\n?</doc>\z", "")
    return docs.select("file", "doc_ix", attribute("id").alias("id"), attribute("url").alias("url"), attribute("title").alias("title"), body.alias("text"))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select("text")


__all__ = [n for n in dir() if not n.startswith("_")]
