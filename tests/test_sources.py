"""What the samples' queries don't show of the readers: modes, subsets, broken and empty files."""

import pytest
from pyspark.sql import functions as F

from parsloom.operators import dims, informal, verbs
from parsloom.plans import pipeline, samples
from parsloom.sources import corpora, text
from parsloom.sources import vectors as sv


def tags(df):
    return [(r["token"], r["tag"]) for r in text.tagged_words(df).orderBy("file", "sent_ix", "tok_ix").collect()]


def test_modes(spark):
    d, u = samples.put(spark, "dadegan"), samples.put(spark, "universal_dadegan")
    assert tags(corpora.dadegan(spark, d, "universal"))[:2] == [("کتاب", "NOUN"), ("علی", "NOUN")]
    assert tags(corpora.dadegan(spark, d, "raw"))[0] == ("کتاب", "N,ezafe|x")
    assert tags(corpora.universal_dadegan(spark, u))[0] == ("کتاب", "Ne") and tags(corpora.universal_dadegan(spark, u, "raw"))[0] == ("کتاب", "NOUN,Case=Ezafe")
    with pytest.raises(ValueError):
        corpora.dadegan(spark, d, "fine")
    b = samples.put(spark, "bijankhan")
    assert ("دیده", "V") in tags(corpora.bijankhan(spark, b, join_verb_parts=False)) and ("اولین", "ADJ_SUP") in tags(corpora.bijankhan(spark, b, tags={}))
    k = samples.put(spark, "peykare")
    assert tags(corpora.peykare(spark, k, universal=True))[0] == ("کتاب", "NOUN")
    table = "".join(bytes([i]).decode("cp1256", "replace") for i in range(256)).replace("ک", "X").replace("ك", "X")
    assert tags(corpora.peykare(spark, k, table=table))[0][0] == "Xتاب"


def test_subsets_and_views(spark):
    a = samples.put(spark, "arman")
    assert len(tags(corpora.arman(spark, a))) == 4 and len(tags(corpora.arman(spark, a, "train"))) == 1
    assert [r["token"] for r in text.words(corpora.arman(spark, a, "train")).collect()] == ["او"]
    assert corpora.naab(spark, samples.put(spark, "naab")).count() == 3 and corpora.pn_summary(spark, samples.put(spark, "pn_summary")).count() == 2
    g = samples.put(spark, "degarbayan")
    assert corpora.degarbayan_pairs(spark, g, True).orderBy("judge").head()["judge"] == "NotParaphrase" and corpora.degarbayan(spark, g, True).where("id = '1'").head()["judge"] == "Paraphrase"
    m = samples.put(spark, "mizan")
    assert corpora.mizan_persian(spark, m).count() == 3 and corpora.mizan_english(spark, m).count() == 2
    assert corpora.texts(corpora.mirastext(spark, samples.put(spark, "mirastext"))).columns == ["text"]
    assert corpora.sentipers(spark, samples.put(spark, "sentipers")).count() == 1


def test_empty_and_missing_files(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("")
    at = str(tmp_path)
    assert corpora.ner(spark, at).count() == 0 == corpora.arman(spark, at).count() == corpora.naab(spark, at).count() == corpora.mirastext(spark, at).count()
    one = str(tmp_path / "a.txt")
    for read in (corpora.bijankhan, corpora.dadegan, corpora.universal_dadegan, corpora.persica, corpora.quran_parts, corpora.quran_words, corpora.verb_valency, corpora.wikipedia, corpora.plain_text, corpora.peykare):
        assert read(spark, one).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        corpora.mirastext(spark, at + "/none").count()


def test_line_numbers(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("a\r\n\nb\n".encode())
    rows = text.numbered(text.whole(spark, str(tmp_path / "x.txt"))).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in rows] == [(0, "a"), (1, ""), (2, "b")]


def test_vectors_by_name(spark):
    t, b = sv.read_vectors(spark, samples.put(spark, "text_vectors")), sv.read_vectors(spark, samples.put(spark, "binary_vectors"))
    assert t.count() == b.count() == 3
    raw = spark.createDataFrame([(0, "a", [3.0, 4.0]), (1, "z", [0.0, 0.0])], "ix bigint, word string, vec array<float>")
    assert [[round(x, 5) for x in r["vec"]] for r in sv.unit_vectors(raw).orderBy("ix").collect()] == [[0.6, 0.8], [0, 0]]


def test_small_tables(spark):
    roots = dims.verb_roots_from_rows(spark, [("رفت", "رو"), ("", "هست")])
    assert [r["root"] for r in dims.present_roots(roots).orderBy("ix").collect()] == ["رو", "هست"]
    assert verbs.conjugation_templates(spark).count() == 609
    with_empty, without = (verbs.verb_forms(roots, keep_empty_past=k).where("form = ''").count() for k in (True, False))
    assert (with_empty, without) == (1, 0)
    lex = dims.lexicon_from_rows(spark, [("واقعاً", 3), ("کتاب", 1)])
    assert {r["word"] for r in informal.informal_surfaces(lex, samples.informal_words(spark)).collect()} >= {"واقعا", "واسه"}
    assert dims.known(spark.createDataFrame([("کتاب",), (None,)], "word string"), lex).count() == 1
    assert dims.unknown(spark.createDataFrame([("کتاب",), (None,), ("x",)], "word string"), lex).count() == 2


def test_tags_for_sentences(spark):
    df = spark.createDataFrame([(1, ["الف", "ب"])], "i int, words array<string>")
    tagger: pipeline.Tagger = lambda tokens: F.transform(tokens, lambda t: F.when(t == "ب", "N").otherwise("X"))
    assert pipeline.tag_sentences(df, tagger).head()["tags"] == ["X", "N"]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Files of many splits, carriage returns, blank lines and no final line end: numbered as whole files are."""
    (tmp_path / "a.txt").write_text("\n".join(f"line {i} " + "x" * (i % 50) + ("\r" if i % 3 else "") for i in range(2000)), encoding="utf-8", newline="")
    (tmp_path / "b.txt").write_text("یک\n\nدو\n", encoding="utf-8", newline="")
    (tmp_path / "c.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = text.numbered_lines(spark, str(tmp_path))
        got = sorted(tuple(r) for r in df.collect())
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = sorted((r["file"], r["line_no"], r["line"].removesuffix("\r")) for r in text.numbered(text.whole(spark, str(tmp_path))).collect())
    assert got == want and len(want) == 2003
