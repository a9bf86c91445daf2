"""Operators against golden cases, brute force and their laws."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parsloom.operators import dims, embeddings, informal, lemmas, ngrams, normalize, spell, verbs
from parsloom.plans import samples
from parsloom.plans.pipeline import TextPipeline
from parsloom.sources import vectors as sv

Z = "‌"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def words(spark, *ws, name="word"):
    return spark.createDataFrame([(w,) for w in ws], f"{name} string")


@pytest.fixture(scope="module")
def forms(spark):
    return verbs.verb_forms(samples.roots(spark)).cache()


def test_paradigm(spark):
    t = verbs.templates()
    assert len(t) == 609 and t[0][3] == "Pن" and [x[0] for x in t] == list(range(609))
    assert (t[405][1], t[477][1], t[603][1]) == ("perfective_present", "imperfective_present", "negative_passive_future_precedent_imperfective")
    made = verbs.conjugate(spark.createDataFrame([(0, "دید", "بین")], "ix int, past string, present string"), ["perfective_past", "imperfective_present", "perfective_future", "present_perfect", "subjunctive_perfective_present"])
    by = {}
    for tense, form in rows(made.select("tense", "form", "form_ix"), "form_ix") and [(r["tense"], r["form"]) for r in made.orderBy("form_ix").collect()]:
        by.setdefault(tense, []).append(form)
    assert by["perfective_past"] == ["دیدم", "دیدی", "دید", "دیدیم", "دیدید", "دیدند"]
    assert by["imperfective_present"][0] == "می‌بینم" and by["perfective_future"][0] == "خواهم دید"
    assert by["present_perfect"][0] == "دیده‌ام" and by["present_perfect"][2] == "دیده است" and len(by["present_perfect"]) == 7
    assert by["subjunctive_perfective_present"][0] == "ببینم"
    with pytest.raises(ValueError):
        verbs.conjugate(made, ["none"])


def test_earliest_root_wins(spark):
    roots = spark.createDataFrame([(0, "الف", "ک"), (1, "الف", "گ")], "ix int, past string, present string")
    assert dict(rows(verbs.verb_forms(roots), "form"))["الفم"] == "الف#ک"
    assert dict(rows(verbs.verb_forms(roots.limit(0)), "form")) == {"است": "#است"}


def test_lemma_nulls_ties_and_clashes(spark, forms):
    df = spark.createDataFrame([("کتاب‌ها", 1), ("کتاب‌ها", 1), (None, 2), ("", 3)], "word string, frequency int")
    assert rows(lemmas.lemmatize(df, samples.lexicon(spark), forms), "frequency") == [("کتاب‌ها", 1, "کتاب"), ("کتاب‌ها", 1, "کتاب"), (None, 2, None), ("", 3, "")]
    with pytest.raises(ValueError):
        lemmas.lemmatize(df, samples.lexicon(spark), forms, into="Frequency")
    assert lemmas.lemmatize(df.limit(0), samples.lexicon(spark), forms).count() == 0
    one = spark.createDataFrame([("رفتم", "V")], "word string, pos string")
    assert rows(lemmas.lemmatize(one, samples.lexicon(spark), forms, pos="pos", map_tags=True), "word")[0][2] == "رفت#رو"


def test_splits(spark, forms):
    df = words(spark, "صداوسیماجمهوری", f"کتاب{Z}خانه", "کتاب", "بیگانه", None, name="token")
    out = dict(rows(lemmas.split_tokens(df, samples.lexicon(spark), forms), "token"))
    assert out["صداوسیماجمهوری"] == [["صداوسیما", "جمهوری"]] and out[f"کتاب{Z}خانه"] == [["کتاب", "خانه"]]
    assert out["کتاب"] == [["کتاب"]] and out["بیگانه"] == [] and None not in out


TEXTS = ["اِعلاممممم کَرد : « زمین لرزه ای به بُزرگیِ 6 دهم ریشتر ...»", "کتاب ها و میروم\n\nخانه ی ما", "", None, "كتاب"]


def test_normalize(spark):
    plain = verbs.verb_forms(samples.roots(spark), joined=False)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    out = [r[2] for r in rows(normalize.normalize(df, samples.lexicon(spark), plain), "i")]
    assert out[0] == "اعلام کرد: «زمین‌لرزه‌ای به بزرگی ۶ دهم ریشتر …»" and out[1] == "کتاب‌ها و می‌روم\n\nخانه‌ی ما" and out[2:4] == ["", None]


def test_large_tables_give_the_same(spark):
    """Beyond the limit the tables are joined instead of broadcast."""
    plain = verbs.verb_forms(samples.roots(spark), joined=False)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    small, large = (rows(normalize.normalize(df, samples.lexicon(spark), plain, limit=k), "i") for k in (10**6, 3))
    assert small == large


def test_normalize_without_tables(spark):
    df = spark.createDataFrame([("سلاممم 5",)], "text string")
    assert rows(normalize.normalize(df), "text")[0][1] == "سلامم ۵"
    with pytest.raises(ValueError):
        normalize.normalize(df, options=normalize.NormalizerOptions())
    with pytest.raises(ValueError):
        normalize.normalize(df, into="TEXT")


def test_repeats_ask_the_lexicon():
    assert normalize.fewer_repeats("سلاممم", frozenset({"سلام"})) == "سلام"
    assert normalize.fewer_repeats("سلاممم", frozenset({"سلام", "سلامم"})) == "سلامم"
    assert normalize.fewer_repeats("سلاممم", frozenset({"سلاممم"})) == "سلاممم"


def test_token_spacing():
    assert normalize.token_spacing(["زمین", "لرزه", "ها"], {"زمین‌لرزه": 2, "زمین": 1}) == ["زمین‌لرزه‌ها"]
    assert normalize.token_spacing(["زمین", "لرزه"], {"زمین‌لرزه": 0}) == ["زمین", "لرزه"]


def test_informal(spark):
    verb_map = informal.informal_verb_map(samples.informal_verbs(spark))
    out = dict(rows(informal.formal_candidates(words(spark, "واسه", "کتاب", "می‌تونم", "میتونم", "کتابو", None), verb_map, samples.informal_words(spark), samples.lexicon(spark)), "word"))
    assert out["واسه"] == ["برای", "واسه"] and out["کتاب"] == ["کتاب"] and out["می‌تونم"] == ["می‌توانم"] == out["میتونم"] and out["کتابو"] == ["کتاب را", "کتاب و"]
    assert None not in out
    forms36 = words(spark, "خوا").select(informal.informal_forms(F.col("word"))).head()[0]
    assert len(forms36) == 36 and forms36[2] == "خواد" and forms36[12] == "می‌خوام"
    literal = dict(rows(informal.informal_verb_map(samples.informal_verbs(spark), literal=True), "form"))
    assert literal and literal != dict(rows(verb_map, "form"))
    tokens = spark.createDataFrame([(1, "واسه"), (2, None)], "i int, token string")
    assert rows(informal.normalize_informal(tokens, verb_map, samples.informal_words(spark), samples.lexicon(spark)).select("i", "candidates"), "i") == [(1, ["برای", "واسه"]), (2, None)]


def edits1(w, letters=spell.ALPHABET):
    cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in cut if b} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1} | {a + c + b[1:] for a, b in cut if b for c in letters if c != b[0]} | {a + c + b for a, b in cut for c in letters}


def test_edits(spark):
    for w in ("کتاب", "آآ", "ب", ""):
        got = words(spark, w).select(spell.edits1(F.col("word"))).head()[0]
        assert set(got) == edits1(w) and len(got) == len(set(got))


def test_candidates_against_brute_force(spark):
    rng = random.Random(5)
    lex = {"".join(rng.choice("ابکxت") for _ in range(rng.randint(1, 5))) for _ in range(60)}
    asked = {"".join(rng.choice("ابکxت") for _ in range(rng.randint(0, 6))) for _ in range(60)} | {"xyzxyz_none"}
    want = set()
    for w in asked:
        e1 = edits1(w)
        best = {w} & lex or e1 & lex or {v for u in e1 for v in edits1(u)} & lex or {w}
        want |= {(w, v) for v in best}
    lexicon = dims.lexicon_from_rows(spark, [(w, 1) for w in sorted(lex)])
    assert set(rows(spell.candidates(words(spark, *sorted(asked), None), lexicon), "word", "candidate")) == want


def test_corrections(spark):
    lexicon = dims.lexicon_from_rows(spark, [("کتاب", 5), ("کباب", 5), ("کتاز", 9)])
    df = spark.createDataFrame([(1, "کتاب"), (2, "کتا"), (3, None), (4, "zzzz"), (2, "کتا")], "i int, word string")
    assert rows(spell.correct(df, lexicon), "i") == [(1, "کتاب", "کتاب"), (2, "کتا", "کتاز"), (2, "کتا", "کتاز"), (3, None, None), (4, "zzzz", "zzzz")]
    assert rows(spell.probability(df, lexicon), "i")[0][2] == 5 / 19 and rows(spell.probability(df, lexicon), "i")[-1][2] == 0
    assert rows(spell.correct(df, lexicon.limit(0)), "i")[0][2] == "کتاب"


SENTS = [["من", "کتاب", "می‌خوانم"], ["او", "کتاب", "نوشت"], ["من", "نوشت"]]


def test_bigrams(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SENTS)] + [(3, ["تنها"]), (4, []), (5, None)], "k int, tokens array<string>")
    m = ngrams.train(df.where("k < 3"))
    assert m.vocab_size().head()[0] == 5 and m.total_tokens().head()[0] == 8
    assert math.isclose(sum(r["probability"] for r in m.unigram_probability(m.unigrams.select("w")).collect()), 1.0)
    p = rows(m.probability(spark.createDataFrame([("من", "کتاب"), ("x", "y"), (None, None)], "prev string, w string")), F.desc_nulls_last("prev"))
    assert {r[:2]: r[2] for r in p} == {("من", "کتاب"): 2 / 7, ("x", "y"): 1 / 5, (None, None): 1 / 5}
    assert dict((r[0], r[1]) for r in rows(m.next_word(), "prev"))["من"] == "نوشت"  # of equals the lesser
    s = rows(m.suggest(words(spark, "من", "ناشناس", name="prev"), 3), "prev", "rank")
    assert [r[2] for r in s if r[0] == "من"] == ["نوشت", "کتاب", "او"][: 3] or [r[1] for r in s if r[0] == "من"] == [1, 2, 3]
    assert len([r for r in s if r[0] == "ناشناس"]) == 3
    assert all(a[3] >= b[3] for a, b in zip(s, s[1:]) if a[0] == b[0])
    perplexity = dict(rows(m.perplexity(df, "k"), "k"))
    assert perplexity[3] == math.inf == perplexity[4] == perplexity[5]
    assert math.isclose(perplexity[0], 2 ** -((math.log2(2 / 7) + math.log2(2 / 7)) / 2))
    assert m.more(df.where("k = 3")).total_tokens().head()[0] == 9
    assert ngrams.train(df.limit(0)).total_tokens().head()[0] == 0


@pytest.fixture(scope="module")
def vecs(spark):
    return sv.read_binary_vectors(spark, samples.put(spark, "binary_vectors")).cache()


def test_neighbours(spark, vecs):
    q = vecs.select(F.col("ix").alias("query"), "vec")
    out = rows(embeddings.most_similar(q, vecs, 2), "query", "rank")
    assert [(r[0], r[1], r[3]) for r in out if r[0] == 0] == [(0, 1, "دفتر"), (0, 2, "پنجره")]
    assert embeddings.most_similar(q.limit(0), vecs, 2).count() == 0
    ties = spark.createDataFrame([(i, str(i), [1.0, 0.0]) for i in range(6)], "ix bigint, word string, vec array<float>")
    got = rows(embeddings.most_similar(ties.where("ix = 3").select(F.col("ix").alias("query"), "vec"), ties.repartition(3), 3), "rank")
    assert [r[2] for r in got] == [0, 1, 2]


def test_blocks_of_queries_agree(spark, vecs, monkeypatch):
    q = vecs.select(F.col("ix").alias("query"), "vec")
    whole = rows(embeddings.most_similar(q, vecs, 2), "query", "rank")
    monkeypatch.setattr(embeddings, "QUERY_BLOCK", 1)
    assert rows(embeddings.most_similar(q, vecs, 2), "query", "rank") == whole


def test_odd_one_and_means(spark, vecs):
    g = spark.createDataFrame([(1, ["کتاب", "دفتر", "پنجره"]), (2, ["کتاب", "x"]), (3, ["دفتر"]), (4, [])], "key int, words array<string>")
    assert rows(embeddings.doesnt_match(g, vecs), "key") == [(1, "پنجره"), (3, "دفتر")]
    s = spark.createDataFrame([(1, ["کتاب", "پنجره", "کتاب", None]), (2, ["x"]), (3, None)], "key int, tokens array<string>")
    out = dict(rows(embeddings.embed_sentences(s, vecs), "key"))
    assert [round(x, 5) for x in out[1]] == [0.66667, 0, 0.33333] and out[2] == [0, 0, 0] == out[3]
    assert rows(embeddings.contains(words(spark, "کتاب", "x", None), vecs), F.asc_nulls_last("word")) == [("x", False), ("کتاب", True), (None, False)]


def test_subwords(spark):
    m = sv.read_subword_model(spark, samples.put(spark, "subword_model"))
    assert (m.dim, m.minn, m.maxn, m.bucket) == (3, 3, 3, 2)
    assert embeddings.subword_hash(b"") == 2166136261 and embeddings.subword_buckets("ab", 3, 3, 2) == [embeddings.subword_hash(x) % 2 for x in (b"<ab", b"ab>")]
    v = dict(rows(embeddings.embed_subwords(words(spark, "ایران", "x", None), m.vectors, m.buckets, m.minn, m.maxn, m.bucket), "word"))
    assert math.isclose(sum(x * x for x in v["ایران"]), 1, abs_tol=1e-5) and v["x"] is not None
    none = dict(rows(embeddings.embed_subwords(words(spark, "ایران", "x"), m.vectors, m.buckets, 0, 0, m.bucket), "word"))
    assert none["x"] is None and [round(x, 5) for x in none["ایران"]] == [0.6, 0.8, 0]


@pytest.mark.parametrize("bad", [{"magic": 1}, {"version": 11}, {"quantized": 1}])
def test_bad_subword_models(spark, bad, tmp_path):
    at = tmp_path / "m.bin"
    at.write_bytes(samples.subword_binary([("a", [1.0, 2.0])], [], **bad))
    with pytest.raises(Exception, match="subword model|quantized"):
        sv.read_subword_model(spark, str(at)).vectors.collect()


def test_pipeline(spark):
    p = TextPipeline(samples.lexicon(spark), samples.roots(spark))
    df = spark.createDataFrame([(1, "او به خانه رفته است. کتاب ها!"), (2, None), (3, "")], "i int, text string")
    assert [r[0] for r in p.tokenize_sentences(df).orderBy("i", "sent_ix").select("words").collect()] == [["او", "به", "خانه", "رفته_است", "."], ["کتاب‌ها", "!"]]
    assert rows(p.stem(words(spark, "کتابی")), "word") == [("کتابی", "کتاب")]
    with pytest.raises(ValueError):
        TextPipeline().lemmatize(words(spark, "x"))


def single_edits(w, letters):
    n = len(w)
    out = {w[:i] + w[i + 1 :] for i in range(n)} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(n - 1)}
    return out | {w[:i] + c + w[i + 1 :] for i in range(n) for c in letters} | {w[:i] + c + w[i:] for i in range(n + 1) for c in letters}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", max_size=6), st.text(alphabet="abcd", max_size=6), st.sampled_from(["abcd", "abx", "a"]))
def test_two_edits_against_brute_force(a, b, letters):
    near = {y for x in single_edits(a, letters) for y in single_edits(x, letters)} | single_edits(a, letters) | {a}
    assert spell._within(a, b, 2, frozenset(letters)) == (b in near)


def test_a_phrase_in_informal_persian(spark):
    """The normalizer, the cuts and the formal words in one operator."""
    df = spark.createDataFrame([(1, "واسه  كتاب. می‌تونم"), (2, None), (3, "")], "id int, text string")
    args = informal.informal_verb_map(samples.informal_verbs(spark)), samples.informal_words(spark), samples.lexicon(spark), verbs.verb_forms(samples.roots(spark), joined=False)
    got = [(r["id"], r["sent_ix"], r["tok_ix"], r["token"], r["candidates"][0]) for r in informal.normalize_text(df, *args).orderBy("id", "sent_ix", "tok_ix").collect()]
    assert [x[:4] for x in got] == [(1, 0, 0, "واسه"), (1, 0, 1, "کتاب"), (1, 0, 2, "."), (1, 1, 0, "می‌تونم")]
    assert got[0][4] == "برای" and got[1][4] == "کتاب" and got[3][4] == "می‌توانم"
    assert informal.normalize_text(df.limit(0), *args).count() == 0


def test_subwords_make_a_word_known(spark):
    vecs = spark.createDataFrame([(0, "کتاب", [1.0, 0.0])], "ix bigint, word string, vec array<float>")
    df = spark.createDataFrame([("کتاب",), ("ab",), ("",), (None,)], "word string")
    known = lambda grams: {r["word"]: r["known"] for r in embeddings.contains(df, vecs, subwords=grams).collect()}
    assert known((3, 6, 10)) == {"کتاب": True, "ab": True, "": False, None: False}
    assert known((5, 6, 10)) == {"کتاب": True, "ab": False, "": False, None: False} == known((0, 0, 0))


def test_means_of_very_many_vectors_are_folded_before_the_shuffle(spark):
    vecs = spark.range(2000).select(F.col("id").alias("ix"), F.col("id").cast("string").alias("word"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    sents = spark.createDataFrame([(1, [str(i) for i in range(2000)] + ["0", None, "no"]), (2, ["no"]), (3, None)], "key int, tokens array<string>")
    got = {r["key"]: r["embedding"] for r in embeddings.embed_sentences(sents, vecs).collect()}
    assert abs(got[1][0] - 1999 * 1000 / 2001) < 1e-6 and got[1][1] == 1.0 and got[2] == [0.0, 0.0] == got[3]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as S

    from parsloom.operators import tables

    none = S(isDefined=lambda: False)
    sc = S(master="spark://x:7077", _jsc=S(sc=lambda: S(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        tables.shared_dir(S(conf=S(get=lambda *_: None), sparkContext=sc))
    assert tables.shared_dir(S(conf=S(get=lambda *_: "hdfs://x"), sparkContext=sc)) == "hdfs://x"
