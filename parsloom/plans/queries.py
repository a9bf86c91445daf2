"""The queries of the text operators over the driver's tables, and over the samples where an operator reads files or needs
Persian dimension tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parsloom.functions import chars, rules, vectors
from parsloom.functions import tokens as tk
from parsloom.functions.stem import stem
from parsloom.operators import dims, embeddings, informal, lemmas, ngrams, normalize, spell, verbs
from parsloom.operators.tables import new_path, over_all_cores, written
from parsloom.plans import samples
from parsloom.plans.pipeline import TextPipeline, parser_rows, tag_sentences
from parsloom.sources import corpora
from parsloom.sources import text as source_text
from parsloom.sources import vectors as source_vectors

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_all_cores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _over_text(f: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", f(F.col("text")).alias("text"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(tk.sentences(F.col("text"))).alias("sent_ix", "sentence"))


def _tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("doc_id", "sent_ix", tk.words(F.col("sentence")).alias("tokens"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokenized(spark, sf_dir).select("doc_id", "sent_ix", F.explode("tokens").alias("token"))


def token_top(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "token").limit(20)


def sentence_rows(spark, sf_dir):
    return _sentences(spark, sf_dir)


def token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(F.size(tk.words(F.col("text"))), F.lit(0)).alias("n_tokens"))


def token_rows(spark, sf_dir):
    return _tokenized(spark, sf_dir).select("doc_id", "sent_ix", F.posexplode("tokens").alias("tok_ix", "token"))


def stems(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token").distinct().select("token", stem(F.col("token")).alias("stem"))


def lexicon_counts(spark, sf_dir):
    return dims.lexicon_from(_tokens(spark, sf_dir)).select("word", "frequency")


def stopword_free(spark, sf_dir):
    """Tokens that are no stopwords, by count."""
    stop = _table(spark, sf_dir, "stopwords")
    return dims.unknown(_tokens(spark, sf_dir).select(F.col("token").alias("word")), stop).groupBy("word").agg(F.count("*").alias("c"))


def stopword_hits(spark, sf_dir):
    stop = _table(spark, sf_dir, "stopwords")
    return dims.known(_tokens(spark, sf_dir).select(F.col("token").alias("word")), stop).groupBy("word").agg(F.count("*").alias("c"))


def sorted_stopwords(spark, sf_dir):
    return dims.sorted_words(_table(spark, sf_dir, "stopwords"))


def verb_parts_joined(spark, sf_dir):
    """Documents' sentences with the parts of verbs joined, where any was."""
    parts = tk.participles_of(p for p, _ in samples.VERBS)
    df = _tokenized(spark, sf_dir)
    return df.select("doc_id", "sent_ix", F.array_join(tk.join_verb_parts(F.col("tokens"), parts), " ").alias("words")).where(F.col("words").contains("_"))


MASK_CASES = [
    "نامه به a.b@x.example.org بده", "http://www.example.org/a?b=1 و example.com", "@user_1 و x@y", "#کتاب_خوب و a#b_c d_e", "در ۱۲۳ و 4.5 و ۱٫۲۵ و 1,234", "بدون نشانه", "",
]


def masks(spark, sf_dir):
    t = F.col("text")
    kinds = {"email": tk.mask_emails, "link": tk.mask_links, "account": tk.mask_accounts, "hashtag": tk.mask_hashtags, "number": tk.mask_numbers}
    return spark.createDataFrame([(i, x) for i, x in enumerate(MASK_CASES)], "id int, text string").select("id", *[f(t).alias(n) for n, f in kinds.items()])


def masked_documents(spark, sf_dir):
    o = tk.WordOptions(join_verb_parts=False, emails=True, links=True, accounts=True, hashtags=True, numbers=True)
    return _docs(spark, sf_dir).select("doc_id", F.size(tk.words(F.col("text"), o)).alias("n_tokens"))


def normalized_simple(spark, sf_dir):
    return normalize.normalize(_docs(spark, sf_dir)).select("doc_id", "normalized")


def normalized_full(spark, sf_dir):
    """With a lexicon counted from the documents and the sample verbs."""
    lexicon = written(dims.lexicon_from(_tokens(spark, sf_dir)).where("frequency >= 20"))
    forms = verbs.verb_forms(samples.roots(spark), joined=False)
    return normalize.normalize(_docs(spark, sf_dir), lexicon, forms).select("doc_id", "normalized")


NORMALIZE_CASES = [
    "اِعلاممممم کَرد : « زمین لرزه ای به بُزرگیِ 6 دهم ریشتر ...»", "حَذفِ اِعراب", "5 درصد", '"نرمال‌سازی"', "و ...", "", "كتاب ها", "میروم و نمیروم", "کتاب های من",
]


def normalize_cases(spark, sf_dir):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(NORMALIZE_CASES)], "id int, text string")
    return normalize.normalize(df, samples.lexicon(spark), verbs.verb_forms(samples.roots(spark), joined=False)).select("id", "normalized")


def conjugations(spark, sf_dir):
    return verbs.conjugate(samples.roots(spark)).select("past", "present", "form_ix", "form")


def verb_form_table(spark, sf_dir):
    return verbs.verb_forms(samples.roots(spark))


def lemmas_of_tokens(spark, sf_dir):
    """Lemmas of the documents' distinct tokens, the tokens of at least five occurrences being the lexicon."""
    counts = written(dims.lexicon_from(_tokens(spark, sf_dir)))
    lexicon = counts.where("frequency >= 5")
    return lemmas.lemmatize(counts.select(F.col("word").alias("token")), lexicon, verbs.verb_forms(samples.roots(spark)), "token")


def lemma_cases(spark, sf_dir):
    rows = [("کتاب‌ها", ""), ("آتشفشان", ""), ("می‌روم", ""), ("گفته_شده_است", ""), ("اجتماعی", "ADJ"), ("مردم", "PRON"), ("رفتم", "VERB"), ("رفتم", "V"), ("ناشناخته", None), (None, "N")]
    return lemmas.lemmatize(spark.createDataFrame(rows, "word string, pos string"), samples.lexicon(spark), verbs.verb_forms(samples.roots(spark)), pos="pos")


def token_splits(spark, sf_dir):
    """Cuts of the misspelled words into words of the corrected ones."""
    entries = _table(spark, sf_dir, "spell_entry")
    lexicon = written(dims.lexicon_from(entries.select(F.explode(tk.words(F.col("corrected"))).alias("token"))))
    tokens = entries.select(F.explode(tk.words(F.col("misspelled"))).alias("token"))
    return lemmas.split_tokens(tokens, lexicon, verbs.verb_forms(samples.roots(spark))).select("token", F.to_json("splits").alias("splits"))


def informal_verbs(spark, sf_dir):
    return informal.informal_verb_map(samples.informal_verbs(spark))


INFORMAL_CASES = ["واسه", "کتاب", "می‌تونم", "کتابا", "خونه‌مون", "خونمون", "کتابو", "زمینه", "ناشناس"]


def informal_cases(spark, sf_dir):
    df = spark.createDataFrame([(w,) for w in INFORMAL_CASES], "word string")
    out = informal.formal_candidates(df, informal.informal_verb_map(samples.informal_verbs(spark)), samples.informal_words(spark), samples.lexicon(spark))
    return out.select("word", F.array_join("candidates", "|").alias("candidates"))


def informal_documents(spark, sf_dir):
    """Formal candidates of the words of miras_doc (informal in part), the words themselves being the lexicon from twenty occurrences on."""
    text = over_all_cores(_table(spark, sf_dir, "miras_doc").select("text"))
    counts = written(dims.lexicon_from(text.select(F.explode(tk.words(F.col("text"))).alias("token"))))
    lexicon = counts.where("frequency >= 20")
    out = informal.formal_candidates(counts, informal.informal_verb_map(samples.informal_verbs(spark)), samples.informal_words(spark), lexicon)
    return out.select("word", F.array_join("candidates", "|").alias("candidates"))


def informal_texts(spark, sf_dir):
    """The words of miras_doc's normalized sentences with what they may stand for."""
    docs = over_all_cores(_table(spark, sf_dir, "miras_doc").select("line_no", "text").distinct())
    forms, verb_map = verbs.verb_forms(samples.roots(spark), joined=False), informal.informal_verb_map(samples.informal_verbs(spark))
    out = informal.normalize_text(docs, verb_map, samples.informal_words(spark), samples.lexicon(spark), forms)
    return out.select("line_no", "sent_ix", "tok_ix", "token", F.array_join("candidates", "|").alias("candidates"))


def informal_lemmas(spark, sf_dir):
    df = spark.createDataFrame([("واسه",), ("می‌تونم",), ("رفتن",), ("کتاب",)], "word string")
    return informal.lemmatize_informal(df, samples.lexicon(spark), verbs.verb_forms(samples.roots(spark)), samples.informal_words(spark), samples.informal_verbs(spark))


def informal_lemmas_of_tokens(spark, sf_dir):
    """Informal lemmas of the distinct words of miras_doc."""
    text = over_all_cores(_table(spark, sf_dir, "miras_doc").select("text"))
    counts = written(dims.lexicon_from(text.select(F.explode(tk.words(F.col("text"))).alias("token"))))
    return informal.lemmatize_informal(counts.select("word"), samples.lexicon(spark), verbs.verb_forms(samples.roots(spark)), samples.informal_words(spark), samples.informal_verbs(spark))


def informal_stem_map(spark, sf_dir):
    past, present = informal.stem_maps(samples.roots(spark), samples.informal_verbs(spark))
    return past.withColumn("tense", F.lit("past")).unionByName(present.withColumn("tense", F.lit("present")))


def _spelling(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    entries = _table(spark, sf_dir, "spell_entry")
    lexicon = written(dims.lexicon_from(entries.select(F.explode(tk.words(F.col("corrected"))).alias("token"))))
    return entries.select("entry_id", F.explode(tk.words(F.col("misspelled"))).alias("word")), lexicon


def spell_probability(spark, sf_dir):
    words, lexicon = _spelling(spark, sf_dir)
    return spell.probability(words.select("word").distinct(), lexicon).select("word", F.round("probability", 9).alias("probability"))


def spell_edits(spark, sf_dir):
    """The known words one edit away from each distinct misspelled word."""
    words, lexicon = _spelling(spark, sf_dir)
    near = words.select("word").distinct().select("word", F.explode(spell.edits1(F.col("word"))).alias("candidate"))
    return near.join(lexicon.select(F.col("word").alias("candidate")), "candidate", "left_semi").select("word", "candidate")


def spell_candidates(spark, sf_dir):
    words, lexicon = _spelling(spark, sf_dir)
    return spell.candidates(words, lexicon)


def spell_corrections(spark, sf_dir):
    words, lexicon = _spelling(spark, sf_dir)
    return spell.correct(words, lexicon)


def _model(spark, sf_dir) -> tuple[DataFrame, ngrams.Bigrams]:
    """The documents' sentences, cut once, and their counts."""
    sents = written(_tokenized(spark, sf_dir))
    return sents, ngrams.train(sents, keep=True)


def unigram_counts(spark, sf_dir):
    return ngrams.train(_tokenized(spark, sf_dir)).unigrams


def bigram_counts(spark, sf_dir):
    return ngrams.train(_tokenized(spark, sf_dir)).bigrams


def bigram_probability(spark, sf_dir):
    model = _model(spark, sf_dir)[1]
    return model.probability(model.bigrams.select("prev", "w")).select("prev", "w", F.round("probability", 9).alias("probability"))


def unigram_probability(spark, sf_dir):
    model = _model(spark, sf_dir)[1]
    return model.unigram_probability(model.unigrams.select("w")).select("w", F.round("probability", 9).alias("probability"))


def next_words(spark, sf_dir):
    return ngrams.train(_tokenized(spark, sf_dir)).next_word()


def next_suggestions(spark, sf_dir):
    """Three suggestions after every word that begins a sentence."""
    sents, model = _model(spark, sf_dir)
    first = sents.where(F.size("tokens") > 0).select(F.col("tokens")[0].alias("prev")).distinct()
    return model.suggest(first, 3).select("prev", "rank", "w", F.round("probability", 9).alias("probability"))


def sentence_perplexity(spark, sf_dir):
    sents, model = _model(spark, sf_dir)
    keyed = sents.select(F.concat_ws(":", "doc_id", "sent_ix").alias("key"), "tokens")
    return model.perplexity(keyed, "key").select("key", F.round("perplexity", 4).alias("perplexity"))


def model_sizes(spark, sf_dir):
    return ngrams.train(_tokenized(spark, sf_dir)).sizes()


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ix"), F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"), "label")


def vector_neighbours(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 20, among all."""
    v = _vectors(spark, sf_dir)
    out = embeddings.most_similar(v.where("ix % 20 = 0").select(F.col("ix").alias("query"), "vec"), v.select("ix", "word", "vec"), 10)
    return out.select("query", "rank", "ix", F.round("similarity", 6).alias("similarity"))


def vector_similarity(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    pairs = v.select(F.col("word").alias("a"), (F.col("ix") + 1).cast("string").alias("b"))
    return embeddings.similarity(pairs, v).select("a", "b", F.round("similarity", 6).alias("similarity"))


def vector_odd_ones(spark, sf_dir):
    """The odd one out of each five vectors in a row."""
    groups = _vectors(spark, sf_dir).select((F.col("ix") / 5).cast("bigint").alias("key"), "ix", "word").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ix", "word"))).alias("g"))
    return embeddings.doesnt_match(groups.select("key", F.transform("g", lambda s: s["word"]).alias("words")), _vectors(spark, sf_dir))


def vector_means(spark, sf_dir):
    """The mean vector of each label, its vectors being the tokens."""
    v = _vectors(spark, sf_dir)
    sents = v.select(F.col("label").alias("key"), F.array("word").alias("tokens"))
    out = embeddings.embed_sentences(sents, v)
    return out.select("key", F.posexplode("embedding").alias("i", "x")).select("key", "i", F.round("x", 6).alias("x"))


def text_vectors_similarity(spark, sf_dir):
    """Texts of numbers, each number being the word of a vector: every text and the next one."""
    v = _vectors(spark, sf_dir)
    text = lambda k: F.concat_ws(" ", (F.col("ix") + k).cast("string"), (F.col("ix") + k + 1).cast("string"))
    return embeddings.text_similarity(v.select(text(0).alias("a"), text(2).alias("b")), v).select("a", "b", F.round("similarity", 6).alias("similarity"))


def vector_lookup(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = v.select((F.col("ix") + 3).cast("string").alias("word"))
    out = embeddings.embed_words(asked, v, or_zero=True)
    return out.select("word", F.round(vectors.norm(F.col("vec")), 5).alias("norm"))


def vector_known(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return embeddings.contains(v.select((F.col("ix") + 3).cast("string").alias("word")), v)


def subword_vectors(spark, sf_dir):
    m = source_vectors.read_subword_model(spark, samples.put(spark, "subword_model"))
    words = spark.createDataFrame([("ایران",), ("ناشناس",)], "word string")
    out = embeddings.embed_subwords(words, m.vectors, m.buckets, m.minn, m.maxn, m.bucket)
    return out.select("word", F.posexplode("vec").alias("i", "x")).select("word", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def subword_vectors_of_tokens(spark, sf_dir):
    """Subword vectors of the documents' distinct words."""
    m = source_vectors.read_subword_model(spark, samples.put(spark, "subword_model"))
    words = written(dims.lexicon_from(_tokens(spark, sf_dir))).select("word")
    out = embeddings.embed_subwords(words, m.vectors, m.buckets, m.minn, m.maxn, m.bucket)
    return out.select("word", F.posexplode("vec").alias("i", "x")).select("word", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def subword_neighbours(spark, sf_dir):
    """The nearest word of the model for every distinct word of the documents, by subword vectors."""
    m = source_vectors.read_subword_model(spark, samples.put(spark, "subword_model"))
    words = written(dims.lexicon_from(_tokens(spark, sf_dir)).select("word"))
    asked = written(embeddings.embed_subwords(words, m.vectors, m.buckets, m.minn, m.maxn, m.bucket).select(F.xxhash64("word").alias("query"), F.col("word").alias("asked"), "vec"))
    own = embeddings.embed_subwords(m.vectors, m.vectors, m.buckets, m.minn, m.maxn, m.bucket).join(m.vectors.select("word", "ix"), "word").select("ix", "word", "vec")
    out = embeddings.most_similar(asked, own, 1, exclude_self=False).join(asked.select("query", "asked"), "query")
    return out.select("asked", "rank", "word", F.round("similarity", 5).alias("similarity"))


def subword_known(spark, sf_dir):
    """Whether the documents' distinct words have a row or a subword of the model."""
    m = source_vectors.read_subword_model(spark, samples.put(spark, "subword_model"))
    words = dims.lexicon_from(_tokens(spark, sf_dir)).select("word")
    return embeddings.contains(words, m.vectors, subwords=(m.minn, m.maxn, m.bucket))


def pipeline_sentences(spark, sf_dir):
    """Documents normalized without a lexicon, cut into sentences and words."""
    out = TextPipeline().tokenize_sentences(_docs(spark, sf_dir))
    return out.select("doc_id", "sent_ix", F.array_join("words", " ").alias("words"))


def parser_input(spark, sf_dir):
    tagged = spark.createDataFrame([(1, 0, "کتاب‌ها", "N"), (1, 1, "می‌روم", "VERB")], "sent_ix int, tok_ix int, token string, tag string")
    return parser_rows(tagged, samples.lexicon(spark), verbs.verb_forms(samples.roots(spark)))


def _lexicon_tags(words: Column) -> Column:
    """N for the words of the sample lexicon, VERB for past roots and what begins with the imperfect's prefix, X for others."""
    nouns, pasts = [w for w, _ in samples.LEXICON], [a for a, _ in samples.VERBS]
    return F.transform(words, lambda w: F.when(w.isin(nouns), "N").when(w.isin(pasts) | w.startswith("می" + samples.Z), "VERB").otherwise("X"))


def parser_input_of_sentences(spark, sf_dir):
    """The parser's rows of the documents' sentences, tagged by a lexicon."""
    tagged = tag_sentences(TextPipeline().tokenize_sentences(_docs(spark, sf_dir)).select("doc_id", "sent_ix", "words"), _lexicon_tags)
    rows = tagged.select("doc_id", "sent_ix", F.posexplode(F.arrays_zip("words", "tags")).alias("tok_ix", "_token"))
    rows = rows.select("doc_id", "sent_ix", "tok_ix", F.col("_token.words").alias("token"), F.col("_token.tags").alias("tag"))
    return parser_rows(rows, samples.lexicon(spark), verbs.verb_forms(samples.roots(spark)))


def streamed_counts(spark, sf_dir):
    """Word counts of the documents as a stream, at its end."""
    from parsloom.streaming.counts import running_counts

    at = new_path(spark, "stream")
    docs = _docs(spark, sf_dir)
    path = f"{sf_dir}/documents.parquet"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    single = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.readStream.schema(_table(spark, sf_dir, "documents").schema)
    stream = (reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir) if single else reader.parquet(path)).select(*docs.columns)
    counts = running_counts(stream)
    run = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/counts")).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/counts")


def _tagged(read: Callable[[SparkSession, str], DataFrame], name: str) -> Query:
    def query(spark, sf_dir):
        return source_text.tagged_words(read(spark, samples.put(spark, name))).drop("file")

    return query


def _plain(read: Callable[[SparkSession, str], DataFrame], name: str, columns: list[str] | None = None) -> Query:
    def query(spark, sf_dir):
        df = read(spark, samples.put(spark, name)).drop("file")
        return df.selectExpr(*columns) if columns else df

    return query


def _vector_rows(read: Callable[[SparkSession, str], DataFrame], name: str) -> Query:
    return lambda spark, sf_dir: read(spark, samples.put(spark, name)).select("ix", "word", F.posexplode("vec").alias("i", "x")).select("ix", "word", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


SOURCES: dict[str, Query] = {
    "source_arman": _tagged(lambda s, p: corpora.arman(s, p, "test"), "arman"),
    "source_ner": _tagged(corpora.ner, "ner"),
    "source_bijankhan": _tagged(corpora.bijankhan, "bijankhan"),
    "source_dadegan": _tagged(corpora.dadegan, "dadegan"),
    "source_universal_dadegan": _tagged(lambda s, p: corpora.universal_dadegan(s, p, "universal"), "universal_dadegan"),
    "source_degarbayan": _plain(corpora.degarbayan, "degarbayan"),
    "source_faspell": _plain(lambda s, p: corpora.faspell_main(s, p).unionByName(corpora.faspell_ocr(s, p)), "faspell", ["misspelled", "corrected", "cast(error_category as string) as error_category"]),
    "source_hamshahri": lambda spark, sf_dir: corpora.hamshahri(spark, samples.put(spark, "hamshahri")).select("id", "title", "text", "issue", "date", F.to_json("categories").alias("categories")),
    "source_mirastext": _plain(corpora.mirastext, "mirastext"),
    "source_mizan": _plain(corpora.mizan_pairs, "mizan"),
    "source_naab": _plain(lambda s, p: corpora.naab(s, p, "train"), "naab"),
    "source_plain_text": lambda spark, sf_dir: corpora.plain_text(spark, samples.put(spark, "plain_text")).select("sent_ix", F.array_join("words", " ").alias("words")),
    "source_persica": _plain(corpora.persica, "persica"),
    "source_peykare": _tagged(corpora.peykare, "peykare"),
    "source_pn_summary": lambda spark, sf_dir: corpora.pn_summary(spark, samples.put(spark, "pn_summary"), "train").select("id", "title", "article", "summary", "category", F.array_join("categories", "|").alias("categories"), "network", "link"),
    "source_quran": _plain(corpora.quran_parts, "quran", ["chapter", "verse", "word", "part", "text", "tag", "lem", "root"]),
    "source_quran_words": _plain(corpora.quran_words, "quran", ["loc", "text", "tag", "lem", "root"]),
    "source_sentipers": lambda spark, sf_dir: corpora.sentipers_comments(spark, samples.put(spark, "sentipers")).select("title", "id", "holder", "value", F.to_json("sentences").alias("sentences")),
    "source_tnews": _plain(corpora.tnews, "tnews"),
    "source_treebank": _tagged(corpora.treebank, "treebank"),
    "source_verb_valency": _plain(corpora.verb_valency, "verb_valency"),
    "source_wikipedia": _plain(corpora.wikipedia, "wikipedia"),
    "source_lexicon": lambda spark, sf_dir: dims.read_lexicon(spark, samples.put(spark, "lexicon")).select("word", "frequency", F.array_join("pos_tags", ",").alias("pos_tags")),
    "source_verb_roots": lambda spark, sf_dir: dims.read_verb_roots(spark, samples.put(spark, "verb_roots")),
    "source_stopwords": lambda spark, sf_dir: dims.sorted_words(dims.read_words(spark, samples.put(spark, "stopwords"))),
    "source_informal_words": lambda spark, sf_dir: dims.read_informal_words(spark, samples.put(spark, "informal_words")),
    "source_informal_verbs": lambda spark, sf_dir: dims.read_informal_verbs(spark, samples.put(spark, "informal_verbs")),
    "source_text_vectors": _vector_rows(source_vectors.read_text_vectors, "text_vectors"),
    "source_binary_vectors": _vector_rows(source_vectors.read_binary_vectors, "binary_vectors"),
}

TEXT: dict[str, Query] = {
    "chars_unified": _over_text(chars.unify),
    "persian_style": _over_text(rules.persian_style),
    "persian_digits": _over_text(chars.persian_digits),
    "diacritics_stripped": _over_text(chars.strip_diacritics),
    "ligatures_spelled_out": _over_text(chars.spell_out_ligatures),
    "specials_stripped": _over_text(chars.strip_specials),
    "extra_space": _over_text(rules.extra_space),
    "affix_space": _over_text(rules.affix_space),
    "punctuation_space": _over_text(rules.punctuation_space),
    "fewer_repeats": _over_text(rules.fewer_repeats),
    "emails_masked": _over_text(tk.mask_emails),
    "html_stripped": _over_text(chars.strip_html),
}

OPERATORS: list[Query] = [
    token_top, sentence_rows, token_counts, token_rows, stems, lexicon_counts, stopword_free, stopword_hits, sorted_stopwords, verb_parts_joined, masks, masked_documents, normalized_simple, normalized_full, normalize_cases,
    conjugations, verb_form_table, lemmas_of_tokens, lemma_cases, token_splits, informal_verbs, informal_cases, informal_documents, informal_texts, informal_lemmas, informal_lemmas_of_tokens, informal_stem_map,
    spell_probability, spell_edits, spell_candidates, spell_corrections, unigram_counts, bigram_counts, bigram_probability, unigram_probability, next_words, next_suggestions, sentence_perplexity, model_sizes,
    vector_neighbours, vector_similarity, vector_odd_ones, vector_means, text_vectors_similarity, vector_lookup, vector_known, subword_vectors, subword_vectors_of_tokens, subword_neighbours, subword_known, pipeline_sentences, parser_input, parser_input_of_sentences, streamed_counts,
]


def queries() -> dict[str, Query]:
    return {**{f.__name__: f for f in OPERATORS}, **TEXT, **SOURCES}
