"""Word and sentence embeddings over tables of vectors (ix, word, vec)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsloom.functions.tokens import words
from parsloom.functions.vectors import cosine, unit, zeros
from parsloom.operators.dims import sized

#: Queries that meet the vectors in one pass, as one matrix; more take more passes.
QUERY_BLOCK = 20_000
#: Similarities that a task holds at once (32 MB).
CELLS = 4_000_000


def dim(vectors: DataFrame) -> int:
    row = vectors.where("vec is not null").select(F.size("vec")).head()
    return row[0] if row else 0


def normalized(vectors: DataFrame) -> DataFrame:
    """Vectors of length one; of a repeated word the last index counts."""
    return vectors.groupBy("word").agg(F.max_by(F.struct("ix", "vec"), "ix").alias("r")).select("r.ix", "word", unit(F.col("r.vec")).alias("vec"))


def vocabulary(vectors: DataFrame) -> DataFrame:
    return vectors.select("ix", "word")


def embed_words(asked: DataFrame, vectors: DataFrame, word: str = "word", or_zero: bool = False, into: str = "vec") -> DataFrame:
    """asked with the word's vector: null, or zeros, for unknown and null words."""
    out = asked.join(sized(vectors.select(F.col("word").alias(word), F.col("vec").alias(into))), word, "left")
    return out.withColumn(into, F.coalesce(into, zeros(dim(vectors)).cast("array<float>"))) if or_zero else out


def similarity(pairs: DataFrame, vectors: DataFrame, a: str = "a", b: str = "b", into: str = "similarity") -> DataFrame:
    """pairs of words with their cosine similarity: null where a word is unknown, 0 where a vector is zero."""
    v = sized(vectors.select("word", "vec"))
    out = pairs.join(v.select(F.col("word").alias(a), F.col("vec").alias("_a")), a, "left").join(v.select(F.col("word").alias(b), F.col("vec").alias("_b")), b, "left")
    return out.select(*pairs.columns, cosine(F.col("_a"), F.col("_b")).alias(into))


def most_similar(queries: DataFrame, vectors: DataFrame, n: int, exclude_self: bool = True) -> DataFrame:
    """(query, rank, ix, word, similarity): for each query (query, vec) the n vectors of the greatest cosine, of equals the lesser ix.

    The queries are the stated set: they come in blocks of QUERY_BLOCK as one matrix, each block meets every vector once, batch
    by batch, and each task keeps its best n per query; so n rows per query and task are shuffled. A null query vector has no
    rows. exclude_self leaves the vector whose ix is the query out."""
    kind = vectors.schema["word"].dataType
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("ix", T.LongType()), T.StructField("word", kind), T.StructField("similarity", T.DoubleType())])
    rows = queries.where("vec is not null").select(F.col("query").cast("bigint"), "vec")
    out, block = None, []

    def search(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block], dtype=np.int64)
        q = np.array([r[1] for r in block], dtype=np.float64)
        lengths = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, lengths, out=np.zeros_like(q), where=lengths > 0)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            top_s = np.full((len(ids), 0), -np.inf)
            top_i = np.zeros((len(ids), 0), dtype=np.int64)
            names: dict[int, object] = {}
            step = max(1, CELLS // len(ids))
            for pdf in batches:
                for lo in range(0, len(pdf), step):
                    part = pdf.iloc[lo : lo + step]
                    v = np.stack(part["vec"].to_numpy()).astype(np.float64)
                    lengths = np.linalg.norm(v, axis=1, keepdims=True)
                    v = np.divide(v, lengths, out=np.zeros_like(v), where=lengths > 0)
                    ix = part["ix"].to_numpy(dtype=np.int64)
                    s = np.round(q @ v.T, 12)
                    if exclude_self:
                        s[ids[:, None] == ix[None, :]] = -np.inf
                    s, i = np.hstack([top_s, s]), np.hstack([top_i, np.broadcast_to(ix, (len(ids), len(ix)))])
                    order = np.lexsort((i, -s), axis=1)[:, :n]
                    top_s, top_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                    names |= dict(zip(ix.tolist(), part["word"].tolist()))
                    keep = set(np.unique(top_i).tolist())
                    names = {k: w for k, w in names.items() if k in keep}
            ok = np.isfinite(top_s)
            r, c = np.nonzero(ok)
            if len(r):
                yield pd.DataFrame({"query": ids[r], "ix": top_i[r, c], "word": [names[k] for k in top_i[r, c].tolist()], "similarity": top_s[r, c]})

        return vectors.where("vec is not null").select(F.col("ix").cast("bigint"), "word", "vec").mapInPandas(best, schema)

    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            out, block = search(block) if out is None else out.unionByName(search(block)), []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    order = W.partitionBy("query").orderBy(F.desc("similarity"), "ix")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query", F.col("rank").cast("int"), "ix", "word", "similarity")


def doesnt_match(groups: DataFrame, vectors: DataFrame, key: str = "key", words: str = "words") -> DataFrame:
    """(key, odd): the word of each group with the lowest mean cosine to the others, of equals the first.

    No row where a word is unknown or the group is empty; a single word is its own odd one out. A group is one row's array."""
    one = groups.select(key, F.size(words).alias("n"), F.posexplode(words).alias("i", "word"))
    v = sized(vectors.select("word", "vec"))
    known = one.join(v, "word").groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("i", "word", "vec"))).alias("g")).where(F.size("g") == F.col("n"))
    mean = F.transform(
        "g",
        lambda x: F.struct(
            F.when(F.col("n") > 1, F.aggregate("g", F.lit(0.0), lambda s, y: s + F.when(y["i"] != x["i"], cosine(x["vec"], y["vec"])).otherwise(F.lit(0.0))) / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("mean"),
            x["i"].alias("i"),
            x["word"].alias("word"),
        ),
    )
    return known.select(key, F.array_min(mean)["word"].alias("odd"))


def embed_sentences(sentences: DataFrame, vectors: DataFrame, key: str = "key", tokens: str = "tokens", into: str = "embedding") -> DataFrame:
    """(key, embedding): the mean of the known tokens' vectors; zeros where none is known, null tokens included.

    Sums fold before the shuffle token by token: each distinct token of a sentence is joined once with its count."""
    d = dim(vectors)
    parts = sentences.select(key, F.explode(tokens).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    known = parts.join(sized(vectors.select("word", "vec")), "word")
    mean = _means(known, key).withColumnRenamed("vec", into)
    return sentences.select(key).distinct().join(mean, key, "left").select(key, F.coalesce(into, zeros(d)).alias(into))


def _means(rows: DataFrame, key: str) -> DataFrame:
    """(key, vec): the mean of the key's vectors, each n times. Sums fold component by component before the shuffle, so a key has at
    most as many rows as a vector has components, however many vectors it has."""
    each = rows.select(key, "n", F.posexplode("vec").alias("_i", "_x")).groupBy(key, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("n")) / F.sum("n")).alias("_m"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_all")).select(key, F.transform("_all", lambda s: s["_m"]).alias("vec"))


def embed_texts(texts: DataFrame, vectors: DataFrame, key: str = "key", text: str = "text", into: str = "embedding") -> DataFrame:
    """(key, embedding) of texts, cut into words but not normalized; zeros for null and empty texts."""
    return embed_sentences(texts.select(key, words(F.col(f"`{text}`")).alias("tokens")), vectors, key, "tokens", into)


def text_similarity(pairs: DataFrame, vectors: DataFrame, a: str = "a", b: str = "b", into: str = "similarity") -> DataFrame:
    """pairs of texts with the cosine similarity of their mean vectors; each distinct text is embedded once, a null text has a null one."""
    texts = pairs.select(F.col(a).alias("key")).union(pairs.select(b)).where("key is not null").distinct()
    means = embed_texts(texts.withColumn("text", F.col("key")), vectors)
    out = pairs.join(means.select(F.col("key").alias(a), F.col("embedding").alias("_a")), a, "left").join(means.select(F.col("key").alias(b), F.col("embedding").alias("_b")), b, "left")
    return out.select(*pairs.columns, cosine(F.col("_a"), F.col("_b")).alias(into))


def sentence_similarity(a: DataFrame, b: DataFrame, vectors: DataFrame, key: str = "key", tokens: str = "tokens") -> DataFrame:
    """(key, similarity) of the sentences with the same key in a and b."""
    x = embed_sentences(a, vectors, key, tokens, "_a")
    return x.join(embed_sentences(b, vectors, key, tokens, "_b"), key).select(key, cosine(F.col("_a"), F.col("_b")).alias("similarity"))


# Subword vectors


def subword_hash(raw: bytes) -> int:
    """32-bit FNV-1a over signed bytes."""
    h = 2166136261
    for b in raw:
        h = ((h ^ (b if b < 128 else b | 0xFFFFFF00)) * 16777619) & 0xFFFFFFFF
    return h


def subword_buckets(word: str, minn: int, maxn: int, bucket: int) -> list[int]:
    """The buckets of all byte n-grams of <word>, from left to right."""
    if not (minn and maxn and bucket):
        return []
    raw = f"<{word}>".encode()
    return [subword_hash(raw[i:j]) % bucket for i in range(len(raw)) for j in range(i + minn, min(i + maxn, len(raw)) + 1)]


def embed_subwords(words: DataFrame, vectors: DataFrame, buckets: DataFrame, minn: int, maxn: int, bucket: int, word: str = "word", into: str = "vec") -> DataFrame:
    """(word, vec) of every distinct word: the mean of its own row and its subwords' rows, of length one; null where there is neither.

    buckets: (bucket, vec). Subwords are joined with the bucket table, so neither table has to fit anywhere."""

    @F.pandas_udf("array<int>")
    def grams(ws: pd.Series) -> pd.Series:
        return pd.Series([subword_buckets(w, minn, maxn, bucket) for w in ws], dtype=object)

    distinct = words.select(F.col(f"`{word}`").alias("word")).where("word is not null").distinct()
    sub = distinct.select("word", F.explode(grams("word")).alias("bucket")).groupBy("word", "bucket").agg(F.count("*").alias("n"))
    rows = sub.join(buckets.select("bucket", "vec"), "bucket").select("word", "n", "vec")
    rows = rows.unionByName(distinct.join(vectors.select("word", "vec"), "word").select("word", F.lit(1).cast("bigint").alias("n"), "vec"))
    mean = _means(rows, "word")
    return distinct.join(mean.select("word", unit(F.col("vec")).cast("array<float>").alias(into)), "word", "left")


def contains(words: DataFrame, vectors: DataFrame, word: str = "word", subwords: tuple[int, int, int] | None = None, into: str = "known") -> DataFrame:
    """words with whether a vector can be had: a row of its own or, where the model's subwords (minn, maxn, bucket) are given, any byte
    n-gram of <word> of minn to maxn bytes. False for null."""
    out = words.join(sized(vectors.select(F.col("word").alias(word), F.lit(True).alias("_k"))), word, "left")
    known = F.col("_k").isNotNull()
    if subwords and all(subwords):
        minn, maxn, _ = subwords
        known = known | (F.lit(minn <= maxn) & (F.octet_length(F.col(word)) + 2 >= minn))
    return out.select(*words.columns, F.coalesce(known, F.lit(False)).alias(into))
