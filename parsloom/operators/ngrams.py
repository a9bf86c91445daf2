"""A bigram language model as tables of counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parsloom.operators.dims import sized
from parsloom.operators.tables import written


def _pairs(tokens: Column) -> Column:
    """Neighbouring tokens of a sentence as an array of (prev, w)."""
    n = F.size(tokens)
    at = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.element_at(tokens, i).alias("prev"), F.element_at(tokens, i + 1).alias("w")))


@dataclass(frozen=True)
class Bigrams:
    """unigrams (w, c) and bigrams (prev, w, c)."""

    unigrams: DataFrame
    bigrams: DataFrame

    def vocab_size(self) -> DataFrame:
        return self.unigrams.agg(F.count("*").alias("vocab_size"))

    def total_tokens(self) -> DataFrame:
        return self.unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total_tokens"))

    def sizes(self) -> DataFrame:
        return self.unigrams.agg(F.count("*").alias("vocab_size"), F.coalesce(F.sum("c"), F.lit(0)).alias("total_tokens"))

    def _totals(self) -> DataFrame:
        return F.broadcast(self.unigrams.agg(F.count("*").alias("_v"), F.coalesce(F.sum("c"), F.lit(0)).alias("_n")))  # one row

    def more(self, sentences: DataFrame, tokens: str = "tokens") -> Bigrams:
        """The model with further sentences counted in."""
        new = train(sentences, tokens)
        one = self.unigrams.unionByName(new.unigrams).groupBy("w").agg(F.sum("c").alias("c"))
        two = self.bigrams.unionByName(new.bigrams).groupBy("prev", "w").agg(F.sum("c").alias("c"))
        return Bigrams(one, two)

    def probability(self, pairs: DataFrame, into: str = "probability") -> DataFrame:
        """pairs (prev, w) with the smoothed probability of w after prev; nulls are unseen."""
        prev = sized(self.unigrams.select(F.col("w").alias("prev"), F.col("c").alias("_c1")))
        out = pairs.join(prev, "prev", "left").join(sized(self.bigrams.withColumnRenamed("c", "_c2")), ["prev", "w"], "left").join(self._totals())
        p = (F.coalesce("_c2", F.lit(0)) + 1) / F.greatest(F.coalesce("_c1", F.lit(0)) + F.col("_v"), F.lit(1))
        return out.select(*pairs.columns, p.alias(into))

    def unigram_probability(self, words: DataFrame, into: str = "probability") -> DataFrame:
        """words (w) with their share of all tokens; 0 for unseen words."""
        out = words.join(sized(self.unigrams.withColumnRenamed("c", "_c")), "w", "left").join(self._totals())
        return out.select(*words.columns, F.when(F.col("_n") > 0, F.coalesce("_c", F.lit(0)) / F.col("_n")).otherwise(F.lit(0.0)).alias(into))

    def next_word(self, words: DataFrame | None = None) -> DataFrame:
        """(prev, next, c): the most frequent successor, of equals the lesser; words without a successor have no row."""
        best = self.bigrams.groupBy("prev").agg(F.min_by(F.struct("w", "c"), F.struct((-F.col("c")).alias("n"), "w")).alias("b"))
        best = best.select("prev", F.col("b.w").alias("next"), F.col("b.c").alias("c"))
        return best if words is None else best.join(words.select("prev").distinct(), "prev", "left_semi")

    def suggest(self, words: DataFrame, n: int) -> DataFrame:
        """(prev, rank, w, probability): the n most probable next words of the whole vocabulary.

        Observed successors come first, by count and word; unseen words follow in code point order, all equally probable.
        Fewer than n observed successors exclude fewer than n words, so the 2n first words of the vocabulary are enough to
        fill up; no word meets the whole vocabulary."""
        asked = words.select("prev").where("prev is not null").distinct()
        order = W.partitionBy("prev").orderBy(F.desc("c"), "w")
        seen = self.bigrams.join(asked, "prev", "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        short = asked.join(seen.groupBy("prev").agg(F.count("*").alias("k")), "prev", "left").select("prev", F.coalesce("k", F.lit(0)).alias("k")).where(F.col("k") < n)
        first = self.unigrams.orderBy("w").limit(2 * n).agg(F.sort_array(F.collect_list("w")).alias("_first"))
        fill = short.join(F.broadcast(first)).select("prev", "k", F.explode("_first").alias("w"))
        fill = fill.join(seen.select("prev", "w"), ["prev", "w"], "left_anti").withColumn("rank", F.col("k") + F.row_number().over(W.partitionBy("prev").orderBy("w"))).where(F.col("rank") <= n)
        both = seen.select("prev", F.col("rank").cast("int"), "w", "c").unionByName(fill.select("prev", F.col("rank").cast("int"), "w", F.lit(0).cast("bigint").alias("c")))
        prev = sized(self.unigrams.select(F.col("w").alias("prev"), F.col("c").alias("_c1")))
        out = both.join(prev, "prev", "left").join(self._totals())
        return out.select("prev", "rank", "w", ((F.col("c") + 1) / F.greatest(F.coalesce("_c1", F.lit(0)) + F.col("_v"), F.lit(1))).alias("probability"))

    def perplexity(self, sentences: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
        """(key, perplexity): 2 to the mean negative log2 probability of the pairs; infinite for sentences of fewer than two tokens."""
        pairs = sentences.select(key, F.explode_outer(_pairs(F.col(tokens))).alias("p")).select(key, "p.prev", "p.w")
        scored = self.probability(pairs)
        mean = F.avg(F.when(F.col("w").isNotNull() | F.col("prev").isNotNull(), -F.log2("probability")))
        return scored.groupBy(key).agg(F.when(mean.isNull(), F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), mean)).alias("perplexity"))


def train(sentences: DataFrame, tokens: str = "tokens", keep: bool = False) -> Bigrams:
    """Counts of tokens and of neighbours within each sentence; null sentences and tokens count nothing.

    keep writes the counts to the shared folder, for a model that is asked more than once. Both counts are partial-and-final hash aggregations; a word that is a third of all tokens folds before the shuffle."""
    one = sentences.select(F.explode(F.col(f"`{tokens}`")).alias("w")).where("w is not null").groupBy("w").agg(F.count("*").alias("c"))
    two = sentences.select(F.explode(_pairs(F.col(f"`{tokens}`"))).alias("p")).select("p.prev", "p.w").where("prev is not null and w is not null").groupBy("prev", "w").agg(F.count("*").alias("c"))
    return Bigrams(written(one), written(two)) if keep else Bigrams(one, two)
