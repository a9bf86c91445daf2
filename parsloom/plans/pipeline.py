"""One entrance to the text operators, and the table shape for parsers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsloom.functions import tokens as tk
from parsloom.functions.stem import stem
from parsloom.operators.dims import past_roots
from parsloom.operators.lemmas import lemmatize
from parsloom.operators.normalize import NormalizerOptions, normalize
from parsloom.operators.verbs import verb_forms


class Tagger(Protocol):
    """Gives each token of a sentence its tag: an expression from an array of tokens to an array of tags."""

    def __call__(self, tokens: Column) -> Column: ...


@dataclass
class TextPipeline:
    """Normalizing, cutting, stemming and lemmatizing of a table's text with one set of dimension tables.

    Every method takes a DataFrame and gives one back; nothing runs until an action. Without a lexicon the normalizer's
    lexicon steps are off, and without roots no verb parts are joined."""

    lexicon: DataFrame | None = None
    roots: DataFrame | None = None
    normalizer: NormalizerOptions | None = None
    words_options: tk.WordOptions = field(default_factory=tk.WordOptions)

    def __post_init__(self) -> None:
        self._joined = verb_forms(self.roots) if self.roots is not None else None
        self._plain = verb_forms(self.roots, joined=False) if self.roots is not None else None
        # verb roots are a fixed table of a language, some hundreds of rows
        self._participles = tk.participles_of(r["root"] for r in past_roots(self.roots).collect()) if self.roots is not None else []

    def normalize(self, df: DataFrame, text: str = "text", into: str = "normalized") -> DataFrame:
        return normalize(df, self.lexicon, self._plain, text, into, self.normalizer)

    def sentences(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df's rows once per sentence, with sent_ix and sentence."""
        return df.select("*", F.posexplode(tk.sentences(F.col(f"`{text}`"))).alias("sent_ix", "sentence"))

    def words(self, df: DataFrame, text: str = "text", into: str = "words") -> DataFrame:
        o = self.words_options
        if o.join_verb_parts and not self._participles:
            o = tk.WordOptions(**{**o.__dict__, "join_verb_parts": False})
        return df.withColumn(into, tk.words(F.col(f"`{text}`"), o, self._participles))

    def normalized_words(self, df: DataFrame, text: str = "text", into: str = "words") -> DataFrame:
        return self.words(self.normalize(df, text, "_normalized"), "_normalized", into).drop("_normalized")

    def tokenize_sentences(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Normalized, cut into sentences, and these into words: df's rows once per sentence with sent_ix, sentence and words."""
        sents = self.sentences(self.normalize(df, text, "_normalized"), "_normalized").drop("_normalized")
        return self.words(sents, "sentence", "words")

    def stem(self, df: DataFrame, word: str = "word", into: str = "stem") -> DataFrame:
        return df.withColumn(into, stem(F.col(f"`{word}`")))

    def lemmatize(self, df: DataFrame, word: str = "word", pos: str | None = None, into: str = "lemma") -> DataFrame:
        if self.lexicon is None or self._joined is None:
            raise ValueError("lemmas need a lexicon and verb roots")
        return lemmatize(df, self.lexicon, self._joined, word, pos, into)


def tag_sentences(sentences: DataFrame, tagger: Callable[[Column], Column], tokens: str = "words", into: str = "tags") -> DataFrame:
    return sentences.withColumn(into, tagger(F.col(f"`{tokens}`")))


def parser_rows(tagged: DataFrame, lexicon: DataFrame, forms: DataFrame) -> DataFrame:
    """Rows of the ten-column format from (sentence columns, tok_ix, token, tag): id, form, lemma, upos, xpos, feats, head, deprel, with
    head 0 and _ for what a parser would fill in."""
    out = lemmatize(tagged, lexicon, forms, "token", "tag", "lemma")
    rest = [c for c in tagged.columns if c not in ("tok_ix", "token", "tag")]
    return out.select(
        *rest, (F.col("tok_ix") + 1).alias("id"), F.col("token").alias("form"), "lemma", F.col("tag").alias("upos"), F.col("tag").alias("xpos"), F.lit("_").alias("feats"), F.lit(0).alias("head"), F.lit("_").alias("deprel")
    )
