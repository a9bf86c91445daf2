"""Spell correction: distinct words, a deletion index over the lexicon, exact verification."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parsloom.operators.dims import sized

#: The letters that may be put into a word.
ALPHABET = "اآأإبپتثجچحخدذرزژسشصضطظعغفقکكگلمنوؤهةۀیيىئ"


def probability(words: DataFrame, lexicon: DataFrame, word: str = "word", into: str = "probability") -> DataFrame:
    """words with their share of the lexicon's total frequency; 0 for words outside of it, null words included."""
    total = lexicon.agg(F.greatest(F.coalesce(F.sum("frequency"), F.lit(0)), F.lit(1)).alias("_total"))
    probed = words.join(sized(lexicon.select(F.col("word").alias(word), F.col("frequency").alias("_f"))), word, "left")
    return probed.join(F.broadcast(total)).select(*[probed[c] for c in words.columns], (F.coalesce("_f", F.lit(0)) / F.col("_total")).alias(into))


def edits1(word: Column, alphabet: str = ALPHABET) -> Column:
    """All strings one edit away: a letter deleted, two neighbours swapped, a letter replaced or put in. Swapped equal
    neighbours give the word itself."""
    n = F.length(word)
    letters = F.array(*map(F.lit, alphabet))
    none = F.array().cast("array<string>")
    left = lambda i: F.substring(word, F.lit(1), i)
    right = lambda i: F.substring(word, i + 1, n)
    upto = lambda k: F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    deletes = F.transform(upto(1), lambda i: F.concat(left(i), right(i + 1)))
    swaps = F.transform(upto(2), lambda i: F.concat(left(i), F.substring(word, i + 2, F.lit(1)), F.substring(word, i + 1, F.lit(1)), right(i + 2)))
    replaces = F.flatten(F.transform(upto(1), lambda i: F.transform(F.filter(letters, lambda c: c != F.substring(word, i + 1, F.lit(1))), lambda c: F.concat(left(i), c, right(i + 1)))))
    inserts = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i)))))
    return F.array_distinct(F.concat(deletes, swaps, F.coalesce(replaces, none), inserts))


def _one_edit(a: str, b: str, letters: frozenset[str]) -> bool:
    """Whether b is among the strings one edit away from a."""
    n, m = len(a), len(b)
    if n == m:
        if a == b:
            return any(a[i] == a[i + 1] for i in range(n - 1))
        at = [i for i in range(n) if a[i] != b[i]]
        return len(at) == 1 and b[at[0]] in letters or len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]
    if n == m + 1:
        return any(a[:i] + a[i + 1 :] == b for i in range(n))
    return m == n + 1 and any(b[i] in letters and b[:i] + b[i + 1 :] == a for i in range(m))


def _within(a: str, b: str, edits: int, letters: frozenset[str]) -> bool:
    """Whether b comes of a by at most so many edits, two at most: the first difference is deleted, replaced, put in or swapped.

    Two edits that meet in one place are told beside that: a letter swapped past two others, and two letters swapped past
    one that goes."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a and not b:
        return True
    if not edits or abs(len(a) - len(b)) > edits:
        return False
    if a and _within(a[1:], b, edits - 1, letters):
        return True
    if b and b[0] in letters and (_within(a, b[1:], edits - 1, letters) or a and _within(a[1:], b[1:], edits - 1, letters)):
        return True
    if len(a) > 1 and _within(a[1] + a[0] + a[2:], b, edits - 1, letters):
        return True
    return edits > 1 and len(a) > 2 and (a[2] + a[:2] + a[3:] == b or b[:2] == a[2] + a[0] and a[3:] == b[2:])


def _deletions(words: pd.Series) -> pd.Series:
    out = []
    for w in words:
        n = len(w)
        out.append(sorted({"".join(c for i, c in enumerate(w) if i not in drop) for k in (0, 1, 2) if k <= n for drop in combinations(range(n), k)}))
    return pd.Series(out, dtype=object)


def candidates(words: DataFrame, lexicon: DataFrame, word: str = "word", alphabet: str = ALPHABET) -> DataFrame:
    """(word, candidate) for every distinct word: itself where it is known, else known words one edit away, else two, else itself.

    Edits are found through deletions: words two edits apart have a common string two deletions away at most. So the
    lexicon's deletions are joined with those of the unknown words, and each pair is verified once against the letters that
    may be put in. Null words are left out; "" is a word."""
    letters = frozenset(alphabet)
    distinct = words.select(F.col(f"`{word}`").alias("word")).where("word is not null").distinct()
    table = lexicon.select(F.col("word").alias("candidate")).where("candidate is not null").distinct()
    asked = distinct.join(sized(table.select(F.col("candidate").alias("word"), F.lit(True).alias("_in"))), "word", "left")
    deletions = F.pandas_udf(_deletions, "array<string>")

    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1 if _one_edit(x, y, letters) else 2 if _within(x, y, 2, letters) else 9 for x, y in zip(a, b)], dtype="int32")

    index = table.select("candidate", F.explode(deletions("candidate")).alias("d"))
    pairs = asked.where("_in is null").select("word", F.explode(deletions("word")).alias("d")).join(index, "d").select("word", "candidate")
    # a fixed number of partitions: the pairs are few bytes, but each is work
    pairs = pairs.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word", "candidate").distinct()
    # two edits change four places at most, and two letters come or go
    near = pairs.where((F.abs(F.length("word") - F.length("candidate")) <= 2) & (F.levenshtein("word", "candidate", 4) >= 0))
    graded = near.select("word", "candidate", edits("word", "candidate").alias("edits")).where("edits <= 2")
    own = asked.select("word", F.col("word").alias("candidate"), F.when(F.col("_in"), 0).otherwise(3).alias("edits"))
    least = F.min("edits").over(Window.partitionBy("word"))
    return own.unionByName(graded).withColumn("_least", least).where("edits = _least").select("word", "candidate")


def correct(words: DataFrame, lexicon: DataFrame, word: str = "word", into: str = "correction", alphabet: str = ALPHABET) -> DataFrame:
    """words with the most probable candidate; among equals the lesser in code point order. Null for null; repeated rows stay."""
    if into.lower() in (c.lower() for c in words.columns):
        raise ValueError(f"column {into} exists already")
    found = candidates(words, lexicon, word, alphabet)
    freq = sized(lexicon.select(F.col("word").alias("candidate"), "frequency"))
    best = found.join(freq, "candidate", "left").groupBy("word").agg(F.min_by("candidate", F.struct((-F.coalesce("frequency", F.lit(0))).alias("f"), "candidate")).alias(into))
    return words.join(best.withColumnRenamed("word", word), word, "left").select(*words.columns, into)
