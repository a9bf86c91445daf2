"""The normalizer: one projection where no lexicon is needed, one pass through Python where it is."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsloom.functions import chars, rules
from parsloom.functions.chars import LETTERS, ZWNJ
from parsloom.functions.stem import SUFFIXES
from parsloom.functions.tokens import words
from parsloom.operators.dims import BROADCAST_ROWS


@dataclass(frozen=True)
class NormalizerOptions:
    """Which steps run; unification always does."""

    persian_style: bool = True
    persian_numbers: bool = True
    remove_diacritics: bool = True
    correct_spacing: bool = True
    unicodes_replacement: bool = True
    remove_specials_chars: bool = True
    decrease_repeated_chars: bool = True
    separate_mi: bool = True

    @classmethod
    def without_lexicon(cls) -> NormalizerOptions:
        return cls(correct_spacing=False, separate_mi=False)

    def but(self, **steps: bool) -> NormalizerOptions:
        return replace(self, **steps)


def before_spacing(text: Column, o: NormalizerOptions) -> Column:
    text = chars.unify(text)
    if o.persian_style:
        text = rules.persian_style(text)
    if o.persian_numbers:
        text = chars.persian_digits(text)
    if o.remove_diacritics:
        text = chars.strip_diacritics(text)
    return text


def after_spacing(text: Column, o: NormalizerOptions) -> Column:
    if o.unicodes_replacement:
        text = chars.spell_out_ligatures(text)
    if o.remove_specials_chars:
        text = chars.strip_specials(text)
    return text


def normalize_column(text: Column, options: NormalizerOptions = NormalizerOptions.without_lexicon()) -> Column:
    """All steps that need no lexicon as one expression; repeats are reduced to two. null for null, "" for ""."""
    if options.correct_spacing or options.separate_mi:
        raise ValueError("spacing and the verbal prefix need a lexicon and verb forms: use normalize")
    text = after_spacing(before_spacing(text, options), options)
    return rules.fewer_repeats(text) if options.decrease_repeated_chars else text


_SUFFIXES = frozenset(SUFFIXES)
_REPEATED = re.compile(f"[{LETTERS}]*([{LETTERS}])\\1{{2,}}[{LETTERS}]*")
_RUN = re.compile(f"([{LETTERS}])\\1{{2,}}")
_MI = re.compile(f"(?<!\\w)(ن?می)(?=[{LETTERS}])([{LETTERS}]+)")
_WORD_SPLIT = re.compile(r'([؟!?]+|[\d.:]+|[:.،؛»\])}"«\[({/\\])')


def space_tokens(tokens: list[str], frequent: frozenset[str], known: frozenset[str], verbs: frozenset[str]) -> list[str]:
    """Neighbours joined by a joiner where the pair is a verb form or a frequent word, or a suffix follows a known word."""
    out: list[str] = []
    last = ""
    for t in tokens:
        if out:
            pair = last + ZWNJ + t
            if pair in verbs or pair in frequent or (t in _SUFFIXES and last in known):
                out[-1] = last = pair
                continue
        out.append(t)
        last = t
    return out


def spaced_lines(text: str, frequent: frozenset[str], known: frozenset[str], verbs: frozenset[str]) -> str:
    out = []
    for line in text.split("\n"):
        if line.strip():
            tokens = [t for t in _WORD_SPLIT.sub(r" \1 ", line.replace("\t", " ")).split(" ") if t]
            line = " ".join(space_tokens(tokens, frequent, known, verbs))
        out.append(line)
    return "\n".join(out)


def fewer_repeats(text: str, known: frozenset[str]) -> str:
    """Runs of three and more letters: a known word stays, one letter where only that is known, else two."""

    def one(m: re.Match) -> str:
        w = m[0]
        if w in known:
            return w
        single, double = _RUN.sub(r"\1", w), _RUN.sub(r"\1\1", w)
        return single if single in known and double not in known else double

    return _REPEATED.sub(one, text) if _RUN.search(text) else text


def separate_mi(text: str, verbs: frozenset[str]) -> str:
    """A joiner after the verbal prefix where that gives a known form."""
    return _MI.sub(lambda m: m[1] + ZWNJ + m[2] if m[1] + ZWNJ + m[2] in verbs else m[0], text) if "می" in text else text


def _sets(lexicon: DataFrame | None, forms: DataFrame | None, limit: int) -> tuple[frozenset, frozenset, frozenset] | None:
    """(frequent, known, verbs), or None where a table is larger than the limit."""
    known, frequent, verbs = frozenset(), frozenset(), frozenset()
    if lexicon is not None:
        rows = lexicon.select("word", F.coalesce("frequency", F.lit(0))).where("word is not null").limit(limit + 1).collect()
        if len(rows) > limit:
            return None
        known, frequent = frozenset(r[0] for r in rows), frozenset(r[0] for r in rows if r[1] > 0)
    if forms is not None:
        rows = forms.select("form").limit(limit + 1).collect()
        if len(rows) > limit:
            return None
        verbs = frozenset(r[0] for r in rows)
    return frequent, known, verbs


def _candidates(text: str, longest: int) -> set[str]:
    """All strings that the lexicon steps could ask for in a text."""
    out: set[str] = set()
    for line in text.split("\n"):
        tokens = [t for t in _WORD_SPLIT.sub(r" \1 ", line.replace("\t", " ")).split(" ") if t]
        for i in range(len(tokens)):
            joined = tokens[i]
            out.add(joined)
            for t in tokens[i + 1 : i + longest]:
                joined += ZWNJ + t
                out.add(joined)
    for m in _REPEATED.finditer(text) if _RUN.search(text) else ():
        out |= {m[0], _RUN.sub(r"\1", m[0]), _RUN.sub(r"\1\1", m[0])}
    for m in _MI.finditer(text):
        out.add(m[1] + ZWNJ + m[2])
    return out


def _lexicon_steps(df: DataFrame, at: str, o: NormalizerOptions, lexicon: DataFrame, forms: DataFrame | None, limit: int) -> DataFrame:
    """df whose column `at` has gone through spacing; then the steps after it."""
    sets = _sets(lexicon if o.correct_spacing or o.decrease_repeated_chars else None, forms if o.separate_mi else None, limit)
    if sets is not None:
        shared = df.sparkSession.sparkContext.broadcast(sets)  # its size is checked above

        def stage(work):
            @F.pandas_udf("string")
            def run(texts: pd.Series) -> pd.Series:
                return pd.Series([None if s is None else work(s, *shared.value) for s in texts], dtype=object)

            return run

        c = F.col(at)
        if o.correct_spacing:
            c = rules.punctuation_space(rules.affix_space(stage(spaced_lines)(rules.extra_space(c))))
        c = after_spacing(c, o)
        if o.decrease_repeated_chars or o.separate_mi:
            c = stage(lambda s, f, k, v: _late(s, o, k, v))(c)
        return df.withColumn(at, c)
    return _by_join(df, at, o, lexicon, forms)


def _late(text: str, o: NormalizerOptions, known: frozenset[str], verbs: frozenset[str]) -> str:
    if o.decrease_repeated_chars:
        text = fewer_repeats(text, known)
    return separate_mi(text, verbs) if o.separate_mi else text


def _by_join(df: DataFrame, at: str, o: NormalizerOptions, lexicon: DataFrame, forms: DataFrame | None) -> DataFrame:
    """The way for tables too large to broadcast: each text's askable strings are joined with them, then brought to the text.

    Asked strings are distinct per text; a text's answers are bounded by its own length."""
    longest = 1 + max(1, lexicon.agg(F.max(F.length(F.regexp_replace("word", f"[^{ZWNJ}]", "")))).collect()[0][0] or 0)
    if forms is not None:
        longest = max(longest, 3)
    table = lexicon.select("word", (F.coalesce("frequency", F.lit(0)) > 0).alias("frequent"), F.lit(True).alias("known"), F.lit(False).alias("verb"))
    if forms is not None:
        table = table.unionByName(forms.select(F.col("form").alias("word"), F.lit(False).alias("frequent"), F.lit(False).alias("known"), F.lit(True).alias("verb")))
    table = table.groupBy("word").agg(F.max("frequent").alias("frequent"), F.max("known").alias("known"), F.max("verb").alias("verb"))

    def answered(df: DataFrame) -> DataFrame:
        @F.pandas_udf("array<string>")
        def ask(texts: pd.Series) -> pd.Series:
            return pd.Series([[] if s is None else sorted(_candidates(s, longest)) for s in texts], dtype=object)

        numbered = df.withColumn("_h", F.xxhash64(at)).withColumn("_n", F.md5(at))
        texts = numbered.select("_n", at).where(F.col(at).isNotNull()).dropDuplicates(["_n"])
        found = texts.select("_n", F.explode(ask(F.col(at))).alias("word")).join(table, "word").groupBy("_n").agg(F.collect_list(F.struct("word", "frequent", "known", "verb")).alias("_known"))
        return numbered.join(found, "_n", "left").drop("_h", "_n")

    def stage(df: DataFrame, work) -> DataFrame:
        @F.pandas_udf("string")
        def run(texts: pd.Series, answers: pd.Series) -> pd.Series:
            out = []
            for s, a in zip(texts, answers):
                rows = [] if a is None else list(a)
                sets = (frozenset(r["word"] for r in rows if r[k]) for k in ("frequent", "known", "verb"))
                out.append(None if s is None else work(s, *sets))
            return pd.Series(out, dtype=object)

        return answered(df).withColumn(at, run(F.col(at), F.col("_known"))).drop("_known")

    if o.correct_spacing:
        df = stage(df.withColumn(at, rules.extra_space(F.col(at))), spaced_lines)
        df = df.withColumn(at, rules.punctuation_space(rules.affix_space(F.col(at))))
    df = df.withColumn(at, after_spacing(F.col(at), o))
    if o.decrease_repeated_chars or o.separate_mi:
        df = stage(df, lambda s, f, k, v: _late(s, o, k, v))
    return df


def normalize(df: DataFrame, lexicon: DataFrame | None = None, verb_forms: DataFrame | None = None, text: str = "text", into: str = "normalized", options: NormalizerOptions | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with the normalized text as a new column: null for null, "" for "".

    Without a lexicon the steps that need one are off by default and all is one projection. verb_forms are the plain forms
    (not joined by _). Tables of up to limit rows travel to the tasks; larger ones are joined with what the texts ask for.
    Raises ValueError where df has a column of the new one's name, or a step lacks its table."""
    if into.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column {into} exists already")
    o = options or (NormalizerOptions() if lexicon is not None and verb_forms is not None else NormalizerOptions.without_lexicon())
    if lexicon is None:
        if o.correct_spacing or o.separate_mi:
            raise ValueError("spacing and the verbal prefix need a lexicon and verb forms")
        return df.withColumn(into, normalize_column(F.col(f"`{text}`"), o))
    if o.separate_mi and verb_forms is None:
        raise ValueError("the verbal prefix needs verb forms")
    return _lexicon_steps(df.withColumn(into, before_spacing(F.col(f"`{text}`"), o)), into, o, lexicon, verb_forms, limit)


def token_spacing(tokens: list[str], lexicon: dict[str, int], verbs: Iterator[str] = ()) -> list[str]:
    """Spacing of one list of tokens with a small lexicon, for use outside a query."""
    return space_tokens(list(tokens), frozenset(w for w, n in lexicon.items() if n > 0), frozenset(lexicon), frozenset(verbs))


__all__ = ["NormalizerOptions", "normalize", "normalize_column", "token_spacing", "words"]
