"""Long exact spans shared between records (problem 8).

Seeds are k-mers picked by winnowing: of any LEAST shared characters both records keep at least one same seed. Seeds
are joined by their hash; the matches of two records are chained in order with gap costs through a Fenwick tree, each
match in one chain. Each chain is aligned: its matches are grown to their equal stretches, measured character by
character, and what lies between the first and the last is a fuzzy passage. The rows come of the chains' stretches of
LEAST and more.

Exact copies are one class with one representative. A seed of very many records, as a phrase shorter than a span in a
third of them, isn't paired off: its records are told apart by all the spans that could hold it, and only equal spans
pair, in classes. Every pair of a class comes out, block against block; the short form instead pairs the members of a
large class with its representative. Two records that are paired are aligned by all seeds they share, those of very many
records too. No task has a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parsloom.llm.common import written

LEAST = 300
#: The length of a seed; a window of LEAST - SEED + 1 seeds keeps its smallest.
SEED = 192
#: Records in a block of a pairing; a seed in more records than HOT is paired by its spans.
BLOCK, HOT = 64, 64
#: Classes of more records than this, copies or holders of one span, are given as pairs of each member and the representative where
#: the short form is asked for; otherwise all their pairs are given by the classes themselves, without aligning each.
COPIES = 64
#: Places of a seed in two records, multiplied, from which on they are paired by the spans around them.
PLACES = 64
GAP_COST = 0.05
#: Broadcast the ids of candidate records up to this number (16 MB), join them beyond it.
BROADCAST_IDS = 1_000_000

_B = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolling(codes: np.ndarray, size: int, base: int = _B) -> np.ndarray:
    """A polynomial hash of every run of size codes, by doubling."""
    h, n, power = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), 1, base
    done, total, total_n = None, None, 0
    left = size
    while left:
        if left & n:
            if total is None:
                total, total_n = h, n
            else:  # the shorter part stands behind the longer one
                m = len(codes) - (total_n + n) + 1
                if m <= 0:
                    return np.zeros(0, dtype=np.uint64)
                total = h[:m] * np.uint64(pow(base, total_n, 1 << 64)) + total[n : n + m]
                total_n += n
            left &= ~n
        if left:
            m = len(h) - n
            if m <= 0:
                return np.zeros(0, dtype=np.uint64)
            h = h[:m] * np.uint64(power) + h[n : n + m]
            power = power * power & _M
            n *= 2
    return _mixed(total)


def _sliding(h: np.ndarray, size: int, pick) -> np.ndarray:
    """The least or greatest of every size consecutive values."""
    out, n = h, 1
    while 2 * n <= size:
        out = pick(out[:-n], out[n:])
        n *= 2
    return pick(out[: len(out) - (size - n)], out[size - n :]) if size > n else out


def seeds_of(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the winnowed seeds of texts that lie one behind the other in codes."""
    window = LEAST - SEED + 1
    h = rolling(codes, SEED)
    if len(h) < window:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    whole = np.zeros(len(h), dtype=bool)  # seeds that lie within one text
    for a, n in zip(starts.tolist(), lengths.tolist()):
        if n >= LEAST:
            whole[a : a + n - SEED + 1] = True
    top = np.uint64(_M)
    h = np.where(whole, np.minimum(h, top - np.uint64(1)), top)
    least = _sliding(h, window, np.minimum)
    padded = np.concatenate((np.zeros(window - 1, dtype=np.uint64), np.where(least == top, np.uint64(0), least), np.zeros(window - 1, dtype=np.uint64)))
    kept = (_sliding(padded, window, np.maximum) == h) & whole
    at = np.flatnonzero(kept)
    return h[at], at


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def of(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        h, at = seeds_of(np.concatenate(parts), starts, lengths)
        which = np.searchsorted(starts, at, side="right") - 1
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.array(ids, dtype=np.int64)[which]), pa.array((at - starts[which]).astype(np.int32))], ["seed", "doc_id", "pos"])

    for b in batches:
        ids, texts, size = [], [], 0
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t is not None and len(t) >= LEAST:
                ids.append(d), texts.append(t)
                size += len(t)
                if size > 500_000:
                    yield of(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield of(ids, texts)


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, rep, n) of the records of at least LEAST characters whose text another has too; rep is the least doc_id of the class."""
    hashed = docs.where(F.length("text") >= LEAST).select("doc_id", F.unhex(F.md5("text")).alias("h"))
    classes = hashed.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(classes, "h").select("doc_id", "rep", "n")


def _paired(rows: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """Pairs a.doc_id < b.doc_id of the rows with the same key, block against block; rows have n, the number of rows of their key."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    own = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = own.select(*key, F.col("doc_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in keep], F.col("_own").alias("_i"), each.alias("_j"))
    right = own.select(*key, F.col("doc_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in keep], F.col("_own").alias("_j"), each.alias("_i"))
    return left.join(right, [*key, "_i", "_j"]).where("a < b").drop("_i", "_j")


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, second, doc_id, start): two hashes of every span of LEAST characters around a place of a hot seed."""

    def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        one, two, ids, starts = (np.concatenate(x) for x in zip(*parts))
        return pa.record_batch([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(ids), pa.array(starts)], ["first", "second", "doc_id", "start"])

    for b in batches:
        parts, size = [], 0
        for d, places, t in zip(*(b.column(i).to_pylist() for i in range(3))):
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            begun = np.unique(np.concatenate([np.arange(max(0, p - (LEAST - SEED)), min(len(codes) - LEAST, p) + 1) for p in places]))
            if len(begun):
                one, two = rolling(codes, LEAST)[begun], rolling(codes, LEAST, 0xC2B2AE3D27D4EB4F)[begun]
                parts.append((one, two, np.full(len(begun), d, dtype=np.int64), begun.astype(np.int32)))
                size += len(begun)
                if size > 200_000:
                    yield out(parts)
                    parts, size = [], 0
        if parts:
            yield out(parts)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The docs of these ids (a written table): broadcast up to a checked number of ids, joined beyond it."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _placed(docs: DataFrame, twins: DataFrame) -> DataFrame:
    """(seed, doc_id, places, n): for each seed that n > 1 records of different text share, where it stands. twins are the copies that aren't representatives."""
    seeds = written(docs.mapInArrow(_seed_rows, "seed bigint, doc_id bigint, pos int"))
    seeds = seeds.join(twins.select("doc_id"), "doc_id", "left_anti")
    shared = seeds.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("seed")
    placed = seeds.join(shared, "seed").groupBy("seed", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    counts = placed.groupBy("seed").agg(F.count("*").alias("n"))
    return written(placed.join(counts, "seed"))


def _hot_spans(docs: DataFrame, placed: DataFrame) -> DataFrame | None:
    """(first, second, doc_id, starts, n): the spans around hot seeds that n > 1 records hold, or None where no seed is hot."""
    hot = placed.where(F.col("n") > HOT)
    if hot.isEmpty():
        return None
    places = hot.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    few = _only(docs, written(places.select("doc_id")))
    rows = places.join(few, "doc_id").select("doc_id", "places", "text").mapInArrow(_span_rows, "first bigint, second bigint, doc_id bigint, start int")
    rows = written(rows.groupBy("first", "second", "doc_id").agg(F.collect_list("start").alias("starts")))
    sizes = rows.groupBy("first", "second").agg(F.count("*").alias("n")).where("n > 1")
    return written(rows.join(sizes, ["first", "second"]))


def _span_classes(spans: DataFrame) -> DataFrame:
    """(first, second, rep): of the spans of the same set of records, which say the same, one; rep is the set's least doc_id. The set
    is known by its size and two sums of hashes."""
    sums = [F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("x"), F.sum(F.hash("doc_id").cast("bigint")).alias("y")]
    marked = spans.groupBy("first", "second").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), *sums)
    return marked.groupBy("n", "x", "y").agg(F.min(F.struct("first", "second", "rep")).alias("s")).select("s.*")


def _members(spans: DataFrame) -> DataFrame:
    """(first, second, doc_id, start, n, rep): the records of one span of each set of records."""
    return written(spans.join(_span_classes(spans), ["first", "second"]).select("first", "second", "doc_id", F.element_at("starts", 1).alias("start"), "n", "rep"))


def _hot_pairs(members: DataFrame, large: str) -> DataFrame:
    """(a, b) of records with a same span: all pairs of a class of up to COPIES records; of a larger one all, those with the
    representative (star), or none."""
    pairs = _paired(members if large == "all" else members.where(F.col("n") <= COPIES), ["first", "second"], []).select("a", "b")
    if large == "star":
        pairs = pairs.unionByName(members.where((F.col("n") > COPIES) & (F.col("doc_id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    return pairs.distinct()


def _large_pairs(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) of all pairs of the span classes of more than COPIES records; the span itself tells who is in a class."""
    large = members.where(F.col("n") > COPIES)
    texts = _only(docs, written(large.select("doc_id").distinct()))
    told = large.join(texts, "doc_id").select("first", "second", F.expr(f"md5(substring(text, start + 1, {LEAST}))").alias("span"), "doc_id", "n")
    return _paired(told, ["first", "second", "span"], []).select("a", "b").distinct()


def chains(matches: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Matches in chains of ascending places in both records, the best first, each match in one.

    A chain scores SEED for each match less GAP_COST for each character between neighbours; the best predecessor comes
    from a Fenwick tree over the places in the second record. Chains are read off from their ends, the best end first, and
    stop where an earlier chain has been."""
    rest = sorted(set(matches))
    ranks = {y: r for r, y in enumerate(sorted({y for _, y in rest}), 1)}
    top, at = [-1e18] * (len(ranks) + 1), [-1] * (len(ranks) + 1)
    score, back = [0.0] * len(rest), [-1] * len(rest)
    i = 0
    while i < len(rest):
        j = i
        while j < len(rest) and rest[j][0] == rest[i][0]:  # the same place: neither precedes the other
            x, y = rest[j]
            r, best, k = ranks[y] - 1, -1e18, -1
            while r > 0:
                if top[r] > best:
                    best, k = top[r], at[r]
                r -= r & -r
            gain = best - GAP_COST * (x + y)
            score[j] = SEED + max(gain, 0.0)
            if k >= 0 and gain > 0:
                back[j] = k
            j += 1
        for k in range(i, j):
            x, y = rest[k]
            r, value = ranks[y], score[k] + GAP_COST * (x + y)
            while r < len(top) and top[r] < value:
                top[r], at[r] = value, k
                r += r & -r
        i = j
    out, used = [], [False] * len(rest)
    for k in sorted(range(len(rest)), key=lambda q: (-score[q], q)):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(rest[k])
            k = back[k]
        if chain:
            out.append(chain[::-1])
    return out


def _grow(s: str, t: str, x: int, y: int) -> tuple[int, int]:
    """(start in s, end in s) of the longest equal stretch of s and t through s[x] and t[y] on one diagonal."""

    def same(a: int, b: int, step: int) -> int:
        n, size = 0, 64
        while size:
            u, v = (s[a + n : a + n + size], t[b + n : b + n + size]) if step > 0 else (s[max(0, a - n - size) : a - n], t[max(0, b - n - size) : b - n])
            if len(u) == size == len(v) and u == v:
                n += size
                size = min(size * 2, 4096)
            else:
                size //= 2
        return n

    return x - same(x, y, -1), x + same(x, y, 1)


def passages(s: str, t: str, matches: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """(fuzzy passages as start and end in both, exact spans of at least LEAST as start in s, start in t, length) of the matches' chains."""
    grown: dict[int, list[tuple[int, int]]] = {}  # the equal stretches of each diagonal, in the order they were met
    fuzzy, exact = [], []
    true = [(x, y) for x, y in set(matches) if s.startswith(t[y : y + SEED], x)]  # the others are clashes of hashes
    for chain in chains(true):
        held, known = [], True
        for x, y in chain:
            d = y - x
            a, e = next((z for z in grown.get(d, ()) if z[0] <= x < z[1]), (0, 0))
            if not e:
                a, e = _grow(s, t, x, y)
                grown.setdefault(d, []).append((a, e))
                known = False
                if e - a >= LEAST:
                    exact.append((a, a + d, e - a))
            if not held or held[-1] != (a, e, d):
                held.append((a, e, d))
        if not known:  # a chain whose stretches others hold already says nothing new
            fuzzy.append((min(a for a, _, _ in held), max(e for _, e, _ in held), min(a + d for a, _, d in held), max(e + d for _, e, d in held)))
    return fuzzy, sorted(exact)


class _Spans:
    """The hashes of all spans of LEAST characters of two texts, taken when a seed of many places asks for them."""

    def __init__(self, s: str, t: str) -> None:
        self.texts, self.hashes = (s, t), None

    def matches(self, p: list[int], q: list[int]) -> list[tuple[int, int]]:
        """Of the places of a seed in both texts those pairs that a shared span can need, in number linear in the places.

        A span of LEAST characters around a place begins up to LEAST - SEED characters before it. Of the places whose spans are
        equal one stands for the others: each place is paired with the first one of the other text that has the same span, so each
        shared span is met in both texts. The n-th places are paired too, for passages without such a span."""
        if len(p) * len(q) <= PLACES:
            return [(x, y) for x in p for y in q]
        if self.hashes is None:
            self.hashes = [rolling(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), LEAST) for x in self.texts]
        out = set(zip(p, q))
        (h, k), (p_, q_) = self.hashes, (np.array(p), np.array(q))
        for before in range(LEAST - SEED + 1):
            left, right = p_[(p_ >= before) & (p_ - before < len(h))], q_[(q_ >= before) & (q_ - before < len(k))]
            one, two = h[left - before], k[right - before]
            firsts, first_at = np.unique(two, return_index=True)
            for mine, theirs, values, turned in ((left, right[first_at], one, False), (right, None, two, True)):
                if turned:
                    firsts, at = np.unique(one, return_index=True)
                    theirs = left[at]
                if len(firsts):
                    place = np.minimum(np.searchsorted(firsts, values), len(firsts) - 1)
                    same = firsts[place] == values
                    pairs = zip(mine[same].tolist(), theirs[place[same]].tolist())
                    out.update(((y, x) for x, y in pairs) if turned else pairs)
        return list(out)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("start_a", pa.int32()), ("start_b", pa.int32()), ("length", pa.int32())]))
    rough = pa.list_(pa.struct([("start_a", pa.int32()), ("end_a", pa.int32()), ("start_b", pa.int32()), ("end_b", pa.int32())]))
    for batch in batches:
        a, b, exact, fuzzy = [], [], [], []
        hot = (((h.as_py() or ()) for h in batch.column(i)) for i in (5, 6))
        for x, y, places, s, t, p, q in zip(*(batch.column(i).to_pylist() for i in range(5)), *hot):
            around = _Spans(s, t)
            matches = [m for one in places for m in around.matches(one["places_a"], one["places_b"])]
            if p and q:
                ours = {one["seed"]: one["places"] for one in p}
                matches += [m for one in q if one["seed"] in ours for m in around.matches(ours[one["seed"]], one["places"])]
            f, e = passages(s, t, matches)
            if e:
                a.append(x), b.append(y)
                exact.append([dict(zip(("start_a", "start_b", "length"), z)) for z in e])
                fuzzy.append([dict(zip(("start_a", "end_a", "start_b", "end_b"), z)) for z in f])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(exact, kinds), pa.array(fuzzy, rough)], ["a", "b", "spans", "passages"])


def _class_pairs(docs: DataFrame, placed: DataFrame, members: DataFrame | None, large: str) -> DataFrame:
    """(a, b, spans, passages): pairs of representatives of different text with a shared span, a < b, by their seeds, and by the spans
    around hot seeds; those of large span classes as in _hot_pairs. All seeds of a pair are aligned, hot ones too."""
    found = _paired(placed.where(F.col("n") <= HOT), ["seed"], ["places"]).select("a", "b", F.struct("places_a", "places_b").alias("places"))
    if members is not None:
        found = found.unionByName(_hot_pairs(members, large).select("a", "b", F.lit(None).cast(found.schema["places"].dataType).alias("places")))
    matches = written(found.groupBy("a", "b").agg(F.collect_list("places").alias("places")))
    ids = written(matches.select(F.col("a").alias("doc_id")).union(matches.select("b")).distinct())
    texts = _only(docs, ids)
    if members is None:
        texts = texts.withColumn("seeds", F.lit(None).cast("array<struct<seed:bigint,places:array<int>>>"))
    else:
        hot = placed.where(F.col("n") > HOT).groupBy("doc_id").agg(F.collect_list(F.struct("seed", "places")).alias("seeds"))
        texts = texts.join(hot, "doc_id", "left")
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"), F.col("seeds").alias(f"seeds_{c}"))
    both = matches.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "places", "text_a", "text_b", "seeds_a", "seeds_b").mapInArrow(
        _aligned, "a bigint, b bigint, spans array<struct<start_a:int,start_b:int,length:int>>, passages array<struct<start_a:int,end_a:int,start_b:int,end_b:int>>"
    )


def _searched(docs: DataFrame, large: str = "star") -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None, DataFrame]:
    """Documents, their copies, the spans around hot seeds and their classes, and the pairs of representatives with their spans and
    passages."""
    docs, same = _prepared(docs)
    placed = _placed(docs, same.where("doc_id != rep"))
    hot = _hot_spans(docs, placed)
    members = None if hot is None else _members(hot)
    return docs, same, hot, members, _class_pairs(docs, placed, members, large)


def shared_passages(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id_a, doc_id_b, start_a, end_a, start_b, end_b, exact_chars): the fuzzy passages of records that share a span of at least
    LEAST characters: what lies between the first and the last match of a chain, and how many of its characters in a are in exact
    spans of LEAST and more. Two copies share the whole text.

    whole gives the passages of all pairs, of which there may be as many as records by records. The short form leaves copies to their
    representative, and pairs the members of a span's class of more than COPIES records with its representative; shared_classes has the
    members of both."""
    docs, same, _, _, pairs = _searched(docs, "all" if whole else "star")
    within = lambda p: F.aggregate(
        F.filter("spans", lambda s: (s["start_a"] >= p["start_a"]) & (s["start_a"] + s["length"] <= p["end_a"]) & (s["start_b"] >= p["start_b"]) & (s["start_b"] + s["length"] <= p["end_b"])),
        F.lit(0), lambda n, s: n + s["length"],
    )
    sized = F.transform("passages", lambda p: F.struct(*[p[c].alias(c) for c in ("start_a", "end_a", "start_b", "end_b")], within(p).alias("exact_chars")))
    pairs = pairs.select("a", "b", sized.alias("passages"))
    if whole:
        sizes = same.join(docs.select("doc_id", F.length("text").alias("size")), "doc_id")
        all_of = F.struct(F.lit(0).alias("start_a"), F.col("size_a").alias("end_a"), F.lit(0).alias("start_b"), F.col("size_b").alias("end_b"), F.col("size_a").alias("exact_chars"))
        among = _paired(sizes, ["rep"], ["size"]).select("a", "b", F.array(all_of).alias("passages"))
        pairs = _with_copies(_with_copies(pairs, "a", same), "b", same).unionByName(among)
    rows = pairs.select("a", "b", F.explode("passages").alias("p"))
    swap = {"start_a": "start_b", "end_a": "end_b", "start_b": "start_a", "end_b": "end_a"}
    turned = [F.when(F.col("a") < F.col("b"), F.col(f"p.{c}")).otherwise(F.col(f"p.{other}")).alias(c) for c, other in swap.items()]
    return rows.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"), *turned, "p.exact_chars")


def shared_classes(docs: DataFrame) -> DataFrame:
    """(kind, class_id, doc_id, rep, members): the members of every class that the short form of shared_pairs may give as pairs with its
    representative: of equal texts (kind text, class_id the representative) and, of more than COPIES records, of one span
    (kind span, class_id the span's hash). Any two members of a class share a span, so with these rows every link can be told."""
    docs, same = _prepared(docs)
    hot = _hot_spans(docs, _placed(docs, same.where("doc_id != rep")))
    out = same.select(F.lit("text").alias("kind"), F.col("rep").alias("class_id"), "doc_id", "rep", F.col("n").alias("members"))
    if hot is None:
        return out
    large = hot.where(F.col("n") > COPIES)
    return out.unionByName(large.join(_span_classes(large), ["first", "second"]).select(F.lit("span").alias("kind"), F.col("first").alias("class_id"), "doc_id", "rep", F.col("n").alias("members")))


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null and text is not null")
    return docs, written(copies(docs))


def _with_copies(pairs: DataFrame, side: str, same: DataFrame) -> DataFrame:
    """The pairs with each copy in turn for the representative in column side, a block of copies at a time."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    reps = same.where("doc_id = rep").select(F.col("rep").alias(side), blocks.alias("_blocks"))
    members = same.select(F.col("rep").alias(side), F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("_i"), F.col("doc_id").alias("_copy"))
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))
    wide = pairs.join(reps, side, "left").withColumn("_i", each).join(members, [side, "_i"], "left")
    wide = wide.where(F.col("_blocks").isNull() | F.col("_copy").isNotNull())
    return wide.select(*[F.coalesce("_copy", side).alias(c) if c == side else c for c in pairs.columns])


def _spread_out(pairs: DataFrame, same: DataFrame, whole: bool) -> DataFrame:
    """Pairs of representatives as pairs of their copies, and the pairs among copies.

    In the short form each copy of a class of more than COPIES is paired with the representative only: that is its membership."""
    small = same if whole else same.where(F.col("n") <= COPIES)
    every = _with_copies(_with_copies(pairs.select("a", "b"), "a", small), "b", small)
    every = every.unionByName(_paired(small, ["rep"], []).select("a", "b"))
    if not whole:
        every = every.unionByName(same.where((F.col("n") > COPIES) & (F.col("doc_id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    return every.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def shared_pairs(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b, of records that share a span of at least LEAST characters: with whole of all.

    docs needs doc_id (unique) and text; null ids and texts and shorter texts share nothing. In the short form copies, and the records
    that hold one span, come as all pairs in classes of up to COPIES, beyond that each member is paired with the representative, which
    has the class's other pairs; shared_classes has the members."""
    docs, same, _, members, pairs = _searched(docs, "none" if whole else "star")
    pairs = pairs.select("a", "b")
    if whole and members is not None and not members.where(F.col("n") > COPIES).isEmpty():
        pairs = pairs.unionByName(_large_pairs(docs, members))
    return _spread_out(pairs, same, whole)


def shared_amounts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): how much of each record of at least LEAST characters also stands in another one, in
    characters of exact shared spans. A copy of another record is shared wholly. Hot seeds cost no pairs here."""
    docs, same, hot, _, pairs = _searched(docs)
    pairs = written(pairs.select("a", "b", "spans"))
    each = pairs.select("a", "b", F.explode("spans").alias("s"))
    parts = [each.select(F.col(r).alias("rep"), F.col(f"s.start_{r}").alias("lo"), (F.col(f"s.start_{r}") + F.col("s.length")).alias("hi")) for r in ("a", "b")]
    if hot is not None:
        parts.append(hot.select(F.col("doc_id").alias("rep"), F.explode("starts").alias("lo")).withColumn("hi", F.col("lo") + LEAST))
    both = reduce(DataFrame.unionByName, parts)
    # equal starts fold first; what is left of a record is bounded by its length
    w = Window.partitionBy("rep").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    folded = both.groupBy("rep", "lo").agg(F.max("hi").alias("hi")).withColumn("before", F.coalesce(F.max("hi").over(w), F.lit(0)))
    amount = folded.groupBy("rep").agg(F.sum(F.greatest(F.col("hi") - F.greatest("lo", "before"), F.lit(0))).cast("bigint").alias("shared"))
    sized = docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars")).where(F.col("n_chars") >= LEAST)
    out = sized.join(same.select("doc_id", F.lit(True).alias("_copy")), "doc_id", "left").join(amount.withColumnRenamed("rep", "doc_id"), "doc_id", "left")
    chars = F.when(F.col("_copy"), F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0)))
    return out.select("doc_id", "n_chars", chars.alias("shared_chars"), (chars / F.col("n_chars")).alias("share"))
