"""Operators of problems 6 to 8 against the library, brute force and exact round trips."""

import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parsloom.llm import bpe, leakage, queries, spans

P = pytest.importorskip("public_tokenizers")
T = bpe.transducer(bpe.vocabulary_path(), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def ids(text):
    return np.frombuffer(T.encode(text), dtype=np.int32).tolist()


# 6: token ids

TEXTS = ["", "Hello world's  end \n\n x", "در آغاز سال می‌روم", "<|endoftext|> a", "a" * 5000, "سلام" * 900, " \t\r\n ", "é́ 世界 🙂🙃", "0123456789" * 60, "'ll 's'S"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_librarys(library, text):
    assert ids(text) == library(text)
    assert T.decode(ids(text)) == text == "".join(T.decode_stream(ids(text)))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120), st.integers(1, 17))
def test_streams(text, size):
    text = text.encode("utf-8", "replace").decode()
    want = ids(text)
    assert list(T.encode_stream(text[i : i + size] for i in range(0, len(text), size))) == want
    assert T.decode(want) == text == "".join(T.decode_stream(want))


@pytest.mark.parametrize("text", ["x're y", "we'll go", "it's  12 3", "a\n\n b   c", "  'll've''s", "1 2  34\t\tx ", "'r e'", "I'm' d'd 'D", "a'", "é'ré", "don't  \n"])
def test_all_cuts_of_a_stream(library, text):
    for n in (1, 2, 3):
        for cuts in itertools.combinations(range(1, len(text)), n):
            parts = [text[i:j] for i, j in zip((0, *cuts), (*cuts, len(text)))]
            assert list(T.encode_stream(parts)) == library(text), parts


@pytest.mark.parametrize("text", [" " * 5000 + "x", " " * 3000, "a" * 3000 + " b", "سلام" * 900 + "! x", "!" * 700 + "'re ", "1" * 999 + "a", "\n" * 600 + " y", "x" + " " * 300 + "\t" * 300 + "'s"])
def test_long_runs_are_handed_on_while_they_go_on(library, text):
    for size in (1, 7, 255, 256, 257, 1000):
        state, got = bpe.Encoder(T), b""
        for i in range(0, len(text), size):
            got += state.feed(text[i : i + size])
            assert len(state.held) <= bpe.HELD + size and (state.going is None or len(state.going.text) <= 4 * T.lookahead)
        assert np.frombuffer(got + state.finish(), dtype=np.int32).tolist() == library(text)


def test_all_texts_take_the_transducer(monkeypatch):
    """No plain merges of a whole pre-token: they only tell which two tokens may stand side by side."""
    t, want = bpe.Transducer(bpe.vocabulary_path(), P.PATTERN), T.encode("در آغاز سال it's")
    seen = []
    monkeypatch.setattr(bpe.Word, "feed", lambda self, piece, feed=bpe.Word.feed: (seen.append(piece), feed(self, piece))[1])
    assert t.encode("در آغاز سال it's") == want and b"".join(seen).decode() == "در آغاز سال it's"


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="abeht ", min_size=200, max_size=900).map(lambda s: s.replace(" ", "")), st.integers(1, 300))
def test_long_words_come_out_as_they_go_in(word, size):
    """The transducer with its bounded memory against the plain merges."""
    raw = word.encode()
    state, out = bpe.Word(T), []
    for i in range(0, len(raw), size):
        out += state.feed(raw[i : i + size])
        assert len(state.text) <= 4 * T.lookahead
    out += state.finish()
    assert out == [T.ranks[t] for t in T.merge(raw)]


def test_decoding_of_broken_bytes():
    half = [T.ranks[bytes([b])] for b in "س".encode()[:1]]
    assert T.decode(half) == "�" and T.decode(half + ids("a")) == "�a"
    assert T.decode([T.ranks[bytes([b])] for b in "🙂".encode()]) == "🙂"


def test_encode_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (0, TEXTS[0]), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", spark.range(1).selectExpr("1").first()[0] * __import__("pyspark.sql.functions", fromlist=["lit"]).lit(7))
    out = bpe.encode_column(df)
    assert out.columns == ["doc_id", "ids"] and out.count() == len(rows)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert all(got[i] == library(t) for i, t in enumerate(TEXTS)) and got[100] == [] and got[None] == library("a")
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode_column(out).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS)) and back[100] == ""
    assert bpe.encode_column(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.decode_column(out, into="DOC_ID")


# 7: leaks


def test_words():
    assert leakage.words_of("كتاب‌ها ۱۲ Éa، خَط١") == ["کتاب", "ها", "12", "ea", "خط1"] and leakage.words_of(None) == []


def leaked(docs, items):
    out = set()
    for i, t in items:
        w = leakage.words_of(t)
        for d, x in docs:
            v = leakage.words_of(x)
            grams = {tuple(v[k : k + 13]) for k in range(len(v) - 12)}
            if any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    opening = " ".join(f"w{i}" for i in range(12))
    items = [(i, opening + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(25)]
    docs = []
    for d in range(300):
        w = [rng.choice(vocabulary + ["oov"]) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:  # a third hold a piece of the same items
            src = leakage.words_of(items[d % 5][1])
            k, n = rng.randint(0, 8), rng.randint(10, 20)
            w[rng.randint(0, len(w)) : 0] = [x.upper() for x in src[k : k + n]]
        docs.append((d, ", ".join(w)))
    docs += [(900, None), (901, ""), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame([*items, (77, None), (78, ""), (79, "short text"), items[0]], "item_id bigint, text string")
    want = leaked([d for d in docs if d[1]], items)
    assert {tuple(r) for r in leakage.leaks(df, it).collect()} == want and want
    monkeypatch.setattr(leakage, "BITS", 64)  # bits that many words share
    assert {tuple(r) for r in leakage.leaks(df, it).collect()} == want
    report = {r["doc_id"]: r["items"] for r in leakage.leak_report(df, it).collect()}
    assert report == {d: len({i for x, i in want if x == d}) for d, _ in want}


def test_leaks_of_nothing(spark):
    df, it = spark.createDataFrame([(1, "a " * 40)], "doc_id bigint, text string"), spark.createDataFrame([(1, "b " * 40)], "item_id bigint, text string")
    assert leakage.leaks(df.limit(0), it).count() == 0 == leakage.leaks(df, it.limit(0)).count() == leakage.leaks(df, it).count()


# 8: shared spans


def text(rng, n):
    return "".join(rng.choice("ابپ تث.جچ\n") for _ in range(n))


def sharing(docs):
    first = {}
    for d, t in docs:
        for k in range(len(t) - spans.LEAST + 1):
            first.setdefault(t[k : k + spans.LEAST], set()).add(d)
    return {(a, b) for s in first.values() for a in s for b in s if a < b}


def planted(n=60, seed=1):
    rng = random.Random(seed)
    docs = [(d, text(rng, rng.randint(200, 900))) for d in range(n)]
    for d in range(0, n - 1, 3):
        size = rng.choice([295, 299, 300, 301, 340])
        piece = docs[d][1][:size]
        t = docs[d + 1][1]
        at = rng.randint(0, len(t))
        docs[d + 1] = (d + 1, t[:at] + piece + t[at:])
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, "phrase " * 120), (103, "phrase " * 90), (104, "x" * 299)]
    return docs


def test_rolling_hashes():
    codes = np.frombuffer("abcabcabc".encode("utf-32-le"), dtype=np.uint32)
    for size in (1, 2, 3, 5, 6, 7):
        h = spans.rolling(codes, size)
        assert len(h) == 9 - size + 1 and all((h[i] == h[j]) == ("abcabcabc"[i : i + size] == "abcabcabc"[j : j + size]) for i in range(len(h)) for j in range(len(h)))
    assert len(spans.rolling(codes, 10)) == 0


def test_pairs_against_brute_force(spark):
    docs = planted()
    df = spark.createDataFrame([*docs, (500, None), (501, "")], "doc_id bigint, text string")
    want = sharing(docs)
    assert {tuple(r) for r in spans.shared_pairs(df.repartition(5)).collect()} == want and len(want) > 10


def test_hot_seeds_and_blocks_give_the_same(spark, monkeypatch):
    """A phrase shorter than a span in most records, and small limits: the way by spans and by blocks."""
    rng = random.Random(9)
    phrase = text(rng, 260)
    docs = [(d, text(rng, 150) + phrase + text(rng, 150)) for d in range(40)]
    docs += [(50 + d, "z" * d + docs[d][1][100:430] + text(rng, 60)) for d in range(5)] + [(90, docs[3][1][:50] + phrase + docs[3][1][410:])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = sharing(docs)
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == want and want
    monkeypatch.setattr(spans, "HOT", 4)
    monkeypatch.setattr(spans, "BLOCK", 2)
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == want


def test_many_copies_are_paired_with_their_representative(spark, monkeypatch):
    monkeypatch.setattr(spans, "COPIES", 3)
    rng = random.Random(2)
    one = text(rng, 500)
    docs = [(d, one) for d in range(8)] + [(20, one[100:450] + text(rng, 100)), (21, text(rng, 400))]
    got = {tuple(r) for r in spans.shared_pairs(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {(0, d) for d in range(1, 8)} | {(0, 20)}


def test_large_span_classes_are_stars(spark, monkeypatch):
    """A passage in many records of different text: pairs with its representative, and the members from which all links can be told."""
    rng = random.Random(12)
    passage = text(rng, 400)
    docs = [(d, text(rng, 50) + passage + text(rng, 40)) for d in range(20)] + [(30, text(rng, 500))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = sharing(docs)
    monkeypatch.setattr(spans, "HOT", 4)
    monkeypatch.setattr(spans, "COPIES", 5)
    got = {tuple(r) for r in spans.shared_pairs(df).collect()}
    assert got <= want and {b for a, b in got if a == 0} == set(range(1, 20)) and len(got) < len(want)
    members = {}
    for r in spans.shared_classes(df).collect():
        assert r["kind"] == "span" and r["members"] == 20 and r["rep"] == 0
        members.setdefault(r["class_id"], set()).add(r["doc_id"])
    assert got | {(a, b) for m in members.values() for a in m for b in m if a < b} == want
    found = spans.shared_passages(df).collect()
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in found} == got
    assert all(docs[r["doc_id_b"]][1][r["start_b"] : r["end_b"]] == docs[r["doc_id_a"]][1][r["start_a"] : r["end_a"]] and r["exact_chars"] >= 400 for r in found)


def test_queries_give_all_pairs_of_large_classes(spark, tmp_path):
    """More than COPIES copies, and more than COPIES records that hold the same two passages with other text around and between."""
    rng = random.Random(14)
    one, two, copied = text(rng, 340), text(rng, 350), text(rng, 420)
    docs = [(d, "".join(p + text(rng, rng.randint(20, 90)) for p in ([one, two] if d % 2 else [two, one]))) for d in range(spans.COPIES + 6)]
    docs += [(200 + d, copied) for d in range(spans.COPIES + 6)] + [(150, text(rng, 30) + copied), (160, text(rng, 400)), (170, docs[3][1])]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sharing(docs)
    rows = [tuple(r) for r in queries.p8_found(spark, str(tmp_path)).collect()]
    assert set(rows) == want and len(rows) == len(want)
    texts, exact = dict(docs), {}
    for r in queries.p8_passages(spark, str(tmp_path)).collect():
        pair = r["doc_id_a"], r["doc_id_b"]
        exact[pair] = exact.get(pair, 0) + r["exact_chars"]
        if r["exact_chars"] == r["end_a"] - r["start_a"]:
            assert texts[pair[0]][r["start_a"] : r["end_a"]] == texts[pair[1]][r["start_b"] : r["end_b"]]
    assert set(exact) == want
    assert all(n >= len(one) + len(two) for (a, b), n in exact.items() if b <= spans.COPIES + 5)


def test_passages_are_the_same_however_many_seeds_are_hot(spark, monkeypatch):
    df = spark.createDataFrame(planted(), "doc_id bigint, text string")
    want = {tuple(r) for r in spans.shared_passages(df, whole=True).collect()}
    monkeypatch.setattr(spans, "HOT", 1)
    assert {tuple(r) for r in spans.shared_passages(df, whole=True).collect()} == want and want


def seeds(t):
    places = {}
    for h, at in zip(*spans.seeds_of(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32), np.array([0]), np.array([len(t)]))):
        places.setdefault(int(h), []).append(int(at))
    return places


def stretches(s, t):
    p, q, around = seeds(s), seeds(t), spans._Spans(s, t)
    matches = [m for h in p if h in q for m in around.matches(p[h], q[h])]
    return matches, spans.passages(s, t, matches)[1]


@pytest.mark.parametrize(("times", "seconds"), [(80, 0.5), (800, 10)])
def test_records_that_repeat_one_phrase(times, seconds):
    phrase = text(random.Random(1), 350)
    s, t = "q" + phrase * times, "zz" + phrase * times + "x"
    began = time.process_time()
    matches, exact = stretches(s, t)
    assert time.process_time() - began < seconds and len(matches) < 40 * times
    assert max(n for _, _, n in exact) == 350 * times


@pytest.mark.parametrize("seed", range(4))
def test_places_of_one_seed_in_all_surroundings(seed):
    """A phrase shorter than a span at many places: just what brute force finds is covered, in both records."""
    rng = random.Random(seed)
    phrase, around = text(rng, 230), [text(rng, 80) for _ in range(6)]
    s, t = ("".join(rng.choice(around) + phrase + rng.choice(around) + text(rng, 9) for _ in range(n)) for n in (14, 11))
    exact = stretches(s, t)[1]
    for side, (mine, other) in enumerate(((s, t), (t, s))):
        held = {other[i : i + 300] for i in range(len(other) - 299)}
        want = {k for i in range(len(mine) - 299) if mine[i : i + 300] in held for k in range(i, i + 300)}
        assert {k for z in exact for k in range(z[side], z[side] + z[2])} == want and want


def test_amounts(spark, monkeypatch):
    rng = random.Random(4)
    piece = text(rng, 350)
    docs = [(1, "«" + piece + "»" + text(rng, 100)), (2, "[" + piece + "]" + text(rng, 50)), (3, text(rng, 400)), (4, "q" + text(rng, 400)), (5, None), (6, "short")]
    docs += [(7, docs[3][1]), (8, "{" + piece[:320] + "}" + text(rng, 10))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = {1: 350, 2: 350, 3: 0, 4: 401, 7: 401, 8: 320}
    assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_amounts(df).collect()} == want
    monkeypatch.setattr(spans, "HOT", 1)
    assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_amounts(df).collect()} == want


def test_chains_hold_every_match():
    m = [(0, 0), (10, 12), (20, 22), (5, 400), (200, 5)]
    found = spans.chains(m)
    assert found[0] == [(0, 0), (10, 12), (20, 22)] and {x for c in found for x in c} == set(m)


def test_a_stretch_beside_a_chain_is_measured():
    """(500, 500) and (500, 700) tie; the chain takes the latter, and the span of 300 lies on a diagonal of the chain."""
    rng = random.Random(8)
    head, x, tail = text(rng, 200), text(rng, 300), text(rng, 200)
    s = head + "1" * 200 + x + "3" * 300 + tail
    t = head + "2" * 200 + x + x[100:292] + "4" * 108 + tail
    assert spans.passages(s, t, [(0, 0), (500, 500), (500, 700), (1000, 1000)])[1] == [(400, 400, 300)]


def test_fuzzy_passages_bridge_gaps():
    rng = random.Random(6)
    a, b = text(rng, 400), text(rng, 400)
    s, t = a + "#" + b, a + "??" + b
    fuzzy, exact = spans.passages(s, t, [(10, 10), (410, 411)])
    assert fuzzy == [(0, 801, 0, 802)] and exact == [(0, 0, 400), (401, 402, 400)]


def test_nothing_shared(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.shared_pairs(df).count() == 0 == spans.shared_amounts(df).count() == spans.shared_passages(df).count() == spans.shared_classes(df).count()
