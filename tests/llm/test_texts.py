"""Decontamination, pieces and shards."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.common_texts import ODD

from echofold.llm import decontaminate, pieces, sharding
from echofold.llm.decontaminate import DecontaminateParams, WuManber, words


def hits(text, items, window=10):
    """Hit word numbers and items, by comparing at every place."""
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        m = min(window, len(p))
        for a in range(len(p) - m + 1) if m else ():
            for i in range(len(w) - m + 1):
                if w[i : i + m] == p[a : a + m]:
                    hit |= set(range(i, i + m))
                    found.add(item)
    return hit, found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab cd e f".split()), max_size=40), st.lists(st.lists(st.sampled_from("ab cd e f".split()), max_size=9), max_size=6))
def test_search(text, items):
    named = [(str(i), " ".join(w)) for i, w in enumerate(items)]
    spans, found = WuManber(named, 4).spans(words(" ".join(text)))
    assert ({k for a, b in spans for k in range(a, b)}, found) == hits(" ".join(text), named, 4)
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def made(seed=1):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(["the", "of", f"w{r.randrange(30)}"]) for _ in range(n))) for i, n in enumerate([25, 12, 10, 4, 1, 0, 25])] + [(8, None), (9, "THE w1, Of?"), (9, "THE w1, Of?")]
    texts = list(ODD)
    for _ in range(30):
        t = [r.choice(["the", "of", f"w{r.randrange(30)}"]) for _ in range(60)]
        i = r.choice([0, 1, 2, 3])
        own = words(items[i][1])
        at = r.randrange(0, max(1, len(own) - 9))
        t[20:20] = [x.decode().upper() for x in own[at : at + 11]]
        texts.append(", ".join(t))
    return items, texts


@pytest.mark.parametrize("most", [2_000_000, 20])
def test_documents(spark, docs, most):
    """In one pass, and in several over bounded sets of items."""
    items, texts = made()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(texts + texts[:2])
    params = DecontaminateParams(max_words=most)
    out = {r.doc_id: r for r in decontaminate.find_contamination(df, bench, params).collect()}
    assert len(out) == len(texts) + 2
    named = [(str(i), t) for i, t in items]
    clean = 0
    for i, t in enumerate(texts):
        hit, found = hits(t, named)
        r = out[i]
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == (len(words(t)), len(hit), sorted(found), bool(hit))
        clean += not hit
    kept = decontaminate.drop_contaminated(df, bench, params)
    assert kept.columns == df.columns and kept.count() == clean + sum(not hits(t, named)[0] for t in texts[:2])


def test_nothing_to_find(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.find_contamination(docs(ODD), none).collect())
    assert decontaminate.find_contamination(docs(["a"]).limit(0), none).count() == 0


VOCABULARY = pieces.Vocabulary.load(pieces.PieceParams().path)
ENCODER = pieces.Encoder(VOCABULARY)


def likeliest(text):
    """The best log-probability over the whole text at once."""
    s = pieces.SPACE + text.replace(" ", pieces.SPACE)
    best = [0.0] + [float("-inf")] * len(s)
    for i, c in enumerate(s):
        best[i + 1] = max(best[i + 1], best[i] + sum(VOCABULARY.scores[VOCABULARY.bytes_at[b]] for b in c.encode()))
        for k in range(1, ENCODER.longest + 1):
            found = ENCODER.piece.get(s[i : i + k])
            if found and i + k <= len(s):
                best[i + k] = max(best[i + k], best[i] + found[0])
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abehint  \n\t▁\0éñ日𝒳"), max_size=80))
def test_round_trip(text):
    ids = ENCODER.encode(text)
    assert ENCODER.decode(ids) == text
    if text and pieces.SPACE not in text:
        assert sum(VOCABULARY.scores[i] for i in ids) == pytest.approx(likeliest(text))


@pytest.mark.parametrize("text", ["a" * 3000, "theing" * 700, "".join(chr(97 + i * 7 % 26) for i in range(2500)), " " * 900])
def test_long_streams(text):
    parts = list(ENCODER.stream(pieces.SPACE + text.replace(" ", pieces.SPACE)))
    ids = [i for p in parts for i in p]
    assert ENCODER.decode(ids) == text and sum(VOCABULARY.scores[i] for i in ids) == pytest.approx(likeliest(text))


def test_paths_that_never_meet():
    """Two ways to read a text that share no boundary before its end."""
    v = pieces.Vocabulary(("▁", "ab", "ba", "a", "b"), (-1.0, -2.0, -2.0, -9.0, -9.0), tuple([0] * 256), frozenset(range(5)))
    e = pieces.Encoder(v)
    s = "ab" * 600
    assert [i for p in e.stream(s) for i in p] == [1] * 600


def test_encoded_table(spark, docs):
    out = pieces.encode(docs([*ODD, "twice", "twice"], [*range(len(ODD)), 50, 50]))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ODD) + 2 and rows[0].ids is None and rows[0].decoded_sha256 is None and list(rows[1].ids) == []
    back = {r.doc_id: r.text for r in pieces.decode(out).collect()}
    assert {i: back[i] for i in range(len(ODD))} == dict(enumerate(ODD))
    assert pieces.encode(docs(["a"]).limit(0)).count() == 0


def best_capacity(sizes, n):
    c = max(sizes)
    while (e := sharding.greedy(sizes, c)) is None or len(e) > n:
        c += 1
    return c


@pytest.mark.parametrize("seed", range(4))
def test_least_capacity(spark, seed):
    r = random.Random(seed)
    groups = sorted((r.getrandbits(60), r.choice([1, 3, 10, 50, 500]) + r.randint(0, 9)) for _ in range(300))
    if seed == 2:
        groups[40] = (groups[40][0], 20_000)
    df = spark.createDataFrame(groups, "key long, size long")
    params = sharding.ShardParams(n_shards=7, first_bits=3, split_bits=2)
    capacity, starts = sharding.cut_keys(df, params)
    sizes = [s for _, s in groups]
    assert capacity == best_capacity(sizes, 7) and len(starts) <= 7
    shards = {}
    for k, s in groups:
        i = sum(k >= x for x in starts[1:])
        shards[i] = shards.get(i, 0) + s
    assert max(shards.values()) <= capacity


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=50), st.integers(1, 9))
def test_cuts(sizes, n):
    cells = [sharding.Cell(i, 60, s, s, 1) for i, s in enumerate(sizes)]
    c = sharding.smallest_capacity(cells, n)
    assert c == best_capacity(sizes, n)
    ends = sharding._Line(cells).even_ends(c, n)
    assert ends[-1] == len(sizes) and len(ends) <= n and all(sum(sizes[a:b]) <= c for a, b in zip([0, *ends], ends, strict=False))


def test_shards(spark, docs):
    texts = [*ODD, *(f"text {i % 50} " * (i % 7) for i in range(400))]
    ids = [*range(len(texts) - 3), None, 5, 5]
    rows = sharding.shard(docs(texts, ids), sharding.ShardParams(n_shards=5)).collect()
    assert len(rows) == len(texts)
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    by, home = {}, {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert home.setdefault(r.key, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(5))
    assert sharding.shard(docs(["a"]).limit(0)).count() == 0
