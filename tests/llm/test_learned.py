"""Language and toxicity: trained on made-up rows, held against held-out rows and plain versions."""

import random

import numpy as np
import pytest
from llm.common_texts import ODD

from echofold.llm import gru, language, toxicity
from echofold.llm.toxicity import BlockMaxIndex, ToxicityParams, Vectors

QUICK = language.LanguageParams(per_lang=30, steps=60, batch=32, train_window=24)


def two_languages(n=120, seed=1):
    r = random.Random(seed)
    say = {"xx": ["lorem", "ipsum", "dolor", "sit"], "yy": ["бета", "гама", "дота"]}
    langs = [r.choice(["xx", "yy"]) for _ in range(n)]
    return langs, [" ".join(r.choice(say[w]) for _ in range(r.randint(5, 60))) for w in langs]


def test_language(spark):
    langs, texts = two_languages()
    rows = [(i, t, w, "s", 0) for i, (t, w) in enumerate(zip(texts, langs, strict=True))] + [(900 + i, t, None, "s", 0) for i, t in enumerate(ODD)] + [(None, "lorem ipsum", "xx", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, held_out int")
    out = language.identify(df, QUICK).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [i for i in range(120) if got[i].held_out]
    assert held and np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.95
    for i, t in enumerate(ODD):
        assert (got[900 + i].lang_pred == "und") == (t is None or not any(map(str.isalpha, t)))
    kept = language.keep_identified(df, QUICK)
    assert kept.columns == df.columns and kept.count() == len(rows) - sum(t is None or not any(map(str.isalpha, t)) for t in ODD)


def test_language_without_labels(spark, docs):
    from pyspark.sql import functions as F

    df = docs(["abc", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(df, QUICK).collect()} == {"und"}
    assert language.identify(df.limit(0), QUICK).count() == 0


def net(h=3, labels=2, seed=0):
    r = np.random.default_rng(seed)
    g = lambda: gru.Gru(r.normal(size=(3 * h, 256)).astype(np.float32), r.normal(size=(3 * h, h)).astype(np.float32))
    return gru.Labeller(g(), g(), r.normal(size=(labels, 2 * h)).astype(np.float32), r.normal(size=(labels, 1)).astype(np.float32))


def one_by_one(n, data):
    sig = lambda x: 1 / (1 + np.exp(-x))

    def run(g, seq):
        h, out = np.zeros(g.h), []
        for b in seq:
            a, r = g.table[:, b].astype(float), g.u.astype(float) @ h
            k = g.h
            z, reset = sig(a[:k] + r[:k]), sig(a[k : 2 * k] + r[k : 2 * k])
            c = np.tanh(a[2 * k :] + reset * r[2 * k :])
            h = z * h + (1 - z) * c
            out.append(h)
        return out

    f, b = run(n.forward, data), run(n.backward, data[::-1])[::-1]
    total = np.zeros(len(n.b))
    for x, y in zip(f, b, strict=True):
        e = np.exp(n.v @ np.r_[x, y] + n.b[:, 0])
        total += e / e.sum()
    return total


def test_whole_texts_are_read():
    n = net()
    p = language.LanguageParams(window=7, lanes=3)
    texts = [b"", b"a", b"abcdefg", b"some longer text of many windows", bytes(range(60))]
    got = language.label(texts, n, p)
    for t, g in zip(texts, got, strict=True):
        want = sum((one_by_one(n, t[i : i + 7]) for i in range(0, len(t), 7)), np.zeros(2))
        assert g == pytest.approx(want, abs=1e-3)


def test_gradients():
    """Backpropagation through time against differences."""
    r = np.random.default_rng(2)
    g = gru.Gru(r.normal(size=(6, 256)).astype(np.float64), r.normal(size=(6, 2)).astype(np.float64))
    x, weight = r.integers(0, 5, (4, 3)), r.normal(size=(4, 2, 3))

    def loss():
        h, keep, total = np.zeros((2, 3)), {}, 0.0
        for i in range(4):
            new, z, reset, n, inner = gru.step(g, h, x[i])
            keep[i], h = (h, z, reset, n, inner), new
            total += (new * weight[i]).sum()
        return total, keep

    dtable, du = gru._backward(g, x, weight, [0, 1, 2, 3], loss()[1])
    for param, grad in ((g.table, dtable), (g.u, du)):
        for at in [(i, j) for i in range(6) for j in range(2)]:
            was = param[at]
            param[at] = was + 1e-4
            up = loss()[0]
            param[at] = was - 1e-4
            down = loss()[0]
            param[at] = was
            assert grad[at] == pytest.approx((up - down) / 2e-4, rel=1e-3, abs=1e-4)


def vectors(n, terms, seed):
    r, out = random.Random(seed), []
    for _ in range(n):
        v = {r.randrange(terms): r.random() for _ in range(r.randint(1, 6))}
        norm = sum(x * x for x in v.values()) ** 0.5
        out.append({t: x / norm for t, x in v.items()})
    return out


def sparse(dicts):
    flat = sorted((i, t, x) for i, d in enumerate(dicts) for t, x in d.items())
    return Vectors(len(dicts), *(np.array(c) for c in zip(*flat, strict=True)))


@pytest.mark.parametrize("n, k, block, dense", [(300, 10, 16, 20), (300, 10, 16, 0), (5, 10, 4, 3), (64, 1, 64, 40)])
def test_nearest_are_exact(n, k, block, dense):
    examples, queries = vectors(n, 40, 1), vectors(50, 40, 2)
    best, who = BlockMaxIndex(sparse(examples), 40, block, dense).nearest(sparse(queries), k)
    for q, b, w in zip(queries, best, who, strict=True):
        s = sorted((sum(x * e.get(t, 0) for t, x in q.items()) for e in examples), reverse=True)[:k]
        s = [x for x in s if x > 1e-6]
        assert [x for x in b if x > 1e-6] == pytest.approx(s, abs=1e-5)
        for x, i in zip(b, w, strict=True):
            if i >= 0:
                assert x == pytest.approx(sum(y * examples[i].get(t, 0) for t, y in q.items()), abs=1e-5)


def test_toxicity(spark, docs):
    r = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    texts, toxic = [], []
    for _ in range(500):
        bad = r.random() < 0.3
        t = [r.choice(words) for _ in range(40)]
        if bad:
            for _ in range(4):
                t.insert(r.randrange(40), r.choice(["vileness", "vileful", "grot"]))
        texts.append(" ".join(t))
        toxic.append(int(bad))
    df = docs(texts + ODD, [*range(500), *range(900, 900 + len(ODD))])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(3, 0), (None, 1), (7777, 1), (4, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    held = [i for i in range(500) if out[i].held_out]
    assert held and np.mean([out[i].predicted == toxic[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert out[900].score == out[901].score and len(out) == 500 + len(ODD)
    hit = next(out[i] for i in held if toxic[i])
    assert hit.evidence[0].toxic == 1 and hit.evidence[0].similarity >= hit.evidence[-1].similarity
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in out.values())


def test_labels_do_not_leak(spark, docs):
    """Labels of held-out rows, and the other columns, change nothing."""
    texts = [f"{'rude' if i % 3 == 0 else 'kind'} line number {i} of text" for i in range(120)]
    df = docs(texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(df, labels, ToxicityParams(k=5)).collect()}
    held = [i for i in out if out[i].held_out]
    flipped = spark.createDataFrame([(i, int((i % 3 == 0) != (i in held))) for i in range(120)], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score(df.drop("source"), flipped, ToxicityParams(k=5)).collect()}
    assert again == {i: r.score for i, r in out.items()}


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs(ODD), none).collect()} == {0.0}
    assert toxicity.score(docs(["a"]).limit(0), none).count() == 0
