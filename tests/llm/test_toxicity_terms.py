"""Toxicity scores against the plain formula, from words to curve; vectors have every word of the examples."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofold.llm import toxicity
from echofold.llm.decontaminate import words


def features(word, stems):
    w = word.decode()
    return [w, *((w[:n], n) for n in stems if len(w) >= n)]


class Plain:
    """The whole model over (id, text) rows and labels, one vector at a time."""

    def __init__(self, rows, labels, p):
        self.p, self.n = p, len(rows)
        self.terms = [Counter(x for w in words(t) for x in features(w, p.stems)) for _, t in rows]
        self.df = Counter(x for c in self.terms for x in c)
        fold = lambda i: zlib.crc32(str(i).encode()) % p.fold_mod
        self.examples = sorted((i, labels[i], c) for (i, _), c in zip(rows, self.terms, strict=True) if i in labels and fold(i) and c)
        self.known = {x for _, _, c in self.examples for x in c}
        self.share = sum(y for _, y, _ in self.examples) / len(self.examples)
        votes = []
        for at, (i, _, c) in enumerate(self.examples):
            f = self.factors([e for j, e in enumerate(self.examples) if j % 2 != at % 2])
            votes.append(self.vote(self.nearest(c, f, p.k, leave=i)))
        self.curve = toxicity._logistic(np.array(votes), np.array([y for _, y, _ in self.examples], float))
        self.whole = self.factors(self.examples)

    def factors(self, some):
        n, bad = len(some), sum(y for _, y, _ in some)
        df, a = Counter(x for _, _, c in some for x in c), Counter(x for _, y, c in some if y for x in c)
        part = lambda o, e: o * math.log(o / e) if o else 0.0
        out, s = {}, bad / n
        for x, m in df.items():
            g = 2 * (part(a[x], m * s) + part(m - a[x], m * (1 - s)) + part(bad - a[x], (n - m) * s) + part(n - m - bad + a[x], (n - m) * (1 - s)))
            out[x] = math.sqrt(1 + max(0, g)) if a[x] > m * s else 1.0
        return out

    def vector(self, c, f):
        w = {x: (1 + math.log(k)) * (math.log((1 + self.n) / (1 + self.df[x])) + 1) * f.get(x, 1.0) for x, k in c.items() if x in self.known}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()}

    def nearest(self, c, f, k, leave=None):
        own, found = self.vector(c, f), []
        for i, y, other in self.examples:
            if i != leave:
                v = self.vector(other, f)
                s = round(sum(x * v.get(t, 0) for t, x in own.items()), 6)
                found.append((-s, i, y))
        return [(-s, i, y) for s, i, y in sorted(found)[:k] if s < 0]

    def vote(self, near):
        say = [(1 / (self.p.near + max(0, 1 - s)), y) for s, _, y in near]
        return math.log((sum(v for v, y in say if y) + self.share) / (sum(v for v, y in say if not y) + 1 - self.share))

    def score(self, c):
        if not any(x in self.known for x in c):
            return self.share
        return 1 / (1 + math.exp(-(self.curve[0] * self.vote(self.nearest(c, self.whole, self.p.k)) + self.curve[1])))


def topics(n=90):
    """Texts on five topics, one of ten with rude words, two without any known word."""
    own = [[f"t{t}w{i}é" for i in range(20)] for t in range(5)]
    texts = [" ".join(own[i % 5][(i * 7 + j * 3 + j * j * (i % 3)) % 20] for j in range(12)) + (" vile vileness, RUDE" if i % 10 == 0 else "") for i in range(n)]
    return texts + ["nothing known", "", "ties ties", "ties ties"]


@pytest.mark.parametrize("as_text", [False, True])
def test_scores_are_the_plain_ones(spark, docs, as_text):
    """With ids that are numbers, and with ids that are text."""
    texts = topics()
    ids = [f"d{i:03}" if as_text else i for i in range(len(texts))]
    df = docs(texts)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(90)], "doc_id long, toxic int")
    if as_text:
        name = F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0"))
        df, labels = df.withColumn("doc_id", name), labels.withColumn("doc_id", name)
    params = toxicity.ToxicityParams(block=16, dense=8)
    out = {r.doc_id: r for r in toxicity.score(df, labels, params).collect()}
    plain = Plain(list(zip(ids, texts, strict=True)), {ids[i]: int(i % 10 == 0) for i in range(90)}, params)
    for i, c in zip(ids, plain.terms, strict=True):
        near = plain.nearest(c, plain.whole, params.k) if any(x in plain.known for x in c) else []
        assert [e.id for e in out[i].evidence] == [x for _, x, _ in near]
        assert [e.similarity for e in out[i].evidence] == pytest.approx([s for s, _, _ in near], abs=3e-6)
        assert out[i].score == pytest.approx(plain.score(c), abs=1e-3)


def test_texts_without_toxic_words_have_neighbours_of_their_own(spark, docs):
    texts = topics(300)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs(texts), labels).collect()}
    clean = [i for i in range(300) if out[i].held_out and i % 10]
    assert len(clean) > 30
    assert all(e.id % 5 == i % 5 for i in clean for e in out[i].evidence)


def test_repeated_ids_and_labels(spark, docs):
    """The least text of an id is the example, and its highest label holds."""
    texts, ids = ["aaa bbb", "zzz yyy", "ccc ddd", "aaa bbb"], [1, 1, 2, 3]
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs(texts, ids), labels, toxicity.ToxicityParams(fold_mod=1000003)).collect()
    assert len(out) == 4
    assert next(e.toxic for r in out if r.doc_id == 3 for e in r.evidence if e.id == 1) == 1
    assert next(r.evidence for r in out if r.doc_id == 1 and not any(e.similarity for e in r.evidence)) == []


def test_cross_validation_leaves_the_held_out_fold_alone(spark, docs):
    from echofold.llm.toxicity import ToxicityParams, cross_validate

    texts = [("bad awful words " if i % 3 == 0 else "kind good words ") + f"w{i % 7} w{i % 5}" for i in range(120)]
    table = docs(texts)
    choices = [ToxicityParams(k=1), ToxicityParams(k=5, stems=())]
    rows = [(i, int(i % 3 == 0)) for i in range(120)]
    other = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in rows]
    got = [cross_validate(table, spark.createDataFrame(r, "doc_id long, toxic int"), choices) for r in (rows, other)]
    assert np.allclose(got[0], got[1]) and all(found == 1.0 and called == 0.0 for _, found, called in got[0])


def test_driver_makes_no_index(spark, docs, monkeypatch):
    """The examples' own votes come from the executors: on the driver an index of all examples would take most of its room."""
    import os

    from echofold.llm import toxicity

    driver, made = os.getpid(), toxicity.BlockMaxIndex

    def elsewhere(*args):
        if os.getpid() == driver:
            raise AssertionError("an index on the driver")
        return made(*args)

    monkeypatch.setattr(toxicity, "BlockMaxIndex", elsewhere)
    texts = [f"plain words of text {i}" if i % 2 else f"vile insults of text {i}" for i in range(80)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(docs(texts), labels)
    assert model.index is None and model.curve[0] > 0
