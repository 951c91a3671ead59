"""The audit of sources: against a plain version in whole numbers, and odd rows."""

import random
import re
from collections import Counter, defaultdict

from llm.common_texts import ODD
from test_entry import same

from echofold.llm.divergence import AuditParams, audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, value long, n long, p long"


def plain(rows, params):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source, *_ in rows]
    df, count = Counter(), defaultdict(Counter)
    for lang, source, terms in docs:
        df.update((lang, t) for t in set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for (g, t), n in df.items() if g == lang and n >= params.least_docs]
        share = {}
        for key in [k for k in count if k[0] == lang] + [lang]:
            own = count[key] if key != lang else sum((count[k] for k in count if k[0] == lang), Counter())
            total = sum(own[t] for t in kept) + params.prior * len(kept)
            share[key] = {t: 1 + params.scale * (own[t] + params.prior) // total for t in kept}
        for g in [k for k in count if k[0] == lang]:
            parts = {"pair": [(o[1], sum(abs(share[g][t] - share[o][t]) for t in kept)) for o in count if o[0] == lang and o != g]}
            parts["term"] = [(t, share[g][t] - share[lang][t]) for t in kept if count[g][t] and share[g][t] > share[lang][t]]
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(*g, part, item, value, k) for k, (item, value) in enumerate(items, 1) if part == "pair" or k <= params.top_terms]
    return sorted(out)


def check(spark, rows, params=AuditParams()):
    got = audit(spark.createDataFrame(rows, SCHEMA), params)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, params)


def test_against_a_plain_version(spark):
    rng = random.Random(5)
    words = ["the", "The", "été", "Été", "übrig", "x", "日本", "a1b", "don't", "ÉCOLE", "école", "𝒳y"]
    hot = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), "en", "src0", "t", 1, 2, 3) for i in range(150)]
    rest = [(i, " ".join(rng.choices(words[: 2 + i % 10], k=rng.randint(0, 9))), rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "é", "z", None]), None, None, None, None) for i in range(250)]
    check(spark, hot + rest, AuditParams(least_docs=20, top_terms=4))
    check(spark, hot + rest)


def test_odd_rows(spark):
    odd = [(None, t, lang, s, None, None, None, None) for t in ODD for lang in ("en", None) for s in ("a", "b", None)]
    check(spark, odd * 2, AuditParams(least_docs=3))
    # no kept term: distances of 0 for every two sources; a source alone has none
    check(spark, [(1, None, "en", "a", *[None] * 4), (1, "", "en", "b", *[None] * 4), (2, "x", "de", "a", *[None] * 4)])
    check(spark, [(1, "long " * 100_000 + "x", "en", "a", *[None] * 4)] * 2 + [(2, "x", "en", "b", *[None] * 4)], AuditParams(least_docs=2))


def test_empty(spark):
    check(spark, [])


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    from echofold.llm.divergence import _share

    row = spark.range(1).select(_share(F.lit(10**13), F.lit(3 * 10**13 + 1), F.lit(7), AuditParams())).first()
    assert row[0] == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 1 + 35)


def test_sql(spark):
    same(spark, "op13_divergence")
