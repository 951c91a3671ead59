"""Chat formatting, fingerprints and revisits: Spark expressions only."""

import hashlib

import pytest
from llm.common_texts import ODD
from pyspark.sql import functions as F

from echofold.llm import chat, fingerprints, warc

TURNS = [
    (1, 2, "assistant", "b & <|im_end|> &lt;|"),
    (1, 0, "system", None),
    (1, 1, "user", "<|im_start|>user\nx"),
    (1, 3, "assistant", "more<"),
    (1, 4, "assistant", ""),
    (1, 5, "us\ner&nl;", "|im_end|>"),
    (2, 0, None, "alone"),
    (2, 0, None, "alone"),
    (None, 7, "assistant", "lost\n"),
    (None, None, "user", "é𝒳"),
]


def chats(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    return chat.format_chats(df)


def test_chat_round_trip(spark):
    out = chats(spark)
    rows = out.select("conv_id", "formatted", "loss_runs", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_texts(F.col("formatted"), F.col("loss_runs")).alias("m")).collect()
    for r in rows:
        own = sorted((t for t in TURNS if t[0] == r.conv_id), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(x.role, x.text) for x in r.t] == [(t[2] or "", t[3] or "") for t in own]
        assert [x for x in r.m if x] == [t[3] for t in own if t[2] == "assistant" and t[3]]
        assert sum(x.chars for x in r.loss_runs) == len(r.formatted)
    one = next(r for r in rows if r.conv_id == 1)
    assert one.formatted.count("<|im_start|>") == 4 and one.formatted.count("<|im_next|>") == 2


def test_chat_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_sketches(spark, docs):
    df = fingerprints.add_sketches(docs(ODD), {"text": "s"})
    got = {r.doc_id: list(r.s) for r in df.collect()}
    assert got[0] == got[1] == got[2] == [] and got[5] == got[6] and len(got[3]) == 1
    assert all(v == sorted(set(v)) for v in got.values())
    whole = " ".join(f"w{i % 900}" for i in range(4000))
    parts = docs([whole, " ".join(whole.split()[:400]), "other words " * 50])
    s = {r.doc_id: r for r in fingerprints.add_sketches(parts, {"text": "s"}).select("doc_id", "s").collect()}
    assert set(s[1].s) <= set(s[0].s) and 900 / 2 * 0.8 < len(s[0].s) < 900 / 2 * 1.2
    both = spark.createDataFrame([(s[0].s, s[1].s, s[2].s)], "a array<long>, b array<long>, c array<long>")
    a, b, c = (F.col(x) for x in "abc")
    r = both.select(fingerprints.containment(a, b), fingerprints.containment(a, c), fingerprints.resemblance(a, b), fingerprints.merge(a, b)).first()
    assert r[0] == 1.0 and r[1] == 0.0 and 0.3 < r[2] < 0.6 and r[3] == s[0].s


@pytest.mark.parametrize("ids", [list(range(200)), [i * 977 for i in range(200)], [-(2**62), -5, -1, 0, 3, 63, 64, 4096, 2**40, 2**62], [7], [3, 3, 9]])
def test_next(spark, ids):
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, v string")
    got = {r.id: r.n for r in fingerprints.with_next(df, "id", "v", "n").collect()}
    order = sorted(set(ids))
    want = {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    if len(ids) == len(order):
        assert got == want
    else:
        assert len(got) == len(order)


def test_next_of_nothing(spark):
    assert fingerprints.with_next(spark.createDataFrame([], "id long, v string"), "id", "v", "n").count() == 0


def test_no_python_in_native_plans(spark, docs):
    df = fingerprints.with_next(docs(["a b", "c"]), "doc_id", "text", "next")
    for plan in (fingerprints.add_sketches(df, {"text": "s"}), chats(spark)):
        assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id long, type string, url string, at long, headers map<string,string>").withColumn("ts", F.timestamp_seconds("at"))


def test_revisits(spark):
    tag = {"etag": '"1"', "server": "a", "date": "d1"}
    rows = [
        (1, "response", "http://www.X.org:80/a/", 100, tag),
        (2, "response", "https://x.org/a#f", 7200, {"last-modified": "m"}),
        (3, "revisit", "http://x.org/a", 100, tag),  # not earlier
        (4, "revisit", "http://x.org/a", 101, {"etag": 'W/"1"', "date": "d2", "server": "b", "vary": None}),
        (5, "revisit", "http://x.org/a", 7199, {"etag": '"2"'}),
        (6, "revisit", "http://x.org/a", 9000, {"last-modified": "m", "expires": "e"}),
        (7, "revisit", "http://x.org/a", 9000, {"etag": '"1"'}),
        (8, "revisit", "http://x.org/a", 9000, None),
        (9, "revisit", None, 9000, tag),
        (10, "revisit", "http://x.org/b", None, tag),
        (11, "response", "http://y.org", 50, {"etag": "q"}),
        (12, "response", "http://y.org/", 50, {"etag": "r"}),
        (13, "revisit", "ftp://y.org", 60, {"etag": "r"}),
        (13, "revisit", "ftp://y.org", 60, {"etag": "r"}),
    ]
    out = [(r.record_id, r.status, r.response_id, r.headers) for r in warc.resolve_revisits(records(spark, rows)).collect()]
    assert len(out) == 10
    got = {r[0]: r[1:] for r in out}
    assert got[3][:2] == ("no_response", None)
    assert got[4] == ("resolved", 1, {"etag": 'W/"1"', "date": "d2", "server": "a"})
    assert got[5][:2] == ("changed", 1)
    assert got[6] == ("resolved", 2, {"last-modified": "m", "expires": "e"})
    assert got[7][0] == got[8][0] == "unverifiable"
    assert got[9][0] == got[10][0] == "no_response"
    assert got[13] == ("resolved", 12, {"etag": "r"})


def test_revisits_against_a_scan(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.choice(["response", "revisit"]), f"http://h/{r.choice('aaab')}", r.randrange(0, 20000, r.choice([1, 3600])), {"etag": r.choice("xy")}) for i in range(400)]
    got = {x.record_id: (x.status, x.response_id) for x in warc.resolve_revisits(records(spark, rows)).collect()}
    for i, kind, url, at, h in rows:
        if kind == "revisit":
            older = [(t, k, g["etag"]) for k, n, u, t, g in rows if n == "response" and u == url and t < at]
            best = max(older, default=None)
            want = ("no_response", None) if not best else ("resolved" if best[2] == h["etag"] else "changed", best[1])
            assert got[i] == want


def test_edited_digest(spark, docs, tmp_path):
    texts = ["abcdef", "", "xyz", "𝒳" * 5]
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in fingerprints.op5_fingerprint(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[(i + 1) % 4][:half]
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and out[i].n_chars == len(t)


def xx(value, seed=42):
    """XXH64 as Spark gives it: of a string or a long, with a seed; signed."""
    import struct

    import xxhash

    data = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    h = xxhash.xxh64_intdigest(data, seed % 2**64)
    return h - 2**64 if h >= 2**63 else h


def plain_shingles(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = [xx(x) for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    out = []
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[i : i + 5]:
            h = xx(x, h)
        out.append((h % 2**64) >> 16)
    return out


def plain_sketch(shingles):
    low = sorted({x for x in shingles if x < 2**47})
    return low or ([min(shingles)] if shingles else [])


def plain_near(x, y):
    """From the two fingerprints alone."""
    a, b = plain_sketch(x), plain_sketch(y)
    if not a or not b:
        return float(a == b)
    low = [[h for h in s if h < 2**47] for s in (a, b)]
    return 1.0 if a == b else len(set(a) & set(b)) / min(map(len, low)) if all(low) else 0.0


def test_fingerprints_are_the_plain_ones(spark, docs, tmp_path):
    """Every column of the query, with null, empty, short, repeated and long texts and ids far apart."""
    import random

    r = random.Random(3)
    long = [" ".join(f"W{r.randrange(300)}" for _ in range(400)) for _ in range(6)]
    texts = [*ODD, *long, *(" ".join(long[i % 6].split()[20 * i : 20 * i + n]) for i, n in enumerate([3, 5, 8, 30, 100, 200])), long[0], "a b c d e f"]
    ids = sorted(r.randrange(-(2**62), 2**62) for _ in range(len(texts) // 2)) + list(range(2**62, 2**62 + len(texts) - len(texts) // 2))
    docs(texts, ids).write.parquet(str(tmp_path / "documents.parquet"))
    out = {x.doc_id: x for x in fingerprints.op5_fingerprint(spark, str(tmp_path)).collect()}
    whole = [t or "" for t in texts]
    hexed = lambda s: "".join(f"{h:012x}" for h in s)
    for k, (i, t) in enumerate(zip(ids, whole, strict=True)):
        after, half = whole[(k + 1) % len(whole)], len(t) // 2
        a, b, c = (plain_shingles(x) for x in (t, t[: len(t) - half] + after[:half], after))
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (hexed(plain_sketch(a)), hexed(plain_sketch(b)))
        assert (out[i].near_edited, out[i].near_next) == (pytest.approx(plain_near(a, b)), pytest.approx(plain_near(a, c)))


def test_short_texts_inside_long_ones(spark):
    """Texts of nine words (five shingles), each wholly inside one of 3000 words: sketches find all but those without a hash below the fraction."""
    import random

    r = random.Random(1)
    w = [f"w{r.randrange(5000)}" for _ in range(3000)]
    df = spark.createDataFrame([(" ".join(w[k : k + 9]), " ".join(w)) for k in range(0, 2970, 30)], "t string, long string")
    got = fingerprints.add_sketches(df, {"t": "a", "long": "b"})
    near = [x[0] for x in got.select(fingerprints.containment(F.col("a"), F.col("b"))).collect()]
    assert set(near) <= {None, 1.0} and near.count(None) <= 10


def test_empty_table_and_clashing_names(spark, docs, tmp_path):
    docs(["a"]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert fingerprints.op5_fingerprint(spark, str(tmp_path)).count() == 0
    df = spark.createDataFrame([(3, "c", 1, 2), (1, "a", 1, 2), (None, "b", 1, 2)], "doc_id long, text string, k long, __h_0 long")
    out = {x.text: x for x in fingerprints.add_sketches(fingerprints.with_next(df, "doc_id", "text", "g"), {"text": "s"}).collect()}
    assert out["c"]["__h_0"] == 2 and {t: x.g for t, x in out.items()} in ({"a": "b", "b": "c", "c": "a"}, {"b": "a", "a": "c", "c": "b"})
