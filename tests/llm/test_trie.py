"""The conversation trie: against a plain version on shared, hot and odd families."""

import hashlib
import random
import zlib
from collections import defaultdict

from test_entry import same

from echofold.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node string, size long"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = [t[2:] for t in sorted(own.get(base, []))[:h] + sorted(own[c])[h:]]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(m) - 1) * (len(n[-1][1].encode()) if n else 0)
    out = []
    for n, m in members.items():
        ids = ",".join(map(str, sorted(ends.get(n, []))))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids.get(n, 0), leaves[n], saved[n], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    out = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).drop("node")
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain(rows)


def row(c, turn, role, text):
    return (c, turn, role, text, "x", "y", 1)


def test_against_a_plain_version(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(-12, 90), *range(20_000, 20_030), 10**12, 10**12 + 3]:
        if rng.random() < 0.85:
            first = "hot" if c % 3 == 0 else rng.choice("abcdé")
            rows += [row(c, t, "user" if t % 2 == 0 else "assistant", first if t == 0 else rng.choice(["x", "yy", "𝒳", ""])) for t in range(rng.randint(1, 12))]
    check(spark, rows)


def test_hot_conversation_and_long_end_lists(spark, monkeypatch):
    monkeypatch.setattr(trie, "_CHUNK_BITS", 3)
    monkeypatch.setattr(trie, "_HELD", 4)
    same_all = [row(c, t, "user", f"t{t}") for c in range(300) for t in range(2)]
    check(spark, same_all + [row(c, t, "user", f"{c} {t}") for c in (400, 401) for t in range(60)])


def test_odd_rows(spark):
    # null and equal turns, null roles and texts, repeated rows, a row without an id, absent bases, conversations that become turnless
    odd = [row(1, None, None, None), row(1, 0, "user", "b"), row(1, 0, "user", "a"), row(1, 0, "user", "a"), row(2, 5, "a:", "b"), row(2, 5, "a", ":b"), row(None, 1, "user", "lost"), row(7, 0, "user", "x"), row(13, 1, "user", "w " * 200_000)]
    check(spark, odd)
    check(spark, [row(0, 0, None, "x"), row(5, 0, "", "x"), row(5, 1, "", "y")])


def test_empty(spark):
    check(spark, [])


def test_family_out_of_order_is_an_error():
    import pyarrow as pa
    import pytest

    b = pa.RecordBatch.from_pydict({"base": [0, 0], "conv_id": [1, 0], "digest": [b"x", b"y"], "size": [1, 1]})
    with pytest.raises(ValueError):
        list(trie._family_nodes(iter([b])))


def test_sql(spark):
    same(spark, "op11_prefix_trie")
