import random
import re

import numpy as np
import pytest
import xxhash
from llm.common_texts import ODD

from echofold.llm.simhash import GrayIndex, SimHashParams, find_links, gray_rank, keep_one, masks, near_duplicates, simhash


def plain(text):


    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(codes, k=2):
    a, root = np.array(codes, np.uint64), list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= k):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(codes))]


def clustered(n, seed):
    r, out = random.Random(seed), {0, 2**64 - 1}
    for _ in range(n):
        x = r.getrandbits(64)
        out.add(x)
        for _ in range(r.randint(0, 8)):
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("text", ODD)
def test_fingerprint(text):
    assert simhash(text) == plain(text)


def test_masks_meet_every_close_pair():
    m = masks(2)
    assert len(m) == 15
    r = random.Random(1)
    for _ in range(500):
        d = (1 << r.randrange(64)) | (1 << r.randrange(64))
        assert any(not d & x for x in m)


def test_gray_neighbours():
    codes = np.arange(64, dtype=np.uint64)
    by_rank = codes[np.argsort(gray_rank(codes))]
    assert (np.bitwise_count(by_rank[1:] ^ by_rank[:-1]) == 1).all()


def test_index_finds_all_links():
    c = np.array(clustered(120, 2), np.uint64)
    c = c[np.argsort(gray_rank(c))]
    index = GrayIndex(c, np.zeros(len(c), np.uint64), 0, fan=4)
    got = {(int(i), int(j)) for a, b in index.links(2, 3000) for i, j in zip(a, b, strict=True)}
    d = np.bitwise_count(c[:, None] ^ c[None])
    assert got == {(i, j) for i in range(len(c)) for j in range(i + 1, len(c)) if d[i, j] <= 2}


def test_links_across_tasks(spark):
    c = clustered(150, 3)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in c], "fp long")
    links, root = find_links(df).collect(), {x: x for x in c}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        x, y = find(r.a % 2**64), find(r.b % 2**64)
        root[max(x, y)] = min(x, y)
    own, want = {}, {}
    for x, w in zip(c, classes(c), strict=True):
        own.setdefault(find(x), set()).add(x)
        want.setdefault(w, set()).add(x)
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, want.values()))


def test_documents(spark, docs):
    r = random.Random(5)
    long = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(300)) for _ in range(4)]
    texts = [*ODD, *long, long[0] + " end", long[1].upper(), *long]
    ids = [None if i == 4 else 1000 - i for i in range(len(texts))]
    out = near_duplicates(docs(texts, ids)).collect()
    code = [plain(t) for t in texts]
    root = classes(code)
    least = {}
    for i, w in zip(ids, root, strict=True):
        least[w] = min((x for x in (least.get(w), i) if x is not None), default=None)
    want = sorted(((i or -1), c, least[w] or -1) for i, c, w in zip(ids, code, root, strict=True))
    assert sorted((r.doc_id or -1, r.fp % 2**64, r.component_id or -1) for r in out) == want
    kept = keep_one(docs(texts, ids))
    assert kept.columns == docs(["a"]).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(x for x in set(least.values()) if x)


def test_empty(spark, docs):
    assert near_duplicates(docs(["a"]).limit(0), SimHashParams()).count() == 0
