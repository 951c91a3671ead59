"""The matching rules in plain Python, to hold the engine against."""

import random

import numpy as np

MASK = 2**64 - 1
NO_MATCH = (0, np.float32(3.4028234663852886e38), 0)


def restless(n, seed=17):
    """Frames that all differ from their neighbours in many bits."""
    r = random.Random(seed)
    return [r.getrandbits(64) for _ in range(n)]


def signed(xs):
    return [x - 2**64 if x >= 2**63 else x for x in xs]


def moving(seq, bits):
    if bits == 0:
        return [True] * len(seq)
    near = lambda i, j: 0 <= j < len(seq) and (seq[i] ^ seq[j]).bit_count() >= bits
    return [near(i, i - 1) or near(i, i + 1) for i in range(len(seq))]


def align(a, b, least, bits):
    m, ma, mb, best = max(least, 1), moving(a, bits), moving(b, bits), None
    for shift in range(m - len(b), len(a) - m + 1):
        x, y = max(shift, 0), max(-shift, 0)
        n = min(len(a) - x, len(b) - y)
        d = [(a[x + k] ^ b[y + k]).bit_count() for k in range(n) if ma[x + k] or mb[y + k]]
        if n >= m and len(d) >= m:
            avg = np.float32(sum(d) / len(d))
            if best is None or avg < best[1]:
                best = (shift, avg, len(d))
    return best or NO_MATCH


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}
