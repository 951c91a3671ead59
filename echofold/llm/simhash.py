"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Fingerprints: A-Z lower-cased, words split at white space, shingles of three
words with repeats; a bit is 1 where over half of the shingles' XXH64 hashes
have it.  Equal fingerprints are one *node* from then on, so copies cost
nothing further.

Links are pairs of nodes that differ in at most ``distance`` bits.  The 64 bits
are cut into ``distance + 4`` blocks; two linked nodes agree in all bits of at
least four blocks, so each node is entered once for every choice of four
blocks, under the bits in them.  For distance 2 that is 15 entries under 42 to
44 bits each: a group has 2 ** 22 nodes at the very most, whatever the data.

Within a group, nodes are sorted by Gray rank and joined through a tree: sixteen
neighbours form an upper node, which holds the bit pattern that they share and
the mask of where they share it; sixteen such nodes form the next, and so on;
the entry's own bits are the root.  A search goes down level by level and adds
the differences in the bits that a node's mask has over its parent's; a whole
subtree goes as soon as the sum passes the limit; at a leaf the sum is the
distance.  Every task reports a spanning forest of the links it finds, not the
pairs.  The forests' components are the classes.

Defined results: null and empty texts have the fingerprint zero, linked like
any other; null ids belong to the class of their fingerprint, whose id is the
least id that is not null; repeated rows stay; an empty table gives an empty
result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import connected_components
from .common import LOWER, cut, partitions, table


@dataclass(frozen=True)
class SimHashParams:
    width: int = 3
    distance: int = 2
    seed: int = 42
    #: Children of an upper node.
    fan: int = 16
    #: Pairs of a query and a node that a search holds at once.
    frontier: int = 2_000_000


#: Shingles whose bits are counted at once: bounds memory for very long texts.
_CHUNK = 65536


def simhash(text: str | None, params: SimHashParams = SimHashParams()) -> int:
    """The fingerprint as an unsigned number."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return 0
    k = params.width
    shingles = map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else iter([b" ".join(w)])
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=params.seed), shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def add_simhash(docs: DataFrame, params: SimHashParams = SimHashParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), params) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Where each code stands in the reflected Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def masks(distance: int) -> list[int]:
    """The bits of every choice of four among distance + 4 blocks of the 64 bits."""
    n = distance + 4
    cuts = [64 * i // n for i in range(n + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(block, 4)]


class GrayIndex:
    """Trees over codes that are sorted by (group, Gray rank); a group shares the bits of ``mask``."""

    def __init__(self, codes: np.ndarray, group: np.ndarray, mask: int, fan: int = 16):
        n = len(codes)
        every = np.uint64(2**64 - 1)
        #: From the leaves up: (pattern, mask, first child or code, one past the last, group).
        self.levels = [(codes, np.full(n, every), np.arange(n), np.arange(1, n + 1), group)]
        while True:
            pattern, own, _, _, g = self.levels[-1]
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
            if len(self.levels) > 1 and len(first) == len(g):
                break
            inside = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
            heads = np.flatnonzero(inside % fan == 0)
            agree = np.bitwise_and.reduceat(own & ~(pattern ^ np.repeat(pattern[heads], np.diff(np.r_[heads, len(g)]))), heads)
            self.levels.append((pattern[heads] & agree, agree, heads, np.r_[heads[1:], len(g)], g[heads]))
        self.codes, self.group, self.mask = codes, group, np.uint64(mask)
        # last code below each node, to leave out what lies before the query
        self.last = [np.arange(n)]
        for _, _, _, end, _ in self.levels[1:]:
            self.last.append(self.last[-1][end - 1])

    def links(self, distance: int, frontier: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of pairs i < j of code numbers of one group that differ in at most distance bits."""
        root_of = np.searchsorted(self.levels[-1][4], self.group)
        at = 0
        step = max(1, frontier // 64)
        while at < len(self.codes):
            q = np.arange(at, min(len(self.codes), at + step))
            at += step
            yield from self._search(q, root_of[q], np.zeros(len(q), np.uint8), np.full(len(q), self.mask), len(self.levels) - 1, distance, frontier)

    def _search(self, q, node, acc, seen, level, distance, frontier):
        """Go down from (query, node) pairs at a level, depth first by halves where they are too many."""
        if len(q) > frontier and len(np.unique(q)) > 1:
            half = len(q) // 2
            for s in (slice(None, half), slice(half, None)):
                yield from self._search(q[s], node[s], acc[s], seen[s], level, distance, frontier)
            return
        pattern, mask, first, end, _ = self.levels[level]
        m = mask[node]
        acc = acc + np.bitwise_count((self.codes[q] ^ pattern[node]) & m & ~seen)
        on = (acc <= distance) & (self.last[level][node] > q)
        q, node, acc, seen = q[on], node[on], acc[on], m[on]
        if level == 0:
            if len(q):
                yield q, node
            return
        if not len(q):
            return
        n = end[node] - first[node]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        child = np.repeat(first[node], n) + offset
        yield from self._search(np.repeat(q, n), child, np.repeat(acc, n), np.repeat(seen, n), level - 1, distance, frontier)


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite a[i] with b[i] in root, in which every entry points to the least of its class."""
    while len(a):
        x, y = root[a], root[b]
        on = x != y
        if not on.any():
            return
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _forest(codes: np.ndarray, entry: np.ndarray, all_masks: list[int], params: SimHashParams) -> pa.RecordBatch:
    """Spanning links of the groups that are whole in (entry, code)."""
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for t, m in enumerate(all_masks):
        c = codes[entry == t]
        if len(c) < 2:
            continue
        group, rank = c & np.uint64(m), gray_rank(c)
        order = np.lexsort((rank, group))
        c, group = c[order], group[order]
        same = group[1:] == group[:-1]
        many = np.r_[False, same] | np.r_[same, False]
        c, group = c[many], group[many]
        if not len(c):
            continue
        root = np.arange(len(c))
        for i, j in GrayIndex(c, group, m, params.fan).links(params.distance, params.frontier):
            _merge(root, i, j)
        moved = np.flatnonzero(root != np.arange(len(c)))
        ends.append((c[moved], c[root[moved]]))
    a, b = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, np.uint64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def find_links(nodes: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(a, b): links whose components are those of all links among distinct fingerprints ``fp``."""
    all_masks = masks(params.distance)
    signed = [m - 2**64 if m >= 2**63 else m for m in all_masks]
    under: Column = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))
    entries = nodes.select("fp", F.posexplode(under).alias("entry", "key"))
    dealt = entries.repartition(partitions(nodes.sparkSession), "entry", "key").sortWithinPartitions("entry", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # groups come one after another; what follows the last border may go on in the next batch
        codes, entry, key = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for b in batches:
            codes = np.r_[codes, b.column(0).to_numpy().view(np.uint64)]
            entry = np.r_[entry, b.column(1).to_numpy()]
            key = np.r_[key, b.column(2).to_numpy()]
            if not len(key):
                continue
            whole = int(np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (key[1:] != key[:-1])])[-1])
            if whole >= 200_000:
                yield _forest(codes[:whole], entry[:whole], all_masks, params)
                codes, entry, key = codes[whole:], entry[whole:], key[whole:]
        yield _forest(codes, entry, all_masks, params)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the least id reachable over links."""
    prints = cut(add_simhash(docs, params, id_col=id_col, text_col=text_col))
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    classes = connected_components(find_links(nodes, params)).select(F.col("id").alias("fp"), F.col("component").alias("class"))
    classed = nodes.join(classes, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    heads = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    of = classed.join(heads, "class").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """One document of each class, that with the least id; of rows that share the id, one. All columns as they are.

    Rows without an id stay only where their class has no id, one for each fingerprint."""
    found = cut(near_duplicates(docs, params))
    heads = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    nameless = found.where(F.col("component_id").isNull())
    if not nameless.isEmpty():
        texts = add_simhash(docs.where(F.col("doc_id").isNull()).withColumn("_row", F.struct(*docs.columns)), params, id_col="_row")
        loose = texts.join(nameless.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("_row").alias("_row")).select("_row.*")
        kept = kept.unionByName(loose)
    return kept.select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
