"""Minimax contiguous partition of documents into shards.

Documents with equal texts form one atomic group.  Groups are ordered by the
MD5 of their text (a null text counts as empty) and the order is cut into at most ``n_shards`` contiguous runs so that the largest run,
in bytes, is as small as any such cutting allows.

The smallest feasible capacity is found by binary search, checking each
capacity greedily.  The list of all groups never reaches the driver: it works
on *cells*, intervals of the key order with the sum, the largest group and the
number of groups in each.  A first pass yields at most ``2 ** first_bits``
cells.  Two capacities enclose the optimum: one feasible with every cell taken
as indivisible, one below which not even divisible cells would do.  Cells that
a cut can fall into between those two are split further by another pass over
the (small) table of groups, until every such cell is a single group.  Then
both bounds meet and the result is the exact optimum over groups.  Within that
capacity the cuts are then placed as evenly as it permits.

Slots count from 0 in each shard without gaps.  Rows of a shard are dealt into
bounded bins by a hash of the id, numbered within the bin, and shifted by the
sum of the bins before; no task holds a whole shard.

Defined results: an empty table gives an empty result; null ids are kept and
hash as empty text; repeated rows each get a slot; columns of the input other
than the id and text are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Bits of the MD5 that order the groups; two texts that agree in all of them
#: would merely stay together.
KEY_BITS = 60


@dataclass(frozen=True)
class ShardParams:
    n_shards: int = 16
    #: Most cells of the first pass, as a power of two: bounds what the driver holds.
    first_bits: int = 14
    #: Each later pass splits a cell in 2 ** split_bits.
    split_bits: int = 8
    #: Rows that a slot bin holds on average.
    bin_rows: int = 4096


@dataclass
class Cell:
    """The keys from ``lo`` on that share its first ``bits`` bits."""

    lo: int
    bits: int
    size: int
    largest: int
    groups: int


def greedy(sizes: list[int], capacity: int) -> list[int] | None:
    """Ends (exclusive) of the runs that a first-fit sweep makes, or None if one size is over the capacity."""
    ends, filled = [], 0
    for i, s in enumerate(sizes):
        if s > capacity:
            return None
        if filled + s > capacity:
            ends.append(i)
            filled = 0
        filled += s
    return [*ends, len(sizes)]


class _Line:
    """Prefix sums over the cells, for sweeps by bisection: shards * log(cells) steps."""

    def __init__(self, cells: list[Cell]):
        self.prefix = [0]
        for c in cells:
            self.prefix.append(self.prefix[-1] + c.size)
        self.largest = max((c.size for c in cells), default=0)

    def ends(self, capacity: int, n: int) -> list[int] | None:
        """Cell ends of a greedy sweep with cells indivisible; None if more than n runs are needed."""
        if capacity < self.largest:
            return None
        ends, i, last = [], 0, len(self.prefix) - 1
        while i < last:
            if len(ends) == n:
                return None
            i = bisect_right(self.prefix, self.prefix[i] + capacity) - 1
            ends.append(i)
        return ends

    def even_ends(self, capacity: int, n: int) -> list[int]:
        """Ends of at most n runs within a feasible capacity, each as near to its share of the rest as that permits.

        A group far above the average sets the capacity; plain first fit would then fill a few shards and leave the others empty."""
        last = len(self.prefix) - 1
        need = [last]  # need[k]: the earliest start from which k runs suffice
        for _ in range(n):
            need.append(bisect_left(self.prefix, self.prefix[need[-1]] - capacity) if self.prefix[need[-1]] > capacity else 0)
        ends, i = [], 0
        for left in range(n, 0, -1):
            if i == last:
                break
            share = -(-(self.prefix[-1] - self.prefix[i]) // left)
            far = bisect_right(self.prefix, self.prefix[i] + capacity) - 1
            i = max(need[left - 1], min(far, max(i + 1, bisect_left(self.prefix, self.prefix[i] + share))))
            ends.append(i)
        return ends


def smallest_capacity(cells: list[Cell], n: int) -> int:
    """Binary search for the least capacity whose greedy sweep needs at most n runs (cells indivisible)."""
    line = _Line(cells)
    lo, hi = max(line.largest, -(-line.prefix[-1] // n)), line.prefix[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        if line.ends(mid, n) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _touched(cells: list[Cell], low: int, high: int, n: int) -> list[int]:
    """Cells that a cut can fall into for some capacity from low to high."""
    line = _Line(cells)
    found: set[int] = set()
    # p is the least and q the greatest place (in bytes) that the i-th cut can have.
    p = q = 0
    for _ in range(n):
        a = max(0, bisect_right(line.prefix, p + low) - 1)
        if a >= len(cells):
            break
        # A run ends inside cell a at the earliest: short of p + low by less than the cell's largest group.
        p = max(line.prefix[a], p + low - cells[a].largest + 1)
        q = min(line.prefix[-1], q + high)
        b = min(len(cells) - 1, bisect_right(line.prefix, q) - 1)
        found.update(range(a, b + 1))
    return [i for i in sorted(found) if cells[i].groups > 1]


def _cells(groups: DataFrame, of: list[Cell], bits: int) -> list[Cell]:
    """The non-empty parts of the given cells, each split to ``bits`` bits of the key in all.

    Sends at most len(of) * 2 ** split_bits sums to the driver."""
    shift = KEY_BITS - bits
    own = F.shiftright("key", shift)
    if len(of) > 1 or of[0].bits:
        within = groups.sparkSession.createDataFrame([(c.lo >> (KEY_BITS - c.bits),) for c in of], "parent long")
        groups = groups.join(F.broadcast(within), F.shiftright("key", KEY_BITS - of[0].bits) == F.col("parent"), "left_semi")
    rows = groups.groupBy(own.alias("own")).agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count("*").alias("groups")).collect()
    return sorted((Cell(r.own << shift, bits, r["size"], r.largest, r.groups) for r in rows), key=lambda c: c.lo)


def cut_keys(groups: DataFrame, params: ShardParams = ShardParams()) -> tuple[int, list[int]]:
    """(the least capacity, the first key of each shard) of a table of (key, size), one row per group, keys distinct."""
    n = params.n_shards
    cells = _cells(groups, [Cell(0, 0, 0, 0, 2)], params.first_bits)
    if not cells:
        return 0, [0]
    while True:
        upper = smallest_capacity(cells, n)
        lower = min(upper, max(max(c.largest for c in cells), -(-sum(c.size for c in cells) // n)))
        touched = _touched(cells, lower, upper, n)
        if not touched:
            break
        # the coarsest first, so that one pass has one depth
        least = min(cells[i].bits for i in touched)
        of = [cells[i] for i in touched if cells[i].bits == least]
        new = _cells(groups, of, min(KEY_BITS, least + params.split_bits))
        gone = {c.lo for c in of}
        cells = sorted([c for c in cells if not (c.bits == least and c.lo in gone)] + new, key=lambda c: c.lo)
    ends = _Line(cells).even_ends(upper, n)
    return upper, [cells[i].lo for i in [0, *ends[:-1]]]


def shard(docs: DataFrame, params: ShardParams = ShardParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, key, shard, slot. See the module's docstring."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = cut(docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size")))
    _, starts = cut_keys(groups, params)
    shard_of = sum((F.col("key") >= s).cast("int") for s in starts[1:]) if len(starts) > 1 else F.lit(0)
    bins = max(16, -(-rows.count() // (params.n_shards * params.bin_rows)))
    # by the key too, so that rows that share an id or lack one are dealt out as well
    placed = rows.withColumn("shard", shard_of.cast("int")).withColumn("bin", F.pmod(F.xxhash64(id_col, "key"), F.lit(bins)))
    counts = placed.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bin", before.alias("before"))
    in_bin = F.row_number().over(Window.partitionBy("shard", "bin").orderBy(F.col(id_col), "key")) - 1
    numbered = placed.withColumn("in_bin", in_bin).join(offsets, ["shard", "bin"])
    return numbered.select(F.col(id_col), "size", "text_crc32", "key", "shard", (F.col("in_bin") + F.col("before")).cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
