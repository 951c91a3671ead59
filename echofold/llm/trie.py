"""A prefix trie of conversations, merged family by family.

Conversation c starts with turns of its family's base, c - c % 5 (the remainder
has the sign of c, as in SQL): the first h of them, h = crc32(decimal c) % 9, and
goes on with its own turns after its first h.

1. Conversations are cogrouped by base id: a family's rows meet in one sorted
   stream, the base's first.  Of a turn only a digest and the size of its text
   come that far.  The task keeps the base's first eight turns and a bounded table
   of nodes, rebuilds each conversation turn by turn and emits the family's trie: a
   row for each node, with the members (a family has nine at most) that pass it.
2. Only these rows are shuffled: nodes of one prefix, named by a digest of all its
   turns, merge by sums and minima, combined before the shuffle.
3. What a node needs from its whole subtree is no walk down levels.  A node belongs
   to its least member, so a conversation owns the end of its own path, from the
   depth where it leaves the path of lesser ones.  A node's distinct bytes are those
   of its owner's path below it and those that its other members own, its leaves
   those that its members own: sums over members, by one more merge, whatever the depth.

The hash of all members that end at a node is taken over chunks of their ids in
order, streamed through one hasher: no list of members is ever in memory.

Defined results: null roles and texts count as empty; null turns come first, equal
turns in order of role and text; repeated rows stay; rows without a conversation id
belong to none and are left out; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

FAMILY, HEADS = 5, 9
#: Nodes of a family that are merged before they are passed on.
_HELD = 50_000
_ROOT = bytes(16)
#: Ids in a chunk of 2^13: conversation ids are distinct, so a chunk has no more.
_CHUNK_BITS = 13
_NODES = "node binary, parent binary, depth int, before long, size long, members array<long>, ends array<long>"
_ARROW = pa.schema(
    [("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("before", pa.int64()), ("size", pa.int64()), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
)


def _heads(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


class _Family:
    """The trie of one family, node by node; ``out`` has the rows that are ready."""

    def __init__(self) -> None:
        self.heads: list[tuple[bytes, int]] = []
        self.nodes: dict[bytes, list] = {}
        self.conv: int | None = None

    def begin(self, conv_id: int, base: int) -> None:
        self.conv, self.is_base = conv_id, conv_id == base
        self.at = [_ROOT, None, 0, 0, 0]  # node, parent, depth, bytes before it, its bytes
        self.skip = 0 if self.is_base else _heads(conv_id)
        self._visit("members")
        for turn in self.heads[: self.skip]:
            self._step(*turn)

    def turn(self, digest: bytes, size: int) -> None:
        if self.is_base and len(self.heads) < HEADS - 1:
            self.heads.append((digest, size))
        if self.skip:
            self.skip -= 1
        else:
            self._step(digest, size)

    def end(self) -> None:
        self._visit("ends")

    def _step(self, digest: bytes, size: int) -> None:
        node, _, depth, before, own = self.at
        self.at = [hashlib.blake2b(node + digest, digest_size=16).digest(), node, depth + 1, before + own, size]
        self._visit("members")

    def _visit(self, what: str) -> None:
        node = self.nodes.setdefault(self.at[0], [*self.at, [], []])
        node[5 if what == "members" else 6].append(self.conv)

    def take(self) -> pa.RecordBatch:
        rows, self.nodes = list(self.nodes.values()), {}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


def _family_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one family from its turns in order: the base's, then conversation by conversation."""
    family, done = _Family(), set()
    for batch in batches:
        for base, conv_id, digest, size in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "digest", "size")), strict=True):
            if conv_id != family.conv:
                if family.conv is not None:
                    family.end()
                if conv_id in done or (conv_id == base and done):
                    raise ValueError("a family's turns came out of order")
                done.add(conv_id)
                family.begin(conv_id, base)
            family.turn(digest, size)
            if len(family.nodes) > _HELD:
                yield family.take()
    if family.conv is not None:
        family.end()
        yield family.take()


def family_nodes(turns: DataFrame) -> DataFrame:
    """(node, parent, depth, before, size, members, ends) of every family's own trie."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    known = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    known = known.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    ordered = known.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "text")
    # the size of the role tells where it ends
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    light = ordered.select("base", "conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("size"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _family_nodes(batches)

    return light.groupBy("base").applyInArrow(build, _NODES)


def _parents(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """(node, parent_conv_id) of the nodes whose parent another conversation owns: where a path leaves a lesser one's.

    Parents with a thousandth of all nodes as children are a thousand at most, and are broadcast; the others meet by shuffle."""
    first = nodes.groupBy(F.col("conv_id").alias("owner")).agg(F.min_by(F.struct("node", "parent"), "depth").alias("first")).select("first.*").where(F.col("parent").isNotNull())
    least = max(1, nodes.count() // 1000)
    owned = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    crowded = cut(children.where(F.col("n_children") > least).select("parent").join(owned, "parent"))
    quick = first.join(F.broadcast(crowded), "parent", "left")
    rest = quick.where(F.col("parent_conv_id").isNull()).drop("parent_conv_id").join(owned, "parent")
    return quick.where(F.col("parent_conv_id").isNotNull()).select("node", "parent_conv_id").unionByName(rest.select("node", "parent_conv_id"))


def _ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end."""
    chunks = ends.groupBy("node", F.shiftright("conv_id", _CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = cut(chunks.select("node", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))
    many = chunks.groupBy("node").agg(F.count("*").alias("n"))
    single = chunks.join(many.where("n = 1"), "node").select("node", F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hasher, out = None, None, []
        for batch in batches:
            for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own == node:
                    hasher.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((node, hasher.hexdigest()))
                node, hasher = own, hashlib.sha256(ids.encode())
        if node is not None:
            out.append((node, hasher.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["node", "ends_sha256"])

    long = chunks.join(many.where("n > 1").select("node"), "node").repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids")
    return single.unionByName(long.mapInArrow(run, "node binary, ends_sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row per node: (node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    family = cut(family_nodes(turns))
    merged = family.groupBy("node").agg(
        F.min(F.array_min("members")).alias("conv_id"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("before").alias("before"), F.first("size").alias("size"),
        F.sum(F.size("members")).cast("long").alias("n_convs"),
    )
    nodes = cut(merged)
    children = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("n_children"))
    counted = cut(nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").na.fill(0, ["n_children"]))
    ends = family.select("node", (F.col("before") + F.col("size")).alias("total"), F.explode("ends").alias("conv_id"))
    # of a conversation: its bytes, those of the nodes that it owns, and whether it owns the leaf at its end
    owners = counted.groupBy("conv_id").agg(F.min("before").alias("begins"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    convs = ends.select("conv_id", "total").join(owners, "conv_id", "left")
    convs = cut(convs.select("conv_id", "total", F.coalesce(F.col("total") - F.col("begins"), F.lit(0)).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    passing = family.select("node", F.explode("members").alias("conv_id")).join(convs, "conv_id")
    sums = passing.groupBy("node").agg(F.sum("total").alias("totals"), F.sum("own").alias("owns"), F.sum("leaf").alias("n_leaves"), F.min_by(F.struct("total", "own"), "conv_id").alias("owner"))
    distinct = F.col("owner.total") - F.col("before") - F.col("owner.own") + F.col("owns")
    saved = F.col("totals") - F.col("n_convs") * F.col("before") - distinct
    full = counted.join(sums, "node").join(_parents(nodes, children), "node", "left").join(_ends(ends.select("node", "conv_id")), "node", "left")
    parent = F.when(F.col("parent").isNotNull(), F.coalesce("parent_conv_id", "conv_id"))
    return full.select(
        "node", "conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("node")


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda k: ascii(k)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda s, _k: xor(s >> 1, (s & 1) * 3988292384))))"
ORACLE = f"""WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
  convs AS (SELECT c, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM own)),
  rebuilt AS (SELECT v.c, o.k AS k, 0 AS side, o.role, o.text FROM convs v JOIN own o ON o.c = v.c - v.c % 5 AND o.k <= v.h UNION ALL SELECT v.c, o.k, 1, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.k > v.h),
  placed AS (SELECT c, row_number() OVER w AS d, encode(text) AS bytes, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER w AS prefix FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY side, k)),
  path AS (SELECT c, d, sha256(prefix) AS node, octet_length(bytes) AS size FROM placed UNION ALL SELECT c, 0, '', 0 FROM convs),
  up AS (SELECT x.*, y.node AS parent FROM path x LEFT JOIN path y ON y.c = x.c AND y.d = x.d - 1),
  nodes AS (SELECT node, min(c) AS conv_id, any_value(d) AS depth, any_value(parent) AS parent, any_value(size) AS size, count(*) AS n_convs FROM up GROUP BY node),
  kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
  below AS (SELECT p.node AS top, n.node, n.size, n.n_convs, coalesce(kids.n, 0) AS n FROM nodes n JOIN path p ON p.c = n.conv_id AND p.d <= n.depth LEFT JOIN kids ON kids.node = n.node),
  sums AS (SELECT top AS node, sum((n_convs - 1) * size) AS saved, count(*) FILTER (n = 0) AS leaves FROM below GROUP BY top),
  last AS (SELECT c, arg_max(node, d) AS node FROM path GROUP BY c),
  done AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM last GROUP BY node)
  SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(coalesce(done.ids, '')) AS ends_sha256
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent LEFT JOIN kids ON kids.node = n.node JOIN sums ON sums.node = n.node LEFT JOIN done ON done.node = n.node"""
