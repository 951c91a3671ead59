"""Connected components of an edge list, by alternating star contraction.

Each round re-hangs every vertex on the least vertex it can see: first the
larger neighbours of a vertex (large star), then the smaller ones (small star).
Only minima are gathered, so no task ever holds the neighbours of a vertex;
rounds are about log2 of the longest chain.  Each round is cut from its lineage
through the shared checkpoint folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import ranked


def _stars(edges: DataFrame) -> DataFrame:
    """edges (a, b): each a re-hung on the least vertex among itself and its b's; both a's and b's point there."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.join(least, "a")


def _round(edges: DataFrame) -> DataFrame:
    """One large and one small star over edges (a > b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _stars(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    hung = _stars(large)
    small = hung.select("a", F.col("m").alias("b")).unionByName(hung.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")))
    return small.where(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Order-free digest of an edge set."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex of an undirected edge list; component is the least id reachable.

    Duplicate and reversed edges do no harm; a self-edge (x, x) makes x a vertex; edges with a null end are ignored."""
    known = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    known = cut_lineage(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops = known.where(F.col("a") == F.col("b")).select(F.col("a").alias("id"))
    links, state = known.where(F.col("a") != F.col("b")), None
    while (now := _state(links)) != state:
        if not now[0]:
            break
        links, state = cut_lineage(_round(links)), now
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component"))
    alone = loops.select("id", F.col("id").alias("component"))
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots).unionByName(alone).groupBy("id").agg(F.min("component").alias("component"))


def cluster_edges(edges: DataFrame, *, a: str = "a", b: str = "b", order: list[str]) -> DataFrame:
    """(component_id, id, position): components with ids in order of first appearance.

    ``order`` columns give the edges their order; within an edge ``a`` comes before ``b``. An id's position is the
    least (order..., side) over its edges; component_id is the id of the component's least position."""
    # both the positions and the components are made of the edges, which may have cost much
    edges = cut_lineage(edges.select(*dict.fromkeys([a, b, *order])))
    ends = [edges.select(F.col(end).alias("id"), F.struct(*order, F.lit(side).alias("side")).alias("at")) for side, end in enumerate((a, b))]
    first = ends[0].unionByName(ends[1]).groupBy("id").agg(F.min("at").alias("position"))
    members = connected_components(edges, a, b).join(first, "id")
    heads = members.groupBy("component").agg(F.min_by("id", "position").alias("component_id"))
    return members.join(heads, "component").select("component_id", "id", "position")


#: Ids in a list; a longer component has several.
_SEGMENT = 1_000_000


def component_places(members: DataFrame) -> DataFrame:
    """(group_no, place, id): components numbered in order of first appearance, and their ids in order.

    All members are ranked by (their component's first position, own position) over all tasks; the place is the distance from
    the component's first rank. No task has to hold a component, or one row for each of all components."""
    heads = ranked(members.groupBy("component_id").agg(F.min("position").alias("head")), ["head"], "group_no")
    placed = ranked(members.join(heads, "component_id"), ["head", "position"])
    first = placed.groupBy("group_no").agg(F.min("rank").alias("first"))
    return placed.join(first, "group_no").select("group_no", (F.col("rank") - F.col("first")).alias("place"), "id")


def component_lists(members: DataFrame, segment: int = _SEGMENT) -> DataFrame:
    """(group_no, segment_no, ids): ordered lists, numbered in order of first appearance; a list has at most ``segment`` ids, the next ones follow in the next segment."""
    places = component_places(members)
    lists = places.groupBy(F.col("group_no").cast("int").alias("group_no"), F.floor(F.col("place") / segment).cast("int").alias("segment_no"))
    return lists.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
