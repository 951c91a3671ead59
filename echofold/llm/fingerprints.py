"""Document fingerprints: threshold-scaled sketches, with Spark expressions only.

A document's shingles are runs of ``width`` words (A-Z lower-cased, split at
white space); fewer words are one shingle.  The sketch keeps *every* distinct
shingle hash below a fixed fraction of the hash range, so its size follows the
document's, sketches of parts merge by union, and the containment of a short
document in a long one is estimated without bias.  A document with shingles but
no hash below the threshold keeps its smallest hash instead, so that it has a
fingerprint; on merging, that one goes if the other sketch has hashes below the
threshold, and it takes no part in a comparison.

A text of n shingles has no hash below the fraction with a chance of (1 - fraction)^n:
half of all hashes are kept, so that texts of some words have several.

Hashes are XXH64 of the words' XXH64 hashes, cut to 48 bits.  The fingerprint
string is the sorted hashes, 12 hex digits each.

Defined results: null texts count as empty; an empty document has an empty
sketch, which is like (1.0) another empty one and unlike (0.0) all others; where
sketches alone cannot tell, containment is null; other columns do not matter,
whatever their names.  For ``with_next``: null ids count as the least id; equal
ids are ordered by a hash of the value, and their rows meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, table

HASH_BITS = 48
#: with_next: ids that share all but the last so many bits meet in one task.
_GROUP_BITS = 6


@dataclass(frozen=True)
class SketchParams:
    width: int = 5
    fraction: float = 0.5


def _words(text: Column) -> Column:
    trimmed = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, SPACE))


def _unused(df: DataFrame, name: str) -> str:
    """A name that begins no column's."""
    while any(c.startswith(name) for c in df.columns):
        name += "_"
    return name


def add_sketches(df: DataFrame, of: dict[str, str], params: SketchParams = SketchParams()) -> DataFrame:
    """df with a sketch (array<long>, ascending) for each {text column: new column}.

    Each step is a projection of its own, as a lambda evaluates what it closes over for every element."""
    w, own = params.width, _unused(df, "__h")
    tmp = {t: f"{own}_{i}" for i, t in enumerate(of)}
    df = df.withColumns({h: F.transform(_words(F.col(t)), lambda x: F.xxhash64(x)) for t, h in tmp.items()})

    def shingles(h: str) -> Column:
        hashed = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(h) - w, F.lit(0))),
            lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + k) for k in range(w))), 64 - HASH_BITS),
        )
        return F.when(F.size(h) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(hashed)

    df = df.withColumns({h: shingles(h) for h in tmp.values()})
    kept = {of[t]: F.sort_array(F.array_distinct(F.filter(h, lambda x: x < _below(params)))) for t, h in tmp.items()}
    df = df.withColumns(kept)
    least = {of[t]: F.when((F.size(of[t]) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(F.col(of[t])) for t, h in tmp.items()}
    return df.withColumns(least).drop(*tmp.values())


def _below(params: SketchParams) -> int:
    return int(params.fraction * 2**HASH_BITS)


def merge(a: Column, b: Column, params: SketchParams = SketchParams()) -> Column:
    """The sketch of the union of two documents' shingles."""
    both = F.sort_array(F.array_union(a, b))
    low = F.filter(both, lambda x: x < _below(params))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def fingerprint(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), HASH_BITS // 4, "0"))), "")


def containment(a: Column, b: Column, params: SketchParams = SketchParams()) -> Column:
    """Estimated share of the smaller document's shingles that the other has; null where a sketch has no hash below the threshold and cannot tell."""
    none = (F.size(a) == 0) | (F.size(b) == 0)
    empty = F.when(none, F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))
    # a sketch's only hash above the threshold stands for none
    low = lambda x: F.when(F.get(x, F.lit(0)) < _below(params), F.size(x)).otherwise(0)
    least = F.least(low(a), low(b))
    return F.coalesce(empty, F.when(a == b, 1.0).when(least > 0, F.size(F.array_intersect(a, b)) / least))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def with_next(df: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """df with the value of the row that follows in ascending key; after the last, that of the first.

    Ids that share all but their last bits form a group, and ``lead`` runs within groups. The last row of a group takes the
    first value of the next group that has rows. Which group that is, the same method finds among the groups' numbers, level
    by level: values take no part in it, and never more than 64 distinct numbers meet in one task."""
    low, high = (x or 0 for x in df.agg(F.min(key), F.max(key)).first())
    own = F.coalesce(F.col(key).cast("long"), F.lit(low))
    # with the sign bit turned over, the unsigned order is the ids' order and shifts of any two ids meet
    group = F.shiftrightunsigned(own.bitwiseXOR(F.lit(-(2**63))), _GROUP_BITS)
    rows = df.select(F.struct("*").alias("row"), own.alias("k"), group.alias("g"), F.struct(F.col(value).alias("v")).alias("v"))
    w = Window.partitionBy("g").orderBy("k", F.xxhash64("v"))
    rows = rows.withColumns({"next": F.lead("v").over(w), "n": F.row_number().over(w)})
    bounds = [(x + 2**63) >> _GROUP_BITS for x in (low, high)]
    firsts = rows.where(F.col("n") == 1).select("g", "v")
    to = _following(firsts.select("g"), *bounds).withColumnRenamed("g", "of")
    above = firsts.join(to, F.col("g") == F.col("to")).select(F.col("of").alias("g"), F.col("v").alias("up"))
    return rows.join(above, "g").select("row.*", F.coalesce("next", "up")["v"].alias(into))


def _following(groups: DataFrame, low: int, high: int) -> DataFrame:
    """(g, to): the number that follows each of distinct numbers between low and high; after the last, the first."""
    rows = groups.select("g", F.shiftrightunsigned("g", _GROUP_BITS).alias("upper"))
    w = Window.partitionBy("upper").orderBy("g")
    rows = rows.withColumns({"to": F.lead("g").over(w), "n": F.row_number().over(w)})
    if low >> _GROUP_BITS == high >> _GROUP_BITS:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return rows.select("g", F.coalesce("to", F.first("g").over(whole)).alias("to"))
    firsts = rows.where(F.col("n") == 1).select(F.col("upper").alias("above"), F.col("g").alias("first"))
    up = _following(firsts.select(F.col("above").alias("g")), low >> _GROUP_BITS, high >> _GROUP_BITS).select(F.col("g").alias("upper"), F.col("to").alias("above"))
    return rows.join(up.join(firsts, "above").select("upper", "first"), "upper").select("g", F.coalesce("to", "first").alias("to"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text; likeness from the fingerprints alone, 0 where they cannot tell."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(docs, "doc_id", "text", "next").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next", F.lit(1), half))
    sketched = add_sketches(paired.withColumn("edited", edited), {"text": "a", "edited": "b", "next": "c"})
    near = lambda x: F.coalesce(containment(F.col("a"), F.col(x)), F.lit(0.0))
    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("a")).alias("fingerprint"),
        fingerprint(F.col("b")).alias("edited_fingerprint"),
        near("b").alias("near_edited"),
        near("c").alias("near_next"),
    )
