"""How far the sources of a language differ in their words: a plain relational audit.

The letters' runs of every text are exploded and counted by (lang, source, term).
A language keeps the terms that enough of its documents have; the groups are
crossed with the kept terms, so that a term that a source lacks counts as zero,
and every count becomes a smoothed share in whole parts of ``scale``::

    p = 1 + floor(scale * (count + prior) / (N + prior * V))

A self-join on (lang, term) sums |p - q| over each two sources of a language; the
terms that a source has more often than its language are ranked within it.

Groups and terms are dealt out by salt, never by language alone: one language may
have a third of all rows.  The marker term '' (which no match can be) gives every
two sources a row, also in a language without kept terms.  All arithmetic is in
whole numbers, products in decimals, so results do not depend on the order of sums.

Defined results: null text, lang and source count as ''; every row is a document,
also one that is repeated or has a null id; of equal values the lesser item in
UTF-8 order comes first; a source alone in its language has no pairs; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, partitions, table

#: What stands between terms: all ASCII but A-Z and a-z. A term is a match of what lies between two matches of this, so texts are
#: split here: ten times faster than Spark's extraction of all matches of the complement, with the same runs.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The term that stands for none: every group has it, with a share of 0.
_NONE = ""


@dataclass(frozen=True)
class AuditParams:
    #: Documents of a language that must have a term.
    least_docs: int = 30
    prior: int = 5
    scale: int = 1_000_000_000
    #: Terms reported for a group.
    top_terms: int = 50


def _count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, n_docs documents)."""
    text = F.col("text")
    # of ASCII alone, lower() changes A-Z only, and does so faster
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))
    rows = docs.select(F.struct("lang", "source").alias("group"), F.array_remove(F.split(low, BETWEEN), "").alias("terms"))
    # one pass: all occurrences, then each distinct term once more, for the document
    each = rows.select("group", F.size("terms").alias("all"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    n, n_docs = F.count_if(F.col("at") < F.col("all")), F.count_if(F.col("at") >= F.col("all"))
    return each.groupBy("group", "term").agg(n.alias("n"), n_docs.alias("n_docs")).select("group.*", "term", "n", "n_docs")


def _share(count: Column, total: Column, terms: Column, params: AuditParams) -> Column:
    """The smoothed share in whole parts of ``scale``; the product does not fit 64 bits, so it is a decimal."""
    top = (count + params.prior).cast("decimal(20,0)") * F.lit(params.scale).cast("decimal(10,0)")
    below = (total + params.prior * terms).cast("decimal(20,0)")
    return F.call_function("div", top, below) + 1


def dense_shares(docs: DataFrame, params: AuditParams = AuditParams()) -> DataFrame:
    """(lang, source, term, n, p, q): every group with every kept term of its language, and with the marker ''."""
    known = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    by_term = Window.partitionBy("lang", "term")
    counts = _count_terms(known).withColumns({"lang_n": F.sum("n").over(by_term), "lang_docs": F.sum("n_docs").over(by_term)})
    kept = cut(counts.where(F.col("lang_docs") >= params.least_docs).select("lang", "source", "term", "n", "lang_n"))
    vocabulary = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = known.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(groups.na.fill(0, ["total", "terms", "lang_total"]))
    marked = vocabulary.unionByName(groups.select("lang", F.lit(_NONE).alias("term"), F.lit(0).cast("long").alias("lang_n")).distinct())
    # groups meet terms on (lang, salt): a language's terms are in as many tasks as there are
    salts = partitions(docs.sparkSession)
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dense = spread.join(salted, ["lang", "salt"]).join(kept.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    real = F.col("term") != _NONE
    p = F.when(real, _share(n, F.col("total"), F.col("terms"), params)).otherwise(0)
    q = F.when(real, _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), params)).otherwise(0)
    return dense.select("lang", "source", "term", n.alias("n"), p.alias("p"), q.alias("q"))


def audit(docs: DataFrame, params: AuditParams = AuditParams()) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each other source is ('pair'), and each group's own terms ('term')."""
    dense = cut(dense_shares(docs, params))
    a = dense.select("lang", "term", "source", "p")
    b = dense.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("r"))
    # each two sources meet once; the distance is the same from either side
    apart = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("other")).groupBy("lang", "source", "other").agg(F.sum(F.abs(F.col("p") - F.col("r"))).alias("value"))
    sides = apart.select("lang", "value", F.inline(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = sides.withColumn("rank", F.row_number().over(order))
    above = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.top_terms)
    named = [df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for part, df in (("pair", pairs), ("term", terms))]
    return named[0].unionByName(named[1])


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""WITH docs AS (SELECT row_number() OVER () AS row_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  occ AS (SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
  vocab AS (SELECT lang, term, count(*) AS lang_n FROM occ GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
  v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM vocab GROUP BY lang),
  groups AS (SELECT DISTINCT lang, source FROM docs),
  c AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN vocab USING (lang, term) GROUP BY lang, source, term),
  totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
  dense AS (SELECT g.lang, g.source, w.term, coalesce(c.n, 0) AS n,
      1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (w.lang_n + 5)) // (v.lang_total + 5 * v.v) AS q
    FROM groups g JOIN vocab w ON w.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = w.term),
  apart AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
  pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(a.value, 0) AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN apart a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
  parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
  SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
