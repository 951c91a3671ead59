"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words, not bytes: texts are lower-cased (A-Z) and cut into runs
of digits, letters and non-ASCII characters.  The patterns are all windows of
``window`` consecutive words of a benchmark item; an item of fewer words, but
not none, is one window.  A word of a document that lies inside any occurrence
of a window is *hit*.

Patterns of one length share a table.  For blocks of two words (one word, for
patterns of one) the shift table says how far the search may advance without
passing the end of an occurrence; an unknown block allows the longest shift.
Where the shift is 0 the block ends a pattern: the bucket of its hash is looked
up, and the words of the text are compared directly with each pattern in it.

The patterns are sent to every task, so their size is bounded: items, each once
and long ones in overlapping parts, are dealt into sets of about ``max_words``
words, one pass over the documents for each set.  A set's tables take some 800
bytes a word and are built once in a worker.  Usually one set holds all items.
With more, the passes give the hit spans of the documents that have any, and
spans are united per document.

Defined results: null and empty texts have no words and no hits; items with no
words match nothing; repeated items and ids count once in ``items``; repeated
document rows each get a result; an empty benchmark hits nothing; other columns
of the input do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean, table, text_of

#: Bytes of words, lower-cased, other ASCII to spaces: UTF-8 sequences stay whole.
WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


@dataclass(frozen=True)
class DecontaminateParams:
    window: int = 10
    #: Words of benchmark items that one pass takes to the executors.
    max_words: int = 250_000
    #: Words of an item that stay together; longer items fall into parts that overlap by a window less one word.
    item_words: int = 20_000


@dataclass
class _Table:
    """Wu-Manber tables of the patterns of one length."""

    length: int
    block: int
    shift: dict = field(default_factory=dict)
    #: Last block of a pattern -> its patterns, each with the items that have it.
    bucket: dict = field(default_factory=dict)

    def add(self, pattern: tuple[bytes, ...], item) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = pattern[end - b : end]
            self.shift[key] = min(self.shift.get(key, m - b + 1), m - end)
        self.bucket.setdefault(pattern[m - b :], {}).setdefault(pattern, set()).add(item)


class WuManber:
    def __init__(self, items: Iterable[tuple[object, str | None]], window: int = 10):
        self.tables: dict[int, _Table] = {}
        for item, text in items:
            w = tuple(words(text))
            m = min(window, len(w))
            if not m:
                continue
            t = self.tables.setdefault(m, _Table(m, min(2, m)))
            for i in range(len(w) - m + 1):
                t.add(w[i : i + m], item)

    def occurrences(self, text: list[bytes]) -> Iterator[tuple[int, int, set]]:
        """(first word, words, items) of every occurrence."""
        n = len(text)
        for m, t in self.tables.items():
            if m > n:
                continue
            shift, bucket = t.shift, t.bucket
            if t.block == 1:
                for i, w in enumerate(text):
                    if (w,) in bucket:
                        yield i, 1, bucket[(w,)][(w,)]
                continue
            far, end = m - 1, m - 1
            while end < n:
                key = (text[end - 1], text[end])
                s = shift.get(key, far)
                if s:
                    end += s
                    continue
                found = bucket[key].get(tuple(text[end - m + 1 : end + 1]))
                if found:
                    yield end - m + 1, m, found
                end += 1

    def spans(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The hit words as disjoint ascending (start, end), and the items that occur."""
        at: list[tuple[int, int]] = []
        items: set = set()
        for i, m, found in self.occurrences(text):
            at.append((i, i + m))
            items |= found
        out: list[tuple[int, int]] = []
        for a, b in sorted(at):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out, items


class _Sent:
    """Items as they are sent; the search over them is built once in a worker."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.items, self.window = items, window

    @cached_property
    def search(self) -> WuManber:
        return WuManber(self.items, self.window)


def _sets(benchmark: DataFrame, params: DecontaminateParams, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The items in sets of bounded size; one set at a time is on the driver."""
    most, overlap = max(params.item_words, 2 * params.window), params.window - 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = words(t)
                own = [w] if len(w) <= most else [w[k : k + most] for k in range(0, len(w) - overlap, most - overlap)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own)), pa.array([b" ".join(x).decode("utf-8", "surrogatepass") for x in own]), pa.array([len(x) for x in own], pa.int64())], names=["id", "text", "n"])

    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    items = cut(rows.mapInArrow(parts, "id string, text string, n long").where("n > 0").distinct())
    n = max(1, -(-int(items.agg(F.sum("n")).first()[0] or 0) // params.max_words))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r.id, r.text) for r in part.select("id", "text").collect()]


_MATCH = "n_words long, spans array<struct<s:int,e:int>>, items array<string>"


def _match(docs: DataFrame, items: list[tuple[str, str]], params: DecontaminateParams, text_col: str, only_hits: bool) -> DataFrame:
    """All columns of docs but the text, with the match of each row; a row may be one struct with its text inside."""
    sent = docs.sparkSession.sparkContext.broadcast(_Sent(items, params.window))
    rest = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*rest, *T.StructType.fromDDL(_MATCH).fields])
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value.search
        for b in lean(batches):
            n, spans, found = [], [], []
            for t in text_of(b, text_col).to_pylist():
                w = words(t)
                s, f = search.spans(w)
                n.append(len(w))
                spans.append([{"s": x, "e": y} for x, y in s])
                found.append(sorted(f))
            cols = [b.column(f.name) for f in rest] + [pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(found, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(cols, names=[f.name for f in rest] + ["n_words", "spans", "items"])
            yield out.filter(pc.greater(pc.list_value_length(out.column("items")), 0)) if only_hits else out

    return docs.mapInArrow(run, schema)


def _united(spans):
    """Disjoint ascending union of an array of spans, by a fold over the sorted starts."""
    last = lambda acc: F.element_at(acc, -1)

    def step(acc, x):
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= F.get(acc, F.size(acc) - 1)["e"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<struct<s:int,e:int>>)"), step)


def find_contamination(docs: DataFrame, benchmark: DataFrame, params: DecontaminateParams = DecontaminateParams(), *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """A row per document: id, n_words, n_hit, spans (of word numbers, end exclusive), items (ids as strings, sorted), contaminated."""
    sets = _sets(benchmark, params, item_col, text_col)
    rows = docs.select(F.col(id_col), F.col(text_col))
    first, second = next(sets), next(sets, None)
    if second is None:
        out = _match(rows, first, params, text_col, only_hits=False)
    else:
        # rows that share an id and a text have the same hits, so (id, text digest) may stand for a row
        keyed = rows.select(id_col, text_col, F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_digest"))
        hits = None
        for items in (first, second, *sets):
            more = _match(keyed, items, params, text_col, only_hits=True).drop("n_words")
            hits = more if hits is None else hits.unionByName(more)
        by = [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col("_digest")]
        hits = hits.groupBy(*by).agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        counted = _match(keyed, [], params, text_col, only_hits=False).drop("spans", "items").withColumn("_id", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
        out = counted.join(hits, ["_id", "_digest"], "left").select(
            id_col, "n_words", _united(F.coalesce("spans", F.expr("cast(array() as array<struct<s:int,e:int>>)"))).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return out.select(id_col, "n_words", n_hit.alias("n_hit"), "spans", "items", (F.size("items") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: DecontaminateParams = DecontaminateParams(), *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents without any occurrence, all columns as they are: a pass over them for each set of patterns."""
    kept = docs
    for items in _sets(benchmark, params, item_col, text_col):
        # the row travels as one column, whatever its columns are called
        rows = kept.select(F.struct("*").alias("row"))
        kept = _match(rows, items, params, text_col, only_hits=False).where(F.size("items") == 0).select("row.*")
    return kept


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")


def expected(items: list[str]) -> str:
    """The digest of a set of item ids, as the query gives it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pats AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, list_slice(w, i, i + least(10, len(w)) - 1) AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM pats),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), wins AS (
  SELECT doc_id, m, i, list_slice(w, i, i + m - 1) AS p FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)
), occ AS (SELECT doc_id, i, wins.m, item_id FROM wins JOIN pats ON wins.m = pats.m AND wins.p = pats.p),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
