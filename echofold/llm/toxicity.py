"""Toxicity from the nearest labelled examples, by exact cosine of weighted TF-IDF vectors.

Examples are a bounded sample of labelled training documents, those with the
least hash of their id.  Terms are words (runs of letters, digits and non-ASCII
characters, A-Z lower-cased) and their first characters, as the stems of
inflected words.  Every term of the examples is in the vocabulary, as its 64-bit
hash; words that no example has are in no vector.  Document frequencies are
counted over all documents.  A term's TF-IDF weight is multiplied by
sqrt(1 + g), g being the log-likelihood ratio by which it is more frequent in
toxic examples than in others, or 0: likeness in such terms counts for more.

The examples' vectors are kept in an inverted index by blocks of examples.  A
query adds up the postings of the rarer terms.  The long postings of the
commonest are held by block with the largest weight of every term; a block is
left out where the bound that this gives does not reach the k-th best similarity
so far: the k similarities are exact.  They are told apart to a millionth, and
of equals the least id comes first.

The neighbours vote, each by its closeness; votes become probabilities by a
logistic curve.  It is fitted to the examples' own votes, each without itself,
and with factors that the other half of the examples gave: no label takes part
both in the choice of a vote's factors and in the curve.

Defined results: null and empty texts, and those without a term of the examples,
have no vector and take the share of toxic examples; without any labelled
example every score is 0; of several labels of an id the highest holds, of
several texts the least; null labels and ids are no examples; repeated rows each
get a result; ids may be of any type; other columns do not matter, whatever
their names; a very long text is read in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Lookup, crc_mod, cut, give_back, lean, powers, runs, table, text_of
from .decontaminate import WORDS


@dataclass(frozen=True)
class ToxicityParams:
    fold_mod: int = 5
    #: Bound of the labelled sample.
    examples: int = 6000
    stems: tuple[int, ...] = (4, 6)
    k: int = 5
    block: int = 256
    #: Commonest terms whose postings are held by block. They bear on time, not on results.
    dense: int = 1024
    #: Added to a neighbour's distance before its inverse is its vote.
    near: float = 0.05


#: Texts, and queries, that are worked on at once.
_ROWS, _QUERIES = 256, 32
#: Terms whose factors are worked out at once; tasks that work out the examples' own votes, for each half of them.
_TERMS, _SLICES = 1 << 16, 6
#: Similarities are kept as millionths, beside an example's place among the ids.
_UNIT, _PLACE = 1e6, 20
_MIX = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0x94D049BB133111EB)]


@dataclass
class Vectors:
    """Sparse rows: (row, term, weight), ascending by row and term."""

    n: int
    row: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    def rows(self, first: int, end: int) -> Vectors:
        # of the rows' own type, which is else widened whole
        a, b = np.searchsorted(self.row, np.array((first, end), self.row.dtype))
        return Vectors(end - first, self.row[a:b] - first, self.term[a:b], self.weight[a:b])


def term_hashes(words: pa.BinaryArray, stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """([word, 1 + stem] hashes of each word and of its first characters, which of them there are)."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    first, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    up, back = powers(1 << len(data).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(chars, first)
    n = np.searchsorted(chars, end) - at
    chars = np.r_[chars, len(data)]
    out, some = np.empty((len(first), 1 + len(stems)), np.uint64), np.ones((len(first), 1 + len(stems)), bool)
    for j, length in enumerate((0, *stems)):
        stop = np.where(n > length, chars[np.minimum(at + length, len(chars) - 1)], end) if length else end
        h = (sums[stop] - sums[first]) * back[first]
        h = (h ^ (h >> np.uint64(31)) ^ (_MIX[2] if length else np.uint64(0))) * _MIX[0]
        out[:, j] = (h ^ (h >> np.uint64(29))) * _MIX[1]
        some[:, j] = n >= length
    return out, some


class Reader:
    """Term frequencies of texts over a vocabulary of hashes."""

    def __init__(self, vocabulary: np.ndarray, stems: tuple[int, ...]):
        self.stems, self.terms, self.of = stems, len(vocabulary), Lookup(vocabulary)

    def read(self, texts: list[bytes]) -> Vectors:
        """How often each text has each term."""
        keys, weights = [], []
        for owner, found in runs(texts, WORDS):
            words = found.dictionary
            if not len(words):
                continue
            hashes, some = term_hashes(words, self.stems)
            term = np.where(some, self.of.get(hashes.ravel()).reshape(hashes.shape), -1)
            key, times = np.unique(owner * len(words) + found.indices.to_numpy(), return_counts=True)
            terms = term[key % len(words)]
            known = terms >= 0
            keys.append((np.repeat(key // len(words), known.sum(axis=1)) * self.terms + terms[known]))
            weights.append(np.repeat(times, known.sum(axis=1)))
        if not keys:
            return Vectors(len(texts), *(np.zeros(0, np.int32) for _ in range(3)))
        key, times = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]
        # half the bytes serve: rows, terms and times fit 32 bits
        small = [key[first] // self.terms, key[first] % self.terms, np.add.reduceat(times[order], first) if len(key) else times]
        return Vectors(len(texts), *(x.astype(np.int32) for x in small))


def weigh(counts: Vectors, idf: np.ndarray) -> Vectors:
    """Unit vectors of term frequencies."""
    w = np.log(counts.weight.astype(np.float32))
    w += 1
    w *= idf.astype(np.float32)[counts.term]
    norm = np.sqrt(np.bincount(counts.row, weights=w * w, minlength=counts.n)).astype(np.float32)
    w /= norm[counts.row]
    return Vectors(counts.n, counts.row, counts.term, w)


def _packed(counts: Vectors) -> tuple:
    """Rows of counts as they are sent."""

    def pack(x: np.ndarray, step: bool) -> bytes:
        x = (np.diff(x, prepend=x.dtype.type(0)) if step else x).astype(np.int32, copy=False)
        return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T))

    return counts.n, pack(counts.row, True), pack(counts.term, True), pack(counts.weight, False)


def _unpacked(n: int, *packed: bytes) -> Vectors:
    row, term, weight = (np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T).view(np.int32).ravel() for x in packed)
    np.cumsum(row, out=row)
    np.cumsum(term, out=term)
    return Vectors(n, row, term, weight)


class BlockMaxIndex:
    """Inverted index of unit vectors. Postings of the commonest terms are in blocks, with the largest weight of every term in each block."""

    def __init__(self, vectors: Vectors, n_terms: int, block: int, dense: int = 1024, place: np.ndarray | None = None):
        self.block, self.n = block, vectors.n
        self.blocks = max(1, -(-self.n // block))
        row, term, weight = vectors.row, vectors.term, vectors.weight.astype(np.float32, copy=False)
        times = np.bincount(term, minlength=n_terms)
        common = np.argsort(-times, kind="stable")[:dense]
        common = common[times[common] > max(1, self.n // 64)]
        #: Place of a term among the commonest, or -1.
        self.place = np.full(n_terms, -1, np.int32)
        self.place[common] = np.arange(len(common))
        times[common] = 0
        self.start = np.r_[0, np.cumsum(times)]
        #: [block, common term, example of the block]
        self.weights = np.zeros((self.blocks, len(common), block), np.float32)
        #: An example's number and its weight's bits side by side, so that both come with one look.
        self.posting = np.empty(self.start[-1], np.int64)
        halves, cursor = self.posting.view(np.int32).reshape(-1, 2), self.start[:-1].copy()
        cuts = np.searchsorted(row, np.arange(self.n + 1, dtype=row.dtype))
        # example by example, each to the next free place of its terms: no copy of the vectors is sorted
        for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            t, w = term[a:z], weight[a:z]
            own = self.place[t]
            on = own >= 0
            self.weights[i // block, own[on], i % block] = w[on]
            t, w = t[~on], w[~on]
            at = cursor[t]
            halves[at, 0], halves[at, 1] = i, w.view(np.int32)
            cursor[t] += 1
        self.largest = self.weights.max(axis=2)
        # the lower an example's place among the ids, the higher its key among equal similarities
        places = np.zeros(self.blocks * block, np.int64)
        places[: self.n] = np.arange(self.n) if place is None else place
        self.example = np.argsort(places[: self.n])
        if len(places) > 1 << _PLACE:
            raise ValueError(f"an index holds {1 << _PLACE} examples at most")
        self.low = ((1 << _PLACE) - 1 - places).reshape(self.blocks, block)

    def nearest(self, queries: Vectors, k: int) -> tuple[np.ndarray, np.ndarray]:
        """[query, k] similarities, descending, and the examples' numbers (-1: fewer than k are alike at all)."""
        keys = np.full((queries.n, k), -1, np.int64)
        for at in range(0, queries.n, _QUERIES):
            end = min(queries.n, at + _QUERIES)
            keys[at:end] = self._nearest(queries.rows(at, end), k)
        low = (1 << _PLACE) - 1
        who = np.where(keys >= 0, self.example[np.minimum(low - (keys & low), max(0, self.n - 1))] if self.n else -1, -1)
        return np.where(keys >= 0, (keys >> _PLACE) / _UNIT, 0.0), who

    def _nearest(self, q: Vectors, k: int) -> np.ndarray:
        width = self.blocks * self.block
        place = self.place[q.term]
        common = place >= 0
        dense = np.zeros((q.n, self.weights.shape[1]), np.float32)
        dense[q.row[common], place[common]] = q.weight[common]
        row, term, weight = q.row[~common], q.term[~common], q.weight[~common]
        size = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        found = self.posting[at].view(np.int32).reshape(-1, 2)
        spot = np.repeat((row * width).astype(np.int32), size)
        spot += found[:, 0]
        share = np.repeat(weight, size)
        share *= found[:, 1].view(np.float32)
        rare = np.bincount(spot, weights=share, minlength=q.n * width).reshape(q.n, self.blocks, self.block)
        bound = dense @ self.largest.T + rare.max(axis=2)
        best = np.full((q.n, k), -1, np.int64)
        for b in np.argsort(-bound.sum(axis=0), kind="stable"):
            # a bound that only just misses may be a matter of rounding
            on = np.flatnonzero(bound[:, b] * _UNIT > (best.min(axis=1) >> _PLACE) - 10)
            if not len(on):
                continue
            s = (dense if len(on) == q.n else dense[on]) @ self.weights[b]
            unit = np.rint((s + rare[on, b]) * _UNIT).astype(np.int64)
            keys = np.where(unit > 0, (unit << _PLACE) | self.low[b], -1)
            more = keys.max(axis=1) > best[on].min(axis=1)
            on, keys = on[more], keys[more]
            best[on] = np.partition(np.concatenate([best[on], keys], axis=1), self.block, axis=1)[:, self.block :]
        return -np.sort(-best, axis=1)


def votes(best: np.ndarray, who: np.ndarray, toxic: np.ndarray, share: float, params: ToxicityParams) -> np.ndarray:
    """Log-odds of the neighbours' votes; a vote of the examples' share is added to each side."""
    say = np.where(who >= 0, 1 / (params.near + np.clip(1 - best, 0, 1)), 0)
    yes = (say * toxic[who]).sum(axis=1) + share
    no = (say * (1 - toxic[who])).sum(axis=1) + 1 - share
    # where all examples are of one kind, the other side has nothing
    return np.log((yes + 1e-9) / (no + 1e-9))


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray
    #: Inverse document frequency times the factor of each term.
    idf: np.ndarray
    #: How often the examples have their terms, in the order of the index; None where the model was sent to.
    examples: Vectors | None
    #: Ids in that order, and each one's place among them all.
    ids: list
    place: np.ndarray
    toxic: np.ndarray
    share: float
    #: Slope and offset of the logistic curve over a vote's log-odds.
    curve: tuple[float, float]
    params: ToxicityParams
    #: On the driver, which asks nothing of it.
    index_later: bool = False

    def __post_init__(self) -> None:
        self.index: BlockMaxIndex | None = None if self.index_later else self.index_of(self.idf)

    def index_of(self, idf: np.ndarray) -> BlockMaxIndex:
        return BlockMaxIndex(weigh(self.examples, idf), len(self.vocabulary), self.params.block, self.params.dense, self.place)

    def __getstate__(self) -> dict:
        """What is sent: counts, which pack well, instead of the index."""
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "examples", "index_later")} | {"packed": _packed(self.examples)}

    def __setstate__(self, state: dict) -> None:
        packed = state.pop("packed")
        self.__dict__.update(state, index_later=False)
        self.examples = _unpacked(*packed)
        self.__post_init__()
        # where it was sent only the index is asked
        self.examples = None
        give_back()

    def votes(self, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        return votes(best, who, self.toxic, self.share, self.params)

    def score(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * votes + self.curve[1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, by Newton steps with a small ridge."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        c += np.linalg.solve(h, a.T @ (y - p) - 1e-3 * c)
    return float(c[0]), float(c[1])


def factors(examples: Vectors, toxic: np.ndarray, n_terms: int, own: np.ndarray) -> np.ndarray:
    """sqrt(1 + log-likelihood ratio) of the terms that are more frequent in toxic examples, among the examples ``own``; 1 for all others."""
    n, bad = int(own.sum()), toxic[own].sum()
    if not n:
        return np.ones(n_terms)
    # some rows, and then some terms, at a time: the driver has little memory
    df, a = np.zeros(n_terms, np.int64), np.zeros(n_terms)
    for i in range(0, examples.n, _ROWS):
        some = examples.rows(i, i + _ROWS)
        on = own[some.row + i]
        np.add.at(df, some.term[on], 1)
        np.add.at(a, some.term[on], toxic[some.row[on] + i])
    share = bad / n

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1) / np.maximum(e, 1e-12)), 0.0)

    for k in range(0, n_terms, _TERMS):
        x, d = a[k : k + _TERMS], df[k : k + _TERMS]
        g = 2 * (part(x, d * share) + part(d - x, d * (1 - share)) + part(bad - x, (n - d) * share) + part((n - d) - (bad - x), (n - d) * (1 - share)))
        # a factor takes the place of its term's count
        x[:] = np.sqrt(1 + np.where(x > d * share, np.maximum(g, 0), 0))
    return a


def _own_votes(spark: SparkSession, model: ToxicityModel, idf: np.ndarray) -> np.ndarray:
    """Every example's vote: without itself, and with the factors of the half it is not in. Executors make the indexes of the halves, which the driver has no room for."""
    toxic, place, share, params, terms = model.toxic, model.place, model.share, model.params, len(model.vocabulary)
    sent = spark.sparkContext.broadcast((_packed(model.examples), idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = place % 2
        for b in batches:
            for task in b.column(0).to_pylist():
                h, part = task % 2, task // 2
                own = np.array_split(np.flatnonzero(half == h), _SLICES)[part]
                if not len(own):
                    continue
                packed, plain = sent.value
                counts = _unpacked(*packed)
                other = plain * factors(counts, toxic, terms, half != h)
                index = BlockMaxIndex(weigh(counts, other), terms, params.block, params.dense, place)
                for i in range(0, len(own), _ROWS):
                    some = own[i : i + _ROWS]
                    asked = weigh(counts.rows(int(some[0]), int(some[-1]) + 1), other)
                    nth = np.full(asked.n, -1)
                    nth[some - some[0]] = np.arange(len(some))
                    on = nth[asked.row] >= 0
                    best, who = index.nearest(Vectors(len(some), nth[asked.row[on]], asked.term[on], asked.weight[on]), params.k + 1)
                    # of more equals than k + 1, another one may stand for it
                    self_at = who == some[:, None]
                    drop = np.where(self_at.any(axis=1), self_at.argmax(axis=1), params.k)
                    keep = np.arange(params.k + 1)[None] != drop[:, None]
                    say = votes(best[keep].reshape(-1, params.k), who[keep].reshape(-1, params.k), toxic, share, params)
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(say)], names=["example", "vote"])
                del counts, index
                give_back()

    # a row for each of the bounded number of examples
    found = spark.range(0, 2 * _SLICES, 1, 2 * _SLICES).mapInArrow(run, "example long, vote double").toArrow()
    sent.destroy()
    out = np.zeros(model.examples.n)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def build(spark: SparkSession, vocabulary: np.ndarray, idf: np.ndarray, counts: Vectors, ids: list, toxic: np.ndarray, params: ToxicityParams) -> ToxicityModel:
    """The model of examples that have a term each."""
    n, terms = counts.n, len(vocabulary)
    whole = idf * factors(counts, toxic, terms, np.ones(n, bool))
    # examples whose heaviest term is the same stand together, so that the bounds of a block are close
    heavy = np.empty(n, np.int64)
    for i in range(0, n, _ROWS):
        w = weigh(counts.rows(i, min(n, i + _ROWS)), whole)
        cuts = np.searchsorted(w.row, np.arange(w.n + 1))
        # of equal weights the last
        heavy[i : i + w.n] = [w.term[z - 1 - w.weight[a:z][::-1].argmax()] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    place = np.empty(n, np.int64)
    place[sorted(range(n), key=lambda i: ids[i])] = np.arange(n)
    order = np.lexsort((place, toxic, heavy))
    # whole rows change places, and the order of terms within them stays; row by row, without an index of all terms
    cuts = np.searchsorted(counts.row, np.arange(n + 1, dtype=counts.row.dtype))
    size = np.diff(cuts)[order]
    term, weight = (np.concatenate([x[cuts[i] : cuts[i + 1]] for i in order]) for x in (counts.term, counts.weight))
    counts = Vectors(n, np.repeat(np.arange(n, dtype=np.int32), size), term, weight)
    del term, weight
    give_back()
    ids, toxic, place = [ids[i] for i in order], toxic[order].astype(float), place[order]
    model = ToxicityModel(vocabulary, whole, counts, ids, place, toxic, float(toxic.mean()), (1.0, 0.0), params, True)
    model.curve = _logistic(_own_votes(spark, model, idf), toxic)
    return model


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod(F.col("id"), params.fold_mod) != 0))
    sample = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(params.examples)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    # the sample has a fixed number of rows of two values
    found = cut(texts.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")))
    stems = params.stems

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for at in range(0, b.num_rows, _ROWS):
                parts = [h[some] for _, words in runs(_texts(b.column(0).slice(at, _ROWS)), WORDS) for h, some in [term_hashes(words.dictionary, stems)] if len(words)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(parts)).view(np.int64))], names=["term"])

    # as many rows as the bounded sample has terms
    vocabulary = np.sort(found.select("text").mapInArrow(distinct, "term long").distinct().toArrow().column(0).to_numpy().view(np.uint64))
    if not len(vocabulary):
        return None
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows = Reader(sent.value, stems), 0
        df = np.zeros(reader.terms + 1, np.int64)
        for b in lean(batches):
            for at in range(0, b.num_rows, _ROWS):
                df[:-1] += np.bincount(reader.read(_texts(b.column(0).slice(at, _ROWS))).term, minlength=reader.terms)
            rows += b.num_rows
        df[-1] = rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value, stems)
        for b in lean(batches):
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                v = reader.read(_texts(part.column(2)))
                cuts = np.searchsorted(v.row, np.arange(1, v.n))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([x.astype(np.int32).tobytes() for x in np.split(y, cuts)], pa.binary()) for y in (v.term, v.weight))], names=["id", "toxic", "terms", "times"])

    kind = T.StructType([found.schema["id"], *T.StructType.fromDDL("toxic int, terms binary, times binary").fields])
    # at most `examples` rows
    rows = [r for r in zip(*(c.to_pylist() for c in found.select("id", "toxic", "text").mapInArrow(vectors, kind).toArrow().columns), strict=True) if r[2]]
    if not rows:
        return None
    term, times = (np.frombuffer(b"".join(r[k] for r in rows), np.int32) for k in (2, 3))
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) // 4 for r in rows])
    ids, toxic = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    del rows
    return build(docs.sparkSession, vocabulary, idf, Vectors(len(ids), row, term, times), ids, toxic, params)


def _predict(rows: DataFrame, model: ToxicityModel | None, id_type: T.DataType | None) -> DataFrame:
    """(row, score, and, where ids have a type, evidence) of (row, text), or of a whole row with its text inside."""
    from pyspark.sql.pandas.types import to_arrow_type

    sent = rows.sparkSession.sparkContext.broadcast(model)
    own_id = None if id_type is None else to_arrow_type(id_type)
    fields = [rows.schema["row"], T.StructField("score", T.DoubleType())]
    if id_type is not None:
        fields.append(T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("similarity double, toxic int").fields]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        reader = Reader(own.vocabulary, own.params.stems) if own else None
        ids = None if own is None or own_id is None else pa.array(own.ids, own_id)
        for part in (b.slice(at, _ROWS) for b in lean(batches) for at in range(0, b.num_rows, _ROWS)):
            n = part.num_rows
            score, best, who = np.full(n, own.share if own else 0.0), np.zeros((n, 0)), np.zeros((n, 0), np.int64)
            if own:
                read = reader.read(_texts(text_of(part)))
                best, who = own.index.nearest(weigh(read, own.idf), own.params.k)
                some = np.bincount(read.row, minlength=n) > 0
                score[some] = own.score(own.votes(best[some], who[some]))
            cols = [part.column(0), pa.array(score)]
            if own_id is not None:
                on = who >= 0
                of = pa.array(who[on])
                items = [ids.take(of) if ids is not None else pa.nulls(0, own_id), pa.array(best[on]), pa.array((own.toxic[who[on]] if own else np.zeros(0)).astype(np.int32))]
                cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(on.sum(axis=1))], pa.int32()), pa.StructArray.from_arrays(items, ["id", "similarity", "toxic"])))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def score(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, held_out, score, predicted, evidence (the neighbours, nearest first)."""
    model = fit(docs, labels, params, id_col=id_col, text_col=text_col)
    out = _predict(docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")), model, docs.schema[id_col].dataType)
    return out.select(F.col("row").alias(id_col), (crc_mod(F.col("row"), params.fold_mod) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def cross_validate(docs: DataFrame, labels: DataFrame, choices: list[ToxicityParams], *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[float, float, float]]:
    """(log loss, share of toxic found, share of clean called toxic) of each choice, by cross-validation within the learnt folds.

    The held-out fold (remainder 0) takes no part: each other fold in turn is scored by a model of the rest."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    out = []
    for params in choices:
        fold, sums = crc_mod(F.col(id_col), params.fold_mod), np.zeros(6)
        for left in range(1, params.fold_mod):
            model = fit(docs, known.where(fold != left), params, id_col=id_col, text_col=text_col, label_col=label_col)
            asked = docs.join(known.where(fold == left).groupBy(id_col).agg(F.max(label_col).alias("_label")), id_col).select(F.struct(id_col, F.col("_label").alias("label")).alias("row"), F.col(text_col).alias("text"))
            p, y = F.least(F.greatest("score", F.lit(1e-9)), F.lit(1 - 1e-9)), F.col("row.label") == 1
            loss, called = F.sum(-F.log(F.when(y, p).otherwise(1 - p))), F.col("score") >= 0.5
            sums += np.array([x or 0 for x in _predict(asked, model, None).agg(loss, F.count("*"), F.count_if(y & called), F.count_if(y), F.count_if(~y & called), F.count_if(~y)).first()], float)
        out.append((sums[0] / max(1, sums[1]), sums[2] / max(1, sums[3]), sums[4] / max(1, sums[5])))
    return out


def keep_clean(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The documents that are not predicted toxic: all columns as they are."""
    model = fit(docs, labels, params)
    # the row travels as one column, whatever its columns are called
    out = _predict(docs.select(F.struct("*").alias("row")), model, None)
    return out.where(F.col("score") < 0.5).select("row.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
