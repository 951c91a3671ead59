"""Language identification by a bidirectional gated recurrent network over bytes.

The network (``gru``) is trained in numpy by backpropagation through time, on
windows from a bounded sample: per language, the ``per_lang`` training documents
with the least hash of their id, a few windows of ``train_window`` bytes of each.
Every position of a window is labelled with the document's language.

Every text is read whole, in windows of ``window`` bytes that start from a zero
state in both directions.  The labels' probabilities at every byte are averaged
over the document; the language with the highest average is its prediction, the
average its score.

Defined results: ``und`` (score 0) for null texts and texts without a letter;
without a labelled training document every text is ``und``; null ids are in the
fold of the empty id; equal averages go to the first language in order; repeated
rows each get a result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, lean, table, text_of
from .gru import Labeller, train

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    fold_mod: int = 4
    fold: int = 2
    #: Bounds of the training sample: documents of each language, and of all (every language has one at least).
    per_lang: int = 400
    sample: int = 25_600
    #: Windows of each of them, and their bytes.
    windows: int = 4
    train_window: int = 48
    h: int = 8
    steps: int = 300
    batch: int = 128
    rate: float = 0.02
    #: Bytes that the network reads from one zero state to the next.
    window: int = 128
    #: Windows that run side by side.
    lanes: int = 4096


def fit(docs: DataFrame, params: LanguageParams, *, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], Labeller | None]:
    """Languages in order, and the network."""
    known = docs.where((crc_mod(F.col(id_col), params.fold_mod) != params.fold) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    key = F.xxhash64(F.col(id_col), F.lit(1))
    # windows are cut before anything moves: a row carries at most windows * train_window characters
    span = F.greatest(F.length(text_col) - params.train_window, F.lit(1))
    cuts = F.array(*(F.substr(F.col(text_col), (F.pmod(F.xxhash64(F.col(id_col), F.lit(k + 2)), span) + 1).cast("int"), F.lit(params.train_window)) for k in range(params.windows)))
    rows = known.select(F.col(lang_col).alias("lang"), key.alias("key"), cuts.alias("cuts"))
    # one row of each language
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], None
    most = max(1, min(params.per_lang, params.sample // len(langs)))
    # the least hashes lie below a bound that leaves about four times as many of each language, wherever its rows are
    bounds = {lang: 2**63 - 1 if n <= 4 * most else int(-(2**63) + 4 * most / n * 2**64) for lang, n in counts.items()}

    def least(of: dict[str, int]) -> list:
        spark = docs.sparkSession
        bound = spark.createDataFrame(list(of.items()), T.StructType([rows.schema["lang"], T.StructField("bound", T.LongType())]))
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("key", "cuts"))
        low = rows.join(F.broadcast(bound), "lang").where(F.col("key") <= F.col("bound"))
        return low.withColumn("nth", nth).where(F.col("nth") <= most).select("lang", "nth", "cuts").collect()

    sample = least(bounds)
    # rows that share few ids may all lie above the bound
    found = Counter(r.lang for r in sample)
    short = {lang: 2**63 - 1 for lang, n in counts.items() if found[lang] < min(most, n)}
    if short:
        sample = [r for r in sample if r.lang not in short] + least(short)
    x, y = [], []
    for r in sorted(sample, key=lambda r: (r.lang, r.nth)):
        for c in r.cuts:
            w = c.encode("utf-8", "surrogatepass")
            if w:
                x.append(np.frombuffer((w * (params.train_window // len(w) + 1))[: params.train_window], np.uint8))
                y.append(langs.index(r.lang))
    if not x:
        return [], None
    net = train(np.stack(x), np.array(y), len(langs), h=params.h, steps=params.steps, batch=params.batch, rate=params.rate)
    return langs, net


def label(texts: list[bytes], net: Labeller, params: LanguageParams) -> np.ndarray:
    """[text, label] sums over all bytes of the labels' probabilities."""
    per = np.array([-(-len(t) // params.window) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), per)
    flat = np.frombuffer(b"".join(texts) + bytes(params.window), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = first[owner] + nth * params.window
    length = np.minimum(params.window, sizes[owner] - nth * params.window)
    order = np.argsort(-length, kind="stable")
    owner, start, length = owner[order], start[order], length[order]
    total = np.zeros((len(texts), len(net.b)))
    view = np.lib.stride_tricks.sliding_window_view(flat, params.window)
    for k in range(0, len(owner), params.lanes):
        s = slice(k, k + params.lanes)
        x = np.ascontiguousarray(view[start[s]].T)
        np.add.at(total, owner[s], net.pooled(x[: length[s][0]], length[s]).T)
    return total


def identify(docs: DataFrame, params: LanguageParams = LanguageParams(), *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per document: id, held_out, lang_pred, score."""
    langs, net = fit(docs, params, id_col=id_col, text_col=text_col, lang_col=lang_col)
    out = _predict(docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")), langs, net, params)
    return out.select(F.col("row").alias(id_col), (crc_mod(F.col("row"), params.fold_mod) == params.fold).alias("held_out"), "lang_pred", "score")


def _predict(rows: DataFrame, langs: list[str], net: Labeller | None, params: LanguageParams) -> DataFrame:
    """(row, lang_pred, score) of (row, text), or of a whole row with its text inside."""
    model = rows.sparkSession.sparkContext.broadcast(net)
    most = params.lanes * params.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for b in (b.slice(k, 1024) for b in lean(batches) for k in range(0, b.num_rows, 1024)):
            texts = text_of(b).to_pylist()
            read = [t.encode("utf-8", "surrogatepass") if t is not None and any(map(str.isalpha, t)) else b"" for t in texts]
            total, at = np.zeros((len(read), max(1, len(langs)))), 0
            while own is not None and at < len(read):
                end, size = at, 0
                while end < len(read) and (end == at or size + len(read[end]) <= most):
                    size += len(read[end])
                    end += 1
                total[at:end] = label(read[at:end], own, params)
                at = end
            mass = total.sum(axis=1)
            best = total.argmax(axis=1)
            said = [langs[i] if m > 0 else UNKNOWN for i, m in zip(best, mass, strict=True)]
            score = np.clip(total.max(axis=1) / np.maximum(mass, 1e-9), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said), pa.array(score)], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def keep_identified(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """The documents whose text is in some language: all columns as they are."""
    langs, net = fit(docs, params, id_col="doc_id", text_col="text", lang_col="lang")
    # the row travels as one column, whatever its columns are called
    out = _predict(docs.select(F.struct("*").alias("row")), langs, net, params)
    return out.where(F.col("lang_pred") != UNKNOWN).select("row.*")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
