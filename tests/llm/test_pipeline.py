"""Every stage against a plain version of its decision, over the smallest tables."""

import os
import re

import duckdb
import pytest
from test_entry import same

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, DATA).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(kept):
    for _, before, after in kept[:-1]:
        assert after.columns == before.columns
        assert set(map(tuple, after.collect())) <= set(map(tuple, before.collect()))


def test_language(kept):
    before, after = (rows(x) for x in kept[0][1:])
    assert set(after) == {i for i, r in before.items() if r.text and re.search(r"[^\W\d_]", r.text)}


def test_toxicity(kept):
    before, after = (rows(x) for x in kept[1][1:])
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{DATA}/labels.parquet'").fetchall())
    clean = [i for i in before if toxic.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.95 * len(clean)


def test_near_duplicates(kept):
    """Against all pairs of five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    from llm.test_near_copies import heads

    before, after = (rows(x) for x in kept[2][1:])
    ids = sorted(before)
    assert set(after) == heads(ids, [before[i].text for i in ids])


def test_decontamination(kept):
    from llm.test_texts import hits

    before, after = (rows(x) for x in kept[3][1:])
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    from echofold.llm.decontaminate import words

    windows = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] for i in range(max(1, len(w) - 9)) if w}
    assert all(len(w) == 10 for w in windows)
    clean = {i for i, r in before.items() if not any(tuple(w[k : k + 10]) in windows for w in [words(r.text)] for k in range(len(w) - 9))}
    assert set(after) == clean and not hits("", items)[0]


def test_pieces(kept, spark):
    from echofold.llm import pieces

    before, after = rows(kept[4][1]), kept[4][2]
    assert {r.doc_id: r.text for r in pieces.decode(after).collect()} == {i: r.text for i, r in before.items()}


def test_run(spark, kept):
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == set(rows(kept[-1][2]))


@pytest.mark.parametrize("name", ["op2_chat_format", "op3_revisits", "op9_decontaminate"])
def test_query(spark, name):
    same(spark, name)


@pytest.fixture
def odd_tables(spark, tmp_path):
    """Makes a folder of tables whose documents have null and repeated ids, repeated rows, odd texts and clashing columns."""
    from llm.common_texts import ODD

    def make(texts):
        extra = {"row": 1, "_row": 2, "node": 3, "class": 4, "score": 5, "spans": 6, "a.b": 7}
        docs = [(i if i % 5 else None, t, "en", "s", 0, *extra.values()) for i, t in enumerate(texts)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in extra)
        spark.createDataFrame(docs + docs[:3], schema).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(i, 0, 0) for i in range(0, 40, 3)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        spark.createDataFrame([(1, "one of the benchmark items that no text of these has at all"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    make.odd = ODD
    return make


def test_odd_rows(spark, odd_tables):
    import corpus_pipeline

    path = odd_tables([*odd_tables.odd, *(f"some plain words of text number {i % 30}" for i in range(60))])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    texts = [r.text for r in docs.collect()]
    assert len(texts) == len(set(texts)) and "one two three" in texts
    assert corpus_pipeline.run(spark, path).count() == len(texts)


def test_no_documents(spark, odd_tables):
    import corpus_pipeline

    path = odd_tables(["gone"])
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0, name
