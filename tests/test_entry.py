"""The registered queries against their SQL, over the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["dhash_frames", "moving_mask", "best_alignment_gated", "clip_candidates_ranked", "clip_clusters", "image_index_candidates", "image_pairs_t10", "image_duplicates", "hex_round_trip", "parsed_fingerprints", "image_index_added", "image_index_empty", "cluster_lists", "sql_functions", "best_alignment_joined", "visual_segments"]


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.6g}")
    return tuple(map(plain, v)) if isinstance(v, list) else v


def same(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = e.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    theirs = con.sql(e.oracle_sql()[name])
    assert sorted(theirs.columns) == cols
    assert mine == sorted((tuple(map(plain, r)) for r in theirs.select(*cols).fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    same(spark, name)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parent.parent
    for p in (root / "echofold").rglob("*.py"):
        if "llm" not in p.relative_to(root / "echofold").parts:
            assert "llm" not in p.read_text(), p
