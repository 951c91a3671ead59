"""Rows that wait for Python have a piece of a text, not the whole text."""

import pytest


@pytest.mark.parametrize("name", ["dhash_frames_arrow", "image_hashes_arrow"])
def test_pieces_leave_their_text(spark, tmp_path, name):
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "x" * 5000), (2, None), (3, ""), (4, "é" * 40)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = entry.queries()[name](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan()
    while not plan.nodeName().startswith("ArrowEvalPython"):
        plan = plan.children().head()
    waiting = plan.children().head().output()
    assert {waiting.apply(k).name() for k in range(waiting.size())} <= {"doc_id", "pos", "gray", "idx"}
    assert out.count() == (70 + 2 if name == "dhash_frames_arrow" else 19 + 1)
