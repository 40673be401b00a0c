"""Splits by judgements where one side is empty."""

import pytest

from lumenspan.plans import catalog


def judged_tables(spark, folder, texts):
    """Three items, and documents with these texts."""
    items = [(1, "one two three four"), (2, "five six seven eight"), (3, "nine ten eleven twelve")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


ALL_JUDGED = ["say one two three four now", "five six seven eight, nine ten eleven twelve", "so nine ten eleven twelve"]


@pytest.mark.parametrize(("texts", "expected"), [(ALL_JUDGED, (0, 3, 0, 4, 0)), (["nothing of them"], (3, 0, 0, 0, 0))])
def test_route_overlap_where_a_side_is_empty(spark, tmp_path, texts, expected):
    r = catalog.QUERIES["route_overlap"](spark, judged_tables(spark, tmp_path, texts)).first()
    assert (r["opt_queries"], r["eval_queries"], r["opt_qrels"], r["eval_qrels"], r["overlap"]) == expected
    assert r["mode"] == "split_by_qrels"


@pytest.mark.parametrize(("texts", "side"), [(ALL_JUDGED, "eval"), (["nothing of them"], "opt")])
def test_route_split_where_a_side_is_empty(spark, tmp_path, texts, side):
    got = catalog.QUERIES["route_split_by_qrels"](spark, judged_tables(spark, tmp_path, texts)).collect()
    assert sorted((r["qid"], r["side"]) for r in got) == [("1", side), ("2", side), ("3", side)]
