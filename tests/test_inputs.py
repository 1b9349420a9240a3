"""Queries do not compute dear inputs twice."""

import pyarrow as pa

from registry import evaluation_queries, term_queries  # noqa: F401  (they register the queries)
from registry.core import QUERIES, Tables
from termloom.functions import ordering


def test_scores_are_computed_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)

    rows = [(f"V_{i}", f"W_{j}", (i + j) / 100) for i in range(7) for j in range(3)]
    frame = spark.createDataFrame(rows, "source string, target string, score double")
    monkeypatch.setattr(Tables, "scores", lambda t: frame.mapInArrow(counted, frame.schema))
    found = QUERIES["read_scores_lenient"](spark, "nowhere").collect()
    assert sorted(map(tuple, found)) == sorted((s, t + ', "q"', x) for s, t, x in rows)
    assert seen.value == len(rows)


def test_only_wanted_columns_are_put_in_order(spark, monkeypatch):
    rows = spark.createDataFrame(
        [("m", "a", 1, "a|x", 0.5, "left"), ("m", "a", 2, "a|y", 0.25, "left")],
        "model string, subject_id string, concept_pair_rank int, pair_id string, e double, subject_label string",
    )
    monkeypatch.setattr(evaluation_queries, "_residuals", lambda t: rows)
    sorted_columns, plain = [], ordering.range_chunks
    monkeypatch.setattr(ordering, "range_chunks", lambda df, *a: sorted_columns.append(df.columns) or plain(df, *a))
    found = QUERIES["lag_residual"](spark, "nowhere").collect()
    assert {tuple(r) for r in found} == {("m", "a|x", None), ("m", "a|y", -0.25)}
    assert [set(c) for c in sorted_columns] == [{"model", "subject_id", "concept_pair_rank", "pair_id", "e"}]
