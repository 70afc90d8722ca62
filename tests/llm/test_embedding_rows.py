"""Repeated ids, vectors of several lengths and vectors that link with nothing."""

import pytest

from tidemark.llm import embeddings


def test_every_row_is_returned_once_and_every_length_compared(spark):
    nan = float("nan")
    table = [
        (5, [1.0, 0.0]), (5, [0.0, 1.0]), (3, [0.0, 2.0]), (9, [3.0, 0.0]),  # one id, two vectors
        (7, [1.0, 1.0, 0.0]), (8, [1.0, 1.0, 0.0]), (6, [1.0, 1.0, 0.1]), (4, [0.0, 0.0, 1.0]),  # another length
        (2, [1.0]), (1, [-1.0]),
        (20, None), (21, []), (22, [0.0, 0.0]), (23, [nan, 1.0]), (24, [None, 1.0]), (24, None), (None, [1.0, 0.0]),
    ]
    got = embeddings.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>"))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(((r.vec_id or -1), r.n_links, (r.component_id or -1), r.kept) for r in got.collect() if r.vec_id is not None) == sorted([
        (5, 1, 5, True), (5, 1, 3, False), (3, 1, 3, True), (9, 1, 5, False),
        (7, 2, 6, False), (8, 2, 6, False), (6, 2, 6, True), (4, 0, 4, True), (2, 0, 2, True), (1, 0, 1, True),
        *((i, 0, i, True) for i in (20, 21, 22, 23, 24, 24)),
    ])
    assert got.count() == len(table)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_audit_sees_missed_pairs_beside_a_large_group(spark):
    rows, of = [], []
    for i in range(900):  # one large group, found whole
        rows.append((i, [1.0, 0.0, 1e-4 * i] + [0.0] * 61))
        of.append((i, 0))
    for i in range(60):  # pairs, all missed
        v = [0.0] * 64
        v[3 + i] = 1.0
        rows += [(1000 + 2 * i, v), (1001 + 2 * i, [*v[:2], 0.01, *v[3:]])]
    points = embeddings.unit_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).withColumnRenamed("vec_id", "id")
    assert embeddings.audit(points, spark.createDataFrame(of, "node long, root long"), 0.9) == pytest.approx(0.0)
