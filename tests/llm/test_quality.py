"""Quality scores: the pieces by hand, held-out accuracy on the given tables."""

import os
import zlib

import numpy as np
import pytest

from sparkmail.llm import quality

SF = os.environ.get("TEST_SF_DIR_LLM", "/root/testdata/sf0.1")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, x string, score string")


def test_isotonic():
    assert quality.isotonic(np.array([1, 0, 3, 2, 8.0]), np.array([1, 1, 4, 4, 8.0])).tolist() == [0.5, 0.5, 0.625, 0.625, 1.0]
    assert quality.isotonic(np.array([]), np.array([])).tolist() == []
    rng = np.random.default_rng(1)
    y, n = rng.random(50), np.ones(50)
    got = quality.isotonic(y, n)
    assert (np.diff(got) >= 0).all() and abs(got.sum() - y.sum()) < 1e-9


def test_partition_sums_give_the_plain_solution(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "!!", "###", "delta."], 30 + i % 7))) for i in range(300)]
    labels = spark.createDataFrame([(i, int("###" not in t), 0) for i, t in rows], "doc_id long, quality int, x int")
    stats = quality.statistics(docs(spark, rows).repartition(5))
    model = quality.fit(stats, labels)
    used = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    z = model.features(np.array([quality.statistics_of(t) for _, t in used]))
    y = np.array([float("###" not in t) for _, t in used])
    penalty = np.eye(z.shape[1]) * max(1e-6, quality.RIDGE * len(z))
    penalty[-1, -1] = 1e-9
    assert np.allclose(model.weights[None], np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-5)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "word " * 50_000), (3, "twice"), (3, "twice"), (4, "\n\n"), (5, "é ß")]
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (3, 1, 1), (3, 0, 1), (5, 1, 0), (77, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    stats = quality.statistics(docs(spark, rows))
    found = quality.score(stats, quality.fit(stats, labels)).collect()
    assert sorted(map(repr, (r[0] for r in found))) == sorted(map(repr, (i for i, _ in rows)))
    assert all(0 <= r[1] <= 1 for r in found)


@pytest.mark.parametrize("label", [None, 0, 1])
def test_labels_of_one_kind(spark, label):
    labels = spark.createDataFrame([(i, label, 0) for i in range(9)] if label is not None else [], "doc_id long, quality int, toxic int")
    stats = quality.statistics(docs(spark, [(i, f"text {i}") for i in range(9)]))
    found = {round(r[1], 3) for r in quality.score(stats, quality.fit(stats, labels)).collect()}
    assert found == {0.5 if label is None else float(label)}


def test_empty_tables(spark):
    stats = quality.statistics(docs(spark, []))
    model = quality.fit(stats, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.score(stats, model).collect() == []
    assert quality.keep_good(docs(spark, []), model).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stats = quality.statistics(table).cache()
    model = quality.fit(stats, labels)
    scored = {r[0]: r[1] for r in quality.score(stats, model).collect()}
    held = [(r["quality"], scored[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    stats.unpersist()
    right = np.mean([(s >= 0.7) == bool(q) for q, s in held])
    good = [s for q, s in held if q]
    bad = [s for q, s in held if not q]
    auc = np.mean([np.mean(np.array(bad) < g) + np.mean(np.array(bad) == g) / 2 for g in good])
    assert right > 0.97 and auc > 0.97
    assert np.mean([s >= 0.7 for s in good]) > 0.98
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, s in scored.items() if s >= 0.7}
