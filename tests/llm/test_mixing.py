"""Mixing: targets, sums, bounds and expectations."""

import re

import numpy as np
import pytest

from sparkmail.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies string, block string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash", "clash") for i, t, s in rows], SCHEMA)


def test_targets_by_hand():
    assert mixing.water_fill({"a": 100, "b": 100, None: 100}) == {"a": 200.0, "b": 166.66666666666666, None: 83.33333333333333}
    assert mixing.water_fill({"b": 0, "a": 0}) == {"a": 0.0, "b": 0.0}
    assert mixing.water_fill({}) == {}
    # 5, 2, 1 by code point: upper case before lower case, a supplementary character last
    assert mixing.water_fill({"\U0001f600": 80, "Z": 80, "a": 80}) == {"Z": 160.0, "a": 133.33333333333334, "\U0001f600": 66.66666666666667}


def test_pivotal_keeps_sum_and_expectation():
    size = np.array([5, 40, 3, 11, 200, 1, 77, 0, 9])
    p = np.array([0.3, 0.5, 0.2, 0.9, 0.4, 0.6, 0.1, 0.7, 0.0])
    mean = np.zeros(len(p))
    for run in range(4000):
        out, at = mixing.pivotal(size, p, np.random.default_rng(run))
        assert abs(size @ out - size @ p) < 1e-6
        assert all(x in (0, 1) for k, x in enumerate(out) if k != at)
        mean += out / 4000
    assert np.abs(mean - p)[size > 0].max() < 0.04


@pytest.mark.parametrize("leaf", [4, 1024])
def test_mix(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(
        zip(rng.integers(1, 60, 400), rng.choice(["a", "a", "a", "b", "c", "é"], 400)))]
    rows += [(1000, None, "a"), (1001, " \n", "b"), (1002, "x " * 700, "a"), (1003, "one word", None), (None, "no id", "c")]
    rows += [rows[3], rows[3]]
    found = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    assert len(found) == len(rows)
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    assert sorted(r["size"] for r in found) == sizes
    for source in {s for _, _, s in rows}:
        own = [r for r in found if r["source"] == source]
        total = sum(r["size"] for r in own)
        assert {r["source_size"] for r in own} == {total}
        (target,) = {r["target"] for r in own}
        assert target <= 2 * total + 1e-9
        rate = target / total
        assert all(int(rate) <= r["copies"] <= -(-rate // 1) for r in own if r["size"])
        assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= max(r["size"] for r in own) / 2 + 1e-6
    assert all(r["copies"] == 0 for r in found if not r["size"])


def test_take_repeats_rows(spark):
    rows = [(i, "some words here " * (i % 5), "ab"[i % 2]) for i in range(40)] + [(3, "some words here " * 3, "b")]
    table = docs(spark, rows)
    copies = {}
    for r in mixing.mix(table).collect():
        copies[r[0]] = copies.get(r[0], 0) + r["copies"]
    taken = mixing.take(table)
    assert taken.columns == table.columns
    found = {}
    for r in taken.collect():
        found[r[0]] = found.get(r[0], 0) + 1
    assert found == {k: v for k, v in copies.items() if v}


def test_take_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "_copies", "_copy", "_tie", "tie", "row", "id", "r", "t"]
    rows = [(i, f"word {i} " * (i + 1), "s", *["mine"] * 8) for i in range(8)] + [(None, "no id", "s", *["mine"] * 8)]
    table = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    taken = mixing.take(table)
    assert taken.columns == names
    found = [tuple(r) for r in taken.collect()]
    assert set(found) <= set(rows) and len(set(found)) > 4


def test_take_of_one_id_with_two_texts(spark):
    rows = [(1, "a b c d e f", "s"), (1, "quite another text here", "s"), (2, "x y z", "s")]
    found = {(r["doc_id"], r["text"]) for r in mixing.take(docs(spark, rows), share=2.0).collect()}
    assert found == {(i, t) for i, t, _ in rows}


def test_empty_table(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    assert mixing.take(docs(spark, [])).collect() == []
