"""Language prediction: gradients, odd rows, held-out accuracy."""

import os
import zlib

import numpy as np
import pytest

from sparkmail.llm import langid

SF = os.environ.get("TEST_SF_DIR_LLM", "/root/testdata/sf0.01")
SCHEMA = "doc_id long, text string, lang string, score string, rank string, windows string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, k, "c", "c", "c") for i, t, k in rows], SCHEMA)


def test_windows():
    found = langid.windows_of("ÄB" + "c" * 256)
    assert found.shape == (2, langid.WINDOW)
    assert found.tobytes().rstrip(b"\0") == ("Äb" + "c" * 256).encode()
    assert langid.windows_of("").shape == (1, langid.WINDOW)


def loss(net, windows, y, weight):
    likely = langid.softmax(net.logits(windows).astype(np.float64))
    return -(weight * np.log(likely[np.arange(len(y)), y])).sum()


def test_gradients():
    rng = np.random.default_rng(1)
    samples = {"a": [rng.integers(1, 90, (6, langid.WINDOW)).astype(np.uint8)], "b": [rng.integers(60, 200, (6, langid.WINDOW)).astype(np.uint8)]}
    net = langid.train(samples)
    for name in ("embedding", "filters", "shift", "layer", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    windows, y = np.concatenate([samples["a"][0], samples["b"][0]]), np.repeat([1, 0], 6)  # wrong on purpose
    weight = np.full(12, 1 / 12)
    grads = langid._gradients(net, windows, y, weight)
    for name, grad in grads.items():
        value = getattr(net, name)
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(4)] + [np.unravel_index(np.abs(grad).argmax(), grad.shape)]:
            if name == "embedding" and at[0] == 0:
                continue
            step, old = 1e-5, value[at]
            value[at] = old + step
            up = loss(net, windows, y, weight)
            value[at] = old - step
            down = loss(net, windows, y, weight)
            value[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-4 + 0.02 * abs(grad[at]), (name, at)


def test_odd_rows(spark):
    rows = [(i, f"the house and the garden number {i}", "en") for i in range(30)]
    rows += [(100 + i, f"das Haus und der Garten Nummer {i}", "de") for i in range(30)]
    odd = [(200, None, "en"), (201, "", None), (202, "123 !? 456", "de"), (None, "the garden and the house", "en"),
           (203, "der Garten " * 20_000, None), (0, rows[0][1], "en"), (204, "\x00\x00", "en"), (205, "x", None)]
    table = docs(spark, rows + odd)
    samples = langid.sample(table)
    assert set(samples) == {"en", "de"}
    learned = sum(map(len, samples.values()))
    assert learned == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, t, k in rows + odd if t is not None and k and i is not None)
    found = langid.predict(table, langid.train(samples)).collect()
    assert len(found) == len(rows + odd)
    named = {r[0]: r for r in found}
    assert [named[i]["lang_pred"] for i in (200, 201, 202, 204)] == ["und"] * 4
    assert named[203]["lang_pred"] == "de" and named[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in found)
    again = langid.predict(table, langid.train(langid.sample(table.repartition(3)))).collect()
    assert sorted((r[0] or -1, r[1]) for r in again) == sorted((r[0] or -1, r[1]) for r in found)


def test_without_labels_or_rows(spark):
    assert langid.sample(docs(spark, [(1, "text", None)])) == {}
    assert langid.predict(docs(spark, [(1, "text", None)]), None).collect()[0]["lang_pred"] == "und"
    assert langid.predict(docs(spark, []), None).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.train(langid.sample(table))
    lang = {r["doc_id"]: r["lang"] for r in table.select("doc_id", "lang").collect()}
    found = [r for r in langid.predict(table, net).collect() if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in found]) > 0.97
