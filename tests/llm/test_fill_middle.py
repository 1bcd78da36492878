"""Fill-in-the-middle against plain slicing of lists of lines."""

import hashlib
import random
import re

import numpy as np
import pytest

from sparkmail.llm import fill_middle

SCHEMA = "doc_id long, text string, n string, form string, output string, middle_chars string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in rows], SCHEMA)


def plain(key, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return key, len(units), "plain", None, None, text
    form, out = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 % 100 < 50 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return key, len(units), form, len(prefix), len(middle), out


@pytest.mark.parametrize("n", [0, 1, 2, 9, 5000])
def test_seek(n):
    widths = np.random.default_rng(n).integers(0, 50, n)
    found = fill_middle.SkipList(widths, seed=n)
    upto = np.append(0, np.cumsum(widths))
    ranks = np.random.default_rng(1).permutation(n + 1)
    assert (found.seek(ranks) == upto[ranks]).all()
    for lane in found.lanes:  # each lane passes everything
        assert lane.units[:-1].sum() == n and lane.chars.sum() == widths.sum()
    assert len(found.lanes) > 3 or n < 5000


def texts():
    rng = random.Random(2)
    alphabet = [*"ab é漢😀\r <>PSM", "\n", "\n", "<", "́"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    made += ["", None, "\n", "\n\n\n", "one", "one\n", "a<P>b\nc", "x\n<S", ">\n<", "<M>", "<P", "line\n" * 50_000, "\r\n\r\n", "x" * 100_000]
    return list(enumerate(made)) + [(None, "no id\nat all\n"), (3, "again\nand\nagain"), (3, "again\nand\nagain")]


@pytest.mark.parametrize("size", [64, 1 << 22])
def test_documents(spark, monkeypatch, size):
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", size)
    rows = texts()
    made = fill_middle.fill_in_middle(docs(spark, rows))
    found = made.select("*", fill_middle.restored().alias("restored")).collect()
    assert sorted([tuple(r)[:6] for r in found], key=repr) == sorted([plain(*r) for r in rows], key=repr)
    assert sorted([(r["doc_id"], r["restored"]) for r in found], key=repr) == sorted([(i, t or "") for i, t in rows], key=repr)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_rates(spark):
    rows = [(i, "a\nb\nc\n") for i in range(300)]
    forms = [r["form"] for r in fill_middle.fill_in_middle(docs(spark, rows), rate=50, spm_rate=100).collect()]
    assert set(forms) == {"plain", "spm"} and 100 < forms.count("plain") < 200


def test_other_marks(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    rows = [(i, t) for i, t in texts() if t and len(t) < 100]
    made = fill_middle.fill_in_middle(docs(spark, rows), marks=marks)
    found = made.select("doc_id", fill_middle.restored(marks=marks).alias("restored")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(rows, key=repr)
    for bad in [("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "><", "<M>"), ("", "a", "b"), ("xay", "a", "b")]:
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs(spark, rows), marks=bad)


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(docs(spark, [])).collect() == []
