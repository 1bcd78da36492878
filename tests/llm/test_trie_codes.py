"""Vector codes against full distances to all entries."""

import hashlib

import numpy as np
import pytest

from sparkmail.llm import trie_codes

SCHEMA = "vec_id long, embedding array<double>, label string, code string, error string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "clash", "clash", "clash") for i, v, k in rows], SCHEMA)


def plain(rows, parts=16, entries=64, rounds=2):
    """(sorted (id, label, code, error), books by length) of rows (id, vector, label), entry by entry."""
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int), k) for i, v, k in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, books = [], {}
    for dim in sorted({len(v) for _, v, _ in kept}):
        own = [r for r in kept if len(r[1]) == dim]
        first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))[:entries]
        codes, errors = [[] for _ in own], [0] * len(own)
        books[dim] = []
        for a, b in trie_codes.cuts(dim, parts):
            book = [r[1][a:b].tolist() for r in first]
            for step in range(rounds + 1):
                picked = []
                for _, v, _ in own:
                    distances = [sum((x - y) ** 2 for x, y in zip(v[a:b].tolist(), c)) for c in book]
                    picked.append((min(distances), distances.index(min(distances))))
                if step < rounds:
                    for e in range(len(book)):
                        members = [own[j][1][a:b].tolist() for j, (_, x) in enumerate(picked) if x == e]
                        if members:
                            book[e] = [sum(c) // len(members) for c in zip(*members)]
            books[dim].append(book)
            for j, (d, e) in enumerate(picked):
                codes[j].append(e)
                errors[j] += d
        out += [(i, k, bytes(c), e) for (i, _, k), c, e in zip(own, codes, errors)]
    return sorted(out, key=repr), books


@pytest.mark.parametrize("subtree", [1, 7, 4096])
@pytest.mark.parametrize("width", [0, 1, 2, 5])
def test_nearest(monkeypatch, subtree, width):
    monkeypatch.setattr(trie_codes, "SUBTREE", subtree)
    rng = np.random.default_rng(width)
    for n in (0, 1, 400):
        rows, book = rng.integers(-4, 4, (n, width)), rng.integers(-4, 4, (9, width))
        some, place, times = trie_codes.distinct(rows)
        assert [tuple(x) for x in some.tolist()] == sorted({tuple(x) for x in rows.tolist()})
        assert (some[place] == rows).all() and times.sum() == n
        entry, least = trie_codes.nearest(some, book)
        every = ((rows[:, None] - book) ** 2).sum(axis=2)
        assert (entry[place] == every.argmin(axis=1)).all() and (least[place] == every.min(axis=1)).all()


@pytest.mark.parametrize("batch", [5, 1 << 15])
def test_codes(spark, monkeypatch, batch):
    monkeypatch.setattr(trie_codes, "BATCH_ROWS", batch)
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(0, 0.05, 32).tolist(), rng.choice(["a", "b", None])) for i in rng.permutation(90)]
    rows += [(500 + i, rows[7][1], "hot") for i in range(60)]  # copies
    rows += [(700, None, "a"), (701, [float("nan")] * 32, "a"), (702, [None] + [0.1] * 31, "b"), (703, [float("inf")] * 32, "b"),
             (704, [0.0] * 32, None), (None, [0.5] * 32, None), (None, rows[0][1], "a"), (3, rows[1][1], "a"),
             (800, [0.1] * 20, "other"), (801, [0.3] * 20, "other"), (802, [], "other"), (803, [0.25] * 3, None)]
    rows += [rows[5], rows[5]]
    found, books = trie_codes.compress(table(spark, rows), entries=8)
    expected, plain_books = plain(rows, entries=8)
    got = found.collect()
    assert sorted([(r["vec_id"], r["label"], bytes(r["code"]), r["error"]) for r in got], key=repr) == expected
    for label in {r["label"] for r in got}:
        own = [r for r in got if r["label"] == label]
        assert {r["label_error"] for r in own} == {sum(r["error"] for r in own)}
    for dim, book in books.items():
        assert [book[:, a:b].tolist() for a, b in trie_codes.cuts(dim)] == plain_books[dim]
    text = ",".join(str(x) for dim in sorted(books) for part in plain_books[dim] for entry in part for x in entry)
    assert trie_codes.digest(books) == hashlib.sha256(text.encode()).hexdigest()
    back = trie_codes.decode(found.where("label = 'hot'"), books, 32).collect()
    code = next(bytes(r["code"]) for r in got if r["label"] == "hot")
    stands_for = [x / 256 for p, (a, b) in enumerate(trie_codes.cuts(32)) for x in books[32][code[p], a:b].tolist()]
    assert len(back) == 60 and all(r["approximate"] == stands_for for r in back)


def test_few_rows_and_none(spark):
    assert trie_codes.compress(table(spark, []))[0].collect() == []
    assert trie_codes.compress(table(spark, [(1, None, "a")]))[0].collect() == []
    rows = [(2, [0.5] * 16, None), (1, [0.25] * 16, None)]
    found, books = trie_codes.compress(table(spark, rows))
    assert sorted((r["vec_id"], bytes(r["code"]), r["error"], r["label_error"]) for r in found.collect()) \
        == [(1, bytes(16), 0, 0), (2, bytes([1] * 16), 0, 0)]
    assert books[16].tolist() == [[64] * 16, [128] * 16]


def test_bounds(spark):
    with pytest.raises(ValueError):
        trie_codes.train(table(spark, []), entries=257)
    with pytest.raises(Exception, match="64 bits"):
        trie_codes.compress(table(spark, [(1, [1e9] * 16, "a")]))
