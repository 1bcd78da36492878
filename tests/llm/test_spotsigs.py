"""SpotSigs against plain sets."""

import bisect
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkmail.llm import spotsigs

SCHEMA = "doc_id long, text string, id string, tie string, block string, sigs string, copy string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "c", "c", "c", "c", "c") for i, t in rows], SCHEMA)


def plain(text, chain=spotsigs.CHAIN):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    content = [(i, w) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    found, places = set(), [i for i, _ in content]
    for i, w in enumerate(words):
        at = bisect.bisect_right(places, i)
        after = [c for _, c in content[at:at + chain]]
        if w in spotsigs.ANCHORS and len(after) == chain:
            found.add((w, *after))
    return found or {("whole", *words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def expected(rows):
    """Rows in order of descending id; each with its edited text and likenesses."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(plain(text), plain(edited)),
                    jaccard(plain(text), plain(after))))
    return sorted(out)


def found(table):
    rows = spotsigs.fingerprint_table(table)
    picked = rows.select("doc_id", "n_chars", F.sha2("edited", 256), spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")),
                         spotsigs.likeness(F.col("sigs"), F.col("next_sigs")))
    return sorted(tuple(r) for r in picked.collect())


def some_texts(n, seed=1):
    rng = random.Random(seed)
    words = "The a of and river stone Éclair ünder token 42 the le de und".split()
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))) + rng.choice(["", ".", "\n🙂 the end of it all"]) for _ in range(n)]


@pytest.mark.parametrize("block_rows", [2, 512])
def test_table(spark, monkeypatch, block_rows):
    monkeypatch.setattr(spotsigs, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(spotsigs, "KNOTS", 8)
    texts = [None, "", "no anchors", "🙂", "x", "the " * 9] + some_texts(120)
    ids = random.Random(2).sample([*range(-50, 50), *range(10**6, 10**6 + 60), 2**53 + 1, -(2**60)], len(texts))
    rows = list(zip(ids, texts))
    assert found(docs(spark, rows)) == expected(rows)


def test_few_rows(spark):
    assert found(docs(spark, [])) == []
    for rows in ([(5, "the one two three")], [(5, "the one two three"), (2, "an apple pie here")]):
        assert found(docs(spark, rows)) == expected(rows)


def test_repeated_ids_and_null_ids(spark):
    rows = [(1, "the a b c"), (1, "the a b c"), (1, "of other words here"), (None, "the null one is last"), (None, None), (9, "x")]
    table = spotsigs.fingerprint_table(docs(spark, rows)).collect()
    assert sorted(map(repr, (r["doc_id"] for r in table))) == sorted(map(repr, (i for i, _ in rows)))
    assert all(r["next_sigs"] is not None and r["edited"] is not None for r in table)


def test_very_long_text(spark):
    text = "the quick brown fox of old " * 40_000
    assert found(docs(spark, [(1, text), (0, "short")])) == expected([(1, text), (0, "short")])


def test_equal_texts_have_equal_fingerprints(spark):
    rows = spotsigs.fingerprint_table(docs(spark, [(1, "the a1 b1 c1 of d1"), (2, "the a1 b1 c1 of d1"), (3, "zzz"), (4, "zzz"), (5, "yyy")]))
    prints = {r[0]: r[1] for r in rows.select("doc_id", spotsigs.fingerprint(F.col("sigs"))).collect()}
    assert prints[1] == prints[2] and prints[3] == prints[4] and len(set(prints.values())) == 3


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows = []
    for group in range(12):
        words = [rng.choice(["the", "of", "and", *(f"w{rng.randrange(4000)}" for _ in range(3))]) for _ in range(200)]
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(200)] = f"n{rng.randrange(999)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, rows[0][1]), (501, None), (502, ""), (None, rows[3][1])]
    pairs, members = spotsigs.near_duplicates(docs(spark, rows))
    sets = {i: frozenset(plain(t)) for i, t in rows if i is not None}
    first = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    assert {r[0]: r[1] for r in members.collect() if r[0] is not None} == {i: first[s] for i, s in sets.items()}
    wanted = {(a, b) for a in first.values() for b in first.values() if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    assert wanted and {(r[0], r[1]) for r in pairs.collect()} == wanted


def test_pruned_likeness(spark):
    row = spark.range(1).select(
        spotsigs.likeness(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)), 0.5),
        spotsigs.likeness(F.array(F.lit(1)), F.array(*map(F.lit, range(1, 9))), 0.5)).first()
    assert (row[0], row[1]) == (1 / 3, 0.0)
