"""SimHash groups against a vote and a pairwise comparison written out plainly."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkmail.llm import graph, simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_print(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    """Smallest id reachable for each place of prints, a list of (id, fingerprint)."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {g: [prints[i][0] for i in range(len(prints)) if group[i] == g and prints[i][0] is not None] for g in set(group)}
    return [min(ids[g], default=None) for g in group]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("width", [1, 3, 5])
def test_prints(spark, width):
    rng = random.Random(3)
    words = ["Alpha", "beta", "ÄRGER", "straße", "x", "é", " nbsp", " ", "KK"]
    texts = ["", None, " \t\n", "one", "ONE two", "a b c", "a  b\tc\x0b\x0cd\r\n"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(40)]
    found = simhash.fingerprints(docs(spark, enumerate(texts)), width=width).collect()
    assert {r[0]: r[1] % 2**64 for r in found} == {i: plain_print(t, width) for i, t in enumerate(texts)}


def test_long_text_is_counted_whole(spark):
    text = " ".join(f"w{i % 9000}" for i in range(200_000))
    found = simhash.fingerprints(docs(spark, [(1, text)])).first()
    assert found[1] % 2**64 == plain_print(text, 3)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_keep_every_group(spark, radius):
    rng = random.Random(radius)
    centres = [0, 2**64 - 1, *(rng.getrandbits(64) for _ in range(25))]
    prints = list(dict.fromkeys(c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))})
                                for c in centres for _ in range(12)))
    signed = [(x - 2**64 if x >> 63 else x,) for x in prints]
    links = simhash.links(spark.createDataFrame([*signed, (None,)], "fp long"), radius).collect()
    assert all(0 < (a ^ b).bit_count() <= radius for a, b in ((r[0] % 2**64, r[1] % 2**64) for r in links))
    table = spark.createDataFrame(links, "hub long, fp long") if links else spark.createDataFrame([], "hub long, fp long")
    group = {r.node % 2**64: r.component for r in graph.connected_components(table, "hub", "fp").collect()}
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                assert group[a] == group[b]


def test_groups(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choices("red green blue black white grey".split(), k=200)) for _ in range(8)]
    rows = [(i, rng.choice(base) + rng.choice(["", " end", " x y", " RED"])) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "  "), (5, rows[5][1]), (None, rows[7][1]), (None, "alone here"), (70, "Same"), (69, "same")]
    found = simhash.simhash_groups(docs(spark, rows)).collect()
    prints = [(i, plain_print(t, 3)) for i, t in rows]
    expected = [(i, p, c) for (i, p), c in zip(prints, plain_groups(prints, 3))]
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in found), key=repr) == sorted(expected, key=repr)


def test_keep_first(spark):
    rows = [(4, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "quite other words here"), (None, "a b c d")]
    rows += [(1, "one text"), (1, "another text with this id"), *[(None, "nobody named this one")] * 5, (None, None), (None, "")]
    kept = simhash.keep_first(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    found = sorted(((r[0], r[1] or "") for r in kept.collect()), key=repr)
    assert found == sorted([(2, "a b c d"), (9, "quite other words here"), (1, "one text"), (1, "another text with this id"),
                            (None, "nobody named this one"), (None, "")], key=repr)


def test_keep_first_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c", "x", "y", 5), (2, "a b c", "z", None, 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, key string, row string, none int")
    assert [tuple(r) for r in simhash.keep_first(table).collect()] == [rows[0]]


def test_empty_table(spark):
    assert simhash.simhash_groups(docs(spark, [])).collect() == []
    assert simhash.keep_first(docs(spark, [])).collect() == []


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 2000 + i) for i in range(300)]
    odd = [(7, 7), (None, 3), (500, None)]
    found = graph.connected_components(spark.createDataFrame(path + star + odd, "a long, b long"), "a", "b")
    group = {r.node: r.component for r in found.collect()}
    assert group == {**{i: 0 for i in range(41)}, 1000: 1000, **{2000 + i: 1000 for i in range(300)}}
    assert found.agg(F.count("*")).first()[0] == len(group)
