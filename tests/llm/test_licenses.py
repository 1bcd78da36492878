"""Templates by hand, base phrases against a plain search."""

import random
import re

import pytest

from sparkmail.llm import licenses

SCHEMA = "doc_id long, text string, base string, found string, n_words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)


def automaton(text):
    return licenses.Automaton("x", text).compile()


def accepted(text, words):
    a = automaton(text)
    words = words.split()
    return a.matches([w.encode() for w in words], f" {' '.join(words)} ".encode())


@pytest.mark.parametrize("template, words, places", [
    ("a b", "x a b a b", [(1, 3), (3, 5)]),
    ("a b", "a x b", []),
    ("a [[b]] c", "a c a b c a b b c", [(0, 2), (2, 5)]),
    ("a {{2}} c", "a c a x c a x y c a x y z c", [(0, 2), (2, 5), (5, 9)]),
    ("a [[b [[c]] d]] e", "a e a b d e a b c d e a b e", [(0, 2), (2, 6), (6, 11)]),
    ("[[a]] b [[c]]", "a b c b", [(0, 3), (3, 4)]),
    ("a {{3}} a", "a a a", [(0, 3)]),
    ("a [[{{1}} b]] c", "a c a x b c a b c", [(0, 2), (2, 6), (6, 9)]),
])
def test_templates(template, words, places):
    assert accepted(template, words) == places


def test_automata_against_regular_expressions():
    rng = random.Random(2)
    forms = {"a [[b]] c": r"a (b )?c", "a {{2}} c [[d]]": r"a (\w )?(\w )?c( d)?", "[[a b]] c {{1}} d": r"(a b )?c (\w )?d"}
    for template, form in forms.items():
        for _ in range(400):
            words = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
            whole = automaton(template).longest([w.encode() for w in words], 0)
            longest = max((n for n in range(1, len(words) + 1) if re.fullmatch(form, " ".join(words[:n]))), default=None)
            assert whole == longest, (template, words)


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def test_base(spark):
    rng = random.Random(8)
    pool = ["cc", "by", "CC BY", "general", "public", "license", "License", "all", "rights", "reserved.", "É", "x-y", "\n", "é2", "ſ"]
    texts = [None, "", " . ", "CC-BY", "cc by cc by", "All Rights Reserved", "all rights\x00reserved", "ALL RIGHTS RESERVEDÉ"]
    texts += [" ".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(200)]
    texts += ["cc by " * 30_000]
    rows = list(enumerate(texts)) + [(4, texts[4]), (None, "cc by")]
    found = licenses.summarise(licenses.scan(docs(spark, rows))).collect()
    expected = [(i, *plain(t)) for i, t in rows]
    assert sorted((tuple(r[:6]) for r in found), key=repr) == sorted(expected, key=repr)
    for r in found:
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-versioned"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
     "License, or (at your option) any later version", "gpl,gpl-versioned"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("Copyright 2020 Some Person. All rights reserved.", "copyright-notice,reserved"),
    ("Copyright one two three four five six seven eight nine all rights reserved", "reserved"),
    ("under the MIT-like license", ""),
])
def test_labels(spark, text, labels):
    row = licenses.summarise(licenses.scan(docs(spark, [(1, text)]))).first()
    assert row["labels"] == labels


def whole(label):
    """The longest template of a label as a text: optional regions as they stand, a holder for what may be replaced."""
    text = max(licenses.TEMPLATES[label], key=len)
    return re.sub(r"\{\{\d+\}\}", "Acme Works", re.sub(r"\[\[|\]\]", "", text))


WHOLE = ["0bsd", "apache-2.0-notice", "bsd-2-clause", "bsd-3-clause", "gpl-notice", "isc", "mit", "zlib"]


def labels_of(spark, texts):
    found = licenses.summarise(licenses.scan(docs(spark, list(enumerate(texts))))).collect()
    return [set(r["labels"].split(",")) - {""} for r in sorted(found, key=lambda r: r["doc_id"])]


def test_whole_licenses(spark):
    texts = [f"Some words. {whole(label).upper()} More words." for label in WHOLE]
    for label, found in zip(WHOLE, labels_of(spark, texts)):
        assert {x for x in WHOLE if x in found} == {label}


def test_a_changed_license_is_not_labelled(spark):
    """Any mandatory word left out, or a word put in anywhere between them, and the text is no longer that licence."""
    rng = random.Random(3)
    texts, of = [], []
    for label in WHOLE:
        words = whole(label).split()
        gap = next(i for i in range(len(words) // 2, len(words)) if "Acme" not in words[i - 7:i + 8]
                   and not {"1", "2", "3"} & set(words[i - 1:i + 2]))
        for changed in (words[:gap] + words[gap + 1:], words[:gap] + ["never"] + words[gap:], words[:len(words) // 3],
                        words[:gap] + ["except", "commercially"] + words[gap:], words[:-1], words[rng.randint(2, 5):]):
            texts.append(" ".join(changed))
            of.append(label)
    assert not [(label, found) for label, found in zip(of, labels_of(spark, texts)) if label in found]


def test_openings_with_other_conditions(spark):
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, except that commercial use is "
        "forbidden.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: you pay us.",
    ]
    assert labels_of(spark, texts) == [set(), set()]


def test_empty_table(spark):
    assert licenses.summarise(licenses.scan(docs(spark, []))).collect() == []
