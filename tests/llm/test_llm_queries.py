"""Registered queries on the given tables: columns, whole results, SQL, and the pipeline against plain models."""

import hashlib
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F
from test_simhash import plain_groups, plain_print

import __spark_entry__ as spark_entry
import corpus_pipeline
from sparkmail.llm import mixing, queries, secret_scan

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

COLUMNS = {
    "op1_spotsigs": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2_secrets": "doc_id place core_sha256 n_chars score is_secret held_out",
    "op3_mix": "doc_id size source_size target taken",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_langid": "doc_id held_out lang_pred score",
    "op7_embeddings": "vec_id n_links component_id kept",
    "op8_quality": "doc_id held_out score predicted",
    "op9_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op11_trie_codes": "vec_id code error label_error codebooks_sha256",
    "op12_prefix_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13_fill_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
}


def test_all_are_registered():
    assert COLUMNS.keys() | {"pipeline"} == queries.REGISTRY.keys() <= spark_entry.queries().keys()
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    found = queries.REGISTRY[name](spark, SF)
    assert found.columns[:len(COLUMNS[name].split())] == COLUMNS[name].split()
    rows = found.collect()
    given = "embeddings" if name.startswith(("op7", "op11")) else "pages" if name.startswith("op10") else "documents"
    table = spark.read.parquet(f"{SF}/{given}.parquet")
    ids = sorted(r[0] for r in table.select(found.columns[0]).collect())
    if name == "op2_secrets":
        assert {r[0] for r in rows} <= set(ids)
    else:
        assert sorted(r[0] for r in rows) == ids
    if "held_out" in found.columns:
        assert all(r["held_out"] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    if "score" in found.columns:
        assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in cursor.description)
    found = queries.REGISTRY[name](spark, SF)
    assert sorted(found.columns) == columns
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    expected = sorted(repr([r[i] for i in order]) for r in cursor.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in found.collect()) == expected


def test_pipeline(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from sparkmail.llm import bpe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "SimHash near-dedup", "secret scans", "mixing sources to target weights",
                           "BPE encoding and decoding"]
    after = {}
    for name, step in steps.items():
        path = spark.conf.get("spark.checkpoint.dir") + "/pipeline-test-" + name.split()[0]
        step(spark, docs, SF).write.mode("overwrite").parquet(path)
        after[name] = spark.read.parquet(path)
        if name != "BPE encoding and decoding":
            assert after[name].columns == docs.columns
        docs = after[name]
    texts = {k: {r["doc_id"]: r["text"] for r in v.collect()} for k, v in after.items() if "text" in v.columns}

    scores = {r["doc_id"]: r["predicted"] for r in queries.REGISTRY["op8_quality"](spark, SF).collect()}
    good = texts["quality classifier"]
    assert good.keys() == {k for k, v in scores.items() if v}

    prints = [(i, plain_print(t, 3)) for i, t in good.items()]
    assert texts["SimHash near-dedup"].keys() == {i for (i, _), c in zip(prints, plain_groups(prints, 3)) if i == c}

    masked = texts["secret scans"]
    key = re.compile(r'token = "([0-9a-f]{40})"')
    for i, text in texts["SimHash near-dedup"].items():
        assert masked[i] == key.sub(lambda m: f'token = "{secret_scan.MASK}"', text)

    copies = {}
    for r in after["mixing sources to target weights"].select("doc_id", "text", "source").collect():
        assert r["text"] == masked[r["doc_id"]]
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    size = {i: len(re.findall(mixing.WORD, t or "")) for i, t in masked.items()}
    source = {r["doc_id"]: r["source"] for r in after["secret scans"].select("doc_id", "source").collect()}
    sums = {}
    for i, s in source.items():
        sums[s] = sums.get(s, 0) + size[i]
    for s, target in mixing.water_fill(sums).items():
        own = [i for i in source if source[i] == s]
        taken = sum(copies.get(i, 0) * size[i] for i in own)
        assert abs(taken - target) <= max(size[i] for i in own) / 2 + 1e-6

    tokenizer = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    encoded = after["BPE encoding and decoding"].collect()
    assert len(encoded) == sum(copies.values())
    for r in encoded:
        ids = tokenizer.encode(masked[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(masked[r["doc_id"]].encode()).hexdigest()

    run = corpus_pipeline.run(spark, SF)
    digest = lambda df: sorted(map(tuple, df.select("doc_id", "ids_sha256").collect()))
    assert digest(run) == digest(after["BPE encoding and decoding"])
    assert run.agg(F.count("*")).first()[0] == len(encoded)
