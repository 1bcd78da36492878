"""The registered query of each operator, with production parameters over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sparkmail.llm import (
    bpe, fill_middle, hnsw, langid, licenses, mixing, prefix_bpe, quality, secret_scan, simhash, spotsigs, trie_codes, warc,
)
from sparkmail.llm.common import held_out, stage, table
from sparkmail.session import staging_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.fingerprint_table(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its score; the token itself only as a hash."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit_by_rule(docs))
    return found.select("doc_id", "place", F.sha2("core", 256).alias("core_sha256"), F.length("core").alias("n_chars"),
                        "score", "is_secret", held_out("doc_id").alias("held_out"), "run")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "source", "copies")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), width=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.sample(docs)
    net = langid.train(samples) if samples else None
    return langid.predict(docs, net).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))
    return groups.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    scored = quality.score(stats, quality.fit(stats, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(licenses.scan(table(spark, sf_dir, "documents"))).drop("found")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = staging_path(spark, "llm-warc")
    warc.write(pages, path)
    kind = pages.schema["page_id"].dataType
    return warc.read(spark, path).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


def op11_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = trie_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                        F.lit(trie_codes.digest(books)).alias("codebooks_sha256"))


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = prefix_bpe.decode(prefix_bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


REGISTRY: dict[str, Query] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_secrets": op2_secrets,
    "op3_mix": op3_mix,
    "op4_simhash": op4_simhash,
    "op5_bpe": op5_bpe,
    "op6_langid": op6_langid,
    "op7_embeddings": op7_embeddings,
    "op8_quality": op8_quality,
    "op9_licenses": op9_licenses,
    "op10_warc": op10_warc,
    "op11_trie_codes": op11_trie_codes,
    "op12_prefix_bpe": op12_prefix_bpe,
    "op13_fill_middle": op13_fill_middle,
    "pipeline": corpus_pipeline.run,
}

def _assigned(k: int) -> str:
    """SQL of vector codes: a{k} gives each distinct part its nearest of the entries b{k}."""
    return f"""a{k} AS MATERIALIZED (
            SELECT p, part, n, min({{'d': list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))),
                                     'e': e}}) AS best
            FROM dist JOIN b{k} USING (p) GROUP BY p, part, n),"""


def _entries(k: int) -> str:
    """SQL of vector codes: b{k + 1} has the entries after a{k}."""
    return f"""m{k} AS (SELECT p, best.e AS e, i, sum(part[i] * n) AS s, sum(n) AS n
                 FROM a{k}, unnest(range(1, len(part) + 1)) AS u(i) GROUP BY p, best.e, i),
        b{k + 1} AS MATERIALIZED (
            SELECT p, e, coalesce(m.c, b{k}.c) AS c
            FROM b{k} LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
                                 FROM m{k} GROUP BY p, e) AS m USING (p, e)),"""


#: What SQL can say whole. Archives: eight groups of five hexadecimal digits make four base32 digits each.
ORACLE_SQL: dict[str, str] = {
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT)
                         >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER) + 1, 1) for i in range(0, 32)], '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op11_trie_codes": f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (
            SELECT vec_id, label, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS part
            FROM kept, unnest(range(16)) AS u(p)),
        dist AS MATERIALIZED (SELECT p, part, count(*) AS n FROM parts GROUP BY p, part),
        b0 AS MATERIALIZED (
            SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS c FROM parts
            WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
        {_assigned(0)}
        {_entries(0)}
        {_assigned(1)}
        {_entries(1)}
        {_assigned(2)}
        coded AS (
            SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d) AS error
            FROM parts JOIN a2 USING (p, part) GROUP BY vec_id, label)
        SELECT vec_id, code, CAST(error AS BIGINT) AS error,
               CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
        FROM coded""",
    "op13_fill_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
        u AS (SELECT *, string_split(t, chr(10)) AS l, len(string_split(t, chr(10))) - (t = '' OR ends_with(t, chr(10)))::INT AS n,
                     [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) for k in range(0, 4)] AS r FROM d),
        c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b FROM u),
        s AS (SELECT *, array_to_string(l[1:a], chr(10)) || CASE WHEN a > 0 AND a < len(l) THEN chr(10) ELSE '' END AS prefix,
                     array_to_string(l[1:b], chr(10)) || CASE WHEN b > 0 AND b < len(l) THEN chr(10) ELSE '' END AS upto,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100
                          THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
        p AS (SELECT *, substr(upto, length(prefix) + 1) AS middle, substr(t, length(upto) + 1) AS suffix FROM s)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
