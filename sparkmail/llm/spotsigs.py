"""SpotSigs: fingerprints from chains of content words that follow common words.

Every place of an anchor (a common word of one of several languages) gives a signature: the anchor with the next CHAIN
words that are no anchors. A text's fingerprint is its set of signatures. Sets are compared by Jaccard likeness. For near
duplicates only sets of similar length can be alike enough, so sets are partitioned by length, meet in their rarest
signatures only, and are verified. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmail.llm.common import stage

CHAIN = 3
#: Common words of English, French, German and Spanish, by language.
ANCHORS = sorted({*"""
a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this
to was were which will with you
au aux avec ce ces dans de des du elle en et il la le les leur mais ne par pas pour que qui sa se ses son sur un une
als auch auf aus bei das dass dem den der des die ein eine einen einer es für ich im ist mit nach nicht sich sie so um
und von war wie zu zum zur
al como con cuando del el ella esta este ha las lo los más me mi muy no para pero por si sin sobre su también te todo
una uno y ya
""".split()})

_SPACED = r"[^\p{L}\p{N}]+"


def signatures(text: Column, chain: int = CHAIN) -> list[tuple[str, Column]]:
    """Steps, as (name, expression), that end in `_sigs`: the sorted distinct hashes of the signatures of `text`.

    An anchor at place i, the k-th of the text, has i - k content words before it, which is where its chain starts. A text
    without a whole chain has one signature, the hash of all its words, so that equal texts are alike and others are not.
    """
    word = F.col("_words")
    is_anchor = lambda w: w.isin(ANCHORS)
    places = F.filter(F.transform(word, lambda w, i: F.when(is_anchor(w), F.struct(w.alias("w"), i.alias("i")))),
                      lambda s: s.isNotNull())
    start = lambda s, k: s["i"] - k + 1
    chains = F.transform(F.col("_spots"), lambda s, k: F.when(
        start(s, k) + (chain - 1) <= F.size("_content"), F.xxhash64(s["w"], F.slice("_content", start(s, k), chain))))
    found = F.sort_array(F.array_distinct(F.array_compact(chains)))
    return [
        ("_words", F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACED), "")),
        ("_spots", places),
        ("_content", F.filter(word, lambda w: ~is_anchor(w))),
        ("_found", found),
        ("_sigs", F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(F.xxhash64(F.lit("whole"), word)))),
    ]


def with_signatures(df: DataFrame, text: Column, name: str = "sigs", chain: int = CHAIN) -> DataFrame:
    """df and the signature set of `text` as column `name`."""
    before = df.columns
    for step, expression in signatures(text, chain):
        df = df.withColumn(step, expression)
    return df.select(*before, F.col("_sigs").alias(name))


def fingerprint(sigs: Column) -> Column:
    """The set in short: its length and a hash of its members; equal sets have equal fingerprints."""
    return F.concat(F.size(sigs).cast("string"), F.lit("-"), F.lower(F.lpad(F.hex(F.xxhash64(sigs)), 16, "0")))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets. With `least`, sets whose lengths alone rule it out are not compared and give 0."""
    common = F.size(F.array_intersect(a, b))
    value = common / (F.size(a) + F.size(b) - common)
    if not least:
        return value
    return F.when(F.least(F.size(a), F.size(b)) >= least * F.greatest(F.size(a), F.size(b)), value).otherwise(0.0)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8,
                    chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of classes that are at least `least` alike, and the class of each row (id_col, class).

    A class is a set of signatures, named by its smallest id; rows with equal sets are never paired one by one. Two sets
    that are alike enough share one of their rarest signatures: of a set of n, one among the first n - ceil(least x n) + 1
    in order of frequency. Sets meet there, in neighbouring partitions of set length, and only if their lengths allow the
    likeness. Null text counts as empty. Rows with a null id have a class but name none.
    """
    sets = with_signatures(docs.select(id_col, text_col), F.col(text_col), "sigs", chain).select(id_col, "sigs")
    sets = stage(sets, "spotsigs")
    classes = stage(sets.where(F.col(id_col).isNotNull()).groupBy("sigs").agg(F.min(id_col).alias("class")), "spotsigs-classes")
    members = sets.join(classes, "sigs", "left").select(id_col, "class")
    spread = classes.select("class", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    counts = spread.groupBy("sig").agg(F.count("*").alias("seen"))
    ranked = spread.join(counts, "sig").groupBy("class", "n") \
        .agg(F.array_sort(F.collect_list(F.struct("seen", "sig"))).alias("order"))
    prefix = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    rarest = ranked.select("class", "n", F.explode(F.slice("order", F.lit(1), prefix.cast("int"))).alias("s")) \
        .select("class", "n", F.col("s.sig").alias("sig"), F.floor(F.log(F.col("n")) / -F.log(F.lit(least))).alias("part"))
    left = rarest.select(F.col("class").alias("a"), F.col("n").alias("n_a"), "sig",
                         F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    right = rarest.select(F.col("class").alias("b"), F.col("n").alias("n_b"), "sig", "part")
    met = left.join(right, ["part", "sig"]).where((F.col("a") < F.col("b"))
                                                  & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))) \
        .select("a", "b").distinct()
    pairs = met.join(classes.select(F.col("class").alias("a"), F.col("sigs").alias("x")), "a") \
        .join(classes.select(F.col("class").alias("b"), F.col("sigs").alias("y")), "b") \
        .select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).where(F.col("likeness") >= least)
    return pairs, members


KNOTS = 256  # quantiles of the id that blocks are laid between
BLOCK_ROWS = 512
MAX_BLOCKS = 65_536


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, text, next_text and the block order: the next row is the next smaller id, the first after the last.

    Ids must be numbers; null ids come after all others, rows with equal ids in the order of their text's hash. Rows are
    dealt into blocks of about BLOCK_ROWS consecutive ids, at most MAX_BLOCKS blocks; one small table has the first row of
    each block, which is sent to the block before it as well. So each text is shuffled once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")) \
        .withColumn("tie", F.xxhash64("text"))
    shape = rows.agg(F.count("*").alias("n"), F.percentile_approx(
        "id", [k / KNOTS for k in range(KNOTS + 1)], 10_000).alias("knots")).first()
    knots = sorted(set(shape["knots"] or [0]), reverse=True)
    parts = max(1, min(MAX_BLOCKS, shape["n"] // BLOCK_ROWS) // KNOTS + 1)
    segment = F.size(F.filter(F.array(*[F.lit(k) for k in knots]), lambda k: k > F.col("id")))  # knots above the id
    top = F.get(F.array(*[F.lit(float(k)) for k in knots]), segment - 1)
    bottom = F.get(F.array(*[F.lit(float(k)) for k in knots]), segment)
    inside = F.floor((top - F.col("id")) / (top - bottom) * parts)
    inside = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.coalesce(inside, F.lit(0))))
    last = (len(knots) + 2) * parts
    block = F.when(F.col("id").isNull(), last).otherwise(segment * parts + inside).cast("long")
    rows = rows.withColumn("block", block)
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")
    heads = rows.groupBy("block").agg(F.max(order).alias("head")).orderBy("block").collect()  # MAX_BLOCKS and some at most
    before = [(h["block"], heads[k - 1]["block"], h["head"]["id"], h["head"]["tie"]) for k, h in enumerate(heads)]
    id_type = rows.schema["id"].dataType
    targets = docs.sparkSession.createDataFrame(before, T.StructType([
        T.StructField("block", T.LongType()), T.StructField("target", T.LongType()), T.StructField("head_id", id_type),
        T.StructField("head_tie", T.LongType())]))
    is_head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    places = F.array_compact(F.array(
        F.struct(F.lit(False).alias("copy"), F.col("block").alias("at")),
        F.when(is_head, F.struct(F.lit(True).alias("copy"), F.col("target").alias("at")))))
    return rows.join(F.broadcast(targets), "block") \
        .select("id", "text", "tie", F.explode(places).alias("place")) \
        .select("id", "text", "tie", "place.copy", F.col("place.at").alias("block"))


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """A row per input row: id_col, n_chars, sigs, edited, edited_sigs, next_sigs.

    edited is the text with its last half replaced by as many characters of the next document (see neighbours), or all of
    them. Null text counts as empty. Repeated rows give a row each. An empty table gives no rows. Other columns are not
    read.
    """
    from pyspark.sql import Window as W

    placed = with_signatures(neighbours(docs, id_col, text_col), F.col("text"), "sigs", chain)
    order = W.partitionBy("block").orderBy("copy", F.col("id").desc_nulls_last(), F.col("tie").desc())
    rows = placed.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sigs", F.lead("sigs").over(order)) \
        .where(~F.col("copy"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    return with_signatures(rows, F.col("edited"), "edited_sigs", chain) \
        .select(F.col("id").alias(id_col), "n_chars", "sigs", "edited", "edited_sigs", "next_sigs")
