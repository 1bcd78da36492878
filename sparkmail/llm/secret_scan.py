"""Secret scans: a random forest keeps the findings that are secrets and drops the false positives.

A candidate is a long run of characters within a word, with a digit; a word can hold several. Its features are its length, how often the kind of character
changes, how much of it the most frequent words of the corpus cover, whether it looks like a path, and whether neighbouring
words speak of keys. The forest learns from labelled findings and becomes one expression, so a scan is a projection of
whole texts: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmail.llm.common import remainder, stage

LEAST_CHARS = 16
FEATURES = ("length", "changes", "digits", "hex", "coverage", "path", "address", "keyword", "assigned", "quoted",
            "issued", "named")
TREES, DEPTH = 25, 8
EXAMPLES = 240  # findings that examples() writes of each kind
LEAST_SCORE = 0.5
MASK = "[secret]"

_SPACE = r"[\x09-\x0D\x20]+"
_PIECE = r"(?<=[\x09-\x0D\x20])(?![\x09-\x0D\x20])"  # cuts as _SPACE does and leaves the white space with the word before
_CHAR = r"[A-Za-z0-9+/_.~\-]"
#: A long run with its padding, or a shorter one; shorter ones that are joined by = count as one. Only a long run is tried
#: for itself, so the name before a long value is no part of it.
_RUN = (rf"{_CHAR}{{{LEAST_CHARS},}}(?:={{1,2}}(?![A-Za-z0-9+/_.~\-=\"'`]))?"
        rf"|{_CHAR}{{1,{LEAST_CHARS - 1}}}(?:=+{_CHAR}{{0,{LEAST_CHARS - 1}}}){{0,8}}(?!{_CHAR})")
_FIELD = r"[^,;&?{}|]*"
_KEYWORD = r"(?i)(?:api|access|auth|private|client|secret|session)?[_-]?(?:key|token|secret|passw(?:or)?d|passwd|pwd|credential|bearer)s?"
#: Well known forms of issued credentials; they label a finding, whatever stands around it.
_ISSUED = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)(?![A-Za-z0-9])"
#: The name of a key, an assignment, and a value of any length.
_NAME = (r"(?<![A-Za-z0-9+/_.~\-])(?:(?i:(?:[a-z0-9+/_.~\-]*[+/_.~\-])?(?:api|access|auth|private|client|secret|session)?"
         r"(?:key|token|secret|passw(?:or)?d|passphrase|pwd|credential|bearer)s?)"
         r"|[A-Za-z0-9+/_.~\-]*[a-z0-9](?:Key|Token|Secret|Passw(?:or)?d|Passphrase|Pwd|Credential)s?)")
_QUOTE = r"\\*[\"'`]?"
_ASSIGN = r"(?:=>|:=|=(?!=)|:(?!:|//))"
_VALUE = r"""(?:(?<=")[^"]*[^"\\]|(?<=')[^']*[^'\\]|(?<=`)[^`]+|(?<!["'`])[^"'`,;&]*[^"'`,;&)\]}>])"""
_PASSWORD = r"(?i)passw(?:or)?d|passphrase|pwd"
_STRONG = _PASSWORD + "|secret|credential"
_ADDRESS = r"(?i)@|^https?:|^www\.|\.(?:com|org|net|html?)\b"
_PATH = r"(?:/[A-Za-z0-9_.\-]+){2,}|\.[a-z]{1,4}$"
DICTIONARY_WORDS = 1000  # the most frequent words of the corpus, of so many letters, are the dictionary
DICTIONARY_LETTERS = (3, 12)
#: Words of examples where the corpus has no dictionary.
_WORDS = ("garden", "window", "letter", "station", "river", "market", "winter", "bridge")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once and not at each place that it is used at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), _SPACE)


def _head(words: Column, i: Column) -> Column:
    """Whether word i begins with a value, or an assignment and a value, of the name of a key in the words before."""
    word = lambda k: F.coalesce(F.get(words, k), F.lit(""))
    before, w = word(i - 1), F.get(words, i)
    return (before.rlike("[=:>]$") & (before.rlike(f"{_NAME}{_QUOTE}{_ASSIGN}$")
                                      | before.rlike(f"^{_ASSIGN}$") & word(i - 2).rlike(f"{_NAME}{_QUOTE}$"))) \
        | (w.rlike("^[=:]") & before.rlike(f"{_NAME}{_QUOTE}$"))


def _parts(words: Column, i: Column) -> Column:
    """Word i cut at its runs and named values: text between them and they in turn. No word holds a line feed."""
    rest = f"({_NAME}{_QUOTE}{_ASSIGN}{_QUOTE})({_VALUE})|({_RUN})"
    cut = lambda pattern, by: F.regexp_replace(F.get(words, i), pattern, by)
    return F.split(F.when(_head(words, i), cut(f"^({_ASSIGN}?+{_QUOTE})(?![=:>])({_VALUE})|{rest}", "$1$3\n$2$4$5\n"))
                   .otherwise(cut(rest, "$1\n$2$3\n")), "\n")


def _interesting(words: Column, i: Column) -> Column:
    w = F.get(words, i)
    return w.rlike("[=:]") | ((F.length(w) >= LEAST_CHARS) & w.rlike("[0-9]")) | w.rlike(_ISSUED) | _head(words, i)


def _found(words: Column, i: Column, parts: Column) -> Column:
    """Array of the candidates among the runs of word i."""
    at = lambda k: F.coalesce(F.when(k >= 0, F.get(parts, k)), F.lit(""))
    word = lambda k: F.coalesce(F.get(words, k), F.lit(""))

    def one(core: Column, k: Column) -> Column:
        ahead = F.concat(at(k - 3), at(k - 2), at(k - 1))
        lead = F.regexp_extract(ahead, f"{_FIELD}$", 0)
        tail = F.regexp_extract(F.concat(at(k + 1), at(k + 2)), f"^{_FIELD}", 0)
        named = at(k - 1).rlike(f"{_NAME}{_QUOTE}{_ASSIGN}{_QUOTE}$") \
            | ((k == 1) & at(k - 1).rlike(f"^{_ASSIGN}?{_QUOTE}$") & _head(words, i))
        long = (F.length(core) >= LEAST_CHARS) & core.rlike("[0-9]")
        return F.when((k % 2 == 1) & (F.length(core) > 0) & (long | core.rlike(_ISSUED) | named), F.struct(
            named.alias("named"),
            i.cast("long").alias("place"), F.floor(k / 2).cast("long").alias("run"), core.alias("core"), word(i).alias("token"),
            lead.alias("lead"), F.concat(lead, core, tail).alias("field"),
            ((k <= 3) & (F.length(lead) == F.length(ahead))).alias("first"),
            word(i - 1).alias("before"), word(i - 2).alias("before2"), word(i + 1).alias("after")))

    return F.filter(F.transform(parts, one), lambda s: s.isNotNull())


def candidates(text: Column) -> Column:
    """Array of structs, one per candidate of a text, in order: place (in words), run (in the word), core, token, named
    (whether it is assigned to the name of a key), lead (what stands before the core in its field of the word), field, first (whether it is the word's first field), before, before2,
    after.

    Words are split at ASCII white space; null text has none. Each run of a word is a candidate of its own.
    """
    def found(words: Column) -> Column:
        return F.flatten(F.filter(F.transform(words, lambda w, i: F.when(
            _interesting(words, i), _let(_parts(words, i), lambda parts: _found(words, i, parts)))), lambda x: x.isNotNull()))

    return _let(_words(text), found)


def dictionary(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The most frequent words of all texts, ASCII letters in lower case, the longest first."""
    word = F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+")).alias("word")
    counts = docs.select(word).where(F.length("word").between(*DICTIONARY_LETTERS)).groupBy("word").count()
    top = counts.orderBy(F.desc("count"), "word").limit(DICTIONARY_WORDS).collect()
    return sorted((r["word"] for r in top), key=lambda w: (-len(w), w))


def _clear(s: Column) -> Column:
    """Whether a named value reads like a credential: any value of a password, one of a secret unless it is a bare word
    after a colon as in prose, and of other keys one of 8 characters or more with letters and digits. Addresses are none."""
    name = F.concat_ws(" ", F.when(s["first"], F.concat_ws(" ", s["before2"], s["before"])), s["lead"])
    prose = s["core"].rlike("^[A-Za-z]+[.!]?$") & name.rlike(r":\s*$")
    mixed = (F.length(s["core"]) >= 8) & s["core"].rlike("[0-9]") & s["core"].rlike("[A-Za-z]")
    address = s["core"].rlike(r"(?i)^https?:|^www\.|@[a-z0-9\-]+\.[a-z]")
    return s["named"] & ~address & (name.rlike(_PASSWORD) | (name.rlike(_STRONG) & ~prose) | mixed)


def features(s: Column, words: Sequence[str] = ()) -> dict[str, Column]:
    """Numbers on a coarse scale, so that findings fall into few distinct cells however many there are."""
    core, near = s["core"], F.when(s["first"], F.concat_ws(" ", s["before2"], s["before"]))
    size = F.length(core).cast("double")
    left = lambda pattern: F.length(F.regexp_replace(core, pattern, ""))
    fifth = lambda x: F.round(x * 5) / 5
    changes = F.regexp_count(core, F.lit("(?<=[A-Za-z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[A-Z])"))
    return {
        "length": F.least(F.round(size / 8) * 8, F.lit(128.0)),
        "changes": fifth(changes / size),
        "digits": fifth(1 - left("[0-9]") / size),
        "hex": F.when(core.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 1.0).otherwise(0.0),
        "coverage": fifth(1 - left("(?i)" + "|".join(words)) / size) if words else F.lit(0.0),
        "path": F.when(s["field"].rlike(_PATH), 1.0).otherwise(0.0),
        "address": F.when(s["field"].rlike(_ADDRESS), 1.0).otherwise(0.0),
        "keyword": F.when(F.concat_ws(" ", near, s["field"]).rlike(_KEYWORD), 1.0).otherwise(0.0),
        "assigned": F.when((s["first"] & s["before"].rlike("^(?:=|:|:=|=>)$")) | s["lead"].rlike("[A-Za-z_.\\-][\"'`]?[=:][\"'`]?$"), 1.0).otherwise(0.0),
        "quoted": F.when(s["lead"].rlike("[\"'`]$"), 1.0).otherwise(0.0),
        "issued": F.when(core.rlike(_ISSUED), 1.0).otherwise(0.0),
        "named": F.when(_clear(s), 1.0).when(s["named"], 0.5).otherwise(0.0),
    }


def rule_label(s: Column) -> Column:
    """Label by rule, for corpora without reviewed findings: an issued form, or a value assigned to a name of a key."""
    assigned = s["first"] & s["before"].rlike("^(?:=|:|:=|=>)$") & s["before2"].rlike(f"^[\"'`]?{_KEYWORD}[\"'`]?$")
    inline = s["lead"].rlike(f"(?:^|[^A-Za-z0-9]){_KEYWORD}[\"'`]?[=:][\"'`]?$")
    shape = s["core"].rlike(r"^(?:[0-9a-fA-F]{24,}|[A-Za-z0-9+/_=.~\-]{16,})$") & ~s["field"].rlike(_ADDRESS)
    return F.when(s["core"].rlike(_ISSUED) | _clear(s) | ((assigned | inline) & shape & s["core"].rlike("[0-9]")), 1.0).otherwise(0.0)


@dataclass
class Forest:
    """Trees as nested tuples (feature, threshold, left, right), leaves as 0.0 or 1.0, and the dictionary they know."""

    trees: list
    words: Sequence[str] = ()

    def score(self, values: dict[str, Column]) -> Column:
        """The share of trees that vote for a secret."""
        votes = [_expression(t, values) for t in self.trees]
        total = votes[0]
        for v in votes[1:]:
            total = total + v
        return total / len(votes)

    def judge(self, values: dict[str, Column]) -> Column:
        """score() with each value worked out once; all trees in one generated method would be too long for the JVM."""
        return _let(F.struct(*[values[k].alias(k) for k in FEATURES]), lambda v: self.score({k: v[k] for k in FEATURES}))


def _expression(tree, values: dict[str, Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, left, right = tree
    return F.when(values[feature] <= threshold, _expression(left, values)).otherwise(_expression(right, values))


def _parse(lines: list[str]):
    """One tree of Spark's description of a forest: If/Else lines, indented by depth, and Predict lines."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1])
    feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = _parse(lines)
    lines.pop(0)  # Else
    right = _parse(lines)
    return left if left == right else (FEATURES[int(feature)], float(threshold), left, right)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Sequence[str] = ()) -> DataFrame:
    """A row per candidate: id_col, place, run, core, token, the features, with a dictionary of `words`."""
    rows = docs.select(id_col, F.explode(candidates(F.col(text_col))).alias("s"))
    rows = rows.select(id_col, "s.place", "s.run", "s.core", "s.token", "s.before", "s.before2", "s.after", "s")
    return rows.select("*", *[v.alias(k) for k, v in features(F.col("s"), words).items()])


def examples(spark: SparkSession, words: Sequence[str] = (), each: int = EXAMPLES) -> DataFrame:
    """Written examples of findings: doc_id, kind, label (1: secret), value, text, `each` of every kind.

    Secrets are issued forms, values assigned to names of keys, short and long passwords, and random runs that a sentence
    calls a key. What looks like them and is none: commit ids, digests, UUIDs, paths, addresses, names made of dictionary
    words, numbers, and remarks about keys; some of these stand beside words that speak of keys too.
    """
    i = F.col("id")
    draw = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), i.cast("string")), 256)
    pick = lambda salt, many: F.get(many, F.pmod(F.xxhash64(F.lit(salt), i), F.size(many)).cast("int"))
    size = lambda salt, *sizes: pick(salt, F.array(*[F.lit(n) for n in sizes]))
    hexes = lambda salt, *sizes: F.substr(draw(salt), F.lit(1), size(salt, *sizes))
    packed = lambda salt: F.concat(F.base64(F.unhex(draw(salt))), F.base64(F.unhex(draw(salt + "'"))))
    mixed = lambda salt, *sizes: F.substr(F.regexp_replace(packed(salt), "[+/=]", ""), F.lit(1), size(salt, *sizes))
    digits = lambda salt, n: F.substr(F.regexp_replace(F.concat(draw(salt), draw(salt + "'")), "[a-f]", ""), F.lit(1), F.lit(n))
    word = lambda salt: pick(salt, F.split(F.lit(" ".join(words or _WORDS)), " "))
    glue = pick("glue", F.array(F.lit("_"), F.lit("-"), F.lit(".")))
    uuid = F.regexp_replace(hexes("u", 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    assigned = ['token = "{}"', "api_key: {}", '{"secret":"{}"}', "client_secret={}", "access_token = '{}'", "x?a=1&token={}"]
    kinds = [
        ("issued id", 1, F.concat(F.lit("AKIA"), F.upper(mixed("a", 16))), ["the id is {} here", "{}", "it is {}. Then", "ID={}"]),
        ("issued token", 1, F.concat(F.lit("ghp_"), mixed("g", 36)), ["use {} here", "{}", "user:{}:x", "see {}."]),
        ("issued live key", 1, F.concat(F.lit("sk_live_"), mixed("l", 24)), ["pay with {} now", "{}", "live: {}"]),
        ("issued web token", 1, F.concat(F.lit("eyJ"), mixed("w", 20), F.lit(".eyJ"), mixed("x", 30), F.lit("."), mixed("y", 40)),
         ["header {} ends", "{}", "jwt={}"]),
        ("assigned digest", 1, hexes("h", 32, 40, 64), assigned),
        ("assigned value", 1, mixed("m", 20, 32, 40), assigned),
        ("assigned packed value", 1, F.substr(packed("p"), F.lit(1), F.lit(40)), assigned),
        ("password", 1, pick("pw", F.array(F.concat(word("p1"), digits("p2", 2)), mixed("p3", 8, 12), F.concat(word("p4"), digits("p5", 4), F.lit("!")),
                                           F.concat_ws("-", word("p6"), word("p7"), word("p8")))),
         ["password = {}", "password: {} ", "pwd={}", 'passphrase: "{}"', "db_password={}", '{"password":"{}"}']),
        ("spoken key", 1, mixed("s", 32, 40), ["Authorization: Bearer {}", "with the key {} in hand", "your token {} is new", "the secret {} was sent"]),
        ("commit", 0, hexes("c", 40), ["commit {}", "merge {} into main", "{} mend the build", "the key commit {} broke it",
                                      "the token list as of commit {}", "revert {} again", "see {}"]),
        ("digest", 0, hexes("d", 32, 64, 64), ["sha256:{}", "sha256 {} of it", "checksum {} holds", "md5 = {}", "digest: {} ok",
                                              "{} file.tar.gz", "the key file has sha256 {}", "{}"]),
        ("uuid", 0, uuid, ["request {} done", "id: {}", "uuid={}", "{}", "session {} closed", "password reset request {} sent"]),
        ("path", 0, F.concat(pick("r", F.array(F.lit("src/"), F.lit("/usr/lib/"), F.lit("lib/"))), word("f1"), digits("f2", 2), F.lit("/"),
                             word("f3"), F.lit("/"), word("f4"), digits("f5", 1), pick("e", F.array(F.lit(".py"), F.lit(".java"), F.lit("/")))),
         ["see {} there", "in {}", "{}", "the key file {} is old", "the token parser {} fails", "file={}"]),
        ("address", 0, F.concat(F.lit("https://example.com/"), word("u1"), F.lit("/"), digits("u2", 4), F.lit("/"), word("u3"), digits("u4", 3), F.lit(".html")),
         ["see {}", "{}", "the key is explained at {}", "token={}", "link: {}"]),
        ("name", 0, F.concat(F.concat_ws("_", word("n1"), word("n2"), word("n3"), word("n4")), glue, digits("n5", 2)),
         ["call {} first", "the key {} is sorted", "your token {} is new", "{}", "name = {}", "with the key {} in hand"]),
        ("number", 0, F.concat(digits("i1", 3), F.lit("-"), digits("i2", 4), F.lit("-"), digits("i3", 8), F.lit("-"), digits("i4", 1)),
         ["ISBN {}", "order {} of today", "{}", "key figures {}", "number: {}"]),
        ("remark", 0, word("k1"), ["The key: {} try", "The secret: {} more", "token: {} and more", "key = {}", "a key, {}"]),
    ]
    def of(each_kind: list[Column]) -> Column:
        return F.coalesce(*[F.when(i % len(kinds) == k, c) for k, c in enumerate(each_kind)])

    rows = spark.range(0, each * len(kinds), 1, 4).select(
        "id", of([F.lit(kind) for kind, *_ in kinds]).alias("kind"), of([F.lit(float(label)) for _, label, *_ in kinds]).alias("label"),
        of([value for _, _, value, _ in kinds]).alias("value"),
        of([pick("t", F.array(*[F.lit(t) for t in texts])) for *_, texts in kinds]).alias("form"),
        F.concat_ws(" ", word("b1"), word("b2")).alias("ahead"), word("b3").alias("behind"))
    return rows.select(i.alias("doc_id"), "kind", "label", "value", F.concat_ws(
        " ", "ahead", F.replace("form", F.lit("{}"), F.col("value")), "behind").alias("text"))


def example_findings(spark: SparkSession, words: Sequence[str] = ()) -> DataFrame:
    """findings() of examples(): doc_id is a struct of their columns, label and kind are columns too."""
    written = examples(spark, words).select(F.struct("doc_id", "kind", "label", "value").alias("doc_id"), "text")
    rows = findings(written, words=words)
    own = F.contains("core", F.col("doc_id.value")) | F.contains(F.col("doc_id.value"), F.col("core"))
    return rows.where(own).select("*", "doc_id.kind", "doc_id.label")


def fit(labelled: DataFrame, label_col: str = "label", seed: int = 1, words: Sequence[str] = (), kind_col: str | None = None) -> Forest:
    """Learn from findings() with a label (1: secret) and with the dictionary `words`. Null labels are not used. With
    `kind_col`, the findings of each label and kind weigh the same together, however many they are.

    Findings are first counted by cell of their features. The scales allow some 200,000 cells and data fill few of them,
    whatever the number of findings; so the cells may be ordered in one task, which makes reruns agree. With findings of
    one kind only, or none, the forest says so everywhere (none: no secret).
    """
    kind = F.lit("") if kind_col is None else F.col(kind_col)
    cells = labelled.where(F.col(label_col).isNotNull()) \
        .groupBy(*FEATURES, F.col(label_col).cast("double").alias("label"), kind.alias("kind")).agg(F.count("*").cast("double").alias("weight"))
    if kind_col is not None:
        totals = cells.groupBy("label", "kind").agg(F.sum("weight").alias("total"))
        cells = cells.join(totals, ["label", "kind"]).withColumn("weight", F.col("weight") / F.col("total") * EXAMPLES).drop("total")
    cells = stage(cells.repartition(1, "label").sortWithinPartitions("label", "kind", *FEATURES), "secret-cells")
    kinds = [r[0] for r in cells.select("label").distinct().collect()]
    if len(kinds) < 2:
        return Forest([float(kinds[0]) if kinds else 0.0], words)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(cells)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, weightCol="weight").fit(rows)
    parts = re.split(r"\n\s*Tree \d+ \(weight [\d.]+\):\n", model.toDebugString)[1:]
    return Forest([_parse([x for x in p.split("\n") if x.strip()]) for p in parts], words)


def fit_by_rule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """A forest from the findings of documents that are not held out, labelled by rule_label, and from the written examples
    that are not held out. The corpus counts as one kind more. The dictionary is that of all documents."""
    words = dictionary(docs, text_col)
    own = findings(docs.where(remainder(id_col) != 2), id_col, text_col, words).withColumn("label", rule_label(F.col("s")))
    written = example_findings(docs.sparkSession, words).where(remainder(F.col("doc_id.doc_id")) != 2)
    labelled = own.select(*FEATURES, "label", F.lit("corpus").alias("kind")).union(written.select(*FEATURES, "label", "kind"))
    return fit(labelled, words=words, kind_col="kind")


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per candidate: id_col, place, token, core, score, is_secret, run. Texts without candidates, null and empty ones
    included, give no rows; repeated rows and null ids are scanned like others. Other columns are not read."""
    rows = findings(docs, id_col, text_col, forest.words)
    score = forest.judge({k: F.col(k) for k in FEATURES})
    return rows.withColumn("score", score).select(
        id_col, "place", "token", "core", "score", (F.col("score") >= LEAST_SCORE).alias("is_secret"), "run")


def mask(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """Every row of docs, all columns; each run of the text that is judged secret is replaced by MASK, and so are further
    copies of it if it is long. Null text stays null."""
    def secret(s: Column) -> Column:
        return forest.judge(features(s, forest.words)) >= LEAST_SCORE

    def hide(words: Column, i: Column, piece: Column) -> Column:
        """The piece (word i and the white space after it) with its secrets hidden, and the long ones, if it has any."""
        def hidden(parts: Column, judged: Column) -> Column:
            runs = F.transform(judged, lambda s: s["run"])
            out = F.transform(parts, lambda x, k: F.when((k % 2 == 1) & F.array_contains(runs, F.floor(k / 2)), F.lit(MASK)).otherwise(x))
            space = F.substr(piece, F.length(F.get(words, i)) + 1)
            return F.when(F.size(judged) > 0, F.struct(
                F.concat(F.array_join(out, ""), space).alias("text"),
                F.filter(F.transform(judged, lambda s: s["core"]), lambda c: F.length(c) >= LEAST_CHARS).alias("long")))

        return F.when(_interesting(words, i), _let(_parts(words, i), lambda parts: _let(
            F.filter(_found(words, i, parts), secret), lambda judged: hidden(parts, judged))))

    text = F.col(text_col)

    def whole(words: Column, pieces: Column) -> Column:
        def joined(done: Column) -> Column:
            cores = F.array_distinct(F.flatten(F.filter(F.transform(done, lambda d: d["long"]), lambda x: x.isNotNull())))
            out = F.array_join(F.zip_with(pieces, done, lambda p, d: F.coalesce(d["text"], p)), "")
            masked = F.aggregate(cores, out, lambda t, core: F.replace(t, core, F.lit(MASK)))
            return F.when(F.exists(done, lambda d: d.isNotNull()), masked).otherwise(text)

        return _let(F.transform(pieces, lambda p, i: hide(words, i, p)), joined)

    masked = _let(_words(text), lambda words: _let(F.split(text, _PIECE), lambda pieces: whole(words, pieces)))
    return docs.withColumn(text_col, F.when(text.isNotNull(), masked)).select(*docs.columns)
