"""Secrets in texts: rules, and character Markov models of random strings and ordinary identifiers.

Both models are tables of transitions between characters, trained on labelled samples.  Random:
strings made from hashes in the usual alphabets (hexadecimal, base64, capitals with digits), and
what the rules find in a bounded sample of texts (the SAMPLE texts with the smallest hashes).
Ordinary: identifiers composed of the words of NAMES in the usual styles, which count for the share
IDENTIFIERS of all transitions, and of the sampled texts in which no rule finds a secret the words that
several of them hold (a key stands in one text), as they are and in capitals, and all numbers and runs of one character.
Identifiers in a fixed form of hexadecimal groups (UUIDs), which look like random strings, aren't judged.  Any token that no rule has found, whatever characters it holds, is a secret if its
log-likelihood ratio is large enough, as a sum and by character.  All is done with built-in functions.

A null text is empty and stays null when redacted.  Spans of kind `random` that touch a rule's span
are not reported.  Repeated rows are rows of their own, a null id is an id like others, an empty table
gives an empty one (and a model of the composed samples alone), columns of docs keep their names
(`rules`, `base` and `secrets` are replaced).  Work grows with the length of a text and of its tokens.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.frames import documents, hidden, restored
from listwright.llm.spans import bound, kept, named, places, replaced

# Fixed patterns of the rules.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"

#: Tokens that the models judge, and how much likelier a random string must be (natural logarithms).
TOKEN, LEAST_SUM, LEAST_MEAN = r"[A-Za-z0-9+/_-]{16,}+={0,2}", 12.0, 0.5
#: Numbers and runs of one character, which train the model of ordinary strings wherever they stand.
PLAIN = r"^(?:[^A-Za-z]+|(.)\1+)$"
#: Identifiers in a fixed form, which are public.
FORMED = r"^(?:[A-Za-z]+[_/-])*[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"
#: Words of composed identifiers, and their share of all transitions of ordinary strings.
NAMES = (
    "account action address array author batch binary block body branch browser buffer build button cache calendar category change channel check class client clock color column command commit component config "
    "connection content context control cookie counter country create current customer data database date default delete device document domain download edit element email engine entry error event export "
    "feature field file filter folder format frame function gateway global graph group handler height helper history home host image import index initial input instance item key label language layout length "
    "level library limit link list local location login machine manager map memory menu message method metric model module name network node number object option order output owner package page parent path "
    "payment port price process product profile project property query queue record request response role schema search server service session size source status storage table text time title type update "
    "upload user value version video view visible warning width window worker wrapper"
).split()
IDENTIFIERS = 0.3
SAMPLE, STRINGS, LEAN = 2000, 3000, 20.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(ALPHABET) + 1  # index 0: any other character


def rule_spans(text: Column) -> list[Column]:
    """Valid spans of each rule."""
    value = lambda v: F.length(F.regexp_extract(v, ASSIGN_VALUE, 1)) >= 6
    any_assign = text.contains("=") | text.contains(":")
    return [
        kept(F.when(any_assign, places(text, ASSIGN)), "assign", 0, value),
        kept(F.when(text.contains("AKIA"), places(text, ACCESS)), "access", 1, lambda v: F.length(v) >= 20),
        kept(F.when(text.rlike("[0-9a-f]{24}"), places(text, HEX)), "hex", 2, lambda v: F.length(v) >= 24),
    ]


def _pairs(value: Column, of: Callable[[Column], Column], size: int) -> Column:
    """A number for each two characters in a row, from numbers below `size` for single ones."""
    numbers = F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), of)
    return bound(numbers, lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: a * size + b))


def _transitions(strings: DataFrame) -> DataFrame:
    """(place in the table, number) over all strings in column s, each once or n times."""
    pairs = _pairs(F.col("s"), lambda c: F.position(c, F.lit(ALPHABET)), _SIZE)
    n = F.col("n") if "n" in strings.columns else F.lit(1)
    return strings.filter(F.length("s") >= 2).select(F.explode(pairs).alias("at"), n.alias("n")).groupBy("at").agg(F.sum("n").alias("count"))


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token, of characters of TOKEN."""
    place = {ord(c): i + 1 for i, c in enumerate(ALPHABET)}
    by_code = [model[place.get(a, 0) * _SIZE + place.get(b, 0)] for a in range(128) for b in range(128)]
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in by_code)), ",").cast("array<double>")
    return F.aggregate(_pairs(value, F.ascii, 128), F.lit(0.0), lambda s, at: s + F.element_at(table, at + 1))


def _identifiers(spark) -> DataFrame:
    """Composed identifiers, in column s."""
    names = F.split(F.lit(" ".join(NAMES)), " ")
    picked = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda j: F.element_at(names, (F.pmod(F.xxhash64("id", j), F.lit(len(NAMES))) + 1).cast("int")))
    w = F.slice(picked, F.lit(1), (3 + F.col("id") % 3).cast("int"))
    number = (F.pmod(F.xxhash64("id"), F.lit(100))).cast("string")
    title = F.transform(w, lambda x: F.initcap(x))
    styles = [
        F.array_join(title, ""), F.concat(F.element_at(w, 1), F.array_join(F.slice(title, 2, 4), "")), F.array_join(w, "_"), F.array_join(w, "-"), F.upper(F.array_join(w, "_")),
        F.concat(F.lit("/"), F.array_join(w, "/")), F.concat(F.array_join(w, "_"), F.lit("_"), number), F.concat(F.array_join(w, "-"), F.lit("-2024-"), number), F.array_join(title, "/"),
    ]
    return spark.range(STRINGS).select(F.explode(F.array(*styles)).alias("s"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log-likelihood ratios of all transitions, random strings against ordinary identifiers."""
    spark = docs.sparkSession
    h = F.sha2(F.col("id").cast("string"), 256)
    kinds = F.array(F.substr(h, F.lit(1), F.lit(40)), F.base64(F.unhex(h)), F.translate(F.substr(F.upper(F.base64(F.unhex(h))), F.lit(1), F.lit(40)), "+/=", "234"))
    random = spark.range(STRINGS).select(F.explode(kinds).alias("s"))
    text = F.col(text_col)
    # Hashes below a bound that leaves about twice the sample, so that one task sorts no more than that; the sample is then exact.
    whole = docs.filter(text.isNotNull()).select(text.alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(2**31)).alias("h"))
    below = int(2**31 * 2.0 * SAMPLE / max(1, whole.count())) + 1
    sample = whole.filter(F.col("h") < below).orderBy("h", "text").limit(SAMPLE).withColumn("hits", F.concat(*rule_spans(F.col("text"))))
    hits = sample.select(F.explode("hits").alias("m")).select(F.regexp_extract("m.value", r"([A-Za-z0-9+/_.=-]+)$", 1).alias("s"))
    clean = sample.filter(F.size("hits") == 0).select("text").distinct()
    words = clean.select("text", F.explode(F.split("text", r"[^A-Za-z0-9+/_=-]+")).alias("s")).filter(F.length("s") > 1)
    common = words.groupBy("s").agg(F.count("*").alias("n"), F.countDistinct(F.xxhash64("text")).alias("texts")).filter((F.col("texts") > 1) | F.col("s").rlike(PLAIN))
    capitals = common.filter(F.col("s") != F.upper("s")).select(F.upper("s").alias("s"), F.ceil(F.col("n") / 4).alias("n"), "texts")
    common = common.unionByName(capitals)
    p, words, names = (_counts(_transitions(x).collect()) for x in (random.unionByName(hits), common, _identifiers(spark)))  # at most _SIZE ** 2 rows each
    total, more = (sum(map(sum, x)) for x in (words, names))
    weight = IDENTIFIERS / (1 - IDENTIFIERS) * total / more if total else 1.0
    ordinary = [[a + weight * b for a, b in zip(x, y)] for x, y in zip(words, names)]
    return [math.log(a / b) for x, y in zip(_conditional(p), _conditional(ordinary)) for a, b in zip(x, y)]


def _counts(rows: list) -> list[list[float]]:
    pair = [[0.0] * _SIZE for _ in range(_SIZE)]
    for r in rows:
        pair[r.at // _SIZE][r.at % _SIZE] = r["count"]
    return pair


def _conditional(pair: list[list[float]]) -> list[list[float]]:
    """Probability of each character after each other; rare ones lean on how frequent a character is at all."""
    single = [0.5 + sum(column) for column in zip(*pair)]
    total = sum(single)
    return [[(n + LEAN * s / total) / (sum(row) + LEAN) for n, s in zip(row, single)] for row in pair]


def find(docs: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """docs with rules (array by kind: spans of each rule) and spans (all, by start)."""
    rows, names = hidden(docs)
    source = next(c for c, n in names.items() if n == text_col)
    rows = rows.withColumn("t", F.coalesce(F.col(source), F.lit("")))
    text = F.col("t")
    rows = rows.withColumns({f"r{i}": s for i, s in enumerate(rule_spans(text))}).withColumn("tokens", places(text, TOKEN))
    rows = rows.withColumn("base", F.array_sort(F.concat("r0", "r1", "r2")))

    def secret(m: Column) -> Column:
        touched = F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
        return (ratio(m["value"], model) >= F.greatest(F.lit(LEAST_SUM), LEAST_MEAN * (F.length(m["value"]) - 1))) & ~touched & ~m["value"].rlike(FORMED)

    rows = rows.withColumn("more", kept(F.filter("tokens", secret), "random", 3, lambda v: F.lit(True)))
    rows = rows.withColumn("all", F.array_sort(F.concat("base", "more")))
    return restored(rows, names, rules=F.array("r0", "r1", "r2"), base="base", secrets="all")


def redact(docs: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """docs with secrets and random strings in the text replaced by a mark."""
    rows, names = hidden(docs)
    text = next(c for c, n in names.items() if n == text_col)
    label = lambda kind, _: F.concat(F.lit("[SECRET:"), F.upper(kind), F.lit("]"))
    return restored(replaced(find(rows, model, text), text, "secrets", label), names)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find(docs, train(docs))
    counts = [F.size(F.col("rules")[i]).cast("long").alias(n) for i, n in enumerate(("n_assign", "n_access", "n_hex"))]
    return found.select("doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("secrets")).alias("spans"))
