"""Sanitisation of personal data by rules and by information about protected entities.

Rules find entities of four kinds.  The corpus tells how strongly a term reveals an entity that
stands in the same text: over all texts, the pointwise mutual information of the term and the
entity, as a share of the entity's information content -log p(entity).  A share of 1 means that
the term never occurs without the entity.  Protected are single entities (one address, one
number) and the kinds as such.  Terms at or above DISCLOSURE that share SUPPORT texts with what
they reveal are removed wherever they stand in texts of that entity or kind, while entities are
generalised to their kind.  Parts of an address are no terms.

All is done with built-in functions.  A null text is empty and stays null when sanitised; a null
id is an id like others.  Rows that repeat id and text are rows of their own, an empty table gives an
empty one, and columns of docs keep their names (of `rules` and `personal`, the result's own replace
them).  Work grows with the length of a text, however long it is and however much is found in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.frames import documents, hidden, restored, written
from listwright.llm.spans import digits, kept, luhn, named, places, replaced

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the rules; \G and the looks behind keep a search from trying again inside a run that has failed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Least share of information, and least number of texts with both, for a term that discloses.
DISCLOSURE, SUPPORT = 0.9, 10
TERM = r"\p{L}{3,}+"


def rule_spans(text: Column) -> list[Column]:
    """Valid spans of each kind."""
    ip = lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    card = lambda v: F.length(digits(v)).between(16, 19) & luhn(digits(v))
    phone = lambda v: F.length(digits(v)).between(8, 15)
    return [
        kept(F.when(text.contains("@"), places(text, EMAIL)), "email", 0, lambda v: F.lit(True)),
        kept(F.when(text.rlike(r"[0-9]\.[0-9]"), places(text, IP)), "ip", 1, ip),
        kept(F.when(text.rlike(r"[0-9][0-9\x20-]{14}"), places(text, CARD)), "card", 2, card),
        kept(F.when(text.contains("+"), places(text, PHONE)), "phone", 3, phone),
    ]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    rows, names = hidden(docs)
    new = {n: c for c, n in names.items()}
    rows = rows.withColumns({"t": F.coalesce(F.col(new[text_col]), F.lit("")), "k1": F.coalesce(F.col(new[id_col]).cast("long"), F.lit(0))})
    return rows.withColumn("k2", F.xxhash64(new[id_col], "t")), names


def _terms(text: Column) -> Column:
    """Different terms of a text, in lower case, without those inside addresses; only addresses hold letters."""
    outside = F.when(text.contains("@"), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(outside, F.lit(TERM), F.lit(0)), F.lower))


def _protected() -> Column:
    """kind:v of the different entities of a text with r0 to r3, v their hashes, and of their kinds, with 0.

    Strings, as Spark finds equal strings of an array by hashes, but equal structs by comparing all pairs.
    """

    def entity(s: Column) -> Column:
        same = F.when(s["kind"].isin("card", "phone"), digits(s["value"])).otherwise(F.lower(s["value"]))
        return F.concat_ws(":", s["kind"], F.xxhash64(same).cast("string"))

    spans = F.concat("r0", "r1", "r2", "r3")
    return F.array_distinct(F.concat(F.transform(spans, entity), F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":0")))))


def disclosing_terms(rows: DataFrame, pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(kind, v, term, share) of the terms that disclose; rows has the texts, as t; pairs: (kind, v, term) of each text; entities: (kind, v, n)."""
    together = pairs.groupBy("kind", "v", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= SUPPORT)
    texts = rows.select(F.explode(_terms(F.col("t"))).alias("term")).groupBy("term").agg(F.count("*").alias("texts"))
    total = rows.agg(F.count("*").alias("total"))
    found = together.join(texts.filter(F.col("texts") >= SUPPORT), "term").join(entities, ["kind", "v"]).join(F.broadcast(total))
    information = -F.log(F.col("n") / F.col("total"))
    mutual = F.log(F.col("both") * F.col("total") / (F.col("texts") * F.col("n")))
    return found.select("kind", "v", "term", (mutual / information).alias("share")).filter((information > 0) & (F.col("share") >= DISCLOSURE))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with rules (array by kind: spans of each rule) and personal (all spans, by kind and start)."""
    rows, names = _keyed(docs, id_col, text_col)
    found = rows.withColumns({f"r{i}": s for i, s in enumerate(rule_spans(F.col("t")))})
    some = found.filter(F.size("r0") + F.size("r1") + F.size("r2") + F.size("r3") > 0)
    # Written, so that what several statistics need of the texts with entities is found once.
    some = written(some.select("k1", "k2", _protected().alias("of"), _terms(F.col("t")).alias("terms")), "entities")
    each = some.select("k1", "k2", F.explode("of").alias("e")).select("k1", "k2", F.split_part("e", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("e", F.lit(":"), F.lit(2)).cast("long").alias("v"))
    # Entities in fewer texts than SUPPORT can't reach it with any term, so their pairs needn't be made.
    entities = each.groupBy("kind", "v").agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT)
    of_text = each.join(entities.select("kind", "v"), ["kind", "v"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("kind", "v")).alias("of"))
    terms = some.select("k1", "k2", "terms").join(of_text, ["k1", "k2"])
    pairs = terms.select("k1", "k2", "terms", F.explode("of").alias("e")).select("k1", "k2", "e.*", F.explode("terms").alias("term"))
    told = pairs.join(disclosing_terms(rows, pairs, entities).drop("share"), ["kind", "v", "term"])
    by_text = told.groupBy("k1", "k2").agg(F.collect_set("term").alias("told"))
    out = found.join(by_text, ["k1", "k2"], "left").withColumn("blank", F.when(F.col("told").isNotNull(), F.col("t")))
    out = replaced(out, "blank", "r0", lambda _, n: F.repeat(F.lit(" "), n))
    marked = F.filter(places(F.col("blank"), TERM), lambda m: F.array_contains("told", F.lower(m["value"])))
    out = out.withColumn("more", kept(marked, "term", len(KINDS), lambda v: F.lit(True)))
    return restored(out, names, rules=F.array("r0", "r1", "r2", "r3"), personal=F.concat("r0", "r1", "r2", "r3", "more"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with entities generalised to their kind and disclosing terms removed."""
    rows, names = hidden(docs)
    new = {n: c for c, n in names.items()}
    found = find(rows, new[id_col], new[text_col]).withColumn("personal", F.array_sort("personal"))
    label = lambda kind, _: F.when(kind == "term", "").otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))
    return restored(replaced(found, new[text_col], "personal", label), names)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.size(F.col("rules")[i]).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(named(F.flatten("rules")), 256).alias("base_sha256"), named(F.col("personal")).alias("spans"))
