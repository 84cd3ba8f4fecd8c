"""PII (5), with DataFrame functions only: patterns, and information-theoretic sanitisation.

Base spans come from four patterns. What else gives a protected value away is measured on the
corpus (Sanchez, Batet, Viejo 2013): a term t discloses the value e in proportion to

    PMI(t; e) / IC(e) = log(N * p(t | e) / n(t)) / log(N / n(e)),

counted over all documents. Protected are the values themselves and the class that a value belongs
to: the domain of an address, the network of an IP number, the issuer of a card, the area of a phone
number (PARTS), as who gives a class away narrows the value down. From `generalise` on, a term beside
e is replaced by its class; from `remove` on it is taken out. All values and pairs are scored. p(t | e) is not n(t, e) / n(e) but the
lower end of its Wilson interval over the different texts that have e (CONFIDENCE), so that one
or two texts weigh what they can prove, and exact copies of a text prove no more than the text.
A value of every document has no information (IC = 0), and nothing discloses it.

Positions are code points. A match is found by regexp_replace() with marks around it, and its
place is the length of what comes before; the marks are private characters that are taken out
of the text first. The patterns are those of the contract, written so that no run of characters
is scanned twice: possessive, and starting where a run starts or the last match ended.

Every word of at least `shortest` letters or digits is a term (three by default, as shorter ones
are function words in most languages; 1 takes all). Of one text, the values and classes that other
texts have too meet those of its words that other texts have too and that could disclose them: at most
their product of rows, all of one text.

Defined results: null text is the empty text; rows that are equal give equal results; spans that
begin at one place are listed by kind; very long texts are read whole; an empty table gives no rows;
other columns are ignored by find_pii(), and kept as they are by sanitise(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_written, keyed, materialize, rejoin

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What of a value is its class.
PARTS = {"email": "@.*$", "ip": r"^[0-9]+\.[0-9]+\.[0-9]+\.", "card": "^[0-9]([ -]?[0-9]){5}", "phone": r"^\+[\x20().-]*[0-9]([\x20().-]*[0-9]){3}"}
HINTS = {"email": "@", "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"
SPAN = "struct<start:int,kind_no:int,end:int,kind:string,value:string>"
WORD = r"[\p{L}\p{N}]"
#: z of the two-sided 97 % interval of p(t | e): of k of m texts with e that have t.
CONFIDENCE = 2.1701
#: A side of a join is broadcast if it has at most so many rows.
BROADCAST_ROWS = 200_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(12, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _marked(text: Column, pattern: Column | str, kind: str, kind_no: int) -> Column:
    """Spans of all matches of a pattern, found between marks."""
    clean = F.translate(text, OPEN + CLOSE, OTHER + OTHER)
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.split(F.regexp_replace(clean, pattern, F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), part.alias("value"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def _found(text: Column, kind: str) -> Column:
    no = KINDS.index(kind)
    maybe = text.rlike(PATTERNS[kind])
    if kind in HINTS:
        maybe = F.contains(text, F.lit(HINTS[kind])) & maybe
    spans = F.filter(_marked(text, PATTERNS[kind], kind, no), lambda s: _valid(kind, s["value"]))
    return F.when(maybe, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _terms(text: Column, shortest: int) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= max(1, shortest)))


def _protected(span: Column) -> Column:
    """A span's value and its class, named apart."""
    part = F.lit("")
    for kind, pattern in PARTS.items():
        part = F.when(span["kind"] == kind, F.regexp_extract(span["value"], pattern, 0)).otherwise(part)
    return F.transform(F.array(F.concat(F.lit("="), span["value"]), F.concat(F.lit("~"), span["kind"], part)), lambda v: F.lower(v))


def base_spans(docs: DataFrame, shortest: int = 3) -> DataFrame:
    """doc_id, id, h (the row's identity), spans; text and terms of rows with spans, else null."""
    rows = keyed(docs).select("doc_id", "id", "h", F.coalesce("text", F.lit("")).alias("text"))
    spans = F.array_sort(F.concat(*(_found(F.col("text"), k) for k in KINDS)))
    rows = rows.withColumn("spans", spans)
    masked = F.col("text")
    for k in KINDS:
        masked = F.regexp_replace(masked, PATTERNS[k], " ")
    some = F.size("spans") > 0
    return rows.select("doc_id", "id", "h", "spans", F.when(some, F.col("text")).alias("text"), F.when(some, _terms(masked, shortest)).alias("terms"))


def _lower(k: Column, m: Column) -> Column:
    """Lower end of the Wilson interval of k of m."""
    zz = CONFIDENCE**2
    return (k + zz / 2 - CONFIDENCE * F.sqrt(k * (m - k) / m + zz / 4)) / (m + zz)


def disclosing_terms(docs: DataFrame, base: DataFrame, generalise: float, shortest: int = 3) -> DataFrame:
    """id, h, disclosed: for each row the terms that disclose one of its values, with the ratio.

    Where the value is one text's or the term is, both are together in that text: the row alone gives the
    ratio. Of the other pairs those go to be counted that would reach `generalise` if the rarer of the two
    never came without the other; a pair that would not cannot reach it with its true count."""
    some = base.filter("terms is not null")
    values = materialize(some.select("id", "h", F.explode(F.array_distinct(F.flatten(F.transform("spans", _protected)))).alias("value")))
    per_value = values.groupBy("value", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.sum("n").alias("n_value"), F.count(F.lit(1)).alias("texts"))
    # All values that only one text has score alike there, so "" stands for them.
    scored = F.when(F.col("texts") == 1, F.lit("")).otherwise(F.col("value")).alias("value")
    lists = values.join(per_value, "value").groupBy("id", "h").agg(F.collect_set(F.struct(scored, "n_value", "texts")).alias("values"))
    # One row stands for the copies of a text.
    one = values.groupBy("h").agg(F.min("id").alias("one"))
    lists = materialize(lists.join(one, "h").select("id", "h", "values", (F.col("id") == F.col("one")).alias("first")))

    terms = some.select("id", "h", "terms").dropDuplicates(["id", "h"]).select("id", "h", F.explode("terms").alias("term"))
    wanted = materialize(terms.select("term").distinct())
    words = docs.select(F.explode(_terms(F.coalesce("text", F.lit("")), shortest)).alias("term"))
    # Counted before the join: each task sends a term once, and the join sees no repeated terms (a semi join would be pushed below the count).
    n_term = materialize(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(_small(wanted), "term"), release=True)
    n = docs.count()
    ratio = lambda k, v, t: F.try_divide(F.log(F.lit(n) * _lower(k, v["texts"]) / t["n_term"]), F.log(F.lit(n) / v["n_value"]))
    counted = terms.join(_small(n_term), "term").groupBy("id", "h").agg(F.collect_list(F.struct("term", "n_term")).alias("terms"))
    rows = materialize(counted.join(lists, ["id", "h"]), release=True)
    alone = lambda v, t: (v["texts"] == 1) | (t["n_term"] == 1)
    best = lambda t: F.array_max(F.transform(F.filter("values", lambda v: alone(v, t)), lambda v: ratio(F.lit(1), v, t)))
    sure = rows.select("id", "h", F.explode(F.filter(F.transform("terms", lambda t: F.struct(t["term"].alias("term"), best(t).alias("ratio"))), lambda x: x["ratio"] >= generalise)).alias("x")).select("id", "h", "x.*")
    pairs = rows.select("id", "h", "first", "terms", F.explode(F.filter("values", lambda v: v["texts"] > 1)).alias("v"))
    at_most = lambda t: ratio(F.least(F.col("v.texts"), t["n_term"]), F.col("v"), t)
    pairs = pairs.select("id", "h", "first", "v.*", F.explode(F.filter("terms", lambda t: (t["n_term"] > 1) & (at_most(t) >= generalise))).alias("t"))
    pairs = materialize(pairs.select("id", "h", "first", "value", "n_value", "texts", "t.*"))
    joint = pairs.filter("first").groupBy("value", "term").agg(F.count(F.lit(1)).alias("k"), *(F.first(c).alias(c) for c in ("n_value", "texts", "n_term")))
    joint = joint.select("value", "term", ratio(F.col("k"), {"texts": F.col("texts"), "n_value": F.col("n_value")}, {"n_term": F.col("n_term")}).alias("ratio"))
    strong = materialize(joint.filter(F.col("ratio") >= generalise))
    found = sure.unionByName(pairs.join(_small(strong), ["value", "term"]).select("id", "h", "term", "ratio"))
    # Dealt by row once, for both of the next steps.
    found = found.repartition("id", "h").groupBy("id", "h", "term").agg(F.max("ratio").alias("ratio"))
    found = materialize(found.groupBy("id", "h").agg(F.collect_list(F.struct("term", "ratio")).alias("disclosed")), release=True)
    drop_written(values, lists, wanted, n_term, rows, pairs, strong)
    return found


def find_pii(docs: DataFrame, generalise: float = 0.75, shortest: int = 3) -> DataFrame:
    """doc_id, id, h, base (spans of the patterns), spans (with those of disclosing terms), disclosed."""
    docs = docs.select("doc_id", "text")
    base = materialize(base_spans(docs, shortest))
    disclosed = disclosing_terms(docs, base, generalise, shortest)
    # Some rows with spans get a pattern of their own terms: whole words, whatever their case.
    pattern = F.concat(F.lit(f"(?iu)(?<!{WORD})(?:"), F.array_join(F.transform("disclosed", lambda d: d["term"]), "|"), F.lit(f")(?!{WORD})"))
    terms = base.filter("terms is not null").join(disclosed, ["id", "h"]).dropDuplicates(["id", "h"])
    inside = lambda s: F.exists("spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    terms = terms.select("id", "h", "disclosed", F.filter(_marked(F.col("text"), pattern, "term", len(KINDS)), lambda s: ~inside(s)).alias("more"))
    out = base.drop("text", "terms").withColumnRenamed("spans", "base").join(terms, ["id", "h"], "left")
    return out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))))).drop("more")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find_pii()."""
    counts = [_count(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), _count(F.col("spans"), "term").alias("n_term"))


def sanitise(docs: DataFrame, generalise: float = 0.75, remove: float = 0.9, shortest: int = 3) -> DataFrame:
    """docs with the text sanitised: base spans become their kind in brackets, terms their class or nothing."""
    names = docs.columns
    found = find_pii(docs, generalise, shortest).filter(F.size("spans") > 0).select("id", "h", "spans", "disclosed").dropDuplicates(["id", "h"])
    rows = keyed(docs).join(found, ["id", "h"], "left")
    strong = F.transform(F.filter("disclosed", lambda d: d["ratio"] >= remove), lambda d: d["term"])
    said = lambda s: (
        F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        .when(F.array_contains(strong, F.lower(s["value"])), F.lit(""))
        .when(s["value"].rlike("[0-9]"), F.lit("[NUMBER]"))
        .when(s["value"].rlike(r"^\p{Lu}"), F.lit("[NAME]"))
        .otherwise(F.lit("[TERM]"))
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    # A span that begins before the last one has ended only takes out what is left of it.
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), said(s))).otherwise(acc["out"]).alias("out"),
    )
    new = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return rejoin(rows, names, F.when(F.col("spans").isNotNull(), new).otherwise(F.col("text")))
