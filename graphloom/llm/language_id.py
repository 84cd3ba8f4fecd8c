"""Language ID (2): Bayesian fusion of text, markup, address suffix and host evidence.

    log P(l | page) = log P(l | host) + log P(declared | l) + log P(suffix | l) + w * text(l)

* text(l): mean log likelihood of the hashed byte trigrams of the whole text under language l,
  weighted by w = min(trigrams, full_text) / temper, as neighbouring trigrams are no independent
  evidence: a longer text than `full_text` trigrams is no surer than one of them. The trigram tables are
  counted over all rows with a declared language; `sample` asks for the rows of least hash of each instead.
* P(declared | l), P(suffix | l) and the host priors are grouped counts over all rows of the language
  that the text alone suggests. A host's prior is smoothed towards its parent domain's, and that
  towards the whole corpus, each with the weight of KAPPA pages.

A row is accepted if a language has at least `min_confidence`, and its text is no outlier of that
language: texts of `outlier_from` trigrams or more, whose mean varies little, must not lie below the
mean of all texts declared so by more than `outlier` deviations.

Every declared language is a class. More than `max_languages` of them are an error, as the tables
have 256 KB each in every worker; they are broadcast once.

Defined results: null or blank text gives no text evidence and is rejected as "und"; a null
declared language or address gives none of that kind; of equal posteriors the language first by name
counts; rows are judged one by one, so repeated rows get equal results; very long texts count whole;
without declared languages every row is "und"; an empty table gives no rows; other columns are ignored,
or kept as they are by keep_identified(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import keyed, materialize, rejoin, small_batches

FEATURES = 1 << 16
KAPPA = 20.0
#: Host tables of at most so many rows are broadcast.
BROADCAST_ROWS = 100_000
RESULT = "doc_id long, id long, h long, host string, declared int, n long, mean array<double>"


def features(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, digits and white space folded."""
    data = np.frombuffer((text or "").lower().encode(), dtype=np.uint8)
    data = _FOLD[data].astype(np.uint32)
    data = data[np.r_[True, (data[1:] != 32) | (data[:-1] != 32)]] if len(data) else data
    if not len(data) or (data == 32).all():
        return np.empty(0, dtype=np.int64)
    data = np.r_[32, data, 32].astype(np.uint32)
    mixed = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(16)).astype(np.int64)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:33] = 32
_FOLD[48:58] = 48


def _train(texts: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probabilities, an array of (FEATURES, languages)."""
    index = {l: i for i, l in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Counts of a task's rows: FEATURES numbers a language that it meets, however many rows.
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for declared, text in zip(b["declared"], b["text"]):
                f = features(text)
                if len(f):
                    np.add.at(held.setdefault(declared, np.zeros(FEATURES, dtype=np.int64)), f, 1)
        for declared, n in held.items():
            token = np.flatnonzero(n)
            yield pd.DataFrame({"language": index[declared], "feature": token, "n": n[token]})

    # What comes to the driver has FEATURES * languages rows at most.
    counts = texts.select("declared", "text").mapInPandas(run, "language int, feature int, n long").groupBy("language", "feature").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((FEATURES, len(languages)), 0.1)
    table[counts["feature"], counts["language"]] += counts["n"]
    return np.log(table / table.sum(axis=0)).astype(np.float32)


def _score(rows: DataFrame, table: Broadcast, languages: list[str], schema: str = RESULT) -> DataFrame:
    index = {l: i for i, l in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs = table.value
        for b in batches:
            found = [features(t) for t in b["text"]]
            means = [logs[f].mean(axis=0, dtype=np.float64).tolist() if len(f) else [0.0] * len(languages) for f in found]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "id": b["id"], "h": b["h"], "host": b["host"], "declared": [index.get(d, -1) for d in b["declared"]], "n": [len(f) for f in found], "mean": means})

    return rows.mapInPandas(run, schema)


def _counts(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, c: rows by text language as an array."""
    return rows.groupBy(*keys).agg(F.array(*(F.count_if(F.col("best") == i).cast("double") for i in range(n))).alias("c"))


def _smooth(c: str, prior: str) -> Column:
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(c, prior, lambda x, p: (x + KAPPA * p) / (total + KAPPA))


def address_parts(address: Column) -> tuple[Column, Column, Column]:
    """Host, parent domain and suffix of a URL or host name; "" for what it lacks."""
    host = F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"\.([^.]+)$", 1)


def identify(
    docs: DataFrame,
    declared: str = "lang",
    address: str = "source",
    sample: int | None = None,
    max_languages: int = 256,
    min_confidence: float = 0.5,
    full_text: int = 400,
    temper: float = 3.0,
    outlier: float = 12.0,
    outlier_from: int = 200,
) -> DataFrame:
    """doc_id, id, h (the row's identity), declared, text_language, language, confidence, accepted."""
    spark = docs.sparkSession
    small_batches(spark)
    host, _, _ = address_parts(F.col("row").getField(address))
    rows = keyed(docs).select("doc_id", "id", "h", host.alias("host"), F.lower(F.col("row").getField(declared)).alias("declared"), "text")
    known = rows.filter("declared is not null and text is not null").select("declared").distinct()
    languages = sorted(r["declared"] for r in known.limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} declared languages")
    if not languages:
        return rows.select("doc_id", "id", "h", "declared", F.lit("und").alias("text_language"), F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    n = len(languages)
    texts = rows.filter(F.col("declared").isin(languages) & F.col("text").isNotNull())
    if sample is not None:
        least = Window.partitionBy("declared").orderBy(F.xxhash64("id", "h"), "id", "h")
        chosen = texts.select("declared", "id", "h").withColumn("r", F.row_number().over(least)).filter(F.col("r") <= sample)
        # At most max_languages * sample rows.
        texts = texts.join(F.broadcast(chosen.select("id", "h").distinct()), ["id", "h"], "left_semi")
    table = spark.sparkContext.broadcast(_train(texts, languages))

    best = F.array_position("mean", F.array_max("mean")).cast("int") - 1
    scored = materialize(_score(rows, table, languages).withColumn("best", F.when(F.col("n") > 0, best).otherwise(F.lit(-1))))
    fit = scored.filter((F.col("n") >= outlier_from) & (F.col("declared") >= 0)).select("declared", F.element_at("mean", F.col("declared") + 1).alias("m"))
    fit = {r["declared"]: (r["mean"], r["dev"]) for r in fit.groupBy("declared").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("dev")).collect()}
    judged = scored.filter("best >= 0")
    # Grouped counts; what comes to the driver has max_languages ** 2 numbers at most.
    prior = np.full(n, 1.0)
    said = np.full((n, n), 0.5) + np.eye(n)
    for r in judged.groupBy("declared", "best").count().collect():
        prior[r["best"]] += r["count"]
        if r["declared"] >= 0:
            said[r["declared"], r["best"]] += r["count"]
    prior /= prior.sum()
    said = np.log(said / said.sum(axis=0))
    all_ = F.array(*map(F.lit, prior.tolist()))

    _, parent, suffix = address_parts(F.col("host"))
    hosts = _counts(judged, ["host"], n).withColumns({"parent": parent, "suffix": suffix})
    merged = F.array(*(F.sum(F.element_at("c", i + 1)) for i in range(n)))
    parents = hosts.groupBy("parent").agg(merged.alias("pc"))
    suffixes = hosts.groupBy("suffix").agg(merged.alias("sc"))
    hosts = hosts.join(parents, "parent").join(suffixes, "suffix").withColumn("g", all_)
    hosts = hosts.withColumn("p", F.when(F.col("parent") == "", F.col("g")).otherwise(_smooth("pc", "g")))
    hosts = hosts.withColumn("p", F.when(F.col("host") == "", F.col("g")).otherwise(_smooth("c", "p")))
    # P(suffix | l) is P(l | suffix) / P(l) but for a factor that all languages share.
    hosts = hosts.withColumn("s", F.when(F.col("suffix") == "", F.transform("g", lambda x: F.lit(0.0))).otherwise(F.zip_with(_smooth("sc", "g"), "g", lambda x, y: F.log(x) - F.log(y))))
    hosts = materialize(hosts.select("host", F.zip_with("p", "s", lambda p, s: F.log(p) + s).alias("host_log")))
    small = hosts.count() <= BROADCAST_ROWS
    fused = scored.join(F.broadcast(hosts) if small else hosts, "host", "left")
    host_log = F.coalesce("host_log", F.transform(all_, lambda p: F.log(p)))
    declared_log = F.when(F.col("declared") >= 0, F.element_at(F.array(*(F.array(*map(F.lit, row)) for row in said.tolist())), F.col("declared") + 1)).otherwise(F.array(*[F.lit(0.0)] * n))
    weight = F.least(F.col("n"), F.lit(full_text)) / temper
    logs = F.zip_with(F.zip_with(host_log, declared_log, lambda a, b: a + b), F.transform("mean", lambda m: m * weight), lambda a, b: a + b)
    fused = fused.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    fused = fused.withColumn("l", F.array_position("logs", F.col("top")).cast("int"))
    confidence = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    floor = F.array(*(F.lit(float(fit[i][0] - outlier * max(fit[i][1], 0.02)) if i in fit else -1e9) for i in range(n)))
    strange = (F.col("n") >= outlier_from) & (F.element_at("mean", F.col("l")) < F.element_at(floor, F.col("l")))
    named = F.array(*map(F.lit, languages))
    sure = (F.col("n") > 0) & (confidence >= min_confidence)
    return fused.select(
        "doc_id",
        "id",
        "h",
        F.when(F.col("declared") >= 0, F.element_at(named, F.col("declared") + 1)).alias("declared"),
        F.when(F.col("best") >= 0, F.element_at(named, F.col("best") + 1)).otherwise("und").alias("text_language"),
        F.when(sure, F.element_at(named, F.col("l"))).otherwise("und").alias("language"),
        F.when(F.col("n") > 0, F.round(confidence, 6)).otherwise(0.0).alias("confidence"),
        (sure & ~strange).alias("accepted"),
    )


def keep_identified(docs: DataFrame, declared: str = "lang", address: str = "source") -> DataFrame:
    """docs without the rows that are not accepted or whose fused language contradicts the declared one."""
    names = docs.columns
    found = identify(docs, declared, address)
    good = found.filter(F.col("accepted") & (F.col("declared").isNull() | (F.col("declared") == F.col("language")))).select("id", "h").distinct()
    return rejoin(keyed(docs).join(good, ["id", "h"], "left_semi"), names)
