"""Token search: all tokens of the query have to be in the text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Distinct tokens, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)))


def query_tokens(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", query.lower())


def search(df: DataFrame, prop: str, query: str, prefix: bool = False) -> DataFrame:
    """Rows whose property holds every token; with prefix the last one may be the start of a token. No tokens, no rows."""
    wanted = query_tokens(query)
    if not wanted:
        return df.filter(F.lit(False))
    text = F.col(prop)
    if df.schema[prop].dataType.typeName() == "array":
        text = F.array_join(text, " ")
    found = tokens(text)
    exact, last = (wanted[:-1], wanted[-1]) if prefix else (wanted, None)
    # A cheap test on the text first: tokens are parts of it.
    test = F.lit(True)
    for w in wanted:
        test = test & F.contains(F.lower(text), F.lit(w))
    for w in exact:
        test = test & F.array_contains(found, w)
    if last:
        test = test & F.exists(found, lambda t: F.startswith(t, F.lit(last)))
    return df.filter(test)


def token_table(df: DataFrame, prop: str) -> DataFrame:
    """token, id: the inverted list, to be written sorted by token when many searches follow."""
    return df.select(F.explode(tokens(F.col(prop))).alias("token"), "id")
