"""Tables of names, patterns and keys looked up in texts: an index of literal pieces, never a pair of every text and pattern.

Each pattern is looked up by the rarest of its literal grams (keys: of their short runs of words), counted over the texts; texts that hold
it are candidates, which are then compared. Only grams that some pattern has are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from attesta.functions.text import WORD, glob_regex, unicode_regex

GRAM = 3
#: Letters of a shell pattern's literal that are looked up together: with few, the values of one gram grow with the table.
LITERAL = 8
RUN = 3
_LITERALS = "literals array<string>, regex string, exact boolean"


def explode_grams(df: DataFrame, text: str, sizes: Column) -> DataFrame:
    """A row per size and place: ``gram``, the letters of ``text`` there. Texts shorter than a size have none of it."""
    sized = df.withColumn("_size", F.explode(sizes)).filter(F.length(text) >= F.col("_size"))
    placed = sized.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(text) - F.col("_size") + 1)))
    return placed.withColumn("gram", F.substring(F.col(text), F.col("_at"), F.col("_size"))).drop("_size", "_at")


def literal_pieces(pattern: str) -> list[str]:
    """What stands as it is between the wildcards of a shell pattern."""
    return [p for p in re.split(r"\*|\?|\[.[^\]]*\]", pattern, flags=re.S) if p]


def _parsed(patterns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in patterns:
        yield pd.DataFrame([(literal_pieces(p), glob_regex(p), not set("*?") & set(p)) for p in part],
                           columns=["literals", "regex", "exact"])


def match_pattern_table(df: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """The rows whose ``column`` any pattern of the table matches: a shell match if the pattern holds ``*`` or ``?``, else equality.
    Null values and null patterns match nothing."""
    parsed = (patterns.select(F.col(pattern).alias("pattern")).filter("pattern IS NOT NULL").distinct()
              .withColumn("p", F.pandas_udf(_parsed, _LITERALS)("pattern")).select("pattern", "p.*"))
    values = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    globs = parsed.filter("NOT exact").select("regex", "literals")
    pieces = globs.select("regex", F.explode("literals").alias("piece"))
    of_globs = explode_grams(pieces, "piece", F.array(F.least(F.length("piece"), F.lit(LITERAL)))).select("regex", "gram").distinct()
    in_use = of_globs.agg(F.coalesce(F.collect_set(F.length("gram")), F.array().cast("array<int>")).alias("sizes")).scalar()  # 1 to LITERAL
    of_values = explode_grams(values.withColumn("_sizes", in_use), "value", F.col("_sizes")).select("value", "gram")
    counts = (of_values.join(of_globs.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("value").alias("n")))
    rarest = (of_globs.join(counts, "gram", "left").groupBy("regex")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0").select("regex", "r.gram"))
    found = of_values.join(rarest, "gram").filter(F.rlike("value", F.col("regex"))).select("value")
    # patterns of wildcards alone say little more than a length: the few there are make one expression
    bare = globs.filter(F.size("literals") == 0).agg(F.array_join(F.array_sort(F.collect_set("regex")), "|").alias("r")).scalar()
    free = values.withColumn("_bare", bare).filter((F.length("_bare") > 0) & F.rlike("value", F.col("_bare"))).select("value")
    same = values.join(parsed.filter("exact").select(F.col("pattern").alias("value")), "value", "left_semi")
    hits = found.unionByName(free).unionByName(same).distinct()
    return df.join(hits.withColumnRenamed("value", "_value"), F.col(column) == F.col("_value"), "left_semi")


def _tokens(text: Column) -> Column:
    """Words, and every other letter by itself, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD}]+|[^{WORD}])"), F.lit(1))


def _windows(sizes: Column) -> Column:
    """The different runs of ``_tokens`` of each of the sizes, as text: tokens of equal text are equal, and so are their runs."""
    def of(size: Column) -> Column:
        places = F.sequence(F.lit(1), F.size("_tokens") - size + 1)
        return F.when(F.size("_tokens") >= size, F.transform(places, lambda i: F.array_join(F.slice("_tokens", i, size), ""))).otherwise(
            F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(sizes, of)))


def match_key_table(docs: DataFrame, doc: str, text: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """(doc, key): the keys of the table that occur in each text as whole words, case ignored. Null and empty keys and null
    texts match nothing; rows of one ``doc`` are one text's, so it should be unique. A whole-word match begins and ends between
    tokens, so keys are looked up by their rarest run of RUN tokens (shorter ones by themselves); those that are one such run, with letters
    at both ends, need no further look at the text."""
    named = keys.select(F.col(key).alias("key")).filter(F.coalesce("key", F.lit("")) != "").distinct()
    of_keys = named.select("key", _tokens(F.col("key")).alias("_tokens"))
    of_keys = of_keys.select("key", F.explode(_windows(F.array(F.least(F.size("_tokens"), F.lit(RUN))))).alias("token"),
                             F.least(F.size("_tokens"), F.lit(RUN)).alias("size"))
    in_use = of_keys.agg(F.coalesce(F.collect_set("size"), F.array().cast("array<int>")).alias("sizes")).scalar()  # 1 to RUN
    of_docs = (docs.select(F.col(doc).alias("doc"), _tokens(F.col(text)).alias("_tokens")).withColumn("_sizes", in_use)
               .select("doc", F.explode(_windows(F.col("_sizes"))).alias("token")))
    of_docs = of_docs.join(of_keys.select("token").distinct(), "token", "left_semi")
    counts = of_docs.groupBy("token").agg(F.count("doc").alias("n"))
    rarest = (of_keys.join(counts, "token", "left").groupBy("key")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r")).filter("r.n > 0").select("key", "r.token"))
    found = of_docs.join(rarest, "token").select("doc", "key", "token").distinct()
    edge = unicode_regex(r"\b")
    itself = (F.lower("key") == F.col("token")) & F.rlike("token", F.lit(f"^[{WORD}]")) & F.rlike("token", F.lit(f"[{WORD}]\\z"))
    whole = found.filter(itself).select("doc", "key")
    check = found.filter(~itself)
    escaped = F.concat(F.lit(edge), F.lit("\\Q"), F.replace(F.lower("key"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"), F.lit(edge))
    checked = (check.join(docs.select(F.col(doc).alias("doc"), F.lower(text).alias("_low")), "doc")
               .filter(F.contains("_low", F.lower("key"))).filter(F.rlike("_low", escaped)).select("doc", "key"))
    return whole.unionByName(checked).withColumnRenamed("doc", doc)
