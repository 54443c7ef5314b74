"""Block and allow rules for URLs, by host suffix and path prefix.

Each URL is expanded into the expressions that a rule could be written for: every suffix of its host at a dot,
times every prefix of its path that ends in a slash. Rules are keyed the same way (a rule whose path does not end
in a slash is keyed by the part up to its last slash). URLs and rules meet in an equi-join on a short prefix of the
key's SHA-256; the full digest and the rule's whole path are confirmed after it. Of the rules that fit, the longest
wins. Expressions that a filter of the rules' digests rules out aren't joined, and those of a hot key are dealt to many
tasks.

Defined results: a null URL or one without ``://`` has an empty host and path, and no rule fits it. Repeated URLs
are judged once. Repeated rules count once; of two rules of one length, the one with the longer host wins, then the
one that blocks. A rule without a path, or whose path doesn't begin with a slash, fits no URL. Empty tables give
empty results. Other columns of the input are kept; ``host path rule verdict`` replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import maybe_among, salted_join
from .store import settle
from .text import ascii_lower, or_empty

#: Hex digits of a digest that the join compares: 32 bits.
SHORT = 8


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rules as a table; verdict is ``block`` or ``allow``."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def url_host(url: Column) -> Column:
    return ascii_lower(or_empty(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)))


def url_path(url: Column) -> Column:
    return or_empty(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def _keyed(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("_digest", F.sha2(key, 256)).withColumn("_short", F.substring("_digest", 1, SHORT))


def _rule_keys(rules: DataFrame) -> DataFrame:
    r = rules.select(
        ascii_lower(F.col("host")).alias("_rule_host"),
        F.col("path").alias("_rule_path"),
        F.col("verdict").alias("_rule_verdict"),
    ).where(F.col("_rule_host").isNotNull() & F.col("_rule_path").startswith("/"))
    r = r.groupBy("_rule_host", "_rule_path").agg(F.max("_rule_verdict").alias("_rule_verdict"))
    folder = F.regexp_extract("_rule_path", "(?s)^(.*/)", 1)
    r = r.withColumn("_labels", F.size(F.split("_rule_host", r"\."))).withColumn("_depth", F.size(F.split(folder, "/")) - 1)
    return _keyed(r, F.concat("_rule_host", folder))


def expand(pairs: DataFrame, labels: int, depth: int) -> DataFrame:
    """One row for each host suffix of at most ``labels`` labels and path prefix of at most ``depth`` slashes."""
    parts, steps = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."),
    )
    count = F.least(F.size(steps) - 1, F.lit(depth))
    prefixes = F.when(
        count > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    wide = pairs.withColumn("_suffix", F.explode(suffixes)).withColumn("_prefix", F.explode(prefixes))
    return _keyed(wide, F.concat("_suffix", "_prefix"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, the rule that decides (null: none) and the verdict."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("_end")).alias("_page")
    seen = pages.select(whole, url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    keys = _rule_keys(rules)

    def result(rows: DataFrame, rule: Column, verdict: Column) -> DataFrame:
        return rows.select(*[F.col(f"_page.`{c}`").alias(c) for c in kept], "host", "path", rule.alias("rule"), verdict.alias("verdict"))

    labels, depth = keys.agg(F.coalesce(F.max("_labels"), F.lit(0)), F.coalesce(F.max("_depth"), F.lit(0))).first()
    if not labels:
        return result(seen, F.lit(None).cast("string"), F.lit(default))
    urls = settle(seen.where("path <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("_n")), "urls")
    # most expressions are no rule's: a filter on the rules' digests keeps them out of the join
    wide = maybe_among(expand(urls.select("host", "path"), labels, depth), F.col("_digest"), keys, "_digest").where("_maybe").drop("_maybe")
    rank = F.struct(
        (F.char_length("_rule_host") + F.char_length("_rule_path")).alias("length"),
        F.char_length("_rule_host").alias("host_length"),
        F.col("_rule_verdict").alias("verdict"),
        F.concat("_rule_host", "_rule_path").alias("rule"),
    )
    met = salted_join(wide, keys.withColumnRenamed("_digest", "_rule_digest"), "_short", "_n", F.concat("host", "path"), weights=wide.groupBy("_short").agg(F.count(F.lit(1)).alias("_n")))
    hits = met.where((F.col("_digest") == F.col("_rule_digest")) & F.expr("startswith(path, _rule_path)")).groupBy("host", "path").agg(F.max(rank).alias("_best"))
    hits = settle(hits.join(urls, ["host", "path"]).select(F.struct("host", "path").alias("_url"), "_n", "_best"), "hits")
    # URLs without a path meet no rule, and stay out of the join
    bare = result(seen.where("path = ''"), F.lit(None).cast("string"), F.lit(default))
    found = salted_join(seen.where("path <> ''").withColumn("_url", F.struct("host", "path")), hits, "_url", "_n", F.monotonically_increasing_id(), "left", urls.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    return bare.unionAll(result(found, F.col("_best.rule"), F.coalesce("_best.verdict", F.lit(default))))
