"""URL filter in Spark expressions alone.

A url's host suffixes and path prefixes, of the shapes that the rules have, make expressions
``suffix`` + ``prefix``. Their digests meet the rules' in an equi-join on a short prefix of the
digest; the whole digest confirms a match; the longest rule wins (of equal ones that with the
longer host, then by text). Verdicts depend on the url alone, so each url is looked up once.

A null url, or one without ``://``, has an empty host and path and no rule. Repeated rows each
get their row; other columns are kept whatever their names, but for columns named host, path, rule
and verdict, which the results replace. Rules with a null host or path are passed over. An empty
table gives no rows; without rules every verdict is the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest in the join's key.
SHORT = 8
#: Tasks that share the rows of one url.
SALTS = 16


def split_url(rows: DataFrame) -> DataFrame:
    """Adds host and path."""
    url = F.coalesce("url", F.lit(""))
    return rows.withColumn("host", F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), CAPITALS, SMALL)).withColumn("path", F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1))


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The rows with host, path, rule and verdict. ``rules``: host, path, verdict."""
    mine = rules.select(F.translate("host", CAPITALS, SMALL).alias("host"), "path", F.col("verdict").alias("rule_verdict")).dropna(subset=["host", "path"])
    digest = F.sha2(F.concat("host", "path"), 256)
    table = mine.select(F.substring(digest, 1, SHORT).alias("short"), digest.alias("rule_digest"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), "rule_verdict")
    # a shape is a number of labels and a path's length, so their number follows from how rules are written
    shapes = mine.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect()

    urls = split_url(pages.select("url").where("url is not null").distinct())
    labels = F.size(F.split("host", r"\."))
    found = [F.when((labels >= s.labels) & (F.length("path") >= s.chars) & (F.col("host") != ""), F.concat(F.substring_index("host", ".", -s.labels), F.substring("path", 1, s.chars))) for s in shapes]
    expressions = urls.select("url", F.explode(F.array_compact(F.array(*found or [F.lit(None).cast("string")]))).alias("expression"))
    hashed = expressions.select("url", F.sha2("expression", 256).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    best = hashed.join(table, "short").where("digest = rule_digest").groupBy("url").agg(F.max(F.struct(F.length("rule").alias("chars"), "host_chars", "rule", "rule_verdict")).alias("best"))
    # rows of one url, or without one, go to SALTS tasks; only urls with a rule are copied for it
    held = best.select(F.col("url").alias("held_url"), "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("held_salt"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), "url", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    joined = split_url(rows.join(held, (F.col("url") == F.col("held_url")) & (F.col("salt") == F.col("held_salt")), "left"))
    own = [F.col(f"page.`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return joined.select(*own, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
