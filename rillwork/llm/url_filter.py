"""URL filters: host-suffix and path-prefix expressions joined with rules by short hash prefixes.

Each URL is expanded into the expressions ``host suffix + path prefix`` that a rule could have.
Expressions meet rules in an equi-join on the first hex digits of their SHA-256 digests; the full
digests then confirm, and the longest rule wins. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, column, materialize, packed, rows_frame, small, unpacked

#: Hex digits of the digest in the short prefix.
PREFIX_DIGITS = 8


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; a null URL or one without ``://`` has empty ones."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def url_verdicts(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
                 out: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """``pages`` with host, path, the rule that decides (or null) and the verdict.

    ``rules`` has host, path and verdict strings. A rule fits its host and all subdomains whose
    path starts with the rule's; the longest rule text wins, then the longer host, then the text;
    of equal rules the verdict that sorts last (block) wins. Null or malformed URLs fit no rule and
    get ``default``. Columns of ``pages`` named as an output column are replaced, others keep their names and values. Empty tables give
    empty results or the default. Repeated rows stay. A host suffix is expanded only if a rule has it, and then with the path lengths of
    that host's rules. Only sites that meet a rule are joined back, on (host, path), where Spark splits skewed partitions.
    """
    kept = [c for c in pages.columns if c not in out]
    host, path = parts(column(url_col).cast("string"))
    cut = pages.select(packed(kept), host.alias("host"), path.alias("path"))
    r = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != "")).select(
        ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    r = r.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    r = materialize(r.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)))
    shapes = r.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    shapes = shapes.withColumn("host_digest", _digest(F.col("rule_host"), F.lit("")))
    shapes = materialize(shapes.select("lengths", "host_digest", F.substring("host_digest", 1, PREFIX_DIGITS).alias("host_prefix"), F.size(F.split("rule_host", r"\.")).alias("labels")))
    depths = [x["labels"] for x in shapes.select("labels").distinct().collect()]  # a host has 127 labels at most
    sites = cut.where(F.col("host") != "").select("host", "path").distinct()
    labels = F.size(F.split("host", r"\."))
    suffixes = F.array(*(F.when(labels >= k, F.substring_index("host", ".", -k)) for k in depths)) if depths else F.array().cast("array<string>")
    # the suffixes that some rule has, then the path prefixes as long as such a rule's
    spread = sites.withColumn("suffix", F.explode(F.array_compact(suffixes))).withColumn("full", _digest(F.col("suffix"), F.lit("")))
    known = spread.join(small(shapes), (F.substring("full", 1, PREFIX_DIGITS) == F.col("host_prefix")) & (F.col("full") == F.col("host_digest")))
    each = known.select("host", "path", "suffix", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    each = each.withColumn("full", _digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("n"))))
    met = each.join(small(r), F.substring("full", 1, PREFIX_DIGITS) == F.col("prefix")).where(F.col("full") == F.col("digest"))
    text = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(text), F.length("rule_host"), text.alias("rule"), F.col("rule_verdict").alias("verdict"))
    won = met.groupBy(F.col("host").alias("at_host"), F.col("path").alias("at_path")).agg(F.max(rank).alias("won"))
    joined = cut.join(won, (F.col("host") == F.col("at_host")) & (F.col("path") == F.col("at_path")), "left")
    return joined.select(*unpacked(kept), F.col("host").alias(out[0]), F.col("path").alias(out[1]), F.col("won.rule").alias(out[2]),
                         F.coalesce("won.verdict", F.lit(default)).alias(out[3]))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def fixed_rules(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    return rows_frame(spark, rows, "host string,path string,verdict string")
