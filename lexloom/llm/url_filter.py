"""URL filters: host-suffix and path-prefix expressions joined with a rule list on short hash prefixes."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the SHA-256 digest that the equi-join sees; the full digest confirms a hit.
PREFIX_DIGITS = 8
#: A rule list of at most so many bytes is broadcast; a longer one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end. Both are empty if the URL is null or has no ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def label_count(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Judges every row's URL by the longest rule that fits it.

    ``rules`` has ``host``, ``path`` and ``action`` (``allow`` or ``block``). A rule fits its host and all subdomains
    if the path starts with the rule's. The longest rule (host and path together, then host) wins; of rules with the same host
    and path, ``block`` wins. Returns the columns ``keep``, then ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    A host is expanded into its suffixes (of as many labels as a rule has at most), which are joined with the rules' hosts; each that is one is
    expanded into the path's prefixes of the lengths that the host's rules have. That loses no match, and makes no expression that can't be one. Both joins
    are equi-joins on a short hash prefix, confirmed by the whole digest. Equal (host, path) pairs are collapsed before they are expanded, so a hot URL costs one row.

    Null URLs, and those without ``://``, have an empty host and path, join with nothing and get ``default``; so does every row if there is no
    rule. Repeated rows are each judged; of rules that tie, ``block`` wins. URLs and rules of any length are read whole. Columns of ``pages`` outside ``keep`` are not read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    named = (
        rules.where(F.col("host").isNotNull() & (F.col("host") != ""))
        .groupBy("host", F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.max("action").alias("action"))
        .withColumn("rule", F.concat("host", "path"))
    )
    most, size = named.agg(F.max(label_count(F.col("host"))), F.sum(F.octet_length("rule") * 2 + 200)).first()
    unjudged = lambda df: df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    if not most:
        return unjudged(rows)
    small = (lambda df: F.broadcast(df)) if size <= BROADCAST_BYTES else (lambda df: df)
    digest = lambda c: F.sha2(c, 256)
    short = lambda c: F.substring(c, 1, PREFIX_DIGITS)
    known = named.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")).select(digest(F.col("host")).alias("k_digest"), "lengths").withColumn("k_short", short(F.col("k_digest")))
    listed = named.select(digest(F.col("rule")).alias("r_digest"), "rule", "action", F.length("host").alias("host_length")).withColumn("r_short", short(F.col("r_digest")))
    labels = F.sequence(F.lit(1), F.least(label_count(F.col("host")), F.lit(most)))
    suffixes = F.transform(labels, lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    hits = (
        rows.select("host", "path").where("host != ''").distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .withColumn("digest", digest(F.col("suffix"))).withColumn("short", short(F.col("digest")))
        .join(small(known), (F.col("short") == F.col("k_short")) & (F.col("digest") == F.col("k_digest")))
        .select("host", "path", F.explode(F.transform(fitting, lambda n: F.concat("suffix", F.substring(F.col("path"), F.lit(1), n)))).alias("expression"))
        .withColumn("digest", digest(F.col("expression"))).withColumn("short", short(F.col("digest")))
        .join(small(listed), (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest")))
    )
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "host_length", "action")).alias("best")
    )
    judged = rows.where("host != ''").join(best, ["host", "path"], "left").select(
        *keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
    return judged.unionByName(unjudged(rows.where("host = ''")))
