"""The triple table over the fixture view, made by the standard maps, and its statements in SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GRAPH
from ..session import ensure_checkpoint_dir
from . import fixture
from .names import NAMES, RDF
from .rml import construct, standard_maps
from .workload import Graph

RES, CORE, DOMAIN = NAMES.resource, NAMES.core, NAMES.domain


def sources(spark: SparkSession, sf_dir: str, parts: tuple[str, ...]) -> dict[str, DataFrame]:
    t = fixture.triplets(spark, sf_dir)
    article = NAMES.article(F.col("article"), F.col("article"))
    out = {}
    base = t.withColumns({
        "article_uri": article, "statement_uri": NAMES.statement(F.col("article"), F.col("article"), F.col("stmt")),
        "head_uri": NAMES.entity(F.col("head_type"), F.col("head")), "tail_uri": NAMES.entity(F.col("tail_type"), F.col("tail")),
    })
    if "triplets" in parts:
        out["triplets"] = base.withColumns({
            "predicate_uri": F.concat(F.lit(DOMAIN), "relation"), "head_type_uri": F.concat(F.lit(CORE), "head_type"), "tail_type_uri": F.concat(F.lit(CORE), "tail_type"),
            "head_label": F.col("head"), "tail_label": F.col("tail"), "tail_alt": F.upper("tail"),
        })
    if "mentions" in parts:
        row = lambda r: F.struct(
            F.concat("statement_uri", F.lit(f"/mention/{r}")).alias("mention_uri"), F.col(f"{r}_uri").alias("entity_uri"), F.concat(F.lit(f"t_{r}_"), "stmt").alias("target_id"),
            F.concat(F.lit(f"x_{r}_"), "stmt").alias("selector_id"), F.lit(0).alias("start"), F.length(r).alias("end"),
        )
        out["mentions"] = base.select("article_uri", F.explode(F.array(row("head"), row("tail"))).alias("m")).select("article_uri", "m.*")
    if "documents" in parts:
        orders = fixture.table(spark, sf_dir, "orders")
        key = F.concat(F.lit("o-"), F.col("o_orderkey").cast("string"))
        out["documents"] = orders.select(
            NAMES.article(key, key).alias("article_uri"), NAMES.document(key).alias("document_uri"), F.concat(NAMES.article(key, key), F.lit("/content")).alias("content_uri"), key.alias("id_local"), key.alias("title"),
            F.col("o_orderkey").cast("string").alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), fixture.content().alias("content"),
        )
    if "topics" in parts:
        out["topics"] = base.select("article_uri", NAMES.topic(F.col("topic")).alias("topic_uri"), F.col("topic").alias("topic_label"))
    return out


def triples(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    return construct(sources(spark, sf_dir, parts), standard_maps(NAMES))


_STORED: dict[tuple, str] = {}


def _version(spark: SparkSession, sf_dir: str) -> tuple:
    """When the tables that a graph is made of were last written, so that a graph of older ones isn't taken for theirs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer", "part")]
    return tuple(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths)


def _stored(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, part, _version(spark, sf_dir))
    if key not in _STORED:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/graph-{uuid.uuid4().hex}"
        # by class within the types, so that a scan for a class skips the pages of others
        made = triples(spark, sf_dir, part).sortWithinPartitions("p", F.when(F.col("p") == RDF + "type", F.col("o")))
        made.write.partitionBy("p").parquet(folder)
        _STORED[key] = folder
    return spark.read.schema(GRAPH).parquet(_STORED[key])


def graph(spark: SparkSession, sf_dir: str, *parts: str) -> Graph:
    """The graph of the parts, which share no triple, as stored tables by predicate, as queries would find it: a part is built
    once for a session, in its shared folder."""
    stored = [_stored(spark, sf_dir, p) for p in parts or ("triplets",)]
    return Graph(reduce(DataFrame.unionByName, stored), NAMES)


def slug_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^0-9a-z]+', '-', 'g'), '-')"


def fold_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^0-9a-z]+', ' ', 'g'))"


def entity_sql(kind: str, label: str) -> str:
    return f"'{RES}/entity/' || {slug_sql(kind)} || '/' || {slug_sql(label)} || '-' || substr(sha1({fold_sql(kind)} || '||' || {fold_sql(label)}), 1, 12)"


#: The statements as a common table expression named k, after t.
SQL = f"""{fixture.SQL}, k AS (
  SELECT '{RES}/extraction/' || article || '/article/' || article || '/triple/' || stmt AS statement, {entity_sql('head_type', 'head')} AS s, head, '{CORE}' || head_type AS s_class,
    '{DOMAIN}' || relation AS p, {entity_sql('tail_type', 'tail')} AS o, tail, '{CORE}' || tail_type AS o_class, '{RES}/document/' || article || '/article/' || article AS a, article, topic
  FROM t
), c AS (
  SELECT '{RES}/document/o-' || o_orderkey || '/article/o-' || o_orderkey AS a, 'o-' || o_orderkey AS article_id_local, o_orderkey::VARCHAR AS article_number, o_orderpriority || ' ' || o_orderstatus AS article_content FROM orders
)"""
