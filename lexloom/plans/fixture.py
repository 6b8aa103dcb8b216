"""A view of triples over the driver's tables, on which the registered queries run, and the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: how columns of the tables stand for types, relations and topics
HEAD_TYPES = {"BUILDING": "Location", "AUTOMOBILE": "Artifact", "MACHINERY": "Action", "HOUSEHOLD": "Actor"}
TAIL_TYPES = {"STANDARD": "Artifact", "PROMO": "Source", "SMALL": "Time", "LARGE": "Action", "ECONOMY": "Condition"}
RELATIONS = {"RO": "hasSource", "RF": "justifiedBy", "AF": "involvesArtifact", "AO": "performedBy", "NO": "hasCondition"}
TOPICS = {"1-URGENT": "maintenanceActivity", "2-HIGH": "maintenanceActivity", "3-MEDIUM": "legalCrossReference"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column, cases: dict, default):
    out = F.lit(default)
    for key, value in reversed(cases.items()):
        out = F.when(column == key, value).otherwise(out)
    return out


def head_type(cases: dict = HEAD_TYPES, default="Condition"):
    return _mapped(F.col("c_mktsegment"), cases, default)


def tail():
    return F.concat_ws(" ", "p_name", "p_brand")


def tail_type(cases: dict = TAIL_TYPES, default="Actor"):
    return _mapped(F.substring_index("p_type", " ", 1), cases, default)


def relation(cases: dict = RELATIONS, default="hasTime"):
    return _mapped(F.concat("l_returnflag", "l_linestatus"), cases, default)


def content():
    """An article's text."""
    return F.concat_ws(" ", "o_orderpriority", "o_orderstatus")


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triple for each line item (with its quantity its key is unique at every size): stmt, article, head, head_type, relation, tail, tail_type, topic, provider."""
    line, orders, customer, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("stmt"),
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("article"),
        F.col("c_name").alias("head"),
        head_type().alias("head_type"),
        relation().alias("relation"),
        tail().alias("tail"),
        tail_type().alias("tail_type"),
        _mapped(F.col("o_orderpriority"), TOPICS, "anotherLegalActivity").alias("topic"),
        (F.col("l_suppkey") % 2).alias("provider"),
    )


def _case(column: str, cases: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cases.items()) + f" ELSE '{default}' END"


#: The view as a common table expression named t.
SQL = f"""t AS (
  SELECT 'l-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::BIGINT AS stmt, 'o-' || o_orderkey AS article, c_name AS head,
    {_case("c_mktsegment", HEAD_TYPES, "Condition")} AS head_type, {_case("l_returnflag || l_linestatus", RELATIONS, "hasTime")} AS relation,
    p_name || ' ' || p_brand AS tail, {_case("split_part(p_type, ' ', 1)", TAIL_TYPES, "Actor")} AS tail_type,
    {_case("o_orderpriority", TOPICS, "anotherLegalActivity")} AS topic, l_suppkey % 2 AS provider
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
)"""
