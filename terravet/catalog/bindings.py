"""Inputs of the operators, derived from the given tables (Spark and SQL side by side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import literal_table
from .registry import Tables


def points(t: Tables, address: bool = False) -> DataFrame:
    """Facility points: one per order."""
    o = t.orders.select(
        F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("cust"),
        (116.25 + (F.col("o_orderkey") % 200) / 1000).alias("lon"),
        (39.90 + (F.col("o_custkey") % 150) / 1000).alias("lat"),
        F.when(F.col("o_orderstatus") == "P", "no_result").otherwise("ok").alias("status"),
        F.col("o_orderpriority").alias("category"))
    if not address:
        return o.drop("cust")
    c = t.customer.select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("address"))
    return o.join(c, "cust").drop("cust")


POINTS = """(SELECT o_orderkey AS point_id, 116.25 + (o_orderkey % 200)::DOUBLE / 1000 AS lon,
    39.90 + (o_custkey % 150)::DOUBLE / 1000 AS lat,
    CASE WHEN o_orderstatus = 'P' THEN 'no_result' ELSE 'ok' END AS status,
    o_orderpriority AS category FROM orders)"""

POINTS_ADDR = """(SELECT o_orderkey AS point_id, 116.25 + (o_orderkey % 200)::DOUBLE / 1000 AS lon,
    39.90 + (o_custkey % 150)::DOUBLE / 1000 AS lat,
    CASE WHEN o_orderstatus = 'P' THEN 'no_result' ELSE 'ok' END AS status,
    o_orderpriority AS category, c_mktsegment AS address
    FROM orders JOIN customer ON c_custkey = o_custkey)"""

IN_BOX = "lon BETWEEN 116.310 AND 116.395 AND lat BETWEEN 39.935 AND 40.030"


def markdown(t: Tables) -> DataFrame:
    """Documents as Markdown: each paragraph starts a level-2 section."""
    body = F.concat(F.lit("intro\n## "), F.replace(F.replace(
        F.col("text"), F.lit("\n"), F.lit("\n\n## ")), F.lit(". "), F.lit(".\n- [source:a] ")))
    return t.documents.select("doc_id", "lang", "source", body.alias("md"))


MARKDOWN = r"""(SELECT doc_id, lang, source, 'intro' || chr(10) || '## ' || replace(replace(text, chr(10),
    chr(10) || chr(10) || '## '), '. ', '.' || chr(10) || '- [source:a] ') AS md FROM documents)"""

EN_TERMS = ["the", "Tion", "heon", "zzz", "of the", "queau"]
SQL_EN_TERMS = "['the','Tion','heon','zzz','of the','queau']"


def features(t: Tables) -> DataFrame:
    """Rectangles of the part table: one feature per part, one submission per brand."""
    x0 = ((F.col("p_partkey") % 40) * 10).cast("double")
    y0 = (F.floor(F.col("p_partkey") / 40) * 10).cast("double")
    side = (5 + F.col("p_size") % 12).cast("double")
    return t.part.select(
        F.col("p_brand").alias("submission"), F.col("p_type").alias("layer"),
        F.col("p_partkey").alias("pos"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feature_id"),
        x0.alias("x0"), y0.alias("y0"), (x0 + side).alias("x1"), (y0 + side).alias("y1"),
        F.col("p_retailprice").alias("declared"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))


FEATURES = """(SELECT p_brand AS submission, p_type AS layer, p_partkey AS pos,
    'f' || p_partkey AS feature_id, ((p_partkey % 40) * 10)::DOUBLE AS x0,
    ((p_partkey // 40) * 10)::DOUBLE AS y0,
    ((p_partkey % 40) * 10 + 5 + p_size % 12)::DOUBLE AS x1,
    ((p_partkey // 40) * 10 + 5 + p_size % 12)::DOUBLE AS y1,
    p_retailprice AS declared, p_size AS size, p_name AS name FROM part)"""


def box_rings(x0, y0, x1, y1):
    """Rectangle as one closed ring of points."""
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0)))


def with_rings(df: DataFrame) -> DataFrame:
    return df.withColumn("rings", box_rings(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def runs(t: Tables) -> DataFrame:
    """Run history per user: event type as fingerprint, value as failure count."""
    return t.events.select(
        F.col("user_id").alias("run_key"), F.col("event_id").alias("seq"), F.col("ts"),
        F.col("event_type").alias("fingerprint"), F.floor("value").cast("bigint").alias("failures"))


RUNS = """(SELECT user_id AS run_key, event_id AS seq, ts, event_type AS fingerprint,
    floor(value)::BIGINT AS failures FROM events)"""


def with_empty(rows, name, key="submission"):
    """Submissions with rows, and one without any."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key).distinct().unionByName(literal_table(rows.sparkSession, [(name,)], f"{key} {kind}"))
