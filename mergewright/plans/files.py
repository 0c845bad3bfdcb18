"""Queries over files of other systems, which they write from the tables first: fixed-width lines, XML entities, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import readers
from ..sources.shared import shared_path
from .registry import Tables, query

#: Entities of one XML file at most: a file is read by one task.
FILE_ENTITIES = 100_000

LINE = {"kind": (0, 3), "key": (3, 10), "maker": (13, 10), "name": (25, 24), "size": (50, 4)}


@query("""SELECT CASE WHEN p_partkey % 10 > 1 THEN p_partkey::VARCHAR END AS key, CASE WHEN p_partkey % 10 > 1 THEN p_brand END AS maker, CASE WHEN p_partkey % 10 > 1 AND p_size <> 7 THEN p_name || ' é' END AS name, CASE WHEN p_partkey % 10 > 1 THEN p_size::VARCHAR END AS size,
CASE p_partkey % 10 WHEN 0 THEN 'length' WHEN 1 THEN 'marker' END AS malformed FROM part""")
def fixed_width_file(t: Tables) -> DataFrame:
    """Lines in ISO-8859-1, some cut short and some of another table, written and read back."""
    rows = t.part.select(F.when(F.col("p_partkey") % 10 == 1, "OLD").otherwise("CAR").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_brand").alias("maker"), F.when(F.col("p_size") != 7, F.concat("p_name", F.lit(" é"))).alias("name"), F.col("p_size").alias("size"))
    line = readers.to_fixed_width(rows, LINE, 60)
    lines = rows.select(F.when(F.col("key") % 10 == 0, F.substring(line, 1, 41)).otherwise(line).alias("value"))
    path = shared_path(t.spark, "lines")
    lines.write.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_fixed_width(t.spark, path, LINE, 60, (0, "CAR")).drop("kind")


@query("""SELECT c_custkey::VARCHAR AS entity_id, c_name AS name, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey::VARCHAR END AS nation FROM customer""")
def entity_file(t: Tables) -> DataFrame:
    """XML entities with attributes of which some aren't asked for, are empty or are missing, written and read back."""
    value = lambda name, c: F.struct(F.lit(name).alias("_AttributeID"), c.cast("string").alias("_VALUE"))
    own = F.array(value("n1", F.col("c_name")), value("x9", F.col("c_acctbal")), value("s2", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).otherwise(" ")), F.when(F.col("c_custkey") % 5 > 0, value("k3", F.col("c_nationkey"))))
    path = shared_path(t.spark, "entities")
    t.customer.select(F.col("c_custkey").alias("_ID"), F.filter(own, lambda v: v.isNotNull()).alias("Value")).write.format("xml").option("rowTag", "Entity").option("rootTag", "Extract").option("maxRecordsPerFile", FILE_ENTITIES).save(path)
    return readers.read_entities(t.spark, path, "Entity", {"n1": "name", "s2": "segment", "k3": "nation"})


@query("""SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def landed_batches(t: Tables) -> DataFrame:
    """One batch an order status; the last one is declared with a row too many, and doesn't land."""
    path = shared_path(t.spark, "landing")
    for status in ("F", "O", "P"):
        batch = t.orders.where(F.col("o_orderstatus") == status)
        try:
            readers.land(batch, path, batch.count() + (status == "P"))
        except ValueError:
            assert status == "P"
    return readers.landed(t.spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
