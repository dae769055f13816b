"""Street graph in GraphML (S5) <-> node / edge tables, via Spark's built-in
XML source.

GraphML keeps attribute values in ``<data key="dN">`` children whose names
are declared once in ``<key id="dN" attr.name="..."/>`` elements.  The reader
parses ``key``, ``node`` and ``edge`` elements with explicit schemas, turns
each element's data list into a map and looks attributes up by the key ids
declared for their names (the declarations are the file's schema: a few
rows, size-checked, read once).  Street-network GraphML names
coordinates ``y`` (latitude) and ``x`` (longitude) and the edge weight
``length``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATA = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_VALUE", T.StringType())]))
KEY_SCHEMA = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_for", T.StringType()),
                           T.StructField("_attr.name", T.StringType()), T.StructField("_attr.type", T.StringType())])
NODE_SCHEMA = T.StructType([T.StructField("_id", T.StringType()), T.StructField("data", DATA)])
EDGE_SCHEMA = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_target", T.StringType()),
                            T.StructField("data", DATA)])

# Attribute names used by street-network GraphML files.
ATTR_LAT, ATTR_LON, ATTR_LENGTH = "y", "x", "length"


def write_graphml(spark: SparkSession, node: DataFrame, edge: DataFrame, path: str) -> None:
    """Write node(id, lat, lon) and edge(u, v, length) as GraphML elements
    (one folder per element kind)."""
    keys = spark.createDataFrame(
        [("d0", "node", ATTR_LAT, "double"), ("d1", "node", ATTR_LON, "double"), ("d2", "edge", ATTR_LENGTH, "double")],
        KEY_SCHEMA)
    keys.write.format("xml").option("rowTag", "key").option("rootTag", "graphml").mode("overwrite").save(f"{path}/keys")

    def data(*pairs):
        return F.array(*[F.struct(F.lit(k).alias("_key"), v.cast("string").alias("_VALUE")) for k, v in pairs])

    (node.select(F.col("id").cast("string").alias("_id"), data(("d0", F.col("lat")), ("d1", F.col("lon"))).alias("data"))
     .write.format("xml").option("rowTag", "node").option("rootTag", "graphml").mode("overwrite").save(f"{path}/nodes"))
    (edge.select(F.col("u").cast("string").alias("_source"), F.col("v").cast("string").alias("_target"),
                 data(("d2", F.col("length"))).alias("data"))
     .write.format("xml").option("rowTag", "edge").option("rootTag", "graphml").mode("overwrite").save(f"{path}/edges"))


MAX_KEY_DECLARATIONS = 10_000


def _key_ids(keys: DataFrame, kind: str) -> dict[str, str]:
    """attr.name -> key id for one element kind.  Key declarations are the
    file's schema (a few rows); their count is checked before reading."""
    k = keys.where(F.col("_for").isin(kind, "all"))
    n = k.count()
    if n > MAX_KEY_DECLARATIONS:
        raise ValueError(f"{n} GraphML key declarations for {kind}: not a schema")
    return {r["_attr.name"]: r["_id"] for r in k.select("_id", "`_attr.name`").collect()}


def _attr(kv, ids: dict[str, str], name: str):
    return F.element_at(kv, F.lit(ids[name])) if name in ids else F.lit(None).cast("string")


def _read(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    return (spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true")
            .schema(schema).load(path))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """GraphML file(s) -> (node(id, lat, lon), edge(u, v, length)).

    ``path`` is one GraphML document, or a folder of them (searched
    recursively); each element kind is read from the same files with its
    own row tag, so a single-file street network and the folders written
    by :func:`write_graphml` both work."""
    keys = _read(spark, path, "key", KEY_SCHEMA)
    nodes = _read(spark, path, "node", NODE_SCHEMA)
    edges = _read(spark, path, "edge", EDGE_SCHEMA)
    nid, eid = _key_ids(keys, "node"), _key_ids(keys, "edge")
    kv = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"])))
    n = nodes.select(
        F.col("_id").try_cast("bigint").alias("id"),
        _attr(kv, nid, ATTR_LAT).try_cast("double").alias("lat"),
        _attr(kv, nid, ATTR_LON).try_cast("double").alias("lon"))
    e = edges.select(
        F.col("_source").try_cast("bigint").alias("u"), F.col("_target").try_cast("bigint").alias("v"),
        _attr(kv, eid, ATTR_LENGTH).try_cast("double").alias("length"))
    return n, e
