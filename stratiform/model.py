"""Binds the star-schema test tables to the domain: ontology, cells, rasters, series, runs, events.

The only module that knows those tables' column names. SQL gives the same relations as
common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import raster

ROOT, AP_MAX = 997, 527
HEIGHT, WIDTH = 512, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def structure(spark: SparkSession, d: str) -> DataFrame:
    """Ontology: root, regions, nations, suppliers as levels 0 to 3."""
    cols = ["id", "name", "acronym", "parent_structure_id", "structure_id_path", "depth", "graph_order", "hemisphere_id"]
    root = spark.sql("select 997 id, 'root' name, 'root' acronym, cast(null as int) parent_structure_id, '/997/' structure_id_path, 0 depth, 997 graph_order, 3 hemisphere_id")
    r = table(spark, d, "region").selectExpr("cast(1000 + r_regionkey as int) id", "r_name name", "concat('R', r_regionkey) acronym", "997 parent_structure_id", "concat('/997/', 1000 + r_regionkey, '/') structure_id_path", "1 depth", "cast(1000 + r_regionkey as int) graph_order", "3 hemisphere_id")
    nation = table(spark, d, "nation")
    n = nation.selectExpr("cast(2000 + n_nationkey as int) id", "n_name name", "concat('N', n_nationkey) acronym", "cast(1000 + n_regionkey as int) parent_structure_id", "concat('/997/', 1000 + n_regionkey, '/', 2000 + n_nationkey, '/') structure_id_path", "2 depth", "cast(2000 + n_nationkey as int) graph_order", "3 hemisphere_id")
    s = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.selectExpr("cast(10000 + s_suppkey as int) id", "s_name name", "concat('S', s_suppkey) acronym", "cast(2000 + n_nationkey as int) parent_structure_id", "concat('/997/', 1000 + n_regionkey, '/', 2000 + n_nationkey, '/', 10000 + s_suppkey, '/') structure_id_path", "3 depth", "cast(10000 + s_suppkey as int) graph_order", "cast(1 + s_suppkey % 3 as int) hemisphere_id")
    return root.select(cols).unionByName(r.select(cols)).unionByName(n.select(cols)).unionByName(s.select(cols))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Detections with a region, from the largest table."""
    return table(spark, d, "lineitem").selectExpr(
        "cast(l_orderkey * 8 + l_linenumber as bigint) cell_id", "cast(l_orderkey % 64 as int) slice_id", "l_quantity * 10 x", "cast(l_partkey % 500 as double) y", "l_extendedprice score",
        "case when l_returnflag = 'N' then null else l_returnflag end detector", "l_linestatus channel", "l_returnflag sample", "l_extendedprice area_px", "l_discount elongation", "l_tax mean_intensity",
        "cast(case when l_partkey % 20 = 0 then 0 when l_partkey % 31 = 0 then 900000 + l_suppkey else 10000 + l_suppkey end as int) region_id")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Detections with unique ids, for suppression and look-ups."""
    return table(spark, d, "events").selectExpr("cast(event_id as bigint) cell_id", "cast(user_id as int) slice_id", "round(value, 3) x", "cast(event_id % 97 as double) y", "value score", "event_type detector")


def slices(spark: SparkSession, d: str, rows: int, least: int) -> int:
    """How many images a table's generated stack has: one for so many orders."""
    return max(least, table(spark, d, "orders").count() // rows)


def label_raster(spark: SparkSession, d: str) -> DataFrame:
    """Tall label images, one for 5000 orders: 0 outside a disc, the root in one block, else a leaf."""
    n = HEIGHT * WIDTH
    df = spark.range(slices(spark, d, 5000, 4) * n).selectExpr(f"cast(id div {n} as int) slice_id", f"cast(id % {n} div {WIDTH} as int) y", f"cast(id % {WIDTH} as int) x")
    return df.selectExpr("slice_id", "y", "x", "cast(case when (x - 256) * (x - 256) + (y - 256) * (y - 256) > 57600 then 0 when x < 200 and y between 200 and 220 then 997 else 10001 + (x div 25 * 7 + y div 25 * 13 + slice_id) % 10 end as int) region_id")


def image_stack(spark: SparkSession, d: str) -> DataFrame:
    """Seeded noise with bright spots as 64 x 64 slices, one for 1000 orders."""
    return raster.synthetic_slices(spark, slices(spark, d, 1000, 12))


def slice_qc(spark: SparkSession, d: str) -> DataFrame:
    """One row a slice and series: series = customer segment block."""
    return table(spark, d, "orders").selectExpr("cast(o_orderkey % 40 as int) series", "cast(o_orderkey div 40 as int) slice_id", "cast(150 + o_orderkey div 400 % 200 + o_orderkey * 7 % 13 - 6 + case when o_orderkey % 29 = 0 then 40 else 0 end as int) best_z", "o_orderkey % 17 <> 0 registration_ok", "o_totalprice % 1.0 best_score").groupBy("series", "slice_id").agg(F.max("best_z").alias("best_z"), F.max("registration_ok").alias("registration_ok"), F.max("best_score").alias("best_score"))


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """run_name, stage (pre, post), metric, value as text: one row each."""
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("run_name"), F.when(F.col("p_partkey") % 2 == 0, "pre").otherwise("post").alias("stage")).agg(F.sum("p_size").alias("s"), F.count("*").alias("c"))
    stack = "stack(6, 'NCC', cast((s % 97) / 97.0 as double), 'SSIM', cast((s % 89) / 89.0 as double), 'Dice', cast((s % 83) / 83.0 as double), 'MSE', cast((s % 79) / 7900.0 as double), 'PSNR', cast(10 + s % 17 as double), 'note', cast(null as double)) as (metric, v)"
    return p.selectExpr("run_name", "stage", stack).selectExpr("run_name", "stage", "metric", "coalesce(cast(round(v, 6) as string), 'n/a') value")


def run_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("cast(event_id as bigint) id", "concat('s', user_id) sample_id", "concat('p', user_id % 7) project_id", "case event_type when 'click' then 'queued' when 'view' then 'running' when 'purchase' then 'done' when 'signup' then 'error' else 'cancel' end event", "ts timestamp", "props data")


SQL = {
    "structure": """structure AS (
  SELECT 997 AS id, 'root' AS name, 'root' AS acronym, NULL::INT AS parent_structure_id, '/997/' AS structure_id_path, 0 AS depth, 997 AS graph_order, 3 AS hemisphere_id
  UNION ALL SELECT (1000 + r_regionkey)::INT, r_name, 'R' || r_regionkey, 997, '/997/' || (1000 + r_regionkey) || '/', 1, (1000 + r_regionkey)::INT, 3 FROM region
  UNION ALL SELECT (2000 + n_nationkey)::INT, n_name, 'N' || n_nationkey, (1000 + n_regionkey)::INT, '/997/' || (1000 + n_regionkey) || '/' || (2000 + n_nationkey) || '/', 2, (2000 + n_nationkey)::INT, 3 FROM nation
  UNION ALL SELECT (10000 + s_suppkey)::INT, s_name, 'S' || s_suppkey, (2000 + n_nationkey)::INT, '/997/' || (1000 + n_regionkey) || '/' || (2000 + n_nationkey) || '/' || (10000 + s_suppkey) || '/', 3, (10000 + s_suppkey)::INT, (1 + s_suppkey % 3)::INT FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "cells": """cells AS (SELECT (l_orderkey * 8 + l_linenumber)::BIGINT AS cell_id, (l_orderkey % 64)::INT AS slice_id, l_quantity * 10 AS x, (l_partkey % 500)::DOUBLE AS y, l_extendedprice AS score,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS detector, l_linestatus AS channel, l_returnflag AS sample, l_extendedprice AS area_px, l_discount AS elongation, l_tax AS mean_intensity,
  (CASE WHEN l_partkey % 20 = 0 THEN 0 WHEN l_partkey % 31 = 0 THEN 900000 + l_suppkey ELSE 10000 + l_suppkey END)::INT AS region_id FROM lineitem)""",
    "points": """points AS (SELECT event_id::BIGINT AS cell_id, user_id::INT AS slice_id, round(value, 3) AS x, (event_id % 97)::DOUBLE AS y, value AS score, event_type AS detector FROM events)""",
    "label_raster": f"""label_raster AS (SELECT slice_id, y, x, (CASE WHEN (x - 256) * (x - 256) + (y - 256) * (y - 256) > 57600 THEN 0 WHEN x < 200 AND y BETWEEN 200 AND 220 THEN 997 ELSE 10001 + (x // 25 * 7 + y // 25 * 13 + slice_id) % 10 END)::INT AS region_id
  FROM (SELECT (id // {HEIGHT * WIDTH})::INT AS slice_id, (id % {HEIGHT * WIDTH} // {WIDTH})::INT AS y, (id % {WIDTH})::INT AS x FROM (SELECT unnest(range(greatest(4, (SELECT count(*) FROM orders) // 5000) * {HEIGHT * WIDTH})) AS id)))""",
    "image_stack": """image_stack AS (SELECT (id // 4096)::INT AS slice_id, (id % 4096 // 64)::INT AS y, (id % 64)::INT AS x, ((id * 1103515245 + 12345) % 2147483648 // 65536 % 120 + CASE WHEN id % 64 % 16 = 8 AND id % 4096 // 64 % 16 = 8 THEN 400 + id // 4096 ELSE 0 END)::INT AS value FROM (SELECT unnest(range(greatest(12, (SELECT count(*) FROM orders) // 1000) * 4096)) AS id))""",
    "slice_qc": """slice_qc AS (SELECT series, slice_id, max(best_z) AS best_z, bool_or(ok) AS registration_ok, max(score) AS best_score FROM (SELECT (o_orderkey % 40)::INT AS series, (o_orderkey // 40)::INT AS slice_id,
  (150 + o_orderkey // 400 % 200 + o_orderkey * 7 % 13 - 6 + CASE WHEN o_orderkey % 29 = 0 THEN 40 ELSE 0 END)::INT AS best_z, o_orderkey % 17 <> 0 AS ok, o_totalprice % 1.0 AS score FROM orders) GROUP BY 1, 2)""",
    "run_metrics": """pm AS (SELECT p_brand AS run_name, CASE WHEN p_partkey % 2 = 0 THEN 'pre' ELSE 'post' END AS stage, sum(p_size)::BIGINT AS s FROM part GROUP BY 1, 2),
run_metrics AS (SELECT run_name, stage, m.metric AS metric, round(m.v, 6) AS v FROM (SELECT run_name, stage, unnest([{'metric': 'NCC', 'v': (s % 97)::DOUBLE / 97}, {'metric': 'SSIM', 'v': (s % 89)::DOUBLE / 89}, {'metric': 'Dice', 'v': (s % 83)::DOUBLE / 83}, {'metric': 'MSE', 'v': (s % 79)::DOUBLE / 7900}, {'metric': 'PSNR', 'v': (10 + s % 17)::DOUBLE}]) AS m FROM pm))""",
    "run_events": """run_events AS (SELECT event_id::BIGINT AS id, 's' || user_id AS sample_id, 'p' || (user_id % 7) AS project_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'error' ELSE 'cancel' END AS event, ts AS timestamp, props AS data FROM events)""",
}


def with_sql(*names: str, body: str) -> str:
    """The named relations as common table expressions before a query; `body` may begin with more of them."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + body
