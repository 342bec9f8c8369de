"""Coordination tables derived from the star-schema tables, as SQL that Spark and other engines read alike.

Each constant is a SELECT over the star-schema tables; ``frame`` runs it in Spark over a folder of Parquet files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

TYPE_SQL = """CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'IfcWall' WHEN 'LARGE' THEN 'IfcSlab' WHEN 'MEDIUM' THEN 'IfcBeam'
  WHEN 'PROMO' THEN 'IfcPipeSegment' WHEN 'SMALL' THEN 'IfcDoor' ELSE 'IfcBuildingElementProxy' END"""

#: Elements with boxes in whole millimetres; y is up.
ELEMENTS = f"""
SELECT p_partkey AS express_id, 'M' || CAST(p_partkey % 3 AS VARCHAR(9)) AS model_id, p_partkey AS pos, {TYPE_SQL} AS ifc_type,
  CASE WHEN p_size % 11 = 0 THEN '' ELSE 'L' || CAST(p_size % 5 AS VARCHAR(9)) END AS storey,
  p_name AS name, p_brand AS material,
  'G' || CAST(CASE WHEN p_partkey > 0 AND p_partkey % 97 = 0 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR(20)) AS global_id,
  (p_partkey * 7919) % 60000 AS x0, CAST((p_size % 5) * 3000 AS BIGINT) AS y0, (p_partkey * 104729) % 60000 AS z0,
  (p_partkey * 7919) % 60000 + 200 + p_size * 100 AS x1, CAST((p_size % 5) * 3000 + 300 + (p_size % 7) * 500 AS BIGINT) AS y1,
  (p_partkey * 104729) % 60000 + 200 + (p_partkey % 13) * 300 AS z1
FROM part"""

#: One tilted triangle per element.
TRIANGLES = """
SELECT p_partkey AS express_id, 'M' || CAST(p_partkey % 3 AS VARCHAR(9)) AS model_id, CAST(0 AS INT) AS tri_idx,
  CAST((p_partkey * 7919) % 6000 AS DOUBLE) AS x0, CAST((p_size % 5) * 300 AS DOUBLE) AS y0, CAST((p_partkey * 104729) % 6000 AS DOUBLE) AS z0,
  CAST((p_partkey * 7919) % 6000 + 1500 + p_size * 10 AS DOUBLE) AS x1, CAST((p_size % 5) * 300 + 700 AS DOUBLE) AS y1, CAST((p_partkey * 104729) % 6000 + 137 AS DOUBLE) AS z1,
  CAST((p_partkey * 7919) % 6000 + 211 AS DOUBLE) AS x2, CAST((p_size % 5) * 300 - 450 AS DOUBLE) AS y2, CAST((p_partkey * 104729) % 6000 + 1300 + (p_partkey % 13) * 50 AS DOUBLE) AS z2
FROM part"""

MODELS = """
SELECT 'M0' AS model_id, 0 AS pos, 'Architecture west' AS name, 'architectural' AS discipline UNION ALL
SELECT 'M1', 1, 'Structure', 'structural' UNION ALL
SELECT 'M2', 2, 'Services west', 'mep'"""

#: Clashes; (order, line) repeats, so id is not unique by intent of the source table.
CLASHES = f"""
SELECT l_orderkey * 10 + l_linenumber AS id,
  CASE l_returnflag WHEN 'N' THEN 'open' WHEN 'A' THEN 'resolved' ELSE 'closed' END AS status,
  CASE l_linestatus WHEN 'O' THEN 'hard' ELSE 'soft' END AS type,
  CASE l_linenumber % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' ELSE 'low' END AS priority,
  {TYPE_SQL} AS elem_a_type,
  CASE l_suppkey % 4 WHEN 0 THEN 'IfcDuctSegment' WHEN 1 THEN 'IfcWall' WHEN 2 THEN 'IfcBeam' END AS elem_b_type,
  CASE WHEN p_size % 11 = 0 THEN '' ELSE 'L' || CAST(p_size % 5 AS VARCHAR(9)) END AS elem_a_storey,
  CASE WHEN l_suppkey % 3 <> 0 THEN 'L' || CAST(l_suppkey % 5 AS VARCHAR(9)) END AS elem_b_storey,
  CASE p_partkey % 3 WHEN 0 THEN 'architectural' WHEN 1 THEN 'structural' ELSE 'mep' END AS discipline_a,
  CASE l_suppkey % 3 WHEN 0 THEN 'architectural' WHEN 1 THEN 'structural' ELSE 'mep' END AS discipline_b,
  p_partkey AS elem_a, l_suppkey AS elem_b, CAST(l_quantity AS BIGINT) AS distance_mm
FROM lineitem JOIN part ON l_partkey = p_partkey"""

CHANGELOG = """
SELECT event_id AS id, event_id AS pos, user_id AS target_id, event_type AS field, value, event_id % 3 = 0 AS is_local FROM events"""

#: Properties of the validation elements in order: set, key, present when, value.
PROPS = (
    ("Pset_WallCommon", "FireRating", "p_size % 3 <> 0", "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '60' WHEN 2 THEN 'REI 90' ELSE 'F7' END"),
    ("Pset_WallCommon", "IsExternal", "p_size % 5 <> 0", "CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END"),
    ("Custom", "firerating", "p_size % 7 = 0", "'120'"),
    ("Custom", "LoadBearing", "p_partkey % 4 <> 0", "CASE WHEN p_size % 2 = 0 THEN 'TRUE' ELSE 'false' END"),
    ("Custom", "ThermalTransmittance", "p_partkey % 6 = 0", "'0.21'"),
    ("Custom", "AcousticRating", "p_partkey % 5 = 0", "' 52 '"),
    ("NL-SfB", "Code", "p_partkey % 7 <> 0", "CASE p_size % 6 WHEN 0 THEN '21.11' WHEN 1 THEN '(28)' WHEN 2 THEN '22' WHEN 3 THEN 'x9' WHEN 4 THEN ' ' ELSE '57.1' END"),
    ("NL-SfB", "classification", "p_size % 13 = 0", "'32.3'"),
    ("Status", "Status", "p_partkey % 3 <> 0", "CASE p_size % 3 WHEN 0 THEN 'Existing' WHEN 1 THEN 'te slopen' ELSE 'unknown' END"),
)

#: The same in long form, in order of pos.
ELEMENT_PROPS = " UNION ALL ".join(f"SELECT p_partkey AS express_id, '{pset}' AS pset, {i} AS pos, '{key}' AS k, {value} AS v FROM part WHERE {when}" for i, (pset, key, when, value) in enumerate(PROPS))

#: Elements for the validation rules, with blanks, nulls and more types.
DQ_ELEMENTS = """
SELECT p_partkey AS express_id, 'M' || CAST(p_partkey % 3 AS VARCHAR(9)) AS model_id, p_partkey AS pos,
  CASE p_partkey % 16 WHEN 0 THEN 'IfcWall' WHEN 1 THEN 'IfcWallStandardCase' WHEN 2 THEN 'IfcSlab' WHEN 3 THEN 'IfcRoof' WHEN 4 THEN 'IfcColumn'
    WHEN 5 THEN 'IfcBeam' WHEN 6 THEN 'IfcDoor' WHEN 7 THEN 'IfcWindow' WHEN 8 THEN 'IfcCovering' WHEN 9 THEN 'IfcSpace' WHEN 10 THEN 'IfcBuildingStorey'
    WHEN 11 THEN 'IfcPipeSegment' WHEN 12 THEN 'IfcDuctSegment' WHEN 13 THEN 'IfcBuildingElementProxy' WHEN 14 THEN 'IfcRailing' ELSE 'IfcAnnotation' END AS ifc_type,
  CASE p_partkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '12-3_4' WHEN 3 THEN 'Basic Wall 200' WHEN 4 THEN ' Door ' WHEN 5 THEN 'Wall 200mm' WHEN 6 THEN 'D-001'
    WHEN 7 THEN '01 Ground' WHEN 8 THEN 'Slab 25 cm' ELSE p_name END AS name,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Room ' || CAST(p_partkey AS VARCHAR(20)) END AS long_name,
  CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN p_name ELSE 'made by ' || p_brand END AS description,
  CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '21 22 23 frame' WHEN 3 THEN 'type (28)' ELSE p_type END AS object_type,
  CASE WHEN p_size % 11 = 0 THEN '' WHEN p_size % 13 = 0 THEN NULL ELSE 'L' || CAST(p_size % 5 AS VARCHAR(9)) END AS storey,
  CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Beton C30/37' ELSE p_brand END AS material,
  CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 43 = 0 THEN ' ' WHEN p_partkey > 0 AND p_partkey % 97 = 0 THEN 'G' || CAST(p_partkey - 1 AS VARCHAR(20)) ELSE 'G' || CAST(p_partkey AS VARCHAR(20)) END AS global_id,
  CASE WHEN p_partkey % 3 = 0 THEN 'H' || CAST(p_partkey AS VARCHAR(20)) END AS host_id,
  CASE WHEN p_partkey % 10 = 0 THEN '0' WHEN p_partkey % 10 = 1 THEN '150' END AS layer_width,
  CASE WHEN p_partkey % 19 = 0 THEN 0 WHEN p_partkey % 19 = 1 THEN NULL ELSE 2 END AS n_meshes,
  CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size AS VARCHAR(9)) || ' mm' END AS q_width,
  CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_size < 3 THEN '-1.5 m2' ELSE CAST(p_size - 3 AS VARCHAR(9)) || '.5 m2' END END AS q_area,
  CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size AS VARCHAR(9)) END AS q_volume, p_partkey, p_size
FROM part"""


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the SELECTs above over the tables of a folder."""
    used = tuple(name for name in TABLES if re.search(rf"\b(FROM|JOIN) {name}\b", sql))
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql), **tables(spark, sf_dir, used))
