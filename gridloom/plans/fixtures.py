"""Geometry derived from the key columns of the test tables.

Each expression is valid in Spark SQL and in DuckDB and uses integers and one division, so
both give the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import GEOMETRY
from gridloom.plans.frame import SpatialFrame


def _cent(expr: str) -> str:
    return f"cast({expr} as double) / cast(100 as double)"


CUSTOMERS = ("customer", [
    "c_custkey as id", f"{_cent('(c_custkey * 7919) % 10007')} as x", f"{_cent('(c_custkey * 6007) % 10009')} as y", "c_acctbal as val", "c_mktsegment as seg",
])
ZONES = ("supplier", [
    "s_suppkey as pid", "s_name as pname", "cast((s_suppkey * 37) % 100 as double) as x0", "cast((s_suppkey * 53) % 100 as double) as y0",
    "cast((s_suppkey * 37) % 100 + 3 + s_suppkey % 7 as double) as x1", "cast((s_suppkey * 53) % 100 + 3 + s_suppkey % 5 as double) as y1",
])
TRIPS = ("orders", [
    "o_orderkey as tripkey", "o_custkey as custkey", "o_orderdate as ts",
    f"{_cent('(o_orderkey * 6007) % 10007')} as px", f"{_cent('(o_orderkey * 7919) % 10009')} as py",
    f"{_cent('(o_orderkey * 4001 + o_custkey * 31) % 10007')} as dx", f"{_cent('(o_orderkey * 9001 + o_custkey * 17) % 10009')} as dy",
    "o_totalprice as fare", "cast(o_orderkey % 7200 as bigint) as dur",
])
BUILDINGS = ("part", [
    "p_partkey as bkey", "p_name as bname", f"{_cent('(p_partkey * 3793) % 10007')} as x0", f"{_cent('(p_partkey * 5231) % 10009')} as y0",
    f"{_cent('(p_partkey * 3793) % 10007 + 50 + p_partkey % 150')} as x1", f"{_cent('(p_partkey * 5231) % 10009 + 50 + p_partkey % 110')} as y1",
])


def load(spark: SparkSession, sf_dir: str, fixture) -> DataFrame:
    table, columns = fixture
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def sql(fixture) -> str:
    table, columns = fixture
    return f"select {', '.join(columns)} from {table}"


def lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 400).alias("lon"), (F.col("embedding")[1].cast("double") * 200).alias("lat"))


LONLAT_SQL = "select vec_id as id, cast(embedding[1] as double) * 400 as lon, cast(embedding[2] as double) * 200 as lat from embeddings"


def boxes(df: DataFrame) -> SpatialFrame:
    """A polygon frame of the boxes x0, y0, x1, y1, without those columns."""
    ring = "array(struct(x0 as x, y0 as y), struct(x1 as x, y0 as y), struct(x1 as x, y1 as y), struct(x0 as x, y1 as y))"
    out = df.withColumn("geom", F.expr(f"array(array({ring}))").cast(GEOMETRY)).drop("x0", "y0", "x1", "y1")
    return SpatialFrame.from_polygons(out, "geom")


#: Rings of the mixed shapes over ZONES as (name, points, condition): triangles, holes and second parts.
RINGS = [
    ("triangle", [("x0", "y0"), ("x1", "y0"), ("x0", "y1")], "pid % 3 = 2"),
    ("rectangle", [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")], "pid % 3 <> 2"),
    ("hole", [("x0 + 1", "y0 + 1"), ("x1 - 1", "y0 + 1"), ("x1 - 1", "y1 - 1"), ("x0 + 1", "y1 - 1")], "pid % 5 = 0 and pid % 3 <> 2"),
    ("second", [("x0 + 20", "y0"), ("x1 + 20", "y0"), ("x1 + 20", "y1"), ("x0 + 20", "y1")], "pid % 4 = 1"),
]


def shapes(spark: SparkSession, sf_dir: str) -> SpatialFrame:
    """Triangles, rectangles with holes, and polygons of two parts."""
    ring = {}
    for name, points, when in RINGS:
        body = ", ".join(f"struct(cast({x} as double) as x, cast({y} as double) as y)" for x, y in points)
        ring[name] = f"case when {when} then array({body}) end"
    shell = f"coalesce({ring['triangle']}, {ring['rectangle']})"
    geometry = f"array_compact(array(array_compact(array({shell}, {ring['hole']})), case when pid % 4 = 1 then array({ring['second']}) end))"
    df = load(spark, sf_dir, ZONES).withColumn("geom", F.expr(geometry).cast(GEOMETRY))
    return SpatialFrame.from_polygons(df.select("pid", "pname", "geom"), "geom")


def edges_sql(kinds=("triangle", "rectangle", "hole", "second"), source: str | None = None) -> str:
    """DuckDB rows (pid, kind, ax, ay, bx, b_y): the edges of the mixed shapes."""
    out = []
    for name, points, when in RINGS:
        if name in kinds:
            for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]]):
                out.append(f"select pid, '{name}' kind, cast({ax} as double) ax, cast({ay} as double) ay, cast({bx} as double) bx, cast({by} as double) b_y from z where {when}")
    return f"(with z as ({source or sql(ZONES)}) {' union all '.join(out)})"


#: Zones whose odd keys are right triangles with equal legs, as rows (pid, x0, y0, x1, y1, c): the part of the box with x + y <= c.
CUT_SQL = f"""select pid, x0, y0, case when pid % 2 = 1 then x0 + x1 - x0 else x1 end x1, case when pid % 2 = 1 then y0 + x1 - x0 else y1 end y1,
case when pid % 2 = 1 then x1 + y0 else x1 + y1 end c from ({sql(ZONES)})"""


def cut_zones(spark: SparkSession, sf_dir: str) -> SpatialFrame:
    """The shapes of CUT_SQL: triangles and rectangles."""
    point = lambda x, y: f"struct({x} as x, {y} as y)"
    triangle = f"array({point('x0', 'y0')}, {point('x1', 'y0')}, {point('x0', 'y0 + x1 - x0')})"
    ring = f"array({point('x0', 'y0')}, {point('x1', 'y0')}, {point('x1', 'y1')}, {point('x0', 'y1')})"
    df = load(spark, sf_dir, ZONES).withColumn("geom", F.expr(f"array(array(case when pid % 2 = 1 then {triangle} else {ring} end))").cast(GEOMETRY))
    return SpatialFrame.from_polygons(df.select("pid", "geom"), "geom")
