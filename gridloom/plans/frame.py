"""SpatialFrame: a DataFrame with a geometry role, and the lazy plan builder over it.

Plans compile to one DataFrame; nothing runs before an action, except the small statistics
job of a join's target (its extent and box sizes) and the column checks at construction.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import distance as dist
from gridloom.functions import geometry as geo
from gridloom.functions import kernels, wkb
from gridloom.operators import joins
from gridloom.operators.aggregates import AggSpec
from gridloom.operators.boxjoin import extent_of, valid
from gridloom.operators.staging import staged
from gridloom.plans.nodes import Node

MODES = ("auto", "eager", "none")
#: Half a thousand machine epsilons either way make two coordinates equal.
POINT_EPS = 1000 * 2.0**-52
GEOM = "__geometry"


def _check(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"column {c!r} is not in the frame")


def _columns(args) -> list[str]:
    return list(args[0]) if len(args) == 1 and isinstance(args[0], (list, tuple)) else list(args)


class SpatialFrame:
    """Rows with a point (two numeric columns) or a polygon (nested arrays or WKB).

    The first form takes point columns; the class methods take WKB, polygons and files.
    index_mode is accepted (auto, eager, none) and never changes results.
    """

    def __init__(self, df: DataFrame, x_col: str, y_col: str, index_mode: str = "auto", coordinate_system: str | None = None):
        _check(df, x_col, y_col)
        for c in (x_col, y_col):
            if not isinstance(df.schema[c].dataType, T.NumericType):
                raise TypeError(f"column {c!r} is not numeric")
        self._init(df, "point", index_mode, coordinate_system, x_col=x_col, y_col=y_col)

    def _init(self, df, kind, index_mode, coordinate_system, x_col=None, y_col=None, geom_col=None, hidden=()):
        if index_mode not in MODES:
            raise ValueError(f"index_mode must be one of {MODES}")
        self._system = dist.resolve_system(coordinate_system)
        if kind == "polygon" and self._system == "geographic":
            raise ValueError("polygons are planar")
        self._df, self.kind, self.index_mode = df, kind, index_mode
        self.x_col, self.y_col, self.geom_col, self._hidden = x_col, y_col, geom_col, tuple(hidden)
        if self._system == "geographic":
            dist.warn_out_of_range(df, F.col(f"`{x_col}`").cast("double"), F.col(f"`{y_col}`").cast("double"))

    @classmethod
    def _make(cls, df, kind, index_mode="auto", coordinate_system=None, **roles) -> "SpatialFrame":
        out = cls.__new__(cls)
        out._init(df, kind, index_mode, coordinate_system, **roles)
        return out

    def _like(self, df: DataFrame) -> "SpatialFrame":
        out = SpatialFrame.__new__(SpatialFrame)
        out.__dict__.update(self.__dict__)
        out._df = df
        return out

    # -- constructors ---------------------------------------------------------------------

    @classmethod
    def from_wkb_points(cls, df: DataFrame, wkb_col: str, x_col: str = "_x", y_col: str = "_y", index_mode: str = "auto", coordinate_system: str | None = None) -> "SpatialFrame":
        """Decode WKB points to x_col and y_col; the WKB column stays."""
        _check(df, wkb_col)
        if not isinstance(df.schema[wkb_col].dataType, T.BinaryType):
            raise TypeError(f"column {wkb_col!r} is not binary")
        x, y = wkb.points_to_xy(F.col(f"`{wkb_col}`"))
        return cls(df.withColumns({x_col: x, y_col: y}), x_col, y_col, index_mode, coordinate_system)

    @classmethod
    def from_polygons(cls, df: DataFrame, geometry_col: str, index_mode: str = "auto", coordinate_system: str | None = None) -> "SpatialFrame":
        """Polygons as part -> ring -> struct(x, y) arrays; the column stays."""
        _check(df, geometry_col)
        want = T._parse_datatype_string(geo.GEOMETRY)
        if df.schema[geometry_col].dataType.simpleString() != want.simpleString():
            raise TypeError(f"column {geometry_col!r} is not {geo.GEOMETRY}")
        return cls._make(df.withColumn(GEOM, F.col(f"`{geometry_col}`")), "polygon", index_mode, coordinate_system, geom_col=geometry_col, hidden=(GEOM,))

    @classmethod
    def from_wkb_polygons(cls, df: DataFrame, wkb_col: str, index_mode: str = "auto", coordinate_system: str | None = None, keep_wkb: bool = False) -> "SpatialFrame":
        """Decode WKB polygons and multipolygons; the WKB column goes unless kept."""
        _check(df, wkb_col)
        if not isinstance(df.schema[wkb_col].dataType, T.BinaryType):
            raise TypeError(f"column {wkb_col!r} is not binary")
        out = df.withColumn(GEOM, wkb.polygons(F.col(f"`{wkb_col}`")))
        return cls._make(out if keep_wkb else out.drop(wkb_col), "polygon", index_mode, coordinate_system, geom_col=GEOM, hidden=(GEOM,))

    @classmethod
    def from_lazy(cls, frame: DataFrame, geometry_col: str, geometry_kind: str, index_mode: str = "auto", coordinate_system: str | None = None, ingest_batch_size: int = 32768) -> "SpatialFrame":
        """A frame over WKB that is read only when a plan runs; results keep the WKB column."""
        if geometry_kind not in ("point", "polygon"):
            raise ValueError("geometry_kind must be 'point' or 'polygon'")
        if ingest_batch_size < 1:
            raise ValueError("ingest_batch_size must be positive")
        if geometry_kind == "polygon":
            return cls.from_wkb_polygons(frame, geometry_col, index_mode, coordinate_system, keep_wkb=True)
        _check(frame, geometry_col)
        if not isinstance(frame.schema[geometry_col].dataType, T.BinaryType):
            raise TypeError(f"column {geometry_col!r} is not binary")
        x, y = wkb.points_to_xy(F.col(f"`{geometry_col}`"))
        df = frame.withColumns({"__x": x, "__y": y})
        return cls._make(df, "point", index_mode, coordinate_system, x_col="__x", y_col="__y", hidden=("__x", "__y"))

    @classmethod
    def scan_parquet(cls, spark: SparkSession, source: str | list[str], geometry_col: str, geometry_kind: str, index_mode: str = "auto", coordinate_system: str | None = None, storage_options: dict | None = None, **scan_options) -> "SpatialFrame":
        """from_lazy over Parquet: a path, a glob, a list or a remote address."""
        paths = [source] if isinstance(source, str) else list(source)
        reader = spark.read.options(**{**(storage_options or {}), **scan_options})
        return cls.from_lazy(reader.parquet(*paths), geometry_col, geometry_kind, index_mode, coordinate_system)

    # -- properties -----------------------------------------------------------------------

    @property
    def df(self) -> DataFrame:
        return self._df.drop(*self._hidden) if self._hidden else self._df

    @property
    def coordinate_system(self) -> str:
        return self._system

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if c not in self._hidden]

    @property
    def n(self) -> int:
        return self._df.count()

    def _box(self):
        if self.kind == "point":
            x, y = F.col(f"`{self.x_col}`").cast("double"), F.col(f"`{self.y_col}`").cast("double")
            return x, y, x, y
        b = geo.bounds(F.col(f"`{GEOM}`"))
        return b["x0"], b["y0"], b["x1"], b["y1"]

    @property
    def extent(self) -> tuple[float, float, float, float] | None:
        """Box of all geometry; None if there is none."""
        e = extent_of(self._df, self._box())
        return (e.x0, e.y0, e.x1, e.y1) if e.rows else None

    def stats(self) -> dict:
        e = extent_of(self._df, self._box())
        return {"n": self.n, "n_valid": e.rows, "kind": self.kind if e.rows else "empty", "extent": self.extent, "levels": e.levels}

    def __repr__(self) -> str:
        return f"SpatialFrame({self.kind}, {self._system}, [{', '.join(self.columns)}])"

    def set_index_mode(self, mode: str) -> str:
        """Set the mode and return the one before; results never change."""
        if mode not in MODES:
            raise ValueError(f"index_mode must be one of {MODES}")
        before, self.index_mode = self.index_mode, mode
        return before

    def build_index(self) -> "SpatialFrame":
        """Cache the decoded geometry for repeated use."""
        self._df = self._df.persist()
        return self

    # -- frame operations -----------------------------------------------------------------

    def lazy(self) -> "SpatialPlan":
        return SpatialPlan(self, ())

    def append(self, rows: DataFrame) -> "SpatialFrame":
        """The frame with more rows of the same visible columns, seen at once by every plan."""
        if self.kind == "polygon" and self.geom_col != GEOM:
            rows = rows.withColumn(GEOM, F.col(f"`{self.geom_col}`"))
        return self._like(self._df.unionByName(rows))

    def union(self, other: "SpatialFrame") -> "SpatialFrame":
        """All rows of both frames, repeats included; columns meet by name."""
        return self._like(self._df.unionByName(other._df))

    def intersect(self, other: "SpatialFrame") -> "SpatialFrame":
        """Distinct rows that both frames hold, geometry included."""
        return self._like(self._df.intersect(other._df.select(self._df.columns)))

    def subtract(self, other: "SpatialFrame") -> "SpatialFrame":
        """Distinct rows that the other frame does not hold."""
        return self._like(self._df.subtract(other._df.select(self._df.columns)))

    def flush(self) -> "SpatialFrame":
        """Cut the lineage of appended rows by a reliable checkpoint where a folder is set; else cache."""
        spark = self._df.sparkSession
        held = spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
        return self._like(self._df.checkpoint() if held else self._df.persist())

    def subset(self, keys: list, key_col: str) -> "SpatialFrame":
        """Rows of the given keys, in their order and with repeats; an unknown key raises IndexError."""
        spark = self._df.sparkSession
        kind = self._df.schema[key_col].dataType
        wanted = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], T.StructType([T.StructField("__pos", T.LongType()), T.StructField("__key", kind)]))
        joined = wanted.join(self._df, wanted["__key"] == self._df[key_col], "left")
        if not joined.filter(F.col(f"`{key_col}`").isNull()).isEmpty():
            raise IndexError("subset: a key is not in the frame")
        return self._like(joined.orderBy("__pos").drop("__pos", "__key"))

    def range_filter(self, min_x: float, min_y: float, max_x: float, max_y: float) -> "SpatialFrame":
        return self._like(_range(self, self._df, min_x, min_y, max_x, max_y))

    def range_mask(self, min_x: float, min_y: float, max_x: float, max_y: float, name: str = "inside") -> DataFrame:
        """Every row with a boolean: whether range_filter would keep it; false where the geometry is missing."""
        return self._df.withColumn(name, F.coalesce(_in_range(self, min_x, min_y, max_x, max_y), F.lit(False))).drop(*self._hidden)

    def contains_mask(self, x: float, y: float, name: str = "inside") -> DataFrame:
        """Every row with a boolean: whether the step contains(x, y) would keep it."""
        return self._df.withColumn(name, F.coalesce(_holds(self, float(x), float(y)), F.lit(False))).drop(*self._hidden)

    def intersect_ranges(self, boxes: list[tuple[float, float, float, float]]) -> "SpatialFrame":
        """Rows that meet every box; without a box, none."""
        df = self._df if boxes else self._df.limit(0)
        for box in boxes:
            df = _range(self, df, *box)
        return self._like(df)

    @staticmethod
    def intersect_hits(hits: list[DataFrame], key: str) -> DataFrame:
        """Distinct keys that all the given results hold, in order."""
        if not hits:
            raise ValueError("intersect_hits needs at least one result")
        met = hits[0].select(key).distinct()
        for other in hits[1:]:
            met = met.join(other.select(key), key, "left_semi")
        return met.orderBy(key)

    def polygon_areas(self) -> DataFrame:
        """The rows with a column area."""
        self._need("polygon")
        return self._df.withColumn("area", geo.area(F.col(f"`{GEOM}`"))).drop(*self._hidden)

    def distinct_shapes(self, name: str = "shape") -> tuple["SpatialFrame", DataFrame]:
        """A frame of the distinct geometries, numbered in the column name, and the visible rows with the number of theirs."""
        self._need("polygon")
        rows = self._df.filter(F.size(F.col(f"`{GEOM}`")) > 0)
        shapes = staged(rows.select(GEOM).distinct().withColumn(name, F.monotonically_increasing_id()), "shapes")
        return SpatialFrame._make(shapes, "polygon", self.index_mode, geom_col=GEOM, hidden=(GEOM,)), rows.join(shapes, GEOM).drop(GEOM)

    def intersects_pairs(self, key_col: str | None = None) -> DataFrame:
        """Pairs of polygons that meet. Without a key: left and right number the rows; with one:
        <key>_1 holds the smaller key, and areas stay with the positions."""
        return _pairs(self, self._df, key_col)

    def closest_pairs(self, key_col: str, k: int, digits: int = 6) -> DataFrame:
        """Those rows of intersects_pairs(key_col) that may be among the k of highest IoU, rounded to digits."""
        return _pairs(self, self._df, key_col, k, 10.0**-digits)

    def radius_query(self, cx: float, cy: float, distance: float) -> DataFrame:
        return self.lazy().within_distance_of_point(cx, cy, distance).to_df()

    def points_within_distance_of_polygon(self, polygon, distance: float) -> DataFrame:
        return self.lazy().points_within_distance_of_polygon(polygon, distance).to_df()

    @staticmethod
    def convex_hull_area(xs, ys) -> float:
        if len(xs) != len(ys):
            raise ValueError("xs and ys differ in length")
        return kernels.hull_area(xs, ys)

    def _need(self, kind: str) -> None:
        if self.kind != kind:
            raise ValueError(f"this operation needs a {kind} frame")


def _in_range(frame: SpatialFrame, x0, y0, x1, y1) -> Column:
    if frame.kind == "point":
        x, y = F.col(f"`{frame.x_col}`"), F.col(f"`{frame.y_col}`")
        return x.between(float(x0), float(x1)) & y.between(float(y0), float(y1))
    g = F.col(f"`{GEOM}`")
    return geo.meets_box(geo.shell_edges(g), geo.bounds(g), float(x0), float(y0), float(x1), float(y1))


def _range(frame: SpatialFrame, df: DataFrame, x0, y0, x1, y1) -> DataFrame:
    return df.filter(_in_range(frame, x0, y0, x1, y1))


def _pairs(frame: SpatialFrame, df: DataFrame, key_col: str | None, closest: int = 0, slack: float = 0.0) -> DataFrame:
    frame._need("polygon")
    keys = [key_col] if key_col else []
    if key_col:
        _check(df, key_col)
    if not key_col:  # numbered once, so that both sides of the join see the same numbers
        df, keys = staged(df.select(GEOM).withColumn("_n", F.monotonically_increasing_id()), "polygons"), ["_n"]
    side, order = joins.polygon_side(df, keys, GEOM), F.col(f"`t_{keys[0]}`")
    met = joins.closest_pairs(side, order, closest, slack) if closest else joins.intersecting_pairs(side, order)
    first, second = (f"{key_col}_1", f"{key_col}_2") if key_col else ("left", "right")
    return met.select(F.col("l__o").alias(first), F.col("r__o").alias(second), F.col("l__area").alias("area_left"), F.col("r__area").alias("area_right"), "overlap_area", "iou")


class SpatialPlan:
    """Immutable builder: every method returns a plan with one more node."""

    def __init__(self, frame: SpatialFrame, nodes: tuple[Node, ...]):
        self.frame, self.nodes = frame, nodes

    def _add(self, op: str, **args) -> "SpatialPlan":
        if self.nodes and self.nodes[-1].op == "select":
            raise ValueError("select must be the last step of a plan")
        if any(n.is_join for n in self.nodes) and op not in ("filter", "select"):
            raise ValueError(f"{op} cannot follow a join")
        return SpatialPlan(self.frame, (*self.nodes, Node(op, args)))

    def filter(self, condition: Column | str) -> "SpatialPlan":
        return self._add("filter", condition=condition)

    def select(self, *columns) -> "SpatialPlan":
        return self._add("select", columns=_columns(columns))

    def range_query(self, min_x, min_y, max_x, max_y) -> "SpatialPlan":
        return self._add("range_query", box=(float(min_x), float(min_y), float(max_x), float(max_y)))

    def contains(self, x, y) -> "SpatialPlan":
        return self._add("contains", x=float(x), y=float(y))

    def knn(self, x, y, k: int, tie: str | None = None) -> "SpatialPlan":
        """The k nearest rows among those that earlier steps leave; ties by the column tie, if named."""
        if k < 0:
            raise ValueError("k must not be negative")
        return self._add("knn", x=float(x), y=float(y), k=int(k), tie=tie)

    def within_distance_of_point(self, cx, cy, distance) -> "SpatialPlan":
        self.frame._need("point")
        return self._add("within_distance_of_point", cx=float(cx), cy=float(cy), distance=float(distance))

    def points_within_distance_of_polygon(self, polygon, distance) -> "SpatialPlan":
        self.frame._need("point")
        return self._add("points_within_distance_of_polygon", polygon=geo.as_parts(polygon), distance=float(distance))

    def knn_join(self, query: DataFrame, x: str, y: str, k: int, tie: str | None = None) -> "SpatialPlan":
        self.frame._need("point")
        return self._add("knn_join", query=query, x=x, y=y, k=int(k), tie=tie)

    def within_distance_join(self, query: DataFrame, x: str, y: str, distance: float) -> "SpatialPlan":
        self.frame._need("point")
        return self._add("within_distance_join", query=query, x=x, y=y, distance=float(distance))

    def within_join(self, query: DataFrame, x: str, y: str) -> "SpatialPlan":
        self.frame._need("polygon")
        return self._add("within_join", query=query, x=x, y=y)

    def polygon_within_distance_join(self, query: DataFrame, x: str, y: str, distance: float) -> "SpatialPlan":
        self.frame._need("polygon")
        return self._add("polygon_within_distance_join", query=query, x=x, y=y, distance=float(distance))

    def polygon_knn_join(self, query: DataFrame, x: str, y: str, k: int, sorted_output: bool = False, tie: str | None = None) -> "SpatialPlan":
        self.frame._need("polygon")
        return self._add("polygon_knn_join", query=query, x=x, y=y, k=int(k), sorted_output=sorted_output, tie=tie)

    def intersects_pairs(self, key_col: str | None = None) -> "SpatialPlan":
        self.frame._need("polygon")
        return self._add("intersects_pairs", key_col=key_col)

    def group_by(self, *keys) -> "SpatialGroups":
        return SpatialGroups(self, _columns(keys))

    # -- compilation ----------------------------------------------------------------------

    def to_df(self) -> DataFrame:
        """The plan as one DataFrame."""
        return _compile(self.frame, self.frame._df, self.nodes)

    lazy_source = to_df

    def collect(self, batch_size: int | None = None) -> DataFrame:
        """Same as to_df; Spark runs it at the first action. batch_size never changes results."""
        return self.to_df()

    def collect_batched(self, batch_size: int | None = None) -> Iterator[list]:
        """Rows in lists of batch_size; one partition and the one after it are fetched at a time."""
        held: list = []
        for row in self.to_df().toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == (batch_size or 262_144):
                yield held
                held = []
        if held:
            yield held

    def sink_parquet(self, path: str, batch_size: int | None = None, mode: str = "errorifexists") -> None:
        """Write the result as a Parquet dataset, with its schema even if it is empty."""
        self.to_df().write.mode(mode).parquet(path)

    @staticmethod
    def collect_all(plans: list["SpatialPlan"]) -> list[DataFrame]:
        """Results of plans over one frame; a common prefix of steps is cached once for all."""
        if not plans:
            raise ValueError("collect_all needs at least one plan")
        frame = plans[0].frame
        if any(p.frame is not frame for p in plans):
            raise ValueError("collect_all needs plans over one frame")
        n = 0
        while all(len(p.nodes) > n and p.nodes[n] is plans[0].nodes[n] for p in plans) and not plans[0].nodes[n].is_join and plans[0].nodes[n].op != "select":
            n += 1
        if not n or len(plans) == 1:
            return [p.to_df() for p in plans]
        shared = _compile(frame, frame._df, plans[0].nodes[:n], raw=True).persist()
        return [_compile(frame, shared, p.nodes[n:]) for p in plans]

    def explain(self, physical: bool = False) -> str:
        """The steps as text; with physical, Spark's formatted plan after them."""
        lines = [repr(self.frame), *[f"{'  ' * (i + 1)}{n.label()}" for i, n in enumerate(self.nodes)]]
        if physical:
            lines.append(self.to_df()._jdf.queryExecution().explainString(self.frame._df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return "\n".join(lines)


class SpatialGroups:
    """A pending grouped aggregation over a plan."""

    def __init__(self, plan: SpatialPlan, keys: list[str]):
        self.plan, self.keys = plan, keys

    def agg(self, **named: AggSpec) -> DataFrame:
        """One row per group; without keys one row for all."""
        if not named:
            raise ValueError("agg needs at least one aggregate")
        plan = self.plan
        if not plan.nodes or plan.nodes[-1].op not in _POLYGON_JOINS:
            return self._over(plan.to_df(), named)
        *first, last = plan.nodes
        target, left = _compile(plan.frame, plan.frame._df, first, raw=True), last.args["query"].columns
        side, met = _meet(plan.frame, target, last.op, last.args)
        right = [c for c in target.columns if c not in plan.frame._hidden]
        df = joins.assemble(side.expand(met), left, right)
        plain = self._over(df, named)
        names = joins.assembled(left, right)
        if last.op == "polygon_within_distance_join" and all(s.kind == "count" for s in named.values()) and all(names[k].startswith("t_") for k in self.keys) and self.keys:
            counted = joins.counted_within_distance(joins.probe_side(last.args["query"], last.args["x"], last.args["y"]), side, last.args["distance"])
            if counted is not None:
                return counted.groupBy(*[F.col(f"`{names[k]}`").alias(k) for k in self.keys]).agg(*[F.sum("_n").alias(n) for n in named])
        if side.members is None or any(isinstance(df.schema[s.column].dataType, T.DecimalType) for s in named.values() if s.column):
            return plain
        return joins.grouped(side, met, names, self.keys, named, plain.schema)

    def _over(self, df: DataFrame, named: dict[str, AggSpec]) -> DataFrame:
        floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
        _check(df, *self.keys, *[s.column for s in named.values() if s.column])
        return df.groupBy(*[F.col(f"`{k}`") for k in self.keys]).agg(*[s.expression(s.column in floats).alias(n) for n, s in named.items()])


def _compile(frame: SpatialFrame, df: DataFrame, nodes, raw: bool = False) -> DataFrame:
    joined = False
    for node in nodes:
        a = node.args
        if node.op == "filter":
            df = df.filter(a["condition"])
        elif node.op == "select":
            df = df.select(*[F.col(f"`{c}`") for c in a["columns"]])
            joined = True
        elif node.op == "range_query":
            df = _range(frame, df, *a["box"])
        elif node.op in _FILTERS:
            df = _FILTERS[node.op](frame, df, a)
        elif node.op == "intersects_pairs":
            df, joined = _pairs(frame, df, a["key_col"]), True
        else:
            df, joined = _join(frame, df, node.op, a), True
    return df if joined or raw else df.drop(*frame._hidden)


def _holds(frame: SpatialFrame, px: float, py: float) -> Column:
    x, y = F.lit(px), F.lit(py)
    if frame.kind == "point":
        px, py = F.col(f"`{frame.x_col}`").cast("double"), F.col(f"`{frame.y_col}`").cast("double")
        return valid(px, py) & (F.abs(px - x) <= POINT_EPS) & (F.abs(py - y) <= POINT_EPS)
    g = F.col(f"`{GEOM}`")
    b = geo.bounds(g)
    near = (b["x0"] <= x) & (b["x1"] >= x) & (b["y0"] <= y) & (b["y1"] >= y)
    return near & geo.contains(geo.edges(g), x, y)


def _contains(frame: SpatialFrame, df: DataFrame, a: dict) -> DataFrame:
    return df.filter(_holds(frame, a["x"], a["y"]))


def _knn(frame: SpatialFrame, df: DataFrame, a: dict) -> DataFrame:
    x, y = F.lit(a["x"]), F.lit(a["y"])
    if frame.kind == "point":
        px, py = F.col(f"`{frame.x_col}`").cast("double"), F.col(f"`{frame.y_col}`").cast("double")
        ok, d = valid(px, py), dist.planar(px, py, x, y)
    else:
        g = F.col(f"`{GEOM}`")
        ok, d = g.isNotNull() & (F.size(g) > 0), geo.distance(geo.edges(g), x, y)
    order = ["__d", *([f"`{a['tie']}`"] if a["tie"] else [])]
    return df.filter(ok).withColumn("__d", d).orderBy(*order).limit(a["k"]).drop("__d")


def _near_point(frame: SpatialFrame, df: DataFrame, a: dict) -> DataFrame:
    px, py = F.col(f"`{frame.x_col}`"), F.col(f"`{frame.y_col}`")
    x0, y0, x1, y1 = dist.fixed_search_box(a["cx"], a["cy"], a["distance"], frame.coordinate_system)
    exact = dist.distance_to_point(px, py, a["cx"], a["cy"], frame.coordinate_system) <= a["distance"]
    near = px.between(x0, x1) & py.between(y0, y1)
    if frame.coordinate_system == "geographic":  # coordinates out of range count around the globe
        near = near | (px < -180) | (px > 180) | (py < -90) | (py > 90)
    return df.filter(near).filter(exact)


def _near_polygon(frame: SpatialFrame, df: DataFrame, a: dict) -> DataFrame:
    px, py = F.col(f"`{frame.x_col}`"), F.col(f"`{frame.y_col}`")
    d = a["distance"]
    x0, y0, x1, y1 = geo.bounds_of(a["polygon"])
    exact = geo.distance(geo.literal_edges(a["polygon"]), px.cast("double"), py.cast("double")) <= d
    return df.filter(px.between(x0 - d, x1 + d) & py.between(y0 - d, y1 + d)).filter(exact)


_FILTERS = {"contains": _contains, "knn": _knn, "within_distance_of_point": _near_point, "points_within_distance_of_polygon": _near_polygon}


#: Joins whose aggregates may be formed before the distinct geometries are expanded to rows.
_POLYGON_JOINS = ("within_join", "polygon_within_distance_join")


def _meet(frame: SpatialFrame, df: DataFrame, op: str, a: dict):
    """The polygon side of a join and its pairs, not expanded."""
    probe = joins.probe_side(a["query"], a["x"], a["y"])
    side = joins.polygon_side(df, [c for c in df.columns if c not in frame._hidden], GEOM)
    return side, joins.contains(probe, side) if op == "within_join" else joins.polygon_within_distance(probe, side, a["distance"])


def _join(frame: SpatialFrame, df: DataFrame, op: str, a: dict) -> DataFrame:
    names = [c for c in df.columns if c not in frame._hidden]
    if op in _POLYGON_JOINS:
        side, met = _meet(frame, df, op, a)
        return joins.assemble(side.expand(met), a["query"].columns, names)
    probe = joins.probe_side(a["query"], a["x"], a["y"])
    extra = None
    tie = [F.col(f"`t_{a['tie']}`")] if a.get("tie") else None
    if frame.kind == "point":
        target = joins.point_side(df, names, frame.x_col, frame.y_col)
        tie = tie or [F.col("_tx"), F.col("_ty")]
    if op == "knn_join":
        out = joins.knn(probe, target, a["k"], tie)
    elif op == "within_distance_join":
        out = joins.within_distance(probe, target, a["distance"], frame.coordinate_system)
    else:
        # of the rows of one geometry, at most k are among the k nearest
        side = joins.polygon_side(df, names, GEOM, keep=tie or [F.lit(0)], most=a["k"])
        tie = tie or [F.col("_tbox")]
        out = joins.polygon_knn(probe, side, a["k"], tie)
        if a["sorted_output"]:
            out = out.orderBy("_d", *tie)
        extra = {"distance_to_polygon": F.col("_d")}
    return joins.assemble(out, a["query"].columns, names, extra)
