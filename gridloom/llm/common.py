"""Shared plumbing: Arrow batch mapping, staged tables and connected components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.staging import at_end, delete, fresh_path

#: Text bytes handled at once in a Python worker.
SLICE_BYTES = 2 << 20

#: Words of 64 bits that a sieve has at most (8 MB). With over 4 million keys it lets more rows through, never fewer.
SIEVE_WORDS = 1 << 20

ASCII_UPPER = bytes(range(65, 91))
ASCII_LOWER = bytes(range(97, 123))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(column: str, buckets: int):
    """crc32 of the column written as text, modulo buckets."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(buckets)


# -- tables that cut the lineage -------------------------------------------------------


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Within it, each execution's shuffle files go when it ends, so that finished jobs hold no disk."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Stage:
    """A DataFrame written to the shared folder; drop() deletes the files once nothing reads them, else they go with the application."""

    def __init__(self, df: DataFrame, name: str = "stage"):
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, name)
        at_end(self.spark, self.path)
        with tidy(self.spark):
            df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


class Bucketed:
    """A DataFrame written in buckets of a key to the shared folder; grouping or joining it by the key moves none of its rows."""

    def __init__(self, df: DataFrame, key: str, buckets: int, name: str = "bucketed"):
        self.spark = df.sparkSession
        self.table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
        self.path = fresh_path(self.spark, name)
        at_end(self.spark, self.path)
        buckets = min(buckets, int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        with tidy(self.spark):
            df.repartition(buckets, key).write.option("path", self.path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(self.table)
        self.df = self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")
        delete(self.spark, self.path)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    return Stage(df, name).df


# -- joins of large rows with few keys -------------------------------------------------


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """A key's word in a sieve, and the three bits it has there."""
    h = F.xxhash64(key)
    one = F.lit(1).cast("long")
    first, second, third = (F.call_function("shiftleft", one, F.pmod(F.shiftrightunsigned(h, by), F.lit(64)).cast("int")) for by in (58, 52, 46))
    return F.pmod(h, F.lit(words)).cast("int"), first.bitwiseOR(second).bitwiseOR(third)


class Sieve:
    """Blocked Bloom filter of a table's keys, as one row of bounded size; keys is read twice."""

    def __init__(self, keys: DataFrame, key: str):
        self.key, self.kind = key, keys.schema[key].dataType
        self.words = min(SIEVE_WORDS, 64 << (keys.count() // 256).bit_length())
        self.name = f"sieve_{uuid.uuid4().hex}"
        place, bits = _place(F.col(key), self.words)
        none = keys.sparkSession.range(self.words).select(F.col("id").cast("int").alias("place"), F.lit(0).cast("long").alias("bits"))
        filled = keys.select(place.alias("place"), bits.alias("bits")).union(none).groupBy("place").agg(F.bit_or("bits").alias("bits"))
        row = F.transform(F.sort_array(F.collect_list(F.struct("place", "bits"))), lambda x: x["bits"])
        self.df = stage(filled.agg(row.alias(self.name)), "sieve")

    def _split(self, df: DataFrame, how: str) -> DataFrame:
        place, bits = _place(F.col(self.key).cast(self.kind), self.words)
        return df.join(F.broadcast(self.df), F.get(self.name, place).bitwiseAND(bits) == bits, how)

    def passed(self, df: DataFrame) -> DataFrame:
        """Every row whose key is among the keys, and a few others."""
        return self._split(df, "left_semi")

    def held(self, df: DataFrame) -> DataFrame:
        """The rows that did not pass; none has a key among the keys."""
        return self._split(df, "left_anti")


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Left anti join; only rows that pass a sieve of the keys are shuffled. Both frames are read twice."""
    sieve = Sieve(keys, key)
    checked = sieve.passed(df).join(keys.select(key), key, "left_anti")
    return sieve.held(df).select(df.columns).union(checked.select(df.columns))


# -- Arrow mapping -----------------------------------------------------------------------


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about limit bytes of the text column, or one row."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    start = 0
    while start < n:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b"" if x is None else x for x in col.cast(kind).to_pylist()]


def without(df: DataFrame, names) -> DataFrame:
    """The frame without columns of these names, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def append_columns(df: DataFrame, text_col: str, fields: T.StructType, compute: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Map every slice of rows to new columns; existing columns of the same names give way."""
    src = without(df, fields.fieldNames())
    schema = T.StructType(src.schema.fields + fields.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                new = [x if isinstance(x, pa.Array) else pa.array(x) for x in compute(part)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *fields.fieldNames()])

    return src.mapInArrow(run, schema)


def emit_rows(df: DataFrame, text_col: str, schema: str, compute: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """Map every slice of rows to any number of rows, given as dicts of arrays."""
    names = T._parse_datatype_string(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                for out in compute(part):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names)

    return df.mapInArrow(run, schema)


# -- hashing -------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# -- connected components -------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label each node of an undirected graph with the smallest id it reaches: (node, comp).

    Distributed union-find: a forest of parent pointers kept as rows; each round hooks the
    larger root of every crossing edge under the smallest neighbouring root and then halves
    the paths, so rounds grow with the logarithm of a component's diameter. Each round is
    written to the shared folder; nothing but a count reaches the driver.
    """
    spark = edges.sparkSession
    live = Stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    labels = Stage(live.df.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("comp")), "labels")
    while True:
        # hook: for every edge between different roots, the larger root takes the smaller
        hooks = (
            live.df.filter("a <> b")
            .select(F.greatest("a", "b").alias("root"), F.least("a", "b").alias("low"))
            .groupBy("root").agg(F.min("low").alias("low"))
        )
        hooked = Stage(hooks, "hooks")
        if hooked.df.isEmpty():
            hooked.drop()
            break
        # shorten the chains among the hooked roots until every one points at a final root
        while True:
            up = hooked.df.select(F.col("root").alias("low"), F.col("low").alias("higher"))
            stepped = Stage(hooked.df.join(up, "low", "left").select("root", F.coalesce("higher", "low").alias("low"), F.col("higher").isNotNull().alias("moved")), "hooks")
            hooked.drop()
            hooked = stepped
            if hooked.df.filter("moved").isEmpty():
                break
        jump = hooked.df.select("root", "low")
        relabelled = Stage(labels.df.join(jump, labels.df.comp == jump.root, "left").select("node", F.coalesce("low", "comp").alias("comp")), "labels")
        left = live.df.join(jump.withColumnRenamed("low", "la"), live.df.a == F.col("root"), "left").select(F.coalesce("la", "a").alias("a"), "b")
        contracted = Stage(left.join(jump.withColumnRenamed("low", "lb"), left.b == F.col("root"), "left").select("a", F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct(), "edges")
        for old in (labels, live, hooked):
            old.drop()
        labels, live = relabelled, contracted
    live.drop()
    return labels.df
