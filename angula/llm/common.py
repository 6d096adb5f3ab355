"""Shared folder, lineage cuts, and sorted arrays that tasks write and map."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

#: Bytes of text to each range of hashes.
PART_BYTES = 64 << 20
#: A word: a run of anything but space and \\t \\n \\v \\f \\r.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(col: str | Column = "text") -> Column:
    """The whole text; a null text is empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that are no columns of df, in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def by_place(df: DataFrame, run, *more: T.StructField) -> DataFrame:
    """df's columns, by place whatever they are called, through run in Arrow batches, and more columns behind them."""
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)]
    out = df.toDF(*[f.name for f in fields]).mapInArrow(run, T.StructType([*fields, *[T.StructField(f"c{len(fields) + i}", f.dataType) for i, f in enumerate(more)]]))
    return out.toDF(*df.columns, *[f.name for f in more])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, where their path doesn't have it: as a zip among the session's files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    known = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if root in known or getattr(sc, "_angula_shipped", False):
        return
    own = os.path.join(tempfile.mkdtemp(prefix="angula-"), "angula.zip")
    with zipfile.ZipFile(own, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "angula")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), root))
    sc.addPyFile(own)
    sc._angula_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares; a temporary one only where spark.checkpoint.dir is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="angula-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def remove(spark: SparkSession, *things: DataFrame | str) -> None:
    """Delete written tables and folders that nothing reads any more: what was made of them is written itself."""
    for x in things:
        path = spark._jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """df as a written table with at: each row's place, from 0, in ascending order of columns, nulls first.

    The range sort deals one value's rows to many tasks as soon as the columns behind it differ. Only a row for each
    partition, its size, is summed up in one place.
    """
    d = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    d = written(d.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")), "order")
    up = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = d.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(F.sum("rows").over(up), F.lit(0)).alias("before"))
    out = d.join(F.broadcast(before), "part").select(*df.columns, (F.col("before") + F.col("nth")).alias("at"))
    out.written_at = d.written_at
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- arrays in the shared folder -------------------------------------------------------------------------------


def _local(folder: str) -> str | None:
    u = urlparse(folder)
    return u.path if u.scheme in ("", "file") else None


def put_array(folder: str, name: str, part: int, array: np.ndarray) -> None:
    """Write one part in one step, so that a task that runs twice leaves the same file."""
    own = f"{name}-{part:06d}.{array.dtype.str[1:]}"
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        tmp = f"{path}/.{own}.{uuid.uuid4().hex}"
        array.tofile(tmp)
        os.replace(tmp, f"{path}/{own}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        tmp = f"{path}/.{own}.{uuid.uuid4().hex}"
        with store.open_output_stream(tmp) as out:
            out.write(array.tobytes())
        store.move(tmp, f"{path}/{own}")


class Arrays:
    """The parts of an array by number, opened as they are asked for: mapped where the shared folder is mounted, else read.

    No more than MOST_OPEN maps or MOST_READ bytes are held at a time, those used last, so that a worker's memory and maps
    don't grow with the array.
    """

    MOST_OPEN, MOST_READ = 4096, 1 << 28

    def __init__(self, folder: str, name: str):
        self.path, self.store = _local(folder), None
        if self.path is not None:
            files = os.listdir(self.path) if os.path.isdir(self.path) else []
        else:
            from pyarrow import fs

            self.store, self.path = fs.FileSystem.from_uri(folder)
            files = [x.base_name for x in self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True))]
        self.files = {int(f[len(name) + 1 :].partition(".")[0]): f for f in files if f.startswith(f"{name}-")}
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()
        self.size = 0

    def _open(self, f: str) -> np.ndarray:
        kind, full = f.rpartition(".")[2], f"{self.path}/{f}"
        if self.store is None:
            return np.memmap(full, kind, "r") if os.path.getsize(full) else np.zeros(0, kind)
        with self.store.open_input_file(full) as src:
            return np.frombuffer(src.read(), kind)

    def __getitem__(self, part: int) -> np.ndarray:
        if part in self.held:
            self.held.move_to_end(part)
        else:
            self.held[part] = self._open(self.files[part])
            self.size += self.held[part].nbytes
            while len(self.held) > self.MOST_OPEN or (self.store is not None and self.size > self.MOST_READ and len(self.held) > 1):
                self.size -= self.held.popitem(last=False)[1].nbytes
        return self.held[part]

    def get(self, part: int) -> np.ndarray | None:
        return self[part] if part in self.files else None

    def __contains__(self, part: int) -> bool:
        return part in self.files

    def __iter__(self) -> Iterator[int]:
        return iter(sorted(self.files))


def parts_of(docs: DataFrame, text: Column, least: int = 32) -> int:
    """How many ranges hashes of docs' texts are dealt to: one for each PART_BYTES of text, so that a range's size doesn't grow."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, partitions(docs.sparkSession), -(-total // PART_BYTES))


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(part, its rows) one part after the other, of batches sorted by their first column, the part."""
    part, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != part:
                if rows:
                    yield part, rows
                part, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield part, rows


def range_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of 64-bit keys that a key falls in, of as many equal ranges as parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def find(parts: Arrays, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each of the sorted keys in its part, -1 if it isn't there, and the part's number."""
    of = range_part(keys, n)
    place = np.full(len(keys), -1, np.int64)
    edges = np.searchsorted(of, np.arange(n + 1))
    for p in range(n):
        lo, hi = edges[p], edges[p + 1]
        held = parts.get(p) if lo < hi else None
        if held is not None and len(held):
            at = np.searchsorted(held, keys[lo:hi])
            at[at == len(held)] = 0
            place[lo:hi] = np.where(held[at] == keys[lo:hi], at, -1)
    return place, of


def small_blob(sorted_keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as compressed differences, byte planes apart."""
    import zstandard

    gaps = np.diff(sorted_keys, prepend=np.zeros(1, sorted_keys.dtype))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, gaps.itemsize).T).tobytes(), 1)


def keys_of(blob: bytes, kind=np.uint64) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def small(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, for what is made of one at a time is several times its text."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


# --- components -------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b): label is the smallest node that links reach.

    Labels spread to neighbours and then jump to their own label's label, so that rounds grow with the logarithm of a
    chain's length. Each round is a written table.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        step = step.join(up, step.label == up.up, "left").select("node", "was", F.least("label", F.coalesce("up_label", "label")).alias("label"))
        step = written(step, "labels")
        labels = step.select("node", "label")
        if step.filter("label <> was").isEmpty():
            return labels
