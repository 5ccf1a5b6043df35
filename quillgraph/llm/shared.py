"""The folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only in local mode, as in tests."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_quillgraph_sent", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="quillgraph-src-")
    with zipfile.ZipFile(f"{folder}/quillgraph_src.zip", "w") as z:
        for d, _, names in os.walk(root):
            for x in names:
                if x.endswith(".py"):
                    z.write(f"{d}/{x}", os.path.relpath(f"{d}/{x}", os.path.dirname(root)))
    context.addPyFile(f"{folder}/quillgraph_src.zip")
    context._quillgraph_sent = True


class Workspace:
    """Tables and array files of one operator call, in a folder of their own.

    Tables cut the lineage: they are written once and read again, so the loss
    of an executor costs no earlier stage.  Array files are written by single
    tasks under a temporary name and then renamed, so that a repeated or
    speculative task leaves one whole file.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        return f"{self.base}/{name}"

    def drop(self, *names: str) -> None:
        """Remove the named parts, or all."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [f"{self.base}/{n}" for n in names] or [self.base]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

    def keep(self, *names: str) -> None:
        """Remove all parts but the named ones."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.base)
        store = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in store.listStatus(top):
            if found.getPath().getName() not in names:
                store.delete(found.getPath(), True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Stands for a null id inside the operators; it orders before any other.
NO_ID = -(1 << 63)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text counts as empty.

    With ``carry`` the text stays as it is and ``rest`` holds all other columns; :func:`whole_row` puts them together again.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rest = [F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("rest")] if carry else []
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), (text if carry else F.coalesce(text, F.lit(""))).alias("text"), *rest)


def carried_type(df: DataFrame) -> str:
    """For the schema of a step's output: the carried columns, if there are any."""
    return f", text string, rest {df.schema['rest'].dataType.simpleString()}" if "rest" in df.columns else ""


def whole_row(names: list[str], text_col: str = "text") -> Column:
    """The carried row as ``row``, its columns in their order."""
    return F.struct(*[(F.col("text") if c == text_col else F.col("rest").getField(c)).alias(c) for c in names]).alias("row")


def ids_back(df: DataFrame, *columns: str) -> DataFrame:
    """Null ids again for ``NO_ID``."""
    return df.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in columns or ("doc_id",)})


def id_partition(ids: np.ndarray, parts: int) -> np.ndarray:
    """Where Spark's hash partitioning puts these long ids (Murmur3, seed 42)."""
    with np.errstate(over="ignore"):
        u = ids.astype(np.int64).view(np.uint64)
        h = np.full(len(u), 42, np.uint32)
        for k in ((u & np.uint64(0xFFFFFFFF)).astype(np.uint32), (u >> np.uint64(32)).astype(np.uint32)):
            k = k * np.uint32(0xCC9E2D51)
            k = (k << np.uint32(15)) | (k >> np.uint32(17))
            h ^= k * np.uint32(0x1B873593)
            h = (h << np.uint32(13)) | (h >> np.uint32(19))
            h = h * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        h ^= h >> np.uint32(16)
        h = h * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h = h * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return np.mod(h.view(np.int32).astype(np.int64), parts).astype(np.int32)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4194304"):
    """Arrow batches bounded in rows and bytes while the body runs its jobs."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _local(path: str) -> str | None:
    url = urlparse(path)
    return url.path if url.scheme in ("", "file") else None


def write_array(folder: str, name: str, array: np.ndarray) -> None:
    """Write from a task; whole or not at all."""
    if local := _local(folder):
        os.makedirs(local, exist_ok=True)
        tmp = f"{local}/.{name}.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            f.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")
        os.replace(tmp, f"{local}/{name}")
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    tmp = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        f.write(np.ascontiguousarray(array).tobytes())
    store.move(tmp, f"{root}/{name}")


def read_array(folder: str, name: str, kind) -> np.ndarray:
    """Map the file, or read it where the store cannot be mapped."""
    if local := _local(folder):
        path = f"{local}/{name}"
        if not os.path.getsize(path):
            return np.zeros(0, kind)
        return np.memmap(path, dtype=kind, mode="r")
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def remove_array(folder: str, name: str) -> None:
    if local := _local(folder):
        with contextlib.suppress(FileNotFoundError):
            os.remove(f"{local}/{name}")
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with contextlib.suppress(FileNotFoundError):
        store.delete_file(f"{root}/{name}")


class Lazy:
    """Values of some keys, loaded when asked for.

    Mapped files are kept, since only the pages that are read take memory.  Of a
    store that cannot be mapped at most ``KEPT`` values are held at a time.
    """

    KEPT = 4

    def __init__(self, folder: str, keys: Iterable, load: Callable):
        self.keys, self.load, self.most = set(keys), load, None if _local(folder) else self.KEPT
        self.held: dict = {}

    def __contains__(self, key) -> bool:
        return key in self.keys

    def get(self, key):
        """The value, or None for an unknown key."""
        if key not in self.held:
            if key not in self.keys:
                return None
            while self.most and len(self.held) >= self.most:
                del self.held[next(iter(self.held))]
            self.held[key] = self.load(key)
        return self.held[key]


def array_names(folder: str) -> list[str]:
    if local := _local(folder):
        return sorted(x for x in os.listdir(local) if not x.startswith(".")) if os.path.isdir(local) else []
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(x.base_name for x in found if not x.base_name.startswith("."))
