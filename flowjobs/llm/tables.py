"""Reading driver tables, cutting lineage, row numbers."""

from __future__ import annotations

import contextvars
import shutil
import tempfile
import uuid
from pathlib import Path
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import shared_dir

_SHIPPED: set[str] = set()
_WRITTEN: dict[str, list[str]] = {}
_SCRATCH: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("scratch", default=None)


#: Bytes of texts that go to a Python worker at once, where the session does not say otherwise.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, BATCH_DEFAULT = 16 << 20, "67108864b"


def ship(spark: SparkSession) -> None:
    """Prepare a session: send this package to the executors, once per application, and keep the batches of texts small.

    Long texts fill batches; each is held several times over by the executor and its
    Python workers. A batch size that the session has set itself stays.
    """
    if spark.conf.get(BATCH, None) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/flowjobs", "zip", root, "flowjobs")
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps start from the files: a lost executor costs one task of a later
    step, never the steps before, and each value is computed once. Tasks hold a
    row group at once when they write and read; ``group_rows`` is for long rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowjobs-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    if (scratch := _SCRATCH.get()) is not None:
        scratch.folders.append(path)
    writer = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if scratch is not None:
        # The list of the folder's files, which every DataFrame made from this one holds.
        files = out._jdf.queryExecution().analyzed().relation().location()
        scratch.readers[path] = spark._jvm.java.lang.ref.WeakReference(files)
    return out


class Scratch:
    """Names the folders that :func:`cut` writes inside a ``with`` block, so that they can be deleted apart from all others.

    An inner block's folders that are left pass to the block around it. What is left
    after the outermost one stays until no DataFrame reads it any more, and is then
    deleted when the next block begins. Nothing is deleted that another block, or a
    call outside of any, has written.
    """

    _left: ClassVar[dict[str, dict[str, object]]] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: list[str] = []
        self.readers: dict[str, object] = {}

    def __enter__(self) -> Scratch:
        self._sweep()
        self._outer = _SCRATCH.get()
        self._token = _SCRATCH.set(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _SCRATCH.reset(self._token)
        if kind is not None:
            self.delete()
        elif self._outer is not None:
            self._outer.folders += self.folders
            self._outer.readers |= self.readers
        else:
            self._left.setdefault(self.spark.sparkContext.applicationId, {}).update({f: self.readers[f] for f in self.folders if f in self.readers})

    def _sweep(self) -> None:
        left = self._left.get(self.spark.sparkContext.applicationId, {})
        unread = [f for f, files in list(left.items()) if files.refersTo(None)]
        for f in unread:
            left.pop(f, None)
        _delete(self.spark, unread)

    def delete(self, unless_read_by: DataFrame | None = None) -> None:
        """Delete this block's folders but those that ``unless_read_by`` reads."""
        files = unless_read_by.inputFiles() if unless_read_by is not None else []
        read_still = {part for file in files for part in file.split("/") if part.startswith("flowjobs-")}
        gone = [f for f in self.folders if f.rsplit("/", 1)[-1] not in read_still]
        self.folders = [f for f in self.folders if f not in gone]
        _delete(self.spark, gone)


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for path in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    mine = _WRITTEN.get(spark.sparkContext.applicationId, [])
    mine[:] = [p for p in mine if p not in folders]


def numbered(df: DataFrame, name: str = "uid") -> DataFrame:
    """``df`` with a number of its own for each row, written with it: the number is the same in all later steps."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def clean(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what :func:`cut` has written in this application. Call it once the results are written.

    ``since`` leaves the first tables, ``keep`` the last ones.
    """
    all_of_them = _WRITTEN.get(spark.sparkContext.applicationId, [])
    _delete(spark, all_of_them[since : len(all_of_them) - keep])


def written(spark: SparkSession) -> int:
    """Tables that :func:`cut` has written in this application and that are still there."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
