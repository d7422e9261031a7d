"""Reading and writing flow tables, views, reports and release snapshots."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 1_000_000
#: A release snapshot in long form.
MANIFEST = "dimension string, key string, key2 string, total double, n long, release string"
_LOCAL_DIR: dict[str, str] = {}
_SCRATCH: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what setCheckpointDir was given.

    Only a local session, as in tests, may have none: it gets a folder on this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="flowjobs-")
    return _LOCAL_DIR[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, until :func:`clean`."""
    path = f"{shared_dir(spark)}/flowjobs-{uuid.uuid4().hex}/{name}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; :func:`clean` deletes it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete what :func:`scratch_path` has named in this application, once the results that read it are written."""
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` itself, or ValueError with the names it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_flows(
    spark: SparkSession, path: str, columns: Sequence[str], years: tuple[int, int] | None = None, isin: Mapping[str, Sequence] | None = None, schema: T.StructType | None = None, year_col: str = "year"
) -> DataFrame:
    """Columns of a flow table, with year range and ``in`` filters that reach the scan; a missing column is an error."""
    reader = spark.read.schema(schema) if schema else spark.read
    wanted = list(dict.fromkeys([*columns, *([year_col] if years else []), *(isin or {})]))
    df = require_columns(reader.parquet(path), wanted)
    if years:
        df = df.where(F.col(year_col).between(*years))
    for c, values in (isin or {}).items():
        df = df.where(F.col(c).isin(list(values)))
    return df.select(*columns)


#: the column that holds the text of a row that does not fit the schema
MALFORMED = "malformed"


def read_csv_input(spark: SparkSession, path: str, schema: T.StructType | str, malformed: str = "error") -> DataFrame:
    """A CSV with a header that names the schema's columns; empty cells are null.

    Rows that don't fit the schema in the columns that a query reads are an ``error``,
    or ``drop`` leaves them out; ``keep`` has their text in the column MALFORMED, null
    for all others.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    modes = {"error": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}
    if malformed not in modes:
        raise ValueError(f"malformed must be one of {', '.join(modes)}, not {malformed!r}")
    if malformed == "keep":
        fields = T.StructType([*fields, T.StructField(MALFORMED, T.StringType())])
    return spark.read.csv(path, header=True, schema=fields, enforceSchema=False, mode=modes[malformed], columnNameOfCorruptRecord=MALFORMED)


def narrow_types(df: DataFrame, year_col: str = "year") -> DataFrame:
    """Types for files: year short; value and pct columns float unless they are integers; all else as it is."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    casts = {}
    for field in df.schema:
        if field.name == year_col:
            casts[field.name] = F.col(field.name).cast("short")
        elif field.name.startswith(("value_", "pct")) and not isinstance(field.dataType, whole):
            casts[field.name] = F.col(field.name).cast("float")
    return df.withColumns(casts) if casts else df


def _writer(df: DataFrame, level: int):
    return df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level)


def write_single_parquet(df: DataFrame, path: str, level: int = 9) -> None:
    """A small view as one zstd file. Only its rows meet in one task, not the work that makes them."""
    _writer(df.repartition(1), level).parquet(path)


def write_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str], level: int = 9, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Hive partitions. Rows of a folder meet in one task unless they are many: adaptive execution splits what is over its advisory size, so a folder that holds most rows is written by many tasks; small folders are one file each, but for those whose shuffle partition such a folder shares."""
    require_columns(df, partition_cols)
    placed = df.hint("rebalance", *partition_cols).sortWithinPartitions(*partition_cols)
    _writer(placed, level).option("maxRecordsPerFile", rows_per_file).partitionBy(*partition_cols).parquet(path)


def read_partitions(spark: SparkSession, base: str, donors: Sequence[str] | None = None, recipients: Sequence[str] | None = None, donor_col: str = "donor_slug", recipient_col: str = "recipient_slug") -> DataFrame:
    """Only the folders of the slugs asked for; None entries are skipped, unknown slugs give no rows, None asks for all."""
    df = spark.read.parquet(base)
    for c, wanted in ((donor_col, donors), (recipient_col, recipients)):
        if wanted is not None:
            df = df.where(F.col(c).isin([w for w in wanted if w is not None]))
    return df


def read_partition_pairs(spark: SparkSession, base: str, selections: DataFrame, selection: str, donor_col: str = "donor_slug", recipient_col: str = "recipient_slug") -> DataFrame:
    """The folders that one named selection asks for: pairs of slugs, not all donors with all recipients.

    ``selections`` has selection, donor_slug and recipient_slug. Its rows prune folders
    while the query runs; pairs without a folder give no rows, a pair named twice counts once.
    """
    wanted = selections.where(F.col("selection") == selection).select(F.col("donor_slug").alias(donor_col), F.col("recipient_slug").alias(recipient_col)).distinct()
    return spark.read.parquet(base).join(wanted, [donor_col, recipient_col])


def write_csv_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.repartition(1).write.mode("overwrite").csv(path, header=True)


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(c)


def save_manifest(totals: DataFrame, path: str) -> None:
    """Release snapshots in long form, a folder for each release. Saving a release again replaces it and no other. NaN and infinite numbers become null."""
    numbers = {f.name: finite(F.col(f.name)) for f in totals.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    writer = (totals.withColumns(numbers) if numbers else totals).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("release").parquet(path)


def load_manifest(spark: SparkSession, path: str, release: str | None = None) -> DataFrame:
    """All releases saved at ``path``, or one of them; an empty table where nothing has been saved."""
    try:
        df = spark.read.parquet(path).withColumn("release", F.col("release").cast("string"))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        df = spark.createDataFrame([], MANIFEST)
    return df if release is None else df.where(F.col("release") == release)


#: A manifest as one document, by release. Fixed names and nesting of the published files.
DOCUMENT = (
    "dataset string, releases map<string, struct<row_count bigint, year_range array<int>, aggregates map<string, map<string, double>>,"
    " distribution map<string, double>, presence map<string, array<string>>>>"
)


def manifest_document(saved: DataFrame, dataset: str) -> DataFrame:
    """One row (document): the snapshots of :func:`save_manifest` as nested maps of the type DOCUMENT.

    Totals are by_{dimension}, keys of two parts are joined by ``|``; NaN and infinite
    numbers are null at every depth. The maps are as large as the release has names,
    not rows.
    """
    named = F.concat_ws("|", "key", "key2")
    number = finite(F.col("total").cast("double"))
    dims = saved.where("dimension <> 'stats'").groupBy("release", "dimension").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(named.alias("k"), number.alias("v"))))).alias("totals"), F.sort_array(F.collect_set(F.when(F.col("key2").isNull(), F.col("key")))).alias("names")
    )
    by = dims.groupBy("release").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("by_"), "dimension").alias("k"), F.map_entries("totals").alias("v"))))).alias("e"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.size("names") > 0, F.struct("dimension", "names"))))).alias("presence"),
    ).withColumn("aggregates", F.transform_values("e", lambda _, v: F.map_from_entries(v)))
    stat = lambda k: F.max(F.when(F.col("key") == k, number))
    shown = ("min", "max", "median", "p25", "p75")
    stats = saved.where("dimension = 'stats'").groupBy("release").agg(
        stat("row_count").cast("long").alias("row_count"), F.array(stat("first_year").cast("int"), stat("last_year").cast("int")).alias("year_range"), F.create_map(*[x for k in shown for x in (F.lit(k), stat(k))]).alias("distribution")
    )
    body = by.join(stats, "release", "left").select("release", F.struct("row_count", "year_range", "aggregates", "distribution", "presence").alias("body"))
    one = body.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("release", F.to_json("body", {"ignoreNullFields": "false"}).alias("body"))))).alias("releases"))
    kind = T.StructType.fromDDL(DOCUMENT)["releases"].dataType.valueType
    releases = F.transform_values("releases", lambda _, v: F.from_json(v, kind))
    return one.select(F.struct(F.lit(dataset).alias("dataset"), releases.alias("releases")).alias("document"))


def merge_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (document): the releases of both, those of ``new`` in place of their like."""
    a, b = old.select(F.col("document").alias("a")), new.select(F.col("document").alias("b"))
    kept = F.map_filter("a.releases", lambda k, _: ~F.array_contains(F.map_keys("b.releases"), k))
    # Two tables of one row.
    return a.join(F.broadcast(b)).select(F.struct(F.col("b.dataset").alias("dataset"), F.map_concat(kept, F.col("b.releases")).alias("releases")).alias("document"))


def write_document(document: DataFrame, path: str) -> None:
    """The document as one JSON text, nulls written out."""
    document.select(F.to_json("document", {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row (document) of type DOCUMENT; a text that is no such JSON is an error."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", T.StructType.fromDDL(DOCUMENT), {"mode": "FAILFAST"}).alias("document"))


def view_options(df: DataFrame, columns: Sequence[str], pinned: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(option, position, value): each column's distinct non-null values, pinned ones first in their order, the rest by name."""
    pinned = pinned or {}
    # One pass over the data for all columns: each row gives its (column, value) pairs.
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("option"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*").where("value is not null").distinct()
    rank = F.lit(None).cast("int")
    for c in columns:
        for i, v in enumerate(pinned.get(c, ())):
            rank = F.when((F.col("option") == c) & (F.col("value") == v), F.lit(i)).otherwise(rank)
    listed = pairs.groupBy("option").agg(F.sort_array(F.collect_list(F.struct(F.coalesce(rank, F.lit(1 << 30)).alias("rank"), "value"))).alias("v"))
    return listed.select("option", F.posexplode("v.value").alias("position", "value"))


def year_option(df: DataFrame, year_col: str = "year", base_year: int | None = None) -> DataFrame:
    return df.agg(F.min(year_col).cast("int").alias("start"), F.max(year_col).cast("int").alias("end")).withColumn("base", F.lit(base_year).cast("int"))


def options_json(options: DataFrame) -> DataFrame:
    """One row: the options as a JSON object of lists."""
    lists = options.groupBy("option").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]).alias("values"))
    return lists.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("option", "values"))))).alias("options"))


def child_index(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(parent, children): the sorted distinct children of each parent."""
    return df.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.sort_array(F.collect_set(child)).alias("children"))
