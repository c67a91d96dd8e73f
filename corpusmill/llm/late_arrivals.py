"""Late-arrival partition overwrite: a layout of day files with a record index, into which late rows are folded by rewriting the days they touch."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from .common import erase, fresh, shared_dir, written

DAY = 86_400_000_000


def micros(df: DataFrame, name: str) -> Column:
    """A time column in microseconds since 1970 in UTC; one without a zone is read in UTC, whatever the session's zone is."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(F.concat(c.cast("string"), F.lit("Z")).cast("timestamp"))
    return F.unix_micros(c)


def _floor_div(c: Column, by: int) -> Column:
    return F.call_function("div", c - F.pmod(c, F.lit(by)), F.lit(by).cast("long"))


def days_since_1970(us: Column) -> Column:
    """Whole days, rounded down; -1 for null."""
    return F.coalesce(_floor_div(us, DAY), F.lit(-1).cast("long"))


@dataclass(frozen=True)
class Layout:
    """A folder of Parquet files, one in each day=D/file=N folder, and the index of its records beside it.

    `files` and `index` are paths; `schema` is that of the rows; day and file name the partition columns.
    """

    files: str
    index: str
    schema: StructType
    key: str
    at: str
    arrived: str
    file_rows: int
    buckets: int
    day: str
    file: str

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def read(self, spark: SparkSession, days: Sequence[int] | None = None) -> DataFrame:
        """The rows with their day and file, of all days or of those given, whose folders must be there."""
        reader = spark.read.schema(StructType([*self.schema.fields, StructField(self.day, LongType()), StructField(self.file, LongType())])).option("basePath", self.files)
        return reader.parquet(*([self.files] if days is None else [f"{self.files}/{self.day}={d}" for d in days]))


def latest(rows: DataFrame, key: str, at: str, arrived: str) -> DataFrame:
    """The row of each key (null is one) that arrived last; a null arrival is before all others. Ties go to the largest `at`, then to the largest
    values of the other columns in their order, so reruns agree. Maxima combine before the shuffle: a hot key is one row of each task."""
    rest = [c for c in rows.columns if c not in (key, at, arrived)]
    top = rows.groupBy(F.col(f"`{key}`").alias("__k")).agg(F.max(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate((arrived, at, *rest))])).alias("__m"))
    where = {c: f"__m.c{i}" for i, c in enumerate((arrived, at, *rest))} | {key: "__k"}
    return top.select(*[F.col(where[c]).alias(c) for c in rows.columns])


def _placed(rows: DataFrame, lay: Layout) -> tuple[str, DataFrame]:
    """(path of the table behind it, rows with day, file and __at, which orders the rows of a file).

    Rows are range-partitioned by day, time and key, so that a day of any size spreads over tasks. A row's place in its day is
    its place in its slice and the rows of the day in the slices before. The table of slices has at most one row for
    each shuffle partition and one for each day.
    """
    spark = rows.sparkSession
    order = [lay.day, lay.at, lay.key]
    d = rows.withColumn(lay.day, days_since_1970(micros(rows, lay.at)))
    d = d.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    path, d = written(d, keep_path=True)
    d = d.withColumn("__slice", F.shiftright("__at", 33))
    before = Window.partitionBy(lay.day).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = d.groupBy(lay.day, "__slice").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("lo"))
    slices = slices.select(lay.day, "__slice", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo")).alias("shift"))
    place = F.col("__at") + F.col("shift")
    return path, d.join(slices, [lay.day, "__slice"]).withColumn(lay.file, _floor_div(place, lay.file_rows))


def _write(placed: DataFrame, lay: Layout, path: str) -> None:
    """One task writes each file, as a stream of rows in order."""
    rows = placed.repartition(lay.day, lay.file).sortWithinPartitions(lay.day, lay.file, "__at").select(*lay.columns, lay.day, lay.file)
    rows.write.partitionBy(lay.day, lay.file).parquet(path)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int")


def lay_out(rows: DataFrame, base: str, file_rows: int, key: str = "sale_id", at: str = "sold_at", arrived: str = "arrived_at") -> Layout:
    """Writes the layout of rows under the folder base, new to this call, and its record index.

    The layout keeps each key's latest row (see latest()). Each day of `at` (null: -1), sorted by `at` and key, is cut into files of file_rows rows,
    the last perhaps fewer, with the columns of rows only. The index has a row for each record: key, day, file and arrival, hash-partitioned
    by key in as many buckets as the session has shuffle partitions. An empty table gives an empty layout. Columns named as
    partition columns would be get no clash: those take underscores. Texts of any length pass unread. Columns must be of types that have an order.
    """
    spark = rows.sparkSession
    lay = Layout(f"{base}/files", f"{base}/index", rows.schema, key, at, arrived, file_rows, int(spark.conf.get("spark.sql.shuffle.partitions")), fresh("day", rows.columns), fresh("file", rows.columns))
    path, placed = _placed(latest(rows, key, at, arrived), lay)
    _write(placed, lay, lay.files)
    c = lambda n: F.col(f"`{n}`")
    entries = placed.select(c(key).alias("k"), c(lay.day).alias("start_day"), c(lay.file).alias("start_file"), micros(rows, arrived).alias("start_arrived"), _bucket(key, lay.buckets).alias("bucket"))
    entries.repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(lay.index)
    erase(spark, path)
    return lay


def merge_late(spark: SparkSession, lay: Layout, late: DataFrame) -> list[int]:
    """Folds late rows into the layout; returns the days whose files were all written anew. Other files stay as they are.

    The latest late row of each key probes the index, which tags it with the day and file of the record it supersedes. It is kept unless that
    record arrived later. Dirty are the days where a kept row stands and those of the records superseded; only their files are read, the superseded
    records leave by key, day and file, kept rows join, and the days are cut again beside the layout. Then each dirty day's folder is moved out and the
    new one in; a rename is redone safely, and the old folders go last. A day without rows left has no files. The index still tells of the start: lay it
    out again before folding in more. Only the list of dirty days, bounded by the calendar, comes to the driver.
    """
    c = lambda n: F.col(f"`{n}`")
    index = spark.read.schema("k " + lay.schema[lay.key].dataType.simpleString() + ", start_day long, start_file long, start_arrived long, bucket int").parquet(lay.index)
    won = latest(late.select(*lay.columns), lay.key, lay.at, lay.arrived).withColumn("__b", _bucket(lay.key, lay.buckets)).withColumn("__us", micros(late, lay.arrived))
    tagged = won.join(index, (F.col("__b") == F.col("bucket")) & c(lay.key).eqNullSafe(F.col("k")), "left")
    tagged = tagged.where(F.col("start_day").isNull() | F.col("start_arrived").isNull() | F.coalesce(F.col("__us") >= F.col("start_arrived"), F.lit(False)))
    tag_path, tagged = written(tagged.select(*lay.columns, "start_day", "start_file", days_since_1970(micros(late, lay.at)).alias("__day")), keep_path=True)
    touched = tagged.select(F.explode(F.array("__day", "start_day")).alias("d")).where("d is not null").distinct()
    days = sorted(r["d"] for r in touched.collect())
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(lay.files).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [d for d in days if fs.exists(fs_path(f"{lay.files}/{lay.day}={d}"))]
    merged = tagged.select(lay.columns)
    if there:
        old = lay.read(spark, there)
        gone = tagged.where("start_day is not null").select(c(lay.key).alias("k"), "start_day", "start_file")
        merged = old.join(gone, (c(lay.day) == F.col("start_day")) & (c(lay.file) == F.col("start_file")) & c(lay.key).eqNullSafe(F.col("k")), "left_anti").select(lay.columns).unionByName(merged)
    base = f"{lay.files}-{uuid.uuid4().hex}"
    path, placed = _placed(merged, lay)
    _write(placed, lay, f"{base}-new")
    for d in days:
        here, new, old = (fs_path(f"{x}/{lay.day}={d}") for x in (lay.files, f"{base}-new", f"{base}-old"))
        if fs.exists(here):
            fs.mkdirs(old.getParent())
            fs.rename(here, old)
        if fs.exists(new):
            fs.rename(new, here)
    for p in (path, tag_path, f"{base}-new", f"{base}-old"):
        erase(spark, p)
    return days


def listing(spark: SparkSession, lay: Layout) -> DataFrame:
    """day, file_no, path, modified and n_bytes of each file that holds rows; no column is read."""
    m = lay.read(spark).select(F.col(f"`{lay.day}`").alias("day"), F.col(f"`{lay.file}`").alias("file_no"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("n_bytes"))
    return m.distinct()


def summed(batches):
    """Sums and the digest of ids of each (day, file), from rows in order, as a stream."""
    now, state, out = None, None, []

    def done():
        return (*now, state[0], state[1], state[2], state[3].hexdigest())

    def packed(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["day", "file_no", "n_rows", "cents", "rows_crc", "ids_sha256"])

    for b in batches:
        day, no = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *((day[1:] != day[:-1]) | (no[1:] != no[:-1])).nonzero()[0] + 1, len(day)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            at, part = (int(day[lo]), int(no[lo])), b.slice(lo, hi - lo)
            if at != now:
                if now is not None:
                    out.append(done())
                now, state = at, [0, 0, 0, hashlib.sha256()]
            state[3].update((("," if state[0] else "") + ",".join(part.column(2).to_pylist())).encode())
            state[0] += hi - lo
            state[1] += pc.sum(part.column(3)).as_py()
            state[2] += pc.sum(part.column(4)).as_py()
        if out:
            yield packed(out)
            out = []
    if now is not None:
        yield packed([done()])


def file_sums(spark: SparkSession, lay: Layout, total: str = "total") -> DataFrame:
    """day, file_no, n_rows, cents, rows_crc, ids_sha256 of each file, from its stored rows in their order."""
    d = lay.read(spark)
    c = lambda n: F.col(f"`{n}`")
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    line = F.concat(text(c(lay.key)), F.lit(":"), text(micros(d, lay.at)), F.lit(":"), text(micros(d, lay.arrived)))
    d = d.select(c(lay.day).alias("day"), c(lay.file).alias("file_no"), text(c(lay.key)).alias("id"), F.coalesce(F.floor(100 * c(total) + 0.5).cast("long"), F.lit(0).cast("long")).alias("cents"), F.crc32(line.cast("binary")).alias("crc"), F.col("_metadata.row_index").alias("i"))
    d = d.repartition("day", "file_no").sortWithinPartitions("day", "file_no", "i").drop("i")
    return d.mapInArrow(summed, "day long, file_no long, n_rows long, cents long, rows_crc long, ids_sha256 string")


def report(spark: SparkSession, lay: Layout, start: DataFrame, total: str = "total") -> DataFrame:
    """A row for each file: its place, sums and digest, the columns stored, its path, and whether it isn't an untouched file of the listing `start`."""
    stored = [c for c in spark.read.option("mergeSchema", "true").parquet(lay.files).columns if c not in (lay.day, lay.file)] if not lay.read(spark).isEmpty() else lay.columns
    same = ["path", "modified", "n_bytes"]
    now = listing(spark, lay).join(start.select(*same, F.lit(False).alias("rewritten")), same, "left").drop("modified", "n_bytes")
    return file_sums(spark, lay, total).join(now, ["day", "file_no"]).select("day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(",".join(stored)).alias("columns"), "ids_sha256", F.coalesce("rewritten", F.lit(True)).alias("rewritten"))


def with_late_copies(sales: DataFrame) -> DataFrame:
    """sales and, where the CRC-32 h of the decimal sale_id divides by 3 and the day by 4, a copy: total + 1, sold h % 2 and arrived 1 + h % 97 days later."""
    h, us = F.crc32(F.col("sale_id").cast("string").cast("binary")), micros(sales, "sold_at")

    def later(name: str, days: Column) -> Column:
        if isinstance(sales.schema[name].dataType, TimestampNTZType):
            return F.col(name) + F.make_dt_interval(days.cast("int"))
        return F.timestamp_micros(F.unix_micros(F.col(name)) + days * DAY)

    copies = sales.where((h % 3 == 0) & (days_since_1970(us) % 4 == 0))
    moved = {"total": F.col("total") + 1, "sold_at": later("sold_at", h % 2), "arrived_at": later("arrived_at", 1 + h % 97)}
    return sales.unionByName(copies.select(*[moved.get(c, F.col(f"`{c}`")).cast(sales.schema[c].dataType).alias(c) for c in sales.columns]))


def overwritten(sales: DataFrame, cutoff: str = "2024-03-20", files: int = 1_100) -> DataFrame:
    """report() after the layout of the rows that arrived before cutoff and a merge of all others, in a new folder that stays. A null arrival is late."""
    spark = sales.sparkSession
    file_rows = 1 + sales.count() // files
    rows = with_late_copies(sales)
    early = F.coalesce(micros(sales, "arrived_at") < F.unix_micros(F.lit(f"{cutoff} 00:00:00Z").cast("timestamp")), F.lit(False))
    base = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    lay = lay_out(rows.where(early), base, file_rows)
    listing(spark, lay).write.parquet(f"{base}/start")
    merge_late(spark, lay, rows.where(~early))
    return report(spark, lay, spark.read.parquet(f"{base}/start"))
