"""Record files in their wrappers: lists, {"data": [...]} objects, single records and lines; read as VARIANT, written back as they were, compared by directory."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTED, WRAPPED, SINGLE, LINES, NONE = "list", "data", "single", "lines", "none"


def relative(path: Column, base: str) -> Column:
    """What stands behind the folder `base` in a file's URI."""
    return F.element_at(F.split(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("\\Q" + base.rstrip("/").split(":", 1)[-1].lstrip("/") + "/\\E"), 2), 2)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """file (below path), n_bytes of every .json and .jsonl file below path; contents aren't read. Spark lists no files of no bytes."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.where(F.lower("path").rlike(r"\.jsonl?$")).select(relative(F.col("_metadata.file_path"), path).alias("file"), F.col("length").alias("n_bytes"))


def numbered_lines(spark: SparkSession, path: str, max_lines: int | None = None, suffix: str = "") -> DataFrame:
    """file (its URI), line_no (from 0 in each file) and value of all physical lines, blank ones too, or of the first max_lines of each file.

    Files are split as Spark likes. A split lies in one task, in order, so the place of a line is its place in its split and the lines
    of the file's splits before, which are counted first: one row for each split, no sort of lines.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    m = F.col("_metadata")
    raw = reader.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    if suffix:
        raw = raw.where(F.lower("file").endswith(suffix))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"))
    splits = splits.select("file", "block", "lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if max_lines is not None:
        splits = splits.where(F.col("base") < max_lines)
    out = raw.join(splits, ["file", "block"]).select("file", (F.col("base") + F.col("at") - F.col("lo")).alias("line_no"), "value")
    return out if max_lines is None else out.where(F.col("line_no") < max_lines)


def read_lines(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """file, ord, record (VARIANT) of JSON lines; blank and malformed lines go. max_records bounds the physical lines of each file, bad ones counted."""
    lines = numbered_lines(spark, path, max_records)
    return lines.select("file", F.col("line_no").alias("ord"), F.try_parse_json("value").alias("record")).where("record is not null")


def _array(v: Column, at: str) -> Column:
    return F.try_variant_get(v, at, "array<variant>")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def wrappers(files: DataFrame) -> DataFrame:
    """file, wrapper and envelope (the other fields beside "data", as JSON) for files(file, value), whose values are whole JSON texts.

    A malformed text and one that is neither list nor object have wrapper "none" and hold no records.
    """
    f = files.select("file", F.try_parse_json("value").alias("v"))
    wrapper = F.when(_array(F.col("v"), "$").isNotNull(), LISTED).when(_array(F.col("v"), "$.data").isNotNull(), WRAPPED).when(_object(F.col("v")).isNotNull(), SINGLE).otherwise(NONE)
    return f.select("file", wrapper.alias("wrapper"), F.when(wrapper == WRAPPED, F.to_json(F.map_filter(_object(F.col("v")), lambda k, _: k != "data"))).alias("envelope"))


def records_of(files: DataFrame) -> DataFrame:
    """file, ord, record (VARIANT) of files(file, value), whose values are whole JSON texts: elements of a list or of "data", or the one object."""
    f = files.select("file", F.try_parse_json("value").alias("v"))
    held = F.coalesce(_array(F.col("v"), "$"), _array(F.col("v"), "$.data"), F.when(_object(F.col("v")).isNotNull(), F.array("v")))
    return f.select("file", F.posexplode(held).alias("ord", "record")).withColumn("ord", F.col("ord").cast("long"))


def record_format(record: Column) -> Column:
    """flat: an object with text and a label that is no object; nested: an object whose label is one; else other."""
    fields = _object(record)
    label = F.try_variant_get(record, "$.label", "map<string,variant>")
    flat = F.map_contains_key(fields, "text") & F.map_contains_key(fields, "label")
    return F.when(label.isNotNull(), "nested").when(F.coalesce(flat, F.lit(False)), "flat").otherwise("other")


def file_formats(records: DataFrame) -> DataFrame:
    """file, format of each file's first record. Firsts combine before the shuffle."""
    first = records.groupBy("file").agg(F.min_by(record_format(F.col("record")), "ord").alias("format"))
    return first


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file, value of every .json file below path. A file is one cell: such a text can't be split, and a VARIANT has Spark's size limit."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(path, wholetext=True)
    return t.select(relative(F.col("_metadata.file_path"), path).alias("file"), "value")


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, envelopes) of all .json and .jsonl files below path.

    records: file, ord, record; envelopes: file, wrapper, envelope, also of files without records. The suffix .jsonl, in any case, means
    lines, whose blank and malformed ones go. Objects lose the order of their fields; of a repeated field the text is malformed.
    """
    texts = whole_files(spark, path)
    lines = numbered_lines(spark, path, suffix=".jsonl").select(relative(F.col("file"), path).alias("file"), F.col("line_no").alias("ord"), F.try_parse_json("value").alias("record")).where("record is not null")
    named = scan_files(spark, path).where(F.lower("file").endswith(".jsonl")).select("file", F.lit(LINES).alias("wrapper"), F.lit(None).cast("string").alias("envelope"))
    return records_of(texts).unionByName(lines), wrappers(texts).unionByName(named)


def file_rows(records: DataFrame, envelopes: DataFrame) -> DataFrame:
    """file, part, n, line: the lines of each file as it is written, in the order of part and n.

    A list is "[", its records, "]"; an object gets its other fields back and "data" last; a single record stands alone, and where none or more than
    one is left they are a list. Lines have no wrapper; where none is left, a blank one keeps the file.
    """
    first = F.row_number().over(Window.partitionBy("file").orderBy("ord")) == 1
    many = records.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    e = envelopes.join(many, "file", "left")
    e = e.withColumn("wrapper", F.when((F.col("wrapper") == NONE) | (F.col("wrapper") == SINGLE) & ~F.col("n").eqNullSafe(F.lit(1)), LISTED).otherwise(F.col("wrapper")))
    opened = F.when(F.col("wrapper") == LISTED, "[").when(F.col("envelope") == "{}", '{"data": [').otherwise(F.concat(F.expr("left(envelope, length(envelope) - 1)"), F.lit(', "data": [')))
    none = F.lit(0).cast("long")
    framed = e.where(F.col("wrapper").isin(LISTED, WRAPPED))
    head = framed.select("file", F.lit(0).alias("part"), none.alias("n"), opened.alias("line"))
    tail = framed.select("file", F.lit(2).alias("part"), none.alias("n"), F.when(F.col("wrapper") == LISTED, "]").otherwise("]}").alias("line"))
    blank = e.where((F.col("wrapper") == LINES) & F.col("n").isNull()).select("file", F.lit(0).alias("part"), none.alias("n"), F.lit("").alias("line"))
    kind = e.select("file", F.col("wrapper").isin(LISTED, WRAPPED).alias("framed"))
    body = records.withColumn("first", first).join(kind, "file")
    body = body.select("file", F.lit(1).alias("part"), F.col("ord").alias("n"), F.concat(F.when(F.col("framed") & ~F.col("first"), ",").otherwise(""), F.to_json("record")).alias("line"))
    return head.unionByName(body).unionByName(tail).unionByName(blank)


def write_records(records: DataFrame, envelopes: DataFrame, path: str) -> int:
    """Writes every file of envelopes below path, a new folder, in its wrapper and under its own name; returns how many.

    One task writes a file as a stream of sorted lines. The driver only renames what the tasks wrote; it sees names, no contents.
    """
    spark = records.sparkSession
    stage = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    rows = file_rows(records, envelopes).select("line", "part", "n", F.hex(F.col("file").cast("binary")).alias("name"))
    # Sorted by the partition column first, so that the writer keeps this order.
    rows.repartition("name").sortWithinPartitions("name", "part", "n").select("line", "name").write.partitionBy("name").text(stage)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs, done = at(stage).getFileSystem(spark._jsc.hadoopConfiguration()), 0
    fs.mkdirs(at(path))
    for status in fs.listStatus(at(stage)):
        folder = status.getPath()
        if folder.getName().startswith("name="):
            to = at(f"{path.rstrip('/')}/{bytes.fromhex(folder.getName()[5:]).decode()}")
            fs.mkdirs(to.getParent())
            (part,) = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
            fs.rename(part, to)
            done += 1
    fs.delete(at(stage), True)
    return done


def _digests(records: DataFrame, side: str) -> DataFrame:
    """One row for each file: its number of records and an order-aware digest, which combines before the shuffle."""
    h = F.xxhash64("ord", F.to_json("record"))
    return records.groupBy("file").agg(F.count(F.lit(1)).alias(f"n_{side}"), F.bit_xor(h).alias(f"x_{side}"), F.bit_xor(F.xxhash64(h)).alias(f"y_{side}"))


def _ranked(records: DataFrame) -> DataFrame:
    return records.select("file", F.col("ord").cast("long").alias("ord"), "record")


def first_difference(a: Column, b: Column) -> Column:
    """What differs between two records: "keys", the first differing field by name, or "record" where they aren't both objects."""
    x, y = _object(a), _object(b)
    keys = lambda m: F.array_sort(F.map_keys(m))
    field = F.get(F.filter(keys(x), lambda k: ~F.to_json(F.element_at(x, k)).eqNullSafe(F.to_json(F.element_at(y, k)))), F.lit(0))
    return F.when(x.isNull() | y.isNull(), "record").when(keys(x) != keys(y), "keys").otherwise(field)


def directory_diff(base: DataFrame, target: DataFrame, base_files: DataFrame | None = None, target_files: DataFrame | None = None) -> DataFrame:
    """A row for each file of either side: file, verdict, n_base, n_target, first_ord, differs_in.

    base and target have file, ord (0, 1, ... in each file) and record (VARIANT); base_files and target_files(file) name files without records as well.
    verdict: missing (in base only, a failure), extra (in target only, a warning), equal, differs. Where counts agree, first_ord is the place of the first
    record that differs, and differs_in tells its field, "keys" or "record"; where they don't, "count". Files are compared by digests
    of 128 bits first; only the records of files that differ meet in a join. Objects are equal whatever the order of their fields.
    """
    base, target = _ranked(base), _ranked(target)
    names = lambda r, f: (r.select("file") if f is None else r.select("file").unionByName(f.select("file"))).distinct()
    a, b = names(base, base_files).withColumn("in_base", F.lit(True)), names(target, target_files).withColumn("in_target", F.lit(True))
    f = a.join(b, "file", "full").join(_digests(base, "base"), "file", "left").join(_digests(target, "target"), "file", "left")
    f = f.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_base", "n_target")})
    both, counts = F.col("in_base") & F.col("in_target"), F.col("n_base") == F.col("n_target")
    same = counts & F.col("x_base").eqNullSafe(F.col("x_target")) & F.col("y_base").eqNullSafe(F.col("y_target"))
    f = f.withColumn("verdict", F.when(F.col("in_target").isNull(), "missing").when(F.col("in_base").isNull(), "extra").when(both & same, "equal").otherwise("differs"))
    odd = f.where((F.col("verdict") == "differs") & counts).select("file")
    pairs = base.join(odd, "file", "left_semi").join(target.join(odd, "file", "left_semi").select("file", "ord", F.col("record").alias("other")), ["file", "ord"])
    pairs = pairs.where(F.to_json("record") != F.to_json("other")).select("file", "ord", first_difference(F.col("record"), F.col("other")).alias("what"))
    first = pairs.groupBy("file").agg(F.min(F.struct("ord", "what")).alias("first"))
    out = f.join(first, "file", "left")
    at = lambda c: F.when(F.col("in_base").isNotNull() & F.col("in_target").isNotNull(), c)
    return out.select("file", "verdict", "n_base", "n_target", F.col("first.ord").alias("first_ord"), at(F.when(F.col("verdict") == "differs", F.coalesce("first.what", F.lit("count")))).alias("differs_in"))


def diff_directories(spark: SparkSession, base: str, target: str) -> DataFrame:
    """directory_diff() of two folders of record files."""
    (a, fa), (b, fb) = (read_records(spark, p) for p in (base, target))
    return directory_diff(_dense(a), _dense(b), fa, fb)


def _dense(records: DataFrame) -> DataFrame:
    """Records numbered 0, 1, ... in their file; blank lines left gaps."""
    return records.withColumn("ord", (F.row_number().over(Window.partitionBy("file").orderBy("ord")) - 1).cast("long"))


def same(diff: DataFrame) -> bool:
    """Whether nothing is missing and no file differs; extra files don't count."""
    return diff.where(F.col("verdict").isin("missing", "differs")).isEmpty()
