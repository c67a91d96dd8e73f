"""Labelled rows from records of mixed shapes (VARIANT): resolvers of text and label, the human predicate, rows for a test set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import HUMAN, HUMAN_TYPES, MACHINE

# The fields that may hold a text, a label or a type, in the order in which they are asked.
TEXT_FIELDS = ("text", "content", "document", "abstract", "story")
LABEL_FIELDS = ("label", "y", "gold", "target", "class")
TYPE_FIELDS = ("data_type", "type", "source_type", "category")


def field(record: Column, name: str) -> Column:
    """A field of a record, null where it is missing or a JSON null."""
    v = F.try_variant_get(record, f"$.{name}", "variant")
    return F.when(~F.is_variant_null(v), v)


def has_field(record: Column, name: str) -> Column:
    """Whether an object has the field, if only as a JSON null."""
    return F.coalesce(F.map_contains_key(F.try_variant_get(record, "$", "map<string,variant>"), name), F.lit(False))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column) -> Column:
    """A string's characters; null for other types."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def as_text(v: Column) -> Column:
    """A string as it is, another value as its JSON text."""
    return F.coalesce(_string(v), F.to_json(v))


def first_truthy(record: Column, *names: str) -> Column:
    """The first field that is a string of at least one character, else ''."""
    return F.coalesce(*[F.nullif(_string(field(record, n)), F.lit("")) for n in names], F.lit(""))


def text_or_abstract(record: Column) -> Column:
    return first_truthy(record, "text", "abstract")


def abstract_or_text(record: Column) -> Column:
    return first_truthy(record, "abstract", "text")


def any_text(record: Column) -> Column:
    """The first of TEXT_FIELDS that isn't null, though it be empty; else ''."""
    return F.coalesce(*[as_text(field(record, n)) for n in TEXT_FIELDS], F.lit(""))


def label_of(v: Column) -> Column:
    """0 or 1 from a label of any type: booleans, numbers cut to whole ones, the known spellings; null for others."""
    kind, n = _kind(v), F.try_variant_get(v, "$", "double")
    whole = F.when(F.abs(n) < 2, F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("int"))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    s = F.lower(F.trim(_string(v)))
    of_string = F.when(s.isin(*HUMAN), 0).when(s.isin(*MACHINE), 1)
    return F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int")).when(number, F.when(whole.isin(0, 1), whole)).otherwise(of_string)


def _human_type(v: Column) -> Column:
    return F.coalesce(F.lower(F.trim(_string(v))).isin(*HUMAN_TYPES), F.lit(False))


def inferred_label(record: Column) -> Column:
    """The first of LABEL_FIELDS that is a label; else 0 if one of TYPE_FIELDS names a human text, else 1."""
    human = F.lit(False)
    for n in TYPE_FIELDS:
        human = human | _human_type(field(record, n))
    return F.coalesce(*[label_of(field(record, n)) for n in LABEL_FIELDS], F.when(human, 0).otherwise(1))


def is_human(record: Column) -> Column:
    """By its label where that is one, else by data_type or, where that is missing or empty, by type."""
    own = field(record, "data_type")
    kind = F.when(own.isNotNull() & ~_string(own).eqNullSafe(F.lit("")), own).otherwise(field(record, "type"))
    return F.coalesce(label_of(field(record, "label")) == 0, _human_type(kind))


def test_rows(records: DataFrame) -> DataFrame:
    """records' other columns, text, label, empty_text, missing_label for each row of records(..., record).

    What is no object is a text of its own, labelled 1 and missing a label. An object gives its text by any_text(); a label that is none is inferred, and
    is missing only if there is no field of that name.
    """
    r = F.col("record")
    is_object = F.try_variant_get(r, "$", "map<string,variant>").isNotNull()
    text = F.when(is_object, any_text(r)).otherwise(F.coalesce(F.when(~F.is_variant_null(r), as_text(r)), F.lit("")))
    label = F.when(is_object, F.coalesce(label_of(field(r, "label")), inferred_label(r))).otherwise(F.lit(1))
    out = records.withColumn("text", text).withColumn("label", label.cast("int"))
    return out.withColumn("empty_text", is_object & (F.col("text") == "")).withColumn("missing_label", ~is_object | ~has_field(r, "label")).drop("record")


def test_row_counters(rows: DataFrame, *by: str) -> DataFrame:
    """n, empty_text, missing_label of test_rows(), in all or for each value of `by`."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("empty_text").alias("empty_text"), F.count_if("missing_label").alias("missing_label"))


def filled(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text holds more than white space."""
    return rows.where(F.coalesce(F.col(text_col), F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]"))


def complete(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows in which all the fields are there."""
    return rows.na.drop(subset=list(fields))
