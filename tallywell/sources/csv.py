"""CSV files, plain or compressed, as typed columns.

Files are read as text and typed by expressions: kinds are inferred in one pass over
all columns (integers if all values are, else floats if all are, else text), unless
a schema string says them.  An empty field is NULL in a nullable column, and 0 or an
empty text in another.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import ColumnSchema, CsvSchema

_ZERO = {"int": lambda: F.lit(0).cast("long"), "float": lambda: F.lit(0.0), "str": lambda: F.lit("")}
#: Whole numbers as they are read: an optional sign, digits, no spaces.
_INT, _FLOAT = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class CsvOptions:
    """Columns are given by position.  ``names`` replaces the header's names, or names the
    columns of a file that has no header."""

    schema: CsvSchema | None = None
    names: Sequence[str] | None = None
    header: bool = True
    ignore: Collection[int] = ()
    always_string: Collection[int] = ()
    nullable: Collection[int] = ()
    all_nullable: bool = False
    delimiter: str = ","

    @classmethod
    def with_schema(cls, text: str, **more) -> CsvOptions:
        schema = CsvSchema.parse(text)
        return cls(schema=schema, names=schema.names, **more)

    def nullable_everywhere(self) -> CsvOptions:
        return replace(self, all_nullable=True)


def _int(text: Column) -> Column:
    return F.when(text.rlike(_INT), text.try_cast("long"))


def _float(text: Column) -> Column:
    return F.when(text.rlike(_FLOAT), text.try_cast("double"))


def transformed(text: Column, column: ColumnSchema) -> Column:
    """A column of text as its schema has it.  Fixed-point numbers are truncated, dates are
    seconds since 1970 in UTC."""
    if column.transform in ("100", "1000"):
        return (text.try_cast("double") * float(column.transform)).cast("long")
    if column.transform == "date":
        return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
    return _int(text) if column.kind == "int" else text


def inferred(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The kinds of text columns, by one aggregate over all of them.  A column with no
    value at all is text."""
    if not columns:
        return {}
    tests = []
    for i, c in enumerate(columns):
        there = F.col(c).isNotNull()
        tests += [F.count_if(there).alias(f"n{i}"), F.count_if(there & _int(F.col(c)).isNull()).alias(f"i{i}"), F.count_if(there & _float(F.col(c)).isNull()).alias(f"f{i}")]
    found = df.agg(*tests).first()
    return {c: "str" if not found[f"n{i}"] else "int" if not found[f"i{i}"] else "float" if not found[f"f{i}"] else "str" for i, c in enumerate(columns)}


def read_csv(spark: SparkSession, path: str | Sequence[str], options: CsvOptions = CsvOptions()) -> DataFrame:
    """The files at ``path``; names ending in .gz are decompressed."""
    reader = spark.read.option("header", options.header).option("sep", options.delimiter).option("quote", '"').option("escape", '"')
    df = reader.option("nullValue", "").option("emptyValue", "").option("inferSchema", False).csv(path)
    names = list(options.names or df.columns)
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    df = df.toDF(*(f"c{i}" for i in range(len(names))))
    kept = [i for i in range(len(names)) if i not in options.ignore and not (options.schema and options.schema.columns[i].kind == "drop")]
    text = {i: F.nullif(F.col(f"c{i}"), F.lit("")) for i in kept}
    if options.schema:
        kinds = {i: options.schema.columns[i].kind for i in kept}
        values = {i: transformed(text[i], options.schema.columns[i]) for i in kept}
        nullable = {i for i in kept if options.schema.columns[i].nullable}
    else:
        open_ = [i for i in kept if i not in options.always_string]
        got = inferred(df.select(*(text[i].alias(f"c{i}") for i in open_)), [f"c{i}" for i in open_]) if open_ else {}
        kinds = {i: got.get(f"c{i}", "str") for i in kept}
        values = {i: _int(text[i]) if kinds[i] == "int" else _float(text[i]) if kinds[i] == "float" else text[i] for i in kept}
        nullable = set(options.nullable)
    full = lambda i: values[i] if options.all_nullable or i in nullable else F.coalesce(values[i], _ZERO[kinds[i]]())
    return df.select(*(full(i).alias(f"c{i}") for i in kept)).toDF(*(names[i] for i in kept))
