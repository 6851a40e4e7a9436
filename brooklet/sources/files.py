"""Files: CSV with control rows, XML, several paths; stores and deliveries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accepted type words.
TYPES = {"int": "int", "integer": "int", "long": "bigint", "ts": "bigint", "timestamp": "bigint", "double": "double", "string": "string", "xml": "string"}


def declared(names: str | Sequence[str], types: str | Sequence[str]) -> T.StructType:
    """A schema from names and type words, separated by blanks or in lists."""
    names, types = (x.split() if isinstance(x, str) else list(x) for x in (names, types))
    if len(names) != len(types):
        raise ValueError("as many types as names")
    unknown = [t for t in types if t.lower() not in TYPES]
    if unknown:
        raise ValueError(f"no such type: {unknown[0]}")
    return T.StructType([T.StructField(n, T._parse_datatype_string(TYPES[t.lower()])) for n, t in zip(names, types, strict=True)])


def csv_stream(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of CSV files with a header, and apart from them the control rows: those with an asterisk in any field.

    The header must agree with the schema. Control rows keep their text.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(text).csv(path)
    control = F.concat_ws(",", *[F.col(f"`{c}`") for c in raw.columns]).contains("*")
    typed = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]
    return raw.filter(~control).select(*typed), raw.filter(control)


def write_csv_with_control(rows: DataFrame, t: str, step: int, path: str) -> None:
    """Writes rows as CSV, and a control row for each step of time that they reach."""
    last = rows.agg(F.max(t).alias("m")).first()["m"]
    first = rows.agg(F.min(t).alias("m")).first()["m"]
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    if last is not None:
        marks = rows.sparkSession.range(first - first % step + step, last + step, step)
        text = text.unionByName(marks.select(*[(F.col("id").cast("string") if c == t else F.lit("*")).alias(c) for c in rows.columns]))
    text.write.mode("overwrite").option("header", True).csv(path)


def xml_scan(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """The elements of XML files as rows."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def write_xml(df: DataFrame, path: str, row_tag: str) -> None:
    df.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", "stream").save(path)


def documents(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Several named Parquet documents as one table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole documents of any format, a row each: name (the last part of its path) and text. A document must fit in a row."""
    read = spark.read.text(paths, wholetext=True)
    return read.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))


def resource(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Rows that ``store`` wrote under a name, in this session or another."""
    return spark.read.parquet(f"{folder}/{name}")


def constant(spark: SparkSession, rows: list[tuple], names: str, types: str) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(rows, declared(names, types))


def store(df: DataFrame, name: str, folder: str) -> DataFrame:
    """Writes rows under a name in a folder and makes them a view of that name once they are complete."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    kept = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    kept.createOrReplaceTempView(name)
    return kept


def display(stream: DataFrame, send: Callable[[DataFrame, int], None]):
    """Hands each micro-batch of a stream to ``send``; returns the writer, which the caller starts."""
    return stream.writeStream.foreachBatch(send)


def deliver(df: DataFrame, column: str) -> DataFrame:
    """The last attribute of each row, as it goes to a client."""
    return df.select(F.col(column).alias("result"))


def tunables(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """The session's values of some settings; null for one that isn't set."""
    return spark.createDataFrame([(n, spark.conf.get(n, None)) for n in names], "name string, value string")
