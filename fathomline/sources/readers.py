"""Readers and writers of survey files, and the guard that admits a source."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.operators.ingest import validate
from fathomline.runtime import materialise


def without_nan(df: DataFrame) -> DataFrame:
    """NaN is not a value of the data model: doubles that hold it become null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", "").option("nanValue", "NaN")
    return without_nan((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def event_comments(lines: DataFrame) -> DataFrame:
    """(event, comment) of header lines (at, line) such as ``Event(s): A_1 (station 1) * LATITUDE: .. * COMMENT: ..``.

    An event's label is one word before the first bracket; its comment is all that follows the key, later
    stars included. Of several lines of one event, the last holds; lines without either are left out.
    """
    body = F.trim(F.regexp_replace(F.trim("line"), "^Event\\(s\\):", ""))
    label = F.trim(F.translate(F.substring_index(body, "(", 1), "\t", " "))
    text = F.trim(F.translate(F.expr("substring(line, locate('COMMENT:', line) + 8)"), "\t\r", "  "))
    told = lines.filter(F.col("line").contains("COMMENT:") & F.substring_index("line", "COMMENT:", 1).contains(")"))
    told = told.select("at", label.alias("event"), text.alias("comment")).filter((F.col("event") != "") & ~F.col("event").contains(" ") & (F.col("comment") != ""))
    return told.groupBy("event").agg(F.max_by("comment", "at").alias("comment"))


def with_comments(rows: DataFrame, comments: DataFrame, event: str) -> DataFrame:
    """Rows with their event's ``comment``, null where the header has none."""
    return rows.join(comments.withColumnRenamed("event", "_event"), rows[event] == F.col("_event"), "left").drop("_event")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line): lines of one text file with their numbers, read by splits.

    A split knows where in the file it starts, and Spark numbers rows as it reads them; lines per split, summed up over the splits
    before, make numbers of the whole file. Only a row a split meets others, so a file may have any length.
    """
    split = F.col("_metadata.file_block_start").alias("split")
    lines = spark.read.option("lineSep", "\n").text(path).select(split, F.regexp_replace("value", "\r$", "").alias("line"))
    lines = materialise(lines.withColumn("read", F.monotonically_increasing_id()), "lines")
    splits = lines.groupBy("split").agg(F.min("read").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.withColumn("before", before), "split").select((F.col("read") - F.col("first") + F.col("before")).alias("at"), "line")


def read_tab(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A ``.tab`` export: (rows with native headers and their line as ``_row``, event comments).

    The header block ends at the line that is ``*/``; a file without it is refused. Native headers
    may repeat in part, so they are kept whole. Lines are a table read by splits: only the header's end and the
    column names reach the driver.
    """
    lines = numbered_lines(spark, path)
    stop = lines.filter(F.trim("line") == "*/").agg(F.min("at").alias("at")).first()["at"]
    if stop is None:
        raise ValueError(f"{path}: the header block has no end")
    names = lines.filter(F.col("at") == stop + 1).first()["line"].split("\t")
    cells = F.split("line", "\t")
    value = lambda k: F.try_element_at(cells, F.lit(k + 1))
    rows = lines.filter((F.col("at") > stop + 1) & (F.trim("line") != "")).select(
        *(F.when(F.trim(value(k)) != "", value(k)).alias(n.replace("`", "")) for k, n in enumerate(names)), (F.col("at") - stop - 2).cast("bigint").alias("_row")
    )
    return rows, event_comments(lines.filter(F.col("at") < stop))


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet of a workbook; needs a workbook library, and says so where there is none."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=sheet)
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    return without_nan(spark.createDataFrame(frame.astype(object).where(frame.notna(), None)))


def read_live(identifier: str, loader: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """A published dataset through an injected loader; there is none built in."""
    if loader is None:
        raise RuntimeError(f"no loader for {identifier}: pass one that returns a DataFrame")
    return loader(identifier)


def read_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored corpus, each of whose rows keeps the rules; the first that does not fails the job, naming what it breaks."""
    return validate(read_csv(spark, path, schema), strict=True)[0]


def write_corpus(corpus: DataFrame, path: str, columns: list[str]) -> None:
    """Rows in order of source and record in range-sorted part files, columns in a fixed order."""
    corpus.select(*columns).orderBy("source_id", "source_record_id").write.mode("overwrite").option("header", True).csv(path)


def write_stack(layers: DataFrame, path: str) -> None:
    layers.write.mode("overwrite").parquet(path)


def admit(entry: dict | None, content: bytes | None) -> None:
    """Refuses a source that is not declared measured, or whose bytes are not those declared."""
    if entry is None:
        raise ValueError("the source is not in the queue")
    if entry.get("data_origin") != "MEASURED":
        raise ValueError(f"the source is declared {entry.get('data_origin')}, not MEASURED")
    if not re.fullmatch(r"[0-9a-f]{64}", str(entry.get("sha256", ""))):
        raise ValueError("the source declares no content hash")
    if content is None:
        raise ValueError("the source's file is missing")
    if hashlib.sha256(content).hexdigest() != entry["sha256"]:
        raise ValueError("the file is not the one declared")
