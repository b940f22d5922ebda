"""Readers and writers for manifests, predictions, reports, review sheets and listings."""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.fixed import GROUP_LEVEL, ITEM_LEVEL
from kinfold.operators.report import REPORT_SCHEMA
from kinfold.sources.files import list_files, reachable
from kinfold.sources.records import csv_records

#: Cells keep their outer blanks in both directions.
CSV = {
    "header": True, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_manifest_csv(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """All-text manifest rows (an empty cell is '' and not NULL, ``NA`` stays text) and the folder its paths hang below.
    Extra columns are kept. Quoted cells may hold line breaks, and yet a large file is read by many tasks (see ``records``);
    a row with more cells than the header fails the query."""
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    names = spark.read.options(header=True, multiLine=True, **options).csv(path).columns
    cells = [f"c{i}" for i in range(len(names) + 1)]
    records = csv_records(spark, path).where("NOT first")
    parsed = records.select(F.from_csv("text", ", ".join(f"{c} string" for c in cells), options).alias("r")).select("r.*")
    first = F.coalesce(cells[0], F.lit(""))
    too_many = F.raise_error(F.concat(F.lit("a row has more cells than the header, near "), first)).cast("boolean")
    raw = parsed.where(F.when(F.col(cells[-1]).isNull(), F.lit(True)).otherwise(too_many))
    folder = os.path.dirname(path if "://" in path else os.path.abspath(path))
    return raw.select(*[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cells, names, strict=False)]), folder


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header; '' and NULL are both written as bare empty cells."""
    df.write.mode("overwrite").options(**CSV).csv(path)


def write_manifest_csv(df: DataFrame, path: str, root: str) -> None:
    """A manifest with paths relative to ``root``."""
    prefix = root.rstrip("/") + "/"
    relative = F.when(F.col("image_path").startswith(prefix), F.substring("image_path", len(prefix) + 1, 1 << 20))
    write_csv(df.withColumn("image_path", F.coalesce(relative, F.col("image_path"))), path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Parquet, the form every other operator reads."""
    df.write.mode("overwrite").parquet(path)


def write_review_sheet(df: DataFrame, path: str) -> None:
    write_csv(df, path)


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path`` of every file below a folder; file contents are not read. Tasks list the folders (see ``files``); a store that only Spark
    reaches is listed by Spark's file index instead, whose result passes the driver."""
    if reachable(root):
        named = F.regexp_extract("path", "[^/]*$", 0).rlike(fnmatch.translate(pattern))
        return list_files(spark, root).where(named).select("path")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def _undefined(value: object, kind: T.DataType) -> object:
    """A JSON value in which the numbers written as text "NaN" are numbers again; names and other texts stay."""
    if value is None:
        return None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(kind, T.ArrayType):
        return [_undefined(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {k: _undefined(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.StructType):
        return {f.name: _undefined(value.get(f.name), f.dataType) for f in kind.fields}
    return value


def write_report(row: DataFrame, path: str) -> None:
    """The one-row run document as one JSON file. NULLs keep their keys; undefined numbers stand as bare ``NaN``."""
    [text] = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()
    document = json.dumps(_undefined(json.loads(text), row.schema), ensure_ascii=False, separators=(",", ":"))
    jvm, conf = row.sparkSession._jvm, row.sparkSession._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    out.write(document.encode())
    out.close()


def write_run_config(spark: SparkSession, path: str, config: dict[str, object]) -> None:
    """The resolved parameters of a run as one JSON row."""
    known = {k: v for k, v in config.items() if v is not None and v != () and v != []}
    columns = [_literal(v).alias(k) for k, v in known.items()]
    spark.range(1).select(*columns).coalesce(1).write.mode("overwrite").json(path)


def _literal(value: object) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value)


def read_reports(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``run`` and the two level documents of each given run; a run is named after the folder that holds its
    ``metrics.json`` (a file or a folder of JSON parts)."""
    schema = ", ".join(f"{level} struct<{_struct_fields(REPORT_SCHEMA)}>" for level in (ITEM_LEVEL, GROUP_LEVEL))
    files = [f"{p.rstrip('/')}/metrics.json" for p in paths]
    rows = spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", True).json(files)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/metrics\.json(/[^/]*)?$", 1)
    return rows.select(run.alias("run"), ITEM_LEVEL, GROUP_LEVEL)


def _struct_fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]
