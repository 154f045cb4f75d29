"""Sources and sinks (S1-S14): Parquet scans with projection, CSV/JSON prediction
files and artefacts, recursive discovery, schema alignment and diff.

Everything is a lazy DataFrame: column pruning and predicate pushdown reach the
Parquet reader through Catalyst, so a 2-column projection of a 445-column table
reads 2 columns (check ``ReadSchema`` in ``explain``).
"""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION_SCHEMA = "ID long, TARGET double"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def scan(spark: SparkSession, sf_dir: str, name: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan with column projection (pruned at the reader)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df


def scan_path(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def row_count(df: DataFrame) -> int:
    """Row count; Spark answers from Parquet footers/row groups and reads no column."""
    return df.count()


def head(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """First ``n`` rows under an explicit order (TakeOrderedAndProject, no global sort)."""
    return df.orderBy(*order).limit(n)


def scan_predictions(spark: SparkSession, path: str, schema: str = PREDICTION_SCHEMA) -> DataFrame:
    """CSV prediction file(s) with header ``ID,TARGET`` and a fixed schema (no inference pass)."""
    return spark.read.csv(path, header=True, schema=schema)


def write_predictions(df: DataFrame, path: str, id_col: str = "ID", value_col: str = "TARGET",
                      mode: str = "overwrite") -> None:
    """CSV sink ``ID,TARGET`` with header (one part file per partition)."""
    (df.select(F.col(id_col).cast("long").alias("ID"), F.col(value_col).cast("double").alias("TARGET"))
       .write.mode(mode).csv(path, header=True))


def write_variants(df: DataFrame, path: str, variant_col: str = "variant", mode: str = "overwrite",
                   fmt: str = "csv") -> None:
    """Fan-out sink - one directory per variant from a long table, in one job."""
    w = df.write.mode(mode).partitionBy(variant_col)
    if fmt == "csv":
        w.csv(path, header=True)
    else:
        w.format(fmt).save(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
              multiline: bool = True) -> DataFrame:
    """JSON source for statistics / CV artefacts."""
    r = spark.read.option("multiLine", multiline)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON sink of metric artefacts (JSON lines, one file per partition)."""
    df.write.mode(mode).json(path)


def scan_recursive(spark: SparkSession, root: str, glob: str = "*.parquet", fmt: str = "parquet",
                   schema: str | T.StructType | None = None, **options) -> DataFrame:
    """Recursive discovery under ``root`` filtered by a file-name glob."""
    r = (spark.read.format(fmt).option("recursiveFileLookup", True)
         .option("pathGlobFilter", glob))
    if schema is not None:
        r = r.schema(schema)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(root)


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), fill: float = 0.0,
          dtype: str = "double") -> DataFrame:
    """Project ``keep + features`` in that order; absent features become ``fill``."""
    present = set(df.columns)
    cols = [F.col(k) for k in keep if k in present]
    for f in features:
        cols.append((F.col(f).cast(dtype) if f in present else F.lit(fill).cast(dtype)).alias(f))
    return df.select(*cols)


def union_tagged(a: DataFrame, b: DataFrame, tag: str = "is_test") -> DataFrame:
    """Tagged union (``a`` -> 0, ``b`` -> 1); columns missing on one side become NULL."""
    return (a.withColumn(tag, F.lit(0))
            .unionByName(b.withColumn(tag, F.lit(1)), allowMissingColumns=True))


def schema_diff(spark: SparkSession, a: DataFrame, b: DataFrame) -> DataFrame:
    """Per-column presence on each side plus types (a tiny DataFrame built from schemas)."""
    ta = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    tb = {f.name: f.dataType.simpleString() for f in b.schema.fields}
    rows = []
    for name in list(ta) + [n for n in tb if n not in ta]:
        in_a, in_b = name in ta, name in tb
        status = "both" if in_a and in_b else ("left_only" if in_a else "right_only")
        rows.append((name, in_a, in_b, ta.get(name), tb.get(name), status))
    return spark.createDataFrame(
        rows, "column string, in_left boolean, in_right boolean, left_type string, right_type string, status string")


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """U4: column-set intersection in ``a``'s order."""
    bs = set(b.columns)
    return [c for c in a.columns if c in bs]


def join_on_id(a: DataFrame, b: DataFrame, id_col: str = "ID", how: str = "inner") -> DataFrame:
    """Side-by-side reassembly of column sets loaded separately - a key join, not position."""
    return a.join(b, id_col, how)
