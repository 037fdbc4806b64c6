"""Delimited and columnar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import clean_text


def read_delimited(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Text columns of a UTF-8 file with a header; a byte order mark before it is dropped."""
    df = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_report(df: DataFrame, path: str, sep: str = "|") -> None:
    """One physical line per row: texts are cleaned, quotes doubled, line ends LF."""
    clean = df.select(*[clean_text(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    clean.write.mode("overwrite").csv(path, sep=sep, header=True, quote='"', escape='"', lineSep="\n", emptyValue="")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
