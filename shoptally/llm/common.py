"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptally.session import checkpoint_dir, materialize

__all__ = ["SPACE", "checkpoint_dir", "has_word", "materialize", "pack", "read", "strip", "unpack", "words"]

SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[ \t\n\x0B\f\r]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; NULL and blank texts have none."""
    bare = strip(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACES, -1))


def has_word(text: Column) -> Column:
    return strip(text) != ""


def pack(df: DataFrame, keep: list[str] | None = None, **named: Column) -> DataFrame:
    """The rows (all columns, or those in ``keep``) as one struct column
    ``_row`` beside the operator's own columns, so that no input column can
    clash with them."""
    row = F.struct(*[df[c] for c in (df.columns if keep is None else keep)])
    return df.select(row.alias("_row"), *[c.alias(n) for n, c in named.items()])


def unpack(df: DataFrame, **named: Column) -> DataFrame:
    """Back to the input columns plus results; a result replaces an input
    column of the same name."""
    inner = [f.name for f in df.schema["_row"].dataType.fields]
    kept = [F.col("_row").getField(c).alias(c) for c in inner if c.lower() not in {n.lower() for n in named}]
    return df.select(*kept, *[c.alias(n) for n, c in named.items()])
