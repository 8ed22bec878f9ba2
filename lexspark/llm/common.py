"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from lexspark.session import map_in_arrow  # noqa: F401 - used by the modules beside this one

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words in a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(*cols: Column) -> Column:
    """The first 60 bits of an MD5 over the columns, as a non-negative long; nulls count as a value of their own."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def with_fields(df: DataFrame, **fields: DataType) -> StructType:
    """The schema of ``df`` with more fields at its end."""
    return StructType([*df.schema.fields, *(StructField(name, kind) for name, kind in fields.items())])
