"""Helpers that the corpus operators share: reading tables, cutting lineage, skew-free row numbering."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = re.compile(rb"[^\x20\x09-\x0d]+")
UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a folder of our own only where none is set (tests, one machine)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space; null has no words."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split()


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod n."""
    return F.pmod(F.crc32((F.col(col) if isinstance(col, str) else col).cast("string").cast("binary")), F.lit(n))


def parts(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_text(df: DataFrame, *cols: str) -> tuple[list[Column], list[Column]]:
    """Columns to send through pandas, and to select afterwards: whole numbers travel as text, since pandas would make a column
    with nulls one of floats."""
    whole = {f.name: f.dataType for f in df.schema if f.dataType.typeName() in ("long", "integer", "short", "byte")}
    return [F.col(c).cast("string").alias(c) if c in whole else F.col(c) for c in cols], [F.col(c).cast(whole[c]).alias(c) if c in whole else F.col(c) for c in cols]
