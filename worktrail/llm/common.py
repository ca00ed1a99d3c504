"""Small helpers of the corpus operators."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.session import ensure_checkpoint_dir, ship_package

# Fixed value: a word is a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    `lower` does just that on pure ASCII texts and is much faster than
    `translate`, which the others need.
    """
    text = F.coalesce(text, F.lit(""))
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 1 by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def input_bytes(df: DataFrame) -> int:
    """Size estimate of a plan's input as Spark's optimizer sees it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the checkpoint folder and read it back.

    For results that are read more than once: readers prune columns, see real
    sizes, and don't depend on the executors that made it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
