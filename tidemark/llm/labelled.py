"""Labelled rows for training, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(""))) % parts


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, parts: int, held_out: int, most: int) -> DataFrame:
    """(id, text, label) of at most ``most`` labelled rows outside the held-out share, in the order of a hash of the id.

    Labels that are null or whose id is null do not count; where an id has several, the largest counts.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    usable = usable.where(remainder("id", parts) != held_out).groupBy("id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # At most ``most`` rows of two numbers.
    return texts.join(F.broadcast(chosen), "id")
