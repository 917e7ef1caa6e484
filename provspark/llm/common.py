"""Small helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is absent (tests, a laptop) a temporary folder is
    made and remembered in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="provspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage, survives the loss of any executor and lets several
    later scans use one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to Python at a time where rows carry whole texts.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BYTES = "4m"


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends rows to Python by ``TEXT_BYTES``, so that a task's memory follows neither the texts' lengths nor the rows of a batch."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, TEXT_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows sorted by ``keys``, cut so that no group is split, with the places where groups begin (and the end)."""
    held: pd.DataFrame | None = None

    def starts(x: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(x), bool)
        change[0] = True
        for k in keys:
            v = x[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for x in batches:
        x = x if held is None else pd.concat([held, x], ignore_index=True)
        if not len(x):
            continue
        at = starts(x)
        if len(at) > 1:
            yield x.iloc[: at[-1]], at
        held = x.iloc[at[-1] :].reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.append(starts(held), len(held))


def sql_crc32(text: str) -> str:
    """DuckDB's words for the unsigned CRC-32 of an ASCII text, which it has no function for: bit by bit."""
    codes = f"[4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    shifted = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce({codes}, lambda a, b: {shifted}), 4294967295)"
