"""64-bit keys: BLAKE2b with an eight-byte digest, as signed longs.

Spark has no BLAKE2, so this is the one Python function on the ingest path; it is
vectorised over Arrow batches.  ``unsigned`` renders the key as it is elsewhere.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8"), digest_size=8).digest(), "big", signed=True)


@F.pandas_udf(LongType())
def hash_key(namespace: pd.Series, path: pd.Series) -> pd.Series:
    """The key of a path in a namespace; null if either is null."""
    return pd.Series([None if a is None or b is None else _key(f"{a}\0{b}") for a, b in zip(namespace, path)], dtype="Int64")


@F.pandas_udf(LongType())
def seed_key(seed: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else _key(s) for s in seed], dtype="Int64")


def path_id(absolute_path: Column) -> Column:
    return hash_key(F.lit("path"), absolute_path)


def content_id(version_id: Column, absolute_path: Column) -> Column:
    return hash_key(version_id, absolute_path)


def unsigned(key: Column) -> Column:
    return F.conv(F.hex(key), 16, 10)


def shard(seed: Column, shards: int = 64) -> Column:
    """The unsigned key of the seed modulo the number of shards."""
    return F.pmod(unsigned(seed_key(seed)).cast("decimal(20,0)"), F.lit(shards).cast("decimal(20,0)")).cast("long")
