"""Functions over encrypted scalars as SQL functions that the optimizer folds away, and a deterministic real cipher."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Logical types of the encrypted ones.
TYPES = {"enc_int4": "INT", "enc_float4": "DOUBLE", "enc_text": "STRING", "enc_timestamp": "TIMESTAMP"}


def register(spark: SparkSession) -> None:
    """enc_<type>_encrypt(text) and enc_<type>_decrypt(value) as temporary SQL functions; casts only, so filters on them
    are pushed down as plain literals."""
    for name, kind in TYPES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_encrypt(x STRING) RETURNS {kind} RETURN CAST(x AS {kind})")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_decrypt(x {kind}) RETURNS {kind} RETURN x")
    for mode in ("enable_client_mode", "enable_record_mode", "enable_replay_mode"):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {mode}(x STRING DEFAULT '') RETURNS BOOLEAN RETURN TRUE")


def rewrite_literals(sql: str) -> str:
    """Query text with enc_<type>_encrypt('literal') calls replaced by typed literals."""
    return re.sub(r"enc_(int4|float4|text|timestamp)_encrypt\(('(?:[^']|'')*')\)", lambda m: f"CAST({m[2]} AS {TYPES['enc_' + m[1]]})", sql)


def encrypt(value: Column, key: str) -> Column:
    """AES in a mode where equal values have equal ciphers, so that joins and groups work; order is lost. key: 16, 24 or 32 characters."""
    return F.base64(F.aes_encrypt(value.cast("string"), F.lit(key), F.lit("ECB")))


def decrypt(cipher: Column, key: str, kind: str = "string") -> Column:
    """The counterpart of encrypt()."""
    return F.aes_decrypt(F.unbase64(cipher), F.lit(key), F.lit("ECB")).cast("string").cast(kind)


def perturbed(value: Column, most: int = 10_000, seed: int = 1) -> Column:
    """A key moved by 1 to `most`, differently in every row."""
    return value + F.floor(1 + F.rand(seed) * most).cast("bigint")
