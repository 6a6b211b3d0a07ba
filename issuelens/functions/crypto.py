"""HMAC-SHA256 as a native Spark expression (no Python UDF).

HMAC(K, m) = SHA256((K' xor opad) || SHA256((K' xor ipad) || m)), where K' is
the key (pre-hashed when longer than the 64-byte block) padded with zeros.
The pads are constants computed once on the driver, so per row the work is
two ``sha2`` calls inside whole-stage codegen.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    key = secret.encode("utf-8")
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(message: Column, secret: str) -> Column:
    """Lower-case hex digest of HMAC-SHA256 over the UTF-8 bytes of ``message``."""
    ipad, opad = hmac_pads(secret)
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(ipad)), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(opad)), inner), 256)


def hmac_sql_duckdb(message_sql: str, secret: str) -> str:
    """The same construction in DuckDB SQL (used by the oracle)."""
    ipad, opad = hmac_pads(secret)
    inner = f"unhex(sha256(unhex('{ipad.hex()}') || encode({message_sql})))"
    return f"sha256(unhex('{opad.hex()}') || {inner})"
