"""Content hashes, keyed pseudonyms and multiset digests, all from built-in expressions."""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_LANES = 4
_LANE_HEX = 15


def sha256_text(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; the order the caller wrote them in does not matter."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def request_fingerprint(**fields: Column) -> Column:
    return sha256_text(canonical_json(**fields))


def pseudonymise(value: Column, salt: str) -> Column:
    """First 24 hex digits of HMAC-SHA256, composed from sha2 so that it stays in the JVM."""
    key = salt.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, 24)


def lane_numbers(digest: Column) -> list[Column]:
    """The lanes of 60 bits that a SHA-256 in hex is cut into."""
    return [F.conv(F.substring(digest, i * _LANE_HEX + 1, _LANE_HEX), 16, 10).cast("bigint") for i in range(_LANES)]


def lane_sum(number: Column) -> Column:
    """Exact sum of a lane: its halves of 30 bits are added up as whole numbers of 64 bits."""
    high, low = (F.sum(half).cast("decimal(20,0)") for half in (F.shiftright(number, 30), number.bitwiseAND(F.lit(2**30 - 1))))
    return (high * F.lit(Decimal(2**30)) + low).cast("decimal(38,0)")


def lane_sums(row_text: Column) -> list[Column]:
    """Aggregates whose values identify a multiset of rows, in any order.

    Every row's SHA-256 is cut into lanes of 60 bits, and the lanes are added up. The sums
    combine map-side, so the rows of one claim are never gathered in one place.
    """
    return [lane_sum(n) for n in lane_numbers(sha256_text(row_text))]
