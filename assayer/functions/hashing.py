"""Digests and fingerprints, and the canonical JSON they are taken of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsontext

DIGEST = r"^sha256:[0-9a-f]{64}$"


def digest(canonical: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def hmac_fingerprint(content: Column, secret: bytes) -> Column:
    """HMAC-SHA-256 by its definition: two nested hashes with the padded key.

    The secret becomes a literal of the plan; run it where plans aren't shown to others.
    """
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    return F.sha2(
        F.concat(outer, F.unhex(F.sha2(F.concat(inner, content.cast("binary")), 256))), 256
    )


def canonical(fields: dict[str, Column], defaults: dict[str, object] | None = None) -> Column:
    """Compact JSON with sorted names, nulls and fields at their default left out.

    Fields are strings, integers, booleans, arrays or structs: doubles print differently
    from other JSON writers, so numbers with a fraction are to be given as text.
    """
    columns = []
    for name in sorted(fields):
        value = fields[name]
        if defaults and name in defaults:
            value = F.when(value != F.lit(defaults[name]), value)
        columns.append(value.alias(name))
    return jsontext.lowered(F.to_json(F.struct(*columns)))
