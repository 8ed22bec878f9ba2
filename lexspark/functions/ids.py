"""Deterministic ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(seed: Column, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """RFC 4122 version 5 id of a string, as SQL functions over SHA-1."""
    h = F.sha1(F.concat(F.lit(namespace.bytes), F.coalesce(seed, F.lit("")).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
