"""Content and record identities."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def _utf8(value) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.encode(value.cast("string"), "UTF-8")


def content_hash(dtype, shape, payload: Column) -> Column:
    """SHA-256 over element type, shape and bytes, so equal bytes of another shape differ."""
    return F.sha2(F.concat(_utf8(dtype), _utf8(shape), payload.cast("binary")), 256)


def file_digest(payload: Column) -> Column:
    """SHA-256 over the raw bytes alone: the catalog key."""
    return F.sha2(payload.cast("binary"), 256)


def dataset_namespace(name: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, name)


def record_uuid(namespace: uuid.UUID, split: Column, index: Column, digest: Column) -> Column:
    """Version-5 UUID of ``"split:index:hash"`` in ``namespace``."""
    name = F.concat_ws(":", split, index.cast("string"), digest)
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), _utf8(name)))
    # RFC 4122: the version digit is 5; the variant digit keeps its low two bits under 10xx.
    variant = F.translate(F.substring(raw, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(raw, 1, 8), F.lit("-"),
        F.substring(raw, 9, 4), F.lit("-5"),
        F.substring(raw, 14, 3), F.lit("-"),
        variant, F.substring(raw, 18, 3), F.lit("-"),
        F.substring(raw, 21, 12),
    )


def seeded_order(seed: int, key: Column) -> Column:
    """Uniform, reproducible ordering key: hex SHA-256 of seed and record key."""
    return F.sha2(F.concat(_utf8(str(seed)), F.lit(":").cast("binary"), _utf8(key)), 256)


def short_id(value: Column) -> Column:
    return F.substring(value, 1, 8)


def path_key(path: Column) -> Column:
    return F.substring(F.sha2(_utf8(path), 256), 1, 16)


def model_version(name: Column, model_json: Column, metrics_json: Column) -> Column:
    """Digest of everything that decides a prediction, threshold included."""
    return F.sha2(F.concat(_utf8(name), _utf8(model_json), _utf8(metrics_json)), 256)
