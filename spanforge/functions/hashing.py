"""Deterministic identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 8-4-4-4-12 layout of 32 hexadecimal digits.
LAYOUT = r"^(.{8})(.{4})(.{4})(.{4})(.{12}).*$"


def as_uuid(hexadecimal: Column) -> Column:
    return F.regexp_replace(hexadecimal, LAYOUT, "$1-$2-$3-$4-$5")


def joined(*parts: Column | str) -> Column:
    return F.concat_ws(":", *parts)


def stable_uuid(*parts: Column | str) -> Column:
    """UUID layout of the SHA-256 of the parts joined by colons (F1)."""
    return as_uuid(F.sha2(joined(*parts), 256))


def short_id(*parts: Column | str) -> Column:
    """First 16 digits of the SHA-256 of the parts joined by colons (F2)."""
    return F.substring(F.sha2(joined(*parts), 256), 1, 16)


def point_id(text: Column) -> Column:
    """A UUID stays; anything else becomes the UUID layout of its MD5."""
    uuid = text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    return F.when(uuid, F.lower(text)).otherwise(as_uuid(F.md5(text)))


def name_uuid(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID: SHA-1 of namespace and name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return as_uuid(F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)))
