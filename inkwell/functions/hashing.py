"""Content hashes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS name space of name-based UUIDs.
_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def chunk_hash(content: Column, source: Column, chunk_type: Column) -> Column:
    """Hash of a chunk by content, source and type; nulls count as empty."""
    parts = [F.coalesce(c, F.lit("")) for c in (content, source, chunk_type)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def filled_hash(doc_hash: Column, content: Column) -> Column:
    """The given hash, or where it is empty the content's."""
    return F.coalesce(F.nullif(doc_hash, F.lit("")), content_hash(content))


def point_id(name: Column) -> Column:
    """Version-5 UUID of a name, without Python."""
    h = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("long").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 19, 2)),
        F.substring(h, 21, 12),
    )


def version_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")
