"""Content hashes and deterministic point ids as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lx

#: Fixed value: the DNS namespace of RFC 4122.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def composite_hash(*parts: Column) -> Column:
    """Hash of the parts joined by a bar; a missing part counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def is_missing(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return value.isNull() | text.isin(lx.MISSING_TOKENS)


def content_hash(df: DataFrame) -> Column:
    """Existing ``text_hash``, else the first text-like column that is filled,
    else all columns as JSON."""
    choices = []
    if "text_hash" in df.columns:
        choices.append(F.when(~is_missing(F.col("text_hash")), F.col("text_hash").cast("string")))
    for name, kind in df.dtypes:
        if kind == "string" and name != "text_hash" and any(h in name.lower() for h in lx.TEXT_NAME_HINTS):
            choices.append(F.when(~is_missing(F.col(name)), text_hash(F.col(name))))
    choices.append(text_hash(F.to_json(F.struct(*sorted(df.columns)))))
    return F.coalesce(*choices)


def _dashed(digits: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digits, start, size) for start, size in cuts])


def uuid5(name: Column) -> Column:
    """RFC 4122 name-based id (SHA-1) of a text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    digits = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant,
                      F.substring(digest, 18, 15))
    return _dashed(digits)


def as_point_id(value: Column) -> Column:
    """A text that is a UUID in canonical form, any other as its UUIDv5."""
    text = F.trim(value.cast("string"))
    bare = F.replace(F.regexp_replace(F.regexp_replace(text, "urn:|uuid:", ""), r"^[{}]+|[{}]+$", ""), F.lit("-"), F.lit(""))
    return F.when(bare.rlike("^[0-9a-fA-F]{32}$"), _dashed(F.lower(bare))).otherwise(uuid5(text))


def point_id(df: DataFrame, key: list[str] | None = None, hash_column: str = "text_hash") -> Column:
    """Key columns if all are filled, else record or chunk id, else the content hash."""
    choices = []
    if key:
        filled = ~F.lit(False)
        for k in key:
            filled = filled & ~is_missing(F.col(k))
        choices.append(F.when(filled, as_point_id(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))))
    for name in ("record_id", "chunk_id"):
        if name in df.columns:
            choices.append(F.when(~is_missing(F.col(name)), as_point_id(F.col(name))))
    if hash_column in df.columns:
        choices.append(F.when(F.col(hash_column) != "", as_point_id(F.col(hash_column))))
    return F.coalesce(*choices, F.uuid())
