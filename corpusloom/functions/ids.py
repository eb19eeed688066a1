"""Content hashes and deterministic point ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_hash(content: Column, path: Column | None = None) -> Column:
    """SHA-256 of the content with CRLF read as LF, but for PDF files, whose bytes are taken as they are."""
    text = F.sha2(F.replace(content.cast("string"), F.lit("\r\n"), F.lit("\n")), 256)
    return text if path is None else F.when(F.lower(path).endswith(".pdf"), F.sha2(content, 256)).otherwise(text)


def as_uuid(hex32: Column) -> Column:
    return F.regexp_replace(hex32, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def point_id(slug: Column, index: Column) -> Column:
    """The UUID of a chunk: MD5 of slug and index."""
    return as_uuid(F.md5(F.concat_ws(":", slug, index.cast("string"))))


def point_id_versioned(slug: Column, index: Column, generation: Column) -> Column:
    return as_uuid(F.md5(F.concat_ws(":", slug, index.cast("string"), F.concat(F.lit("g"), generation.cast("string")))))


def visual_point_id(slug: Column, page: Column) -> Column:
    return as_uuid(F.md5(F.concat_ws(":", slug, F.lit("visual"), page.cast("string"))))


def issue_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.left(key, F.lit(8)))


def is_lfs_pointer(content: Column) -> Column:
    """Whether a file is a large-file pointer that was not fetched."""
    return F.coalesce(F.startswith(content, F.encode(F.lit("version https://git-lfs.github.com/spec/"), "utf-8")), F.lit(False))
