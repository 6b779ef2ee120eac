"""Column expressions on file paths, sizes and progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that count as images.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".gif", ".png", ".bmp")
#: Fixed value: bytes from which sizes are given in MB.
MEGABYTE = 1_048_576


def extension(path: Column) -> Column:
    """Last extension with its dot, in small letters; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def path_key(path: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the path in small letters."""
    return F.substring(F.sha2(F.lower(path), 256), 1, 32)


def thumbnail_path(folder: str, path: Column, ending: str = ".jpg") -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), path_key(path), F.lit(ending))


def display_path(thumbnail: Column, path: Column) -> Column:
    return F.coalesce(thumbnail, path)


def is_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"\s+", ""), F.lit("")) == ""


def half_up(x: Column, digits: int) -> Column:
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def size_text(length: Column) -> Column:
    """Size as text: whole KB, or MB with one digit from a megabyte on; null is 0 KB."""
    mb = F.format_string("%.1f MB", half_up(length / MEGABYTE, 1))
    return F.when(length.isNull(), "0 KB").when(length >= MEGABYTE, mb).otherwise(F.format_string("%.0f KB", half_up(length / 1024, 0)))


def percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(done.cast("double"), total.cast("double")) * 100.0)
