"""Column functions: everything that is said of one row, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DECODE_LIMIT, FILMS, KINDS, OLDEST_MTIME


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; '' without a dot or with none but a leading one."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def is_supported(name: Column) -> Column:
    return extension(name).isin(*KINDS)


def is_film(name: Column) -> Column:
    return extension(name).isin(*FILMS)


def is_decodable(name: Column, size: Column) -> Column:
    return (size <= DECODE_LIMIT) & ~is_film(name)


def believable_mtime(mtime: Column, ctime: Column) -> Column:
    return F.when(mtime < OLDEST_MTIME, ctime).otherwise(mtime)


def effective_date(exif: Column, modified: Column) -> Column:
    return F.coalesce(exif, modified)


def known(value: Column) -> Column:
    """A stored 0 means "none"."""
    return F.when(value != 0, value)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_text(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def under_root(path: Column, root: str) -> Column:
    """By path elements: /photos2 is not under /photos."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def dated(millis: Column, pattern: str) -> Column:
    """In UTC, whatever the session's time zone is: of the built-in formatters only this one takes a zone."""
    plain = {"sep": "\x01", "timeZone": "UTC", "timestampFormat": pattern, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return F.when(millis.isNotNull(), F.to_csv(F.struct(F.timestamp_millis(millis).alias("t")), plain))


def with_slashes(text: Column) -> Column:
    return F.translate(text, "\\", "/")


def slices(bits: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of `parts` slices of a word; the first ones take what does not divide evenly."""
    out, at = [], 0
    for k in range(parts):
        width = bits // parts + (k < bits % parts)
        out.append((at, width))
        at += width
    return out


def hash_slice(h: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(h, offset).bitwiseAND(F.lit((1 << width) - 1))
