"""Schemas and settings of a run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from enum import Enum

#: File kinds that are filed, and those of them that are films (never decoded).
FILMS = ("mp4", "avi", "3gp", "mov", "wmv", "mts")
KINDS = ("heic", "heif", "jpg", "jpeg", "png", *FILMS)
#: Largest file that is decoded, and the oldest believable modification time (1990-01-01), in ms.
DECODE_LIMIT = 100 * 1024 * 1024
OLDEST_MTIME = 631_152_000_000

SCANNED = "path string, file_size bigint, last_modified bigint"
ITEM = f"{SCANNED}, exif_millis bigint, perceptual_hash bigint, content_signature bigint"


class NoDate(Enum):
    """What happens to an item without a capture date."""

    SKIP = "skip"
    FIXED_DIR = "fixed"
    MODIFIED_DATE = "modified"
    STOP = "stop"


class Collision(Enum):
    """What happens when a target name is taken."""

    SKIP = "skip"
    INCREASE = "increase"
    OVERWRITE = "overwrite"
    STOP = "stop"


@dataclass(frozen=True)
class Settings:
    source: str | None = None
    destination: str | None = None
    dry_run: bool = True
    move_files: bool = False
    workers: int = 0
    use_cache: bool = True
    cache_file: str = ".fernglass-cache"
    no_date: NoDate = NoDate.MODIFIED_DATE
    no_date_dir: str = "noExif"
    collision: Collision = Collision.INCREASE
    duplicates_dir: str = "duplicates"
    dir_format: str = "yyyy\\yyyy_MM"
    file_format: str = "yyyyMMdd_HHmmss"
    #: Also sign films and files above the decode limit (from their head and tail).
    sign_all: bool = False

    def __post_init__(self) -> None:
        for pattern in (self.dir_format, self.file_format):
            bad = {c for c in pattern if c.isalpha()} - set("yMdHhmsSaEDw")
            if bad:
                raise ValueError(f"date pattern {pattern!r} has letters that Spark reads otherwise: {sorted(bad)}")


#: Configuration keys and the settings they fill.
KEYS = {
    "dir.source": "source",
    "dir.destination": "destination",
    "run.mode.drymode": "dry_run",
    "run.mode.filemove": "move_files",
    "run.parser.count": "workers",
    "run.cache.enabled": "use_cache",
    "run.cache.file": "cache_file",
    "policy.noexif": "no_date",
    "policy.noexif.dir": "no_date_dir",
    "policy.duplicate": "collision",
    "policy.duplicate.dir": "duplicates_dir",
    "format.dir": "dir_format",
    "format.file": "file_format",
}


def read_properties(text: str) -> dict[str, str]:
    """A properties text: `key = value` lines, # and ! comments, backslash escapes and continued lines."""
    found: dict[str, str] = {}
    logical, carried = [], ""
    for line in text.splitlines():
        line = carried + line.lstrip()
        if not carried and line[:1] in ("#", "!"):
            continue
        if (len(line) - len(line.rstrip("\\"))) % 2:
            carried = line[:-1]
            continue
        carried = ""
        logical.append(line)
    for line in [*logical, carried]:
        key, value, at, escaped = [], [], 0, False
        while at < len(line) and (escaped or line[at] not in "=: \t"):
            escaped = line[at] == "\\" and not escaped
            key.append(line[at])
            at += 1
        rest = line[at:].lstrip()
        value = rest[1:].lstrip() if rest[:1] in ("=", ":") else rest
        if key:
            found[_unescaped("".join(key))] = _unescaped(value)
    return found


def _unescaped(text: str) -> str:
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c == "\\" and at + 1 < len(text):
            at += 1
            c = text[at]
            if c == "u":
                out.append(chr(int(text[at + 1 : at + 5], 16)))
                at += 5
                continue
            c = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}.get(c, c)
        out.append(c)
        at += 1
    return "".join(out)


def settings_from(properties: Mapping[str, str]) -> Settings:
    """Settings from configuration keys. Values that cannot be read leave the default; only 'true' is true."""
    out = Settings()
    kinds = {f.name: type(getattr(out, f.name)) for f in fields(Settings)}
    for key, name in KEYS.items():
        value = properties.get(key)
        if value is None:
            continue
        kind = kinds[name]
        if kind is bool:
            out = replace(out, **{name: value.strip().lower() == "true"})
        elif kind is int:
            if value.strip().lstrip("+-").isdecimal():
                out = replace(out, **{name: int(value)})
        elif issubclass(kind, Enum):
            if value.strip().upper() in kind.__members__:
                out = replace(out, **{name: kind[value.strip().upper()]})
        else:
            out = replace(out, **{name: value})
    return out


def settings_from_file(path: str) -> Settings:
    with open(path, encoding="iso-8859-1") as file:
        return settings_from(read_properties(file.read()))
