"""What is computed from a file's bytes: signature, perceptual hash, capture date."""

from __future__ import annotations

import re
import struct
import zlib
from datetime import UTC, datetime

import numpy as np

#: The published 64-bit FNV-1a constants and the bytes sampled at either end.
FNV_START, FNV_STEP = 0xCBF29CE484222325, 0x100000001B3
SAMPLE = 64 * 1024
#: Side of the shrunken picture and of its low-frequency block.
SIDE, LOW = 32, 8


def sampled(head: bytes, tail: bytes, length: int) -> bytes:
    """The bytes that are signed: length, head, and the tail without what the head already holds."""
    rest = max(0, min(SAMPLE, length - SAMPLE))
    return struct.pack("<q", length) + head[:SAMPLE] + (tail[-rest:] if rest else b"")


def signatures(samples: list[bytes]) -> np.ndarray:
    """FNV-1a of every sample, all samples of a batch together: one step per byte position. 0 becomes 1."""
    order = sorted(range(len(samples)), key=lambda k: -len(samples[k]))
    lengths = np.array([len(samples[k]) for k in order], np.int64)
    width = int(lengths[0]) if len(lengths) else 0
    data = np.zeros((width, len(order)), np.uint8)
    for column, k in enumerate(order):
        data[: len(samples[k]), column] = np.frombuffer(samples[k], np.uint8)
    h = np.full(len(order), FNV_START, np.uint64)
    step = np.uint64(FNV_STEP)
    live = np.searchsorted(-lengths, -np.arange(width), side="left")  # samples longer than each position
    for at in range(width):
        n = live[at]
        h[:n] = (h[:n] ^ data[at, :n]) * step
    out = np.empty(len(order), np.uint64)
    out[order] = np.where(h == 0, np.uint64(1), h)
    return out.view(np.int64)


def signature(content: bytes) -> int:
    return int(signatures([sampled(content[:SAMPLE], content[-SAMPLE:], len(content))])[0])


def _cosines() -> np.ndarray:
    """The first LOW rows of the orthogonal-type DCT-II matrix of SIDE points."""
    k, i = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    rows = np.cos((2 * i + 1) * k * np.pi / (2 * SIDE))
    rows[0] /= np.sqrt(2)
    return rows / 2


_DCT = _cosines()
#: Bit x + 8 y of a hash stands for the coefficient at horizontal frequency x and vertical frequency y.
_BITS = (np.uint64(1) << (np.arange(LOW)[:, None] + LOW * np.arange(LOW)[None, :]).astype(np.uint64)).ravel()


def perceptual_hash(pixels: np.ndarray | None) -> int:
    """64-bit hash of an (height, width[, channels]) picture; 0 for none, and for one without any variation."""
    if pixels is None or pixels.size == 0:
        return 0
    height, width = pixels.shape[:2]
    step = max(1, min(height, width) // SIDE)
    small = pixels[::step, ::step]
    rows = np.arange(SIDE) * small.shape[0] // SIDE
    columns = np.arange(SIDE) * small.shape[1] // SIDE
    small = small[rows][:, columns].astype(float)
    if small.ndim == 3:
        small = small[:, :, 0] if small.shape[2] < 3 else small[:, :, :3] @ np.array([0.299, 0.587, 0.114])
    low = _DCT @ small.T @ _DCT.T  # [horizontal, vertical]
    mean = (low.sum() - low[0, 0]) / (LOW * LOW - 1)
    over = low.ravel() > mean
    over[0] = False
    return int(np.bitwise_or.reduce(_BITS[over], initial=np.uint64(0)).astype(np.uint64).view(np.int64))


def decode_png(content: bytes) -> np.ndarray | None:
    """Pixels of a non-interlaced 8-bit PNG (grey, RGB, palette, with or without alpha); None for anything else."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        length, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + length]
        at += 12 + length
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6] != 0:
        return None
    width, height, _, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None:
        return None
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error:
        return None
    if len(raw) < height * (1 + width * channels):
        return None
    lines = raw[: height * (1 + width * channels)].reshape(height, -1)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        out[y] = above = _unfiltered(int(lines[y, 0]), lines[y, 1:].astype(np.int64), above, channels)
    pixels = out.reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if colour == 3 and palette is not None else pixels


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, channels: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) & 255
    if kind == 1:
        return (line.reshape(-1, channels).cumsum(axis=0) & 255).ravel()
    left = np.zeros(len(line) + channels, np.int64)
    up_left = np.concatenate([np.zeros(channels, np.int64), above])
    for x in range(len(line)):
        a, b, c = int(left[x]), int(above[x]), int(up_left[x])
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        left[x + channels] = (line[x] + guess) & 255
    return left[channels:]


#: Brands of ftyp boxes that hold pictures (HEIC and HEIF) and not films.
PICTURE_BRANDS = (b"heic", b"heix", b"heim", b"heis", b"hevc", b"hevx", b"mif1", b"msf1", b"avif")


def capture_millis(head: bytes) -> int | None:
    """Capture date in ms (UTC) by kind of file: EXIF in JPEG, PNG and HEIC, the movie header in MP4 and QuickTime, IDIT in AVI."""
    if head[:2] == b"\xff\xd8":
        return _exif_date(_jpeg_exif(head))
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        at = head.find(b"eXIf")
        return _exif_date(head[at + 4 :] if at >= 0 else None)
    if head[4:8] == b"ftyp" and head[8:12] in PICTURE_BRANDS:
        starts = [at for mark in (b"Exif\x00\x00II*\x00", b"Exif\x00\x00MM\x00*") if (at := head.find(mark)) >= 0]
        return _exif_date(head[min(starts) + 6 :] if starts else None)
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
        return _movie_date(head)
    if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        at = head.find(b"IDIT")
        return _text_date(head[at + 8 : at + 8 + 26].decode("latin-1"), ("%a %b %d %H:%M:%S %Y", "%Y:%m:%d %H:%M:%S", "%Y-%m-%d %H:%M:%S")) if at >= 0 else None
    return None


def _text_date(text: str, patterns: tuple[str, ...]) -> int | None:
    text = " ".join(text.replace("\x00", " ").split())
    for pattern in patterns:
        try:
            return int(datetime.strptime(text, pattern).replace(tzinfo=UTC).timestamp() * 1000)
        except ValueError:
            continue
    return None


def _jpeg_exif(content: bytes) -> bytes | None:
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker, length = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if marker == 0xE1 and content[at + 4 : at + 10] == b"Exif\x00\x00":
            return content[at + 10 : at + 2 + length]
        if marker in (0xDA, 0xD9):
            return None
        at += 2 + length
    return None


#: Tags of the original date, its fraction of a second and its offset from UTC, and of their directory.
DATE, FRACTION, OFFSET, DIRECTORY = 0x9003, 0x9291, 0x9011, 0x8769


def _exif_date(tiff: bytes | None) -> int | None:
    """The original date, with its fraction and its offset where these are given (without one it counts as UTC)."""
    if not tiff or tiff[:2] not in (b"II", b"MM"):
        return None
    order = "<" if tiff[:2] == b"II" else ">"

    def tag(directory: int, wanted: int) -> tuple[int, int, int] | None:
        """(place of the value or of its offset, count, value as a number) of a tag."""
        (n,) = struct.unpack_from(order + "H", tiff, directory)
        for k in range(n):
            at = directory + 2 + 12 * k
            code, _, count, value = struct.unpack_from(order + "HHII", tiff, at)
            if code == wanted:
                return at + 8, count, value
        return None

    def text(directory: int, wanted: int) -> str | None:
        found = tag(directory, wanted)
        if found is None:
            return None
        at = found[0] if found[1] <= 4 else found[2]  # values of four bytes and less stand in their entry
        return tiff[at : at + found[1]].decode("latin-1").replace("\x00", " ").strip()

    try:
        sub = tag(struct.unpack_from(order + "I", tiff, 4)[0], DIRECTORY)
        if sub is None or (date := text(sub[2], DATE)) is None:
            return None
        fraction, offset = text(sub[2], FRACTION), text(sub[2], OFFSET)
    except struct.error:
        return None
    millis = _text_date(date, ("%Y:%m:%d %H:%M:%S",))
    if millis is None:
        return None
    if fraction and fraction.isdecimal():
        millis += int(float(f"0.{fraction}") * 1000)
    if offset and (parts := re.fullmatch(r"([+-])(\d\d):(\d\d)", offset)):
        minutes = int(parts[2]) * 60 + int(parts[3])
        millis -= (minutes if parts[1] == "+" else -minutes) * 60_000
    return millis


#: Seconds from 1904 to 1970, the two epochs.
_EPOCHS = 2_082_844_800


def _movie_date(content: bytes) -> int | None:
    at = content.find(b"mvhd")
    if at < 0 or at + 20 > len(content):
        return None
    seconds = int.from_bytes(content[at + 8 : at + 16], "big") if content[at + 4] == 1 else int.from_bytes(content[at + 8 : at + 12], "big")
    return (seconds - _EPOCHS) * 1000 if seconds else None
