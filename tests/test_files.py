import os
import struct
import zlib

import numpy as np
import pytest
from fernglass import app
from fernglass.functions import content
from fernglass.model import ITEM, Settings
from fernglass.operators import fpcache
from fernglass.operators.apply import apply, file_one
from fernglass.sources.extract import extract
from fernglass.sources.listing import scan
from fernglass.streaming.incremental import fingerprints, landing


def png(pixels):
    height, width = pixels.shape[:2]
    raw = b"".join(b"\x00" + pixels[y].astype(np.uint8).tobytes() for y in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def gradient(seed, size=64):
    y, x = np.mgrid[:size, :size]
    v = (4 * x + 2 * y + 30 * seed) & 255
    return np.stack([v, v // 2, (3 * y) & 255], axis=2)


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def test_signature_is_fnv_of_length_head_and_tail():
    def plain(data):
        h = content.FNV_START
        for byte in struct.pack("<q", len(data)) + data[: 1 << 16] + data[max(1 << 16, len(data) - (1 << 16)) :]:
            h = ((h ^ byte) * content.FNV_STEP) & ((1 << 64) - 1)
        h = h or 1
        return h - (1 << 64) if h >> 63 else h

    edges = [0, 1, 1 << 16, (1 << 16) + 1, 1 << 17, (1 << 17) + 1]
    for n in edges:
        data = bytes(k * 7 % 251 for k in range(n))
        assert content.signature(data) == plain(data), n
    middle = bytearray(512 * 1024)
    whole = content.signature(bytes(middle))
    middle[256 * 1024] = 1
    assert content.signature(bytes(middle)) == whole


def test_perceptual_hash():
    one = content.perceptual_hash(gradient(1))
    touched = gradient(1).copy()
    touched[:3, :3] = 255
    assert one != 0 and one == content.perceptual_hash(content.decode_png(png(gradient(1))))
    assert distance(one, content.perceptual_hash(gradient(40))) > 5
    assert distance(one, content.perceptual_hash(touched)) <= 5
    assert content.perceptual_hash(np.zeros((64, 64, 3))) == 0 == content.perceptual_hash(content.decode_png(b"\x01\x02\x03\x04"))


def exif_jpeg(date):
    value = date.encode() + b"\x00"
    tiff = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<HHHII", 1, 0x8769, 4, 1, 26) + struct.pack("<I", 0)
    tiff += struct.pack("<HHHII", 1, 0x9003, 2, len(value), 44) + struct.pack("<I", 0)
    body = b"Exif\x00\x00" + tiff.ljust(44, b"\x00") + value
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def test_capture_dates():
    assert content.capture_millis(exif_jpeg("2020:02:03 11:22:55")) == 1580728975000
    movie = b"\x00\x00\x00\x10ftypmp42" + b"\x00" * 4 + b"\x00\x00\x00\x6cmvhd" + struct.pack(">III", 0, 2082844800 + 1000, 0) + b"\x00" * 8
    assert content.capture_millis(movie) == 1_000_000
    assert content.capture_millis(b"RIFF\x00\x00\x00\x00AVI IDIT\x1a\x00\x00\x00Mon Feb 03 11:22:55 2020\n\x00") == 1580728975000
    assert content.capture_millis(b"nothing") is None


def test_dates_of_heic_with_fraction_and_offset():
    def entry(tag, value, at):
        return struct.pack("<HHI", tag, 2, len(value)) + (value.ljust(4, b"\x00") if len(value) <= 4 else struct.pack("<I", at))

    date, fraction, offset = b"2020:02:03 11:22:55\x00", b"25\x00", b"+02:00\x00"
    tiff = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<HHHII", 1, 0x8769, 4, 1, 26) + struct.pack("<I", 0)
    tiff += struct.pack("<H", 3) + entry(0x9003, date, 100) + entry(0x9011, offset, 130) + entry(0x9291, fraction, 0) + struct.pack("<I", 0)
    tiff = tiff.ljust(100, b"\x00") + date.ljust(30, b"\x00") + offset
    heic = b"\x00\x00\x00\x18ftypheic" + b"\x00" * 40 + b"\x00\x00\x00\x06Exif\x00\x00" + tiff
    assert content.capture_millis(heic) == 1580728975000 + 250 - 2 * 3_600_000
    assert content.capture_millis(b"\x00\x00\x00\x18ftypheic" + b"\x00" * 40) is None


def test_no_file_is_lost_or_taken_for_another(spark, tmp_path):
    def write(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    source, dest = write("a", b"AAAA"), write("b", b"BBBB")
    assert "exists" in file_one(source, dest, False, False) and open(dest, "rb").read() == b"BBBB"
    assert "exists" in file_one(source, dest, True, False) and os.path.exists(source)
    fresh = str(tmp_path / "sub" / "c")
    assert file_one(source, fresh, False, False) is None and file_one(source, fresh, False, False) is None  # a task that runs again
    assert file_one(source, str(tmp_path / "moved"), True, False) is None and not os.path.exists(source)
    modified = os.stat(tmp_path / "moved").st_mtime_ns // 1_000_000
    assert file_one(source, str(tmp_path / "moved"), True, False, 4, modified) is None
    assert "gone" in file_one(source, str(tmp_path / "moved"), True, False, 5, modified)
    assert "gone" in file_one(source, dest, False, False, 4, modified)
    assert sorted(os.listdir(tmp_path)) == ["b", "moved", "sub"]


def test_the_last_of_a_target_stays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = []
    for k in range(40):
        (tmp_path / "in" / f"{k:02d}").write_bytes(b"%d" % k)
        rows.append((str(tmp_path / "in" / f"{k:02d}"), str(tmp_path / "out" / f"{k % 3}"), "file" if k < 3 else "overwrite", 1, 1, False))
    rows += [(str(tmp_path / "in" / "00"), None, "skip", 1, 1, False)]
    frame = spark.createDataFrame(rows[::-1], "path string, dest_path string, action string, file_size long, last_modified long, is_duplicate boolean").repartition(7)
    done = apply(frame, Settings(dry_run=False), allow_overwrite=True).collect()
    assert sum(r.done for r in done) == 40 and [r.error for r in done if not r.done] == ["not placed"]
    assert [(tmp_path / "out" / f"{k}").read_bytes() for k in range(3)] == [b"39", b"37", b"38"]


def jpeg(spark, path, seed, kind="jpg"):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(64, 64, 1)
    for y, line in enumerate(gradient(seed)):
        for x, (r, g, b) in enumerate(line.tolist()):
            image.setRGB(x, y, r << 16 | g << 8 | b)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


@pytest.mark.parametrize("listed", [0, 10_000])
def test_pictures_whatever_their_names_hold(spark, tmp_path, monkeypatch, listed):
    from fernglass.sources import extract as module

    monkeypatch.setattr(module, "LISTED", listed)
    names = ["a b.jpg", "a+b.jpg", "a%20b.jpg", "c.Jpg", "d[1]{x}*.jpeg", "e.PNG", "é ü.JPG", "f.heic"]
    for seed, name in enumerate(names[:-1]):
        jpeg(spark, tmp_path / name, 1 if seed < 2 else 20 * seed, "png" if name.endswith("PNG") else "jpg")
    (tmp_path / "f.heic").write_bytes(b"no picture")
    items = extract(scan(spark, str(tmp_path)), decode=False)
    found = module.add_picture_hashes(items, str(tmp_path)).collect()
    assert sorted(os.path.basename(r.path) for r in found) == sorted(names)
    hashes = {os.path.basename(r.path): r.perceptual_hash for r in found}
    assert hashes.pop("f.heic") is None and all(hashes.values()) and hashes["a b.jpg"] == hashes["a+b.jpg"]
    assert hashes["e.PNG"] == content.perceptual_hash(gradient(100)) and len(set(hashes.values())) == len(hashes) - 1


def test_nothing_is_decoded_again(spark, tmp_path, monkeypatch):
    from fernglass.sources import extract as module

    jpeg(spark, tmp_path / "a.jpg", 3)
    items = extract(scan(spark, str(tmp_path)), decode=False)
    whole = spark.createDataFrame(module.add_picture_hashes(items, str(tmp_path)).collect(), items.schema)
    monkeypatch.setattr(module, "_pictures", lambda *_: pytest.fail("read again"))
    assert module.add_picture_hashes(whole, str(tmp_path)).first().perceptual_hash


def test_queries_of_contents_against_the_plain_functions(spark):
    from fernglass import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.signature for r in queries.content_signatures(spark, sf).collect()} == {i: content.signature(t) for i, t in texts.items()}
    vectors = {r.vec_id: np.array(r.embedding).reshape(-1, 8) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert {r.vec_id: r.perceptual_hash for r in queries.picture_hashes(spark, sf).collect()} == {i: content.perceptual_hash(v) for i, v in vectors.items()}


def test_scan_rules(spark, tmp_path):
    for name in ("photo.jpg", "old.JPG", "ignored.txt", "README", ".gitignore", ".jpg", ".a.jpg", "_a.jpg", "a.tar.jpg", "x.", "deep/er/still/video.mp4"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    os.symlink(tmp_path / "deep", tmp_path / "link")
    os.symlink(tmp_path / "photo.jpg", tmp_path / "link.jpg")
    os.utime(tmp_path / "old.JPG", (1, 1))
    found = {os.path.basename(r.path): r for r in scan(spark, str(tmp_path)).collect()}
    assert set(found) == {"photo.jpg", "old.JPG", ".a.jpg", "_a.jpg", "a.tar.jpg", "video.mp4"}
    assert found["old.JPG"].last_modified > 1_000_000_000_000
    with pytest.raises(FileNotFoundError):
        scan(spark, str(tmp_path / "none"))


def test_extraction_absorbs_failures(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(gradient(1)))
    rows = [(str(tmp_path / "a.png"), 1, 1), (str(tmp_path / "gone.png"), 1, 1), (str(tmp_path / "v.mp4"), 1, 1)]
    (tmp_path / "v.mp4").write_bytes(b"film")
    found = {os.path.basename(r.path): r for r in extract(spark.createDataFrame(rows, "path string, file_size long, last_modified long")).collect()}
    assert found["a.png"].perceptual_hash and found["a.png"].content_signature
    assert found["gone.png"].content_signature is None and found["v.mp4"].content_signature is None


def test_whole_run(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    target.mkdir()
    (source / "a.png").write_bytes(png(gradient(1)))
    (source / "copy.png").write_bytes(png(gradient(1)))
    (source / "other.png").write_bytes(png(gradient(40)))
    settings = Settings(source=str(source), destination=str(target), cache_file=str(tmp_path / "cache"), dry_run=False)
    counts = app.run(spark, settings)
    assert (counts["scanned"], counts["cache_hits"], counts["duplicates"], counts["filed"], counts["failed"]) == (3, 0, 1, 3, 0)
    files = [os.path.relpath(os.path.join(at, n), target) for at, _, names in os.walk(target) for n in names]
    assert len(files) == 3 and sum(f.startswith("duplicates/") for f in files) == 1
    (source / "other.png").unlink()
    again = app.run(spark, Settings(source=str(source), destination=str(target), cache_file=str(tmp_path / "cache")))
    assert (again["scanned"], again["cache_hits"], again["filed"]) == (2, 2, 2)
    assert fpcache.load(spark, str(tmp_path / "cache")).count() == 2
    assert "cache hits" in app.report(again)


def test_cache_rules(spark, tmp_path):
    entry = ("/photos/a.jpg", 1000, 5555, 1234000, 0xABCD, 0xF00D)
    cache = spark.createDataFrame([entry, ("/photos2/b.jpg", 1, 1, None, None, None), ("/photos/gone.jpg", 1, 1, None, None, None)], fpcache.SCHEMA)
    scanned = spark.createDataFrame([("/photos/a.jpg", 1000, 5555), ("/photos/a.jpg", 2000, 5555), ("/photos/a.jpg", 1000, 9999)], "path string, file_size long, last_modified long")
    assert sorted(r.hit for r in fpcache.probe(scanned, cache).collect()) == [False, False, True]
    assert {r.path for r in fpcache.prune(cache, scanned, "/photos").collect()} == {"/photos/a.jpg", "/photos2/b.jpg"}
    (tmp_path / "c.tsv").write_text("1\t2\t3\t-1\t0\t/a\tb.jpg\nbad\n1\tx\t3\t4\t5\t/c\n7\t2\t3\t9\t8\t/a\tb.jpg\n")
    (row,) = fpcache.load_tsv(spark, str(tmp_path / "c.tsv")).collect()
    assert (row.path, row.perceptual_hash, row.exif_millis, row.content_signature) == ("/a\tb.jpg", 7, 9, 8)


def test_stream_keeps_the_cache_up(spark, tmp_path):
    scanned = "path string, file_size long, last_modified long"
    done = lambda rows: rows.selectExpr("*", "cast(null as long) exif_millis", "file_size perceptual_hash", "1L content_signature")
    for rows in ([("/a", 1, 1), ("/b", 2, 1)], [("/b", 2, 1), ("/c", 3, 1)], [("/a", 9, 2)]):
        spark.createDataFrame(rows, scanned).write.mode("append").parquet(str(tmp_path / "landing"))
        fingerprints(landing(spark, str(tmp_path / "landing")), str(tmp_path / "cache"), str(tmp_path / "cp"), done).awaitTermination()
    assert {(r.path, r.perceptual_hash) for r in fpcache.load(spark, str(tmp_path / "cache")).collect()} == {("/a", 9), ("/b", 2), ("/c", 3)}
    assert spark.createDataFrame([], ITEM).count() == 0
