from datetime import UTC, datetime

import pytest
from fernglass.model import Collision, NoDate, Settings, read_properties, settings_from
from fernglass.operators import layout

ITEM = "path string, last_modified long, exif_millis long, is_duplicate boolean"


def millis(text):
    return int(datetime.strptime(text, "%Y%m%d_%H%M%S").replace(tzinfo=UTC).timestamp() * 1000)


M, X = millis("20200203_112244"), millis("20200203_112255")


def placed(spark, rows, existing=(), **settings):
    taken = spark.createDataFrame([(e,) for e in existing], "dest_path string")
    found = layout.plan(spark.createDataFrame(rows, ITEM), Settings(destination="target", **settings), taken).collect()
    return {r.path: (r.dest_path, r.action) for r in found}


@pytest.mark.parametrize(
    ("row", "settings", "existing", "want"),
    [
        (("dummy.jpg", M, None, False), {}, (), ("target/2020/2020_02/20200203_112244.jpg", "file")),
        (("dummy.jpg", M, None, False), {"no_date": NoDate.STOP}, (), (None, "error")),
        (("dummy.jpg", M, None, False), {"no_date": NoDate.SKIP}, (), (None, "skip")),
        (("a/img_123.JPG", M, None, False), {"no_date": NoDate.FIXED_DIR}, (), ("target/noExif/img_123.JPG", "file")),
        (("d.jpg", M, X, False), {}, (), ("target/2020/2020_02/20200203_112255.jpg", "file")),
        (("d.jpg", M, X, True), {}, (), ("target/duplicates/2020/2020_02/20200203_112255.jpg", "file")),
        (("d.jpg", M, X, False), {}, ("target/2020/2020_02/20200203_112255.jpg",), ("target/2020/2020_02/20200203_112255_001.jpg", "rename")),
        (("d.jpg", M, X, False), {"collision": Collision.STOP}, ("target/2020/2020_02/20200203_112255.jpg",), (None, "error")),
        (("d.jpg", M, X, False), {"collision": Collision.SKIP}, ("target/2020/2020_02/20200203_112255.jpg",), (None, "skip")),
        (
            ("d.jpg", M, X, False),
            {"collision": Collision.OVERWRITE},
            ("target/2020/2020_02/20200203_112255.jpg",),
            ("target/2020/2020_02/20200203_112255.jpg", "overwrite"),
        ),
    ],
)
def test_one_item(spark, row, settings, existing, want):
    assert placed(spark, [row], existing, **settings) == {row[0]: want}


def test_numbers_skip_what_is_taken(spark):
    base = "target/2020/2020_02/20200203_112255"
    rows = [(f"{k}.jpg", M, X, False) for k in range(4)]
    found = placed(spark, rows, (f"{base}.jpg", f"{base}_002.jpg", f"{base}_03.jpg"))
    assert [found[f"{k}.jpg"][0] for k in range(4)] == [f"{base}_{n:03d}.jpg" for n in (1, 3, 4, 5)]


def test_four_digits_after_999(spark):
    found = placed(spark, [(f"{k:04d}.jpg", M, X, False) for k in range(1002)])
    assert found["1001.jpg"][0].endswith("_1001.jpg") and len({d for d, _ in found.values()}) == 1002


def test_a_number_that_is_another_items_name(spark):
    rows = [("a/img.jpg", M, None, False), ("b/img.jpg", M, None, False), ("c/img_001.jpg", M, None, False)]
    found = placed(spark, rows, no_date=NoDate.FIXED_DIR)
    assert sorted(d for d, _ in found.values()) == ["target/noExif/img.jpg", "target/noExif/img_001.jpg", "target/noExif/img_002.jpg"]
    assert found["c/img_001.jpg"] == ("target/noExif/img_001.jpg", "file")


def test_a_number_that_is_another_items_name_and_the_next_one_stands(spark):
    rows = [("a/img.jpg", M, None, False), ("b/img.jpg", M, None, False), ("c/img_001.jpg", M, None, False), ("d/img_001.jpg", M, None, False)]
    found = placed(spark, rows, ("target/noExif/img_002.jpg", "target/noExif/img_001_001.jpg"), no_date=NoDate.FIXED_DIR)
    assert [found[r[0]] for r in rows] == [
        ("target/noExif/img.jpg", "file"), ("target/noExif/img_003.jpg", "rename"), ("target/noExif/img_001.jpg", "file"), ("target/noExif/img_001_002.jpg", "rename"),
    ]


def test_a_name_that_very_many_want(spark):
    base = "target/2020/2020_02/20200203_112255"
    rows = [(f"{k:05d}.jpg", M, X, k % 2 == 0) for k in range(3000)] + [("other.jpg", M, M, False)]
    taken = [f"{base}.jpg", *[f"{base}_{n:03d}.jpg" for n in (1, 2, 700, 701, 1400, 9000)]]
    found = placed(spark, rows, taken)
    free = (n for n in range(10000) if n not in (0, 1, 2, 700, 701, 1400, 9000))
    assert [found[f"{k:05d}.jpg"][0] for k in range(1, 3000, 2)] == [f"{base}_{next(free):03d}.jpg" for _ in range(1500)]
    assert len({d for d, _ in found.values()}) == 3001


def test_dates_are_utc_in_every_session(spark):
    from fernglass.functions.columns import dated
    from pyspark.sql import functions as F

    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/New_York")
    spring = millis("20210314_023000")  # an hour that New York skips
    rows = other.createDataFrame([(0,), (spring,), (None,)], "m long").select(dated(F.col("m"), "yyyy\\MM yyyyMMdd_HHmmss").alias("t")).collect()
    assert [r.t for r in rows] == ["1970\\01 19700101_000000", "2021\\03 20210314_023000", None]


def test_settings():
    text = "# note\ndir.source = C:\\\\in\nformat.dir=yyyy\\\\MM\nrun.mode.drymode = TRUE \nrun.mode.filemove=yes\nrun.parser.count=x\npolicy.noexif= skip\npolicy.duplicate=what\n"
    found = settings_from(read_properties(text))
    assert (found.source, found.dir_format, found.dry_run, found.move_files, found.workers) == ("C:\\in", "yyyy\\MM", True, False, 0)
    assert found.no_date is NoDate.SKIP and found.collision is Collision.INCREASE
    with pytest.raises(ValueError, match="letters"):
        Settings(file_format="yyyyQQ")
