from pyspark.sql import functions as F

from strataflow.functions import scalars as S
from strataflow.sources import library


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()[0]


def test_hostile_names_are_safe(spark):
    # Names that must be made safe, and what a name becomes.
    for name in ("../../evil.mp4", "..\\..\\evil.mp4", "/sdcard/evil.mp4", "a/b/c.mp4", "a\x00b.mp4", "   ", "...", "", "my.clip.mov", "x" * 500 + ".mp4"):
        got = one(spark, S.safe_name(F.lit(name)))
        assert got and len(got) <= 96 and not set("/\\\x00") & set(got) and ".." not in got
    assert one(spark, S.display_name(F.lit("IMG_1234.mp4"))) == "IMG_1234_sans_filigrane.mp4"
    assert one(spark, S.safe_name(F.lit("my.clip.mov"))) == "my.clip" and one(spark, S.safe_name(F.lit("..."))) == "video"


def test_versions(spark):
    # Pairs of versions and whether the first is newer.
    for a, b, newer in (("1.4.0", "1.3.0", True), ("1.10.0", "1.9.9", True), ("v2.0.0", "1.99.0", True), ("1.3.1", "1.3.0-debug", True), ("1.3.0", "1.3.0", False), ("1.2.9", "1.3.0", False), ("1.3", "1.3.0", False), ("garbage", "1.0", False)):
        assert one(spark, S.is_newer(F.lit(a), F.lit(b))) is newer
    assert one(spark, S.safe_version(F.lit("../../evil"))) == "update" and one(spark, S.safe_version(F.lit("v1.4.0"))) == "1.4.0" and len(one(spark, S.safe_version(F.lit("9" * 80)))) == 32


def test_urls_digests_and_packages(spark):
    for url, ok in (("https://github.com/a", True), ("https://GitHub.com/a", True), ("http://github.com/a", False), ("https://github.com.evil.org/", False), ("not a url", False)):
        assert one(spark, S.trusted_url(F.lit(url))) is ok
    assert one(spark, S.digest_token(F.lit(" " + "A" * 64 + "  file"))) == "a" * 64 and one(spark, S.digest_token(F.lit("abc"))) is None
    body = F.concat(F.unhex(F.lit("504B")), F.repeat(F.lit("x"), 70_000).cast("binary"))
    assert one(spark, S.archive_ok(body, F.lit(None).cast("string"))) and one(spark, S.archive_ok(body, F.sha2(body, 256))) and not one(spark, S.archive_ok(body, F.lit("0")))


def test_geometry(spark):
    # Rectangles and what becomes of them.
    r = S.rect(F.lit(0.6), F.lit(0.86), F.lit(0.97), F.lit(0.97))
    assert tuple(one(spark, S.crop_excluding(r))) == (0.0, 0.0, 1.0, 0.86)
    moved = one(spark, S.rect_translated(r, F.lit(0.5), F.lit(0.5)))
    assert abs(moved.right - 1) < 1e-12 and abs(moved.bottom - 1) < 1e-12
    zone = S.rect(F.lit(0.30), F.lit(0.50), F.lit(0.70), F.lit(0.75))
    assert tuple(one(spark, S.region_of(zone, F.lit(200), F.lit(120)))) == (32, 32, 136, 86)
    assert one(spark, S.target_bitrate(F.lit(1920), F.lit(1080), F.lit(30.0), F.lit(90_000_000))) == 120_000_000
    assert one(spark, S.duration_text(F.lit(12_345))) == "00:12" and one(spark, S.duration_text(F.lit(6_000_000))) == "100:00"
    centred = one(spark, S.rect_from_center(F.lit(0.5), F.lit(0.5), F.lit(0.2), F.lit(0.001)))
    assert centred.bottom - centred.top >= 0.0199


def test_library_file(spark, tmp_path):
    row = "id bigint, uri string, name string, source string, createdAt bigint, durationMs bigint, width int, height int, size bigint, method string, zones int, thumb string"
    items = spark.createDataFrame([(42, "u", "a.mp4", "s.mp4", 5, 12_345, 1920, 1080, 9_876_543, "BLUR", 2, None), (43, "w", "b.mp4", "s", 6, 1, 1, 1, 1, "LASER", 0, "t")], row)
    library.write_index(items, str(tmp_path / "index"))
    got = {r.id: r for r in library.read_index(spark, str(tmp_path / "index")).collect()}
    assert got[42].thumb is None and got[42].size == 9_876_543 and got[43].method == "INPAINT"
    bad = spark.createDataFrame([("",), ("garbage",), ('{"items":[{"foo":"bar"},{"id":1,"uri":"x"}]}',)], "value string")
    assert [r.id for r in library.decode(bad, "value").collect()] == [1]
    assert [r.id for r in library.recent(items, 1).collect()] == [43]


def test_labels_sizes_and_dates(spark):
    # Sizes with their texts.
    for size, text in ((0, "0 B"), (900, "900 B"), (901, "0.90 kB"), (1_500, "1.5 kB"), (12_345, "12 kB"), (9_876_543, "9.9 MB"), (950_000_000, "0.95 GB")):
        assert one(spark, S.size_text(F.lit(size))) == text
    now = F.lit(1_700_000_000_000)
    for ago, text in ((30_000, "0 minutes ago"), (60_000, "1 minute ago"), (7_200_000, "2 hours ago"), (86_400_000, "1 day ago"), (864_000_000, "2023-11-04")):
        assert one(spark, S.relative_date(now - ago, now)) == text
    assert one(spark, S.relative_date(F.lit(0), now)) == "" and one(spark, S.relative_date(F.lit(None).cast("long"), now)) == ""
    assert one(spark, S.bitrate_label(F.lit(17_600_000))) == "18 Mb/s" and not one(spark, S.uses_shader(F.lit("CROP"))) and one(spark, S.uses_shader(F.lit("INPAINT")))
    assert tuple(one(spark, S.bounded_size(F.lit(4000), F.lit(3), 1280))) == (1280, 1) and tuple(one(spark, S.thumbnail(F.lit(1920), F.lit(1080), F.lit(1000))).size) == (512, 288)


def test_container_metadata(spark):
    text = lambda *xs: [F.lit(x).cast("string") for x in xs]
    w, h, rotation, ms, rate, fps = text("1920", "1080", "-90", "1000", None, "29.97")
    got = one(spark, S.container_info(w, h, rotation, ms, F.lit(500_000), rate, fps))
    assert (got.width, got.height, got.rotation, got.duration_ms, got.bitrate, round(got.frame_rate, 2)) == (1920, 1080, 270, 1000, 4_000_000, 29.97)
    assert one(spark, S.container_info(*text("n/a", "1080", None, None), F.lit(0), *text(None, None))) is None


def test_rename_and_update_records(spark):
    items = spark.createDataFrame([(1, "old.mp4"), (2, "b.mp4")], "id long, name string")
    name = lambda typed: library.rename(items, F.col("id") == 1, F.lit(typed)).where("id = 1").first().name
    assert name("../new:name.mp4") == "newname.mp4" and name("   ") == "old.mp4" and name(None) == "old.mp4"
    from strataflow.operators import selection

    broken = spark.createDataFrame([("{}",), ("x",), (None,), ('{"version":"2.0","apk":"https://github.com/a","page":"p","sha":"short"}',)], "j string").select(selection.decode_update(F.col("j")).alias("u"))
    got = [r.u for r in broken.collect()]
    assert got[:3] == [None] * 3 and got[3].sha is None and got[3].size == 0


def test_numbering_of_whole_lists(spark):
    from strataflow.operators import zones

    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 as k")
    got = sorted((r.pos, r.k) for r in zones.numbered(rows, "k").collect())
    assert got == [(i, i) for i in range(1000)] and zones.numbered(rows.limit(0), "k").count() == 0
