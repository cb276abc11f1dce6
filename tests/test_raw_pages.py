"""Raw pages: written, read and written again; blocked ones apart; odd names, sidecars and folders."""

from lawloom.plans.queries import table
from lawloom.sources import raw_pages


def test_pages_round_trip(spark, tmp_path):
    rows = [("a", "https://x.org/a", "2026-01-01", "<p>é\r\n"), ("b/c ?", "https://x.org/b", None, None), (None, None, None, "no name"), ("blocked", "u", None, "Please complete the CAPTCHA")]
    pages = spark.createDataFrame(rows, raw_pages.SCHEMA)
    one, bad = str(tmp_path / "one"), str(tmp_path / "bad")
    assert raw_pages.write_pages(pages, one, bad) == {"written": 3, "rejected": 1}
    read = raw_pages.read_pages(spark, one)
    got = sorted((r.url or "", r.fetched_at or "", r.html) for r in read.collect())
    assert got == [("", "", "no name"), ("https://x.org/a", "2026-01-01", "<p>é\r\n"), ("https://x.org/b", "", "")]
    assert [r.name for r in raw_pages.read_pages(spark, bad).collect()] == ["blocked"]
    # Written again, the same files; of pages that are gone nothing is left.
    two = str(tmp_path / "two")
    assert raw_pages.write_pages(read, two, bad) == {"written": 3, "rejected": 0}
    assert sorted(map(tuple, raw_pages.read_pages(spark, two).collect())) == sorted(map(tuple, read.collect()))
    raw_pages.write_pages(read.where("name = 'a'"), two, bad)
    assert raw_pages.read_pages(spark, two).count() == 1 and raw_pages.read_pages(spark, bad).count() == 0
    (tmp_path / "two" / "a.json").write_text("{broken")
    assert [r.url for r in raw_pages.read_pages(spark, two).collect()] == [None]


def test_all_pages_in_parts_of_a_bounded_size(spark, tmp_path):
    pages = table(spark, "/root/testdata/sf0.001", "pages").selectExpr("concat('p', page_id) AS name", "url", "cast(null AS string) AS fetched_at", "html")
    counts = raw_pages.write_pages(pages, str(tmp_path / "in"), str(tmp_path / "out"))
    read = raw_pages.read_pages(spark, str(tmp_path / "in"), 50_000)
    assert counts["written"] == read.count() == pages.count() and read.rdd.getNumPartitions() > 3
    assert sorted(map(repr, read.collect())) == sorted(map(repr, pages.collect()))
