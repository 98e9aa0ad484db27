import hashlib

import zstandard
from pyspark.sql import functions as F

from slotvalue.llm import warc

SCHEMA = "page_id long, url string, html string, refers_to long, digest string"


def test_odd_pages_round_trip(spark, tmp_path):
    body, big = "<p>ü</p>" * 30, "<html>" + "long text " * 200_000
    rows = [(5, "http://a/", body), (3, "http://b/x y\r\nEvil: 1", body), (9, None, body), (None, "http://c/", body), (3, "u", body),
            (1, "u", "short"), (2, "u", "short"), (4, "u", ""), (6, "u", None), (7, "u", big), (8, "u", big), (10, "", "\r\n\r\n" * 40)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = warc.archive_pages(pages, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [i for i, _, h in rows if h == html and i is not None]
        again = len(raw) >= 100 and page_id != min(same)
        want.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response",
                     min(same) if again else None))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    texts = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert all(bytes(r.payload) == texts[r.payload_digest] for r in got if r.payload is not None)


def test_archives_are_plain_zstandard(spark, tmp_path):
    """A decoder with the embedded dictionary reads every record; frames are
    one per record, and the dictionary leads each archive."""
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.concat(
        F.lit("<html><body class='main'>"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8), F.lit("</body>")).alias("html"))
    path = tmp_path / "w"
    warc.write_archives(pages.coalesce(1), str(path))
    files = sorted(path.glob("part-*"))
    assert len(files) == 3  # RECORDS each
    records = 0
    for f in files:
        data = f.read_bytes()
        size = int.from_bytes(data[4:8], "little")
        assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC and size > 1000
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
        raw = reader.stream_reader(data, read_across_frames=True).read()
        records += raw.count(b"WARC/1.1\r\n")
        assert len(data) < len(raw)
    assert records == 5000
    assert warc.read_archives(spark, str(path)).select("page_id").distinct().count() == 5000


def test_large_pages_close_an_archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 10_000)
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"),
                                   F.concat(F.repeat(F.lit("ab c"), 1000), "id").alias("html")).coalesce(1)
    got = warc.archive_pages(pages, str(tmp_path / "w"))
    assert got.select("page_id").distinct().count() == got.count() == 40
    assert len(list((tmp_path / "w").glob("part-*"))) == 14


def test_every_archive_has_a_dictionary(spark, tmp_path):
    """Small tasks too: 64 partitions, some of a single short record."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").repartition(60).union(
        spark.createDataFrame([(10 ** 6 + i, "u", None if i % 2 else "x") for i in range(4)], "page_id long, url string, html string")
        .repartition(4))
    path = tmp_path / "w"
    got = warc.archive_pages(pages, str(path))
    assert got.count() == pages.count()
    files = [f.read_bytes() for f in path.glob("part-*")]
    assert len(files) >= 60
    for data in files:
        size = int.from_bytes(data[4:8], "little")
        assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC and size >= 32
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
        assert reader.stream_reader(data, read_across_frames=True).read().startswith(b"WARC/1.1")
    texts = {r.page_id: r.html or "" for r in pages.select("page_id", "html").collect()}
    assert all(bytes(r.payload).decode() == texts[r.page_id] for r in got.collect() if r.payload is not None)


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], SCHEMA)
    assert warc.archive_pages(pages, str(tmp_path / "w")).count() == 0
