import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from arrears.llm import q03, warc


def rows():
    pages = [(i, f"http://x/{i}", f"<html>é page {i % 7}" + "y" * (i * 900), "c") for i in range(20)]
    pages += [(100 + i, None if i == 2 else "http://same/\r\nx", "<p>same</p>", "c") for i in range(9)] + [(200, "u", None, "c"), (201, "u", "", "c"), (300, "u", "z" * 300_000, "c")]
    return pages + [(100, "http://again", "<p>same</p>", "c"), (103, "u", "<p>same</p>", "c"), (None, "u", "<p>same</p>", "c"), (None, "u", "alone", "c"), (103, "u", "other payload", "c")]


def brute(pages):
    low = {}
    for i, _, h, _ in pages:
        if i is not None:
            low[h or ""] = min(low.get(h or "", i), i)
    out = []
    for i, _, h, _ in pages:
        b = (h or "").encode()
        again = (h or "") in low and low[h or ""] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", low[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string, offset string")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, q03.op3_warc(spark, str(tmp_path)).collect()), key=str) == brute(rows())


def test_selected_records_and_standard_gzip(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string, offset string").coalesce(1)
    warc.write(pages, folder, file_bytes=5000, revisit_bytes=12).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert index.select("file").distinct().count() > 1
    got = warc.read(index, folder, (F.col("page_id") % 3 == 0) & (F.col("page_id") < 100), gap=2000).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in got} == {(i, h) for i, _, h, _ in rows() if i is not None and i < 100 and i % 3 == 0}
    assert index.where("record_type = 'revisit'").count() == 0  # those payloads are shorter
    files = list((tmp_path / "a").iterdir())
    assert all(f.name.endswith(".warc.gz") for f in files)
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == len(rows())


def test_ranges_coalesce():
    got = list(warc.ranges([("a", 0, 10), ("a", 10, 5), ("a", 30, 5), ("a", 100, 5), ("b", 105, 5)], 20, 1000))
    assert got == [("a", 0, 35, [(0, 10), (10, 5), (30, 5)]), ("a", 100, 5, [(100, 5)]), ("b", 105, 5, [(105, 5)])]


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert q03.op3_warc(spark, str(tmp_path)).count() == 0
