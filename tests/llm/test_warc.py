import gzip
import hashlib
import os

import pytest

from bindscape.llm.warc import decode_record, read_records, round_trip, write_archives
from tests.conftest import SMOKE


def expect(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ref = first.get(h) if len(b) >= 100 and first.get(h) != i else None
        out.append((-1 if i is None else i, len(b), hashlib.sha256(b).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


ROWS = [(1, "u", "x" * 200), (2, None, "x" * 200), (2, None, "x" * 200), (None, "v", "x" * 200), (3, "u\r\nX: y", None),
        (4, "u", "short"), (5, "u", "short"), (1, "u", "x" * 200), (7, "u", "é" * 60), (6, "u", "é" * 60),
        (8, "w", "WARC/1.1\r\n\r\nWARC/1.1\r\n" * 9), (9, "big", "long text \U0001f600 " * 90_000)]


def got(df):
    return sorted(((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect()), key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 1, "k") for r in ROWS], "page_id long, url string, html string, file int, digest string")
    assert got(round_trip(pages, folder=f"file://{tmp_path}/w")) == expect(ROWS)
    assert round_trip(pages.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.read.parquet(f"{SMOKE}/pages.parquet")
    assert got(round_trip(pages)) == expect([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_files_and_selected_records(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(2)
    index = write_archives(pages, folder)
    rows = index.collect()
    for r in rows:
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            fields, block = decode_record(gzip.decompress(f.read(r["length"])))
        assert fields["warc-type"] == r["record_type"] and fields["warc-record-id"] == r["record_id"]
        assert "x" not in fields
        assert fields["x-row-id"] == ("" if r["rec_id"] is None else str(r["rec_id"]))
        assert fields.get("x-refers-to-row-id") == (None if r["refers_to"] is None else str(r["refers_to"]))
        if r["record_type"] == "response":
            assert hashlib.sha256(block).hexdigest() == r["digest"]
    assert {os.path.basename(r["file"]) for r in rows} == {f for f in os.listdir(tmp_path / "w") if f.endswith(".gz")}
    some = read_records(index.where("rec_id in (4, 8, 9)"), folder, max_gap=0, max_read=1).collect()
    assert {r["rec_id"]: r["payload"].decode() for r in some} == {i: h for i, _, h in ROWS if i in (4, 8, 9)}


def test_torn_record():
    with pytest.raises(ValueError):
        decode_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")


def test_half_of_the_rows_under_one_digest(spark, monkeypatch):
    """Blank pages and copies of one page, with the duplicate table joined by a shuffle; reading in several tasks."""
    from bindscape.llm import warc
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(warc, "TASK_BYTES", 2000)
    rows = [(i, f"u{i}", ("", "x" * 500, f"page {i} " * 30, None)[i % 4]) for i in range(400)]
    rows += [(i, f"u{i}", "copy " * 40) for i in range(400, 800)] + [(None, None, ""), (None, "u", "copy " * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"{warc.shared_dir(spark)}/warc-half-{warc.uuid.uuid4().hex}"
    assert got(round_trip(pages, folder=folder)) == expect(rows)
    planned = warc.plan_revisits(pages, "page_id", "url", "html")
    plan = planned._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan
    again = read_records(write_archives(pages, folder + "-2"), folder + "-2")
    assert again.rdd.getNumPartitions() > 4 and again.count() == len(rows)
