"""Archives: exact round trips, revisits, determinism and damage."""

import hashlib
import io
from pathlib import Path

import pytest

from tallyfield.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, kind string, shard string"


def pages():
    big, other = "<p>größer</p>" * 200, "<html>\r\n\r\nWARC/1.1\r\n" + "z" * 3000
    rows = [(i, f"http://h/{i}", f"page {i} " + "q" * (i * 13 % 2500)) for i in range(120)]
    rows += [(500 + i, "http://copy/", big) for i in range(30)] + [(700, None, other), (650, "u\r\nv", other), (None, "n", other), (None, "n", None)]
    rows += [(800, "e", ""), (801, "e", None), (900, "r", big + "x"), (900, "r", big + "x"), (10**12, "s", "short"), (5, "t", "short")]
    return rows


def expected(rows):
    largest = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            largest[b] = max(largest.get(b, p), p)
    out, seen = [], set()
    for p, _, h in rows:
        b = (h or "").encode()
        stored = len(b) < 1000 or largest.get(b) == p and (p, b) not in seen
        seen.add((p, b))
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if stored else "revisit", None if stored else largest[b]))
    return sorted(map(str, out))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def read(df):
    return sorted(str((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in df.collect())


def test_round_trip(spark):
    assert read(warc.archive_and_read(frame(spark, pages()))) == expected(pages())


def write(spark, df, folder, **more):
    return warc.write_warc(df.selectExpr("page_id as record_id", "url as uri", "cast(html as binary) as payload"), folder.as_uri(), **more)


def files(folder):
    return {p.name: p.read_bytes() for p in folder.glob("*.warc.gz")}


def test_same_files_from_any_layout(spark, tmp_path):
    df = frame(spark, pages())
    write(spark, df.repartition(2), tmp_path / "a", file_bytes=2000)
    write(spark, df.repartition(9), tmp_path / "b", file_bytes=2000)
    a, b = files(tmp_path / "a"), files(tmp_path / "b")
    assert a == b and len(a) > 10
    assert not list((tmp_path / "a").glob(".tmp*"))
    assert read(warc.read_warc(spark, (tmp_path / "a").as_uri())) == expected(pages())


def test_payloads_come_back(spark, tmp_path):
    write(spark, frame(spark, pages()), tmp_path / "a")
    got = warc.read_warc(spark, (tmp_path / "a").as_uri()).where("record_type = 'response'").collect()
    by = {(p, (h or "").encode()) for p, _, h in pages()}
    assert {(r["record_id"], bytes(r["payload"])) for r in got} <= by and len(got) > 120


def test_files_that_no_manifest_names_are_not_read(spark, tmp_path):
    write(spark, frame(spark, pages()), tmp_path / "a")
    (tmp_path / "a" / ".tmp-lost-attempt.warc.gz").write_bytes(b"half a file")
    assert len(read(warc.read_warc(spark, (tmp_path / "a").as_uri()))) == len(pages())


def test_damage_is_noticed():
    data = warc.record(1, "u", b"payload", 7, hashlib.sha1(b"payload").hexdigest())
    assert warc.parse_record(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(data.replace(b"payload\r\n\r\n", b"paxload\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(__import__("gzip").compress(data)[:-9])))


def test_empty(spark):
    assert warc.archive_and_read(frame(spark, [])).count() == 0


def test_no_stray_folder():
    assert not Path("warc").exists()
