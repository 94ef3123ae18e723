import hashlib

import pytest
from strandline.llm import warc
from strandline.llm.common import scratch

NASTY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "é" * 700


def plain(pages):
    rows = [(i, (h or "").encode()) for i, _, h in pages]
    out = []
    for i, b in rows:
        same = [j for j, c in rows if c == b]
        first = max(same)
        revisit = len(b) >= 1000 and i != first
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [warc.BROADCAST_BYTES, -1])
def test_round_trip_against_plain_code(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast)
    big = "x" * 1000
    pages = [(1, "http://a/", big), (9, "http://b/\r\nX: y", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "n", NASTY), (2, "n", NASTY), (10, "z", "\r\n\r\n" + "q" * 2000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(df)
    assert sorted(tuple(r)[:5] for r in got.collect()) == plain(pages)
    assert got.where("not digest_ok").count() == 0


def test_assembly_joins_all_three_records(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(20)], "page_id long, url string, html string")
    path = scratch(spark, "test")
    warc.write_records(warc.page_records(pages), path, 7)
    records = warc.read_archives(spark, path)
    assert records.groupBy("warc_type").count().count() == 3 and records.count() == 60
    rows = warc.assemble(records).collect()
    assert len(rows) == 20
    for r in rows:
        assert len(r["requests"]) == len(r["metadata"]) == 1
        page = r["metadata"][0]["fields"][0]["value"]
        assert bytes(r["response"]["payload"]).decode() == f"<p>{page}</p>" and r["target_uri"].endswith(f"/{page}")
        assert r["requests"][0]["http_line"].startswith("GET ")
    alone = warc.assemble(records.where("warc_type = 'response'")).first()
    assert alone["requests"] == [] and alone["metadata"] == []


@pytest.mark.parametrize("rows", [[], [(None, None, None, "x")], [(1, "u", "a" * 1200, "x"), (1, "u", "a" * 1200, "y")], [(None, "u", "a" * 1200, "x"), (4, "u", "a" * 1200, "x")]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    out = warc.round_trip(df).collect()
    assert len(out) == len(rows)
    assert all(r["refers_to"] == 4 for r in out if r["record_type"] == "revisit")


def test_revisits_name_a_record_of_the_archive(spark):
    rows = [(i, f"http://h/{i}", "y" * 1500 if i % 3 else f"own {i} " * 300) for i in range(40)] + [(100, "http://h/a", "z" * 2000), (100, "http://h/b", "z" * 2000), (7, "http://h/c", "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    path = scratch(spark, "test")
    warc.write_archives(pages, path)
    records = {r["record_id"]: r for r in warc.read_archives(spark, path, with_payload=False).collect()}
    assert len(records) == 3 * len(rows)
    again = [r for r in records.values() if r["warc_type"] == "revisit"]
    assert len(again) == 25 + 1
    for r in again:
        if r["refers_to"] is not None:
            first = records[r["refers_to"]]
            assert first["warc_type"] == "response" and first["payload_digest"] == r["payload_digest"] and first["target_uri"] == r["refers_to_uri"]
    assert sum(r["refers_to"] is None for r in again) == 1  # two responses share the page_id that it revisits
    out = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect() if r["record_type"] == "revisit")
    assert out == sorted([(i, "revisit", 38) for i in range(38) if i % 3] + [(7, "revisit", 100)])


def test_archives_are_bounded_by_bytes(spark):
    import gzip
    from pathlib import Path

    sizes = [10] * 30 + [300] * 9 + [5000] * 3 + [0]
    pages = spark.createDataFrame([(i, "u", "".join(chr(97 + (i * 7 + j) % 26) for j in range(n))) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    path = scratch(spark, "test")
    warc.write_archives(pages, path, page_bytes=(100, 1000), archive_bytes=1000)
    held = []
    for f in Path(path).rglob("*.gz"):
        rows = list(warc.parse(gzip.open(f), True))
        held.append([len(r["payload"]) for r in rows if r["warc_type"] == "response"])
    assert sorted(n for h in held for n in h) == sorted(sizes)
    assert all(sum(h) <= 1000 or len(h) == 1 for h in held) and max(map(len, held)) > 1
    assert sorted(r["payload_bytes"] for r in warc.assemble(warc.read_archives(spark, path)).select("response.payload_bytes").collect()) == sorted(sizes)
