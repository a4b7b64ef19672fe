import gzip
import hashlib
import os
import random

import pytest

from pulsewatch.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def site(n=60, seed=1):
    pick = random.Random(seed)
    bodies = ["<p>" + pick.choice("abcdé") * pick.randint(90, 300) + "</p>" for _ in range(9)]
    rows = []
    for i in range(n):
        body = pick.choice(bodies) if i % 3 else f"<p>page {i} ü</p>" * pick.randint(0, 20)
        rows.append((i, f"http://{pick.choice(['a', 'b.a', 'WWW'])}.example.com/{pick.randint(0, 8)}?q={i % 4}", body))
    return rows


AWKWARD = [
    (900, None, None), (901, "http://x.org", ""), (None, "http://x.org", "n" * 200), (902, "no url at all", "n" * 200),
    (903, "http://x.org/\r\nInjected: yes é", "short"), (904, "http://x.org", "short"), (905, "http://x.org", "long é" * 60_000),
    (906, "http://hot.org/", "same" * 100), (906, "http://hot.org/", "same" * 100), (907, "http://hot.org/", "same" * 100),
]


def expected(rows):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100:
            known = first.get(body, page)
            first[body] = page if known is None else known if page is None else min(known, page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        original = first.get(body, page)
        kind = "response" if original == page else "revisit"
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), kind, None if kind == "response" else original))
    return sorted(out, key=repr)


def told(records):
    return sorted((tuple(r) for r in records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def archived(spark, rows, folder, **sizes):
    file_bytes = sizes.pop("file_bytes", warc.FILE_BYTES)
    captures = warc.write_archive(pages(spark, rows), f"{folder}/archive", file_bytes=file_bytes)
    return captures, warc.build_index(captures, f"{folder}/index", **sizes)


@pytest.mark.parametrize("sizes", [{}, {"file_bytes": 2000, "block_lines": 3, "shard_lines": 10}])
def test_round_trip_through_the_index(spark, tmp_path, sizes):
    rows = site() + AWKWARD
    _, shards = archived(spark, rows, str(tmp_path), **sizes)
    found = warc.lookup(warc.url_keys(pages(spark, rows)), f"{tmp_path}/index", shards)
    records = warc.read_records(found, f"{tmp_path}/archive")
    assert told(records) == expected(rows)
    got = {(r["page_id"], r["payload"].decode()) for r in records.collect() if r["record_type"] == "response"}
    assert got <= {(i, h or "") for i, _, h in rows}


def test_salted_payloads(spark, tmp_path, monkeypatch):
    rows = site(80, 3) + [(1000 + i, "http://hot.org/", "copy" * 50) for i in range(40)]
    monkeypatch.setattr(warc, "fits_broadcast", lambda _: False)
    monkeypatch.setattr(warc, "HOT_PAGES", 5)
    captures, _ = archived(spark, rows, str(tmp_path))
    assert told(warc.read_records(captures, f"{tmp_path}/archive")) == expected(rows)


def test_lookup_of_some_keys(spark, tmp_path):
    rows = site(200, 4) + [(1000 + i, "http://hot.org/", f"page {i}") for i in range(90)]
    captures, shards = archived(spark, rows, str(tmp_path), block_lines=7, shard_lines=40)
    keys = ["org,hot)/", "com,example,b,a)/3?q=1", "com,example,a)/0?q=0", "absent", "", "zz"]
    asked = spark.createDataFrame([(k, 1) for k in keys + keys], "key string, n long")
    columns = ["key", "file", "offset", "length", "url", "digest", "type"]
    got = sorted(tuple(r) for r in warc.lookup(asked, f"{tmp_path}/index", shards).select(*columns).collect())
    assert got == sorted(tuple(r) for r in captures.select(*columns).collect() if r["key"] in keys)
    assert sum(r[0] == "org,hot)/" for r in got) == 90


def test_files_are_plain_warc(spark, tmp_path):
    archived(spark, site(20) + AWKWARD[:6], str(tmp_path))
    count = 0
    for name in os.listdir(f"{tmp_path}/archive"):
        data = gzip.open(f"{tmp_path}/archive/{name}").read()
        while data:
            version, head, rest = warc.fields(data)
            assert version == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type"} <= set(head)
            assert "Injected" not in head
            size = int(head["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data, count = rest[size + 4 :], count + (head["WARC-Type"] != "warcinfo")
    assert count == 26


def test_damage_is_noticed():
    body = b"x" * 200
    digest = hashlib.sha256(body).hexdigest()
    raw = warc.record(1, "http://a.org/", body, digest)
    assert warc.parsed(raw)[1:] == (body, 200)
    with pytest.raises(ValueError):
        warc.parsed(raw.replace(b"xx", b"xy", 1))
    with pytest.raises(ValueError):
        warc.unpacked(warc.member(raw) + b"more")


@pytest.mark.parametrize(
    "url, key",
    [
        ("HTTP://user@WWW.Example.com:80/A?b=C#d", "com,example,www)/A?b=C"),
        ("https://example.com:8080", "com,example:8080)/"),
        ("http://127.0.0.1/x y", "127.0.0.1)/x%20y"),
        ("http://münchen.de/", "de,m%C3%BCnchen)/"),
        ("mailto:a@b.c", "mailto:a@b.c"),
        ("no url", "no%20url"),
        ("", ""),
        (None, ""),
    ],
)
def test_keys(url, key):
    assert warc.url_key(url) == key


def test_empty_table(spark, tmp_path):
    _, shards = archived(spark, [], str(tmp_path))
    assert spark.read.parquet(shards).collect() == []
    assert warc.lookup(warc.url_keys(pages(spark, site(3))), f"{tmp_path}/index", shards).collect() == []
