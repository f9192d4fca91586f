"""Archives: exact round trips, equal bytes, rolling, revisits and damage."""

import base64
import bisect
import gzip
import hashlib
import os

import pytest
from conftest_llm import sorted_rows

from clipquest.llm.warc import ArchiveFormat, _shard_of, read_archives, write_archives

BIG = "päge <b>é</b>\r\n\r\nWARC/1.1\r\n" * 400
PAGES = ([(i, f"http://h/{i}", f"<html>{i} {BIG[:i * 37]}</html>") for i in range(40)]
         + [(i, "http://common/", "same") for i in range(100, 130)]
         + [(50, None, None), (51, "u", ""), (60, "a b\r\nc", BIG), (60, "second", "other"), (60, "third", "same"),
            (None, "x", "same"), (None, "y", "only without an id"), (None, "z", "only without an id"),
            (61, "r", "twice"), (61, "r", "twice"), (10**15, "far", "same"), (-7, "low", "last one")])


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(p, u, h, "clash", "clash") for p, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, shard string, first string"
                                 ).repartition(5)


def expected(rows, least=0):
    firsts = {}
    for page, _, html in rows:
        if page is not None:
            firsts[html or ""] = min(firsts.get(html or "", page), page)
    out = []
    for page, url, html in rows:
        body = (html or "").encode()
        first = firsts.get(html or "") if len(body) >= least else None
        revisit = first is not None and page != first
        out.append((page, base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body),
                    "revisit" if revisit else "response", first if revisit else None,
                    None if revisit else body))
    return sorted(out, key=str)


def read(spark, target):
    found = read_archives(spark, target).select("page_id", "payload_digest", "payload_bytes", "record_type",
                                                "refers_to", "payload")
    return sorted([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found.collect()],
                  key=str)


@pytest.mark.parametrize("settings", [{}, {"shard_bytes": 4000, "file_bytes": 900}, {"revisit_bytes": 5}])
def test_round_trip(spark, pages, tmp_path, settings):
    config = ArchiveFormat(**settings)
    manifest = write_archives(pages, str(tmp_path / "a"), config)
    assert read(spark, str(tmp_path / "a")) == expected(PAGES, config.revisit_bytes)
    rows = manifest.collect()
    assert sum(r.records for r in rows) == len(PAGES)
    for r in rows:
        data = (tmp_path / "a" / "archives" / r.name).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    if "file_bytes" in settings:
        assert max(r.shard for r in rows) > 1 and max(r.number for r in rows) > 0
    assert not [f for f in os.listdir(tmp_path / "a" / "pending") if not f.startswith(".")]


def test_same_bytes_however_rows_are_dealt(spark, pages, tmp_path):
    config = ArchiveFormat(shard_bytes=4000, file_bytes=900)
    one = write_archives(pages, str(tmp_path / "one"), config)
    two = write_archives(pages.repartition(1).orderBy("url"), str(tmp_path / "two"), config)
    assert sorted_rows(one) == sorted_rows(two)


def test_more_shards_than_a_few(spark, tmp_path):
    far = 2**60  # Neighbours that doubles cannot tell apart.
    rows = [(far + i, f"u{i}", f"{i % 90} " * 20) for i in range(100)] + [(None, "n", "0 " * 20), (None, "n", "only")]
    given = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = write_archives(given, str(tmp_path / "m"), ArchiveFormat(shard_bytes=600)).collect()
    assert read(spark, str(tmp_path / "m")) == expected(rows)
    assert [(r.shard, r.records) for r in sorted(found)] == [(i, 1) for i in range(99)] + [(99, 3)]


@pytest.mark.parametrize("count", [0, 1, 2, 64, 65, 4096, 70_000])
def test_shard_of_an_id(spark, count):
    edges = [2**61 + 3 * i for i in range(count)]
    ids = sorted({2**61 + d for d in (-2**62, -1, 0, 1, 2, 3, 190, 192, 3 * count - 4, 3 * count - 3, 3 * count)})
    found = spark.createDataFrame([(i,) for i in ids], "page_id long").select("page_id", _shard_of(edges).alias("n"))
    assert {r.page_id: r.n for r in found.collect()} == {i: bisect.bisect_right(edges, i) for i in ids}


def test_urls_stay_in_their_line(spark, pages, tmp_path):
    write_archives(pages, str(tmp_path / "u"))
    urls = {r.url for r in read_archives(spark, str(tmp_path / "u")).filter("page_id = 60").collect()}
    assert urls == {"a%20b%0D%0Ac", "second", "third"}


def test_nothing_to_write(spark, pages, tmp_path):
    assert write_archives(pages.filter("false"), str(tmp_path / "none")).count() == 0
    assert read_archives(spark, str(tmp_path / "none")).count() == 0


def test_damage_and_unlisted_files_are_seen(spark, pages, tmp_path):
    target = str(tmp_path / "d")
    write_archives(pages, target)
    name = sorted(n for n in os.listdir(f"{target}/archives") if n.endswith(".gz"))[0]
    data = open(f"{target}/archives/{name}", "rb").read()
    body = gzip.decompress(data).replace(b"<html>7 ", b"<html>8 ")
    open(f"{target}/archives/{name}", "wb").write(gzip.compress(body))
    with pytest.raises(Exception):
        read_archives(spark, target).count()
    open(f"{target}/archives/{name}", "wb").write(data)
    open(f"{target}/archives/extra.warc.gz", "wb").write(data)
    with pytest.raises(ValueError, match="not those of its manifest"):
        read_archives(spark, target)
