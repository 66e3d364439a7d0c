"""Archives: round trip, revisits, broken files."""

import base64
import hashlib

import pytest
import zstandard

from palimpsest.llm import archive
from palimpsest.llm.storage import Scratch

SCHEMA = "page_id long, url string, html string, digest string"


def expected(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        refers = first.get(p) if first.get(p) != i else None
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def round_trip(spark, rows, **options):
    path = Scratch(spark, "test").path("warc")
    pages = spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], SCHEMA).repartition(3)
    archive.write_archives(pages, path, **options)
    return archive.read_archives(spark, path), path


def number(ref):
    text = ref.removeprefix("<urn:page:").removesuffix(">") if ref else ""
    return int(text) if text else None


ROWS = [(k, f"http://x/{k}?a=%0D\n", "<p>" + "word " * (k % 50) + str(k % 40) + "é</p>") for k in range(300)] + [(900, None, None), (901, "u", ""), (902, "u", "x" * 300_000), (903, "u", "a\r\n\r\nb"), (None, "u", "<p>0é</p>"), (None, "n", "only"), (904, "u", "x" * 300_000), (0, "again", "<p>0é</p>")]


@pytest.mark.parametrize("broadcast", [archive.BROADCAST_DIGESTS, 0])
def test_round_trip(spark, broadcast):
    """Digests of repeated payloads broadcast to the pages, or joined by a shuffle."""
    records, _ = round_trip(spark, ROWS, broadcast_digests=broadcast)
    got = records.collect()
    assert sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, r.type, number(r.refers_to)) for r in got), key=str) == expected(ROWS)
    payload = {number(r.record_id): r.payload.decode() for r in got if r.type == "response"}
    urls = {number(r.record_id): r.url for r in got}
    for i, u, h in ROWS:
        if i not in (0, None):
            assert urls[i] == u
            assert payload.get(i, h or "") == (h or "")


def test_small_payloads_are_all_responses(spark):
    records, _ = round_trip(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], min_revisit_bytes=5)
    assert sorted((number(r.record_id), r.type) for r in records.collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty_table(spark):
    records, _ = round_trip(spark, [])
    assert records.collect() == []


def test_files_roll_by_bytes_with_the_dictionary_first(spark):
    raw = archive.train_dictionary(spark.createDataFrame([r + ("c",) for r in ROWS[:299]], SCHEMA))
    files = [f for b in archive._files(raw, 1000)(iter([_batch(ROWS[:40]), _batch(ROWS[40:80])])) for f in b.column(0).to_pylist()]
    head = archive.dictionary_frame(raw)
    assert len(files) > 2 and all(f.startswith(head) for f in files)
    longest = max(len(zstandard.ZstdCompressor(level=archive.LEVEL).compress((r[2] or "").encode())) for r in ROWS[:80]) + 2000
    assert all(len(f) - len(head) < 1000 + longest for f in files) and all(len(f) - len(head) >= 1000 for f in files[:-1])
    assert sum(len(list(archive.read_archive(f))) for f in files) == 80


def _batch(rows):
    import pyarrow as pa

    ids, urls, texts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls), pa.array(texts), pa.nulls(len(ids), pa.int64())], ["page_id", "url", "payload", "refers_to"])


def _file(records, raw=b""):
    packer = zstandard.ZstdCompressor()
    return archive.dictionary_frame(raw) + b"".join(archive.SEPARATOR + packer.compress(r) for r in records)


def _record(payload=b"hello", **change):
    data = archive.record_bytes(1, "u", payload, archive.payload_digest(payload))
    for old, new in change.items():
        data = data.replace(old.encode(), new)
    return data


def test_broken_archives():
    good = _file([_record(), _record(b"")])
    assert [archive.parse_record(d)["payload"] for d in archive.read_archive(good)] == [b"hello", b""]
    for bad in (b"", good[8:], good[:-3], good + b"junk-at-the-end", good[:4] + b"\xff\xff\xff\x7f" + good[8:], good + b"\x50\x2a\x4d\x18\x09\0\0\0"):
        with pytest.raises(archive.ArchiveError):
            list(archive.read_archive(bad))


@pytest.mark.parametrize("bad", [b"junk", _record()[:-1], _record() + b"x", _record(hello=b"jello"), _record().replace(b"WARC/1.1", b"HTTP/1.1"), _record().replace(b"WARC-Date", b"X-Date"), _record().replace(b"WARC-Type: response", b"WARC-Type: revisit"), _record().replace(b"WARC-Type: response", b"WARC-Type")])
def test_broken_records(bad):
    with pytest.raises(archive.ArchiveError):
        archive.parse_record(bad)
