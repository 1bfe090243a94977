import base64
import hashlib
import struct

import pytest
import zstandard

from quire.llm import warc
from quire.llm.shared import make_dir, scratch

PAGES = "page_id long, url string, html string, first string"


def expected(rows, least):
    out = []
    for k, _, html, _ in rows:
        data = (html or "").encode()
        same = [x for x, _, h, _ in rows if (h or "").encode() == data and x is not None]
        first = min(same, default=None)
        revisit = len(data) >= least and first is not None and k != first
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    rows = [(i, f"http://a/{i}", f"<p>{'é' * (i % 7)} {i % 11}\r\n\r\nWARC/1.1\r\n</p>" * (i % 50), None) for i in range(600)]
    rows += [(700, None, None, None), (701, "x\r\ny: z", "", None), (702, "u", "short", None), (703, "u", "short", None), (0, "again", rows[0][2], None), (None, "n", rows[5][2], None), (None, "n", "alone", None), (704, "long", "z" * 3_000_000, None)]
    out = make_dir(spark, scratch(spark, "t"))
    warc.write(spark.createDataFrame(rows, PAGES).repartition(3), "page_id", "url", "html", out, least)
    back = warc.read(spark, out, spark.createDataFrame([], PAGES).schema["page_id"].dataType).collect()
    got = sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str)
    assert got == expected(rows, least)
    texts = {(r.key, r.url): bytes(r.block).decode() for r in back if r.record_type == "response"}
    assert all(t in [h or "" for _, _, h, _ in rows] for t in texts.values())


def test_empty(spark):
    out = make_dir(spark, scratch(spark, "t"))
    empty = spark.createDataFrame([], PAGES)
    warc.write(empty, "page_id", "url", "html", out)
    assert warc.read(spark, out, empty.schema["page_id"].dataType).count() == 0


def archive(*records, dictionary=b""):
    made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    return warc.preamble(dictionary) + b"".join(made.compress(r) for r in records)


def test_reader_of_foreign_archives():
    one = warc.record(1, "u", b"body", warc.digest(b"body"), 4, None)
    dictionary = warc.trained([warc.record(i, f"http://host/{i}", b"<p>%d</p>" % i, "A" * 32, 1, None) for i in range(200)])
    assert dictionary
    for data in (archive(one, one), archive(one, one, dictionary=dictionary)):
        assert [b for _, b in warc.records(data)] == [b"body"] * 2
    made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(one)
    packed = zstandard.ZstdCompressor().compress(dictionary)
    assert [b for _, b in warc.records(warc.preamble(packed) + made)] == [b"body"]
    streamed = zstandard.ZstdCompressor(write_content_size=False, write_checksum=True).compressobj()
    frame = streamed.compress(one * 1) + streamed.flush()
    assert [b for _, b in warc.records(warc.preamble(b"") + frame)] == [b"body"]


@pytest.mark.parametrize("change", ["length", "digest", "version", "type", "cut", "magic", "frame", "header"])
def test_reader_refuses(change):
    one = warc.record(1, "u", b"body", warc.digest(b"body"), 4, None)
    bad = {
        "length": one.replace(b"Content-Length: 4", b"Content-Length: 5"),
        "digest": one.replace(b"body", b"BODY"),
        "version": one.replace(b"WARC/1.1", b"WARC/9.9"),
        "type": one.replace(b"WARC-Type: response", b"WARC-Type: other"),
        "header": one.replace(b"WARC-Date: ", b"Some-Date: "),
    }
    data = archive(bad.get(change, one))
    data = {"cut": data[:-3], "magic": b"\x00" + data[1:], "frame": data[:9] + b"\x00" + data[10:]}.get(change, data)
    with pytest.raises(ValueError):
        list(warc.records(data))
    assert struct.unpack("<I", archive(one)[:4])[0] == warc.SKIPPABLE


@pytest.mark.parametrize("name", ["WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Record-ID", "Content-Length", "WARC-Type", "X-Payload-Length"])
def test_every_header_is_needed(name):
    whole = warc.record("1", "http://a/", b"body", warc.digest(b"body"), 4, None)
    lines = whole.split(b"\r\n")
    cut = b"\r\n".join(x for x in lines if not x.lower().startswith(name.lower().encode() + b":"))
    assert len(cut) < len(whole) and warc.parse(whole)[1] == b"body"
    with pytest.raises(ValueError):
        warc.parse(cut)
