import base64
import hashlib
import io
import random
import struct
import uuid

import pytest
import zstandard
from pyspark.sql import functions as F

from braidwork.llm import queries, warc

from .test_operators import SF, same


def folder(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def made_pages():
    r = random.Random(3)
    page = "<html><head><title>{}</title></head><body><p class='text'>{}</p></body></html>"
    words = [f"word{k}" for k in range(300)]
    rows = [(n, f"https://example.org/{n}?ä=1 2", page.format(n, " ".join(r.choices(words, k=r.randint(0, 200))))) for n in range(60)]
    rows += [(100 + n, f"https://example.net/{n}\r\nWARC-Type: x", page.format("same", "text")) for n in range(20)]
    rows += [(200, None, None), (201, "", ""), (None, "u", page.format("same", "text")), (None, "u", "only here"), (None, "u", "only here")]
    rows += [(105, "again", page.format("same", "text")), (100, "again", page.format("same", "text")), (300, "long", "\r\n\r\nContent-Length: 5\n" * 100_000), (-7, "x", "\x00é漢😀")]
    return rows


def wanted(rows, least=0):
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        again = p in first and i != first[p]
        out.append((i, len(p), sha1(p), "revisit" if again else "response", first[p] if again else None))
    return out


def read_back(spark, where):
    rows = warc.read_archives(spark, where).where("type <> 'warcinfo'")
    return rows.select(warc.page_of(F.col("record_id")), "payload_bytes", "payload_digest", "type", warc.page_of(F.col("refers_to"))).collect()


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, None) for i, u, h in rows], "page_id long, url string, html string, payload string, first int, key string").repartition(3)


@pytest.mark.parametrize(("least", "broadcast"), [(0, 10), (0, 0), (1, 10), (70, 10)])
def test_round_trip(spark, tmp_path, monkeypatch, least, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    rows, where = made_pages(), folder(tmp_path)
    made = warc.write_archives(pages(spark, rows), where, least_bytes=least)
    assert made.agg(F.sum("records")).first()[0] == len(rows)
    same(read_back(spark, where), wanted(rows, least))
    stored = warc.read_archives(spark, where).where("type = 'response'").select("payload").collect()
    first = [(h or "").encode() for (_, _, h), w in zip(rows, wanted(rows, least), strict=True) if w[3] == "response"]
    assert sorted(bytes(r[0]) for r in stored) == sorted(first)


def test_archives_roll_over_and_keep_to_the_format(spark, tmp_path):
    rows, where = made_pages()[:60], folder(tmp_path)
    made = warc.write_archives(pages(spark, rows).coalesce(1), where, sample_bytes=30_000, most_bytes=6_000).collect()
    assert len(made) > 1 and sum(r["records"] for r in made) == 60 and any(r["dictionary_bytes"] for r in made)
    same(read_back(spark, where), wanted(rows))
    for r in made:
        data = open(f"{where}/{r['archive']}", "rb").read()
        assert len(data) == r["bytes"]
        press = zstandard.ZstdDecompressor()
        if r["dictionary_bytes"]:
            magic, size = struct.unpack("<II", data[:8])
            assert magic == 0x184D2A5D and size == r["dictionary_bytes"] and data[8:12] == struct.pack("<I", 0xEC30A437)
            press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        for offset, fields, _ in warc.read_records(io.BytesIO(data)):  # each record can be read by its offset alone
            head = press.decompressobj().decompress(data[offset:])
            assert head.startswith(b"WARC/1.1\r\n") and head.endswith(b"\r\n\r\n") and fields["warc-record-id"].encode() in head


def test_odd_addresses_stay_one_field(spark, tmp_path):
    rows, where = made_pages(), folder(tmp_path)
    warc.write_archives(pages(spark, rows), where)
    got = warc.read_archives(spark, where).where("type <> 'warcinfo'").select("target_uri").collect()
    assert sorted(r[0] or "" for r in got) == sorted(warc._uri(u or "") for _, u, _ in rows)
    assert "https://example.net/0%0D%0AWARC-Type:%20x" in [r[0] for r in got]


def test_empty_table(spark, tmp_path):
    where = folder(tmp_path)
    assert warc.write_archives(pages(spark, []), where).count() == 0 and warc.read_archives(spark, where).count() == 0


def test_damage_is_noticed():
    one = warc.page_record(1, "u", b"abcdef", None, False, "1970-01-01T00:00:00Z")
    assert warc.parse(one)[1].endswith(b"\r\n\r\nabcdef")
    with pytest.raises(ValueError):
        warc.parse(one.replace(b"abcdef", b"abcdeg"))
    out = io.BytesIO()
    warc.write_archive(out, iter([one] * 20), one, 1 << 12, 1 << 20, 1 << 30, 3)
    with pytest.raises(EOFError):
        list(warc.frames(io.BytesIO(out.getvalue()[:-3])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"plain text")))
    packed = zstandard.ZstdCompressor().compress(b"\x37\xa4\x30\xec" + b"x" * 50)  # content of a leading frame may be compressed
    assert next(warc.frames(io.BytesIO(struct.pack("<II", 0x184D2A5D, len(packed)) + packed)))[2] == packed


def test_table(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    same(queries.op12_warc(spark, SF).collect(), wanted(rows))
