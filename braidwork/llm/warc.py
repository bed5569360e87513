"""WARC archives compressed by a Zstandard dictionary, as Spark jobs that write and read them.

An archive begins with a skippable frame that holds a dictionary, trained on records of that archive. Each record is
then a frame of its own, so that any record can be read with the dictionary and its offset alone. A task streams its
rows into archives and its reader streams them out again: neither holds more than a sample of records and one record.

Archives lie in a folder that all executors reach by a path or URI. A table of them (``manifest`` in that folder) is
written by Spark, which commits the rows of one attempt a task: what a lost executor had written is not listed and not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, rows_of, utf8

#: Fixed values of the two formats.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive's dictionary, and of its first records, on which it is trained.
DICTIONARY, SAMPLE = 64 << 10, 2 << 20
#: Compressed bytes after which a task begins another archive.
ARCHIVE = 1 << 30
LEVEL = 3
#: Repeated payloads up to which their keys are broadcast (some 20 MB); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_READ = 1 << 20
_MANIFEST = "archive string, records long, bytes long, dictionary_bytes long"


def digest(data: bytes) -> str:
    """SHA-1 in base 32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(fields: Iterable[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in chain(fields, [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]))
    return b"".join((b"WARC/1.1\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one record, the digest of which must hold."""
    head, block = data.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    block = block[: int(fields["content-length"])]
    if not version.startswith("WARC/") or fields.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError("a record is damaged")
    return fields, block


def _name(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def _uri(url: str) -> str:
    """The address with what a header line cannot hold percent-encoded."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~|^{}`\\\"<>")


def page_record(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    """A response, or a revisit of the page ``first``: it keeps the payload's length in its header, and its digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _uri(url))] if url else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", _name(first))] if revisit else []
    return record(fields, http if revisit else http + payload)


def train(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary; none where the records are too few or too small to make one."""
    if len(records) < 8 or sum(map(len, records)) < 16 << 10:
        return None
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, records)) // 8), records, k=256, d=8)
    except zstandard.ZstdError:  # nothing in them repeats
        return None


def write_archive(out: BinaryIO, records: Iterator[bytes], info: bytes, dictionary_bytes: int, sample_bytes: int, most_bytes: int, level: int) -> tuple[int, int, int]:
    """Writes records until the archive has ``most_bytes``; how many, the archive's bytes, and those of its dictionary."""
    held, size = [], 0
    for one in records:
        held.append(one)
        size += len(one)
        if size >= sample_bytes:
            break
    dictionary = train(held, dictionary_bytes)
    written = trained = 0
    if dictionary is not None:
        dictionary.precompute_compress(level)
        data = dictionary.as_bytes()
        trained = len(data)
        written = out.write(struct.pack("<II", DICTIONARY_MAGIC, trained) + data)
    press = zstandard.ZstdCompressor(level, dict_data=dictionary, write_checksum=True)
    written += out.write(press.compress(info))
    n = 0
    for one in chain(held, records):
        written += out.write(press.compress(one))
        n += 1
        if written >= most_bytes and n >= len(held):
            break
    return n, written, trained


class _Stream:
    """A file read forwards, a piece at a time."""

    def __init__(self, file: BinaryIO):
        self.file, self.held, self.at, self.offset = file, b"", 0, 0

    def peek(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end of the file."""
        if len(self.held) - self.at < n:
            parts = [self.held[self.at :]]
            missing = n - len(parts[0])
            while missing > 0 and (more := self.file.read(max(missing, _READ))):
                parts.append(more)
                missing -= len(more)
            self.held, self.at = b"".join(parts), 0
        return self.held[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        data = self.peek(n)
        if len(data) < n:
            raise EOFError("an archive ends within a frame")
        self.at += n
        self.offset += n
        return data


def frames(file: BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """(offset, magic number, frame) of each frame; that of a skippable one is its content."""
    stream = _Stream(file)
    while stream.peek(1):
        offset, magic = stream.offset, struct.unpack("<I", stream.peek(4))[0]
        if magic in SKIPPABLE:
            size = struct.unpack("<II", stream.take(8))[1]
            yield offset, magic, stream.take(size)
        elif magic == FRAME_MAGIC:
            head = stream.peek(18)
            parts, last = [stream.take(zstandard.frame_header_size(head))], False
            while not last:
                block = stream.take(3)
                value = int.from_bytes(block, "little")
                last, kind, size = value & 1, value >> 1 & 3, value >> 3
                parts += [block, stream.take(1 if kind == 1 else size)]  # one byte stands for a run
            parts.append(stream.take(4 if zstandard.get_frame_parameters(head).has_checksum else 0))
            yield offset, magic, b"".join(parts)
        else:
            raise ValueError(f"no frame begins at {offset}")


def read_records(file: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of each record of an archive."""
    press = zstandard.ZstdDecompressor()
    for offset, magic, data in frames(file):
        if magic == DICTIONARY_MAGIC and offset == 0:
            if data[:4] == struct.pack("<I", FRAME_MAGIC):  # the format lets it be compressed itself
                data = press.decompress(data)
            press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        elif magic == FRAME_MAGIC:
            yield offset, *parse(press.decompress(data))


def _writer(folder: str, date: str, dictionary: int, sample: int, most: int, level: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for rows in rows_of(batch, "payload"):
                    columns = (rows.column(c).to_pylist() for c in ("page", "url"))
                    for page, url, payload, first, revisit in zip(*columns, utf8(rows.column("payload")), rows.column("first").to_pylist(), rows.column("revisit").to_pylist(), strict=True):
                        yield page_record(page, url, payload, first, revisit, date)

        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, number = TaskContext.get(), 0
        left = records()
        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x-archive:info>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: braidwork\r\nformat: WARC File Format 1.1\r\n")
        while (one := next(left, None)) is not None:
            name = f"part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                n, size, trained = write_archive(out, chain([one], left), info, dictionary, sample, most, level)
            number += 1
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "bytes": [size], "dictionary_bytes": [trained]})

    return run


def _reader(folder: str, payloads: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "offset", "type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", *["payload"] * payloads]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.binary()] * payloads]
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{archive}", compression=None) as file:
                    for offset, fields, block in read_records(file):
                        found, length, body = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None
                        if fields.get("content-type", "").startswith("application/http"):
                            head, body = block.split(b"\r\n\r\n", 1)
                            length = int(m[1]) if (m := re.search(rb"(?im)^content-length:\s*(\d+)", head)) else len(body)
                            if fields["warc-type"] == "response":
                                length = len(body)
                                if found not in (None, own := digest(body)):
                                    raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                                found = own
                            else:
                                body = None
                        rows.append((archive, offset, fields["warc-type"], fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-refers-to"), found, length, *[body] * payloads))
                        held += 200 + len(body or b"") * payloads
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page, url, payload) with ``first``, the smallest page of those with an equal payload, and ``revisit``.

    Payloads are equal if their SHA-256 and length are. Of keys that repeat, one row each is counted and, if these are few,
    broadcast, so that no payload is shuffled; otherwise pages meet them in a join that adaptive execution splits where a
    key is frequent.
    """
    size = F.octet_length("payload")
    keyed = pages.withColumn("key", F.concat(F.sha2("payload", 256), F.lit("-"), size))
    found = keyed.where(size >= least_bytes).groupBy("key").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    few = len(found.select(F.lit(1)).limit(BROADCAST_ROWS + 1).collect()) <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(found) if few else found, "key", "left")
    return joined.select("page", "url", "payload", "first", (F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))).alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dictionary_bytes: int = DICTIONARY, sample_bytes: int = SAMPLE, most_bytes: int = ARCHIVE, level: int = LEVEL) -> DataFrame:
    """Writes a record for each row into archives in ``folder``; the table of archives: archive, records, bytes, dictionary_bytes.

    ``folder`` is a path or URI that pyarrow's file systems and Spark both know and all executors share. Of rows with equal
    payloads of ``least_bytes`` or more, those with the smallest id are responses and others revisit it; rows that repeat
    an id are records of their own. A null payload is an empty one, a row without id is no original unless all of its copies
    lack one, a null or empty address gives no target. Other columns are not read. An empty table gives no archives.

    The dictionary comes from an archive's first records, up to ``sample_bytes`` of them; it decides on sizes only. An archive
    of few or tiny records has none, which the format allows.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page"), pages[url_col].alias("url"), F.coalesce(pages[payload_col].cast("binary"), F.lit(b"")).alias("payload"))
    made = with_originals(rows, least_bytes).mapInArrow(_writer(folder, date, dictionary_bytes, sample_bytes, most_bytes, level), _MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row a record of the listed archives, a task an archive, with their payloads if asked for.

    archive, offset, type, record_id, target_uri, date, refers_to, payload_digest, payload_bytes, payload. Digest and
    length of a response are those of the payload that was read, which has to have the digest that is written in the
    record; those of a revisit are the ones that it states, and its payload is null.
    """
    listed = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("archive")
    dealt = listed.repartitionByRange(max(1, listed.count()), "archive")
    columns = "archive string, offset long, type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long"
    return dealt.mapInArrow(_reader(folder, payloads), columns + ", payload binary" * payloads)


def page_of(record_id: Column) -> Column:
    """The id of the page that a record's name holds."""
    return F.regexp_extract(record_id, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
