"""Importance resampling towards a target: hashed n-gram counts, gains by bucket, and a draw by scores.

Two Arrow passes over the texts. The first counts each partition's features into a vector by bucket, and a tree of
additions merges the vectors. The second looks the gains of its features up and sums them by document. Both find
buckets without making a feature's string: CRC-32 is linear over GF(2), so the checksum of "a b" comes from those of
its parts by table look-ups on whole arrays.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, rows_of, word_spans

#: Bytes of text that are looked at together; a longer text comes alone.
SLICE = 1 << 20
#: Words whose features are made together; a document of any length is a run of such stretches.
STRETCH = 1 << 19
_WORD_BYTE = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
_BYTE_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)  # of a register that holds 0


@cache
def _zero_bytes(n: int) -> np.ndarray:
    """(4, 256): what ``n`` zero bytes make of a checksum's register, by its bytes; the map is linear."""
    single = np.array([1 << k for k in range(32)], np.uint32)
    if n == 1:
        images = _BYTE_CRC[single & 0xFF] ^ (single >> np.uint32(8))
    else:
        images = _shift_by(_shift_by(single, _zero_bytes(n // 2)), _zero_bytes(n - n // 2)) if n else single
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, (np.arange(256) >> bit & 1).astype(bool)] ^= images[8 * byte + bit]
    return out


def _shift_by(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0][values & np.uint32(0xFF)]
    for byte in (1, 2, 3):
        out ^= table[byte][values >> np.uint32(8 * byte) & np.uint32(0xFF)]
    return out


@cache
def _short_shifts() -> np.ndarray:
    """(4, 64 * 256): the tables of 0 to 63 zero bytes in a row."""
    return np.concatenate([_zero_bytes(n) for n in range(64)], axis=1)


def shifted(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums after as many zero bytes more: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    tables, low = _short_shifts(), (sizes & 63) << 8
    out = tables[0][low | (values & np.uint32(0xFF))]
    for byte in (1, 2, 3):
        out ^= tables[byte][low | (values >> np.uint32(8 * byte) & np.uint32(0xFF))]
    more, n = sizes >> 6, 64
    while more.any():
        odd = np.flatnonzero(more & 1)
        out[odd] = _shift_by(out[odd], _zero_bytes(n))
        more, n = more >> 1, 2 * n
    return out


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of ``data``, byte by byte over all of them at once; long ones by the library."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-np.minimum(sizes, 65), kind="stable")
    long = int(np.count_nonzero(sizes > 64))
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + sizes[k]])
    order = order[long:]
    register = np.full(len(order), 0xFFFFFFFF, np.uint32)
    left = np.searchsorted(-sizes[order], -np.arange(65), "left")  # how many have more than k bytes
    at = starts[order]
    for k in range(64):
        n = left[k]
        if not n:
            break
        register[:n] = _BYTE_CRC[(register[:n] & np.uint32(0xFF)) ^ data[at[:n] + k]] ^ (register[:n] >> np.uint32(8))
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    return out


def features(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every run of one to three words, a stretch of words at a time."""
    data, starts, sizes, of = word_spans(texts, _WORD_BYTE)
    words, space = checksums(data, starts, sizes), np.uint32(zlib.crc32(b" "))
    one = np.ones(1, np.int64)
    for a in range(0, len(words), STRETCH):
        b = min(a + STRETCH, len(words))
        own, n, text = words[a : b + 2], sizes[a : b + 2], of[a : b + 2]
        yield text[: b - a], own[: b - a] % np.uint32(buckets)
        run = own
        for length in (2, 3):
            run, own, n = run[:-1], own[1:], n[1:]
            run = shifted(shifted(run, one) ^ space, n) ^ own
            whole = np.flatnonzero(text[length - 1 :][: b - a] == text[: len(text) - length + 1][: b - a])
            yield text[whole], run[whole] % np.uint32(buckets)


def _count(buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for rows in rows_of(batch, "text", SLICE):
                for _, found in features(rows.column("text"), buckets):
                    total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return run


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts (``text``) lie in each bucket; one vector a partition, added up in a tree."""
    vectors = texts.mapInArrow(_count(buckets), "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    zero = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)  # a table may have no partition
    return zero.union(vectors).treeReduce(np.add, depth=3)


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed share in the target / smoothed share in the source)) by bucket."""
    n, t_all, s_all = len(source), int(target.sum()), int(source.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.float64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 times a Gumbel variable) that only the seed and the id decide."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(by_bucket: np.ndarray, seed: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, "text", SLICE):
                n, ids = rows.num_rows, rows.column("doc_id").to_pylist()
                count, weight, words = np.zeros(n, np.int64), np.zeros(n), None
                for of, found in features(rows.column("text"), len(by_bucket)):
                    weight += np.bincount(of, by_bucket[found], n)  # whole numbers, exact below 2**53
                    count += np.bincount(of, minlength=n)
                # n words make n + (n - 1) + (n - 2) features, so 20 words are 57 and any count tells its words.
                words = np.where(count < 4, (count + 1) // 2, count // 3 + 1)
                score = weight.astype(np.int64) + np.array([noise(i, seed) for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, (count, words, weight.astype(np.int64), score))], names=["doc_id", "n_features", "n_words", "weight", "score"])

    return run


def score_documents(docs: DataFrame, target: DataFrame, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight, score of each row of ``docs``; ``weight`` sums its features' gains.

    A null text has no words, and a row without id is scored with an empty one. Rows that repeat an id are rows of
    their own. Empty tables count nothing: without a target all its shares are equal. Other columns are not read.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    source = bucket_counts(texts.select("text"), buckets)
    wanted = bucket_counts(target.select(target[target_text_col].alias("text")), buckets)
    return texts.mapInArrow(_score(gains(wanted, source), seed), "doc_id long, n_features long, n_words long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank of each row: ``rank`` counts the drawn ones from 1, others have none.

    Of the N rows with ``least_words`` or more, floor(percent * N / 100) are drawn: those with the highest scores, ties to
    the smaller id (a missing one first). Adding the noise to log weights and taking the highest draws without
    replacement in proportion to the weights. Odd rows are treated as :func:`score_documents` says.

    Rows that can be drawn are dealt out by ranges of (score, id); a task numbers its own, and the tasks' counts, one
    number a task, give what comes before it.
    """
    scored = materialize(score_documents(docs, target, buckets, seed, id_col, text_col, target_text_col))
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    ranged = materialize(scored.where(able).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, f"{_SCORED}, part int, place long"))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("base") + F.col("place") + 1
    ranked = ranged.join(F.broadcast(base), "part").withColumn("rank", F.when(rank <= F.expr(f"`all` * {percent} div 100"), rank))
    return ranked.drop("part", "place", "base", "all").unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


_SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = pa.array(np.arange(done, done + batch.num_rows, dtype=np.int64))
        done += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), place], names=[*batch.schema.names, "part", "place"])
