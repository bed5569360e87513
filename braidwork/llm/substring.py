"""Substring deduplication through difference-cover anchors.

Short anchors are hashed only where the word's place in its document, modulo a period, lies in a difference
cover. For any two places some shift smaller than the period puts both on the cover, so two equal windows of
words share an anchor that lies at the same distance from their starts and wholly inside both. Passages that
occur once, nearly all of a corpus, are thereby settled by a fraction of the places and a short key. Around
the anchors that several documents share, the windows are extended to their full width and compared.

Documents are dealt out into blocks by a hash of their id, and keys into buckets by their own hash. What goes
from a block to a bucket is one packed row, in which each key stands once, however many documents of the block
hold it; so a passage that a third of all documents share costs its bucket one key a block.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8
from .wordhash import Words, windows

#: Bytes of text in a block. A task holds one at a time, and takes about twenty times as much memory for it.
BLOCK_BYTES = 4 << 20
#: A difference cover for each period: its differences give every residue.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}


def _words(docs: pa.Table) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray]:
    """Ids (a null is -1 with the flag unset), words, and for each word its document and the end of that."""
    ids = docs.column("id").combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    words = Words(utf8(docs.column("text").combine_chunks()))
    counts = np.diff(words.first)
    of = np.repeat(np.arange(len(counts)), counts)
    ends = words.first[1:][of]
    return np.where(known, ids.fill_null(-1).to_numpy(zero_copy_only=False), -1), words, of, np.where(known[of], ends, 0)


def _anchors(words: Words, of: np.ndarray, ends: np.ndarray, width: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors, as numbers of words, and their hashes."""
    size = width - period + 1
    at = np.arange(len(of))
    first = words.first[of]
    fits = (at + size <= ends) & (ends - first >= width) & np.isin((at - first) % period, COVERS[period])
    places = np.flatnonzero(fits)
    return places, windows(words.hashes, size, 1)[places]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(block: int, bucket: np.ndarray, columns: dict[str, np.ndarray], key: str = "bucket") -> pa.Table:
    """One row a bucket (ascending), with each column's values packed."""
    found, starts = np.unique(bucket, return_index=True)
    cuts = [*starts.tolist(), len(bucket)]
    packed = {n: pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for n, x in columns.items()}
    other = "block" if key == "bucket" else "bucket"
    return pa.table({key: pa.array(found, pa.int64()), other: pa.array(np.full(len(found), block, np.int64)), **packed})


def _unpack(rows: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and the number of the row that each is from."""
    values = [np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]
    return np.concatenate(values) if values else np.empty(0, kind), np.repeat(np.arange(len(values)), [len(v) for v in values])


def _to_buckets(width: int, period: int, buckets: int):
    """Block of documents -> its distinct anchors by bucket, and whether two of its documents have them."""

    def run(docs: pa.Table) -> pa.Table:
        ids, words, of, ends = _words(docs)
        places, keys = _anchors(words, of, ends, width, period)
        holders = ids[of[places]]
        order = np.lexsort((holders, keys))
        keys, holders = keys[order], holders[order]
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(head)
        last = np.concatenate([at[1:], [len(keys)]]).astype(np.int64) - 1
        several = (holders[last] != holders[at]).astype(np.uint8) if len(at) else np.empty(0, np.uint8)
        keys = keys[at]
        return _pack(docs.column("block")[0].as_py(), _bucket(keys, buckets), {"keys": keys.astype("<u4"), "several": several})

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """Bucket -> for each block, those of its anchors that two documents or more have."""
    keys, row = _unpack(rows, "keys", "<u4")
    several, _ = _unpack(rows, "several", "u1")
    order = np.argsort(keys, kind="stable")
    keys, row, several = keys[order], row[order], several[order].astype(bool)
    same = keys[1:] == keys[:-1]
    several[1:] |= same
    several[:-1] |= same
    keys, row = keys[several], row[several]
    order = np.argsort(row, kind="stable")
    keys, row = keys[order], row[order]
    blocks = rows.column("block").to_numpy()
    # Rows of a block come together: a block sends one row to a bucket.
    return _pack(rows.column("bucket")[0].as_py(), row, {"keys": keys}, "block").set_column(0, "block", pa.array(blocks[np.unique(row)], pa.int64()))


def _window_keys(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits a window, of two hashes a word that are independent."""
    low = windows(words.hashes, width, 2)
    return low, (windows(words.other_hashes(), width, 3) >> np.uint64(32)).astype(np.uint32)


def _extend(width: int, period: int, buckets: int):
    """Block of documents and its shared anchors -> the distinct windows around these, with the smallest id."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        nothing = _pack(0, np.empty(0, np.int64), {n: np.empty(0, np.uint8) for n in ("low", "high", "ids", "several")})
        if not docs.num_rows or not shared.num_rows:
            return nothing
        ids, words, of, ends = _words(docs)
        places, keys = _anchors(words, of, ends, width, period)
        low, row = _unpack(shared, "keys", "<u4")
        common = np.unique(shared.column("bucket").to_numpy()[row] << 32 | low)
        keys = _bucket(keys, buckets) << 32 | keys.astype("<u4")
        near = np.zeros(len(of) + 1, np.int64)
        near[1 + places[common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys]] = 1
        near = np.cumsum(near)
        at = np.arange(len(of))
        starts = np.flatnonzero((at + width <= ends) & (near[np.minimum(at + period, len(of))] > near[at]))
        if not len(starts):
            return nothing
        low, high = _window_keys(words, width)
        low, high, holders = low[starts], high[starts], ids[of[starts]]
        order = np.lexsort((holders, high, low))
        low, high, holders = low[order], high[order], holders[order]
        head = np.ones(len(low), bool)
        head[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        at = np.flatnonzero(head)
        last = np.concatenate([at[1:], [len(low)]]).astype(np.int64) - 1
        several = (holders[last] != holders[at]).astype(np.uint8)
        low, high, holders = low[at], high[at], holders[at]
        return _pack(docs.column("block")[0].as_py(), _bucket(low, buckets), {"low": low, "high": high, "ids": holders.astype(np.int64), "several": several})

    return run


def _firsts(rows: pa.Table) -> pa.Table:
    """Bucket -> for each block, its windows that also start in a smaller document than its last, with that id."""
    low, row = _unpack(rows, "low", "<u8")
    high, ids, several = (_unpack(rows, n, k)[0] for n, k in (("high", "<u4"), ("ids", "<i8"), ("several", "u1")))
    order = np.lexsort((ids, high, low))
    low, high, ids, row, several = low[order], high[order], ids[order], row[order], several[order]
    head = np.ones(len(low), bool)
    head[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    smallest = ids[np.flatnonzero(head)][np.cumsum(head) - 1]
    keep = (smallest < ids) | several.astype(bool)
    low, high, smallest, row = low[keep], high[keep], smallest[keep], row[keep]
    order = np.argsort(row, kind="stable")
    low, high, smallest, row = low[order], high[order], smallest[order], row[order]
    blocks = rows.column("block").to_numpy()
    packed = _pack(rows.column("bucket")[0].as_py(), row, {"low": low, "high": high, "ids": smallest}, "block")
    return packed.set_column(0, "block", pa.array(blocks[np.unique(row)], pa.int64()))


def _remove(width: int):
    """Block of documents and its repeated windows -> the documents without them."""

    def run(docs: pa.Table, firsts: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        ids, words, of, ends = _words(docs)
        keep = np.ones(len(of), bool)
        low, _ = _unpack(firsts, "low", "<u8")
        if len(low):
            high, smallest = _unpack(firsts, "high", "<u4")[0], _unpack(firsts, "ids", "<i8")[0]
            order = np.lexsort((high, low))
            low, high, smallest = low[order], high[order], smallest[order]
            at = np.flatnonzero(np.arange(len(of)) + width <= ends)
            own_low, own_high = _window_keys(words, width)
            own_low, own_high = own_low[at], own_high[at]
            place = np.searchsorted(low, own_low)
            hit = np.zeros(len(at), bool)
            open_ = np.arange(len(at))
            while len(open_):  # nearly always one round: further ones only where low keys of different windows agree
                open_ = open_[place[open_] < len(low)]
                open_ = open_[low[place[open_]] == own_low[open_]]
                equal = high[place[open_]] == own_high[open_]
                done = open_[equal]
                hit[done] = smallest[place[done]] < ids[of[at[done]]]
                open_ = open_[~equal]
                place[open_] += 1
            covered = np.zeros(len(of) + 1, np.int64)
            np.add.at(covered, at[hit], 1)
            np.subtract.at(covered, at[hit] + width, 1)
            keep = np.cumsum(covered)[:-1] == 0
        texts, removed = [], []
        for i, text in enumerate(utf8(docs.column("text").combine_chunks())):
            own = keep[words.of(i)]
            removed.append(int(len(own) - own.sum()))
            texts.append(b" ".join(compress(text.split(), own.tolist()) if removed[-1] else text.split()))
        return pa.table(
            {
                "doc_id": docs.column("id"),
                "n_words": pa.array(np.diff(words.first), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
            }
        )

    return run


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, period: int = 7, blocks: int | None = None, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of ``width`` words that covers it also starts in a document with a smaller id,
    judged on the input. Words are maximal runs of other than the six ASCII white-space characters. A null
    or empty text has no words. Rows that repeat an id count as one document, so they don't remove each
    other's words; a row with a null id removes nothing and loses nothing. Other columns are not read. An
    empty table gives no rows.

    The texts are shuffled once, by block, and read thrice from that. Keys: a bucket and 32 bits for an anchor, which
    decides only what is compared further, and 96 bits for a window, from two independent hashes of each word.
    Blocks are of ``BLOCK_BYTES`` on the average, whatever the input (its size is one sum over the column), and
    there are as many buckets, so that these are of bounded size too. A step sends at most a row for each
    block and bucket, and none without an anchor in it: in proportion to the text at most.
    """
    if blocks is None:
        size = docs.agg(F.sum(F.octet_length(docs[text_col]).cast("long")).alias("size")).first()["size"] or 0
        blocks = -(-size // BLOCK_BYTES) or 1
    buckets = buckets or blocks
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    # Rows without id are told apart by their text only to spread them.
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.xxhash64("text"))), F.lit(blocks)))
    anchors = rows.groupBy("block").applyInArrow(_to_buckets(width, period, buckets), "bucket long, block long, keys binary, several binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared, "block long, bucket long, keys binary")
    kinds = "bucket long, block long, low binary, high binary, ids binary, several binary"
    found = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_extend(width, period, buckets), kinds)
    firsts = found.groupBy("bucket").applyInArrow(_firsts, "block long, bucket long, low binary, high binary, ids binary")
    out = "doc_id long, n_words long, n_removed long, kept_text string"
    return rows.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(_remove(width), out)
