"""Packing of tokenised documents into sequences of a fixed length.

Shortest pack first over the histogram of lengths: lengths are placed longest first, each on the emptiest
pattern of packs that has room, and whole counts move at once. The driver sees the histogram only, one
number a length. Patterns are joined back to the pieces by length and rank.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_chars
from .common import lean, materialize, rows_of, utf8
from .wordhash import Words, distinct

#: Bytes that a worker spends on words whose ids it remembers, in each of two generations.
CACHE = 24 << 20
#: What a remembered word takes besides its bytes and ids; longer words than these many bytes aren't remembered.
ENTRY, LONGEST = 150, 64
#: Bytes of text that are encoded at once, or one longer text.
SLICE = 2 << 20
_SIMPLE = re.compile("[a-zß-öø-ÿ]+")
#: Words that fall into pieces of letters, single digits, and signs, and these pieces; an apostrophe is left to the library.
_MIXED, _PIECE = re.compile(r"[a-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~]+"), re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_SIGN, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_PLACED = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_PIECES = "doc_id long, start long, length int, ids binary, doc_tokens long, part int, local_rank long"


class WordEncoder:
    """Ids of whole texts by a tokenizer that lowers letters and drops white space.

    Such a tokenizer never merges over white space, so a text's ids are those of its words in order, and
    each different word of a slice of texts is looked up once. To meet fewer different words, signs at the end of
    a word behind an ASCII letter or digit count as a word (they are a piece of their own in any case), and A-Z are
    lowered, except in texts that may hold the name of a special token, which is case-sensitive. Words of a
    slice are told apart by their bytes.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Ids are kept in two bytes if they fit.
        self.kind = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        #: Of signs, digits and short runs of letters.
        self.pieces: dict[str, bytes] = {}

        # Words of small letters need no normalising and are one piece, so the model can be asked at once. Whether
        # this tokenizer is of that kind is tried out on such letters.
        self.characters = str.maketrans({chr(b): c for c, b in byte_chars().items()})
        self.simple = _SIMPLE
        letters = [*map(chr, range(97, 123)), *(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)]
        tried = letters + [a + b for a in letters for b in letters[::3]]
        if any(self._ids(w) != self._library(w) for w in tried):
            self.simple = re.compile("(?!)")
        # Whether signs and digits part words as ``_PIECE`` has it is tried out as well.
        self.mixed = _MIXED
        signs = [chr(c) for c in np.flatnonzero(_SIGN) if chr(c) != "'"]
        tried = signs + [x + y for x in ["a", "7", "é", *signs] for y in ["b", "8", "ü", *signs]] + ["a.b", "a1b22", "--a==b;", "3.14", "x_1-y"]
        if self.simple is not _SIMPLE or any([i for x in _PIECE.findall(w) for i in self._library(x)] != self._library(w) for w in tried):
            self.mixed = re.compile("(?!)")
        # And whether signs at the end are parted from a letter or digit, an apostrophe among them.
        self.parts = all(self._library(w + x + y) == self._library(w) + self._library(x + y) for w in ("a", "z9") for x in ["", "'", *signs] for y in ["'", *signs])

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, word: str) -> list[int]:
        """Of a simple word."""
        spelled = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(spelled)]

    def _piecewise(self, text: str) -> bytes:
        out = []
        for x in _PIECE.findall(text):
            if (ids := self.pieces.get(x)) is None:
                ids = array(self.kind, self._ids(x) if self.simple.fullmatch(x) else self._library(x)).tobytes()
                if len(x) <= 3:
                    if len(self.pieces) > 20_000:
                        self.pieces.clear()
                    self.pieces[x] = ids
            out.append(ids)
        return b"".join(out)

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        out = [*map(self.young.get, words)]
        new: list[tuple[int, str]] = []
        kind, old, simple, mixed, tokenize = self.kind, self.old.get, self.simple.fullmatch, self.mixed.fullmatch, self._ids
        fresh = [k for k, ids in enumerate(out) if ids is None]
        for k in fresh:
            if (ids := old(words[k])) is None:
                text = words[k].decode("utf-8", "replace")
                if simple(text):
                    ids = array(kind, tokenize(text)).tobytes()
                elif mixed(text):
                    ids = self._piecewise(text)
                else:
                    new.append((k, text))
            out[k] = ids
        for (k, _), e in zip(new, self.tokenizer.encode_batch_fast([x for _, x in new], add_special_tokens=False), strict=True):
            out[k] = array(kind, e.ids).tobytes()
        for k in fresh:
            if len(words[k]) <= LONGEST:
                self.held += ENTRY + len(words[k]) + len(out[k])
                if self.held > CACHE:
                    self.old, self.young, self.held = self.young, {}, 0
                self.young[words[k]] = out[k]
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        plain = [t if b"<|" not in t else b"" for t in texts]
        words = Words(plain, lower=True)
        data, starts, ends = words.folded, words.starts, words.ends
        # Where the signs at the end of a word begin, if something plain is before them.
        cut = ends
        if self.parts and len(ends):
            last = np.where(_SIGN[data], 0, np.arange(1, len(data) + 1, dtype=np.int32))
            cut = np.maximum.accumulate(last)[ends - 1].astype(np.int64)
            cut = np.where((cut > starts) & _PLAIN[data[np.maximum(cut - 1, 0)]], cut, ends)
        parted = cut < ends
        doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
        take = np.repeat(np.arange(len(starts)), 1 + parted)
        tail = np.zeros(len(take), bool)
        tail[1:] = take[1:] == take[:-1]
        starts, ends, doc = np.where(tail, cut[take], starts[take]), np.where(tail, ends[take], cut[take]), doc[take]
        at, inverse = distinct(data, starts, ends)
        raw = data.tobytes()
        found = self._look_up([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        flat = np.frombuffer(b"".join(found), self.kind)
        sizes = np.array([len(x) for x in found], np.int64) // flat.itemsize
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        own = sizes[inverse]
        place = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[inverse], own)
        ids = flat[place]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, own, len(texts)).astype(np.int64))])
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for k, t in enumerate(texts):
            if b"<|" in t:
                out[k] = np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _cut(path: str, end_id: int, room: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        part, end = TaskContext.get().partitionId(), np.array([end_id], words.kind)
        ranks = np.zeros(room + 1, np.int64)
        for batch in batches:
            for rows in rows_of(batch, "text", SLICE):
                ids, starts, sizes, pieces, totals, local = [], [], [], [], [], []
                for i, found in zip(rows.column("id").to_pylist(), words.encode(utf8(rows.column("text"))), strict=True):
                    whole = np.append(found, end)
                    total = len(whole)
                    for start in range(0, total, room):
                        size = min(room, total - start)
                        ids.append(i)
                        starts.append(start)
                        sizes.append(size)
                        pieces.append(whole[start : start + size].tobytes())
                        totals.append(total)
                        local.append(int(ranks[size]))
                        ranks[size] += 1
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(pieces, pa.binary()), pa.array(totals, pa.int64()), pa.array(np.full(n, part, np.int32)), pa.array(local, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "part", "local_rank"],
                )

    return run


def shortest_pack_first(histogram: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and how many sequences have each.

    Open patterns lie in a list by the room they have left. Each length takes packs from the one with most
    room, as many as there are pieces. Where none has room for a piece a new one is opened, and as it has most room then, it
    takes pieces until it is full: so what is left over goes into packs of as many pieces as have room in one.
    """
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    most_room: list[int] = []

    def put(left: int, pattern: tuple[int, ...], count: int) -> None:
        if left not in open_by_room:
            open_by_room[left] = []
            heapq.heappush(most_room, -left)
        open_by_room[left].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count > 0:
            left = -most_room[0] if most_room else -1
            if left < length:
                each = room // length
                for pieces, packs in ((each, count // each), (count % each, 1)):
                    if pieces and packs:
                        put(room - pieces * length, (length,) * pieces, packs)
                break
            patterns = open_by_room[left]
            pattern, n = patterns.pop()
            if n > count:
                patterns.append((pattern, n - count))
            if not patterns:
                del open_by_room[left]
                heapq.heappop(most_room)
            used = min(n, count)
            put(left - length, (*pattern, length), used)
            count -= used
    return sorted((p, n) for patterns in open_by_room.values() for p, n in patterns)


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank, first sequence, offset): where pieces of a length go by rank."""
    rows, used, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, rank + count - 1, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    return rows


def _place(table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                first, at, off = table[int(length)]
                own = lengths == length
                k = np.searchsorted(first, ranks[own], "right") - 1
                sequence[own] = at[k] + ranks[own] - first[k]
                offset[own] = off[k]
            # The pieces travelled with ids in two bytes where these fit.
            ids = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in zip(batch.column("ids").to_pylist(), lengths.tolist(), strict=True)]
            columns = [pa.array(ids, pa.binary()) if c == "ids" else batch.column(c) for c in _PLACED[:5]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=_PLACED)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, room: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's for its whole text, then ``end_id``; a null or empty text gives
    ``end_id`` alone. Longer documents are cut after every ``room`` ids. Pieces lie in their sequence without
    gaps from 0. Each row is packed on its own, so ids may repeat or be null, and other columns are not
    read. An empty table gives no rows.

    Ranks are made without a global order: a task numbers its own pieces of each length, and the tasks'
    counts are summed up before it. The driver gets the histogram and makes the patterns: at most ``room``
    lengths, and a number of patterns that depends on them and not on the documents.
    """
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    pieces = materialize(texts.mapInArrow(_cut(tokenizer, end_id, room), _PIECES))
    counts = pieces.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table: dict[int, tuple] = {}
    for row in placements(shortest_pack_first(histogram, room)):
        for column, x in zip(table.setdefault(row[0], ([], [], [])), (row[1], row[3], row[4]), strict=True):
            column.append(x)
    table = {k: tuple(np.array(x, np.int64) for x in v) for k, v in table.items()}
    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "doc_tokens", (F.col("base") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(_place(table), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
