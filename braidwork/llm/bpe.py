"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For a fixed merge list the encoding of every prefix of a piece ends in exactly one token. Two tokens may
stand side by side in an encoding exactly if encoding their joint bytes gives the two back, and a token
sequence is an encoding exactly if all its neighbours may. So the last token of the prefix of length i is
the one among the vocabulary's suffixes of that prefix that is compatible with the last token of the prefix
before it. An automaton over all tokens gives the suffixes; back-pointers give the ids.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, rows_of, utf8

#: White space as the splitting pattern of the public tokenizers sees it.
_S = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
PIECES = regex.compile(_SPLIT.format(S=_S, L=r"\p{L}", N=r"\p{N}"))
#: Entries of a worker's tables; what is forgotten is worked out again.
CACHE = 300_000


def byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(c): b for b, c in [(b, b) for b in shown] + [(b, 256 + k) for k, b in enumerate(hidden)]}


@lru_cache(maxsize=1)
def _newer() -> tuple[regex.Pattern, regex.Pattern]:
    """Code points that the regex module takes for letters or digits and older Unicode versions don't know;
    and the splitting pattern without them."""
    unknown = "".join(c for c in map(chr, range(0x370, 0x110000)) if unicodedata.category(c) == "Cn")
    found = regex.findall(r"[\p{L}\p{N}]", unknown)
    ranges, start = [], 0
    for k in range(1, len(found) + 1):
        if k == len(found) or ord(found[k]) != ord(found[k - 1]) + 1:
            ranges.append(f"{found[start]}-{found[k - 1]}")
            start = k
    new = "".join(ranges) or "\ud800"
    known = {k: rf"[\p{{{k}}}--[{new}]]" for k in "LN"}
    split = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{known['L']}+| ?{known['N']}+| ?[^{_S}{known['L']}{known['N']}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
    return regex.compile(f"[{new}]"), regex.compile(split)


class Bpe:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        self.bytes_of: dict[int, bytes] = {i: bytes(chars[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: (left id, right id) -> rank; merged id -> (rank, left id, right id)
        self.merges = {(vocab[a], vocab[b]): rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.parts = {vocab[a + b]: (rank, vocab[a], vocab[b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.spines: tuple[dict, dict] = ({}, {})
        self.of_byte = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        made = {*self.parts, *self.of_byte.values()}
        self.automaton = ahocorasick.Automaton()
        for i in made:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]), i))
        self.automaton.make_automaton()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fits: dict[int, bool] = {}
        #: Pieces met lately, in two generations: when the younger is full, the older is forgotten.
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at one end of a token while merges build it, smallest first; side 0 is its left end.

        Each with the rank of the merge that takes it up, infinite for the token itself. Ranks ascend, as a
        merge is learnt after the two that made its parts.
        """
        found = self.spines[side].get(token)
        if found is None:
            found = [(token, math.inf)]
            while (parts := self.parts.get(found[-1][0])) is not None:
                found.append((parts[1 + side], parts[0]))
            self.spines[side][token] = found = found[::-1]
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the joint bytes of two tokens gives the two back.

        Merges run in the order of their ranks, so at any time one entry of the left token's right spine
        faces one of the right token's left spine. If the two can merge before either is taken up, the
        border is lost. Among equal ranks the leftmost goes first: the left token's own merge comes before
        the one over the border, that before the right token's own.
        """
        a, b = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = a[i], b[j]
            over = self.merges.get((x, y))
            if over is not None and over < until_x and over <= until_y:
                return False
            if until_x <= until_y:
                if until_x == math.inf:
                    return True
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece, without regard to what stands around it."""
        n = len(piece)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        fits = self.fits
        for at, (size, token) in self.automaton.iter(piece.decode("latin-1")):  # at each place the longest first
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = before << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) >= CACHE:
                        fits.clear()
                    fits[pair] = fit = self.compatible(before, token)
                if not fit:
                    continue
            last[end], back[end] = token, start
        ids, end = [], n
        while end > 0:
            if last[end] < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            ids.append(last[end])
            end = back[end]
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        newer, older = _newer()
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            mark = len(out)
            for piece in PIECES.findall(part):
                ids = known.get(piece)
                if ids is None:
                    if not piece.isascii() and newer.search(piece):  # it may be split otherwise; rare
                        out[mark:] = [i for p in older.findall(part) for i in self.encode_piece(p.encode("utf-8"))]
                        break
                    ids = self.older.get(piece)
                    if ids is None:
                        ids = self.encode_piece(piece.encode("utf-8"))
                    if len(piece) <= 64:
                        if len(known) >= CACHE:
                            self.older, self.known = known, {}
                            known = self.known
                        known[piece] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Ids that the vocabulary lacks are skipped; bytes that are no UTF-8 become U+FFFD."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """One a worker process."""
    return Bpe(path)


def _encode(path: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for rows in rows_of(batch):
                ids = [np.array(bpe.encode(t.decode("utf-8", "replace")), "<u4") for t in utf8(rows.column("text"))]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _decode(path: str, ids_col: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for rows in rows_of(batch, ids_col):
                texts = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in rows.column(ids_col).fill_null(b"").to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, "decoded"])

    return run


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit numbers) of every row.

    Special tokens' strings in a text become their ids, as the tokenizers library has it by default. A null
    text is empty and has no ids. Rows are encoded alone: ids may be null or repeat, other columns are not
    read, an empty table gives no rows. There is no shuffle.
    """
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(_encode(path), "doc_id long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the text that its ids spell, special tokens included, as ``decoded``.

    Null ids are none, and spell an empty text; ids that the vocabulary lacks are skipped. Rows are decoded alone; an empty
    table gives no rows. ``encoded`` is not to have a column ``decoded``.
    """
    fields = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(_decode(path, ids_col), fields)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
