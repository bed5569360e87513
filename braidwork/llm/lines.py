"""Line deduplication: lines that many documents share stay in one of them only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, lean, materialize, rows_of, utf8

_STRIP = SPACE.encode()


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key, or nothing if the key is too short to count.

    ``bytes.lower`` lowers A-Z only, as wanted.
    """
    key = line.strip(_STRIP).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def _keys(min_chars: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, "text", 8 << 20):
                ids, found = [], []
                for i, text in zip(rows.column("id").to_pylist(), utf8(rows.column("text")), strict=True):
                    keys = {k for line in text.split(b"\n") if (k := _key(line, min_chars)) is not None}
                    ids += [i] * len(keys)
                    found += keys
                halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["id", "k0", "k1"])

    return run


def _rewrite(min_chars: int, text_col: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, batch.column("row").field(text_col), 8 << 20):
                n_lines, n_dropped, texts = [], [], []
                for text, drop in zip(utf8(rows.column("row").field(text_col)), rows.column("drop").to_pylist(), strict=True):
                    lines = text.split(b"\n")
                    n_lines.append(len(lines))
                    kept = None
                    if drop:
                        gone = {np.array([x["k0"], x["k1"]], np.int64).tobytes() for x in drop}
                        lines = [x for x in lines if _key(x, min_chars) not in gone]
                        kept = b"\n".join(lines)
                    n_dropped.append(n_lines[-1] - len(lines))
                    texts.append(kept)
                out = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([rows.column("row"), *out], names=["row", "n_lines", "n_dropped", "kept_text"])

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` as a struct ``row``, with n_lines, n_dropped and kept_text beside it.

    A text is cut at ``\\n``. A line's key is the line without white space at its ends and with A-Z lowered.
    Keys of at least ``min_chars`` code points that are found in at least ``min_docs`` documents lose all
    their lines except those in the largest id that holds them. What stays is joined by ``\\n`` in its
    order. A null or empty text is one empty line. A row whose id is null loses nothing and is not counted.
    Rows that repeat an id are one document for the counts. Since the row travels as a struct, any column
    names are fine. Empty tables give no rows.

    Keys are read once, each document sending a key once: only (id, 128-bit key) pairs are checkpointed and
    shuffled. The count is distinct by (key, id) first, so a line that a third of all documents hold is dealt out by id
    and summed before its key meets in one place. The repeated keys are checkpointed before they are joined back, so
    that both sides of that join are shuffled for it alone, and adaptive execution splits a hot key's pairs.
    """
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"))
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id IS NOT NULL")
    pairs = materialize(texts.mapInArrow(_keys(min_chars), "id long, k0 long, k1 long"))
    repeated = pairs.groupBy("k0", "k1").agg(F.countDistinct("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    repeated = materialize(repeated.select("k0", "k1", "last"))
    dropped = (
        pairs.join(repeated, ["k0", "k1"])
        .where("id <> last")
        .groupBy("id")
        .agg(F.collect_set(F.struct("k0", "k1")).alias("drop"))
    )
    fields = T.StructType([base.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("new_text", T.StringType())])
    done = base.join(dropped, "id", "left").select("row", "drop").mapInArrow(_rewrite(min_chars, text_col), fields)
    return done.select("row", "n_lines", "n_dropped", F.coalesce("new_text", F.col("row")[text_col], F.lit("")).alias("kept_text"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """``docs`` with the text rewritten; n_chars, if there is such a column, follows the text.

    All rows and columns stay, whatever their names; a null text stays null, a row without id unchanged, and rows that
    repeat an id are rewritten alike. An empty table gives no rows. See ``drop_repeated_lines``.
    """
    done = drop_repeated_lines(docs, id_col, text_col, **limits)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row")[text_col])
    change = {text_col: text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return done.select(*[change.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
