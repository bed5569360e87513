"""Exact deduplication by a distributed sort of the normalised contents.

Spark samples splitters and deals the rows out by (prefix, hash, doc_id) of the normalised text, so that a group
of copies, however large, spreads over as many tasks as its share of the rows asks for. Each task sorts its range
externally and compares neighbours in full. A group that runs over the end of a range is put together from
its parts' first rows: at most two rows a task, whatever the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_REGEX, lean, materialize, shuffle_partitions

#: Tasks of the sort up to which what joins their ranges is broadcast (some ten MB).
BROADCAST_TASKS = 100_000
_RUNS = "id long, part int, run long, head boolean, low long, size long, digest string, edge string"


@lean
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts of one sorted range."""
    part = TaskContext.get().partitionId()
    done = 0
    text: bytes | None = None
    pending: list[pa.Array] = []

    def rows(ids: pa.Array, sizes: np.ndarray, first_run: int, texts: list[bytes], edge: bool) -> pa.RecordBatch:
        heads = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        of = np.repeat(np.arange(len(sizes)), sizes)
        is_head = np.zeros(len(ids), bool)
        is_head[heads] = True
        edges: list[str | None] = [None] * len(ids)
        if edge or first_run == 0:
            edges[0] = texts[0].decode("utf-8", "replace")
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(np.full(len(ids), part, np.int32)),
                pa.array(first_run + of),
                pa.array(is_head),
                ids.take(pa.array(heads)).take(pa.array(of)),
                pa.array(sizes[of].astype(np.int64)),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]).take(pa.array(of)),
                pa.array(edges, pa.string()),
            ],
            names=["id", "part", "run", "head", "low", "size", "digest", "edge"],
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, content = batch.column("id"), batch.column("norm").cast(pa.binary())
        new = np.ones(n, bool)
        new[0] = text is None or content[0].as_py() != text
        if n > 1:
            new[1:] = pc.not_equal(content.slice(1), content.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(new)
        if not len(heads):
            pending.append(ids)
            continue
        if text is not None:
            pending.append(ids.slice(0, int(heads[0])))
            whole = pa.concat_arrays(pending)
            yield rows(whole, np.array([len(whole)]), done, [text], False)
            done += 1
        if len(heads) > 1:
            closed = content.take(pa.array(heads[:-1])).to_pylist()
            yield rows(ids.slice(int(heads[0]), int(heads[-1] - heads[0])), np.diff(heads), done, closed, False)
            done += len(heads) - 1
        text, pending = content[int(heads[-1])].as_py(), [ids.slice(int(heads[-1]))]
    if text is not None:
        whole = pa.concat_arrays(pending)
        yield rows(whole, np.array([len(whole)]), done, [text], True)


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space has become one space; a null text is
    empty. ``keep_id`` is the smallest id of the group and exactly one row of a group is kept: the one with
    that id. Of rows that repeat both id and text one is kept. A null id counts as larger than any other, so
    such a row stays only if its whole group has no id (keep_id is null then). Empty tables give no rows.
    Further columns of ``docs`` are not read, whatever their names.
    """
    n = partitions or shuffle_partitions(docs.sparkSession)
    norm = F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), SPACE_REGEX, " ")
    rows = docs.select(docs[id_col].cast("long").alias("id"), norm.alias("norm"))
    # A splitter, of which the driver samples many, is a short prefix and a hash, not a whole text.
    rows = rows.withColumns({"prefix": F.substring("norm", 1, 24), "hash": F.xxhash64("norm")})
    last = F.col("id").asc_nulls_last()
    rows = rows.repartitionByRange(n, "prefix", "hash", last).sortWithinPartitions("prefix", "hash", "norm", last).select("id", "norm")
    # The splitters are sampled anew whenever the plan is planned again, and both uses below must agree.
    rows = materialize(rows.mapInArrow(_runs, _RUNS))
    joint = (
        rows.where("edge IS NOT NULL")
        .groupBy("edge")
        .agg(F.min("low").alias("all_low"), F.sum("size").alias("all_size"), F.collect_list(F.struct("part", "run")).alias("places"))
        .where(F.size("places") > 1)
        .select(F.explode("places").alias("place"), F.array_min("places").alias("first"), "all_low", "all_size")
        .select("place.*", "first", "all_low", "all_size")
    )
    # At most two rows of six numbers a task of the sort, so the number of partitions says whether it is small.
    rows = rows.join(F.broadcast(joint) if n <= BROADCAST_TASKS else joint, ["part", "run"], "left")
    return rows.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("first").isNull(), F.col("low")).otherwise(F.col("all_low")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("head") & F.coalesce(F.struct("part", "run") == F.col("first"), F.lit(True))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
