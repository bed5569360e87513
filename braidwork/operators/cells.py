"""Kernel cells of sparse vectors (i, f, v), summed where they are made: by pairs of blocks of entities, which share no cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .network import broadcast_few, number

#: Entities of a block; a task holds the sums of two blocks (32 MB a kind), whatever their features.
SIDE = 2048
#: Rows whose features are paired at once, pairs that are listed at once, and features of a dense product.
CHUNK, LISTED, COLUMNS = 1 << 18, 1 << 21, 512
#: Cells of a row that come one after the other, before the same cells turned round.
RUN = 32
#: What two rows of a feature add to their cell. Of "cross", which is taken alone, the larger entity's value is its ``u`` and not its ``v``.
KINDS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"product": np.multiply, "least": np.minimum, "common": lambda a, b: np.ones(len(a)), "cross": np.multiply}


def both_ways(a: np.ndarray, b: np.ndarray, values: dict[str, np.ndarray], counts: np.ndarray, type_: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(i, j, values): the cells of rows ``a`` and columns ``b`` that ``counts`` tells of, and the same turned round; one with itself once.

    Cells are quadratic, so what is written of them is to be small. They come in runs of one row and ascending columns, and each
    run is followed by its mirror: names are then repeated or the same series again, and a value lies near its copy, which
    encodings and codecs of files of columns make use of.
    """
    for at in range(0, len(b), RUN):
        r, c = np.nonzero(counts[:, at : at + RUN])
        if not len(r):
            continue
        first, second = a[r], b[at + c]
        turned = np.flatnonzero(first != second)
        own, more = np.bincount(r, minlength=len(a)), np.bincount(r[turned], minlength=len(a))
        start, x = np.cumsum(own + more) - own - more, r[turned]
        place = (start - np.cumsum(own) + own)[r] + np.arange(len(r))
        mirrored = (start + own - np.cumsum(more) + more)[x] + np.arange(len(x))
        columns = []
        for straight, back in ((first, second), (second, first), *[(m[:, at : at + RUN][r, c],) * 2 for m in values.values()]):
            out = np.empty(len(r) + len(x), straight.dtype)
            out[place], out[mirrored] = straight, back[turned]
            columns.append(out)
        yield pa.RecordBatch.from_arrays([*[pa.array(n, type_) for n in columns[:2]], *map(pa.array, columns[2:])], names=["i", "j", *values])


class _Block:
    """The sums of the entities of two blocks; the larger ones are rows. Rows come by feature, a feature's all together."""

    def __init__(self, kinds: list[str], one: bool, side: int) -> None:
        self.kinds, self.one, self.side = kinds, one, side
        self.sums = {k: np.zeros((side, side)) for k in kinds}
        self.names: list[np.ndarray | None] = [None, None]

    def add(self, rows: pa.Table) -> None:
        f = rows.column("f").combine_chunks().dictionary_encode()
        code, n = f.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(f.dictionary)
        high, place = (rows.column(c).to_numpy() for c in ("high", "place"))
        v, i = rows.column("v").to_numpy(), rows.column("i").to_numpy()
        sides = []
        for k in (True, False):
            own = np.arange(len(code)) if self.one else np.flatnonzero(high == k)
            if self.names[k] is None:
                self.names[k] = np.zeros(self.side, i.dtype)
            self.names[k][place[own]] = i[own]
            values = rows.column("u").to_numpy() if k and "cross" in self.kinds else v
            sides.append((code[own], place[own], values[own], np.bincount(code[own], minlength=n)))
        (ca, pa_, va, na), (cb, pb, vb, nb) = sides
        met = na * nb
        dense = met * 64 > self.side * self.side
        for kind in self.kinds:
            if kind != "least":
                self.multiply(kind, np.flatnonzero(dense), sides, n)
            here = np.flatnonzero((met[ca] > 0) & (True if kind == "least" else ~dense[ca]))
            first = np.concatenate([[0], np.cumsum(nb)])
            times = nb[ca[here]]
            ends = np.cumsum(times)
            at = 0
            while at < len(here):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LISTED, "right")))
                some, many = here[at:stop], times[at:stop]
                a = np.repeat(some, many)
                b = np.repeat(first[ca[some]] - np.cumsum(many) + many, many) + np.arange(len(a))
                np.add.at(self.sums[kind].reshape(-1), pa_[a] * self.side + pb[b], KINDS[kind](va[a], vb[b]))
                at = stop

    def multiply(self, kind: str, features: np.ndarray, sides: list, n: int) -> None:
        for at in range(0, len(features), COLUMNS):
            some = features[at : at + COLUMNS]
            column = np.full(n, -1)
            column[some] = np.arange(len(some))
            both = []
            for code, place, v, _ in sides:
                m, own = np.zeros((self.side, len(some))), np.flatnonzero(column[code] >= 0)
                np.add.at(m, (place[own], column[code[own]]), 1.0 if kind == "common" else v[own])
                both.append(m)
            self.sums[kind] += both[0] @ both[1].T

    def cells(self, type_: pa.DataType, both: bool) -> Iterator[pa.RecordBatch]:
        """The cells that are not zero, i being the larger entity's name, or ``both`` ways."""
        strip = max(1, (1 << 19) // self.side)
        for at in range(0, self.side, strip):
            values = {k: m[at : at + strip] for k, m in self.sums.items()}
            some = np.logical_or.reduce([m != 0 for m in values.values()])
            if self.one:
                some &= np.arange(at, at + len(some))[:, None] >= np.arange(self.side)[None, :]
            if both:
                if some.any():
                    yield from both_ways(self.names[True][at : at + strip], self.names[False], values, some, type_)
                continue
            i, j = np.nonzero(some)
            if len(i):
                sums = [pa.array(m[i, j]) for m in values.values()]
                yield pa.RecordBatch.from_arrays([pa.array(self.names[True][at + i], type_), pa.array(self.names[False][j], type_), *sums], names=["i", "j", *self.sums])


def _run(kinds: list[str], side: int, type_: pa.DataType, both: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key, held, size = None, None, [], 0

        def full(last: bool) -> None:
            """Adds what is held; unless it is the block's last, the last feature may go on and waits."""
            nonlocal held, size
            rows = pa.Table.from_batches(held)
            stop = rows.num_rows
            if not last:
                f = rows.column("f").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                stop = int(np.searchsorted(f, f[-1]))
            if stop:
                block.add(rows.slice(0, stop))
            held = rows.slice(stop).to_batches()
            size = rows.num_rows - stop

        for batch in batches:
            if not batch.num_rows:
                continue
            low, top = (batch.column(c).to_numpy() for c in ("low", "top"))
            cuts = [0, *(np.flatnonzero((low[1:] != low[:-1]) | (top[1:] != top[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (low[a], top[a]) != key:
                    if block is not None:
                        full(True)
                        yield from block.cells(type_, both)
                    key, block, held, size = (low[a], top[a]), _Block(kinds, low[a] == top[a], side), [], 0
                held.append(batch.slice(a, b - a))
                size += b - a
                if size >= CHUNK:
                    full(False)
        if block is not None:
            full(True)
            yield from block.cells(type_, both)

    return run


def by_blocks(features: DataFrame, kinds: list[str], side: int | None = None, both: bool = False) -> DataFrame:
    """(i, j, a column for each of ``KINDS``) with i >= j, or ``both`` ways: what all pairs of rows that share a feature add up to.

    Entities are numbered and cut into blocks. A row travels once to each block that its own meets, which are as many as there
    are blocks; each pair of blocks is summed by one task, feature by feature, and no cell is shuffled.
    """
    side = side or SIDE
    spark = features.sparkSession
    places = number(features.select("i").where("i IS NOT NULL"), "i")
    blocks = max(1, -(-places.count() // side))
    values = ["v", "u"] if "cross" in kinds else ["v"]
    rows = features.where("f IS NOT NULL").select("i", "f", *[F.col(c).cast("double").alias(c) for c in values]).join(broadcast_few(places), "i")
    own = F.floor(F.col("index") / side).cast("int")
    rows = rows.select("i", "f", *values, own.alias("own"), F.pmod("index", F.lit(side)).cast("long").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("met"))
    low, top = F.least("own", "met"), F.greatest("own", "met")
    rows = rows.select(low.alias("low"), top.alias("top"), (F.col("own") > F.col("met")).alias("high"), "place", "i", "f", *values)
    pairs = blocks * (blocks + 1) // 2
    type_ = features.schema["i"].dataType
    schema = T.StructType([T.StructField(c, type_) for c in "ij"] + [T.StructField(k, T.DoubleType()) for k in kinds])
    dealt = rows.repartition(pairs, "low", "top").sortWithinPartitions("low", "top", "f")
    return dealt.mapInArrow(_run(kinds, side, to_arrow_type(type_), both), schema)
