"""Identity of sequences by banded global alignment, and clusters that are greedy by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize

#: Scores of an alignment's columns; of the best alignments one with most identities counts.
MATCH, MISMATCH, GAP = 2, -1, -2
#: Cells of the band of all pairs that are aligned together.
CELLS = 1 << 20
#: Scores are kept in units that leave room for a count of identities beside them.
_UNIT = 1 << 24
_NONE = -(1 << 60)


def identities(pairs: list[tuple[str, str]], band: int) -> np.ndarray:
    """Identical residues in a best global alignment of each pair, no residue being moved by more than ``band`` beyond what the lengths differ by.

    All pairs advance a residue of their shorter sequence at a time; a row of the table is computed for all of them at
    once, and gaps along a row by a running maximum.
    """
    if not pairs:
        return np.zeros(0, np.int64)
    short = [min(x, key=len) for x in pairs]
    long = [y if x is s else x for (x, y), s in zip(pairs, short, strict=True)]
    n, m = np.array([len(s) for s in short]), np.array([len(s) for s in long])
    low, width = -band, int((m - n).max(initial=0)) + 2 * band + 1  # of the place in the long one less that in the short one
    a = np.zeros((len(pairs), int(n.max(initial=0)) + 1), np.int32)
    b = np.full((len(pairs), int(n.max(initial=0)) + width + band + 2), -1, np.int32)
    for k, (s, t) in enumerate(zip(short, long, strict=True)):
        a[k, : len(s)] = np.frombuffer(s.encode("utf-32-le"), np.int32)
        b[k, band : band + len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    at = np.arange(width)
    gaps = at.astype(np.int64) * GAP * _UNIT
    place = at + low  # long residues used, at row 0
    row = np.where((place >= 0) & (place <= m[:, None]), place * GAP * _UNIT, _NONE).astype(np.int64)
    done = np.zeros(len(pairs), np.int64)
    ends = m - n - low  # where a pair's table ends in its last row
    for i in range(int(n.max(initial=0)) + 1):
        over = np.flatnonzero(n == i)
        done[over] = row[over, ends[over]]
        if i == n.max(initial=0):
            break
        same = b[:, i : i + width] == a[:, i, None]  # the long one's residue before each place, shifted by the band
        place = at + low + i + 1
        down = np.full_like(row, _NONE)
        down[:, :-1] = row[:, 1:] + GAP * _UNIT  # a residue of the short one beside a gap
        across = row + np.where(same, MATCH * _UNIT + 1, MISMATCH * _UNIT)
        best = np.maximum(down, np.where(place >= 1, across, _NONE))
        best = np.where((place >= 0) & (place <= m[:, None]), best, _NONE)
        row = np.maximum.accumulate(best - gaps, axis=1) + gaps
        row = np.where((place >= 0) & (place <= m[:, None]), np.maximum(row, _NONE), _NONE)
    return (done % _UNIT).astype(np.int64)


def _aligned(band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [*zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True)]
            sizes = [(min(len(x), len(y)) + 1) * (abs(len(x) - len(y)) + 2 * band + 1) for x, y in pairs]
            found, first, held = [], 0, 0
            for k, size in enumerate([*sizes, 0]):
                if k == len(pairs) or held and held + size > CELLS:
                    found.append(identities(pairs[first:k], band))
                    first, held = k, 0
                held += size
            short = np.array([min(len(x), len(y)) for x, y in pairs], np.float64)
            share = np.concatenate([*found, np.zeros(0)])[: len(pairs)] / np.maximum(short, 1)
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("q"), pa.array(share)], names=["p", "q", "identity"])

    return run


def word_size(threshold: float) -> int:
    """Words that two sequences of that identity are taken to share."""
    return 5 if threshold >= 0.7 else 4 if threshold >= 0.6 else 3 if threshold >= 0.5 else 2


def similar_pairs(sequences: DataFrame, threshold: float, k: int, band: int = 20) -> DataFrame:
    """(p, q, identity): pairs p < q of sequences (p, seq) of at least that identity to the shorter one.

    Aligned are pairs that share a word of ``k`` residues; similar sequences that share none are not found, which for the words
    of ``word_size`` is rare. A word that many sequences have is dealt into blocks.
    """
    from .network import pairs_within

    words = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substr("seq", i, F.lit(k))))
    rows = sequences.where(F.length("seq") >= k).select("p", "seq")
    grams = rows.select("p", F.explode(words).alias("g"))
    met = pairs_within(grams, "g", "p").where("a.p > b.p").select(F.col("b.p").alias("p"), F.col("a.p").alias("q")).distinct()
    met = met.join(rows.select("p", F.col("seq").alias("s")), "p").join(rows.select(F.col("p").alias("q"), F.col("seq").alias("t")), "q")
    found = met.select("p", "q", "s", "t").mapInArrow(_aligned(band), f"p {sequences.schema['p'].dataType.simpleString()}, q {sequences.schema['p'].dataType.simpleString()}, identity double")
    return found.where(F.col("identity") >= threshold)


def greedy_clusters(sequences: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p, representative): from the longest sequence on (ties: the smaller name), one is a representative unless it is similar to an earlier
    one, of which the first takes it.

    Settled in rounds: a sequence with no undecided one before it among its neighbours is decided.
    """
    rows = materialize(sequences.select("p", F.length("seq").alias("n")))
    place = rows.select("p", F.struct((-F.col("n")).alias("n"), F.col("p").alias("name")).alias("at"))
    both = pairs.select("p", "q").unionByName(pairs.select(F.col("q").alias("p"), F.col("p").alias("q")))
    ahead = both.join(place, "p").join(place.select(F.col("p").alias("q"), F.col("at").alias("before")), "q").where("before < at").select("p", "q", "before")
    ahead = materialize(ahead)
    left, out = materialize(place), None
    while not left.isEmpty():
        # Taken: a neighbour before is a representative, and none before that one is undecided.
        open_ = ahead.join(left.select("p"), "p", "left_semi")
        undecided = open_.join(left.select(F.col("p").alias("q")), "q", "left_semi").groupBy("p").agg(F.min("before").alias("first_open"))
        kept = None if out is None else open_.join(out.where("p = representative").select(F.col("p").alias("q")), "q", "left_semi").groupBy("p").agg(F.min("before").alias("first_kept"))
        state = left.join(undecided, "p", "left")
        state = state.withColumn("first_kept", F.lit(None).cast(state.schema["at"].dataType)) if kept is None else state.join(kept, "p", "left")
        taken = F.col("first_kept").isNotNull() & (F.col("first_open").isNull() | (F.col("first_kept") < F.col("first_open")))
        free = F.col("first_kept").isNull() & F.col("first_open").isNull()
        done = materialize(state.where(taken | free).select("p", F.when(taken, F.col("first_kept.name")).otherwise(F.col("p")).alias("representative")))
        out = done if out is None else materialize(out.unionByName(done))
        left = materialize(left.join(done.select("p"), "p", "left_anti"))
    return out if out is not None else rows.select("p", F.col("p").alias("representative"))


def redundancy_by_identity(sequences: DataFrame, threshold: float = 0.6, k: int | None = None, band: int = 20) -> DataFrame:
    """(p, representative) of sequences (p, seq), which are given once each; a sequence shorter than a word stands for itself."""
    rows = materialize(sequences.select("p", "seq"))
    return greedy_clusters(rows, materialize(similar_pairs(rows, threshold, k or word_size(threshold), band)))
