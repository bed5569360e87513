"""Features of sequences (i, s)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .strings import AMINO_ACIDS

_SMALL = "abcdefghijklmnopqrstuvwxyz"


def residues(sequences: DataFrame) -> DataFrame:
    """(i, pos, residue), positions from 0."""
    return sequences.where(F.length("s") > 0).select("i", F.posexplode(F.split("s", "")).alias("pos", "residue"))


def composition(sequences: DataFrame, properties: DataFrame, columns: list[str]) -> DataFrame:
    """Per residue the values of a property table (aa, ...); an unknown residue gets the table's means. Small letters count as capitals."""
    means = properties.agg(*[F.avg(c).alias(f"mean {c}") for c in columns])
    rows = residues(sequences.withColumn("s", F.translate("s", _SMALL, _SMALL.upper()))).join(F.broadcast(properties.select(F.col("aa").alias("residue"), *columns)), "residue", "left")
    return rows.crossJoin(F.broadcast(means)).select("i", "pos", *[F.coalesce(c, f"mean {c}").alias(c) for c in columns])


#: Residues of a sequence that are counted together.
STRETCH = 1 << 16


def entropies(codes: np.ndarray, letters: int, width: int, epsilon: float) -> np.ndarray:
    """The entropy at each residue of what lies up to ``width`` residues away; codes beyond the letters are not counted.

    Counts run on from residue to residue, so a window's are the difference of two of them, and its terms are looked up:
    a count is a whole number up to the window's size.
    """
    n = len(codes)
    ends, begins = np.minimum(np.arange(n) + width + 1, n), np.maximum(np.arange(n) - width, 0)
    smooth = np.arange(2 * width + 2) + epsilon
    plain, total = smooth * np.log(smooth), np.zeros(n)
    h = np.zeros(n)
    for letter in range(letters):
        upto = np.concatenate([[0], np.cumsum(codes == letter)])
        counts = upto[ends] - upto[begins]
        total += smooth[counts]
        h += plain[counts]
    h = np.log(total) - h / total
    return np.where(np.abs(h) < epsilon, 0.0, h)


def _low_complexity(windows: tuple[int, ...], alphabet: str, epsilon: float):
    code = {a: k for k, a in enumerate(alphabet)}
    reach = max(windows, default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in zip(batch.column("i"), batch.column("s").to_pylist(), strict=True):
                codes = np.array([code.get(x, len(alphabet)) for x in s or ""], np.int16)
                for a in range(0, len(codes), STRETCH):
                    b, low = min(a + STRETCH, len(codes)), max(0, a - reach)
                    part = codes[low : b + reach]
                    rows = [pa.array(entropies(part, len(alphabet), w, epsilon)[a - low : b - low]) for w in windows]
                    yield pa.RecordBatch.from_arrays([pa.repeat(i, b - a), pa.array(np.arange(a, b, dtype=np.int32)), *rows], names=["i", "pos", *[f"entropy_{w}" for w in windows]])

    return run


def low_complexity(sequences: DataFrame, windows: tuple[int, ...] = (8, 16, 32, 64, 128), alphabet: str = AMINO_ACIDS, epsilon: float = 1e-10) -> DataFrame:
    """Per residue the entropy of the composition of each centred window of 2w+1 residues, by one pass over each sequence.

    Frames end with the sequence, and letters are counted as they are written. A sequence is one row from the start, so
    nothing is shuffled; a long one is worked on in stretches that overlap by the widest window.
    """
    kind = sequences.schema["i"].dataType.simpleString()
    rows = sequences.select("i", F.col("s").cast("string").alias("s"))
    return rows.mapInArrow(_low_complexity(tuple(windows), alphabet, epsilon), ", ".join([f"i {kind}", "pos int", *[f"entropy_{w} double" for w in windows]]))


def summarised(sequences: DataFrame, get_phi: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Features of one's own: ``get_phi`` turns (i, s) into rows (i, pos, numbers), whose means by sequence are given."""
    return per_sequence(get_phi(sequences))


def per_sequence(phi: DataFrame) -> DataFrame:
    """Means over the residues of each sequence."""
    return phi.groupBy("i").agg(*[F.avg(c).alias(c) for c in phi.columns if c not in ("i", "pos")])
