"""String kernels: counts of (near) k-mers per string, then a sparse linear kernel over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import sparse_linear

# The amino acids by letter, and by their place in position-specific scoring matrices.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
PSSM_ORDER = "ARNDCQEGHILKMFPSTWYV"
# The amino acids' three-letter names, and how frequent they are in sequences, by letter.
THREE_LETTERS = {
    "A": "ALA", "C": "CYS", "D": "ASP", "E": "GLU", "F": "PHE", "G": "GLY", "H": "HIS", "I": "ILE", "K": "LYS", "L": "LEU",
    "M": "MET", "N": "ASN", "P": "PRO", "Q": "GLN", "R": "ARG", "S": "SER", "T": "THR", "V": "VAL", "W": "TRP", "Y": "TYR",
}
BACKGROUND = {
    "A": 0.0799912015849807, "C": 0.0171846021407367, "D": 0.0578891399707563, "E": 0.0638169929675978, "F": 0.0396348024787477,
    "G": 0.0760659374742852, "H": 0.0223465499452473, "I": 0.0550905793661343, "K": 0.060458245507428, "L": 0.0866897071203864,
    "M": 0.0215379186368154, "N": 0.044293531582512, "P": 0.0465746314476874, "Q": 0.0380578923048682, "R": 0.0484482507611578,
    "S": 0.0630028230885602, "T": 0.0580394726014824, "V": 0.0700241481678408, "W": 0.0144991866213453, "Y": 0.03635438623143,
}


def three_letter(code: Column) -> Column:
    """The three-letter name of an amino acid's letter; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in THREE_LETTERS.items() for x in pair]), code)


def one_letter(name: Column) -> Column:
    """The letter of a three-letter name; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for one, three in THREE_LETTERS.items() for x in (three, one)]), name)


def check_arguments(strings: DataFrame, k: int, alphabet: str) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")
    if len(set(alphabet)) < 2:
        raise ValueError("the alphabet needs two symbols")
    if not strings.where(F.length("s") < k).isEmpty():
        raise ValueError("a string is shorter than k")


def kmers(strings: DataFrame, k: int) -> DataFrame:
    """All instances (i, offset, kmer) of strings (i, s)."""
    fits = strings.where(F.length("s") >= k)
    return fits.select("i", "s", F.explode(F.sequence(F.lit(1), F.length("s") - k + 1)).alias("offset")).select("i", (F.col("offset") - 1).alias("offset"), F.substr("s", F.col("offset"), F.lit(k)).alias("kmer"))


def _gram(counts: DataFrame, least: int) -> DataFrame:
    """Kernel of (i, f, v); leaves with fewer than ``least`` instances over all strings don't count."""
    if least > 1:
        counts = counts.join(counts.groupBy("f").agg(F.sum("v").alias("n")).where(F.col("n") >= least), "f", "left_semi")
    return sparse_linear(counts)


def spectrum_counts(strings: DataFrame, k: int, alphabet: str = AMINO_ACIDS) -> DataFrame:
    inside = F.translate("kmer", alphabet, "") == ""
    return kmers(strings, k).where(inside).groupBy("i", F.col("kmer").alias("f")).agg(F.count("*").cast("double").alias("v"))


def spectrum(strings: DataFrame, k: int, alphabet: str = AMINO_ACIDS, least: int = 1) -> DataFrame:
    """Common k-mers over the alphabet."""
    check_arguments(strings, k, alphabet)
    return _gram(spectrum_counts(strings, k, alphabet), least)


def by_expansion(strings: DataFrame, k: int, expand: Callable[[DataFrame], DataFrame], least: int = 1) -> DataFrame:
    """A string kernel of one's own: ``expand`` turns different k-mers (kmer) into the leaves that they reach, (kmer, f)."""
    counts = kmers(strings, k).groupBy("i", "kmer").agg(F.count("*").cast("double").alias("v"))
    # The reach of a k-mer depends on it alone: different ones are expanded once.
    reached = counts.join(expand(counts.select("kmer").distinct()), "kmer").groupBy("i", "f").agg(F.sum("v").alias("v"))
    return _gram(reached, least)


def mismatch(strings: DataFrame, k: int, m: int = 1, alphabet: str = AMINO_ACIDS, least: int = 1) -> DataFrame:
    """k-mers within Hamming distance m. Different k-mers are expanded once, level by level, pruned at m."""
    check_arguments(strings, k, alphabet)

    def near(different: DataFrame) -> DataFrame:
        level = different.select("kmer", F.lit("").alias("leaf"), F.lit(0).alias("mm"))
        symbols = F.explode(F.array(*[F.lit(a) for a in alphabet]))
        for d in range(1, k + 1):
            level = level.select("kmer", "leaf", "mm", symbols.alias("a"))
            level = level.select("kmer", F.concat("leaf", "a").alias("leaf"), (F.col("mm") + (F.substring("kmer", d, 1) != F.col("a")).cast("int")).alias("mm")).where(F.col("mm") <= m)
        return level.select("kmer", F.col("leaf").alias("f"))

    return by_expansion(strings, k, near, least)


def profile(profiles: DataFrame, k: int, threshold: float = 6.0, alphabet: str = AMINO_ACIDS, least: int = 1) -> DataFrame:
    """Leaves whose cost, summed over k successive positions, is at most the threshold.

    ``profiles`` is (i, pos, residue, scores), scores by the alphabet's order and not negative, so a branch
    whose sum is over the threshold already is dropped at once.
    """
    if k < 1 or len(set(alphabet)) < 2:
        raise ValueError("k must be at least 1 and the alphabet needs two symbols")
    symbols = F.array(*[F.lit(a) for a in alphabet])
    scores = profiles.select("i", "pos", F.posexplode("scores").alias("at", "cost")).select("i", "pos", F.get(symbols, F.col("at")).alias("a"), "cost")
    level = scores.where(F.col("cost") <= threshold).select("i", F.col("pos").alias("offset"), F.col("a").alias("leaf"), F.col("cost").alias("total"))
    for d in range(1, k):
        step = scores.select("i", (F.col("pos") - d).alias("offset"), "a", "cost")
        level = level.join(step, ["i", "offset"]).select("i", "offset", F.concat("leaf", "a").alias("leaf"), (F.col("total") + F.col("cost")).alias("total")).where(F.col("total") <= threshold)
    return _gram(level.groupBy("i", F.col("leaf").alias("f")).agg(F.count("*").cast("double").alias("v")), least)
