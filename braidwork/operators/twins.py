"""Symmetric matrices whose entities fall into classes that rows and columns don't tell apart.

Entities of the same complexes have the same neighbours. A matrix (i, j, k) is then known by its cells between classes, and by
one cell of a member with itself. The differences of a class's members are eigenvectors, all of one eigenvalue; what is left
is a matrix of a row a class. So functions of it are computed by classes, and only their cells are as many as the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize
from . import blocks, kernels
from .network import TASK_PAIRS, broadcast_few, number

#: Members of a block of a class: a pair of blocks is a quarter of a task's pairs, so that tasks are about alike.
BLOCK_MEMBERS = 1024


@dataclass(frozen=True)
class Classes:
    """``members`` (i, c); ``between`` (a, b, k), both ways: the cell of two different members of a and b, no row where it is
    0; ``own`` (c, n, k): members of a class, and the cell of each with itself. Classes are numbered from 0."""

    members: DataFrame
    between: DataFrame
    own: DataFrame

    def joined(self) -> DataFrame:
        """``between`` with the numbers of members, na and nb."""
        n = broadcast_few(self.own.select("c", "n"))
        return self.between.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")

    def inner(self) -> DataFrame:
        """(c, n, k, other, e): with the cell of two different members of c, and the eigenvalue of their differences."""
        same = self.between.where("a = b").select(F.col("a").alias("c"), F.col("k").alias("other"))
        return self.own.join(same, "c", "left").withColumn("other", F.coalesce("other", F.lit(0.0))).withColumn("e", F.col("k") - F.col("other"))

    def quotient(self) -> DataFrame:
        """(i, j, k): the matrix on vectors that are alike within classes, by classes; it is symmetric."""
        apart = self.joined().where("a <> b").select(F.col("a").alias("i"), F.col("b").alias("j"), (F.sqrt(F.col("na").cast("double") * F.col("nb")) * F.col("k")).alias("k"))
        return apart.unionByName(self.inner().select(F.col("c").alias("i"), F.col("c").alias("j"), (F.col("k") + (F.col("n") - 1) * F.col("other")).alias("k")))

    def rounded(self, digits: int) -> Classes:
        """With rounded cells, which is done once a class and not once a cell."""
        return replace(self, between=self.between.withColumn("k", F.round("k", digits)), own=self.own.withColumn("k", F.round("k", digits)))

    def cells(self, most: int = BLOCK_MEMBERS) -> DataFrame:
        """(i, j, k): the cells that are not 0, each once.

        A class is dealt into blocks of about ``most`` members, and each pair of blocks is a row that holds both. These are
        spread over tasks by the number of pairs, which is counted, and a task makes the cells of its rows one by one.
        """
        sizes = self.own.select("c", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
        dealt = self.members.join(broadcast_few(sizes), "c").groupBy("c", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int").alias("x")).agg(F.collect_list("i").alias("held"))
        dealt = materialize(dealt)
        joined = materialize(self.joined().where("k <> 0"))
        total = joined.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0
        grid = joined.select("a", "b", "k").join(dealt.select(F.col("c").alias("a"), "x", F.col("held").alias("i")), "a").join(dealt.select(F.col("c").alias("b"), F.col("x").alias("y"), F.col("held").alias("j")), "b")
        grid = grid.repartition(max(1, -(-int(total) // TASK_PAIRS)), "a", "x", "b", "y")
        # Generated code holds all rows that it makes of one, so both explosions in one stage would hold the cells of two blocks
        # at a time. A function that has no generated code parts them: what is held then are the cells of one member.
        one = F.explode(F.transform("i", lambda x: x)).alias("i")
        apart = grid.select(one, "j", "k").select("i", F.explode("j").alias("j"), "k").where("i <> j")
        alone = self.members.join(broadcast_few(self.own.where("k <> 0").select("c", "k")), "c").select("i", F.col("i").alias("j"), "k")
        return apart.unionByName(alone)


def cliques(members: DataFrame, entities: DataFrame | None = None, own: float = 1.0) -> Classes:
    """Entities that share a complex (i, complex) have 1, and ``own`` with themselves; the same as ``kernels.cliques``. Of
    ``entities`` (i), if they are given, those without a complex make a class of their own, which has zeros."""
    sets = members.where("i IS NOT NULL AND complex IS NOT NULL").groupBy(F.col("i").cast("long").alias("i")).agg(F.sort_array(F.collect_set("complex")).alias("set"))
    if entities is not None:
        sets = entities.select(F.col("i").cast("long").alias("i")).distinct().join(sets, "i", "left")
    sets = materialize(sets)
    found = materialize(number(sets.where("set IS NOT NULL").select("set"), "set"))
    m = found.count()
    held = sets.join(broadcast_few(found), "set", "left").select("i", F.coalesce("index", F.lit(m)).alias("c"))
    held = materialize(held)
    between = kernels.cliques(found.select(F.col("index").alias("i"), F.explode("set").alias("complex"))).select(F.col("i").alias("a"), F.col("j").alias("b"), "k")
    sizes = held.groupBy("c").agg(F.count("*").alias("n")).withColumn("k", F.when(F.col("c") < m, F.lit(float(own))).otherwise(F.lit(0.0)))
    return Classes(held, materialize(between), materialize(sizes))


def exponential(matrix: Classes, block: int = blocks.BLOCK) -> Classes:
    """exp(M). See ``blocks.exponential``, which it is by classes."""
    found = materialize(blocks.exponential(matrix.quotient(), max(1, matrix.own.count()), block))
    inner = matrix.inner().select("c", "n", F.exp("e").alias("e"))
    diagonal = found.where("i = j").select(F.col("i").alias("c"), F.col("k").alias("q"))
    same = materialize(inner.join(diagonal, "c", "left").withColumn("k", (F.coalesce("q", F.lit(0.0)) - F.col("e")) / F.col("n")))
    counts = replace(matrix, between=found.where("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b"), "k")).joined()
    apart = counts.select("a", "b", (F.col("k") / F.sqrt(F.col("na").cast("double") * F.col("nb"))).alias("k"))
    within = same.where("n > 1 AND k <> 0").select(F.col("c").alias("a"), F.col("c").alias("b"), "k")
    return Classes(matrix.members, apart.unionByName(within), same.select("c", "n", (F.col("k") + F.col("e")).alias("k")))


def diffusion(adjacency: Classes, beta: float = 1.0, block: int = blocks.BLOCK) -> Classes:
    """exp(beta (A - D)), D holding the row sums of A; the same as ``kernels.diffusion``."""
    weight = adjacency.joined().groupBy(F.col("a").alias("c")).agg(F.sum(F.col("k") * F.col("nb")).alias("w"))
    own = adjacency.inner().join(weight, "c", "left").select("c", "n", (F.lit(float(beta)) * (F.col("other") - F.coalesce("w", F.lit(0.0)))).alias("k"))
    return exponential(Classes(adjacency.members, adjacency.between.withColumn("k", F.lit(float(beta)) * F.col("k")), materialize(own)), block)


def lowest_eigenvalue(matrix: Classes, block: int = blocks.BLOCK) -> float:
    found = matrix.inner().where("n > 1").agg(F.min("e")).first()[0]
    lowest = blocks.lowest_eigenvalue(matrix.quotient(), matrix.own.count(), block)
    return lowest if found is None else min(lowest, found)


def fixup(kernel: Classes, tolerance: float | None = None, block: int = blocks.BLOCK) -> Classes:
    """A smallest eigenvalue below 0 adds ten times its size to the diagonal; the same as ``kernels.fixup``."""
    lowest = lowest_eigenvalue(kernel, block)
    if tolerance is not None and lowest < -tolerance:
        raise ValueError(f"the smallest eigenvalue is {lowest}")
    most = max(kernel.between.agg(F.max(F.abs("k"))).first()[0] or 0.0, kernel.own.agg(F.max(F.abs("k"))).first()[0] or 0.0)
    if lowest >= -1e-12 * max(1.0, most):
        return kernel
    return replace(kernel, own=kernel.own.withColumn("k", F.col("k") - 10 * F.lit(lowest)))
