"""Matrices by classes of entities, against the same by cells."""

import random

import pytest
from pyspark.sql import functions as F

from braidwork.operators import kernels, twins


def dense(df):
    rows = df.collect()
    found = {(r["i"], r["j"]): r["k"] for r in rows}
    assert len(found) == len(rows)
    return found


def close(got, wanted, eps=1e-9):
    got, wanted = dense(got), dense(wanted)
    assert all(abs(got.get(x, 0.0) - wanted.get(x, 0.0)) < eps for x in got.keys() | wanted.keys())


@pytest.fixture
def groups(spark):
    r = random.Random(4)
    # Many alike, some in several complexes, some alone in one, and 36 to 39 in none.
    rows = [(i, c) for i in range(36) for c in {i % 3, *r.sample(range(3, 7), r.randint(0, 2))}] + [(0, 0), (35, 99), (34, None)]
    return spark.createDataFrame(rows, "i long, complex int"), spark.range(40).toDF("i")


def test_diffusion_by_classes(spark, groups):
    members, entities = groups
    wanted = kernels.diffusion(kernels.cliques(members.dropna()), 40, 0.3)
    for block in (512, 4):  # as a whole, and in blocks
        got = twins.diffusion(twins.cliques(members, entities), 0.3, block)
        assert got.own.count() < 30
        close(got.cells(most=5), wanted)


def test_fixup_by_classes(spark, groups):
    members, entities = groups
    plain = kernels.cliques(members.dropna()).where("i <> j")
    close(twins.fixup(twins.cliques(members, entities, 0.0)).cells(most=3), kernels.fixup(plain, 40), 1e-6)
    with pytest.raises(ValueError):
        twins.fixup(twins.cliques(members, own=0.0), tolerance=0.5)
    close(twins.fixup(twins.cliques(members, own=50.0)).cells(), kernels.cliques(members.dropna()).withColumn("k", F.when(F.col("i") == F.col("j"), 50.0).otherwise(1.0)))


def test_no_entities(spark):
    none = spark.createDataFrame([], "i long, complex int")
    assert twins.diffusion(twins.cliques(none)).cells().count() == 0 and twins.fixup(twins.cliques(none)).cells().count() == 0


def test_as_many_rows_as_classes(spark):
    """Diffusion and the smallest eigenvalue over 8,000 entities of two complexes are those of a matrix of two rows."""
    members = spark.range(8000).select(F.col("id").alias("i"), (F.col("id") % 2).alias("complex"))
    found = twins.diffusion(twins.cliques(members))
    assert found.own.count() == 2 and [r["k"] for r in found.between.collect()] == pytest.approx([1 / 4000] * 2)
    assert twins.lowest_eigenvalue(twins.cliques(members, own=0.0)) == pytest.approx(-1)


def test_cells_of_two_blocks_are_not_held_at_once(spark):
    rows = spark.range(60).select(F.col("id").alias("i"), (F.col("id") % 3).alias("complex"))
    made = twins.cliques(rows).cells(most=8)
    got = {(r.i, r.j) for r in made.collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if i % 3 == j % 3}
    stages = [line for line in made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Generate explode" in line]
    assert sorted("*(" in line for line in stages) == [False, True]
