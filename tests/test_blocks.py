"""Matrices in blocks, and pairs within large groups."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from braidwork.operators import blocks, folds, kernels, network


def cells(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame(pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "k": pa.array(np.asarray(m)[i, j], pa.float64())}))


def dense(df, n):
    t = df.toArrow()
    out = np.zeros((n, n))
    np.add.at(out, tuple(t.column(c).to_numpy() for c in ("i", "j")), t.column("k").to_numpy())
    return out


def test_products_and_sums(spark):
    g = np.random.default_rng(2)
    a, b = ((g.random((23, 23)) < 0.2) * g.standard_normal((23, 23)) for _ in range(2))
    a[:8] = 0  # a missing row of blocks
    x, y = (blocks.to_blocks(cells(spark, m), 5) for m in (a, b))
    assert np.allclose(dense(blocks.to_cells(x, 5), 23), a)
    assert np.allclose(dense(blocks.to_cells(blocks.multiply(x, y, 23, 5), 5), 23), a @ b)
    assert np.allclose(dense(blocks.to_cells(blocks.combine((2.0, x), (-1.0, y), (1.0, blocks.identity(spark, 23, 5))), 5), 23), 2 * a - b + np.eye(23))
    assert blocks.to_cells(blocks.multiply(x, blocks.to_blocks(cells(spark, np.zeros((23, 23))), 5), 23, 5), 5).count() == 0


def test_exponential_within_its_bound(spark):
    g = np.random.default_rng(1)
    a = (g.random((30, 30)) < 0.2) * g.random((30, 30))
    a = a + a.T
    laplacian = a - np.diag(a.sum(axis=1))
    values, vectors = np.linalg.eigh(3 * laplacian)
    wanted = (vectors * np.exp(values)) @ vectors.T
    norm = np.abs(3 * laplacian).sum(axis=0).max()
    assert blocks.remainder(norm) < 1e-15 and blocks.remainder(0.5) < 1e-15 and blocks.remainder(0.0) == 0
    for block in (40, 12):
        assert np.abs(dense(kernels.diffusion(cells(spark, a), 30, 3.0, block), 30) - wanted).max() < 1e-12
    assert np.array_equal(dense(blocks.exponential(cells(spark, np.zeros((3, 3))), 3), 3), np.eye(3))


@pytest.mark.parametrize("kind", ["gaussian", "singular", "copies of one value"])
def test_lowest_eigenvalue(spark, kind):
    g = np.random.default_rng(4)
    m = g.standard_normal((24, 24))
    m = {"gaussian": m + m.T, "singular": m[:, :4] @ m[:, :4].T, "copies of one value": np.ones((24, 24)) - 3 * np.eye(24)}[kind]
    wanted = np.linalg.eigvalsh(m)[0]
    for block in (32, 16):
        assert abs(blocks.lowest_eigenvalue(cells(spark, m), 24, block) - wanted) < 1e-6
    if kind != "gaussian":
        fixed = dense(kernels.fixup(cells(spark, m), 24, block=16), 24)
        assert np.allclose(fixed, m + (30 * np.eye(24) if kind != "singular" else 0), atol=1e-6)


def test_lowest_eigenvalue_of_little(spark):
    assert blocks.lowest_eigenvalue(cells(spark, np.zeros((5, 5))), 5) == 0 == blocks.lowest_eigenvalue(cells(spark, np.zeros((5, 5))), 5, 2)
    assert blocks.lowest_eigenvalue(cells(spark, -np.eye(5)), 5, 2) == pytest.approx(-1) and blocks.lowest_eigenvalue(cells(spark, np.eye(1)), 1) == pytest.approx(1)
    with pytest.raises(ValueError, match="not known"):
        m = np.random.default_rng(0).standard_normal((20, 20))
        blocks.lowest_eigenvalue(cells(spark, m + m.T), 20, 10, most_steps=2)


# A key that all rows have.


def test_pairs_of_a_large_group_lie_in_a_grid(spark):
    rows = spark.range(300).select(F.col("id").alias("i"), F.lit("all").alias("f")).unionByName(spark.createDataFrame([(0, "few"), (5, "few"), (7, "one")], "i long, f string"))
    pairs = network.pairs_within(rows, "f", "i", most=20, summary={"n": F.count("*")})
    got = Counter((r["f"], r["a"]["i"], r["b"]["i"], r["n"]) for r in pairs.collect())
    assert got == Counter([("all", i, j, 300) for i in range(300) for j in range(i + 1)] + [("few", 0, 0, 2), ("few", 5, 5, 2), ("few", 5, 0, 2), ("one", 7, 7, 1)])
    assert max(pairs.select(F.spark_partition_id().alias("t"), "f").groupBy("t").count().toPandas()["count"]) < 45_450  # no task has them all


def test_hot_features_give_the_same_kernels(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, f, float(r.randint(1, 3))) for i in range(60) for f in ["hot", *r.sample("abcdefgh", 2)]]
    features = spark.createDataFrame(rows, "i long, f string, v double")
    small = [dense(k(features), 60) for k in (kernels.sparse_linear, kernels.intersection)] + [dense(kernels.set_intersection(features.withColumnRenamed("f", "item")), 60)]
    places = features.select("i", F.lit("c").alias("chrom"), (F.col("i") * F.col("i")).alias("pos")).distinct()
    near = dense(kernels.colocalization(places), 60)
    monkeypatch.setattr(kernels, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(kernels, "pairs_within", lambda *a, **b: network.pairs_within(*a, **b, most=7))
    large = [dense(k(features), 60) for k in (kernels.sparse_linear, kernels.intersection)] + [dense(kernels.set_intersection(features.withColumnRenamed("f", "item")), 60)]
    assert all(np.array_equal(x, y) for x, y in zip(small, large, strict=True))
    assert np.allclose(near, dense(kernels.colocalization(places), 60)) and np.allclose(near[3, 7], np.exp(-40 / 59**2))
    members = features.select("i", F.lit("x").alias("complex")).distinct()
    assert kernels.cliques(members).count() == 3600


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("p")).repartition(7)
    got = network.number(rows.unionByName(rows.limit(10)), "p").collect()
    assert [r["p"] for r in sorted(got, key=lambda r: r["index"])] == sorted(r["p"] for r in rows.collect()) and sorted(r["index"] for r in got) == list(range(1000))
    assert network.number(rows.limit(0), "p").count() == 0


def test_pairs_are_dealt_out_by_their_number(spark, monkeypatch):
    """Few bytes of entities make many pairs: adaptive execution is not to gather them in a task or two."""
    monkeypatch.setattr(network, "TASK_PAIRS", 5_000)
    rows = spark.range(500).select(F.col("id").alias("p"), (F.col("id") % 2).alias("g"))
    monkeypatch.setattr(network.pairs_within, "__defaults__", (20, None))
    pairs = network.co_members(rows)
    tasks = pairs.select(F.spark_partition_id().alias("t")).groupBy("t").count().collect()
    assert sum(x["count"] for x in tasks) == 500 * 249 // 2 and len(tasks) >= 10 and max(x["count"] for x in tasks) < 20_000
    assert "Exchange" not in network.symmetrize(pairs, once=True)._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
    twice = network.co_members(rows.unionByName(rows.withColumn("g", F.col("g") + 2)))
    assert twice.count() == twice.distinct().count() == 500 * 249 // 2
    labels = kernels.label_kernel(rows.select(F.col("p").alias("i"), F.col("g").alias("y")))
    assert labels.count() == 250**2


def test_folds_are_cut_where_a_sort_would_cut_them(spark, monkeypatch):
    monkeypatch.setattr(folds, "STRETCH", 7)
    pairs = spark.range(900).select((F.col("id") % 30).alias("p"), (30 + F.floor(F.col("id") / 30)).alias("q"))
    got = {(r["p"], r["q"]): r["fold"] for r in folds.chunk(pairs, 7, seed=3, once=True).collect()}
    key = lambda x: hashlib.md5(f"3|{x[0]}|{x[1]}".encode()).hexdigest() + f"|{x[0]}|{x[1]}"
    assert got == {x: min(n // (900 // 7), 6) for n, x in enumerate(sorted(got, key=key))} and len(got) == 900
    assert got == {(r["p"], r["q"]): r["fold"] for r in folds.chunk(pairs.unionByName(pairs), 7, seed=3).collect()}


def test_asymmetric_pairs_keep_their_rows(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (5, 4), (5, 4), (3, 3), (None, 4), (6, 7)], "p int, q int")
    got = Counter((r["p"], r["q"]) for r in network.asymmetric(pairs).collect())
    assert got == Counter([(5, 4), (5, 4), (None, 4), (6, 7)])
    assert network.canonical(network.symmetrize(pairs.where("p < q").where("p > 5"), once=True), symmetric=True).collect() == [(6, 7)]


def test_cells_are_summed_by_blocks(spark, monkeypatch):
    """All kinds, of numbers and names, with features that all entities have and with those that few have; no cell is shuffled."""
    from braidwork.operators import cells as by

    monkeypatch.setattr(by, "CHUNK", 50)
    monkeypatch.setattr(by, "LISTED", 30)
    r = random.Random(4)
    rows = [(i, f, float(r.randint(1, 5))) for i in range(45) for f in ["hot", "warm", *r.sample([f"f{k}" for k in range(60)], 3)]] + [(3, "hot", 2.0), (50, None, 1.0)]
    wanted = {}
    for i, f, v in rows:
        for j, g, w in rows:
            if f == g and f and i >= j:
                a, b, c = wanted.get((i, j), (0, 0, 0))
                wanted[i, j] = a + v * w, b + min(v, w), c + 1
    for name in (lambda i: i, lambda i: f"n{i:02}"):
        kind = "long" if name(1) == 1 else "string"
        got = by.by_blocks(spark.createDataFrame([(name(i), f, v) for i, f, v in rows], f"i {kind}, f string, v double"), ["product", "least", "common"], side=8)
        assert {(x["i"], x["j"]): tuple(x)[2:] for x in got.collect()} == {(name(i), name(j)): x for (i, j), x in wanted.items()}
    features = spark.createDataFrame(rows[:-2], "i long, f string, v double")
    monkeypatch.setattr(kernels, "BROADCAST_ROWS", 0)
    kernel = kernels.sparse_linear(features)
    assert "Exchange" not in kernel._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    whole = dense(kernels.normalize(kernel), 50)
    assert np.allclose(whole, dense(kernels.normalize(kernel, kernels.squares(features)), 50))
    both = kernels.joint(features)
    assert np.array_equal(dense(both.select("i", "j", F.col("product").alias("k")), 50), dense(kernel, 50))
    items = kernels.set_intersection(features.withColumnRenamed("f", "item"))
    assert np.isclose(kernels.aligned(both, "product", "common").first()[0], kernels.alignment(kernel, items).first()[0])


def written(rows, path):
    """Bytes of Parquet a row."""
    rows.write.mode("overwrite").option("compression", "snappy").parquet(str(path))
    return sum(f.stat().st_size for f in path.rglob("*.parquet")) / rows.sparkSession.read.parquet(str(path)).count()


def test_dense_kernels_are_written_small(spark, tmp_path):
    # Of a normal double nothing can be saved, but each is there twice. Cell by cell, each next to its mirror, it took 7 bytes or more.
    g = np.random.default_rng(11)
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g.standard_normal((700, 6)))], "i long, x array<double>").repartition(3)
    assert written(kernels.linear(x), tmp_path / "linear") < 5.5
    sparse = x.select("i", F.posexplode("x").alias("f", "v")).crossJoin(spark.range(5).toDF("n")).select("i", (F.col("f") * 5 + F.col("n")).alias("f"), (F.col("v") * (F.col("n") + 1)).alias("v"))
    assert sparse.count() > kernels.BROADCAST_ROWS
    assert written(kernels.sparse_linear(sparse), tmp_path / "sparse") < 5.5
    labels = x.select("i", F.when(F.get("x", F.lit(0)) > 0, 1).otherwise(-1).alias("y"))
    assert written(kernels.label_kernel(labels), tmp_path / "labels") < 1.5


def test_both_ways_of_a_strip():
    from braidwork.operators import cells as by

    g = np.random.default_rng(12)
    for one in (False, True):
        m = g.standard_normal((70, 70)) * (g.random((70, 70)) < 0.7)
        a = np.arange(70) * 3
        b = a if one else a + 1000
        counts = (m != 0) & (a[:, None] >= b[None, :]) if one else m != 0
        got = [c for batch in by.both_ways(a, b, {"k": m, "l": 2 * m}, counts, pa.int64()) for c in zip(*batch.to_pydict().values(), strict=True)]
        wanted = [(int(a[r]), int(b[c]), m[r, c], 2 * m[r, c]) for r, c in zip(*np.nonzero(counts), strict=True)]
        wanted += [(j, i, *rest) for i, j, *rest in wanted if i != j]
        assert len(got) == len(wanted) and set(got) == set(wanted)


def test_empirical_kernel_of_vectors(spark, monkeypatch):
    """The same as of the cells, which it doesn't make: of some entities as rows, in blocks."""
    from braidwork.operators import cells as by

    g = np.random.default_rng(13)
    m = g.standard_normal((30, 9)) * (g.random((30, 9)) < 0.4)
    m[4] = 0
    rows = [(int(i), f"f{f}", float(m[i, f])) for i, f in zip(*np.nonzero(m), strict=True)] + [(4, "f1", 0.0)]
    v = spark.createDataFrame(rows, "i long, f string, v double")
    anchors = spark.createDataFrame([(29 - i, i) for i in range(30) if i % 4], "position long, row long")
    wanted = dense(kernels.empirical(kernels.normalize(kernels.sparse_linear(v)), anchors), 30)
    monkeypatch.setattr(by, "SIDE", 8)
    made = []
    monkeypatch.setattr(kernels, "sparse_linear", lambda *_: made.append(1))
    monkeypatch.setattr(kernels, "BROADCAST_ROWS", 3)
    got = kernels.empirical_linear(v, anchors)
    assert not made and got.where("i < 0 OR j < 0").count() == 0
    assert np.allclose(dense(got, 30), wanted) and np.abs(wanted).max() > 1
