import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.operators import features, kernels, strings


def cells(spark, matrix):
    return spark.createDataFrame([(i, j, float(k)) for i, row in enumerate(matrix) for j, k in enumerate(row) if k], "i long, j long, k double")


def dense(kernel, n):
    out = np.zeros((n, n))
    for r in kernel.collect():
        out[r["i"], r["j"]] = r["k"]
    return out


def close(kernel, wanted):
    assert np.allclose(dense(kernel, len(wanted)), wanted, atol=1e-6)


def random_kernel(n, seed):
    """A positive semi-definite matrix with holes."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4)) * (r.random((n, 4)) < 0.6)
    return x @ x.T


def test_normalize(spark):
    m = random_kernel(7, 1)
    m[3, :] = m[:, 3] = 0
    m[3, 5] = m[5, 3] = 0.25  # an entity with nothing on the diagonal
    scale = np.array([1 / np.sqrt(m[i, i]) if m[i, i] else 1.0 for i in range(7)])
    close(kernels.normalize(cells(spark, m)), m * scale[:, None] * scale[None, :])


def rows(spark, *vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "i long, x array<double>")


def test_linear_and_correlation(spark):
    r = np.random.default_rng(2)
    x = r.integers(-3, 4, (9, 5)).astype(float)
    x[4] = 0
    x[6] = 2.5  # no variance
    x[8] = x[0]
    close(kernels.linear(rows(spark, *x)), x @ x.T)
    wanted = np.zeros((9, 9))
    varied = [i for i in range(9) if x[i].std() > 0]
    wanted[np.ix_(varied, varied)] = np.corrcoef(x[varied])
    close(kernels.correlation(rows(spark, *x)), wanted)


def test_linear_in_blocks(spark):
    x = np.random.default_rng(1).normal(size=(40, 6))
    close(kernels.linear(rows(spark, *x), block=7), x @ x.T)
    close(kernels.correlation(rows(spark, *x)), np.corrcoef(x))
    k = dense(kernels.random_linear(spark.range(5).toDF("i"), seed=3), 5)
    assert np.allclose(k, k.T) and np.linalg.eigvalsh(k)[0] > -1e-9


def test_sparse_set_intersection(spark):
    r = np.random.default_rng(3)
    x = r.integers(-2, 4, (8, 12)) * (r.random((8, 12)) < 0.4)
    x[5] = 0
    features = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(8) for j in range(12) if x[i, j] or j % 3 == 0], "i long, f string, v double")
    close(kernels.sparse_linear(features), x @ x.T)
    h = np.abs(x)
    counts = spark.createDataFrame([(i, f"f{j}", float(h[i, j])) for i in range(8) for j in range(12) if h[i, j]], "i long, f string, v double")
    close(kernels.intersection(counts), np.minimum(h[:, None, :], h[None, :, :]).sum(axis=2))
    sets = [set(np.flatnonzero(row).tolist()) for row in x]
    items = spark.createDataFrame([(i, f"x{v}") for i, s in enumerate(sets) for v in s for _ in range(1 + v % 2)], "i long, item string")
    close(kernels.set_intersection(items), [[len(a & b) for b in sets] for a in sets])


def test_empirical_and_pairwise(spark):
    m = random_kernel(6, 4)
    anchors = [(0, 4), (1, 1), (2, 5)]
    picked = m[[row for _, row in anchors]]
    close(kernels.empirical(cells(spark, m), spark.createDataFrame(anchors, "position long, row long")), picked @ picked.T)
    named = [(0, 2), (3, 5), (1, 1), (4, 0), (5, 2)]
    pairs = spark.createDataFrame([(s, i, j) for s, (i, j) in enumerate(named)], "s long, i long, j long")
    close(kernels.pairwise(pairs, cells(spark, m)), [[m[i, n] * m[j, q] + m[i, q] * m[j, n] for n, q in named] for i, j in named])
    close(kernels.pairwise(pairs, cells(spark, m), "sum"), [[m[i, n] + m[j, q] + m[i, q] + m[j, n] for n, q in named] for i, j in named])
    with pytest.raises(ValueError):
        kernels.pairwise(pairs, cells(spark, m), "max")


def test_colocalization(spark):
    df = spark.createDataFrame([(0, "a", 0.0), (1, "a", 10.0), (2, "a", 5.0), (3, "b", 7.0)], "i long, chrom string, pos double")
    e = np.exp
    close(kernels.colocalization(df), [[1, e(-1), e(-0.5), 0], [e(-1), 1, e(-0.5), 0], [e(-0.5), e(-0.5), 1, 0], [0, 0, 0, 1]])


def test_algebra(spark):
    a, b = cells(spark, [[1, 2], [2, 1]]), cells(spark, [[3, 0], [0, 3]])
    close(kernels.average(a, b), [[2, 1], [1, 2]])
    assert kernels.alignment(a, b).first()[0] == pytest.approx(6 / (np.sqrt(10 * 18) + 1e-10))
    y = kernels.label_kernel(spark.createDataFrame([(0, 1), (1, -1)], "i long, y int"))
    close(y, [[1, -1], [-1, 1]])
    only = spark.createDataFrame([(0,)], "i long")
    assert kernels.alignment(a, b, only).first()[0] == pytest.approx(1)
    train, test = kernels.split_train_test(a, only, spark.createDataFrame([(1,)], "i long"))
    assert [tuple(r) for r in train.collect()] == [(0, 0, 1.0)] and [tuple(r) for r in test.collect()] == [(1, 0, 2.0)]


def test_dense_algebra(spark):
    adjacency = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], float)
    m = adjacency - np.diag(adjacency.sum(axis=1))
    wanted, term = np.eye(3), np.eye(3)
    for n in range(1, 40):
        term = term @ m / n
        wanted = wanted + term
    close(kernels.diffusion(cells(spark, adjacency), 3), wanted)
    skew = np.array([[0, 1.0, 0], [0, 0, 2.0], [0, 0, 0]])
    d = skew - np.diag(skew.sum(axis=1))
    wanted, term = np.eye(3), np.eye(3)
    for n in range(1, 60):
        term = term @ d / n
        wanted = wanted + term
    close(kernels.diffusion(cells(spark, skew), 3), wanted)
    bad = cells(spark, [[1, 2], [2, 1]])
    assert not kernels.is_psd(bad, 2) and kernels.is_psd(kernels.fixup(bad, 2), 2)
    close(kernels.fixup(bad, 2), [[11, 2], [2, 11]])
    with pytest.raises(ValueError):
        kernels.fixup(bad, 2, tolerance=0.5)
    square = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "i long, row array<double>")
    close(kernels.precomputed(square), [[1, 0], [0, 2]])
    with pytest.raises(ValueError):
        kernels.precomputed(square.where("i = 0"))


def test_cliques(spark):
    got = kernels.cliques(spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (1, "y"), (1, "y")], "i long, complex string"))
    assert {(r["i"], r["j"]) for r in got.collect()} == {(0, 0), (1, 1), (2, 2), (0, 1), (1, 0), (1, 2), (2, 1)}


def test_domain_and_expression_kernels(spark):
    entities = spark.createDataFrame([(0, "p"), (1, "q"), (2, "r")], "i long, p string")
    hits = spark.createDataFrame([("p", "Pfam", "A", "1e-3"), ("p", "Pfam", "A", "x"), ("q", "Pfam", "A", "0"), ("q", "SMART", "B", "1")], "p string, DB string, FAMILY string, EVALUE string")
    close(kernels.interpro(entities, hits), [[1, 1, 0], [1, 2, 0], [0, 0, 0]])
    close(kernels.interpro(entities, hits, "count", ["Pfam"]), [[4, 2, 0], [2, 1, 0], [0, 0, 0]])
    a = -np.log(1e-3)
    close(kernels.interpro(entities, hits, "evalue", ["Pfam"]), [[a * a, a, 0], [a, 1, 0], [0, 0, 0]])
    genes = spark.createDataFrame([(0, "g"), (1, "h")], "i long, gene string")
    one = spark.createDataFrame([("z", [9.0, 1.0]), ("h", [1.0, 0.0]), ("g", [0.0, 1.0])], "gene string, x array<double>")
    close(kernels.expression(genes, [one, one]), [[2, -2], [-2, 2]])


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "i long, s string")


def grams(values, k):
    """Counts of the k-mers of each string."""
    return [Counter(v[o : o + k] for o in range(len(v) - k + 1)) for v in values]


def gram(counts):
    return [[sum(n * b[f] for f, n in a.items()) for b in counts] for a in counts]


def random_strings(n, seed, alphabet="ACDK"):
    r = random.Random(seed)
    return ["".join(r.choices(alphabet, k=r.randint(4, 11))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_spectrum(spark, k):
    values = random_strings(6, k)
    close(strings.spectrum(texts(spark, *values), k), gram(grams(values, k)))


def test_spectrum_of_an_alphabet(spark):
    values = random_strings(5, 9, "ACDX")
    close(strings.spectrum(texts(spark, *values), 2, "ACD"), gram([Counter({f: n for f, n in c.items() if "X" not in f}) for c in grams(values, 2)]))


@pytest.mark.parametrize(("k", "m"), [(1, 0), (1, 1), (2, 1), (3, 1), (3, 2)])
def test_mismatch(spark, k, m):
    values = random_strings(4, 10 * k + m)
    leaves = ["".join(x) for x in product("ACDK", repeat=k)]
    near = [Counter({f: sum(n for g, n in c.items() if sum(a != b for a, b in zip(f, g, strict=True)) <= m) for f in leaves}) for c in grams(values, k)]
    close(strings.mismatch(texts(spark, *values), k, m, "ACDK"), gram(near))


@pytest.mark.parametrize("threshold", [0.3, 0.9, 1.4, 3.0])
def test_profile(spark, threshold):
    r = np.random.default_rng(5)
    costs = [r.random((n, 3)) for n in (3, 5, 4)]
    found = []
    for c in costs:
        counts = Counter()
        for o in range(len(c) - 1):
            for a, b in product(range(3), repeat=2):
                if c[o, a] + c[o + 1, b] <= threshold:
                    counts[a, b] += 1
        found.append(counts)
    profiles = spark.createDataFrame([(i, pos, "A", row.tolist()) for i, c in enumerate(costs) for pos, row in enumerate(c)], "i long, pos int, residue string, scores array<double>")
    close(strings.profile(profiles, 2, threshold, "ACD"), gram(found))


def test_string_arguments(spark):
    df = texts(spark, "KDCA", "CKD")
    for k, alphabet in ((-1, "CDK"), (4, "CDK"), (2, "KK")):
        with pytest.raises(ValueError):
            strings.spectrum(df, k, alphabet)
    values = random_strings(5, 12)
    assert strings.kmers(texts(spark, *values), 3).count() == sum(len(v) - 2 for v in values)
    total = sum(grams(values, 2), Counter())
    close(strings.spectrum(texts(spark, *values), 2, least=3), gram([Counter({f: n for f, n in c.items() if total[f] >= 3}) for c in grams(values, 2)]))


def test_kernels_are_symmetric(spark):
    df = texts(spark, *random_strings(3, 13))
    for k in (strings.spectrum(df, 2), strings.mismatch(df, 2, 1)):
        m = dense(k, 3)
        assert np.allclose(m, m.T)
        assert np.allclose(np.diag(dense(kernels.normalize(k), 3)), 1)
    assert kernels.mirror(spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0)], "i long, j long, k double")).agg(F.sum("k")).first()[0] == 5


def test_kernels_of_ones_own(spark):
    x = np.random.default_rng(8).normal(size=(9, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double")

    def near(left, right):
        return F.exp(-((left("a") - right("a")) * (left("a") - right("a")) + (left("b") - right("b")) * (left("b") - right("b"))))

    close(kernels.of_pairs(df, near, block=4), np.exp(-((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)))
    values = random_strings(4, 14)
    first = strings.by_expansion(texts(spark, *values), 2, lambda different: different.select("kmer", F.substring("kmer", 1, 1).alias("f")))
    close(first, gram([Counter(v[:-1]) for v in values]))
    lengths = features.summarised(texts(spark, *values), lambda s: features.residues(s).select("i", "pos", (F.col("residue") == "A").cast("double").alias("share")))
    assert {r["i"]: pytest.approx(r["share"]) for r in lengths.collect()} == {i: v.count("A") / len(v) for i, v in enumerate(values)}


def test_vectors_are_dealt_once_to_each_pair_of_blocks(spark):
    """No cell is shuffled, with several experiments too, and a row travels once to each block instead of twice."""
    x = np.random.default_rng(5).standard_normal((30, 4))
    one = spark.createDataFrame([(f"g{n}", v.tolist()) for n, v in enumerate(x)], "gene string, x array<double>")
    two = spark.createDataFrame([(f"g{n}", v[:3].tolist()) for n, v in enumerate(x) if n % 3], "gene string, x array<double>")
    genes = spark.createDataFrame([(n, f"g{n}") for n in range(30)], "i long, gene string")
    wanted = np.corrcoef(x)
    some = [n for n in range(30) if n % 3]
    wanted[np.ix_(some, some)] += np.corrcoef(x[some, :3])
    found = kernels.expression(genes, [one, two])
    assert np.allclose(dense(found, 30), wanted)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "CoGroup" not in plan
    assert "CoGroup" not in kernels.linear(spark.range(9).selectExpr("id AS i", "array(1.0D) AS x"), block=2)._jdf.queryExecution().optimizedPlan().toString()
