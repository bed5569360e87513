"""Operators whose rounds, tasks or passes are bounded."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork import file_queries, lineage
from braidwork.operators import features, folds, ontology
from braidwork.plans import sparql, statistics
from braidwork.plans.mapping import iri, to_triples
from braidwork.sources import files, sinks
from braidwork.terms import TYPE


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "is_a") for a, b in pairs], "child string, parent string, relation string")


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    made = []
    keep = ontology.materialize
    monkeypatch.setattr(ontology, "materialize", lambda df: made.append(1) or keep(df))
    chain = edges(spark, [(f"t{k:04}", f"t{k + 1:04}") for k in range(300)])
    assert ontology.closure(chain).count() == 300 * 301 // 2 and len(made) <= math.ceil(math.log2(300)) + 2
    terms = spark.createDataFrame([(f"t{k:04}",) for k in range(301)], "id string")
    assert {r["id"]: r["level"] for r in ontology.levels(terms, chain).collect()} == {f"t{k:04}": 300 - k for k in range(301)}


def test_distances_are_those_of_shortest_paths(spark):
    r = random.Random(3)
    pairs = sorted({(f"n{a}", f"n{r.randrange(a)}") for a in range(1, 40) for _ in range(r.randint(0, 3))})
    up = {}
    for a, b in pairs:
        up.setdefault(a, set()).add(b)
    wanted = {}
    for start in up:
        reached, frontier, d = {}, {start}, 0
        while frontier:
            d += 1
            frontier = {b for a in frontier for b in up.get(a, ())} - reached.keys()
            reached |= dict.fromkeys(frontier, d)
        wanted |= {(start, b): n for b, n in reached.items()}
    got = ontology.distances(edges(spark, pairs)).collect()
    assert {(x["id"], x["ancestor"]): x["d"] for x in got} == wanted and len(got) == len(wanted)
    circle = ontology.closure(edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])).collect()
    assert len(circle) == 9
    assert ontology.closure(edges(spark, [])).count() == 0


def plain_order(sets):
    left, rounds = dict(sets), []
    while left:
        counts = {}
        for fs, n in left.items():
            for f in fs:
                counts[f] = counts.get(f, 0) + n
        rounds.append(min(counts, key=lambda f: (counts[f], f)))
        left = {s: n for s, n in left.items() if rounds[-1] not in s}
    return rounds


def test_greedy_order(spark):
    r = random.Random(5)
    for _ in range(30):
        sets = {tuple(sorted(r.sample("abcdefghij", r.randint(1, 4)))): r.randint(1, 5) for _ in range(r.randint(0, 25))}
        assert folds.feature_order(sets) == plain_order(sets)
    counted = spark.createDataFrame([(list(s), n) for s, n in sets.items()], "features array<string>, count long")
    assert folds.feature_order_by_jobs(counted) == folds.feature_order(sets)


def test_greedy_order_of_many_sets():
    r = random.Random(6)
    sets = {tuple(sorted(r.sample(range(5000), 6))): 1 for _ in range(200_000)}
    sets = {tuple(f"f{x:04}" for x in s): n for s, n in sets.items()}
    began = time.process_time()
    assert len(folds.feature_order(sets)) > 1000 and time.process_time() - began < 60


def plain_entropy(s, pos, w, alphabet, epsilon=1e-10):
    part = s[max(0, pos - w) : pos + w + 1]
    counts = [part.count(a) + epsilon for a in alphabet]
    h = -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)
    return 0.0 if abs(h) < epsilon else h


def test_entropies_of_all_widths(spark, monkeypatch):
    r = random.Random(7)
    rows = [(k, "".join(r.choices("ACDEFGHIKLxX", k=n))) for k, n in enumerate([0, 1, 2, 17, 40, 300])] + [(9, None), (10, "xxxx"), (11, "AAAA")]
    got = features.low_complexity(spark.createDataFrame(rows, "i long, s string")).collect()
    assert len(got) == sum(len(s or "") for _, s in rows)
    texts = dict(rows)
    for x in got:
        for w in (8, 16, 32, 64, 128):
            assert x[f"entropy_{w}"] == pytest.approx(plain_entropy(texts[x["i"]], x["pos"], w, features.AMINO_ACIDS), abs=1e-7)
    codes = np.array([ord(c) % 7 for c in "".join(r.choices("abcdefg", k=500))])
    whole = features.entropies(codes, 7, 8, 1e-10)
    assert np.allclose(whole[100:200], features.entropies(codes[92:208], 7, 8, 1e-10)[8:108])


def test_skipped_records_of_a_file_in_many_splits(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"t{n}.tsv").write_text("".join(f"head {k}\tx\n" for k in range(3)) + "".join(f"{n}_{k}\t{k}\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        rows = files.delimited(spark, f"{tmp_path}/*.tsv", ["a", "b"], skip=3)
        assert rows.rdd.getNumPartitions() >= 10
        assert sorted(r["a"] for r in rows.collect()) == sorted(f"{n}_{k}" for n in range(2) for k in range(5000))
        assert rows.select(F.spark_partition_id().alias("t")).distinct().count() >= 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_fold_files_are_compressed_and_not_sorted(spark, tmp_path):
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    pairs = spark.range(20_000).select(F.col("id").cast("string").alias("p"), (F.col("id") + 1).cast("string").alias("q"), F.lit(True).alias("state"), (F.col("id") % 4).cast("int").alias("fold"))
    rotated = folds.rotate(pairs, 4)
    sinks.write_folds(rotated, str(tmp_path / "folds"))
    assert spark.conf.get(name) == before
    size = sum(f.stat().st_size for f in (tmp_path / "folds").rglob("part-*"))
    lines = sinks.fold_lines(rotated).select(F.col("test_fold").cast("int"), "part", "file", "value")
    got = spark.read.text(str(tmp_path / "folds")).select("test_fold", "part", "file", "value")
    assert got.exceptAll(lines).isEmpty() and got.count() == lines.count() == 160_000
    assert size < lines.select(F.sum(F.length("value") + 1)).first()[0] / 4


def test_fold_files_are_smaller_than_the_fastest_level_makes_them(spark, tmp_path):
    pairs = spark.range(0, 20_000, 1, 2).select(F.col("id").cast("string").alias("p"), (F.col("id") + 1).cast("string").alias("q"), F.lit(True).alias("state"), (F.col("id") % 4).cast("int").alias("fold"))
    rotated = folds.rotate(pairs, 4)
    sinks.write_folds(rotated, str(tmp_path / "folds"))
    sinks.fold_lines(rotated).write.partitionBy("test_fold", "part", "file").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(str(tmp_path / "fast"))
    size, fast = (sum(f.stat().st_size for f in (tmp_path / d).rglob("part-*")) for d in ("folds", "fast"))
    assert size < 0.9 * fast


def test_triples_of_one_split_are_made_by_many_tasks(spark):
    rows = spark.range(0, 400_000, 1, 1).select(F.col("id").cast("string").alias("k"))
    triples = to_triples(rows, [iri(F.col("k"), "p", F.concat(F.lit("o"), "k")), iri(F.col("k"), "q", F.lit("x"))])
    assert "RebalancePartitions" in triples._jdf.queryExecution().optimizedPlan().toString()
    assert triples.count() == 800_000 and triples.select("s").distinct().count() == 400_000
    assert "Rebalance" not in to_triples(rows, [iri(F.col("k"), "p", F.lit("o"))], distinct=False)._jdf.queryExecution().optimizedPlan().toString()


def test_statistics_shuffle_triples_once(spark, monkeypatch):
    made = []
    keep = statistics.materialize
    monkeypatch.setattr(statistics, "materialize", lambda df: made.append(df) or keep(df))
    rows = [("a", TYPE, "c1"), ("a", TYPE, "c2"), ("a", "p", "1"), ("a", "p", "2"), ("b", "p", "3"), ("c", TYPE, "c1"), ("c", "p", "1")]
    got = statistics.statistics_of(spark.createDataFrame(rows, "s string, p string, o string"))
    assert {tuple(r) for r in got.predicates.select("p", "triples", "subjects", "most").collect()} == {(TYPE, 3, 2, 2), ("p", 4, 3, 2)}
    assert {(tuple(r["members"]), r["subjects"]) for r in got.sets.collect()} == {(tuple(sorted(("p", TYPE, f"{TYPE} c1", f"{TYPE} c2"))), 1), (("p",), 1), (tuple(sorted(("p", TYPE, f"{TYPE} c1"))), 1)}
    assert len(made) == 1


def test_a_held_graph_is_made_by_many_tasks_and_not_broadcast(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    rows = spark.range(0, 600_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    held = file_queries.held(to_triples(rows, [iri(F.col("k"), "p", F.concat(F.lit("o"), "k")), iri(F.col("k"), "q", F.lit("x"))]))
    assert spark.conf.get(name, None) == before and spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None
    assert held.triples.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = sparql.run(held, "SELECT ?s ?o WHERE { ?s <p> ?o . ?s <q> <x> . }", arity=2)
    found.write.format("noop").mode("overwrite").save()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 600_000
    with pytest.raises(ZeroDivisionError), lineage.spread(spark):
        assert spark.conf.get(name) == "16m"
        1 / 0
    assert spark.conf.get(name, None) == before


def test_proteins_of_a_level_are_counted_without_copies_of_rows(spark):
    terms = spark.createDataFrame([("a", 0, False), ("b", 1, False), ("c", 1, True), ("d", 2, True)], "id string, level int, is_bin boolean")
    held = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", None), ("b", 3), ("x", 9)], "id string, p int")
    got = ontology.level_statistics(terms, held)
    assert got.columns == ["level", "n_terms", "n_bins", "n_annotations", "n_proteins"]
    assert {tuple(r) for r in got.collect()} == {(0, 1, 0, 2, 2), (1, 2, 1, 3, 2), (2, 1, 1, 0, 0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") <= 1 and "p#" not in "".join(line for line in plan.splitlines() if "Expand" in line)
