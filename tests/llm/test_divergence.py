import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm import divergence, queries

from . import brute
from .test_operators import SF, same

COLUMNS = "doc_id long, lang string, source string, text string, term string, n int, p double, place int, `lead` int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(None, *r, "x", 1, 0.5, 2, 0) for r in rows], COLUMNS).repartition(parts)


def made():
    r = random.Random(6)
    words = [f"{a}{b}" for a in ("wort", "mot", "größe", "漢", "Word") for b in "abcdefghijklmnopqrst"]
    rows = []
    for lang, sources in (("en", 9), ("de", 5), ("", 2)):
        for s in range(sources):
            own = r.sample(words, 12)  # rare terms in few groups, and some in all
            rows += [(lang, f"s{s}", " ".join(r.choices(own, k=r.randint(0, 40)) + r.choices(words[:6], k=5)) + ". X1_y-Z") for _ in range(r.randint(1, 9))]
    rows += [("en", "silent", ""), ("en", "silent", None), ("en", None, "worta worta"), (None, "s0", "the 42 \x00 the"), ("fr", "only", "un deux"), ("xx", "a", None), ("xx", "b", "1 2 3"), ("xx", "c", "once")]
    return rows + rows[:7]


@pytest.mark.parametrize(("block", "cell", "heavy"), [(64, 200_000, 25), (2, 50, 25), (3, 20, 0), (1, 10_000, 200)])
def test_against_brute_force(spark, block, cell, heavy):
    rows = made()
    same(divergence.audit(table(spark, rows), most_terms=7, block=block, cell=cell, heavy=heavy).collect(), brute.divergence(rows, most=7))


def test_hot_group_and_empty_table(spark):
    r = random.Random(8)
    rows = [("en", "hot" if n % 3 else f"s{n % 7}", " ".join(f"t{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(30))) for n in range(200)]
    same(divergence.audit(table(spark, rows, 8), least_docs=1, block=2, cell=300).collect(), brute.divergence(rows, least=1))
    assert divergence.audit(table(spark, [])).collect() == []
    same(divergence.audit(table(spark, [(None, None, None)] * 2)).collect(), brute.divergence([(None, None, None)]))


def test_large_counts_stay_exact(spark):
    """The product of share unit and count is beyond 64 bits."""
    big = 40_000_000_000_000
    rows = spark.createDataFrame([(big, 3 * big + 1, 5), (0, 1, 0), (0, 0, 0)], "n long, total long, v long")
    got = [r[0] for r in rows.select(divergence.share(rows.n, rows.total, rows.v)).collect()]
    assert got == [1 + 10**9 * (big + 1) // (3 * big + 6), 1 + 10**9, 1 + 10**9]


@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 4), st.integers(1, 10**9)), max_size=40, unique_by=lambda x: x[:2]), st.sampled_from([1, 7, 1 << 21]))
@settings(deadline=None, max_examples=200)
def test_sparse_sums_are_the_dense_ones(postings, tile):
    least = np.array([3, 10**9, 17, 1, 250], np.int64)
    p = np.broadcast_to(least, (9, 5)).copy()
    for t, g, x in postings:
        p[t, g] = x
    term, group, x = (np.array(c, np.int64) for c in zip(*sorted(postings), strict=True)) if postings else (np.zeros(0, np.int64),) * 3
    whole, divergence.TILE = divergence.TILE, tile
    try:
        sparse = divergence.sparse_pairs((term, group, x), (term, group, x), least, least)
        dense = divergence.dense_tile(p, p) - 9 * divergence.dense_tile(least[None, :], least[None, :])
    finally:
        divergence.TILE = whole
    assert sparse.tolist() == dense.tolist()
    wanted = [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(p[:, g], p[:, h], strict=True)) for h in range(5)] for g in range(5)]
    assert (dense + 9 * divergence.dense_tile(least[None, :], least[None, :])).tolist() == wanted


def test_counts_of_a_slice():
    got = divergence._term_counts(pa.array(["a", "a", "b"]), pa.array(["x", "x", "x"]), pa.array(["Die die é", "die", None])).to_pylist()
    assert sorted(tuple(r.values()) for r in got) == [("a", "x", "die", 3, 2), ("a", "x", "é", 1, 1)]


def test_table(spark):
    rows = [(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(queries.op11_divergence(spark, SF).collect(), brute.divergence(rows))
