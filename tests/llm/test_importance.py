import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm import importance, queries

from . import brute
from .test_operators import SF, docs, frame, rows, same  # noqa: F401  fixtures


@given(st.lists(st.one_of(st.none(), st.text(alphabet=" aB0-_\x00\n@[`{éß漢😀", max_size=40)), max_size=6), st.sampled_from([1, 2, 3, 5, 1000]))
@settings(deadline=None, max_examples=300)
def test_buckets_are_those_of_the_strings(texts, stretch):
    whole, importance.STRETCH = importance.STRETCH, stretch
    try:
        got = [(int(t), int(b)) for of, found in importance.features(pa.array(texts, pa.string()), 10_000) for t, b in zip(of, found, strict=True)]
    finally:
        importance.STRETCH = whole
    assert sorted(got) == sorted((k, zlib.crc32(f.encode()) % 10_000) for k, t in enumerate(texts) for f in brute.ngrams(t)[1])


def test_checksums_of_words_of_any_length():
    r = random.Random(1)
    words = [bytes(r.choices(range(97, 123), k=n)) for n in [*range(1, 140), 1000, 4096, 100_001]]
    text = " ".join(w.decode() for w in words)
    got = [int(b) for _, found in importance.features(pa.array([text]), 2**32 - 1) for b in found]
    assert got == [zlib.crc32(f.encode()) % (2**32 - 1) for f in brute.ngrams(text)[1]]
    sliced = pa.array(["x y", None, "a b", "", "c"]).slice(1)
    assert [x.tolist() for x, _ in importance.features(sliced, 10)] == [[1, 1, 3], [1], []]


def test_table_against_brute_force(spark):
    read = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark")]
    wanted = brute.importance([(r["doc_id"], r["text"]) for r in read[0].collect()], [r["text"] for r in read[1].collect()])
    same(queries.op13_importance(spark, SF).collect(), wanted)


def drawn(df):
    return df.select("doc_id", "n_features", "weight", "score", "rank").collect()


def test_odd_rows(spark, rows, docs):  # noqa: F811
    target = [(1, "lorem ipsum dolor"), (2, None), (3, ""), (4, "größe 漢字 " * 30)]
    wanted = brute.importance(rows, [t for _, t in target], percent=40)
    got = drawn(importance.resample(docs, frame(spark, target), percent=40))
    same(got, wanted)
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 10


def test_ties_go_to_the_smaller_id_and_empty_tables(spark):
    docs, none = frame(spark, [(5, "a " * 30)] * 4 + [(9, "a " * 30)] * 3), frame(spark, [])  # noqa: F811
    got = drawn(importance.resample(docs, docs, percent=100))
    assert {r["weight"] for r in got} == {got[0]["weight"]} and sorted(r["rank"] for r in got) == list(range(1, 8))
    same(got and drawn(importance.resample(docs, none)), brute.importance([(r["doc_id"], r["text"]) for r in docs.collect()], []))
    assert drawn(importance.resample(none, docs)) == [] == drawn(importance.resample(none, none))


def test_gains():
    assert importance.gains(np.array([0, 0]), np.array([0, 0])).tolist() == [0, 0]
    assert importance.gains(np.array([10**12, 0]), np.array([0, 10**12]))[0] > 27_000
