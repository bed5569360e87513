import functools
import random

import pytest

from braidwork.operators import alignment
from braidwork.operators.alignment import GAP, MATCH, MISMATCH


@functools.cache
def plain(x, y):
    """Identities of the best alignment, by the whole table."""
    s, t = (x, y) if len(x) <= len(y) else (y, x)
    row = [(j * GAP, 0) for j in range(len(t) + 1)]
    for i in range(1, len(s) + 1):
        new = [(i * GAP, 0)]
        for j in range(1, len(t) + 1):
            same = s[i - 1] == t[j - 1]
            new.append(max((row[j - 1][0] + (MATCH if same else MISMATCH), row[j - 1][1] + same), (row[j][0] + GAP, row[j][1]), (new[-1][0] + GAP, new[-1][1])))
        row = new
    return row[-1][1]


def mutated(r, s, n):
    s = list(s)
    for _ in range(n):
        at = r.randrange(len(s) + 1)
        if r.random() < 0.6 and at < len(s):
            s[at] = r.choice("ACDEFGHIKL")
        elif r.random() < 0.5 and at < len(s):
            s.pop(at)
        else:
            s.insert(at, r.choice("ACDEFGHIKL"))
    return "".join(s)


def test_identities():
    r = random.Random(1)
    for _ in range(120):
        pairs = []
        for _ in range(6):
            x = "".join(r.choices("ACDE", k=r.randint(0, 25)))
            pairs.append((x, mutated(r, x, r.randint(0, 6))))
        assert alignment.identities(pairs, 40).tolist() == [plain(*p) for p in pairs]
    assert alignment.identities([], 5).tolist() == [] and alignment.identities([("", ""), ("é漢", "é漢x")], 3).tolist() == [0, 2]
    far = [(x, mutated(r, x, 12)) for x in ("".join(r.choices("ACDEFGHIKL", k=300)) for _ in range(5))]
    assert alignment.identities(far, 20).tolist() == [plain(*p) for p in far]


def families(r):
    out = []
    for k in range(6):
        base = "".join(r.choices("ACDEFGHIKL", k=r.randint(40, 80)))
        out += [base] + [mutated(r, base, r.choice([0, 3, 8, 15, 25])) for _ in range(r.randint(1, 5))]
    return [(f"s{k:02}", s) for k, s in enumerate(out)] + [("tiny", "AC"), ("empty", "")]


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.8, 1.0])
def test_clusters_against_all_pairs(spark, threshold):
    rows = families(random.Random(int(threshold * 10)))
    k = alignment.word_size(threshold)
    words = {p: {s[i : i + k] for i in range(len(s) - k + 1)} for p, s in rows}
    similar = {(p, q): plain(s, t) / len(min(s, t, key=len)) for p, s in rows for q, t in rows if p < q and words[p] & words[q]}
    similar = {k: v for k, v in similar.items() if v >= threshold}
    df = spark.createDataFrame(rows, "p string, seq string")
    got = {(r["p"], r["q"]): r["identity"] for r in alignment.similar_pairs(df, threshold, alignment.word_size(threshold), band=60).collect()}
    assert got == pytest.approx(similar)
    wanted, kept = {}, []
    for p, _ in sorted(rows, key=lambda x: (-len(x[1]), x[0])):
        wanted[p] = next((q for q in kept if (min(p, q), max(p, q)) in similar), p)
        kept += [p] * (wanted[p] == p)
    clusters = alignment.redundancy_by_identity(df, threshold, band=60).collect()
    assert {r["p"]: r["representative"] for r in clusters} == wanted and len(clusters) == len(rows)


def test_no_sequences(spark):
    assert alignment.redundancy_by_identity(spark.createDataFrame([], "p string, seq string")).count() == 0
