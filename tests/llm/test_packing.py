import random
from collections import Counter

import numpy as np
import pytest

from braidwork.llm.packing import placements, shortest_pack_first


def piece_by_piece(lengths, room):
    """Room left in each pack, each piece going into the pack with most room."""
    left = []
    for n in sorted(lengths, reverse=True):
        at = max(range(len(left)), key=left.__getitem__, default=None)
        if at is None or left[at] < n:
            left.append(room - n)
        else:
            left[at] -= n
    return sorted(left)


def left_over(histogram, room):
    patterns = shortest_pack_first(histogram, room)
    used = Counter()
    for pattern, n in patterns:
        for length in pattern:
            used[length] += n
    assert used == Counter(histogram) and all(sum(p) <= room for p, _ in patterns)
    return sorted(room - sum(p) for p, n in patterns for _ in range(n))


def test_as_if_piece_by_piece():
    r = random.Random(9)
    for room in (7, 20, 100):
        for _ in range(80):
            lengths = [r.choice([1, 2, 3, room // 2, room // 3, r.randint(1, room), room]) for _ in range(r.randint(0, 120))]
            assert left_over(Counter(lengths), room) == piece_by_piece(lengths, room)


@pytest.mark.parametrize(("length", "count"), [(100, 1000), (1, 5000), (1400, 1000), (4096, 9), (2049, 7), (2048, 7), (40, 100_000)])
def test_one_length_takes_the_fewest_sequences(length, count):
    assert len(left_over({length: count}, 4096)) == -(-count // (4096 // length))


@pytest.mark.parametrize("kind", ["peaked", "two peaks", "log-normal", "short log-normal", "uniform"])
def test_little_padding(kind):
    g = np.random.default_rng(3)
    lengths = {
        "peaked": np.full(100_000, 40),
        "two peaks": np.concatenate([np.full(100_000, 40), np.full(100, 2000)]),
        "log-normal": g.lognormal(6, 1, 50_000),
        "short log-normal": g.lognormal(4.1, 0.5, 100_000),
        "uniform": g.integers(1, 4097, 20_000),
    }[kind]
    histogram = Counter(int(x) for x in np.clip(lengths, 1, 4096))
    left = left_over(histogram, 4096)
    assert 1 - sum(left) / (4096 * len(left)) > 0.97
    rows = placements(shortest_pack_first(histogram, 4096))
    assert sum(r[2] - r[1] + 1 for r in rows) == sum(histogram.values()) and len(rows) < 40_000
