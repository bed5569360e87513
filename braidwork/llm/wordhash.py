"""Words of many texts at once: boundaries and 64-bit hashes as numpy arrays.

A word is a maximal run of bytes other than the six ASCII white-space characters, which in UTF-8 is the
same as a run of such code points. Hashes depend on the bytes of a word only, on no process.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are hashed eight at a time for all words at once; longer words are hashed one by one.
SHORT = 64
#: Words per round, so that temporaries stay small.
ROUND = 1 << 17
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) * _GOLDEN) | np.uint64(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word runs over one of ``bounds`` (ascending, first 0, last the size)."""
    inside = ~_IS_SPACE[data]
    if not inside.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class Lanes:
    """The bytes of all words, eight at a time."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.at = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def take(self, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 k to 8 k + 7 of words that have more than 8 k."""
        return self.at[starts + 8 * k] & _TAIL[np.minimum(sizes - 8 * k, 8)]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """One hash a word; those of two salts are independent of each other.

    Short words: their bytes, eight at a time, go through a chain of bijective mixers, so that words of up to eight
    bytes and one length never agree. Long ones: BLAKE2b.
    """
    out = np.empty(len(starts), np.uint64)
    lanes = Lanes(data)
    first, second = constants(2, 51 + salt)
    with np.errstate(over="ignore"):
        for a in range(0, len(starts), ROUND):
            at, sizes = starts[a : a + ROUND], ends[a : a + ROUND] - starts[a : a + ROUND]
            state = sizes.astype(np.uint64) * _GOLDEN + first
            own = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
            for k in range(SHORT // 8):
                if not len(own):
                    break
                state[own] = mix(state[own] ^ lanes.take(at[own], sizes[own], k)) * second + first
                own = own[sizes[own] > 8 * k + 8]
            out[a : a + ROUND] = mix(state)
    raw = memoryview(data)
    for i in np.flatnonzero(ends - starts > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, one for each different word, and for each word which of these it is; told apart by their bytes."""
    keys = hashes(data, starts, ends)
    order = np.argsort(keys)
    keys = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    at, inverse = order[head], np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(head) - 1
    sizes = ends - starts
    same = sizes == sizes[at][inverse]
    lanes = Lanes(data)
    own = np.flatnonzero(same & (sizes > 0) & (sizes <= SHORT))
    k = 0
    while len(own):
        first = at[inverse[own]]
        same[own] = lanes.take(starts[own], sizes[own], k) == lanes.take(starts[first], sizes[own], k)
        own = own[same[own] & (sizes[own] > 8 * k + 8)]
        k += 1
    raw = memoryview(data)
    for i in np.flatnonzero(sizes > SHORT).tolist():
        j = int(at[inverse[i]])
        same[i] = i == j or raw[starts[i] : ends[i]] == raw[starts[j] : ends[j]]
    if same.all():
        return at, inverse
    # Two words of one hash: all are told apart one by one.
    known: dict[bytes, int] = {}
    first_places: list[int] = []
    inverse = np.empty(len(starts), np.int64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        word = bytes(raw[a:b])
        if word not in known:
            known[word] = len(first_places)
            first_places.append(i)
        inverse[i] = known[word]
    return np.array(first_places, np.int64), inverse


def windows(words: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Hashes of all runs of ``width`` successive words; result i starts at word i."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(constants(width, salt)):
            out += words[j : j + n] * c
    return mix(out)


class Words:
    """The words of a list of texts (UTF-8 bytes), and their hashes. With ``lower``, these are of words with A-Z lowered."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        #: What is hashed.
        self.folded = _LOWER[self.data] if lower else self.data
        self.bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.bounds[1:])
        self.starts, self.ends = spans(self.data, self.bounds)
        #: Word k of text i is number first[i] + k.
        self.first = np.searchsorted(self.starts, self.bounds)

    @cached_property
    def hashes(self) -> np.ndarray:
        return hashes(self.folded, self.starts, self.ends)

    def other_hashes(self) -> np.ndarray:
        """Hashes that are independent of ``hashes``."""
        return hashes(self.folded, self.starts, self.ends, 1)

    def of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))
