"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its score comes from its own features and some of its neighbours'; a two by two
table scores the step from one line to the next. Forward-backward gives each line's probability of being
good, and the document's score is their mean weighted by length. The field is fitted by gradient ascent on a
bounded sample of labelled documents, whose lines all take the document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, rows_of, utf8
from .wordhash import Words, mix

FEATURES = (
    "length", "upper", "digit", "stops", "symbols", "foreign", "word_length", "word_spread", "adjacent_repeats", "distinct", "symbol_ends",
    "repeated_line", "capital_start", "full_stop_end", "document_repeats", "empty", "bangs", "letters_in_word", "markup",
)
#: Features of the line before and the line after that a line sees as well.
NEIGHBOURS = ("upper", "symbols", "adjacent_repeats", "distinct", "symbol_ends", "repeated_line", "empty", "letters_in_word")
WIDTH = len(FEATURES) + 2 * len(NEIGHBOURS) + 1


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _class(bytes(range(65, 91)))
_LETTER = _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT = _class(b"0123456789")
_STOPS = _class(b".,;:?")
_SYMBOL = _class(b"!\"#$%&'()*+-/<=>@[\\]^_`{|}~")
_FOREIGN = _class(bytes(range(192, 256)))
_CONTINUED = _class(bytes(range(128, 192)))
_BANG = _class(b"!")
_MARKUP = _class(b"<>{}[]|=/\\")


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (the last column is 1), their lengths in characters, and lines per text."""
    words = Words(texts, lower=True)
    data, bounds = words.data, words.bounds
    breaks = np.flatnonzero(data == 10)
    counts = np.diff(np.searchsorted(breaks, bounds)) + 1
    ends = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
    starts = np.empty(len(ends), np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    starts[1:] = ends[:-1] + 1
    starts[first] = bounds[:-1]
    doc = np.repeat(np.arange(len(texts)), counts)
    n = len(ends)

    def per_line(mask: np.ndarray) -> np.ndarray:
        running = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=running[1:])
        return (running[ends] - running[starts]).astype(np.float64)

    chars = (ends - starts) - per_line(_CONTINUED[data])
    some = np.maximum(chars, 1)
    letters = per_line(_LETTER[data] & ~_CONTINUED[data])
    line = np.searchsorted(starts, words.starts, "right") - 1
    n_words = np.bincount(line, minlength=n).astype(np.float64)
    each = np.maximum(n_words, 1)
    sizes = (words.ends - words.starts).astype(np.float64)
    h = words.hashes
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])

    def distinct(group: np.ndarray, total: int) -> np.ndarray:
        """Different words in each group."""
        keys = np.sort((group.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        return np.bincount((keys[head] >> np.uint64(40)).astype(np.int64), minlength=total).astype(np.float64)

    own_doc = doc[line]
    doc_words = np.bincount(own_doc, minlength=len(texts)).astype(np.float64)
    last_byte = data[words.ends - 1] if len(h) else np.empty(0, np.uint8)
    total = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(h), out=total[1:])
        edge = np.searchsorted(words.starts, np.concatenate([starts, [len(data)]]))
        content = total[np.searchsorted(words.starts, ends)] - total[edge[:-1]]
        keyed = mix(content + doc.astype(np.uint64))
    _, inverse, times = np.unique(keyed, return_inverse=True, return_counts=True)
    mean = np.bincount(line, sizes, n) / each
    spread = np.sqrt(np.maximum(np.bincount(line, sizes**2, n) / each - mean**2, 0))
    inside = ends > starts
    opening = np.where(inside, data[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else 0, 0)
    closing = np.where(inside, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    columns = {
        "length": np.log1p(chars),
        "upper": per_line(_UPPER[data]) / np.maximum(letters, 1),
        "digit": per_line(_DIGIT[data]) / some,
        "stops": per_line(_STOPS[data]) / some,
        "symbols": per_line(_SYMBOL[data]) / some,
        "foreign": per_line(_FOREIGN[data]) / some,
        "word_length": np.minimum(mean, 40) / 10,
        "word_spread": np.minimum(spread, 40) / 10,
        "adjacent_repeats": np.bincount(line, again, n) / each,
        "distinct": distinct(line, n) / each,
        "symbol_ends": np.bincount(line, _SYMBOL[last_byte], n) / each,
        "repeated_line": ((times[inverse] > 1) & (n_words > 0)).astype(np.float64),
        "capital_start": _UPPER[opening].astype(np.float64),
        "full_stop_end": (closing == ord(".")).astype(np.float64),
        "document_repeats": (1 - distinct(own_doc, len(texts)) / np.maximum(doc_words, 1))[doc],
        "empty": (n_words == 0).astype(np.float64),
        "bangs": per_line(_BANG[data]) / some,
        "letters_in_word": letters / np.maximum(np.bincount(line, sizes, n), 1),
        "markup": per_line(_MARKUP[data]) / some,
    }
    out = np.zeros((n, WIDTH), np.float32)
    for j, name in enumerate(FEATURES):
        out[:, j] = columns[name]
    at = len(FEATURES)
    same = doc[1:] == doc[:-1]
    for name in NEIGHBOURS:
        x = columns[name]
        out[1:, at] = np.where(same, x[:-1], 0)
        out[:-1, at + 1] = np.where(same, x[1:], 0)
        at += 2
    out[:, -1] = 1
    return out, chars, counts


@dataclass
class Field:
    """Weights of the good state (the bad one's are 0), and the steps' scores, [from][to], 0 bad, 1 good."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH))

    def normalised(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -8, 8)

    def marginals(self, x: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Of normalised lines: the probability of good; and, given weights of lines, the expected steps into them summed."""
        own = np.zeros((len(x), 2))
        own[:, 1] = x @ self.weights
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        lengths = counts[order]
        alpha, beta = own.copy(), np.zeros_like(own)
        deepest = int(lengths[0]) if len(lengths) else 0
        running = np.searchsorted(-lengths, -np.arange(deepest + 1), "left")  # chains longer than t
        for t in range(1, deepest):
            at = first[order[: running[t]]] + t
            before = alpha[at - 1]
            for b in (0, 1):
                alpha[at, b] += np.logaddexp(before[:, 0] + self.steps[0, b], before[:, 1] + self.steps[1, b])
        for t in range(deepest - 1, 0, -1):
            at = first[order[: running[t]]] + t
            after = beta[at] + own[at]
            for a in (0, 1):
                beta[at - 1, a] = np.logaddexp(self.steps[a, 0] + after[:, 0], self.steps[a, 1] + after[:, 1])
        final = alpha[first + counts - 1]
        log_z = np.logaddexp(final[:, 0], final[:, 1])
        of = np.repeat(log_z, counts)
        good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - of, 0))
        if weight is None:
            return good, None
        inner = np.ones(len(x), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        return good, np.array([[weight[at] @ np.exp(alpha[at - 1, a] + self.steps[a, b] + own[at, b] + beta[at, b] - of[at]) for b in (0, 1)] for a in (0, 1)])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Quality of each text: its lines' marginals weighted by their length; an empty line weighs 1."""
        if not texts:
            return np.empty(0)
        features, chars, counts = line_features(texts)
        good, _ = self.marginals(self.normalised(features), counts)
        doc = np.repeat(np.arange(len(texts)), counts)
        weight = np.maximum(chars, 1)
        return np.clip(np.bincount(doc, good * weight) / np.bincount(doc, weight), 0, 1)


def fit_field(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Gradient ascent (Adam) on the log-likelihood a line, both labels weighing the same."""
    model = Field()
    if not len(labels) or labels.min() == labels.max():
        if len(labels):
            model.weights[-1] = 2.0 * (2 * int(labels[0]) - 1)
        return model
    model.mean, model.scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    model.mean[-1], model.scale[-1] = 0, 1
    x = model.normalised(features.astype(np.float64))
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    y = np.repeat(labels, counts)
    # Each document weighs the same within its label, however many lines it has.
    weight = np.repeat(share / counts, counts)
    seen = np.diag([(share * (counts - 1) / counts)[labels == k].sum() for k in (0, 1)])
    moments = np.zeros((2, WIDTH + 4))
    for step in range(1, rounds + 1):
        good, expected = model.marginals(x, counts, weight)
        gradient = np.concatenate([x.T @ (weight * (y - good)) - decay * model.weights, (seen - expected).ravel() - decay * model.steps.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        change = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        model.weights += change[:WIDTH]
        model.steps += change[WIDTH:].reshape(2, 2)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


@lean
def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in rows_of(batch):
            features, _, counts = line_features(utf8(rows.column("text")))
            cuts = np.concatenate([[0], np.cumsum(counts)])
            packed = [features[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([rows.column("quality"), pa.array(packed, pa.binary())], names=["quality", "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, sample_bytes: int = 16384) -> Field:
    """A field fitted on at most ``sample`` labelled documents of at most ``sample_bytes`` bytes.

    The sample is the first labelled rows by a hash of the id, none held out. The two bounds make up what
    the driver gets. Without labels each score is one half.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & ~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where(F.octet_length("text") <= sample_bytes)
    rows = texts.join(F.broadcast(known), "id").select("quality", "text").limit(2 * sample).mapInArrow(_sample_features, "quality int, features binary").collect()
    rows = sorted((r["quality"], bytes(r["features"])) for r in rows)
    if not rows:
        return Field()
    features = [np.frombuffer(f, np.float32).reshape(-1, WIDTH) for _, f in rows]
    return fit_field(np.concatenate(features), np.array([len(f) for f in features]), np.array([q for q, _ in rows]))


def _score(model: Field, text_col: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rows_of(batch, batch.column("row").field(text_col), 1 << 20):
                scores = model.scores(utf8(rows.column("row").field(text_col)))
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def score_quality(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """``docs`` as a struct ``row`` with its ``score``, 0 to 1, beside it.

    A null or empty text is one empty line and gets that line's score. Rows are scored alone, by their text
    only, so ids may be null or repeat and columns may have any names. Empty tables give no rows. There is
    no shuffle.
    """
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return base.mapInArrow(_score(model, text_col), T.StructType([base.schema["row"], T.StructField("score", T.DoubleType())]))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``.

    Each row is judged alone, by its text, a null one being empty; rows with null or repeated ids are judged like others.
    All columns are passed on, whatever their names. An empty table gives no rows.
    """
    done = score_quality(docs, train(docs, labels))
    return done.where(F.col("score") >= threshold).select(*[F.col("row")[c].alias(c) for c in docs.columns])
