"""How sources of a language differ in their words: exact divergences between all of them, and the terms that mark each.

Every group (language, source) and every language gives each kept term a smoothed share p. Between two groups the
divergence sums floor((p - q)**2 / q) over all kept terms. Most terms are in few groups, and elsewhere their share is
the group's least one, that of count 0. So a pair's sum is taken to be (kept terms) * f(least, least), and what terms add
to that comes in two parts, both in whole numbers:

* terms present in many groups of their language make dense tiles of shares, groups by terms, compared as wholes;
* of rarer terms only the postings are looked at: f(p, least of the other) by a histogram of p, once a group and other
  group, and for two groups that both have the term a correction of that.

Blocks of groups and parts of the terms make cells of bounded size, whose sums Spark adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_small, lean, materialize, rows_of, shuffle_partitions, word_spans

#: A share is a whole number of so many parts.
UNIT = 1_000_000_000
#: A term is compared densely from so many hundredths of its language's groups on.
HEAVY = 25
#: Groups of a block, and postings of a cell if its language were the only one.
BLOCK, CELL = 64, 200_000
#: Numbers of a tile, or corrections, that are made together.
TILE = 1 << 21
#: Bytes of text that are counted together; a longer text comes alone.
SLICE = 8 << 20
_LETTER_BYTE = np.array([chr(b).isalpha() or b > 127 for b in range(256)])
_COUNTS = "lang string, source string, term string, n long, docs long"


def _term_counts(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Occurrences of each term in each group, and in how many rows."""
    data, starts, sizes, of = word_spans(texts, _LETTER_BYTE)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    place = np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[place])]).dictionary_encode()
    n_terms = max(1, len(spelled.dictionary))
    langs, sources = langs.dictionary_encode(), sources.dictionary_encode()
    lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
    group, n_sources = lang * max(1, len(sources.dictionary)) + source, max(1, len(sources.dictionary))
    key, n = np.unique(of * n_terms + spelled.indices.to_numpy(zero_copy_only=False), return_counts=True)
    key, inverse, docs = np.unique(group[key // n_terms] * n_terms + key % n_terms, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, n, len(key)).astype(np.int64)
    group, term = key // n_terms, key % n_terms
    columns = [langs.dictionary.take(pa.array(group // n_sources)), sources.dictionary.take(pa.array(group % n_sources)), spelled.dictionary.take(pa.array(term)).cast(pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])


@lean
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in rows_of(batch, "text", SLICE):
            yield _term_counts(*(rows.column(c).fill_null("") for c in ("lang", "source", "text")))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (total + terms)); the product needs more than 64 bits."""
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)")) + 1


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n (occurrences), n_lang, in_groups, lead (one row a term): the terms of ``least_docs`` rows or more."""
    counts = docs.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    rows = counts.select("*", F.sum("n").over(same).alias("n_lang"), F.sum("docs").over(same).alias("all_docs"), F.count("*").over(same).alias("in_groups"), (F.min("source").over(same) == F.col("source")).alias("lead"))
    return rows.where(F.col("all_docs") >= least_docs).drop("docs", "all_docs")


def all_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, place (from 0 in its language), total, lang_total, terms, groups, least: every group, with terms or without."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("lead").alias("own"))
    rows = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    whole = Window.partitionBy("lang")
    rows = rows.select(
        "lang", "source", (F.row_number().over(whole.orderBy("source")) - 1).alias("place"), F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce(F.sum("total").over(whole), F.lit(0)).alias("lang_total"), F.coalesce(F.sum("own").over(whole), F.lit(0)).alias("terms"), F.count("*").over(whole).alias("groups"),
    )
    return rows.withColumn("least", share(F.lit(0), F.col("total"), F.col("terms")))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return (d * d).view(np.uint64) // q.view(np.uint64)  # below 2**63, and unsigned division is the faster


def _sums(x: np.ndarray, axis: int) -> np.ndarray:
    return x.sum(axis=axis, dtype=np.uint64).view(np.int64)


def dense_tile(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Over terms (rows) the sums of f between each column of ``p`` and each of ``q``."""
    out, step = np.zeros((p.shape[1], q.shape[1]), np.int64), max(1, TILE // max(1, p.shape[1] * q.shape[1]))
    for a in range(0, len(p), step):
        out += _sums(_f(p[a : a + step, :, None], q[a : a + step, None, :]), 0)
    return out


def sparse_pairs(own: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], least: np.ndarray, other_least: np.ndarray) -> np.ndarray:
    """What rare terms add to f(least, least) for each pair of groups; postings are (term, group, share), sorted by term."""
    base = _f(least[:, None], other_least[None, :]).view(np.int64)
    out = np.zeros(base.shape, np.int64)
    for (_, group, p), turned in ((own, False), (other, True)):  # one of the two has the term
        order = np.lexsort((p, group))
        group, p = group[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (p[1:] != p[:-1])])) if len(p) else np.zeros(0, np.int64)
        times, group, p = np.diff(np.append(first, len(p))), group[first], p[first]
        step = max(1, TILE // max(1, base.shape[0 if turned else 1]))
        for a in range(0, len(p), step):
            g, x, n = group[a : a + step], p[a : a + step], times[a : a + step, None]
            if turned:
                np.add.at(out.T, g, (_f(least[None, :], x[:, None]).view(np.int64) - base.T[g]) * n)
            else:
                np.add.at(out, g, (_f(x[:, None], other_least[None, :]).view(np.int64) - base[g]) * n)
    term, group, p = own
    low, high = (np.searchsorted(other[0], term, side) for side in ("left", "right"))
    upto = np.concatenate([[0], np.cumsum(high - low)])
    a = 0
    while a < len(term):  # both have it
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + TILE, "right")) - 1)
        n = high[a:b] - low[a:b]
        at = np.repeat(low[a:b] - (upto[a:b] - upto[a]), n) + np.arange(upto[b] - upto[a])
        g, x, h, y = np.repeat(group[a:b], n), np.repeat(p[a:b], n), other[1][at], other[2][at]
        added = _f(x, y).view(np.int64) - _f(x, other_least[h]).view(np.int64) - _f(least[g], y).view(np.int64) + base[g, h]
        np.add.at(out, (g, h), added)
        a = b
    return out


def _cell(block: int):
    """Sums of one cell: groups of blocks ``low`` and ``high``, some of the terms. Its first part of the terms also has the sums of least shares."""

    def run(postings: pa.Table, groups: pa.Table) -> pa.Table:
        part, low, high = (groups.column(c)[0].as_py() for c in ("chunk", "low", "high"))
        place = groups.column("place").to_numpy()
        order = np.argsort(place)
        place, least = place[order], groups.column("least").to_numpy()[order]
        names, lang, terms = groups.column("source").combine_chunks().take(pa.array(order)), groups.column("lang")[0].as_py(), groups.column("terms")[0].as_py()
        term = postings.column("term").combine_chunks().dictionary_encode()
        n_terms, term = len(term.dictionary), term.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        group, p, heavy = np.searchsorted(place, postings.column("place").to_numpy()), postings.column("p").to_numpy(), postings.column("heavy").to_numpy(zero_copy_only=False)
        dense, at = np.unique(term[heavy], return_inverse=True)
        tile = np.broadcast_to(least, (len(dense), len(place))).copy()
        tile[at, group[heavy]] = p[heavy]
        order = np.argsort(term[~heavy], kind="stable")
        rare = [x[~heavy][order] for x in (term, group, p)]
        sides = [np.flatnonzero(place // block == b) for b in dict.fromkeys((low, high))]
        found = []
        for mine, theirs in ((0, -1), (-1, 0))[: len(sides)]:
            a, b = sides[mine], sides[theirs]
            base = _f(least[a][:, None], least[b][None, :]).view(np.int64)
            postings_of = [tuple(x[(rare[1] >= s[0]) & (rare[1] <= s[-1])] - (s[0] if k == 1 else 0) for k, x in enumerate(rare)) if len(s) else (np.zeros(0, np.int64),) * 3 for s in (a, b)]
            value = dense_tile(tile[:, a], tile[:, b]) - len(dense) * base + sparse_pairs(*postings_of, least[a], least[b])
            if part == 0:
                value += terms * base
            g, h = np.nonzero((a[:, None] != b[None, :]) & ((value != 0) | (part == 0)))
            found.append((names.take(pa.array(a[g])), names.take(pa.array(b[h])), pa.array(value[g, h])))
        source, item, value = (pa.chunked_array(x) for x in zip(*found, strict=True))
        return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": source, "item": item, "value": value})

    return run


def _between(first: Column | int, last: Column) -> Column:
    return F.explode(F.sequence(F.lit(first) if isinstance(first, int) else first, last))


def pair_divergences(postings: DataFrame, groups: DataFrame, n_postings: int, block: int = BLOCK, cell: int = CELL, heavy: int = HEAVY) -> DataFrame:
    """lang, source, item, value: for each ordered pair of a language's groups. Postings hold place, p, in_groups and groups."""
    chunks = max(1, -(-n_postings // cell))
    last = F.ceil(F.col("groups") / block).cast("int") - 1
    own = F.floor(F.col("place") / block).cast("int")
    keys = ["lang", "chunk", "low", "high"]
    blocks = [F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high")]
    shares = postings.select("lang", "term", "place", "p", (F.col("in_groups") * 100 >= heavy * F.col("groups")).alias("heavy"), F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk"), own.alias("own"), _between(0, last).alias("met")).select("lang", "term", "place", "p", "heavy", "chunk", *blocks)
    heads = groups.select("lang", "source", "place", "least", "terms", own.alias("own"), _between(0, last).alias("met")).select("lang", "source", "place", "least", "terms", *blocks, _between(0, F.lit(chunks - 1)).alias("chunk"))
    tasks = shuffle_partitions(postings.sparkSession)
    shares, heads = (x.toDF(*x.columns).repartition(tasks, *keys) for x in (shares, heads))  # names of their own: both come from the groups
    sums = shares.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInArrow(_cell(block), "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def marking_terms(postings: DataFrame, most: int) -> DataFrame:
    """lang, source, item, value, rank: the ``most`` terms of each group whose share is furthest above its language's.

    A group's terms are ranked in parts first, so that no task gets all terms of a large one.
    """
    above = postings.withColumn("q", share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))).where("p > q")
    above = above.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"), F.pmod(F.xxhash64("term"), F.lit(32)).alias("part"))
    for keys in (["lang", "source", "part"], ["lang", "source"]):
        above = above.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= most)
    return above.drop("part")


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, block: int = BLOCK, cell: int = CELL, heavy: int = HEAVY, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank (from 1 in its group and part; highest value first, then item by bytes).

    Part ``pair``: the divergence of each group from each other source of its language, 0 where the language keeps no
    term. Part ``term``: the terms that mark a group, up to ``most_terms``. A term is a run of letters or characters
    beyond ASCII, in lower case as to A-Z; terms of fewer than ``least_docs`` rows of a language are not kept. Null
    text, language or source is an empty one. Each row is a document, so repeated rows count anew; ids and other columns
    are not read. A language of one source has no pairs. An empty table gives no rows.
    ``block`` (groups), ``cell`` (postings) and ``heavy`` (hundredths of the groups) say how the work is cut, not what comes out.
    """
    docs = docs.select(F.coalesce(docs[lang_col], F.lit("")).alias("lang"), F.coalesce(docs[source_col], F.lit("")).alias("source"), docs[text_col].alias("text"))
    kept = materialize(kept_terms(docs, least_docs))
    groups = materialize(all_groups(docs, kept))
    postings = joined_small(kept, groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    pairs = pair_divergences(postings, groups, kept.count(), block, cell, heavy)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    parts = [pairs.withColumn("part", F.lit("pair")), marking_terms(postings, most_terms).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")
