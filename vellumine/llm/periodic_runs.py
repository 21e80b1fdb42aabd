"""Periodic runs in documents: every maximal stretch of words that repeats itself.

For each period p, neighbours on the grid 0, p, 2p ... are extended to both sides; a run of
period p holds two neighbours, so n / p + n / 2 + ... + 1 pairs find all runs. A pair counts
only if three words before or behind both agree, which hashes of three words tell first. What
is left is extended by lce.Extensions, over the text and over its reverse. Many documents are
handled as one text, parted by numbers that occur once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lce import Extensions

#: A run has at least this many words (and at least two periods).
SHORTEST = 12
#: Words handled at once (a longer document is handled alone).
CHUNK = 1 << 19
#: Periods from which on many are handled at once.
_FEW = 512
_PAIRS = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass
class Runs:
    """Runs of some documents, by document, start and period."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One text of all documents, each behind a number that occurs once; and where they start."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    top = max((int(d.max(initial=0)) for d in docs), default=0) + 1
    text = np.empty(int(sizes.sum()) + len(docs) + 1, np.int64)
    text[np.append(starts - 1, len(text) - 1)] = top + np.arange(len(docs) + 1)
    for s, d in zip(starts.tolist(), docs):
        text[s : s + len(d)] = d
    return text, starts


def _grid(text: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i and periods p of grid neighbours i, i + p that may lie in one run.

    Documents lie in the text by falling size, so those with two periods of p are a prefix.
    Of p - or 12 - p - more words that must agree around a pair, three agree on one side.
    """
    three = np.zeros(len(text) + 3, np.uint64)  # hash of the words at k, k + 1, k + 2; three[k + 3] sits at k
    words = np.append(text, text[-1:].repeat(2) + 1).astype(np.uint64)
    three[3:] = words[: len(text)] * _MIX[0] + words[1 : len(text) + 1] * _MIX[1] + words[2 : len(text) + 2] * _MIX[2]
    three[:3] = np.arange(3)
    largest = int(sizes.max(initial=0)) // 2
    last = np.append(0, ends)[np.searchsorted(-sizes, -2 * np.arange(largest + 2), "right")]  # by period
    for p in range(1, min(largest, _FEW - 1) + 1):
        n = int(last[p])
        a, b = three[3 : n - p + 3 : p], three[p + 3 : n + 3 : p]
        c, d = three[0 : n - p : p], three[p:n:p]
        at = np.flatnonzero((a == b) | (c == d))
        if len(at):
            yield at * p, np.full(len(at), p)
    p = _FEW
    while p <= largest:
        counts = np.maximum(0, (last[p : largest + 1] - 1) // np.arange(p, largest + 1))
        many = max(1, int(np.searchsorted(np.cumsum(counts), _PAIRS)))
        counts = counts[:many]
        period = np.repeat(np.arange(p, p + len(counts)), counts)
        i = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period
        j = i + period
        use = (three[i + 3] == three[j + 3]) | (three[i] == three[j])
        if use.any():
            yield i[use], period[use]
        p += many


def runs_of(docs: list[np.ndarray], shortest: int = SHORTEST) -> Runs:
    """All runs of documents given as non-negative integer words.

    A run has its smallest period q, at least max(shortest, 2 q) words, and can't be longer;
    shortest must be 5 or more. One run is found by many periods and pairs: a pair counts if it
    is the first of its period in the run, and of the periods the smallest stays.
    """
    if shortest < 5:
        raise ValueError("shortest must be 5 or more")
    order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
    order = [k for k in order if len(docs[k]) >= shortest]
    empty = np.zeros(0, np.int64)
    if not order:
        return Runs(empty, empty, empty, empty)
    sizes = np.array([len(docs[k]) for k in order])
    text, starts = _joined([docs[k] for k in order])
    found = list(_grid(text, starts + sizes, sizes))
    if not found:
        return Runs(empty, empty, empty, empty)
    i, p = (np.concatenate(x) for x in zip(*found))
    own = np.searchsorted(starts, i, "right") - 1
    inside = (own >= 0) & (i + p < starts[own] + sizes[own])  # both in one document
    i, p, own = i[inside], p[inside], own[inside]
    # documents without such a pair have no run; the others make a shorter text
    some, where = np.unique(own, return_inverse=True)
    text2, starts2 = _joined([docs[order[k]] for k in some.tolist()])
    i = i - starts[own] + starts2[where]
    n = len(text2)
    right = Extensions(text2).ahead(i, i + p)
    left = Extensions(text2[::-1]).ahead(n - i, n - i - p)
    start, end = i - left, i + p + right
    good = (end - start >= np.maximum(2 * p, shortest)) & (left < p)
    start, end, p, where = start[good], end[good], p[good], where[good]
    by = np.lexsort((p, end, start))
    start, end, p, where = start[by], end[by], p[by], where[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p, where = start[new], end[new], p[new], where[new]
    doc, start = np.array(order)[some[where]], start - starts2[where]
    by = np.lexsort((p, start, doc))
    return Runs(doc[by], start[by], (end - starts2[where] - start)[by], p[by])


def kept_words(size: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of `size` words no run holds behind its first period."""
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) == 0


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of some documents at a time."""
    ids, words, held = [], [], 0
    for b in batches:
        for id_, text in zip(b.column(0).to_pylist(), b.column(1)):
            w = (text.as_py() or b"").split()
            ids.append(id_)
            words.append(w)
            held += len(w) + 1
            if held >= most:
                yield ids, words
                ids, words, held = [], [], 0
    if ids:
        yield ids, words


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, chunk: int = CHUNK
) -> DataFrame:
    """One row per document: doc_id, runs (array of start, length, period by start and period), collapsed.

    Words are what stands between the characters of [\\x20\\x09-\\x0D] and are numbered from 0.
    collapsed joins by one space the words that stay if every run keeps its first period only.
    Null, empty and wordless texts have no run and an empty collapsed text. Every row is handled
    by itself, so repeated and null ids are kept as they are. Other columns are ignored. Nothing
    is shuffled; a task holds about `chunk` words, or one document if that is longer.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in _chunks(batches, chunk):
            number: dict[bytes, int] = {}
            texts = [np.array([number.setdefault(x, len(number)) for x in w], np.int64) for w in words]
            found = runs_of(texts, shortest)
            at = np.searchsorted(found.doc, np.arange(len(words) + 1))
            collapsed = []
            for k, w in enumerate(words):
                own = slice(at[k], at[k + 1])
                if at[k] < at[k + 1]:
                    stay = kept_words(len(w), found.start[own], found.length[own], found.period[own])
                    w = [w[x] for x in np.flatnonzero(stay).tolist()]
                collapsed.append(b" ".join(w))
            values = pa.StructArray.from_arrays([pa.array(x) for x in (found.start, found.length, found.period)], fields=list(run))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kinds = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(each, kinds)
