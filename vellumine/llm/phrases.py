"""Phrase collocation mining by Rabin-Karp fingerprints.

Prefix polynomials modulo 2**64 give the fingerprint of every word (over its bytes) and of
every phrase (over its words' fingerprints), the language folded in. Level by level tasks count
fingerprints: words; phrases of two frequent words; phrases of three and four all of whose
pairs are frequent. What is frequent so far goes to the tasks as a bit map of fixed size, whose
chance hits only cost work. Counts by fingerprint are never too small, but collisions may make
them too large; so at the end the occurrences of frequent fingerprints are counted by their
words, and of each phrase a task cuts the text at one place only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_of_each
from .common import cut, shuffles_dropped

LONGEST = 4
LEAST = 30
FIRST = 2000
#: Bits of a map of frequent fingerprints (16 MB), whatever the corpus.
MAP_BITS = 27
#: Bytes of text handled at once; a piece that is longer is handled alone.
CHUNK = 1 << 20
SCALE, COVERED = 2_000_000, (100, 80)

_BASE, _WORD_BASE = 0x5851F42D4C957F2D, 0xD1342543DE82EF95  # odd, so they have inverses modulo 2**64
_U = np.uint64


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: 0 in a word, 1 white space, 2 between pieces; and its lower case."""
    kind = np.zeros(256, np.uint8)
    kind[[0x20, 0x09]] = 1
    kind[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return kind, lower


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n + (n >> 3), 1 << 16), base, _U)
        held[0] = 1
        _powers[base] = held = np.multiply.accumulate(held)
    return held[:n]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """sum of values[k] * base ** -(k - start) over each span, from one prefix polynomial."""
    inverse = pow(base, -1, 1 << 64)
    prefix = np.zeros(len(values) + 1, _U)
    np.cumsum(values.astype(_U) * _power(inverse, len(values)), out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * _power(base, len(values) + 1)[starts]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits, so that sums of word fingerprints don't hang on their letters."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Words:
    """The words of a chunk: bytes in lower case, places, pieces and fingerprints."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        kind, lower = _classes()
        of = kind[data]
        self.data = lower[data]
        edge = np.zeros(len(data) + 1, bool)  # a document begins here
        edge[offsets[:-1]] = True
        edge[-1] = True
        inside = np.append(of == 0, False)
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge))
        self.ends = np.flatnonzero(before & (~inside | edge))
        cuts = edge.astype(np.int8)
        cuts[1:] += of == 2
        self.piece = np.cumsum(cuts, dtype=np.int32)[self.starts]
        doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.lang = langs[doc]
        length = (self.ends - self.starts).astype(_U)
        self.word = _mixed(_spans(self.data, self.starts, self.ends, _BASE) + length * _U(0x9E3779B97F4A7C15))

    def places(self, n: int) -> np.ndarray:
        """Numbers of the words at which n words of one piece begin."""
        m = max(0, len(self.piece) - n + 1)
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1 :][:m])

    def prints(self, at: np.ndarray, n: int, seeds: np.ndarray) -> np.ndarray:
        """Fingerprints of the n words at `at`, in their language."""
        return _mixed(_spans(self.word, at, at + n, _WORD_BASE) * _U(2) + seeds[self.lang[at]] + _U(n))

    def exact(self) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the words, equal if and only if their bytes are, and the words by number."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.starts] += 1
        np.add.at(inside, self.ends, -1)
        letters = self.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        ends = np.append(0, np.cumsum(self.ends - self.starts)).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        found = column.dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary.cast(pa.large_string(), safe=False)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Words, np.ndarray, list[str]]]:
    """Words of about `most` bytes at a time, seeds and names of their languages.

    Documents end a chunk, and so may an end of a piece within a long one: no phrase is cut.
    """
    kind, _ = _classes()
    for b in batches:
        texts = b.column(1).cast(pa.large_binary())
        names = b.column(0).to_pylist()
        known = sorted(set(names))
        langs = np.array([known.index(x) for x in names], np.int64)
        seeds = np.array([int.from_bytes(_digest(x), "little") for x in known], _U)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at, last = int(offsets[0]), int(offsets[-1])
        while at < last:
            end = min(last, at + most)
            if end < last:
                end = _edge(kind, data, offsets, at, end, last)
            first, behind = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end, "left")
            own = np.clip(offsets[first : behind + 1], at, end) - at
            yield Words(data[at:end], own, langs[first:behind]), seeds, known
            at = end


def _edge(kind: np.ndarray, data: np.ndarray, offsets: np.ndarray, at: int, end: int, last: int) -> int:
    """The last end of a document or piece in (at, end], or else the first one behind."""
    doc = int(offsets[np.searchsorted(offsets, end, "right") - 1])
    cuts = np.flatnonzero(kind[data[max(at, doc) : end]] == 2)
    best = max(doc, max(at, doc) + int(cuts[-1]) + 1 if len(cuts) else 0)
    if best > at:
        return best
    after = int(offsets[np.searchsorted(offsets, end, "left")])
    for x in range(end, after, 1 << 20):
        cuts = np.flatnonzero(kind[data[x : min(after, x + (1 << 20))]] == 2)
        if len(cuts):
            return x + int(cuts[0]) + 1
    return min(after, last)


def _digest(name: str) -> bytes:
    return xxhash.xxh64(name.encode("utf-8", "surrogatepass"), seed=11).digest()


def _hits(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = prints & _U(8 * len(bits) - 1)
    return (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _admitted(w: Words, seeds: np.ndarray, maps: list[np.ndarray], n: int) -> np.ndarray:
    """Places of n words that can be frequent: all words for n = 2, all pairs for more are."""
    at = w.places(n)
    part = min(n - 1, 2)
    if not part or not len(at):
        return at
    places = w.places(part)
    good = np.zeros(len(w.word) + 1, bool)
    good[places] = _hits(maps[part - 1], w.prints(places, part, seeds))
    for k in range(n - part + 1):
        at = at[good[at + k]]
    return at


def bit_map(prints: DataFrame, bits: int) -> np.ndarray:
    """The low bits of column `fp` as a map of 2**bits bits: at most 2**(bits - 15) rows of 4 KB reach the driver."""
    place = prints.select(F.expr(f"fp & {(1 << bits) - 1}").alias("p"))
    parts = place.groupBy(F.expr("p >> 15").alias("part")).agg(F.bitmap_construct_agg(F.expr("p & 32767")).alias("map"))
    out = np.zeros(1 << max(bits - 3, 12), np.uint8)
    for r in parts.collect():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["map"], np.uint8)
    return out


def _counter(numbers: tuple[int, ...], maps: Callable[[], list[np.ndarray]], chunk: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, seeds, _ in _chunks(batches, chunk):
            for n in numbers:
                fp, count = np.unique(w.prints(_admitted(w, seeds, maps(), n), n, seeds), return_counts=True)
                if len(fp):
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(count)], names=["fp", "n"])

    return each


def _teller(longest: int, maps: Callable[[], list[np.ndarray]], chunk: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, seeds, names in _chunks(batches, chunk):
            ids, words = w.exact()
            langs = pa.array(names, pa.string())
            code, count = np.unique(w.lang, return_counts=True)
            yield _told(langs.take(pa.array(code)), 0, pa.array([""] * len(code), pa.string()), count)
            for n in range(1, longest + 1):
                at = _admitted(w, seeds, maps(), n)
                at = at[_hits(maps()[n - 1], w.prints(at, n, seeds))]
                key = w.lang[at]  # grouped by language and the words themselves
                for k in range(n):
                    key = np.unique(key, return_inverse=True)[1] * len(words) + ids[at + k]
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                at = at[first]  # of each phrase one occurrence
                phrase = pc.binary_join_element_wise(*[words.take(pa.array(ids[at + k])) for k in range(n)], pa.scalar(" ", pa.large_string()))
                yield _told(langs.take(pa.array(w.lang[at])), n, phrase.cast(pa.string()), count)

    return each


def _told(lang: pa.Array, words: int, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    columns = [lang, pa.array(np.full(len(lang), words, np.int32)), phrase, pa.array(count, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "n"])


def frequent_phrases(
    docs: DataFrame,
    text_col: str = "text",
    group: Column | None = None,
    least: int = LEAST,
    longest: int = LONGEST,
    bits: int = MAP_BITS,
    chunk: int = CHUNK,
) -> DataFrame:
    """lang, words (how many), phrase, n: every phrase of 1 to `longest` words that occurs `least` times in its lang.

    A row of words = 0 and an empty phrase has the number of all words of a lang. Texts are
    lower-cased in A-Z and split at [.,;:!?\\x0A-\\x0D] into pieces and at spaces and tabs into
    words; overlapping occurrences count, those across pieces don't. lang is `group` (the column
    lang unless given), null counts as `und`. Null, empty and wordless texts have no phrase; every
    row counts, repeated ones too; other columns are ignored. Counts are exact.
    """
    group = F.col("lang") if group is None else group
    rows = docs.select(F.coalesce(group.cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    context = docs.sparkSession.sparkContext
    sent: list = []

    def maps() -> list[np.ndarray]:
        return [np.frombuffer(m.value, np.uint8) for m in sent]

    level = 1
    while level <= longest:
        # from three words on all that is asked is that pairs are frequent, so one pass counts all
        numbers = (level,) if level < 3 else tuple(range(3, longest + 1))
        counts = rows.mapInArrow(_counter(numbers, maps, chunk), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
        with shuffles_dropped(docs.sparkSession):
            often = context.broadcast(bit_map(counts.where(F.col("n") >= least).select("fp"), bits).tobytes())
        sent += [often] * len(numbers)
        level += len(numbers)
    told = rows.mapInArrow(_teller(longest, maps, chunk), "lang string, words int, phrase string, n long")
    return told.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))


def _some_words(first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice("__w", F.lit(first) if isinstance(first, int) else first, F.lit(count) if isinstance(count, int) else count), " ")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    group: Column | None = None,
    least: int = LEAST,
    longest: int = LONGEST,
    first: int = FIRST,
    **limits: int,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` phrases of two or more words of each lang.

    a, l, r count the phrase and the parts of its lowest-scoring cut (ties: the shortest first
    part), n all words; score is floor(2000000 * a / (l + r)). A phrase goes if one that holds it
    and is frequent too has 80 % of its count or more. Order: score and a falling, then phrase
    by bytes. See frequent_phrases for the reading of texts and odd rows; an empty table gives no
    rows.
    """
    found = frequent_phrases(docs, text_col, group, least, longest, **limits)
    with shuffles_dropped(docs.sparkSession):
        counted = cut(found, "phrase-counts")
    parts = counted.where("words > 0").select("lang", "phrase", "n")
    several = counted.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("__w"))
    cuts = several.select("lang", "words", "phrase", "a", "__w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "words", "phrase", "a", "k",
        _some_words(1, F.col("k")).alias("left"), _some_words(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        other = parts.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__part"), F.col("n").alias(name))
        cuts = cuts.join(other, (F.col("lang") == F.col("__lang")) & (F.col(side) == F.col("__part"))).drop("__lang", "__part")
    # floor in whole numbers: the product needs more than 64 bits from 4.6e12 occurrences on
    score = F.expr(f"cast(cast({SCALE} * cast(a as decimal(20, 0)) as decimal(38, 0)) div cast(cast(l as decimal(20, 0)) + r as decimal(38, 0)) as bigint)")
    cuts = cuts.withColumn("score", score)
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(lowest).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # where a longer phrase covers a shorter one
    spans = [(n, s, k) for n in range(3, longest + 1) for k in range(2, n) for s in range(1, n - k + 2)]
    inner = F.array(*[F.when(F.col("words") == n, _some_words(s, k)) for n, s, k in spans]) if spans else F.array(F.lit(None).cast("string"))
    held = several.where("words > 2").select("lang", F.col("a").alias("b"), F.explode(F.array_distinct(inner)).alias("phrase"))
    held = held.where("phrase is not null").groupBy(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase")).agg(F.max("b").alias("b"))
    over = (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__phrase")) & F.expr(
        f"{COVERED[0]} * cast(b as decimal(20, 0)) >= {COVERED[1]} * cast(a as decimal(20, 0))"
    )
    stay = scored.join(held, over, "left_anti")
    total = counted.where("words = 0").select(F.col("lang").alias("__lang"), F.col("n").alias("n"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = top_of_each(stay, ["lang"], order, first).join(F.broadcast(total), F.col("lang") == F.col("__lang"))
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
