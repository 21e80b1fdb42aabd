"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; letters above U+024F share 432 of them by a hash.
A letter n-gram is the product (binding) of its letters' vectors, each rotated (permuted) by its
place; a document or a language is the sum (bundle) of its n-grams' vectors, and the language
whose profile has the largest cosine with the document's vector is predicted. Sums are linear,
so n-grams are counted first and each distinct n-gram of a batch is bound once, some thousand at
a time. Vectors are whole numbers below 2**53, so sums are exact in any order. Training sends
one fixed-size sum per language and task.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
GRAM = 3
SEED = 11
#: Symbols: 0 is a word's edge, code points below DIRECT stand for themselves, others are hashed.
SYMBOL_BITS, DIRECT = 10, 0x250
UNDETERMINED = "und"
#: Documents and n-grams that are bound at a time.
_DOCS, _GRAMS = 256, 4096


@cache
def _letters() -> np.ndarray:
    """Symbol of every code point of category L or M (case folded by the caller), else 0."""
    kind = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)), bool)
    at = np.arange(len(kind), dtype=np.int64)
    rest = (1 << SYMBOL_BITS) - DIRECT
    return np.where(kind, np.where(at < DIRECT, at, DIRECT + (at * 2654435761 >> 7) % rest), 0).astype(np.int64)


@cache
def _vectors() -> np.ndarray:
    signs = np.random.default_rng(SEED).integers(0, 2, (1 << SYMBOL_BITS, DIMENSIONS), dtype=np.int8)
    return signs * 2 - 1


def grams(text: str) -> np.ndarray:
    """Keys of the letter n-grams of a text, repeats included; word edges count as a symbol."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _letters()[code]
    s = np.concatenate([[0], s, [0]])
    s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]
    if len(s) <= GRAM:
        s = np.concatenate([s, np.zeros(GRAM, np.int64)])[: GRAM + 1] if s.any() else s[:0]
    key = np.zeros(max(0, len(s) - GRAM + 1), np.int64)
    for k in range(GRAM if len(key) else 0):
        key = key << SYMBOL_BITS | s[k : len(s) - GRAM + 1 + k]
    return key


def bound(keys: np.ndarray) -> np.ndarray:
    """(n, DIMENSIONS) vectors of n-grams: the product of their letters' rotated vectors."""
    out = np.ones((len(keys), DIMENSIONS), np.int8)
    for k in range(GRAM):
        symbol = keys >> (SYMBOL_BITS * (GRAM - 1 - k)) & ((1 << SYMBOL_BITS) - 1)
        out *= np.roll(_vectors(), GRAM - 1 - k, axis=1)[symbol]
    return out


def bundle(keys: np.ndarray, counts: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Sum of the n-grams' vectors, each times its count; _GRAMS of them are held at a time.

    known: sorted n-grams, among them all of keys, with their vectors. All sums are of whole
    numbers: in single precision where they stay below 2**24, so both precisions are exact.
    """
    total = np.zeros(DIMENSIONS)
    for at in range(0, len(keys), _GRAMS):
        k, n = keys[at : at + _GRAMS], counts[at : at + _GRAMS]
        vectors = bound(k) if known is None else known[1][np.searchsorted(known[0], k)]
        kind = np.float32 if n.sum() < 1 << 24 else np.float64
        total += n.astype(kind) @ vectors.astype(kind)
    return total


def bundles(counted: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The bundle of each document's n-grams; those that documents share are bound once."""
    distinct = np.unique(np.concatenate([k for k, _ in counted])) if counted else np.zeros(0, np.int64)
    if len(distinct) > 16 * _GRAMS and len(counted) > 1:
        half = len(counted) // 2
        return bundles(counted[:half]) + bundles(counted[half:])
    known = (distinct, bound(distinct)) if len(distinct) <= 16 * _GRAMS else None
    return [bundle(k, n, known) for k, n in counted]


def profiles(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> dict[str, np.ndarray]:
    """Profile of every label: the bundle of all n-grams of all its texts, of length one.

    Rows without text or label teach nothing. What reaches the driver is DIMENSIONS numbers a
    language, whatever the number of documents.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(DIMENSIONS))
        for b in batches:
            label = np.array(b.column(1).to_pylist(), object)
            for one in set(label.tolist()):
                parts = [grams(b.column(0)[int(k)].as_py()) for k in np.flatnonzero(label == one)]
                for at in range(0, len(parts), _DOCS):
                    total[one] += bundle(*np.unique(np.concatenate(parts[at : at + _DOCS]), return_counts=True))
        for label, v in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(np.rint(v).astype(np.int64))],
                names=["label", "dim", "value"],
            )

    rows = docs.select(F.col(text_col).cast("string"), F.col(label_col).cast("string")).dropna()
    sums = rows.mapInArrow(summed, "label string, dim long, value long").groupBy("label", "dim").agg(F.sum("value"))
    found: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(DIMENSIONS))
    for label, dim, value in sums.collect():  # bounded: languages * DIMENSIONS
        found[label][dim] = value
    return {k: v / np.sqrt((v * v).sum()) for k, v in sorted(found.items()) if v.any()}


def predict(docs: DataFrame, known: dict[str, np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row with lang_pred and score.

    lang_pred is the label with the largest cosine, the first in code point order of equals;
    score is that cosine, 0 if negative. A null text or one without a letter, and any text if
    nothing was learned, gives `und` and 0. An empty table gives no rows.
    """
    names, matrix = list(known), np.array(list(known.values())).reshape(-1, DIMENSIONS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            texts = b.column(b.num_columns - 1)
            for at in range(0, b.num_rows, _DOCS):
                some = [t.as_py() or "" for t in texts.slice(at, _DOCS)]
                for text, v in zip(some, bundles([np.unique(grams(t), return_counts=True) for t in some])):
                    size = np.sqrt((v * v).sum())
                    if not size or not names or not any(map(str.isalpha, text)):
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    cosines = matrix @ v / size
                    best = int(cosines.argmax())
                    langs.append(names[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
            columns = [*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{n}" for n in range(len(keep))), "lang_pred", "score"])

    rows = docs.select(*[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)], F.col(text_col).cast("string").alias("t"))
    schema = rows.drop("t").schema.add("lang_pred", "string").add("score", "double")
    out = rows.mapInArrow(each, schema)
    return out.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)], "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """True for the documents that never teach: crc32 of the id's text, modulo 3, is 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from rows that aren't held out.

    A null id counts as not held out and teaches nothing.
    """
    known = profiles(docs.where(~held_out(id_col)), text_col, label_col)
    rows = docs.withColumn("__id", F.col(id_col)).withColumn("__held", F.coalesce(held_out(id_col), F.lit(False)))
    out = predict(rows, known, ["__id", "__held"], text_col)
    return out.select(F.col("__id").alias("doc_id"), F.col("__held").alias("held_out"), "lang_pred", "score")


def drop_undetermined(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", least: float = 0.0
) -> DataFrame:
    """docs without those that have no letter, or no positive cosine with any language.

    Text unlike every learned language has cosines that are noise round 0, so the default
    `least` doesn't reliably reject it: only `und` is rejected with certainty.
    A document goes if its lang_pred is `und` or its score isn't above `least`. All columns of
    the rows that stay are unchanged; nothing is shuffled.
    """
    known = profiles(docs.where(~held_out(id_col)), text_col, label_col)
    out = predict(docs, known, docs.columns, text_col)
    return out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") > least)).select(*docs.columns)
