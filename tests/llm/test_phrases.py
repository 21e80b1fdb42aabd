"""Phrase mining on texts where everything can be counted by hand or by a plain loop."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.llm import phrases

TEXTS = [
    ("The cat sat, the cat ran. THE CAT sat", "en"), ("the cat\tsat  on\nthe cat", "en"), ("the cat", None), (None, "en"), ("", "de"),
    (" ,.; ", "en"), ("é è é è é è É", "fr"), ("a a a a a a", "en"), ("x" * 3000 + " y", "en"), ("漢 字 漢 字 漢 字", "und"),
    ("the cat sat", "en"), ("the cat sat", "en"), ("b\x00c b\x00c", "en"), ("one:two three!four", "en"),
]


def plain(rows, least, first):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for s in range(len(w) - k + 1):
                    key = (lang, tuple(w[s : s + k]))
                    f[key] = f.get(key, 0) + 1
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, w), a in often.items():
        if any(
            len(o) > len(w) and ol == lang and 100 * b >= 80 * a and any(o[s : s + len(w)] == w for s in range(len(o)))
            for (ol, o), b in often.items()
        ):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, n[lang], -s)
        for lang, found in out.items()
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:first], 1)
    )


@pytest.mark.parametrize("least, first, chunk", [(2, 2000, 4 << 20), (2, 3, 8), (3, 2000, 40), (1, 2000, 1)])
def test_equals_plain_counts(spark, least, first, chunk):
    rows = spark.createDataFrame([(*r, 1, "p", 2) for r in TEXTS], "text string, lang string, n int, phrase string, a int")
    got = phrases.collocations(rows, least=least, first=first, chunk=chunk, bits=15)
    assert sorted(map(tuple, got.collect())) == plain(TEXTS, least, first)


def test_collisions_do_not_change_counts(spark, monkeypatch):
    """With fingerprints of six bits nearly everything collides; the words decide."""
    rows = spark.createDataFrame(TEXTS, "text string, lang string").repartition(1)
    real = phrases.Words.prints
    monkeypatch.setattr(phrases.Words, "prints", lambda self, at, n, seeds: real(self, at, n, seeds) & np.uint64(63))
    b = rows.select(F.coalesce("lang", F.lit("und")), F.coalesce("text", F.lit("")).cast("binary")).toArrow().to_batches()
    ones = np.full(4096, 255, np.uint8)
    told = [r for t in phrases._teller(4, lambda: [ones] * 4, 1 << 20)(iter(b)) for r in t.to_pylist()]
    f = Counter()
    for r in told:
        f[r["lang"], r["phrase"]] += r["n"]
    want = {(lang, p): a for lang, _, p, a, *_ in plain(TEXTS, 2, 2000)}
    assert {k: f[k] for k in want} == want


def test_empty_and_phraseless_tables(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(none).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("w", "en")], "text string, lang string")).collect() == []


def test_scores_beyond_64_bits(spark):
    a, l, r = 9_000_000_000_000, 9_000_000_000_001, 10_000_000_000_000
    score = F.expr(f"cast(cast({phrases.SCALE} * cast({a} as decimal(20, 0)) as decimal(38, 0)) div cast(cast({l} as decimal(20, 0)) + {r} as decimal(38, 0)) as bigint)")
    assert spark.range(1).select(score).first()[0] == int(Fraction(phrases.SCALE * a, l + r))


def test_map_is_of_fixed_size(spark):
    few, many = (phrases.bit_map(spark.range(n).select(F.xxhash64("id").alias("fp")), 20) for n in (10, 20_000))
    assert len(few) == len(many) == 1 << 17
    prints = np.array([r[0] for r in spark.range(20_000).select(F.xxhash64("id")).collect()]).view(np.uint64)
    assert phrases._hits(many, prints).all() and np.bitwise_count(few).sum() == 10
