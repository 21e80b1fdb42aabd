"""Periodic runs against plain comparison of words at every distance."""

import hashlib
import zlib

import duckdb
import numpy as np
from compare import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm import lce, queries
from vellumine.llm.periodic_runs import periodic_runs, runs_of


def plain(words, shortest=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(2 * p, shortest):
                found.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def runs_by_doc(docs):
    r = runs_of([np.array(d, np.int64) for d in docs])
    rows = list(zip(r.doc.tolist(), r.start.tolist(), r.length.tolist(), r.period.tolist()))
    assert rows == sorted(rows, key=lambda x: (x[0], x[1], x[3]))
    return [[x[1:] for x in rows if x[0] == k] for k in range(len(docs))]


words = st.lists(st.integers(0, 2), max_size=40)
repeated = st.builds(lambda a, b, n, c: a + b * n + c, words, st.lists(st.integers(0, 5), min_size=1, max_size=15), st.integers(1, 9), words)


@settings(max_examples=200, deadline=None)
@given(st.lists(words | repeated, max_size=5))
def test_equals_plain_comparison(docs):
    assert [sorted(x) for x in runs_by_doc(docs)] == [plain(d) for d in docs]


def test_long_periods():
    rng = np.random.default_rng(2)
    docs = [np.tile(rng.integers(0, 10**6, 700), 3)[:1900], np.zeros(5000, int), np.tile(np.tile(rng.integers(0, 9, 5), 30).tolist() + [99], 12)]
    assert [sorted(x) for x in runs_by_doc(docs)] == [plain(list(d)) for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=120), st.randoms())
def test_extensions(text, random):
    closed = np.array([7, *text, 8])
    e = lce.Extensions(closed)
    pairs = [(random.randrange(len(closed)), random.randrange(len(closed))) for _ in range(30)]
    pairs = [(i, j) for i, j in pairs if i != j]
    i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    for x, y, n in zip(i.tolist(), j.tolist(), e.ahead(i, j).tolist()):
        want = 0
        while max(x, y) + want < len(closed) and closed[x + want] == closed[y + want]:
            want += 1
        assert n == want


def test_cover_meets_every_pair():
    assert all(((d + a) % lce.COVER) in lce.RESIDUES for d in range(lce.COVER) for a in [next(a for a in lce.RESIDUES if (d + a) % lce.COVER in lce.RESIDUES)])


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a, old = g % n, words
        p = 1 + (n - a) // (3 + g % 8)
        words = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    found = sorted(plain(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines.encode()), sha(kept))


def test_query_equals_plain_reading(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(DATA)).collect()]
    assert sorted(got) == sorted(expected(*d) for d in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(spark, docs):
    rows = docs.select("*").withColumnRenamed("norm", "runs").withColumnRenamed("head", "collapsed")
    got = queries.with_planted_runs(rows)
    assert sorted(map(str, got.collect())) and got.count() == rows.count()
    found = periodic_runs(rows, chunk=3).collect()
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert len(found) == rows.count()
    for r in found:
        if r["doc_id"] is not None:
            assert sorted((x["start"], x["length"], x["period"]) for x in r["runs"]) == plain((texts[r["doc_id"]] or "").encode().split())
    assert {r["collapsed"] for r in found if r["doc_id"] == 10} == {"word"} and {r["collapsed"] for r in found if r["doc_id"] == 4} == {""}
    assert periodic_runs(rows.where("false")).collect() == []
