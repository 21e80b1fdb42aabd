import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm import embedding_dedup, exact_dedup, golay, simhash
from vellumine.llm.components import components, spanning_links


def roots_of(nodes, links):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    return {n: find(n) for n in nodes}


def test_exact_groups(docs, none):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert {(1, 1, 3, True), (3, 1, 3, False), (None, 1, 3, False)} <= got
    assert {(4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True)} <= got  # nothing but white space; the longest stays
    assert {(2, 2, 1, True), (12, 12, 2, True), (7, 7, 1, True)} <= got
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 6, 7, 8, 9, 10, 11, 12, 12]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aBé \n\t\x1c 漢.", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_groups(docs, none):
    rows = simhash.near_groups(docs).collect()
    prints = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in rows}
    ids = [i for i in prints if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {r["doc_id"]: r["component_id"] for r in rows} == roots_of(ids, links) | {None: None}
    assert len(rows) == docs.count() and prints[4] == prints[5] == 0
    assert simhash.near_groups(none).count() == 0
    assert sorted(r["doc_id"] or 0 for r in simhash.drop_near_copies(docs).collect()) == [0, 1, 4, 7, 8, 9, 10, 11, 12, 12]


def test_all_links_of_near_fingerprints_are_found(spark):
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for k in rng.integers(1, 5, 1200)]
    fps = np.unique(centers[rng.integers(0, 40, 1200)] ^ np.array(flips, np.uint64))
    rows = spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(fps.view(np.int64))], "rep long, fp long")
    links = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3) if i < j]
    want = {k: v for k, v in roots_of(range(len(fps)), links).items() if any(k in x for x in links)}
    for block in (4096, 16):  # one cell, and many cells of a bucket
        got = {r["node"]: r["root"] for r in components(simhash.linked(rows, block)).collect()}
        assert got == want


def test_golay_code_is_perfect():
    v = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    index, new = golay.near_indices(v)
    assert set(new.sum(axis=1).tolist()) <= {1, 6}
    for bits in (1, 2):
        for _ in range(3):
            flip = np.bitwise_or.reduce(1 << np.random.default_rng(bits).choice(23, bits, replace=False))
            other, _ = golay.near_indices(v ^ flip)
            assert all(set(a) & set(b) for a, b in zip(index.tolist(), other.tolist()))


def test_spanning_links():
    a, b = np.array([5, 7, 9, 2]), np.array([7, 9, 5, 3])
    assert sorted(zip(*(x.tolist() for x in spanning_links(a, b)))) == [(3, 2), (7, 5), (9, 5)]


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 64))
    near = [(b + 0.1 * rng.standard_normal(64)).tolist() for b in base[:10] for _ in range(6)]
    vectors = base.tolist() + near + [near[0], near[0], (2 * np.array(near[0])).tolist()]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [None, [0.0] * 64, [], [None] * 64, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [1.0, 0.0]]
    rows += [(n + k, v, "x") for k, v in enumerate(odd)] + [(None, near[0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class string")
    e = np.array([*vectors, near[0]])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    close = e @ e.T >= 0.95
    links = [(i, j) for i in range(n) for j in range(i) if close[i, j]]
    want = roots_of(range(n), links)
    for block in (1024, 8):
        got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, block=block).collect()}
        assert len(got) == len(rows)
        assert all(got[i]["component_id"] == want[i] and got[i]["n_links"] == close[i].sum() - 1 for i in range(n))
        assert all(got[n + k]["n_links"] == 0 and got[n + k]["kept"] for k in range(len(odd)))
        assert got[None]["component_id"] is None and got[None]["n_links"] == close[n].sum() - 1
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_pairs_at_the_threshold_are_found(spark):
    """1500 pairs at a cosine of 0.9501 under the production parameters; the docstring says 0.994."""
    rng = np.random.default_rng(11)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1500, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9501 * a + np.sqrt(1 - 0.9501**2) * b
    below = 0.9499 * a[:300] + np.sqrt(1 - 0.9499**2) * -b[:300]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, near, below]))]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[i] > 0 for i in range(1500)) >= 0.985 * 1500
    assert all(got[i] == got[1500 + i] <= 1 for i in range(1500)) and not any(got[3000 + i] for i in range(300))
