"""Machines over streams in several runs against a plain loop over the same events."""

import random

import pytest
from pyspark.sql import functions as F

from vellumine.streaming import feeds, machines


def loop(machine, rows, columns):
    """Outcomes by batch, then by time and id."""
    states, out = {}, []
    for batch in rows:
        for r in sorted((r for r in batch if None not in (r["k"], r["t"], r["id"])), key=lambda r: (r["t"], r["id"])):
            states[r["k"]], outcome, _ = machine.step(states.get(r["k"]), {c: r[c] for c in columns})
            out.append((r["k"], r["id"], outcome))
    return sorted(out)


def streamed(spark, tmp_path, machine, rows, columns, schema, **more):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for batch in rows:
        spark.createDataFrame([tuple(r[c] for c in ("k", "t", "id", *columns)) for r in batch], schema).coalesce(1).write.mode("append").parquet(source)
        stream = feeds.files(spark, source, spark.createDataFrame([], schema))
        found = machines.decisions(stream, machine, "k", "id", F.timestamp_seconds("t"), columns, **more)
        feeds.append_available(found, out, checkpoint)
    return sorted((r["k"], r["id"], r["outcome"]) for r in spark.read.parquet(out).collect())


def test_balances(spark, tmp_path):
    rng = random.Random(1)
    rows = [[{"k": rng.choice("abc"), "t": rng.randrange(50), "id": 100 * b + i, "amount": rng.choice([5, -3, -9, 2, None])} for i in range(60)] for b in range(3)]
    rows[1] += [{"k": None, "t": 1, "id": 1, "amount": 5}, {"k": "a", "t": None, "id": 2, "amount": 5}]
    got = streamed(spark, tmp_path, machines.Balance(), rows, ["amount"], "k string, t long, id long, amount long", numbers=("balance",))
    assert got == loop(machines.Balance(), rows, ["amount"])
    assert {o for *_, o in got} == {"ACCEPTED", "REFUSED", "IGNORED"}
    balances = spark.read.parquet(str(tmp_path / "out"))
    assert balances.where("balance < 0").count() == 0 and "x" not in balances.columns


def test_token_families(spark, tmp_path):
    e = lambda k, t, token, following: {"k": k, "t": t, "id": t, "token": token, "next": following}
    rows = [
        [e(1, 1, None, "a"), e(1, 2, "a", "b"), e(2, 3, None, "p"), e(3, 4, "z", "y"), e(1, 5, None, "q")],
        [e(1, 6, "b", "c"), e(2, 7, "nobody's", "x"), e(1, 8, "a", "thief")], [e(1, 9, "c", "d"), e(2, 10, "p", "r")],
    ]
    got = streamed(spark, tmp_path, machines.TokenFamily(), rows, ["token", "next"], "k int, t long, id long, token string, next string")
    want = "OPENED ROTATED OPENED UNKNOWN EXISTS ROTATED UNKNOWN REUSED REVOKED ROTATED".split()
    assert [o for _, _, o in sorted(got, key=lambda r: r[1])] == want
    assert got == loop(machines.TokenFamily(), rows, ["token", "next"])


def test_sync_outcomes(spark, tmp_path):
    e = lambda k, t, digest, error=None: {"k": k, "t": t, "id": t, "digest": digest, "error": error}
    rows = [[e("r", 1, "x"), e("s", 2, "y", "down")], [e("r", 3, "x"), e("s", 4, "y", "down"), e("r", 5, "z")], [e("s", 6, "y"), e("s", 7, "y"), e("u", 8, "1", "e"), e("u", 9, "1", "e"), e("u", 10, "1", "e"), e("u", 11, "1"), e("u", 12, "2")]]
    got = streamed(spark, tmp_path, machines.Sync(), rows, ["digest", "error"], "k string, t long, id long, digest string, error string", numbers=("tries",))
    want = "OK FAILED SKIPPED FAILED OK OK SKIPPED FAILED FAILED FAILED GIVEN_UP OK".split()
    assert [o for _, _, o in sorted(got, key=lambda r: r[1])] == want


@pytest.mark.parametrize("start, want", [(0, "REFUSED"), (9, "ACCEPTED")])
def test_balance_starts(start, want):
    assert machines.Balance(start).step(None, {"amount": -9})[1] == want
