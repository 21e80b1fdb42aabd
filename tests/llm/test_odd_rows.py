"""Rows, parameters and sizes that are out of the ordinary, and plain versions of whole queries."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from compare import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumine.llm import common, language_id, mixing, queries, sentencepiece_viterbi, sharding, token_store


def test_mix_with_odd_quality(spark):
    rows = spark.sql("SELECT id AS doc_id, repeat('w ', cast(id % 5 as int)) AS text, if(id % 2 = 0, 'a', 'b') AS source FROM range(400)")
    q = F.expr("CASE doc_id % 6 WHEN 0 THEN null WHEN 1 THEN 0D WHEN 2 THEN -1D WHEN 3 THEN double('NaN') WHEN 4 THEN double('inf') ELSE 1D END")
    got = mixing.mix(rows, quality=q).collect()
    assert len(got) == 400 and sorted(map(tuple, mixing.mix(rows, quality=q).collect())) == sorted(map(tuple, got))
    assert all(r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2
        most = max(r["copies"] for r in own if r["size"])
        better = [r for r in own if r["size"] and r["doc_id"] % 6 in (4, 5)]  # they come before all others
        others = [r for r in own if r["size"] and r["doc_id"] % 6 not in (4, 5)]
        assert not (any(r["copies"] < most for r in better) and any(r["copies"] == most for r in others))


def test_wordless_rows_come_only_with_complete_passes(spark):
    rows = spark.createDataFrame([(1, "", "a"), (2, "w", "a"), (3, None, "b"), (4, "w " * 90, "b")], "doc_id long, text string, source string")
    assert all(r["copies"] <= 3 for r in mixing.mix(rows).collect())
    assert max(Counter(r["doc_id"] for r in mixing.mixed_documents(rows).collect()).values()) <= 3


def test_no_bin_is_hot():
    for quality in (0.1, 1.0, 1e-6):
        key = -np.log(np.random.default_rng(1).random(20_000)) / quality
        counts = np.unique(np.floor(np.log(key) * mixing.BINS), return_counts=True)[1]
        assert counts.max() <= 0.002 * 20_000


def test_language_equals_plain_bundles(spark):
    """Every document's language and score from vectors bound and bundled one n-gram at a time."""
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{DATA}/documents.parquet'").fetchall()
    vectors, symbols = language_id._vectors().astype(np.int64), language_id._letters()
    rolled = [np.roll(vectors, 2 - k, axis=1) for k in range(3)]

    def bundle(text):
        s = re.sub("\0+", "\0", "\0" + "".join(c if symbols[ord(c)] else "\0" for c in text.lower()) + "\0")
        s = [int(symbols[ord(c)]) if c != "\0" else 0 for c in s]
        s = s if len(s) > 3 else (s + [0] * 3)[:4] if any(s) else []
        grams = Counter(zip(s, s[1:], s[2:]))
        return sum(n * rolled[0][a] * rolled[1][b] * rolled[2][c] for (a, b, c), n in grams.items()) if grams else np.zeros(1024)

    own = {i: bundle(t or "") for i, t, _ in docs}
    profile = {}
    for i, t, lang in docs:
        if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            profile[lang] = profile.get(lang, 0) + own[i]
    for r in language_id.identify(spark.read.parquet(f"{DATA}/documents.parquet")).collect():
        v = own[r["doc_id"]]
        cosines = {k: p @ v / np.linalg.norm(p) / np.linalg.norm(v) for k, p in profile.items()} if v.any() else {}
        best = max(cosines, key=cosines.get, default="und")
        assert (r["lang_pred"], r["held_out"]) == (best, zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["score"] == pytest.approx(max(0.0, cosines.get(best, 0.0)), abs=1e-9)


def test_language_where_labels_teach_nothing(spark):
    rows = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (3, "...", "de")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(rows).collect()} == {("und", 0.0)}
    assert language_id.drop_undetermined(rows).count() == 0


def test_bundles_do_not_hang_on_batches(monkeypatch):
    texts = ["the cat sat", "der hund bellt laut", "x" * 50, "漢字 mixed in 文"]
    counted = [np.unique(language_id.grams(t), return_counts=True) for t in texts]
    want = language_id.bundles(counted)
    monkeypatch.setattr(language_id, "_GRAMS", 1)
    assert all((a == b).all() for a, b in zip(want, language_id.bundles(counted)))


def test_shards_of_the_query_split(spark):
    assert queries.op8_sharding(spark, "/root/testdata/sf0.01").agg(F.min("depth")).first()[0] > 0


def test_token_store_with_null_and_repeated_ids(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(None, "a b"), (None, None), (5, "c"), (5, "d e f"), (2, "x\n\ny \t z"), (2, "x\n\ny \t z")]
    got = token_store.stored_digests(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    ids = {x: [*t.encode(x or "", add_special_tokens=False).ids, 0] for _, x in rows}
    crc = {x: zlib.crc32(np.array(v, "<u4").tobytes()) for x, v in ids.items()}
    assert sorted(((r["doc_id"] or 0), r["ids_crc32"]) for r in got) == sorted(((i or 0), crc[x]) for i, x in rows)
    in_order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in in_order] == [None, None, 2, 2, 5, 5]
    assert [r["start"] for r in in_order] == np.cumsum([0, *(r["n_tokens"] for r in in_order)])[:-1].tolist()


def test_pieces_of_whole_texts(spark):
    """Every text of the table: the ids are the library's."""
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = queries.op7_sentencepiece(spark, str(DATA)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(list(r["ids"]) == library.encode(texts[r["doc_id"]] or "") for r in got)


def test_whole_texts_by_the_unigram_rule():
    """Without merges the ids' sum of scores is that of a plain dynamic programme."""
    m = sentencepiece_viterbi.Model(public_tokenizers.path("piece_bpe_32k.model"))
    m.merges = False
    pieces = {m.text[i]: m.score[i] for ids in m.keys.values() for i in ids[1].tolist()}
    best = {}

    def score(word):
        at = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for k in range(max(0, end - m.longest), end):
                at[end] = max(at[end], at[k] + pieces.get(word[k:end], m.unknown_score if end - k == 1 else -np.inf))
        return at[-1]

    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall())
    for text in texts.values():
        words = m.words(text or "")
        ids = m.encode([text or ""])[0].tolist()
        if any(i in m.byte_id.values() for i in ids):
            continue
        for w in set(words) - best.keys():
            best[w] = score(w)
        assert sum(m.score[i] for i in ids) == pytest.approx(sum(best[w] for w in words))


def test_models_that_change_texts_are_refused(monkeypatch):
    monkeypatch.setattr(sentencepiece_viterbi, "_PROBE", "a▁b c")
    sentencepiece_viterbi.Model(public_tokenizers.path("piece_bpe_32k.model"))

    class Changing:
        def __init__(self, model_file):
            pass

        def normalize(self, text):
            return text.upper()

    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Changing)
    with pytest.raises(ValueError, match="normaliser"):
        sentencepiece_viterbi.Model("any")


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    (tmp_path / "mine").mkdir()
    name = common.scratch_path(spark, "some-table").rpartition("/")[2]
    spark.range(3).write.parquet(str(tmp_path / name))
    assert common.drop_scratch(spark, str(tmp_path)) and [p.name for p in tmp_path.iterdir()] == ["mine"]
    assert not common.drop_scratch(spark, str(tmp_path))


def test_no_local_scratch_on_a_cluster():
    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.master": "spark://x:7077"}.get(name, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_path(Session, "x")


def test_many_rows_of_one_id_make_many_shards(spark, monkeypatch):
    """A third of the rows without an id, and one document beyond the limit: a few rounds, and tasks of a bin each."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.when(F.col("id") == 100, F.repeat(F.lit("y"), 90_000)).otherwise(F.repeat(F.lit("x"), 100)).alias("text")
    )
    rounds = []
    real = sharding.cut
    monkeypatch.setattr(sharding, "cut", lambda df, name: (rounds.append(name), real(df, name))[1])
    got = sharding.assign_shards(rows, limit=20_000).collect()
    assert len(got) == 9000 and rounds.count("shard-sums") < 24
    sums = {}
    for r in got:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["n_bytes"]
    assert all(sums[r["shard"]] == r["shard_bytes"] for r in got)
    assert sorted(v for v in sums.values() if v > 20_000) == [90_000]
    assert sum(r["doc_id"] is None for r in got) == 3000 and len({r["shard"] for r in got if r["doc_id"] is None}) >= 15
    halves = sharding.assign_shards(spark.createDataFrame([(1, "x" * n) for n in (60, 60, 30, 20, 100, 101)], "doc_id int, text string"), limit=100).collect()
    assert all(r["shard_bytes"] <= 100 or r["n_bytes"] == 101 for r in halves)


def test_mix_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(i, "w " * i, "a", i, i, i) for i in range(1, 9)], "doc_id long, text string, source string, copies int, __copies int, _id int")
    out = mixing.mixed_documents(rows)
    assert out.columns == rows.columns and all(r["copies"] == r["__copies"] == r["_id"] == r["doc_id"] for r in out.collect())


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{DATA}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
