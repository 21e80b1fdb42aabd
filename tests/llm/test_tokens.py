import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vellumine.llm import sentencepiece_viterbi as sv
from vellumine.llm import token_counts, token_store, tokenizing

BYTES, WORDS, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXT = st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", " \n", "\t", "\xa0", "\x1c", "'s", "%%", ".", "12", "é", "É", "<|endoftext|>", "　", "\r\n", "漢字", "\x85", "🙂"]), max_size=14).map("".join)


@given(st.lists(TEXT, min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_byte_encoder_equals_the_library(texts):
    t = Tokenizer.from_file(BYTES)
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in texts]
    encoder = tokenizing.byte_encoder(BYTES)
    assert encoder.encode(pa.array(texts, pa.string())).to_pylist() == want
    assert encoder.encode(pa.array([*texts, None], pa.string()), b"\0\0").to_pylist() == [w + b"\0\0" for w in [*want, b""]]


@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_word_counter_equals_the_library(text):
    t = Tokenizer.from_file(WORDS)
    assert tokenizing.word_counter(WORDS).count(text) == len(t.encode(text, add_special_tokens=False).ids)


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_pack_round_trip(numbers):
    x = np.array(numbers, np.uint32)
    assert token_store.unpack(*token_store.pack(x), len(x)).tolist() == numbers


def test_token_store(docs, none):
    t = Tokenizer.from_file(BYTES)
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in token_store.stored_digests(rows, BYTES).collect()}
    start = 0
    for r in rows.orderBy("doc_id").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert tuple(got[r["doc_id"]][c] for c in ("start", "n_tokens", "ids_crc32")) == want
        start += len(ids)
    assert token_store.stored_digests(docs, BYTES).count() == docs.count()
    assert token_store.stored_digests(none, BYTES).count() == 0


def test_token_counts_and_their_cache(spark, docs, none, tmp_path):
    t = Tokenizer.from_file(WORDS)
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = token_counts.count_tokens(docs, WORDS, cache_dir=cache, limit=2000).collect()
        by_text = {r["doc_id"]: r["text"] for r in docs.collect()}
        for r in got:
            text = by_text[r["doc_id"]] or ""
            n = len(t.encode(text, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2000)
        assert len(got) == docs.count()
        stored = token_counts.stored(spark, cache)
        assert stored.count() == stored.select("digest").distinct().count() == 9  # each content once
    assert token_counts.count_tokens(none, WORDS).count() == 0


def best_score(m, word):
    best = [0.0] + [-np.inf] * len(word)
    pieces = {t: s for ids in m.keys.values() for i in ids[1].tolist() for t, s in [(m.text[i], m.score[i])]}
    for end in range(1, len(word) + 1):
        for k in range(max(0, end - m.longest), end):
            s = pieces.get(word[k:end], m.unknown_score if end - k == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[k] + s)
    return best[-1]


def test_paths_are_the_best():
    m = sv.Model(PIECES)
    m.merges = False  # the unigram rule
    words = ["▁the", "▁retionthe", "▁straße", "▁internationalization"]
    for w in words:
        (ids,) = m.paths([w])
        assert sum(m.score[i] for i in ids) == pytest.approx(best_score(m, w))
    together = m.paths(["▁thea", "▁ntio", "▁zzzz"])
    assert [x.tolist() for x in together] == [m.paths([w])[0].tolist() for w in ("▁thea", "▁ntio", "▁zzzz")]


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
PIECE = st.sampled_from([LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(259, 32000, 7)])


@given(st.lists(st.one_of(PIECE, TEXT, st.text(max_size=5), st.integers(1, 70).map(" ".__mul__)), max_size=8).map("".join))
@settings(max_examples=400, deadline=None)
def test_piece_ids_equal_the_library(text):
    assert sv.model(PIECES).encode([text])[0].tolist() == LIBRARY.encode(text)


def test_piece_ids_of_repeats_and_long_words_equal_the_library():
    texts = [unit * k for unit in ("a", "-", "=-", " ", "▁", "  the", "\n ", "漢") for k in (1, 2, 3, 15, 16, 17, 31, 200)]
    texts += ["".join(random.Random(k).choices("aberstn", k=3000)) for k in range(3)]
    assert [x.tolist() for x in sv.model(PIECES).encode(texts)] == LIBRARY.encode(texts)


def test_remembered_pairs_may_share_a_place(monkeypatch):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    monkeypatch.setattr(sv, "PAIRS", 4)
    monkeypatch.setattr(sv, "MEMO", 100)
    assert [x.tolist() for x in sv.Model(PIECES).encode(texts)] == LIBRARY.encode(texts)


def test_encode_and_decode(docs, none):
    got = sv.encode(docs, PIECES, ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    assert all(list(r["ids"]) == LIBRARY.encode(r["text"] or "") for r in got)
    assert all(r["round_trip"] == ("▁" not in (r["text"] or "")) for r in got)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    back = sv.decode(sv.encode(docs, PIECES, ["doc_id"]), PIECES, ["doc_id"]).collect()
    texts = {r["doc_id"]: (r["text"] or "").replace("▁", " ") for r in docs.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in back)
    assert sv.encode(none, PIECES, ["doc_id"]).count() == 0
