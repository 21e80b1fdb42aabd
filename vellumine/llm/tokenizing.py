"""Encoding texts with the tokenizers library, by memoised pieces.

Both vocabularies split a text at white space before anything else, so the ids of a text are
those of its pieces one after another. Each worker keeps a bounded memo of pieces, and texts
in which pieces could depend on each other go to the library whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces a worker remembers; then it starts anew. Bounds its memory, not its results.
MEMO = 800_000
#: White space as Unicode has it, which the libraries' patterns mean by \s.
_SPACE = "\x09-\x0d\x20\x85\xa0  -     　"
_BYTE_PIECES = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c))
#: Marks that end words often; none of them is a letter, a digit or an apostrophe.
_MARKS = ".,;:!?%$&*#)]}"
#: Latin letters, with or without a space: surely one piece of the pattern.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Stands for a line end where texts are cut up; texts that hold it themselves aren't cut up so.
LINE = "\x01"
#: A piece that is a word, after LINE or a space, with marks behind it or none.
_SIMPLE = f"^(?P<line>{LINE}?)(?P<word>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<marks>[{re.escape(_MARKS)}]*)$"
#: Python's split() also splits at these, the libraries don't.
_ODD = re.compile("[\x1c-\x1f]")


@cache
def load(path: str):  # noqa: ANN201
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def version(path: str) -> str:
    """Digest of a tokenizer file: what is counted with one version is never used for another."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _byte_chars() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself if it prints in Latin-1, others from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()


class ByteEncoder:
    """Ids of texts under byte_bpe_50k.json, as little-endian numbers of 16 bits.

    A text is cut before each single space and around each line end: the pattern parts it there
    if no other white space stands beside. Arrow does the cutting for a whole batch, parts words
    from the marks behind them, and numbers what is distinct, so Python sees a word once a batch
    and the model once for as long as a worker remembers it.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cores: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words (_WORD), each of which is one piece of the pattern: straight to the model."""
        known, tokenize = self.cores, self.model.tokenize
        new = [w for w in words if w not in known]
        if len(known) + len(new) > MEMO:
            known.clear()
            new = words
        for w in new:
            named = w.replace(" ", _BYTE_CHARS[32]) if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS)
            known[w] = array("H", [t.id for t in tokenize(named)]).tobytes()
        return list(map(known.__getitem__, words))

    def core(self, core: str) -> bytes:
        """Ids of a part of a text that the pattern parts from what stands beside it."""
        found = self.cores.get(core)
        if found is None:
            if _WORD.fullmatch(core):
                return self.words([core])[0]
            if len(self.cores) >= MEMO:
                self.cores.clear()
            found = self.cores[core] = self.whole(core)
        return found

    def piece(self, piece: str) -> bytes | None:
        """Ids of a piece after a space or LINE; None if white space at its ends belongs to what stands beside it."""
        text = piece.removeprefix(LINE)
        if not text or text[0] in _SPACES or text[-1] in _SPACES:
            return None
        return self.core(f" {text}") if text is piece else self.core("\n") + self.core(text)

    def ids_of(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of distinct pieces, and which have none because their neighbours matter."""
        parts = pc.extract_regex(pieces, _SIMPLE)
        line, word, marks = (pc.fill_null(pc.struct_field(parts, k), "") for k in range(3))
        after_line = pc.equal(line, LINE)
        lead = pc.if_else(after_line, pa.scalar(""), pa.scalar(" "))
        others = parts.is_null()
        words = pc.binary_join_element_wise(lead, pc.if_else(others, pa.scalar("a"), word), "").dictionary_encode()
        ends = marks.dictionary_encode()
        of_words = pa.array(self.words(words.dictionary.to_pylist()), pa.binary()).take(words.indices)
        of_ends = pa.array(list(map(self.core, ends.dictionary.to_pylist())), pa.binary()).take(ends.indices)
        new_line = pc.if_else(after_line, pa.scalar(self.core("\n")), pa.scalar(b""))
        out = pc.binary_join_element_wise(new_line, of_words, of_ends, b"")
        unsure = np.zeros(len(pieces), bool)
        if pc.any(others).as_py():
            own = list(map(self.piece, pieces.filter(others).to_pylist()))
            unsure[np.flatnonzero(others.to_numpy(zero_copy_only=False))] = [x is None for x in own]
            out = pc.replace_with_mask(out, others, pa.array([x or b"" for x in own], pa.binary()))
        return out, unsure

    def encode(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text (null: empty) with `end` after them, as a binary array."""
        texts = texts.fill_null("")
        if not len(texts):
            return pa.array([], pa.binary())
        cut_up = pc.split_pattern(pc.replace_substring(texts, "\n", f" {LINE}"), " ")
        counts = pc.list_value_length(cut_up).to_numpy()
        first = np.append(0, np.cumsum(counts, dtype=np.int64))  # where each text's pieces start
        pieces = cut_up.flatten().dictionary_encode()
        at = pieces.indices.to_numpy().astype(np.int64)
        leads = pieces.dictionary.take(pa.array(at[first[:-1]])).to_pylist()
        ids, unsure = self.ids_of(pieces.dictionary)
        n = len(ids)
        at[first[:-1]] = n
        apart = np.add.reduceat(np.append(unsure, False)[at], first[:-1], dtype=np.int64) > 0
        apart |= np.array([not x or x[0] in _SPACES or x[-1] in _SPACES or x[0] == LINE for x in leads])
        for special in [*self.specials, LINE]:
            apart |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        # a text's first piece brings the end of the text before it; the last end stands alone
        heads = [end + (self._apart(texts[i].as_py()) if apart[i] else self.core(x)) for i, x in enumerate(leads)]
        at[np.repeat(apart, counts)] = n + len(heads)
        at[first[:-1]] = n + np.arange(len(heads))
        at = np.append(at, n + len(heads) + 1)
        values = pa.concat_arrays([ids, pa.array([*heads, b"", end], pa.binary())]).take(pa.array(at))
        _, bounds, data = values.buffers()
        bounds = np.frombuffer(bounds, np.int32)[first] + np.int32(len(end))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), data])

    def _apart(self, text: str) -> bytes:
        """White space before a special string belongs to no word, so such texts go whole."""
        if any(s in text for s in self.specials):
            return self.whole(text)
        return b"".join(map(self.core, _BYTE_PIECES.findall(text)))


class WordCounter(dict):
    """Numbers of tokens of texts under word_bpe_49k.json, which drops white space."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = load(path)

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self[piece] = self.whole(piece)
        return n

    def count(self, text: str) -> int:
        if _ODD.search(text):
            return self.whole(text)
        return sum(map(self.__getitem__, text.split()))


@cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


@cache
def word_counter(path: str) -> WordCounter:
    return WordCounter(path)
