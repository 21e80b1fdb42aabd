"""SentencePiece encoding and decoding by batched Viterbi.

Paths have the largest sum of the pieces' scores. Of a unigram file every path is allowed. Of
a BPE file only those are whose pieces' borders outlive the file's merges: of each word exactly
one, the one that merging gives. So ids are the library's own under either kind of file.

Pieces never hold a word mark after another character, so the best path of a text is those of
its words one after another; nor does a piece hold a character that has only a piece of its
own, or none, so words end there too. The distinct words of a batch that are equally long advance
together: hashes of all their substrings probe the sorted hashes of the pieces of each length,
a maximum per end position is taken over all piece lengths at once, and the chosen lengths are
the backpointers.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
#: Cells of a group of words that advance together, and words and pairs of pieces a worker remembers.
_CELLS, MEMO, PAIRS = 60_000, 300_000, 1 << 20
#: Bytes of texts whose new words are learnt together.
_TEXTS = 2 << 20
#: What a model's normaliser must leave as it is, but for the marks: wide, composed and odd characters, runs of spaces.
_PROBE = "Ａ ﬁ é e\u0301  ①\tÇ\nｶﾞ \u00a0x"
#: A time that no merge has.
_NEVER = np.int64(1) << 40
#: Fixed value of the public unigram algorithm: how far below the lowest score an unknown is.
UNKNOWN_BELOW = 10.0


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)


class Model:
    """Pieces of a SentencePiece model file with their scores and, of a BPE file, merges. Only
    normal pieces take part in paths; a character without a piece becomes bytes.

    Raises ValueError for a file whose normaliser changes more than spaces, or with a piece that
    has a word mark after another character: texts couldn't be encoded word by word. So it does
    for a BPE file with pieces that are merged but not put out.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK):
            raise ValueError(f"{path}: its normaliser changes texts")
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.byte_id = {int(self.text[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown_id = sp.unk_id()
        normal = [i for i in range(n) if not special[i]]
        if any(MARK in self.text[i].lstrip(MARK) for i in normal):
            raise ValueError(f"{path}: a piece has a word mark inside")
        self.unknown_score = self.score[normal].min() - UNKNOWN_BELOW
        by_length: dict[int, list[int]] = defaultdict(list)
        for i in normal:
            by_length[len(self.text[i])].append(i)
        # a BPE file's scores are ranks, whole numbers; a unigram file has logarithms
        self.merges = bool(np.all(self.score[normal] == np.rint(self.score[normal])))
        if self.merges:
            if any(map(sp.is_unused, range(n))):
                raise ValueError(f"{path}: merges through unused pieces")
            self._check_scores(path, [i for i in normal if len(self.text[i]) > 1])
            by_length = self._learn_merges(by_length)
        inside = sorted({c for t, k in ((t, k) for k, ids in by_length.items() for t in map(self.text.__getitem__, ids)) if k > 1 for c in t} - {MARK})
        joins = "".join(map(re.escape, inside))
        self.word = re.compile(f"{MARK}*[{joins}]+|{MARK}+|[^{MARK}{joins}]" if joins else f"{MARK}+|[^{MARK}]")
        self.score_of = np.append(self.score, -np.inf)  # of -1, no piece: minus infinity
        self.longest = max(by_length)
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, ids in by_length.items():
            codes = _codes([self.text[i] for i in ids], length)
            h = np.zeros(len(ids), np.uint64)
            for k in range(length - 1, -1, -1):
                h = codes[:, k].astype(np.uint64) + _P * h
            order = np.argsort(h)
            self.keys[length] = h[order], np.array(ids, np.int32)[order], codes[order]
        self.memo: dict[str, np.ndarray] = {}
        self.out = [bytes([byte_of[i]]) if i in byte_of else b"" if special[i] else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]

    def _check_scores(self, path: str, merged: list[int]) -> None:
        """Refuses equal scores, but for pieces of several marks that are the last to merge and
        whose merges, the leftmost first, leave the longest pieces first."""
        self.run = np.array([len(t) if t and not t.strip(MARK) else 0 for t in self.text])
        ranks = [self.score[i] for i in merged if not self.run[i]]
        runs = [i for i in merged if self.run[i]]
        if len(set(ranks)) < len(ranks) or any(self.score[i] >= min(ranks) for i in runs):
            raise ValueError(f"{path}: which pieces merge first isn't told by scores")
        sizes = {1, *self.run[runs].tolist()}
        most = max(sizes)
        #: By length of two runs together: length of the longest piece within.
        self.run_within = np.array([max((k for k in sizes if k <= size), default=0) for size in range(2 * most + 1)])
        for size in range(1, 3 * most):
            merging, longest = [1] * size, []
            while pairs := [k for k in range(len(merging) - 1) if sum(merging[k : k + 2]) in sizes]:
                merging[pairs[0] : pairs[0] + 2] = [sum(merging[pairs[0] : pairs[0] + 2])]
            while sum(longest) < size:
                longest.append(int(self.run_within[min(size - sum(longest), most)]))
            if merging != longest:
                raise ValueError(f"{path}: runs of word marks don't merge to the longest pieces first")

    def _learn_merges(self, by_length: dict[int, list[int]]) -> dict[int, list[int]]:
        """Learns when two pieces merge and from which two each piece is made; pieces to use.

        Any two pieces merge that together are a piece, those of the best score first. A piece
        is made of the two parts that stay apart until its own time; one without such parts is
        never made.
        """
        id_of = {self.text[i]: i for ids in by_length.values() for i in ids}
        n = len(self.text)
        self.made = np.zeros(n, np.int64)  # 0: a character, there from the start
        many = np.array([i for length, ids in by_length.items() if length > 1 for i in ids], np.int64)
        self.made[many] = 1 - self.score[many].astype(np.int64)
        splits = [
            (len(t), i, id_of[t[:k]], id_of[t[k:]])
            for i in many.tolist()
            for t in [self.text[i]]
            for k in range(1, len(t))
            if t[:k] in id_of and t[k:] in id_of
        ]
        size, whole, left, right = np.array(splits, np.int64).reshape(-1, 4).T
        pair = left * n + right
        order = np.argsort(pair)
        self.pairs, self.pair_made = np.append(pair[order], _NEVER), np.append(self.made[whole[order]], _NEVER)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.known = np.full(PAIRS, -1, np.int64)  # pairs of pieces, doubled, plus 1 if they stay apart
        usable = self.made == 0
        for i in many[self.run[many] > 0].tolist():  # only the symbols at their ends matter
            usable[i], self.left[i], self.right[i] = True, id_of[MARK], id_of[MARK]
        for length in sorted(set(size.tolist())):  # parts are shorter: known by then
            at = np.nonzero((size == length) & (self.run[whole] == 0) & usable[left] & usable[right])[0]
            at = at[np.maximum(self.made[left[at]], self.made[right[at]]) < self.made[whole[at]]]
            at = at[self._apart(left[at], right[at], self.made[whole[at]])]
            self.left[whole[at]], self.right[whole[at]] = left[at], right[at]
            usable[whole[at]] = True
        kept = {length: [i for i in ids if usable[i]] for length, ids in by_length.items()}
        return {length: ids for length, ids in kept.items() if ids}

    def _apart(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | np.int64 = _NEVER) -> np.ndarray:
        """Whether no merge before `until` crosses the border between pieces left and right.

        Goes back in time: the two symbols at the border would have merged if their merge comes
        before the later of them was taken up into a larger one. Of merges at the same time the
        one further left comes first. Of two runs of marks the first must be the longest piece within both.
        """
        n = len(self.text)
        ok = np.ones(len(left), bool)
        if until is _NEVER:
            marks = (self.run[left] > 0) & (self.run[right] > 0)
            ok[marks] = self.run[left[marks]] == self.run_within[self.run[left[marks]] + self.run[right[marks]]]
            row = np.nonzero(~marks)[0]
            left, right = left[row], right[row]
        else:
            row = np.arange(len(left))
        until = np.broadcast_to(until, len(row))
        while len(row):
            pair = left * n + right
            at = np.searchsorted(self.pairs, pair)
            crossed = (self.pairs[at] == pair) & (self.pair_made[at] < until)
            ok[row[crossed]] = False
            a, b = self.made[left], self.made[right]
            go = ~crossed & ((a > 0) | (b > 0))
            row, left, right, a, b = row[go], left[go], right[go], a[go], b[go]
            until = np.where(a > b, a, b + 1)
            left, right = np.where(a > b, self.right[left], left), np.where(a > b, right, self.left[right])
        return ok

    def _remembered(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_apart, which is worked out for pairs that aren't in their place of a table yet."""
        pair = left * len(self.text) + right
        place = ((pair.astype(np.uint64) * _P) >> np.uint64(40)).astype(np.int64) & (PAIRS - 1)
        known = self.known[place]
        new = np.nonzero(known >> 1 != pair)[0]
        if len(new):
            known[new] = pair[new] * 2 + self._apart(left[new], right[new])
            self.known[place[new]] = known[new]
        return (known & 1).astype(bool)

    def _found(self, codes: np.ndarray) -> np.ndarray:
        """By length - 1, start and word: id of the piece there, or -1. A word is a column of codes."""
        size, n = codes.shape
        wide = codes.astype(np.uint64)
        h = np.zeros((size + 1, n), np.uint64)
        out = np.full((min(size, self.longest), size, n), -1, np.int32)
        for length in range(1, len(out) + 1):
            # hash of codes[s : s + length] from that of codes[s + 1 : s + length]
            h = wide[: size - length + 1] + _P * h[1:]
            if length not in self.keys:
                continue
            keys, ids, texts = self.keys[length]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            start, word = np.nonzero(keys[at] == h)
            at = at[start, word]
            same = np.ones(len(word), bool)
            for k in range(length):  # equal hashes are confirmed by the characters
                same &= texts[at, k] == codes[start + k, word]
            out[length - 1, start[same], word[same]] = ids[at[same]]
        return out

    def paths(self, words: list[str]) -> list[np.ndarray]:
        """Ids of the best path of each of some equally long words.

        Of paths with equal scores (none under merges) the one with the longest last piece is taken.
        """
        n, size = len(words), len(words[0])
        codes = np.ascontiguousarray(_codes(words, size).T)
        found = self._found(codes)
        column = np.arange(n)
        best = np.zeros((size + 1, n))
        back = np.zeros((size + 1, n), np.int64)
        last = np.full((size + 1, n), -1, np.int64)  # the piece that ends here; -1: none or unknown
        for end in range(1, size + 1):
            lengths = np.arange(min(end, len(found)), 0, -1)
            starts = end - lengths
            ids = found[lengths - 1, starts]
            tried = best[starts] + self.score_of[ids]
            if self.merges:
                at, word = np.nonzero((ids >= 0) & (last[starts] >= 0))
                cut = ~self._remembered(last[starts[at], word], ids[at, word])
                tried[at[cut], word[cut]] = -np.inf
            unknown = ids[-1] < 0
            tried[-1, unknown] = best[end - 1, unknown] + self.unknown_score
            pick = tried.argmax(axis=0)
            back[end] = lengths[pick]
            best[end] = tried[pick, column]
            last[end] = ids[pick, column]
        ends = np.zeros((size + 1, n), bool)
        word, end = column, np.full(n, size)
        while len(word):
            ends[end, word] = True
            end = end - back[end, word]
            word, end = word[end > 0], end[end > 0]
        word, end = np.nonzero(ends.T)  # word by word, in order
        ids = last[end, word]
        cuts = [0, *np.cumsum(ends.sum(axis=0)).tolist()]
        flat = ids.astype(np.int32)
        parts = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        for w in set(word[ids < 0].tolist()):
            of_word = zip(parts[w].tolist(), end[word == w].tolist())
            parts[w] = np.array([i for piece, e in of_word for i in ([piece] if piece >= 0 else self._bytes(words[w][e - 1]))], np.int32)
        return parts

    def _bytes(self, char: str) -> list[int]:
        if not self.byte_id:
            return [self.unknown_id]
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]

    def words(self, text: str) -> list[str]:
        return self.word.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, words: set[str]) -> None:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in words - self.memo.keys():
            by_length[len(w)].append(w)
        for length, group in by_length.items():
            step = max(1, _CELLS // length)
            for at in range(0, len(group), step):
                some = group[at : at + step]
                self.memo.update(zip(some, (ids.tobytes() for ids in self.paths(some))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(t) for t in texts]
        self.learn({w for ws in split for w in ws})
        return [np.frombuffer(b"".join(map(self.memo.__getitem__, ws)), np.int32) for ws in split]

    def decode(self, ids: list[int]) -> str:
        """Text of some ids; the mark that encoding puts first is taken off again."""
        return b"".join(map(self.out.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


@cache
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row with ids (array of int), n_tokens, round_trip.

    Null and empty texts have no ids. round_trip tells whether decoding the ids gives the text
    again; it is false only for texts that hold the mark U+2581 itself or lone surrogates. An
    empty table gives no rows; repeated rows are encoded alike.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // _TEXTS
            cuts = [0, *(np.nonzero(np.diff(size))[0] + 1).tolist(), b.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                some = [t or "" for t in texts.slice(at, to - at).to_pylist()]
                ids = m.encode(some)
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
                same = [m.decode(i.tolist()) == t for i, t in zip(ids, some)]
                columns = [*(c.slice(at, to - at) for c in b.columns[:-1]), lists, pa.array(np.diff(ends)), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{n}" for n in range(len(keep))), "ids", "n_tokens", "round_trip"])

    rows = docs.select(*[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)], F.col(text_col).cast("string").alias("t"))
    schema = rows.drop("t").schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")
    out = rows.mapInArrow(each, schema)
    return out.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)], "ids", "n_tokens", "round_trip")


def decode(tokens: DataFrame, model_path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns `keep` of every row with text, decoded from ids (null: null)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            texts = [None if i is None else m.decode(i) for i in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*(f"k{n}" for n in range(len(keep))), "text"])

    rows = tokens.select(*[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)], F.col(ids_col).alias("t"))
    out = rows.mapInArrow(each, rows.drop("t").schema.add("text", "string"))
    return out.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)], "text")
