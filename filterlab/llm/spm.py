"""SentencePiece BPE encoding by a prefix table of last tokens, and decoding.

For every prefix of a text, byte-pair encoding ends with exactly one token. That token is the one
among the pieces that end there (found by an Aho-Corasick automaton) that is compatible with the
last token of the prefix before it: merging across their border would never have come first. The
table is filled from left to right, and the ids are read backwards from the end.

No piece joins a space mark to what stands before it, so a text is encoded word by word and the
ids of words are kept in a bounded cache. White space is kept as it is; runs of space marks have
pieces of their own below all other scores, so a run is encoded apart from its word. Characters
without a piece become byte pieces.

A null text is taken as empty; an empty text has no ids. Long texts are never cut. Repeated rows
give repeated results. Other columns of the input are ignored.
"""

from __future__ import annotations

import array
import functools
import heapq

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


MARK = "▁"
#: Words, and token pairs, whose results a task keeps; longer words are encoded anew each time.
CACHE_WORDS, LONGEST_KEPT, CACHE_PAIRS = 250_000, 64, 250_000
ROWS_AT_ONCE = 256
_NEVER = 1 << 40


class Words(dict):
    """word -> the ids of the space mark and the word, packed as int32; filled on demand."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.bare = model, {}

    def __missing__(self, word: str) -> bytes:
        head, *rest = word.split("\n")
        if rest:  # a line break stands in no piece: lines are encoded apart
            return self[head] + b"".join(self.model.line_break + self.without_mark(x) for x in rest)
        first, *others = self.model.apart(word)
        if others:
            return self[first] + b"".join(map(self.without_mark, others))
        found = self.model.pack(self.model.encode_marked(1, word))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found

    def without_mark(self, word: str) -> bytes:
        found = self.bare.get(word)
        if found is None:
            found = self.model.pack(self.model.encode_marked(0, word))
            if len(word) <= LONGEST_KEPT:
                if len(self.bare) >= CACHE_WORDS:
                    self.bare.clear()
                self.bare[word] = found
        return found


class Model:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids, normal = {}, []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces for unknown characters")
        self.shown = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.runs = {len(self.pieces[i]): i for i in normal if not self.pieces[i].strip(MARK)}
        self.run_score = {k: sp.get_score(i) for k, i in self.runs.items()}
        # merges in order of score; the characters themselves come before all of them
        self.ids: dict[str, int] = {}
        self.order, self.left, self.right, self.pair = {}, {}, {}, {}
        self.memo: dict[int, bool] = {}
        self.span = 1 << 32  # more than there are names of tokens, and of characters without any
        self.run_memo: dict[int, list[int]] = {}
        chars = {c for i in normal for c in self.pieces[i]}
        single = {self.pieces[i]: i for i in normal if len(self.pieces[i]) == 1}
        for k, c in enumerate(sorted(chars)):  # a character of pieces that is no piece itself has a name of its own
            name = single.get(c, n + k)
            self.ids[c], self.order[name] = name, -1
        self.names = {v: k for k, v in self.ids.items()}
        self.known = frozenset(chars)
        self.inner_pairs = {self.pieces[i][k : k + 2] for i in normal for k in range(len(self.pieces[i]) - 1)}
        score = {i: sp.get_score(i) for i in normal}
        merges = sorted((i for i in normal if len(self.pieces[i]) > 1 and self.pieces[i].strip(MARK)), key=lambda i: (-score[i], i))
        if len({score[i] for i in merges}) != len(merges):
            raise ValueError("the model has merges of equal score")
        if any(MARK in self.pieces[i][1:] for i in merges) or max((self.run_score[k] for k in self.runs if k > 1), default=-1e18) >= min(score[i] for i in merges):
            raise ValueError("the model joins space marks in a way that word-by-word encoding doesn't cover")
        longest = 1
        for rank, i in enumerate(merges):
            piece = self.pieces[i]
            parts = self._last_tokens(piece, lambda s, e, piece=piece: ((self.ids.get(piece[b:e]), e - b) for b in range(max(0, e - longest), e)))
            if parts is not None and len(parts) == 2:  # else encoding never arrives at this piece
                self.left[i], self.right[i] = parts
                self.pair[parts[0], parts[1]] = i
                self.ids[piece], self.order[i], self.names[i] = i, rank, piece
                longest = max(longest, len(piece))
                self.memo.clear()
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.line_break = self.pack(self.encode_chars("\n"))
        self.words = Words(self)

    def forget(self) -> None:
        """Empties the caches: the model outlives its task, and what runs next in the worker needs the memory."""
        self.words.clear()
        self.words.bare.clear()
        self.memo.clear()

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b is what byte-pair encoding makes of their joined text."""
        found = self.memo.get(a * self.span + b)
        if found is None:
            if len(self.memo) >= CACHE_PAIRS:
                self.memo.clear()
            found = self.memo[a * self.span + b] = self._compatible(a, b)
        return found

    def apart(self, word: str) -> list[str]:
        """word, cut wherever no piece joins the two neighbours: its parts are encoded each by itself."""
        inner = self.inner_pairs
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in inner]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _compatible(self, a: int, b: int) -> bool:
        # Take back the later of the two merges that face the border, again and again. A merge
        # across the border must not come before the merge just taken back; of two merges of one
        # kind the left one comes first.
        before = _NEVER
        order = self.order
        while True:
            across = self.pair.get((a, b))
            if across is not None and order[across] < before:
                return False
            x, y = order.get(a, -1), order.get(b, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                before, a = x, self.right[a]
            else:
                before, b = y + 1, self.left[b]

    def _last_tokens(self, text: str, ending) -> list[int] | None:
        """The tokens of a text. ending(text, e): (token or None, length) of the pieces that end at e."""
        n = len(text)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for e in range(1, n + 1):
            for token, size in ending(text, e):
                if token is None:
                    continue
                start = e - size
                if not start or (last[start] is not None and self.compatible(last[start][0], token)):
                    last[e] = (token, size)
                    break
        out, e = [], n
        while e:
            if last[e] is None:
                return None
            out.append(last[e][0])
            e -= last[e][1]
        return out[::-1]

    def encode_chars(self, text: str) -> list[int]:
        """The ids of a text that has no run of space marks but one at its start."""
        if not self.known.issuperset(text):
            return self._encode_unknown(text)
        n, memo, span = len(text), self.memo, self.span
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for at, (token, length) in self.automaton.iter(text):  # the longest first of those that end at a place
            at += 1
            if last[at] < 0:
                before = last[at - length]
                if at == length or (before >= 0 and ((fits := memo.get(before * span + token)) or (fits is None and self.compatible(before, token)))):
                    last[at], size[at] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out if max(out, default=0) < len(self.pieces) else self._spelled(out)

    def _encode_unknown(self, text: str) -> list[int]:
        ends: list[list[tuple[int, int]]] = [[] for _ in range(len(text) + 1)]
        for at, found in self.automaton.iter(text):
            ends[at + 1].append(found)
        for k, c in enumerate(text):
            if c not in self.known:
                ends[k + 1] = [(-1 - ord(c), 1)]
        return self._spelled(self._last_tokens(text, lambda s, e: ends[e]) or [])

    def _spelled(self, tokens: list[int]) -> list[int]:
        """tokens, with byte pieces in place of characters that are no pieces."""
        out = []
        for t in tokens:
            if 0 <= t < len(self.pieces):
                out.append(t)
            else:
                out += [self.byte_ids[x] for x in (chr(-1 - t) if t < 0 else self.names[t]).encode("utf-8", "surrogatepass")]
        return out

    def encode_marked(self, marks: int, word: str) -> list[int]:
        """The ids of a run of space marks and a word without any."""
        if not marks:
            return self.encode_chars(word) if word else []
        ids = self.encode_chars(MARK + word)
        if ids[0] == self.runs.get(1):  # the last mark stays with the run
            ids = ids[1:]
        else:
            marks -= 1
        return self.encode_run(marks) + ids

    def encode_run(self, marks: int) -> list[int]:
        """The ids of a run of space marks: many merges share a score here, so they are made one
        by one, the best score first and the leftmost of a score."""
        found = self.run_memo.get(marks)
        if found is None:
            size, after, before = [1] * marks, list(range(1, marks + 1)), list(range(-1, marks - 1))
            heap = []

            def offer(i: int) -> None:
                j = after[i]
                if i >= 0 and j < marks and size[i] + size[j] in self.runs:
                    heapq.heappush(heap, (-self.run_score[size[i] + size[j]], i, size[i], size[j]))

            for i in range(marks):
                offer(i)
            while heap:
                _, i, a, b = heapq.heappop(heap)
                j = after[i]
                if size[i] != a or j >= marks or size[j] != b:
                    continue
                size[i], size[j], after[i] = a + b, 0, after[j]
                if after[i] < marks:
                    before[after[i]] = i
                offer(i)
                if before[i] >= 0:
                    offer(before[i])
            found = [self.runs[x] for x in size if x]
            if marks < 1000:
                self.run_memo[marks] = found
        return found

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return array.array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, with the space mark that the library puts before it."""
        if not text:
            return np.empty(0, np.int32)
        words = text.replace(MARK, " ").split(" ")
        if "" in words:
            packed, marks = [], 0
            for k, w in enumerate(words):
                marks += 1
                if not w and k < len(words) - 1:
                    continue
                if marks == 1:
                    packed.append(self.words[w])
                else:
                    head, *rest = w.split("\n")
                    packed.append(self.pack(self.encode_marked(marks, head)))
                    packed += [self.line_break + self.words.without_mark(x) for x in rest]
                marks = 0
            return np.frombuffer(b"".join(packed), np.int32)
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that stands for the first mark."""
        text = b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def coded(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    """doc_id, ids, decoded of batches of ids and texts."""
    m = model(model_path)
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):  # a few texts at a time: results are larger than texts
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = [m.encode(t or "") for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([m.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])
    finally:
        m.forget()


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded of every row. model_path must lead to the model on every machine."""
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: coded(batches, model_path), schema)
