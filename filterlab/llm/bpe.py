"""Byte-pair encoding of words with word ends, by speculation and verification.

A word's greedy longest-match tokens are a guess that costs a few lookups. They are what byte-pair
encoding makes of the word just if every pair of neighbours is: the merges that made the two tokens must
all come before any merge across their border. All pairs of a batch of new words are tested at once
with arrays. Only words with a pair that fails are merged step by step.

Texts are treated as the file says: special tokens are taken out first, the rest is put in composed form, white space
becomes single spaces, letters are lowered one by one, and the pattern's matches are the words; all else goes.
A word is its UTF-8 bytes, the last one marked as the end of the word. A file that asks for anything else is
refused. Python's Unicode tables decide what a letter is; texts with characters that these don't have yet are put in form
and split by the library's tables. Ids of words are kept in a bounded cache. Decoding joins the tokens' names by spaces, since the file
names no decoder.

A null text is taken as empty; an empty text has no ids. Long texts and long words are never cut. Repeated rows
give repeated results; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Words whose ids a worker keeps; longer words are encoded anew each time; texts at a time.
CACHE_WORDS, LONGEST_KEPT, ROWS_AT_ONCE = 1_000_000, 64, 256
END = "Ā"
#: The normaliser, the splitter and the word end of the files that are understood.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPLITTERS = [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
SUFFIX = "</w>"
_NONE, _NEVER = -1, 1 << 40


def byte_names() -> dict[str, str]:
    """The printable character that stands for each byte in token names -> the byte as a character: printable
    Latin-1 characters stand for themselves, the other bytes for those from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): chr(b) for b in own} | {chr(256 + k): chr(b) for k, b in enumerate(rest)}


class Model:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or model["end_of_word_suffix"] != SUFFIX or said["normalizer"].get("normalizers") != NORMALIZERS or said["pre_tokenizer"].get("pretokenizers") != SPLITTERS or said["decoder"] is not None or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]):
            raise ValueError("the tokenizer file asks for steps that aren't built here")
        names = byte_names()

        def symbols(name: str) -> str:
            """A token's bytes as characters, with END at a word's end."""
            stem = name.removesuffix(SUFFIX) if name.endswith(SUFFIX) else name
            return "".join(map(names.__getitem__, stem)) + (END if stem != name else "")

        vocab: dict[str, int] = model["vocab"]
        self.name = {i: name for name, i in vocab.items()} | {t["id"]: t["content"] for t in said["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        size = max(self.name) + 1
        self.ids: dict[str, int] = {}  # what byte-pair encoding can arrive at
        for name, i in vocab.items():
            if (s := symbols(name)).removesuffix(END) and len(s.removesuffix(END)) == 1:
                self.ids[s] = i
        if len(self.ids) != 512:
            raise ValueError("the vocabulary lacks bytes")
        self.order = np.full(size, _NONE, np.int64)
        self.left, self.right = np.full(size, _NONE, np.int64), np.full(size, _NONE, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.base = dict(self.ids)
        made = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = (rank, i)
            made.append((rank, vocab[a], vocab[b], i, symbols(a + b)))
        keys = np.array([(a << 32) | b for _, a, b, _, _ in made], np.int64)
        ranks = np.array([x[0] for x in made], np.int64)
        by_key = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[by_key], ranks[by_key]
        for rank, a, b, i, text in made:  # a token counts if merging its own text arrives at it by this merge
            if self.order[i] == _NONE and text not in self.ids:
                self.order[i], self.left[i], self.right[i], self.ids[text] = rank, a, b, i
        for text, i in [x for x in self.ids.items() if x[0] not in self.base]:
            if self.merged(text) != [i]:
                del self.ids[text]
        self.longest: dict[str, int] = {}
        for text in self.ids:
            self.longest[text[0]] = max(self.longest.get(text[0], 0), len(text))
        self.words: dict[str, bytes] = {}
        self.pattern = regex.compile(PATTERN)
        self.path, self.assigned, self.names = path, set(), names
        self.parts = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def merged(self, text: str) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of a rank. text: a word's bytes and END."""
        ending = text.endswith(END)
        stems = text[:-1] if ending else text
        token = array("i", map(self.base.__getitem__, stems[:-1])) if len(stems) > 1 else array("i")
        token.append(self.base[stems[-1] + (END if ending else "")])
        n = len(token)
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        merge, heap = self.merge, []
        for k in range(n - 1):
            if found := merge.get((token[k], token[k + 1])):
                heap.append((found[0], k, token[k], token[k + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k]
            if token[k] != a or j >= n or token[j] != b:
                continue
            token[k], token[j], after[k] = new, -1, after[j]
            if after[k] < n:
                before[after[k]] = k
                if found := merge.get((new, token[after[k]])):
                    heapq.heappush(heap, (found[0], k, new, token[after[k]], found[1]))
            if before[k] >= 0 and (found := merge.get((token[before[k]], new))):
                heapq.heappush(heap, (found[0], before[k], token[before[k]], new, found[1]))
        return [t for t in token if t >= 0]

    def proposed(self, text: str) -> list[int]:
        """Greedy longest matches. END alone is no token, so no match may stop before it."""
        out, at, n, ids, longest = [], 0, len(text), self.ids, self.longest
        while at < n:
            for end in range(min(n, at + longest[text[at]]), at, -1):
                if end != n - 1 and (t := ids.get(text[at:end])) is not None:
                    break
            out.append(t)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each a then b is what byte-pair encoding makes of their joined text: the later of the two
        merges that face the border is taken back, again and again, and no merge across the border may come
        before the one just taken back; of two of one rank the left one comes first."""
        good = np.zeros(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), _NEVER)
        last = len(self.pair_keys) - 1
        while len(live):
            key = (a << 32) | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), last)
            across = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)
            x, y = self.order[a], self.order[b]
            fits = across >= limit
            done = fits & (x < 0) & (y < 0)
            good[live[done]] = True
            on = fits & ~done
            left_last = x > y
            a, b, limit = np.where(left_last, self.right[a], a)[on], np.where(left_last, b, self.left[b])[on], np.where(left_last, x, y + 1)[on]
            live = live[on]
        return good

    def learn(self, words: list[str]) -> list[bytes]:
        """The packed ids of distinct words."""
        texts = [w.encode("utf-8", "surrogatepass").decode("latin-1") + END for w in words]
        guesses = [self.proposed(t) for t in texts]
        sizes = np.array([len(g) for g in guesses], np.int64)
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(of[1:] == of[:-1])
        failed = set(of[inner[~self.compatible(flat[inner], flat[inner + 1])]].tolist())
        return [array("i", self.merged(t) if k in failed else g).tobytes() for k, (t, g) in enumerate(zip(texts, guesses, strict=True))]

    def split(self, text: str) -> Iterator[str | int]:
        """The words of a text, and the ids of its special tokens."""
        at = 0
        for m in self.parts.finditer(text) if self.parts else ():
            yield from self.plain(text[at : m.start()])
            yield self.special[m[0]]
            at = m.end()
        yield from self.plain(text[at:])

    def plain(self, text: str) -> list[str]:
        if not text.isascii() and not self.assigned.issuperset(text):
            new = set(text) - self.assigned
            unknown = {c for c in new if unicodedata.category(c) == "Cn"}
            self.assigned |= new - unknown
            if unknown:
                return self._plain_by_library(text)
        # white space of any kind only parts words, so it needn't be made into spaces first
        return self.pattern.findall(lowered(unicodedata.normalize("NFC", text)))

    def _plain_by_library(self, text: str) -> list[str]:
        """The words of a text with characters that are younger than Python's tables: whether these are letters,
        and of which case, depends on the library's own."""
        steps = _library(self.path)
        found = steps.pre_tokenizer.pre_tokenize_str(steps.normalizer.normalize_str(text))
        return ["".join(map(self.names.__getitem__, w)).encode("latin-1").decode("utf-8") for w, _ in found]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of whole texts."""
        parts = [list(self.split(t or "")) for t in texts]
        known = self.words
        new = list({w for p in parts for w in p if w not in known and not isinstance(w, int)})
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list({w for p in parts for w in p if not isinstance(w, int)})
        short = [w for w in new if len(w) <= LONGEST_KEPT]
        known.update(zip(short, self.learn(short), strict=True))
        long = [w for w in new if len(w) > LONGEST_KEPT]
        apart = dict(zip(long, self.learn(long), strict=True)) | {i: array("i", [i]).tobytes() for i in self.special.values()}

        def ids(w: str | int) -> bytes:
            found = known.get(w)
            return apart[w] if found is None else found

        return [np.frombuffer(b"".join(map(ids, p)), np.int32) for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.name.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def lowered(text: str) -> str:
    """Lower case letter by letter: a final sigma is a sigma like any other."""
    return text.replace("Σ", "σ").lower()


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded of every row. path must lead to the tokenizer file on every machine."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = m.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([m.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(code, schema)
