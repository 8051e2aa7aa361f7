"""Language identification by a linear-chain conditional random field over words.

Each line of a text is a chain. A word's emission comes from hashed affix, character n-gram and
lexicon features; transitions between labels are learned with it. Forward-backward gives each
word's label distribution, so code-switched text is labelled word by word; a document's score for
a language is the mean of its words' marginals.

Training: a bounded sample of labelled documents, chosen by a hash of the id among those that
``may_train`` admits, of each language alike; chains are drawn from lines of different documents,
so label changes occur inside chains and the transitions learn them. The sample is at most
``DOCS_PER_LANG`` documents a language, ``TRAIN_CHARS`` characters of each, in whole lines from a place that
a hash chooses (one line, if it is longer, is cut); the sample as a whole is bounded by ``MAX_LANGS`` times as many documents,
taken in turn from all languages alike. Prediction reads whole texts, and only texts; ``word_labels`` gives its
word-by-word labels.

Whether a text is in any learned language at all is told by its spelling: ``familiar`` is the mean share of its words' letter
trigrams that the sample's words have, and ``Tagger.limit`` what a text should reach. The limit is calibrated on sample documents
held out in turn: FAMILIAR times the median, over them, of what their words reach that no other document has. So a clean text of new
words passes, gibberish and other scripts don't; a language of like spelling (Italian
beside Spanish, Dutch beside German) passes too: nothing that is learned here tells it from prose of new words.

One more label, noise, is learned from words of the sample with their letters shuffled, and given to words
all of whose letters lie in blocks of Unicode that the sample has nothing of. It is never predicted;
``noise`` is its share of a document, so a caller can tell text in no learned language.

A null text, or one without a letter, is ``und`` with score 0; so is everything if there is
nothing to learn from. Ties go to the label first in code point order. Repeated rows give
repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filterlab.llm.common import mapped

DOCS_PER_LANG, TRAIN_CHARS, MAX_LANGS = 150, 20_000, 60
BUCKET_BITS, STEPS, RATE, L2, SEED = 15, 40, 0.3, 1e-6, 7
BUCKETS = 1 << BUCKET_BITS
#: Words whose emissions a worker keeps; words that are labelled at a time.
CACHE_WORDS, CHUNK_WORDS = 400_000, 200_000
#: Of the usual familiarity of words that the sample lacks, the part that a text needs; sample documents held out are every so many.
FAMILIAR, HELD_OUT_EVERY = 0.5, 5
UND = "und"
#: The label of words that look like none of the learned languages.
NOISE = "zxx"
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_HAS_LETTER = regex.compile(r"\p{L}")


def core(word: str) -> str:
    """The letters of a word, in lower case."""
    return "".join(_LETTERS.findall(word.lower())) if _HAS_LETTER.search(word) else ""


def block_of(letter: str) -> int:
    """Of 128 code points."""
    return ord(letter) >> 7


def features(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position of the word, hashed feature) pairs of words of letters, none of them empty.

    Marked ``^word$``, a word has its n-grams of two and three characters (those at its ends are
    affixes of one and two), its affixes of three, and itself."""
    lengths = np.fromiter(map(len, cores), np.int64, len(cores)) + 2
    points = np.frombuffer(("^" + "$^".join(cores) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = lengths.cumsum() - lengths
    word = np.repeat(np.arange(len(cores)), lengths)
    left = np.repeat(begin + lengths, lengths) - np.arange(len(points))  # characters of the word from here on
    with np.errstate(over="ignore"):
        one = points * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + one[2:]
        four = (three[:-1] ^ (three[:-1] >> np.uint64(30))) * np.uint64(0xD6E8FEB86659FD93) + one[3:]
        powers = np.r_[np.uint64(1), np.full(int(lengths.max()) - 1, 0xA24BAED4963EE407, np.uint64)].cumprod(dtype=np.uint64)
        whole = np.add.reduceat(one * powers[np.arange(len(points)) - begin[word]], begin)
    at2, at3 = np.flatnonzero(left[: len(two)] >= 2), np.flatnonzero(left[: len(three)] >= 3)
    long = np.flatnonzero(lengths >= 4)
    where = [word[at2], word[at3], long, long, np.arange(len(cores))]
    what = [two[at2], three[at3], four[begin[long]], four[begin[long] + lengths[long] - 4], whole]
    with np.errstate(over="ignore"):
        hashed = [((h + np.uint64(k)) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - BUCKET_BITS) for k, h in enumerate(what)]
    return np.concatenate(where), np.concatenate(hashed).astype(np.int64)


def emissions(cores: list[str], weights: np.ndarray) -> np.ndarray:
    """The summed weights of each word's features; zeros for words without letters."""
    out = np.zeros((len(cores), weights.shape[1]))
    have = np.array([k for k, c in enumerate(cores) if c], np.int64)
    if len(have):
        word, feature = features([cores[k] for k in have])
        for c in range(weights.shape[1]):
            out[have, c] = np.bincount(word, weights[feature, c], len(have))
    return out


def shapes(word: str) -> list[str]:
    """The letter trigrams of a word of letters, with its ends marked."""
    whole = f"^{word}$"
    return [whole[k : k + 3] for k in range(len(word))]


def familiarity(word: str, known: frozenset[str]) -> float:
    return sum(x in known for x in shapes(word)) / len(word) if word else 0.0


def calibrated(texts: list[str]) -> tuple[frozenset[str], float]:
    """The trigrams of the sample's words, and the familiarity that a text should reach."""
    words = [{c for w in t.split() if (c := core(w))} for t in texts]
    found = []
    for k in range(min(HELD_OUT_EVERY, len(words))):
        others = set().union(*(w for j, w in enumerate(words) if j % HELD_OUT_EVERY != k))
        known = frozenset(x for w in others for x in shapes(w))
        found += [float(np.mean([familiarity(w, known) for w in new])) for d in words[k::HELD_OUT_EVERY] if (new := d - others)]
    return frozenset(x for d in words for w in d for x in shapes(w)), FAMILIAR * float(np.median(found)) if found else 0.0


@dataclass
class Chains:
    """Words of many chains laid out by time: the t-th words of all chains that have one lie together."""

    order: np.ndarray  # position in the layout -> position in the flat list of words
    counts: np.ndarray  # chains that have a t-th word, falling with t
    starts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.starts = np.r_[0, self.counts.cumsum()]


def lay_out(lengths: np.ndarray) -> Chains:
    lengths = lengths[lengths > 0]
    begin = np.r_[0, lengths.cumsum()[:-1]]
    longest_first = np.argsort(-lengths, kind="stable")
    n, begin = lengths[longest_first], begin[longest_first]
    counts = len(n) - np.searchsorted(n[::-1], np.arange(1, n[0] + 1), side="left") if len(n) else np.empty(0, int)
    order = np.concatenate([begin[:c] + t for t, c in enumerate(counts)]) if len(n) else np.empty(0, int)
    return Chains(order, counts)


def forward_backward(potentials: np.ndarray, chains: Chains, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each word (in layout order), expected transitions, log of the partition function.
    potentials, start and move are not logarithms."""
    p, at = potentials, chains.starts
    forward, log_z = np.empty_like(p), 0.0
    for t, c in enumerate(chains.counts):
        here = slice(at[t], at[t] + c)
        x = p[here] * (start if t == 0 else forward[at[t - 1] : at[t - 1] + c] @ move)
        norm = x.sum(1, keepdims=True)
        forward[here] = x / norm
        log_z += float(np.log(norm).sum())
    backward = np.ones_like(p)
    moved = np.zeros_like(move)
    for t in range(len(chains.counts) - 2, -1, -1):
        c, after = chains.counts[t + 1], slice(at[t + 1], at[t + 1] + chains.counts[t + 1])
        ahead = p[after] * backward[after]
        x = ahead @ move.T
        f = forward[at[t] : at[t] + c]
        moved += (f / (f * x).sum(1, keepdims=True)).T @ ahead * move
        backward[at[t] : at[t] + c] = x / x.sum(1, keepdims=True)
    marginals = forward * backward
    return marginals / marginals.sum(1, keepdims=True), moved, log_z


class Tagger:
    """A trained field. Emissions of words are kept in a bounded cache of each worker."""

    def __init__(self, labels: list[str], weights: np.ndarray, start: np.ndarray, move: np.ndarray, seen: frozenset[int], known: frozenset[str] = frozenset(), limit: float = 0.0) -> None:
        self.labels, self.weights, self.start, self.move, self.seen, self.known, self.limit = labels, weights, start, move, seen, known, limit
        self._fresh()

    def _fresh(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.empty((1 << 12, len(self.labels)), np.float32)
        self.lettered = np.empty(1 << 12, bool)
        self.familiar = np.empty(1 << 12, np.float32)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("labels", "weights", "start", "move", "seen", "known", "limit")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def _learn(self, words: set[str]) -> None:
        """Puts the emissions of new words into the cache."""
        if len(self.index) + len(words) > CACHE_WORDS:
            self._fresh()
        k, new = len(self.index), list(words)
        if k + len(new) > len(self.rows):
            more = max(len(self.rows), k + len(new) - len(self.rows))
            self.rows = np.concatenate([self.rows, np.empty((more, len(self.labels)), np.float32)])
            self.lettered = np.concatenate([self.lettered, np.empty(more, bool)])
            self.familiar = np.concatenate([self.familiar, np.empty(more, np.float32)])
        cores = [core(w) for w in new]
        e = emissions(cores, self.weights)
        self.rows[k : k + len(new)] = np.maximum(np.exp(e - e.max(1, keepdims=True)), 1e-12)
        strange = [i for i, c in enumerate(cores) if c and not any(block_of(x) in self.seen for x in c)]
        self.rows[k : k + len(new)][strange] = np.where(np.arange(len(self.labels)) == len(self.labels) - 1, 1.0, 1e-12)
        self.lettered[k : k + len(new)] = [bool(c) for c in cores]
        self.familiar[k : k + len(new)] = [familiarity(c, self.known) for c in cores]
        self.index.update(zip(new, range(k, k + len(new)), strict=True))

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The mean marginals and the mean familiarity of each text's words that have letters; zeros if it has none."""
        out, total, familiar = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts)), np.zeros(len(texts))
        docs: list[int] = []
        lengths: list[int] = []
        words: list[str] = []

        def done() -> None:
            known = self.index
            if new := {w for w in words if w not in known}:
                self._learn(new)
                known = self.index
                if again := {w for w in words if w not in known}:  # the cache was emptied meanwhile
                    self._learn(again)
            rows = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            chains = lay_out(np.array(lengths, np.int64))
            rows = rows[chains.order]
            marginals, _, _ = forward_backward(self.rows[rows], chains, self.start, self.move)
            doc = np.repeat(docs, lengths)[chains.order]
            have = self.lettered[rows]
            for k in range(len(self.labels)):
                out[:, k] += np.bincount(doc[have], marginals[have, k], len(texts))
            total[:] += np.bincount(doc[have], minlength=len(texts))
            familiar[:] += np.bincount(doc[have], self.familiar[rows][have], len(texts))
            for x in (docs, lengths, words):
                x.clear()

        for i, text in enumerate(texts if self.labels else []):
            for line in (text or "").split("\n"):
                parts = line.split()
                if parts:
                    docs.append(i)
                    lengths.append(len(parts))
                    words += parts
            if len(words) >= CHUNK_WORDS:
                done()
        if words:
            done()
        return out / np.maximum(total, 1)[:, None], familiar / np.maximum(total, 1)

    def labels_of(self, text: str | None) -> list[str]:
        """The likeliest label of each word."""
        lines = [line.split() for line in (text or "").split("\n")]
        words = [w for line in lines for w in line]
        if not words or not self.labels:
            return [UND] * len(words)
        if new := {w for w in words if w not in self.index}:
            self._learn(new)
        if again := {w for w in words if w not in self.index}:
            self._learn(again)
        rows = np.array([self.index[w] for w in words], np.int64)
        chains = lay_out(np.array([len(line) for line in lines], np.int64))
        marginals, _, _ = forward_backward(self.rows[rows[chains.order]], chains, self.start, self.move)
        best = np.empty(len(words), np.int64)
        best[chains.order] = marginals.argmax(1)
        return [self.labels[k] if self.lettered[r] else UND for k, r in zip(best, rows, strict=True)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The best language of each text, its score, the share of noise, and the text's familiarity."""
        s, familiar = self.scores(texts)
        if not self.labels:
            return [UND] * len(texts), *np.zeros((3, len(texts)))
        langs = s[:, :-1]
        names = [self.labels[k] if lettered else UND for k, lettered in zip(langs.argmax(1), s.sum(1) > 0, strict=True)]
        return names, np.clip(langs.max(1), 0, 1), np.clip(s[:, -1], 0, 1), familiar


def fit(texts: list[str], langs: list[str]) -> Tagger:
    """Maximum likelihood with a small penalty, by Adam over all chains of the sample."""
    labels, rng = sorted(set(langs)), np.random.default_rng(SEED)
    lines = [(labels.index(lang), line.split()) for text, lang in zip(texts, langs, strict=True) for line in text.split("\n") if line.strip()]
    lines = [x for x in lines if x[1]]
    seen = frozenset(block_of(c) for _, line in lines for w in line for c in core(w))
    if lines:
        noise = rng.permutation(len(lines))[: -(-len(lines) // len(labels))]
        labels = [*labels, NOISE]
        lines += [(len(labels) - 1, ["".join(rng.permutation(list(w))) for w in lines[k][1]]) for k in noise]
    n_labels = len(labels)
    rng.shuffle(lines)
    chains, k = [], 0
    while k < len(lines):  # one to three lines of a random order make a chain
        take = int(rng.integers(1, 4))
        chains.append(lines[k : k + take])
        k += take
    names: dict[str, int] = {}
    flat = np.array([names.setdefault(w, len(names)) for c in chains for _, line in c for w in line], int)
    gold = np.array([lab for c in chains for lab, line in c for _ in line], int)
    layout = lay_out(np.array([sum(len(line) for _, line in c) for c in chains], int))
    flat, gold = flat[layout.order], gold[layout.order]
    cores = [core(w) for w in names]
    have = np.array([k for k, c in enumerate(cores) if c], np.int64)
    f_word, f_id = features([cores[k] for k in have]) if len(have) else (np.empty(0, np.int64), np.empty(0, np.int64))
    f_word = have[f_word] if len(have) else f_word
    hits = np.zeros((len(names), n_labels))
    np.add.at(hits, (flat, gold), 1)
    first = np.zeros(n_labels)
    np.add.at(first, gold[: layout.counts[0]] if len(layout.counts) else gold[:0], 1)
    pairs = np.zeros((n_labels, n_labels))
    for t in range(len(layout.counts) - 1):
        a, c = layout.starts[t], layout.counts[t + 1]
        np.add.at(pairs, (gold[a : a + c], gold[layout.starts[t + 1] : layout.starts[t + 1] + c]), 1)
    weights, start, move = np.zeros((BUCKETS, n_labels)), np.zeros(n_labels), np.zeros((n_labels, n_labels))
    params = [weights, start, move]
    mean, square = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    n = max(1, len(flat))
    for step in range(1, STEPS + 1 if n_labels > 1 and len(flat) else 1):
        emit = np.zeros((len(names), n_labels))
        for c in range(n_labels):
            emit[:, c] = np.bincount(f_word, weights[f_id, c], len(names))
        e = emit[flat]
        m, moved, _ = forward_backward(np.exp(np.maximum(e - e.max(1, keepdims=True), -30)), layout, np.exp(start - start.max()), np.exp(move - move.max()))
        expected = np.zeros_like(hits)
        for c in range(n_labels):
            expected[:, c] = np.bincount(flat, m[:, c], len(names))
        gap = hits - expected
        g_weights = np.zeros_like(weights)
        for c in range(n_labels):
            g_weights[:, c] = np.bincount(f_id, gap[f_word, c], BUCKETS)
        grads = [g_weights / n - L2 * weights, (first - m[: layout.counts[0]].sum(0)) / n - L2 * start, (pairs - moved) / n - L2 * move]
        for x, g, a, b in zip(params, grads, mean, square, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Tagger(labels, weights.astype(np.float32), np.exp(start - start.max(initial=-1e9)).astype(np.float32), np.exp(move - move.max(initial=-1e9)).astype(np.float32), seen, *calibrated(texts))


def sampled_text(text: str, h: int) -> str:
    """At most TRAIN_CHARS characters of a text: whole lines from one that the hash chooses on, and round."""
    if len(text) <= TRAIN_CHARS:
        return text
    lines = text.split("\n")
    at, out, room = h % len(lines), [], TRAIN_CHARS
    for line in lines[at:] + lines[:at]:
        if room <= 0:
            break
        out.append(line[:room])
        room -= len(out[-1]) + 1
    return "\n".join(out)


def train(docs: DataFrame, may_train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Tagger:
    have = docs.where(may_train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    have = have.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    # a rank by hash is limited before its shuffle, so a hot language sends few rows
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    drawn = have.withColumn("rank", rank).where(F.col("rank") <= DOCS_PER_LANG)

    def cut(texts: list[dict]) -> list[pa.Array]:
        return [pa.array([sampled_text(x["text"], x["h"]) for x in texts], pa.string())]

    short = mapped(drawn.withColumn("both", F.struct("text", "h")), "both", lambda: cut, "said string", ["lang", "rank"], 20)
    rows = short.orderBy("rank", "lang").limit(MAX_LANGS * DOCS_PER_LANG).select("lang", "said").collect()
    rows.sort()
    return fit([r.said for r in rows], [r.lang for r in rows])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predicted(docs: DataFrame, tagger: Tagger, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all if None), lang_pred, score, noise and familiar."""
    def predict(texts: list[str | None]) -> list[pa.Array]:
        names, *numbers = tagger.predict(texts)
        return [pa.array(names, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)]

    return mapped(docs, text_col, lambda: predict, "lang_pred string, score double, noise double, familiar double", keep)


def word_labels(docs: DataFrame, tagger: Tagger, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all if None) and labels: the likeliest language of each word of the text, split at
    white space; ``und`` for words without a letter. Empty for a null text."""
    def label(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([tagger.labels_of(t) for t in texts], pa.list_(pa.string()))]

    return mapped(docs, text_col, lambda: label, "labels array<string>", keep)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, noise, familiar of every row; learns from the rows that aren't held out."""
    out = held_out(F.col(id_col))
    tagger = train(docs, F.col(id_col).isNotNull() & ~out, id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    return predicted(slim, tagger, "text", ["doc_id", "held_out"])
