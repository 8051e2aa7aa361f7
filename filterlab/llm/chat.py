"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered with control strings that mark its turns, encoded once with
offsets, and a token belongs to the loss if its span meets the span of an assistant text. Spans
and tokens are both sorted, so each span finds its tokens by binary search. The control strings
are tokens of their own, so no token straddles the border of a text.

    user        [INST]text[/INST]
    assistant   <s>text</s>
    other role  <s>role[INST]text[/INST]</s>

A control string inside a role or text gets a backslash after its first character, one more than
it has; reading back takes one away. So no text can end its turn or forge another.

Null texts and roles are taken as empty. Turns are ordered by turn, role and text, nulls first;
repeated rows are turns of their own. Null conv_ids form one conversation. A conversation is the
unit of work and is held whole in one task; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filterlab.llm.common import mapped

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_ESCAPE = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        text = escape(text)
        if role == "user":
            parts = ["[INST]", text, "[/INST]"]
        elif role == "assistant":
            parts = ["<s>", text, "</s>"]
            spans.append((at + 3, at + 3 + len(text)))
        else:
            parts = ["<s>", escape(role), "[INST]", text, "[/INST]", "</s>"]
        out += parts
        at += sum(map(len, parts))
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted conversation holds."""
    turns, at = [], 0
    while at < len(formatted):
        if formatted.startswith("[INST]", at):
            end = formatted.index("[/INST]", at)
            turns.append(("user", unescape(formatted[at + 6 : end])))
            at = end + 7
            continue
        mark = _CONTROL.search(formatted, at + 3)
        if mark[0] == "</s>":
            turns.append(("assistant", unescape(formatted[at + 3 : mark.start()])))
            at = mark.end()
        else:
            end = formatted.index("[/INST]", mark.end())
            turns.append((unescape(formatted[at + 3 : mark.start()]), unescape(formatted[mark.end() : end])))
            at = end + 11
    return turns


@functools.lru_cache(2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    t.add_tokens([AddedToken(c, normalized=False, special=False) for c in CONTROLS])
    t.encode_special_tokens = True  # its own special tokens are ordinary text here
    return t


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token meets a span. Tokens of one character's bytes share its offsets."""
    mask = np.zeros(len(starts), bool)
    for a, b in spans:
        if a < b:
            mask[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b, side="left")] = True
    return mask


FIELDS = "formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def formatted(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id and FIELDS, one row for each conversation of (conv_id, turn, role, text) rows."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def code(conversations: list[list[dict]]) -> list[pa.Array]:
        out, t = [], tokenizer(tokenizer_path)
        for turns_of in conversations:
            text, spans = render([(x["role"], x["text"]) for x in turns_of])
            e = t.encode(text, add_special_tokens=False)
            offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
            starts, ends = np.ascontiguousarray(offsets[:, 0]), np.ascontiguousarray(offsets[:, 1])
            out.append((text, np.array(e.ids, np.int32), starts, ends, loss_mask(starts, ends, spans)))
        kinds = [pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
        return [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]

    return mapped(whole, "turns", lambda: code, FIELDS, ["conv_id"])


def loss_text(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """The text under the mask, unescaped run by run."""
    a, b = starts[loss], ends[loss]
    if not len(a):
        return ""
    cut = np.flatnonzero(a[1:] > b[:-1]) + 1
    return "".join(unescape(text[i:j]) for i, j in zip(a[np.r_[0, cut]], np.maximum.accumulate(b)[np.r_[cut - 1, len(b) - 1]], strict=True))


def digests(coded: DataFrame) -> DataFrame:
    """conv_id, and what the columns formatted, starts, ends and loss hold, read back from them."""
    def read(rows: list[dict]) -> list[pa.Array]:
        out = []
        for r in rows:
            turns = parse(r["formatted"])
            under = loss_text(r["formatted"], np.array(r["starts"], np.int64), np.array(r["ends"], np.int64), np.array(r["loss"], bool))
            joined = "".join(f"{role}\n{t}\n" for role, t in turns)
            out.append((len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(r["formatted"])))
        return [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]

    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return mapped(coded.select("conv_id", F.struct("formatted", "starts", "ends", "loss").alias("c")), "c", lambda: read, fields, ["conv_id"], 100)
