"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is run through the merges once: those that come out as one token are whole. A text is
cut into pre-tokens; a whole one counts 1 without any merge, and only the rest are merged, each distinct one once
until the memo is full and starts anew. Special strings inside a text are one token each, the library's default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

LIMIT = 1024
#: Pre-tokens whose counts a worker remembers; a full memo is emptied, so memory is bounded and counts don't change.
MEMO = 400_000
#: Longer pre-tokens aren't remembered.
MEMO_CHARS = 64

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself where it prints, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts the tokens of texts as the tokenizers library does for a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config["pre_tokenizer"]
        if config["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or config["model"]["ignore_merges"]:
            raise ValueError(f"{path}: only plain byte-level BPE is proved here")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in config["added_tokens"]):
            raise ValueError(f"{path}: special tokens that take more than their own string")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = regex.compile(PATTERN).findall
        special = [regex.escape(t["content"]) for t in config["added_tokens"]]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.marks = [t["content"] for t in config["added_tokens"]]
        self.chars = byte_chars()
        self.whole = self.prove(config["model"]["vocab"])
        self.memo: dict[str, int] = {}

    def prove(self, vocab: dict[str, int]) -> dict[str, int]:
        """{text: 1} of the vocabulary strings that are valid UTF-8 and that the merges leave as one token."""
        byte = {c: b for b, c in self.chars.items()}
        whole = {}
        for s in vocab:
            try:
                text = bytes(byte[c] for c in s).decode()
            except (UnicodeDecodeError, KeyError):
                continue
            if len(self.model.tokenize(s)) == 1:
                whole[text] = 1
        return whole

    def merged(self, piece: str) -> int:
        return len(self.model.tokenize("".join([self.chars[b] for b in piece.encode()])))

    def plain(self, text: str) -> int:
        pieces = self.find(text)
        whole, memo = self.whole, self.memo
        rest = [p for p in pieces if p not in whole]
        n = len(pieces) - len(rest)
        for p in rest:
            k = memo.get(p)
            if k is None:
                k = self.merged(p)
                if len(p) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[p] = k
            n += k
        return n

    def count(self, text: str) -> int:
        if not any(m in text for m in self.marks):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; a null text counts as an empty one, repeated rows each.

    path: a byte-level BPE file of the tokenizers library, found under this path by every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                tokens.append(count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
