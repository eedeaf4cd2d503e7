"""Token tables of public tokenizer files, and splitting of texts into reusable chunks.

A text is cut before each single blank that stands between two signs that are
not white space. The byte-level pre-tokenizer always starts a new piece there,
so a chunk's tokens do not depend on its surroundings and can be kept for the
next time the chunk is seen.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed value: how byte-level files of this kind cut texts into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_RUNS = re.compile(r"\s\s")
_CUTS = re.compile(r"(?<=\S)(?= \S)")


def plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file cuts texts by PATTERN and nothing else, so that chunks() may cut them first."""
    before = spec.get("pre_tokenizer") or {}
    cut = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    model = spec["model"]
    plain = all(not model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    return bool(cut and plain and model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding"))


def ids_are_ranks(spec: dict) -> bool:
    """Whether the vocabulary's ids stand in the order of the merges that make them, one merge for each token of several bytes."""
    vocab = spec["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    alphabet = byte_alphabet()
    special = {t["content"] for t in spec["added_tokens"]}
    several = sum(len(t) > 1 and t not in special for t in vocab)
    return all(c in vocab for c in alphabet) and len(made) == several and all(x < y for x, y in zip([max(vocab[c] for c in alphabet), *made], made))


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of byte-level vocabularies stands for: printable bytes for
    themselves, the others, in order, as the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def chunks(text: str) -> list[str]:
    """The text in order, cut where pre-tokens cannot reach across."""
    if not text:
        return []
    if _RUNS.search(text):
        return _CUTS.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


class Kept:
    """What was computed for chunks, at most about 2 * limit of them: when the young
    generation is full it becomes the old one, and what is asked for again moves back."""

    def __init__(self, compute, limit: int):
        self.compute, self.limit = compute, limit
        self.young: dict = {}
        self.old: dict = {}

    def of(self, wanted: set) -> dict:
        """A dict that holds at least all wanted."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        absent = wanted.difference(self.young)
        again = absent.intersection(self.old)
        self.young.update((c, self.old[c]) for c in again)
        fresh = list(absent.difference(again))
        if fresh:
            self.young.update(zip(fresh, self.compute(fresh), strict=True))
        return self.young


class MergeTable:
    """Vocabulary and merges of a byte-level BPE file, as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.plain = plain_byte_level(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.base = max(vocab.values()) + 1
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.keys = key[order]
        self.ranks = order.astype(np.int32)
        self.made = made
        self.symbol = {c: i for c, i in vocab.items() if len(c) == 1}
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens in the byte alphabet, and the number of special strings."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        if self.split_special is None or not self.split_special.search(text):
            return [p for p, _ in split(text)], 0
        parts = self.split_special.split(text)
        return [p for part in parts if part for p, _ in split(part)], len(parts) - 1

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; pairs that never merge have the largest int."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int32).max)


def count_symbols(pretokens: list[str], table: MergeTable) -> np.ndarray:
    """Surviving symbols of each pre-token after all merges, rank-synchronously.

    All sequences stand in one ragged array. In each round every sequence
    applies its own lowest-ranked pair at all its places at once (leftmost
    first where places overlap); sequences without a pair leave the array.
    """
    counts = np.zeros(len(pretokens), np.int64)
    lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
    owner = np.repeat(np.arange(len(pretokens)), lengths)
    joined = "".join(pretokens)
    symbols = np.fromiter(map(table.symbol.__getitem__, joined), np.int32, len(joined))
    never = np.iinfo(np.int32).max
    while len(symbols):
        rank = np.full(len(symbols), never, np.int32)
        same = owner[:-1] == owner[1:]
        at = np.flatnonzero(same)
        rank[at] = table.rank_of(symbols[at], symbols[at + 1])
        begins = np.flatnonzero(np.concatenate([[True], ~same]))
        best = np.minimum.reduceat(rank, begins)
        sizes = np.diff(np.concatenate([begins, [len(symbols)]]))
        ended = best == never
        counts[owner[begins[ended]]] = sizes[ended]
        apply = (rank == np.repeat(best, sizes)) & (rank != never)
        spots = np.flatnonzero(apply)
        if len(spots) > 1:  # in a run of overlapping places every second one merges
            fresh = np.concatenate([[True], np.diff(spots) != 1])
            group = np.cumsum(fresh) - 1
            spots = spots[(np.arange(len(spots)) - np.flatnonzero(fresh)[group]) % 2 == 0]
        symbols[spots] = table.made[rank[spots]]
        keep = np.repeat(~ended, sizes)
        keep[spots + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return counts
