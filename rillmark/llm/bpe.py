"""Byte-pair encoding with word ends by rank-synchronous array merging.

All distinct pre-tokens of a slice of texts lie one after the other in one array of symbols. In each round every
pre-token finds its pair of lowest rank, and all pre-tokens merge theirs at once; those without a pair are done.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rillmark.llm.common import bytes_of, ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
NONE = np.iinfo(np.int64).max
KEPT = 200_000
ODD = np.uint64(0x9E3779B97F4A7C15)
#: The white space of Unicode beyond ASCII.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself, or the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def slot_of(key: np.ndarray, slots: int) -> np.ndarray:
    """Where the search for a key begins in a table of ``slots`` (a power of two)."""
    return (key.astype(np.uint64) * ODD >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def hash_slots(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """An open hash table of distinct keys (each one's number, -1 for empty slots), and the most slots a search visits."""
    slots = np.full(1 << (8 * len(keys) + 1).bit_length(), -1, np.int32)
    left, at, reach = np.arange(len(keys)), slot_of(keys, len(slots)), 0
    while len(left):
        free = np.flatnonzero(slots[at] < 0)
        taken, first = np.unique(at[free], return_index=True)
        slots[taken] = left[free[first]]
        rest = slots[at] != left
        left, at, reach = left[rest], (at[rest] + 1) % len(slots), reach + 1
    return slots, reach


class WordBPE:
    """The vocabulary of a tokenizers file: byte-level BPE whose last symbol of a word carries a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_alphabet()
        self.plain = np.array([vocab[c] for c in chars])
        self.final = np.array([vocab[c + end] for c in chars])
        self.width = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs])
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order
        self.slots, self.reach = hash_slots(self.keys)
        self.made = np.array([vocab[a + b] for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        self.known_chunks, self.known_ids, self.known_at = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(1, np.int64)
        # the vocabulary's own pattern for text of ASCII letters; other text is split by the library
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\v\f\ra-z0-9]+"
        self.ascii, self.ascii_lines = re.compile(pattern), re.compile(pattern + "|\n")

    def pretokens(self, text: str) -> list[str | int]:
        """The pre-tokens of a text without ASCII white space; special strings as their ids."""
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                out += self.ascii.findall(part.lower())
            else:
                out += [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def ranks(self, key: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE for those that are not merged."""
        out = np.full(len(key), NONE)
        rows, at = np.arange(len(key)), slot_of(key, len(self.slots))
        for _ in range(self.reach):
            no = self.slots[at]
            used = no >= 0  # an empty slot ends a search
            rows, at, no, key = rows[used], at[used], no[used], key[used]
            met = self.keys[no] == key
            out[rows[met]] = self.rank[no[met]]
            rows, at, key = rows[~met], (at[~met] + 1) % len(self.slots), key[~met]
        return out

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, and where each word's begin (with the end as last). No word is empty."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        data, ends = bytes_of(words)
        size = np.diff(ends)
        symbol, owner = self.plain[data], np.repeat(np.arange(len(words)), size)
        last = np.cumsum(size) - 1
        symbol[last] = self.final[data[last]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank = np.full(len(symbol), NONE)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self.ranks(symbol[inner] * self.width + symbol[inner + 1])
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.concatenate([first, [len(symbol)]])))
            idle = best == NONE
            if idle.any():
                done.append((owner[idle], symbol[idle]))
            hit = np.flatnonzero((rank == best) & ~idle)
            run = np.concatenate([[True], np.diff(hit) != 1]) if len(hit) else np.zeros(0, bool)
            hit = hit[(hit - np.repeat(hit[run], np.diff(np.concatenate([np.flatnonzero(run), [len(hit)]])))) % 2 == 0]  # of a a a, the left pair
            symbol[hit] = self.made[rank[hit]]
            idle[hit + 1] = True
            symbol, owner = symbol[~idle], owner[~idle]
        owner, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])

    def split(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The pre-tokens of chunks without ASCII white space: chunk number and index into a list, in order."""
        owner: list[np.ndarray] = []
        tokens: list[str] = []
        plain = [i for i, x in enumerate(chunks) if x.isascii() and "<|" not in x]
        if plain:
            found = self.ascii_lines.findall("\n".join([chunks[i] for i in plain]).lower() + "\n")
            known = pa.array(found).dictionary_encode()
            number = known.indices.to_numpy()
            stop = number == known.dictionary.index("\n").as_py()
            owner.append(np.array(plain)[np.cumsum(stop)[~stop]])
            tokens, index = known.dictionary.to_pylist(), [number[~stop]]
        else:
            index = []
        # chunks that hold white space of their own would shift the count of spaces below, so they go one by one
        wide = [i for i, x in enumerate(chunks) if not x.isascii() and "<|" not in x and not WIDE_SPACE.search(x)]
        joined: list[int] = []
        if wide:
            text = self.library.normalizer.normalize_str(" ".join([chunks[i] for i in wide]))
            begin = np.flatnonzero(np.concatenate([[True], np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32]))
            if len(begin) == len(wide):  # else the normaliser leaves nothing of some chunk
                parts = [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(text)]
                owner.append(np.array(wide)[np.searchsorted(begin, [a for a, _ in parts], side="right") - 1])
                index.append(np.arange(len(tokens), len(tokens) + len(parts)))
                tokens += [text[a:b] for a, b in parts]
                joined = wide
        alphabet = {c: b for b, c in enumerate(byte_alphabet())}
        done = {*plain, *joined}
        for i in [i for i in range(len(chunks)) if i not in done]:
            for x in self.pretokens(chunks[i]):
                owner.append(np.array([i]))
                index.append(np.array([len(tokens)]))
                tokens.append(x if isinstance(x, int) or x.isascii() else bytes(alphabet[c] for c in x).decode())
        owners, indices = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, index))
        order = np.argsort(owners, kind="stable")
        return owners[order], indices[order], tokens

    def encode(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks (texts without ASCII white space), and where each chunk's begin.

        The first ``KEPT`` chunks that a worker meets stay known to it, so frequent ones are encoded once."""
        at = pc.index_in(chunks, value_set=self.known_chunks)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        ids, ends = self.encode_new(chunks.take(pa.array(new)).to_pylist())
        at = at.fill_null(0).to_numpy().astype(np.int64)
        begin, size = self.known_at[:-1][at] if len(self.known_chunks) else np.zeros(len(at), np.int64), np.diff(self.known_at)[at] if len(self.known_chunks) else np.zeros(len(at), np.int64)
        begin[new], size[new] = len(self.known_ids) + ends[:-1], np.diff(ends)
        out = np.concatenate([self.known_ids, ids])[ragged(begin, size)]
        more = min(KEPT - len(self.known_chunks), len(new))
        if more > 0:
            self.known_chunks = pa.concat_arrays([self.known_chunks, chunks.take(pa.array(new[:more]))])
            self.known_at = np.concatenate([self.known_at, len(self.known_ids) + ends[1 : more + 1]])
            self.known_ids = np.concatenate([self.known_ids, ids[: ends[more]]])
        return out, np.concatenate([[0], np.cumsum(size)])

    def encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        owner, index, tokens = self.split(chunks)
        marks = [i for i, x in enumerate(tokens) if isinstance(x, int)]
        specials = np.array([tokens[i] for i in marks], np.int64)
        for i in marks:
            tokens[i] = " "  # no pre-token
        known = pa.array(tokens, pa.string()).dictionary_encode()
        ids, at = self.merge(known.dictionary)
        number = known.indices.to_numpy()
        size, begin = np.diff(at)[number], at[:-1][number]
        size[marks], begin[marks] = 1, len(ids) + np.arange(len(marks))
        ids = np.concatenate([ids, specials])
        total = np.concatenate([[0], np.cumsum(size[index])])
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(chunks)))]).astype(np.int64)
        return ids[ragged(begin[index], size[index])], total[ends]


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)
