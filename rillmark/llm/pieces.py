"""SentencePiece encoding and decoding by batched numpy Viterbi.

Distinct words of equal length advance together, one character at a time. At each place the substrings that end
there are probed, by hash, among the sorted keys of the pieces; a vectorised maximum over the pieces that may end
there chooses one and stores a backpointer. For a unigram model a piece's worth is its score plus that of the best
way to its start. For a BPE model (whose merges are no sum of scores) a piece is worth choosing if and only if merging
would leave it beside the piece chosen before it: two neighbours stand as they are in a BPE encoding exactly if no
merge crosses their border while either of them is built, so that test along the best path gives the ids of the
merge procedure itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import Words, mix, powers, ragged, table, text_slices, tidy

BLANK = np.array([b == 0x20 for b in range(256)])
META = "▁"
KEPT = 300_000
LONG = 48  # longer words are cut where no piece can cross


def codepoints(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(words)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), at


class PieceModel:
    """Pieces and scores of a SentencePiece model with an identity normaliser and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or not spec.trainer_spec.byte_fallback:
            raise ValueError("only models with the identity normaliser, a dummy prefix and byte fallback are handled")
        self.library = SentencePieceProcessor(model_file=path)
        self.bpe = spec.trainer_spec.model_type == 2
        self.known_words, self.known_ids, self.known_at = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(1, np.int64)
        kinds, texts = np.array([p.type for p in spec.pieces]), [p.piece for p in spec.pieces]
        self.byte_ids = np.full(256, -1)
        for i in np.flatnonzero(kinds == 6):
            self.byte_ids[int(texts[i][3:5], 16)] = i
        ids = [int(i) for i in np.flatnonzero(kinds == 1)]
        self.blanks = {len(texts[i]): i for i in ids if set(texts[i]) == {META}}
        self.text_bytes = [b"" if kinds[i] in (3, 2) else bytes([int(t[3:5], 16)]) if kinds[i] == 6 else t.replace(META, " ").encode() for i, t in enumerate(texts)]
        keep = [i for i in ids if META not in texts[i][1:]]  # runs of blanks are merged on their own
        self.longest = max(len(texts[i]) for i in keep)
        self.ids = np.array(keep)
        self.lengths = np.array([len(texts[i]) for i in keep])
        chars, at = codepoints([texts[i] for i in keep])
        self.codes = np.random.default_rng(11).integers(1, 2**63, 4096).astype(np.uint64)
        up, down = powers(len(chars) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(self._code(chars) * up[: len(chars)], dtype=np.uint64)])
        keys = mix((total[at[1:]] - total[at[:-1]]) * down[at[:-1]] + self.lengths.astype(np.uint64))
        order = np.argsort(keys)
        self.keys, self.number = keys[order], order
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys >> np.uint64(44)).astype(np.int64)] = True
        self.memo_key, self.memo = np.full(1 << 20, -1), np.zeros(1 << 20, bool)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.score = np.array([spec.pieces[i].score for i in keep])
        inner = np.ones(len(chars), bool)
        inner[at[1:] - 1] = False
        pair = (chars[:-1].astype(np.uint64) << np.uint64(32)) | chars[1:]
        self.joined = np.unique(pair[inner[:-1]])
        # every way to write a piece as two: (left, right) -> rank of the piece
        self.rank = np.full(len(keep), -1)
        multi = self.lengths > 1
        self.rank[np.flatnonzero(multi)[np.argsort(-self.score[multi], kind="stable")]] = np.arange(int(multi.sum()))
        self.left = np.full(len(keep), -1)
        self.right = np.full(len(keep), -1)
        if self.bpe:
            self._splits(chars, at, total, down)

    @staticmethod
    def _code(chars: np.ndarray) -> np.ndarray:
        return mix(chars.astype(np.uint64) + np.uint64(0x51ED2701)) | np.uint64(1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the pieces with these hashes, -1 for none; a bit table turns most others away first."""
        out = np.full(len(keys), -1)
        maybe = np.flatnonzero(self.seen[(keys >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == keys[maybe], self.number[at], -1)
        return out

    def _splits(self, chars: np.ndarray, at: np.ndarray, total: np.ndarray, down: np.ndarray) -> None:
        left, right, whole = [], [], []
        for size in range(2, self.longest + 1):
            mine = np.flatnonzero(self.lengths == size)
            for cut in range(1, size):
                mid = at[mine] + cut
                a = self.find(mix((total[mid] - total[at[mine]]) * down[at[mine]] + np.uint64(cut)))
                b = self.find(mix((total[at[mine + 1]] - total[mid]) * down[mid] + np.uint64(size - cut)))
                ok = (a >= 0) & (b >= 0)
                left.append(a[ok])
                right.append(b[ok])
                whole.append(mine[ok])
        left, right, whole = (np.concatenate(x) for x in (left, right, whole))
        key = left * len(self.ids) + right
        order = np.argsort(key)
        self.pair_keys, self.pair_rank = key[order], self.rank[whole][order]
        self.usable = self.lengths == 1
        for size in range(2, self.longest + 1):  # shorter pieces first: which two a piece is last merged from
            rows = np.flatnonzero((self.lengths[whole] == size) & self.usable[left] & self.usable[right])
            good = rows[self.stand(left[rows], right[rows], self.rank[whole[rows]])]
            self.left[whole[good]], self.right[whole[good]] = left[good], right[good]
            self.usable[whole[good]] = True

    def stand(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether pieces a and b stay apart under merging (up to, not including, the merge of rank ``limit``)."""
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.astype(np.int64).copy()
        live = np.flatnonzero((a >= 0) & (b >= 0))  # a character without a piece merges with nothing
        while len(live):
            key = a[live] * len(self.ids) + b[live]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == key) & (self.pair_rank[at] < limit[live])
            out[live[crossed]] = False
            live = live[~crossed]
            ra, rb = self.rank[a[live]], self.rank[b[live]]
            live, ra, rb = (x[(ra >= 0) | (rb >= 0)] for x in (live, ra, rb))
            undo = ra > rb  # the later of the two merges is undone; of equal ones the left comes first
            limit[live] = np.where(undo, ra, rb + 1)
            a[live[undo]] = self.right[a[live[undo]]]
            b[live[~undo]] = self.left[b[live[~undo]]]
        return out

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stand`` behind a table of recent answers (one place for each hash, of fixed size)."""
        key = np.where((a >= 0) & (b >= 0), a * len(self.ids) + b, -2)
        slot = (mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        out = self.memo[slot] | (key == -2)
        miss = np.flatnonzero((self.memo_key[slot] != key) & (key != -2))
        if len(miss):
            out[miss] = self.stand(a[miss], b[miss])
            self.memo_key[slot[miss]] = key[miss]
            good = self.memo_key[slot[miss]] == key[miss]  # of several misses for one place the last one stays
            self.memo[slot[miss[good]]] = out[miss[good]]
        return out

    def blank_run(self, n: int) -> list[int]:
        return _blank_run(self, n)

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The piece numbers (-1 - code point for a character without piece) of all words, and where each word's begin."""
        chars, at = codepoints(words)
        size = np.diff(at)
        longest = int(size.max()) if len(size) else 0
        up, down = powers(longest + 1)
        got_word, got_place, got_piece = [], [], []
        for length in np.unique(size):
            group = np.flatnonzero(size == length)
            n = len(group)
            letters = chars[at[group][:, None] + np.arange(length)].T  # a row for each place, so that steps read along memory
            total = np.zeros((length + 1, n), np.uint64)
            np.cumsum(self._code(letters) * up[:length, None], axis=0, out=total[1:])
            last = np.full((length + 1, n), -1)
            back = np.zeros((length + 1, n), np.int32)
            worth = np.full((length + 1, n), -np.inf)
            worth[0] = 0
            for end in range(1, length + 1):
                for m in range(1, min(end, self.longest) + 1):
                    piece = self.find(mix((total[end] - total[end - m]) * down[end - m] + np.uint64(m)))
                    rows = np.flatnonzero(piece >= 0) if m > 1 else np.arange(n)
                    if not len(rows):
                        continue
                    before = worth[end - m][rows]
                    if self.bpe:
                        fits = np.isfinite(before) & ((piece[rows] < 0) | self.usable[piece[rows]])
                        rows = rows[fits]
                        if end > m:
                            rows = rows[self.neighbours(last[end - m][rows], piece[rows])]
                        gain = np.zeros(len(rows))
                    else:
                        gain = before + np.where(piece[rows] >= 0, self.score[piece[rows]], self.score.min() - 10)
                    better = gain > worth[end][rows]
                    rows = rows[better]
                    worth[end, rows], back[end, rows], last[end, rows] = gain[better], m, piece[rows]
            end, rows = np.full(n, length), np.arange(n)
            while len(rows):
                here = end[rows]
                piece = last[here, rows]
                got_word.append(group[rows])
                got_place.append(here)
                got_piece.append(np.where(piece >= 0, piece, -1 - letters[here - 1, rows].astype(np.int64)))
                end[rows] = here - back[here, rows]
                rows = rows[end[rows] > 0]
        if not got_word:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        word, place, piece = (np.concatenate(x) for x in (got_word, got_place, got_piece))
        order = np.lexsort((place, word))
        return piece[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (each begins with the blank mark and holds no other), and where each word's begin."""
        parts, owner = [], []
        for i, w in enumerate(words):
            if len(w) <= LONG:
                parts.append(w)
                owner.append(i)
                continue
            chars, _ = codepoints([w])
            pair = (chars[:-1].astype(np.uint64) << np.uint64(32)) | chars[1:]
            at = np.minimum(np.searchsorted(self.joined, pair), len(self.joined) - 1)
            cuts = [0, *(np.flatnonzero(self.joined[at] != pair) + 1).tolist(), len(w)]
            parts += [w[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            owner += [i] * (len(cuts) - 1)
        known = pa.array(parts).dictionary_encode()
        number = known.indices.to_numpy()
        piece, at = self.viterbi(known.dictionary.to_pylist())
        ids = np.where(piece >= 0, self.ids[np.maximum(piece, 0)], piece)
        lone = np.flatnonzero(ids < 0)
        if len(lone):  # characters without a piece are written as their bytes
            raw = [chr(-1 - int(c)).encode("utf-8", "surrogatepass") for c in ids[lone]]
            width = np.ones(len(ids), np.int64)
            width[lone] = [len(r) for r in raw]
            start = np.concatenate([[0], np.cumsum(width)])
            wide = np.repeat(ids, width)
            wide[ragged(start[lone], width[lone])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            ids, at = wide, start[at]
        size = np.diff(at)[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        count = np.bincount(np.array(owner, np.int64), minlength=len(words)) if owner else np.zeros(len(words), np.int64)
        return ids[ragged(at[:-1][number], size)], ends[np.concatenate([[0], np.cumsum(count)])]

    def encode_known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words (without blanks), and where each word's begin. The first ``KEPT`` words that a
        worker meets stay known to it, so frequent ones are encoded once."""
        at = pc.index_in(words, value_set=self.known_words)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        ids, ends = self.encode_words([META + w for w in words.take(pa.array(new)).to_pylist()])
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if len(self.known_words):
            old = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            begin, size = self.known_at[:-1][old], np.diff(self.known_at)[old]
        begin[new], size[new] = len(self.known_ids) + ends[:-1], np.diff(ends)
        out = np.concatenate([self.known_ids, ids])[ragged(begin, size)]
        more = min(KEPT - len(self.known_words), len(new))
        if more > 0:
            self.known_words = pa.concat_arrays([self.known_words, words.take(pa.array(new[:more]))])
            self.known_at = np.concatenate([self.known_at, len(self.known_ids) + ends[1 : more + 1]])
            self.known_ids = np.concatenate([self.known_ids, ids[: ends[more]]])
        return out, np.concatenate([[0], np.cumsum(size)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, and where each text's begin (with the end as last)."""
        texts = pc.replace_substring(texts, META, " ")
        words = Words(texts, lower=False, between=BLANK)
        size_bytes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        before = words.begin.copy()
        inner = np.flatnonzero(words.text[1:] == words.text[:-1]) + 1
        before[inner] -= words.begin[inner - 1] + words.length[inner - 1]
        opening = np.ones(len(words), bool)
        opening[inner] = False
        before[opening] += 1  # the blank that is put before every text
        after = np.where(size_bytes > 0, size_bytes + 1, 0)  # blanks after the last word (all, where there is none)
        final = np.flatnonzero(np.diff(words.first) > 0)
        tail = words.first[1:][final] - 1
        after[final] = size_bytes[final] - words.begin[tail] - words.length[tail]
        number, known = words.distinct() if len(words) else (np.zeros(0, np.int64), pa.array([], pa.string()))
        ids, at = self.encode_known(known)
        bare = (at[1:] > at[:-1]) & (ids[np.minimum(at[:-1], max(len(ids) - 1, 0))] == self.blanks[1]) if len(ids) else np.zeros(len(known), bool)
        run = np.where(bare[number], before, before - 1) if len(words) else before
        longest = np.unique(np.concatenate([run, after]))
        runs = {int(n): self.blank_run(int(n)) for n in longest if n > 0}
        run_ids = np.array([x for r in runs.values() for x in r], np.int64)
        run_at = np.concatenate([[0], np.cumsum([len(r) for r in runs.values()])]).astype(np.int64)
        run_no = np.array([*runs], np.int64)
        pool = np.concatenate([ids, run_ids])

        def place(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = np.searchsorted(run_no, n) if len(run_no) else np.zeros(len(n), np.int64)
            k = np.minimum(k, max(len(run_no) - 1, 0))
            has = n > 0
            return np.where(has, run_at[k] + len(ids), 0), np.where(has, (run_at[k + 1] - run_at[k]) if len(run_no) else 0, 0)

        s1, n1 = place(run)
        s2, n2 = place(after)
        skip = bare[number].astype(np.int64) if len(words) else np.zeros(0, np.int64)
        start = at[:-1][number] + skip if len(words) else np.zeros(0, np.int64)
        count = np.diff(at)[number] - skip if len(words) else np.zeros(0, np.int64)
        owner = np.concatenate([words.text, words.text, np.arange(len(texts))])
        place_ = np.concatenate([2 * np.arange(len(words)), 2 * np.arange(len(words)) + 1, np.full(len(texts), 2 * len(words) + 2)])
        order = np.lexsort((place_, owner))
        begin, length = np.concatenate([s1, start, s2])[order], np.concatenate([n1, count, n2])[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[order], length, len(texts)))]).astype(np.int64)
        return pool[ragged(begin, length)], ends

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts that the ids stand for, without the blank put before them."""
        size = np.array([len(b) for b in self.text_bytes])
        data = np.frombuffer(b"".join(self.text_bytes), np.uint8)
        start = np.cumsum(size) - size
        flat = data[ragged(start[ids], size[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(size[ids])])[at]
        return [flat[i:j].decode("utf-8", "replace").removeprefix(" ") for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(maxsize=4096)
def _blank_run(model: PieceModel, n: int) -> list[int]:
    """A run of blanks: all its merges have one score, so the leftmost pair that is a piece merges first."""
    if not model.bpe:
        best, took = [0.0], [0]
        score = {m: model.library.get_score(i) for m, i in model.blanks.items()}
        for end in range(1, n + 1):
            gain, m = max((best[end - m] + s, m) for m, s in score.items() if m <= end)
            best.append(gain)
            took.append(m)
        out, end = [], n
        while end:
            out.append(model.blanks[took[end]])
            end -= took[end]
        return out[::-1]
    done: list[int] = []
    todo = n
    while True:
        if len(done) >= 2 and done[-2] + done[-1] in model.blanks:
            done[-2:] = [done[-2] + done[-1]]
        elif todo:
            done.append(1)
            todo -= 1
        else:
            return [model.blanks[m] for m in done]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_crc32, round_trip[, ids]) of every row's whole text.

    ids_crc32 is over the little-endian unsigned 32-bit ids; round_trip tells whether decoding gives the text back
    (a text with the blank mark itself comes back with spaces there). Null texts are empty; empty texts have no
    tokens; repeated ids are rows each; an empty table gives an empty one.
    """
    names = ["id", "n_tokens", "ids_crc32", "round_trip"] + ["ids"] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            model = piece_model(path)
            ids, at = model.encode(texts)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            same = pc.equal(pa.array(model.decode(ids, at), pa.string()), pc.replace_substring(texts, META, " "))
            out = [rows.column(0), pa.array(np.diff(at)), pa.array(crc, pa.int64()), same]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)


def op9(spark, sf_dir):
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
