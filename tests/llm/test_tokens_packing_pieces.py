"""Token ids against the libraries; packings against their rules."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import Tokenizer

from rillmark.llm import bpe, packing, pieces, tokens
from rillmark.llm.bpe import WIDE_SPACE
from rillmark.llm.common import table
from tests.conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "  ", "A J\u030cx <|endoftext|>a<|ENDOFTEXT|> don't I'LL \uff12\uff13 \u00bd \u200b\x1c x\x85y z w \u0130stanbul \u0391\u03a3 \u03a3", "aaaaaaa " * 3 + "hahahahaha",
    "\u65e5\u672c\u8a9e\u30c6\u30ad\u30b9\u30c8 \U0001f389\U0001f389 \u0301abc", "<|startoftext|><|endoftext|>", "a" * 3_000, "'s's 's'", "\ufb01 \u01c5 \u0149 \u1e9e \u00df", "Hello  world\n\tx \u2581y \u3000z\x00 <s> <0x41>",
    " " * 40 + "word" + " " * 17, "====================", "function(x){return x;}  " * 5, "\n\n\n   \n", "ab" * 100 + "\u65e5" * 60, "x\u00a0y\u2003z",
]


def odd_docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (3, ODD[3]), (None, "null id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("length", F.lit(1)).withColumn("piece", F.lit(2))


def test_word_ids_are_the_library_s():
    lib = Tokenizer.from_file(WORD)
    for _ in range(2):  # the second time from what is known
        ids, at = tokens.text_ids(pa.array(ODD), WORD)
        for i, text in enumerate(ODD):
            assert ids[at[i] : at[i + 1]].tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_ranks_of_pairs_are_looked_up():
    """Every merge has its rank, other pairs none, however many keys crowd a slot."""
    model = bpe.word_bpe(WORD)
    assert (model.ranks(model.keys) == model.rank).all() and len(model.ranks(model.keys[:0])) == 0
    other = np.setdiff1d(np.random.default_rng(3).integers(0, model.width**2, 200_000), model.keys)
    assert (model.ranks(other) == bpe.NONE).all()
    keys = np.arange(0, 4_000, 3)
    slots, reach = bpe.hash_slots(keys)
    assert reach >= 1 and sorted(slots[slots >= 0].tolist()) == list(range(len(keys)))


def test_random_text_is_encoded_like_the_library():
    rng = random.Random(1)
    alphabet = "abcXYZ 0123.,'!<|>\n\t\u00e9\u00df\u03a3\u0301\u4e2d\U0001f600\u00a0\u0130"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    lib, sp = Tokenizer.from_file(WORD), SentencePieceProcessor(model_file=PIECE)
    ids, at = tokens.text_ids(pa.array(texts), WORD)
    assert all(ids[at[i] : at[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))
    ids, at = pieces.piece_model(PIECE).encode(pa.array(texts))
    assert all(ids[at[i] : at[i + 1]].tolist() == sp.encode(t) for i, t in enumerate(texts))


def test_white_space_beyond_ascii_shifts_no_ids():
    lib = Tokenizer.from_file(WORD)
    spaces = "\x85\u00a0\u1680\u2000\u2003\u2028\u2029\u202f\u205f\u3000"
    every = [c for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and " " in lib.normalizer.normalize_str(c)]
    assert all(WIDE_SPACE.search(c) for c in every)
    rng = random.Random(2)
    words = ["caf\u00e9", "na\u00efve", "\u00e9t\u00e9", "plain", "\u4e2d\u6587", "\u0301", "<|endoftext|>\u00e9", "\u0130x"]
    texts = ["caf\u00e9\u3000\u00e9t\u00e9", "a \u00a0 b", "na\u00efve"]
    for _ in range(10_000):
        texts.append("".join(rng.choice([rng.choice(words), rng.choice(spaces), " ", " " + rng.choice(spaces) + " "]) for _ in range(rng.randrange(8))))
    for slice_ in (texts, texts[:3], texts):  # the last time from what is known
        ids, at = tokens.text_ids(pa.array(slice_), WORD)
        for i, t in enumerate(slice_):
            assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_op4_counts(spark):
    lib = Tokenizer.from_file(WORD)
    got = sorted((r["id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(odd_docs(spark), WORD, limit=50).collect() if r["id"] is not None)
    want = []
    for i, t in [*enumerate(ODD), (100, ""), (3, ODD[3])]:
        n = len(lib.encode(t, add_special_tokens=False).ids)
        want.append((i, len(t.encode()), n, n > 50))
    assert got == sorted(want)
    assert tokens.token_counts(odd_docs(spark).limit(0), WORD).count() == 0
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    counted = {r["doc_id"]: r["n_tokens"] for r in tokens.op4(spark, SMALL).collect()}
    assert counted == {r["doc_id"]: len(lib.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs}


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op3(spark):
    lib = Tokenizer.from_file(WORD)
    rows = packing.op3(spark, SMALL).collect()
    docs = {r["doc_id"]: [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in table(spark, SMALL, "documents").collect()}
    seen = {}
    for r in rows:
        part = docs[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["length"] > 0
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {k: len(v) for k, v in docs.items()}
    total = sum(map(len, docs.values()))
    assert check_packing(rows, 2048) <= -(-total // 2048) + 2


def test_packing_odd_rows(spark):
    out = packing.pack_documents(odd_docs(spark), WORD, capacity=64, with_ids=True).collect()
    check_packing(out, 64)
    assert all(len(r["ids"]) == r["length"] for r in out)
    assert sum(1 for r in out if r["id"] == 3 and r["piece"] == 0) == 2 and sum(1 for r in out if r["id"] == 100) == 1
    assert packing.pack_documents(odd_docs(spark).limit(0), WORD).count() == 0


def test_plan_covers_the_histogram():
    """Every piece has its place; the program places nearly all, in sequences near the least number there can be."""
    rng = np.random.default_rng(0)
    for n, top in ((1, 10), (50, 100), (3_000, 300), (20_000, 2_048), (5_000, 1_501), (400_000, 2_048)):
        lengths = np.where(rng.random(n) < 0.15, top, np.minimum(rng.geometric(3 / top, n), top)) if n > 3_000 else rng.integers(1, top + 1, n)
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        bins, placed = packing.plan(histogram, top)
        used = {}
        for times, pattern, room in bins:
            assert sum(x * k for x, k in pattern.items()) + room == top and room >= 0
            for x, k in pattern.items():
                used[x] = used.get(x, 0) + times * k
        assert used == histogram
        bound = -(-int(lengths.sum()) // top)
        sequences, plain = sum(b[0] for b in bins), sum(b[0] for b in packing.best_fit(histogram, top))
        print("packing:", n, "pieces; bound", bound, "program", sequences, "best-fit alone", plain, "placed by the program", placed / n)
        assert sequences <= 1.01 * max(bound, plain) + 1
        assert n <= 3_000 or placed >= 0.8 * n  # lengths as documents have them
    assert packing.plan({}) == ([], 0)


def test_places_do_not_depend_on_how_tables_are_dealt(spark):
    docs = table(spark, MIDDLE, "documents")
    for some in (docs.coalesce(1), docs.repartition(9)):
        out = packing.pack_documents(some, WORD).collect()
        total = sum(r["length"] for r in out)
        assert check_packing(out, 2048) <= 1.01 * -(-total // 2048) + 1


def test_pieces_are_the_library_s(spark):
    lib, model = SentencePieceProcessor(model_file=PIECE), pieces.piece_model(PIECE)
    ids, at = model.encode(pa.array(ODD))
    for i, text in enumerate(ODD):
        assert ids[at[i] : at[i + 1]].tolist() == lib.encode(text), text
    assert model.decode(ids, at) == [t.replace("\u2581", " ") for t in ODD]
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SMALL, "documents").collect()}
    for r in pieces.op9(spark, SMALL).collect():
        want = lib.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes()) and r["round_trip"]
    odd = pieces.encode_documents(odd_docs(spark), PIECE, with_ids=True).collect()
    assert len(odd) == len(ODD) + 3 and all(r["round_trip"] for r in odd)
    assert pieces.encode_documents(odd_docs(spark).limit(0), PIECE).count() == 0


def test_unigram_model_is_the_library_s(tmp_path):
    spec = proto.ModelProto()
    with open(PIECE, "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1
    rng = random.Random(4)
    for p in spec.pieces:
        if p.type == 1:
            p.score = -8 - 3 * rng.random() - 2.5 * (len(p.piece) == 1)
            if "\u2581\u2581" in p.piece:
                p.type = 5
    path = f"{tmp_path}/unigram.model"
    with open(path, "wb") as f:
        f.write(spec.SerializeToString())
    lib, model = SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    texts = ["the quick brown fox", "internationalization of words", "Hello, world! 123", "caf\u00e9 na\u00efve \u65e5\u672c"]
    ids, at = model.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t), t


def test_models_that_are_not_handled(tmp_path):
    spec = proto.ModelProto()
    with open(PIECE, "rb") as f:
        spec.ParseFromString(f.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    path = f"{tmp_path}/other.model"
    with open(path, "wb") as f:
        f.write(spec.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceModel(path)
