"""Token files and byte-level BPE against the libraries, and exact round trips."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairlight.llm import bpe, queries, rans

RANKS, FILE, WHERE = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
SF = "/root/testdata/sf0.001"


def odd_texts():
    rnd = random.Random(3)
    made = ["", " ", "a", "  a  b", "a \n b\n\n c  ", "x\0y z", "\x1c \x1f a", "don't  we'll 's", "日本語 テスト　x", "a" * 700 + " b" * 5, "\n \n\n  x", "é" * 300,
            " <|endoftext|> x", "a.\nB,c. d..e", "1.2,3 ½. x²."]
    return made + ["".join(rnd.choice("ab \n\t'sé1.,  ") for _ in range(rnd.randint(0, 200))) for _ in range(200)]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library():
    own, lib = bpe.load(*WHERE), library()
    texts = odd_texts()
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == lib.encode_ordinary(text)
        assert bpe.vocabulary(RANKS).decode(ids.astype(np.int64)) == text.encode()


def test_bpe_of_very_long_words():
    rnd, own, lib = random.Random(1), bpe.load(*WHERE), library()
    for n in (500, 513, 5000, 60_000):
        text = "".join(rnd.choice("abcdefgh") for _ in range(n))
        assert next(own.encode([text])).tolist() == lib.encode_ordinary(text)


def test_bpe_forgets_and_stays_right():
    own, lib = bpe.Bpe(library()._mergeable_ranks, P.PATTERN, piece_limit=5), library()
    own.chunks.known.limit, own.chunks.group_chars = 3, 20
    texts = odd_texts() * 2
    assert [x.tolist() for x in own.encode(texts)] == [lib.encode_ordinary(t) for t in texts]


def test_bpe_tables(spark):
    rows = [(1, "a b", "kept"), (1, "a b", "kept"), (2, None, None), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a clashing column
    made = bpe.decode(bpe.encode(docs, *WHERE), RANKS).orderBy("doc_id").collect()
    assert [(r.doc_id, len(r.ids), bytes(r.decoded)) for r in made] == [(1, 2, b"a b"), (1, 2, b"a b"), (2, 0, b""), (3, 0, b"")]
    assert bpe.decode(bpe.encode(docs.limit(0), *WHERE), RANKS).count() == 0
    assert bpe.round_trip(docs, *WHERE).orderBy("doc_id").collect() == made and bpe.round_trip(docs.limit(0), *WHERE).count() == 0


def test_op6_query(spark):
    lib, texts = library(), dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    import hashlib
    for r in queries.op6_byte_bpe(spark, SF).collect():
        ids = lib.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_chunked_library_equals_whole_texts():
    lib = Tokenizer.from_file(FILE)
    lib.encode_special_tokens = True
    texts = odd_texts()
    for text, ids in zip(texts, rans._encoder(FILE).texts(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 1000, 32768, 70001])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.geometric(0.01, n), np.full(n, 7), rng.integers(0, 50_000, n)):
        seg = rans.encode_blocks(ids.astype(np.uint32)) | {"n_tokens": n}
        assert (rans.decode_blocks(seg) == ids).all()


def test_rans_blocks_stand_alone_and_are_checked():
    ids = np.random.default_rng(0).geometric(0.01, 100_000).astype(np.uint32)
    seg = rans.encode_blocks(ids) | {"n_tokens": len(ids)}
    assert (rans.decode_blocks(seg, 1, 2) == ids[32768:65536]).all() and (rans.decode_blocks(seg, 3) == ids[98304:]).all()
    bits = ids.size * -np.sum(np.bincount(ids) / ids.size * np.log2(np.maximum(np.bincount(ids), 1) / ids.size))
    assert 8 * len(seg["words"]) < 1.03 * bits + 64 * 32 * 4
    damaged = bytearray(seg["words"])
    damaged[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode_blocks(seg | {"words": bytes(damaged)})


def test_frequencies_sum():
    for counts in ([1], [1, 10**9], [1] * 1000, [10**6] + [1] * 4000):
        f = rans.frequencies(np.array(counts), 14)
        assert f.sum() == 1 << 14 and (f > 0).all()


def test_token_file(spark):
    rows = [(5, "b c", "x"), (2, "a", "y"), (9, None, "z"), (2, "a", "y"), (None, "n n", "q"), (7, "", "w"), (8, "long " * 5000, "v"), (11, "a <|endoftext|> b<|endoftext|>", "u"), (12, "<|endoftext|", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = rans.new_file(spark)
    rans.write_tokens(docs, path, FILE, end_id=2, segment_tokens=50)
    lib = Tokenizer.from_file(FILE)
    made = sorted(rans.read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, text, _) in zip(made, want, strict=True):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(bytes(r.ids), dtype="<u4").tolist()) == (i, start, len(ids), ids)
        start += len(ids)
    empty = rans.new_file(spark)
    rans.write_tokens(docs.limit(0), empty, FILE, end_id=2)
    assert rans.read_tokens(spark, empty).count() == 0


def test_op1_query(spark):
    lib, start = Tokenizer.from_file(FILE), 0
    made = {r.doc_id: r for r in queries.op1_token_files(spark, SF).collect()}
    for doc_id, text in sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()):
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        r = made.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not made
