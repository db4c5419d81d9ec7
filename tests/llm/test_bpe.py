import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from bylines.llm import bpe
from bylines.llm.bpe import decode, encode, opened_numbers, shut_numbers
from bylines.llm.queries import op6_byte_bpe

OWN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
SCHEMA = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("shard", pa.int32()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary()), ("docs", pa.list_(pa.int64()))])


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(OWN[0], "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_numbers_round_trip():
    for x in ([], [0], [1, 2**32 - 1, 300, 70_000]):
        assert opened_numbers(shut_numbers(np.array(x, np.int64))).tolist() == x


def test_odd_texts(spark, library):
    texts = [None, "", "  \n\n x  \t", "it's  we'll 12345 é日本 🙂🙂", "<|endoftext|>", "a" * 30_000, "word " * 20_000, "\x1c\x85 \x00z", "it's  we'll 12345 é日本 🙂🙂"]
    df = spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, block int")
    want = sorted((tuple(library.encode_ordinary(t or "")), (t or "").encode()) for t in texts)
    for limits in ({}, {"block_tokens": 10, "shard_bytes": 1000}, {"block_words": 3, "shard_bytes": 1}):
        got = decode(encode(df, *OWN, **limits), OWN[0]).collect()
        assert sorted((tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert encode(df.limit(0), *OWN).count() == 0


def test_long_text_is_listed_in_stretches(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "STRETCH", 7)
    text = "Some words, é 12 and more   of them\n\n " * 20
    block, *words = bpe.exploded(iter([pa.record_batch({"id": [5], "t": [text]})]), P.PATTERN, 3, 10, 10, SCHEMA)
    back = bpe.encoded_words(iter([b.slice(i, 1) for b in (block, *words) for i in range(b.num_rows)]), *OWN)
    assert bpe.laid_out(pa.Table.from_batches(list(back)), "doc_id").to_pylist() == [{"doc_id": 5, "ids": library.encode_ordinary(text)}]


def test_decode_keeps_rows_and_tells_nulls(spark, library):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # rows of one document then come in several batches
    try:
        ids = [library.encode_ordinary(t) for t in ("many small words in one text here", "", "x")]
        rows = [(1, ids[0], "a"), (2, None, "b"), (2, None, "b"), (3, ids[1], None), (None, ids[2], "c")]
        df = spark.createDataFrame(rows, "row int, ids array<int>, token string").coalesce(1)
        got = [(r.row, r.ids, r.token, r.decoded and bytes(r.decoded)) for r in decode(df, OWN[0]).collect()]
        assert got == [(1, ids[0], "a", b"many small words in one text here"), (2, None, "b", None), (2, None, "b", None), (3, [], None, b""), (None, ids[2], "c", b"x")]
        assert decode(df.limit(0), OWN[0]).count() == 0
        with pytest.raises(Exception, match="token-byte table"):
            decode(spark.createDataFrame([([1, 99_999_999],)], "ids array<int>"), OWN[0]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_whole_table(spark, library):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op6_byte_bpe(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
