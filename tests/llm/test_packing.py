import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from bylines.llm.packing import WordEncoder, binary_pieces, pack
from bylines.llm.queries import op5_binary_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def wanted(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def holds(rows, docs):
    """Every id in one piece, lengths powers of two, sequences gapless, one piece each, buckets adjacent."""
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, ids in docs.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.length & (r.length - 1) == 0 and r.length <= 2048 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and {r.offset for r in rows} <= {0}
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)


def test_pieces():
    assert binary_pieces(2048 * 2 + 11, 2048) == [(0, 2048), (2048, 2048), (4096, 8), (4104, 2), (4106, 1)]
    assert binary_pieces(0, 2048) == []


def test_odd_texts(spark, tmp_path):
    texts = ["Hello there", None, "", "   \x1c á é x\r\ny ΟΔΟΣ İ", "it's 123 <|endoftext|>!!", "end <|endoftext|> of a<|startoftext|>b <|endoftext|><|endoftext|>", "w " * 5000, "́ \ńx", "日本語テキスト 🙂🙂", "dup", "DON'T. \"It's\" dogs' 5. a's' x<|ENDOFTEXT|> (a)... É!! Σ! ΟΔΟΣ. a>|. ½! '' 'S. x'S'", "x\x85y​z"]
    rows = list(enumerate(texts))
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_binary_packing(spark, str(tmp_path)).collect()
    holds(got, dict(zip([i for i, _ in rows], wanted(texts), strict=True)))


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    holds(op5_binary_packing(spark, d).collect(), dict(zip([r.doc_id for r in docs], wanted([r.text for r in docs]), strict=True)))


def test_ids_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = pack(df, PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    ids = {tuple(np.frombuffer(r.ids, "<u4")) for r in got}
    assert all(len(i) in (1, 2) for i in ids) and sum(r.length for r in got) == 8
    assert pack(df.limit(0), PATH).count() == 0


def test_every_letter_and_digit_before_a_mark():
    """A mark after a character encodes apart only if the tokenizer still sees a letter or digit there."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]
    t, enc = Tokenizer.from_file(PATH), WordEncoder(PATH)
    for at in range(0, len(chars), 20_000):
        texts = [f"a{c}. {c}!" for c in chars[at : at + 20_000]]
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
        assert [x for x, g, e in zip(texts, got, t.encode_batch(texts, add_special_tokens=False), strict=True) if g != e.ids] == []


def test_plain_words_are_learnt_without_normal_forms():
    """Words of plain letters go to the model as they are, many at once; only the rest passes through the whole tokenizer."""
    words = ["Éelleanment", "schöß", "ÿþ", "anesbleat", "ª", "µm", "x" * 300, "aﬁ", "Ǆ", "İi", "a\u0301b", "a<|b", "don't", "555-1941", "naïve's"]
    text = [" ".join(words + [w.upper() + "," for w in words])]
    enc, whole = WordEncoder(PATH), []
    enc.learn, learn = lambda w: (whole.extend(w), learn(w)), enc.learn
    assert enc.as_is and np.frombuffer(enc.encode(text)[0], "<u4").tolist() == wanted(text)[0][:-1]
    assert not {"éelleanment", "schöß", "ÿþ", "anesbleat", "x" * 300} & set(whole) and {"µm", "don't", "naïve's"} <= set(whole)


def test_columns_of_texts():
    """Slices of a column, whose ids lie one after another with an end to each text."""
    import pyarrow as pa

    texts = ["left out", "a\tb\r\nc", "", "  Á é. ", "a", "b"]
    at, data = WordEncoder(PATH).encode_column(pa.array(texts).slice(1, 4), b"\1\0\0\0")
    assert [np.frombuffer(data[a:b], "<u4").tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == wanted(texts[1:5])


def test_shares_of_texts():
    import pyarrow as pa

    from bylines.llm.packing import shares

    texts = pa.array(["", "abc", "d" * 9, "e", "f", "g", ""])
    assert list(shares(texts, 3, 5)) == [(0, 2), (2, 1), (3, 3), (6, 1)] and list(shares(texts.slice(1), 9, 99)) == [(0, 6)] and list(shares(texts[:0], 3, 5)) == []
