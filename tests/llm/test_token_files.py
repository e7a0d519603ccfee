import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabweave.llm import token_files as tf
from tabweave.llm.queries import tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_ids_equal_the_library():
    tokenizer, encode = Tokenizer.from_file(tokenizer_path()), tf.Encoder(tokenizer_path(), 1)
    rng = random.Random(3)
    letters = "abcXYZ'’.,-_ \t\n\r\x1c\x85\xa0éÉüßİıǅ²½ªµ×÷ſ0123́‍😀中<|>endoftext"
    cases = ["<|endoftext|> a", "it's we'll DON'T 'S", "''s", "a's's", "\x00b", "İstanbul", ""]
    cases += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text in cases:
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert np.frombuffer(encode(text), encode.kind).tolist() == want, text


def test_memory_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 5)
    monkeypatch.setattr(tf, "_memories", {})
    encode, tokenizer = tf.Encoder(tokenizer_path(), 1), Tokenizer.from_file(tokenizer_path())
    for k in range(60):
        text = f"word{k} again{k % 7} word{k - 1}, the end."
        assert np.frombuffer(encode(text), encode.kind).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_round_trip(spark, docs, none):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for vocabulary in (tokenizer_path(), public_tokenizers.path("byte_bpe_50k.json")):
        tokenizer = Tokenizer.from_file(vocabulary)
        files = tf.write_token_files(docs, vocabulary, file_bytes=100_000)
        got = tf.token_digests(spark, files).orderBy("start").collect()
        assert len(got) == docs.count()
        assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
        texts, start = {r.doc_id: r.text for r in docs.collect()}, 0
        for r in got:
            ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
        one = tf.TokenReader(got[3].file, tf.read_dictionary(files))
        assert one.ids(got[3].place).tolist()[-1] == 1
        with pytest.raises(ValueError):
            tf.TokenReader(got[3].file, b"another dictionary")
    assert tf.token_digests(spark, tf.write_token_files(none, tokenizer_path())).count() == 0


def test_dictionary_helps_short_documents(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in ("ata", "ere", "ini") for c in ("ster", "ling", "mont")]
    rows = [(k, " ".join(rng.choice(words) for _ in range(25))) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def size():
        return tf.write_token_files(df, tokenizer_path()).manifest.agg({"bytes": "sum"}).first()[0]

    shared = size()
    monkeypatch.setattr(tf, "train_dictionary", lambda *_: b"")
    assert shared < 0.95 * size()
