import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import bpe

V = bpe.vocabulary(*bpe.public_paths())
T = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def by_tree(text, piece):
    segments = {}
    for k, special, part in bpe.cut_text(V, text, piece):
        segments.setdefault(k, []).append((part, np.array([V.special[part]]) if special else V.encode_plain(part), special))
    return [int(i) for s in segments.values() for i in (s[0][1] if s[0][2] else bpe.encode_tree(V, [(t, ids) for t, ids, _ in s]))]


ALPHABETS = ["ab", "a ", "'rels ", "  \n\ta", "aé漢🙂 1", "!?#a1 '"]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(ALPHABETS).flatmap(lambda a: st.text(a, max_size=60)), st.integers(1, 9))
def test_tree_equals_library(text, piece):
    assert by_tree(text, piece) == T.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 1500, "the" * 900 + " " * 500 + "x", "é" * 1000, "aab" * 700, "=" * 999 + "'re" * 50, "x<|endoftext|>  <|endoftext|>y" * 20, "abcdefghij" * 300])
@pytest.mark.parametrize("piece", [7, 64, 500])
def test_long_unsplit(text, piece):
    assert by_tree(text, piece) == T.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    texts = [None, "", "a", "<|endoftext|>x ", "word " * 400, "z" * 900, "z" * 900, "né 漢字 🙂\n" * 90]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "b", "x")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_documents(df, bpe.public_paths(), long_chars=300, piece_chars=64, with_ids=True).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        ids = T.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(T.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), bpe.public_paths()).count() == 0
