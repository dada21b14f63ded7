import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm import _shared as shared
from strata.llm import token_file as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 32])
def test_pack_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, tf.STRIDE, tf.STRIDE + 5, 3 * tf.STRIDE):
        ids = rng.integers(0, 2**width, n, dtype=np.uint64)
        block = tf.Block(tf.write_block([4, 9], [n, 0], ids, width))
        assert (block.ids() == ids).all()
        for _ in range(5):
            a = random.randint(0, n)
            b = random.randint(a, n)
            assert (block.ids(a, b) == ids[a:b]).all()


def test_width():
    assert tf.width_for(49408) == 16 and tf.width_for(65537) == 17 and tf.width_for(1) == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'!ÀßİΣς<|>startofendx́é1²")), max_size=60))
def test_words_encode_as_whole_texts(text):
    enc = tf.encoder(PATH, "<u4")
    assert enc.direct
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.library.encode(text, add_special_tokens=False).ids


class Counted:
    def __init__(self, inner):
        self.inner, self.asked = inner, []

    def tokenize(self, run):
        self.asked.append(run)
        return self.inner.tokenize(run)

    def encode(self, text, **more):
        self.asked.append(text)
        return self.inner.encode(text, **more)


def test_the_library_is_asked_once_for_each_distinct_run():
    enc = tf.WordEncoder(PATH, "<u4")
    text = "The the, (THE) the. the! 12the21 Élan élan, don't don't"
    want = enc.library.encode(text, add_special_tokens=False).ids
    enc.model, enc.library = Counted(enc.model), Counted(enc.library)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == want
    assert sorted(enc.model.asked) == sorted(["the", ",", "(", ")", ".", "!", "1", "2", "Ã©lan"]) and enc.library.asked == ["don't"]
    enc.encode("Élan (the) 2. DON'T don't")
    assert len(enc.model.asked) == 9 and enc.library.asked == ["don't", "DON'T"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'!aZ0Àß×÷Σ\u0301\x1c\x85\xa0")), max_size=20), st.sampled_from(["<|endoftext|>", "a<|startoftext|>b", "<|endof", "text|>"])), max_size=8), st.integers(1, 12))
def test_rows_encode_as_each_text(texts, piece):
    enc = tf.WordEncoder.__new__(tf.WordEncoder)
    enc.__dict__ |= tf.encoder(PATH, "<u4").__dict__ | {"PIECE": piece}
    rows = pa.array([None, *texts, ""], pa.string())[1:]
    assert [r.tolist() for r in enc.rows(rows)] == [enc.library.encode(t or "", add_special_tokens=False).ids for t in [*texts, ""]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_vocabulary_gives_the_ids_of_the_library(name):
    enc = tf.encoder(public_tokenizers.path(name), "<u4")
    for text in ("Hello,  World\n\n  and so on 12.5%", " x", "Ünï çé", ""):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rows", [[], [(5, "Hi there"), (None, "x"), (2, None), (9, ""), (2, "again <|endoftext|>"), (7, "word " * 30000)]])
def test_file_round_trip(spark, rows):
    docs = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, start int")
    got = [tuple(r) for r in tf.read(tf.write(docs, PATH, block_ids=50)).orderBy("start").collect()]
    lib = Tokenizer.from_file(PATH)
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes()), 16))
        start += len(ids)
    assert got == want


def test_caches_last_as_long_as_their_kernel():
    def first(batches):
        for _ in batches:
            yield shared.cached("words", dict)

    def second(batches):
        for _ in batches:
            yield shared.cached("words", dict)

    one, again, other = (next(shared.lean(k)(iter([0]))) for k in (first, first, second))
    assert one is again and other is not one
