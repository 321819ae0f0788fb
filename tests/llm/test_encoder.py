"""The packing encoder against the tokenizers library's own reading of the file."""

import random

import numpy as np
import public_tokenizers
import pytest

from citeflow.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(PATH)
    return packing.Encoder(PATH), lambda texts: [np.array(x.ids, "<u4").tobytes() for x in fresh.encode_batch(texts, add_special_tokens=False)]


def test_special_strings_and_odd_texts(both):
    encode, want = both
    assert encode.fast is not None
    texts = ["", " ", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "x" * 100_000, " " * 300_000 + "x", " " * 300_000, "\n" * 50_000 + "a b", "1" * 50_000, "é" * 20_000, "a\x00b�\U0001f600"]
    assert encode([*texts, None]) == [*want(texts), b""]


def test_every_code_point(both):
    encode, want = both
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 17 == 0)]
    texts = [f"a{c}b {c} 1{c}1 ?{c}? {c}{c}  {c}" for c in points]
    assert encode(texts) == want(texts)


def test_random_texts(both):
    encode, want = both
    rng, pool = random.Random(5), [*"ab1'?é \n\t 　", "<|endoftext|>", "'ll", "'s", " ", " "]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 14))) for _ in range(5000)]
    assert encode(texts) == want(texts)


def test_other_files_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = packing.Encoder(path)
    assert encode.fast is None
    assert encode(["Some words, and more"]) == [np.array(encode.tokenizer.encode("Some words, and more", add_special_tokens=False).ids, "<u4").tobytes()]
