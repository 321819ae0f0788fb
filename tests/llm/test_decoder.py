"""Decoding by the table of pieces against the backend's own decoder."""

import random

import numpy as np
import public_tokenizers

from citeflow.llm import sentencepiece


def test_decoder_matches_the_backend():
    path = public_tokenizers.path("piece_bpe_32k.model")
    tokenizer, decode = sentencepiece.load(path), sentencepiece.decoder(path)
    assert decode.plain
    rng = random.Random(7)
    cases = [[rng.randrange(32_000) for _ in range(rng.randrange(0, 30))] for _ in range(3000)] + [[rng.randrange(300) for _ in range(10)] for _ in range(500)]
    cases += [tokenizer.encode(t, add_special_tokens=False).ids for t in ("", " ", "  a", "▁ ▁", "a\nb é \U0001f600 <0x41> <unk>", "x" * 5000)]
    for ids in cases:
        assert decode(np.array(ids, "<u4")) == tokenizer.decode(ids, skip_special_tokens=False), ids


def test_normal_texts_match_the_backend():
    path = public_tokenizers.path("piece_bpe_32k.model")
    decode, slow = sentencepiece.decoder(path), sentencepiece.Decoder(sentencepiece.load(path))
    slow.marks_only = False
    assert decode.marks_only
    rng = random.Random(9)
    for text in ["", " ", "  a", "▁", "▁ ▁a", "a\tb\n c ", *("".join(rng.choices(" ▁ab\né", k=rng.randrange(12))) for _ in range(2000))]:
        assert decode.normal(text) == slow.normal(text), text
