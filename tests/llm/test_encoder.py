"""The word encoder against the tokenizer itself."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyfield.llm import encoder, packing

PATH = packing.default_tokenizer()
SIGNS = list("aZéÉßÿ×÷0179 \t\n.,!?'-_()[]<>|#$%&*\"\\^~`\x1c\x1f\x7f") + ["'s", "'T", "'re", "don't", "e\u0301", "<\u0338", "\u0301", "日本", "İ", "Σς", "—", "“", "\u00a0", "\u3000", "\u0085", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "ﬁ", "٣", "½", "1\u20e3", "👍🏽"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def agrees(tokenizer, texts):
    ids, own = encoder.WordEncoder(PATH).ids_of([t.encode() for t in texts])
    ends = np.cumsum(own)
    for t, a, b in zip(texts, ends - own, ends, strict=True):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:200]


@pytest.mark.parametrize("block", [7, 64, 4 << 20])
def test_awkward_strings(tokenizer, monkeypatch, block):
    monkeypatch.setattr(encoder, "BLOCK_BYTES", block)
    r = random.Random(block)
    agrees(tokenizer, ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 30))) for _ in range(3000)])


def test_whole_documents(spark, small, tokenizer):
    agrees(tokenizer, [r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()])


def test_a_memory_that_forgets_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(encoder, "REMEMBERED_BYTES", 10 * encoder.ENTRY_BYTES)
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 9) + r.choice(["", ",", "7", "'s"]) for _ in range(50)) for _ in range(40)]
    one, ids = encoder.WordEncoder(PATH), []
    for t in texts:
        ids.append(one.ids_of([t.encode()])[0].tolist())
        assert len(one.remembered) <= 10 + 4 * 50 and one.held == encoder._cost(one.remembered)
    assert ids == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("distinct", [200_000, 1_000_000])
def test_texts_of_very_many_words(tokenizer, distinct):
    r = random.Random(distinct)
    words = sorted({"".join(r.choices("abcdefghijklmnop", k=8)) for _ in range(distinct)})
    agrees(tokenizer, [" ".join(words)])


def test_one_word_longer_than_a_block(tokenizer, monkeypatch):
    monkeypatch.setattr(encoder, "BLOCK_BYTES", 1000)
    agrees(tokenizer, ["x" * 5000, "a " + "yz7" * 3000 + " b", " " * 5000, ("word " * 900).strip()])


def test_another_tokenizer_encodes_texts_whole(tmp_path, tokenizer):
    import json

    other = json.loads(tokenizer.to_str())
    other["normalizer"] = None
    path = str(tmp_path / "other.json")
    with open(path, "w") as file:
        json.dump(other, file)
    one = encoder.WordEncoder(path)
    texts = ["Some Words, 12!", "", "Ünder"]
    ids, own = one.ids_of([t.encode() for t in texts])
    assert not one.by_parts and ids.tolist() == [i for t in texts for i in Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids] and own[1] == 0
