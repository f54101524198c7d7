import sys

import numpy as np
import pytest
import tiktoken
import tokenizers

from notewell.llm import bpe, packing
from notewell.llm.arrays import Memo, encode_block
from notewell.llm.queries import TOKENIZERS

CHARACTERS = [chr(p) for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
TEXTS = ["".join(f"a{c}b1{c}2 {c}'s{c} \n{c}" for c in CHARACTERS[i : i + 4096]) for i in range(0, len(CHARACTERS), 4096)]


@pytest.fixture(scope="module")
def some():
    """Every block with letters, and each tenth of the others."""
    return [t for i, t in enumerate(TEXTS) if i < 50 or i % 10 == 0]


def split(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_ids_equal_tiktoken(some):
    path = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    ranks = bpe.read_ranks(path)
    pattern = packing.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    memo, decoder = bpe._machines(path)
    for text in some:
        ids, bounds = encode_block([text], memo)
        assert split(ids, bounds) == [library.encode_ordinary(text)]
        assert decoder.feed(ids) == text.encode() and decoder.finish()


def test_ids_equal_tokenizers(some):
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    library = tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = [*some, "a <|endoftext|> b", "<|endoftext|>", ""]
    found = split(*encode_block(texts, packing._memo(path)))
    assert found == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_full_memo_starts_anew():
    memo = Memo(lambda word: [len(word)], entries=4)
    for k in range(20):
        texts = [f"w{k} x{k} y{k} z{k} {'v' * k}"]
        ids, _ = encode_block(texts, memo)
        assert ids.sum() == len(texts[0]) and ids.dtype == np.uint32
