import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veriloom.llm.rank_bpe import RankBpe, bpe, vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
MINE, THEIRS = RankBpe(vocabulary(PATH)), Tokenizer.from_file(PATH)


def same(text):
    ids = MINE.encode_batch([text])[0]
    ref = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == ref
    assert MINE.decode(ids) == THEIRS.decode(ref, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=("Cn", "Co")), max_size=60))
def test_like_the_library(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ab" * 3000, "<|endoftext|>x<|startoftext|>", "ΑΣ ΣΑΣ", "İI'LL 're", "12３४", "x\x85y\x1cz", "​é"])
def test_odd_texts(text):
    same(text)


def test_random_words():
    random.seed(1)
    for _ in range(50):
        same(" ".join("".join(random.choice("aeiounrst'!1ü") for _ in range(random.randint(1, 70))) for _ in range(40)))


def test_rows(odd, none):
    rows = bpe(odd, PATH, ids=True).collect()
    assert len(rows) == odd.count() and all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    assert bpe(none, PATH).count() == 0
