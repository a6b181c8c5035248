"""Ids laid out by words against the tokenizers library on whole texts."""

import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from decantry.llm.token_file import WordEncoder


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


def _same(encoder, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()), 1)
    for t, lo, hi in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[lo:hi].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1], t


def test_every_cased_letter_before_a_full_stop_or_comma(encoder):
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    letters += [c for c in map(chr, range(0x250, 0x1F000)) if unicodedata.category(c) in ("Lu", "Lt") or c.lower() != c or c.upper() != c]
    _same(encoder, [f"{c}{e}" for c in letters for e in (".", ",")] + [f"A{c}, b{c}." for c in letters])
    _same(encoder, ["İ.", "İ.İ", "don't.", "it's, a", "A1.", "é.", " ́a", "<|endoftext|>.", "a<|startoftext|>b,", "..", ",", "a.."])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85 　.,'aAİſKéß1½日🙂́"), st.characters(codec="utf-8")), max_size=25),
                max_size=6))
def test_any_texts(encoder, texts):
    encoder.known.clear()
    _same(encoder, texts)


def test_cache_is_bounded_and_long_words_pass(encoder, monkeypatch):
    import decantry.llm.token_file as T
    monkeypatch.setattr(T, "CACHE_BYTES", 1000)
    for k in range(5):
        _same(encoder, [f"w{k}x{i}" for i in range(50)] + ["q" * 20_000])
        assert len(encoder.known) <= 60
    assert len(encoder.encode(pa.array([], pa.string()), 1)[0]) == 0
