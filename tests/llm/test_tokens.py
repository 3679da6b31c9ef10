import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from skyledger.llm import tokens

ODD = ["", " ", "a\u1680b \u2003c\u2028d\u202fe\u205ff", "\n", "  a", "a  b", "a \n b", "\n\nab c", "don't 's 't", "a\tb", "x\x1cy \x1f!", "\xa0nbsp\xa0 q", "a b  ",
       "é é ΑΣ Σ. ΣΑΣ İi", "<|endoftext|> x", " \x01 \x01a", "日本語 テスト", "🙂🙂 ok​", "Á ́x", "end \n", "12 345,6"]


def texts(n=400):
    rng = random.Random(5)
    parts = ODD + list(" \n\t!?.,ab1é\x85　 ") + ["word", "The", "<|startoftext|>"]
    return ODD + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(n)]


@pytest.mark.parametrize("name,make", [("byte_bpe_50k.json", tokens.ByteBpe), ("word_bpe_49k.json", tokens.WordBpe)])
def test_ids_equal_the_library_on_whole_texts(name, make):
    whole = Tokenizer.from_file(P.path(name))
    whole.encode_special_tokens = True
    encoder, given = make(P.path(name)), texts()
    for _ in range(2):  # learned, then looked up
        got = encoder.encode(given)
        for text, ids in zip(given, got):
            assert list(ids) == whole.encode(text, add_special_tokens=False).ids, repr(text)
    encoder.memo.limit = 10
    assert all(np.array_equal(a, b) for a, b in zip(encoder.encode(given), got))


def test_words_that_differ_in_case_or_signs_share_pieces():
    encoder = tokens.WordBpe(P.path("word_bpe_49k.json"))
    encoder.encode(["Word word, WORD! (word). word Word, wORD"])
    assert set(encoder.memo) == {"word", ",", "!", "(", ").", "!"}


def test_latin_texts_are_cut_as_the_library_cuts_them():
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    encoder, rng = tokens.WordBpe(P.path("word_bpe_49k.json")), random.Random(6)
    parts = [chr(i) for i in range(256)] + ["'s", "'LL", "'re", "don't", "Ünder", "</w>", "<|endoftext|>", "12", "ß", " ", "\n", " "]
    given = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]
    given += ["".join(rng.choices([p for p in parts if p.isprintable()], k=20)) for _ in range(3000)] + [a + c + b for c in parts for a, b in ("aB", "1.", "'s", " '")]
    for text, ids in zip(given, encoder.encode(given)):
        assert list(ids) == whole.encode(text, add_special_tokens=False).ids, repr(text)
