import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from skyledger.llm import prefix_bpe as B
from tests.llm.helpers import clashing, documents, empty
from tests.llm.test_tokens import ODD, texts

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return B.Ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def test_ids_equal_the_library(library):
    encoder = B.PrefixBpe(PATH)
    given = texts() + ["aaaaaaaaaaaaaaaaaaaaaaaabbbb" * 40, "antidisestablishmentarianism" * 3, "Größenwahn führte 中文字符 ñandú"]
    given += ["".join(map(chr, range(a, a + 256))) for a in range(0, 0xD800, 256)]
    for text, ids in zip(given, encoder.encode(given)):
        assert ids.tolist() == library.encode_ordinary(text), repr(text[:40])
        assert encoder.decode(ids.tolist()) == text.encode()


def test_appends_and_edits_are_exact(ranks, library):
    rng = random.Random(2)
    parts = ODD + list("abcdefg 'stre\n")
    for _ in range(60):
        t = B.EditableText(ranks, "".join(rng.choices(parts, k=6)))
        for _ in range(6):
            if rng.random() < 0.5:
                t.append(rng.choice(parts))
            else:
                a = rng.randint(0, len(t.text))
                t.edit(a, min(len(t.text), a + rng.randint(0, 3)), rng.choice(parts))
            assert t.ids() == library.encode_ordinary(t.text), repr(t.text)
    t = B.EditableText(ranks, "word " * 500)
    before = t.encoded
    t.edit(1200, 1203, "xyz")
    assert t.encoded - before < 10 and t.ids() == library.encode_ordinary(t.text)


def test_table_keeps_its_prefixes(ranks):
    table = B.PrefixTable(ranks, b"unbelievable")
    kept = list(table.last)
    table.append(b"ness")
    assert table.last[:len(kept)] == kept and table.ids() == ranks.merged(b"unbelievableness")
    table.replace(2, 4, b"BE")
    assert table.ids() == ranks.merged(b"unBElievableness")


def test_rows(spark, library):
    docs = documents(spark, 20)
    want = sorted((str(r.doc_id), library.encode_ordinary(r.text or "")) for r in docs.collect())
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, np.uint16).tolist()) for r in B.encode_decode(clashing(docs)).collect())
    assert got == want
    assert B.encode_decode(empty(spark)).count() == 0
