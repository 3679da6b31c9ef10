import textwrap

import numpy as np
import zstandard

from skyledger.llm import licenses as L
from tests.llm.helpers import clashing, documents, empty, prose


def judged(text):
    known = L.templates()
    return [(text[a:b], *known.judge(text[a:b])) for a, b in known.blocks(text)]


def test_every_template_is_its_own_winner():
    for license, texts in L.TEMPLATES.items():
        for text in texts:
            (block, found, reduction, confirmed, shared, missing, added), = judged(prose(1, 40) + "\n" + text + "\n" + prose(2, 40))
            assert (block, found, confirmed, shared, missing, added) == (text, license, True, 1.0, [], []), text
            assert reduction >= L.LEAST_REDUCTION


def test_changed_words_are_named_and_other_uses_are_not_confirmed():
    (_, license, _, confirmed, _, missing, added), = judged(L.TEMPLATES["MIT"][1].replace("free of charge", "without charge").replace("AUTHORS", "WRITERS"))
    assert (license, confirmed, missing, added) == ("MIT", True, ["free", "of", "authors"], ["without", "writers"])
    for text in ("He lost his driving license in the rain on a cold day.", "The copyright office opens at nine."):
        assert [x[3] for x in judged(text)] == [False]
    assert judged("no such thing\n" * 50) == []


def test_long_runs_are_several_blocks():
    line = L.TEMPLATES["Apache-2.0"][0]
    found = judged("\n".join([line] * 200))
    assert "\n".join(x[0] for x in found).count(line) == 200 and len(found) == 3


def test_rows(spark):
    docs = documents(spark, 5).unionByName(spark.createDataFrame([(77, "Intro.\nReleased under the MIT License.\nEnd", "en", "s", 1), (None, "Licensed under CC BY-NC 4.0.", "en", "s", 1)], documents(spark).schema))
    got = sorted((str(r.doc_id), r.license, r.confirmed, r.start) for r in L.scan(clashing(docs)).collect())
    assert got == [("77", "MIT", True, 7), ("None", "CC-BY-NC-4.0", True, 0)]
    assert L.scan(empty(spark)).count() == 0


def spans(text):
    return [(text[a:b], license, confirmed) for a, b, license, _, confirmed, *_ in L.templates().spans(text)]


def confirmed(text):
    return [x[:2] for x in spans(text) if x[2]]


MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."


def test_every_license_of_a_run_is_confirmed():
    assert spans(MIT + "\n" + APACHE) == [(MIT, "MIT", True), (APACHE, "Apache-2.0", True)]
    assert spans(APACHE + " " + MIT) == [(APACHE, "Apache-2.0", True), (MIT, "MIT", True)]
    assert spans("\n".join([MIT] * 200)) == [(MIT, "MIT", True)] * 200
    assert [x[:2] for x in spans("Copyright 2020 Foo. " + MIT) if x[2]] == [(MIT, "MIT")]
    assert [x[2] for x in spans("Copyright 2020 Foo. " + MIT)] == [False, True]
    whole = L.TEMPLATES["Apache-2.0"][1]
    assert confirmed(MIT + "\n" + whole + "\n" + L.TEMPLATES["MIT"][1]) == [(MIT, "MIT"), (whole, "Apache-2.0"), (L.TEMPLATES["MIT"][1], "MIT")]


def test_a_license_across_the_end_of_a_block():
    text = L.TEMPLATES["MIT"][1].replace(", ", ",\n")
    for before in (70, 75, 79, 80):
        assert confirmed("Copyright notice kept.\n" * before + text) == [(text, "MIT")], before


def test_one_identifying_word_is_another_license():
    gpl3 = L.TEMPLATES["GPL-3.0"][1]
    gpl2 = gpl3.replace("version 3", "version 2").replace("software: you", "software; you")
    assert confirmed(gpl2) == [(gpl2, "GPL-2.0")] and [x[1:4:2] for x in judged(gpl2)] == [("GPL-2.0", True)]
    for name in ("Lesser", "Affero"):
        text = gpl3.replace("GNU General", f"GNU {name} General")
        assert confirmed(text) == [(text, name[0].replace("L", "LGPL").replace("A", "AGPL") + "-3.0")]
    assert confirmed("Released under the ISC License.") == [("Released under the ISC License.", "ISC")]
    bsd4 = L.TEMPLATES["BSD-3-Clause"][1].replace("3. Neither", "3. All advertising materials must display an acknowledgement. 4. Neither")
    for text in ("Released under the Zlib License.", "Licensed under CC BY 3.0.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.",
                 "Licensed under the Apache License, Version 1.1.", "Licensed under the Mozilla License, Version 2.0.", "Released under the BSD 4-Clause License.",
                 gpl3.replace("version 3", "version 1"), bsd4, L.TEMPLATES["MPL-2.0"][0].replace("2.0", "1.1"),
                 "This work is licensed under a Creative Commons Attribution 3.0 International License.",
                 "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."):
        assert confirmed(text) == [], text


def test_other_words_may_differ():
    named = L.TEMPLATES["BSD-3-Clause"][1].replace("the copyright holder", "MIT").replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    for text, license in ((named, "BSD-3-Clause"), (L.TEMPLATES["GPL-3.0"][1].replace("This program is distributed", "Foo is distributed"), "GPL-3.0"),
                          ("Licensed under the Apache License 2.0.", "Apache-2.0")):
        assert confirmed(text) == [(text, license)], text


def test_whole_licenses():
    for license, text in L.TEXTS.items():
        assert confirmed(prose(1, 40) + "\n" + text + "\n" + prose(2, 40)) == [(text, license)], license
    wrapped = "\n".join(textwrap.wrap(L.TEXTS["BSD-3-Clause"].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS"), 70))
    assert confirmed("Copyright (c) 2020 Foo\n" + wrapped) == [(wrapped, "BSD-3-Clause")]
    both = L.TEXTS["ISC"] + "\n\n" + L.TEXTS["Apache-2.0"] + "\n\n" + MIT
    assert [x[1] for x in confirmed(both)] == ["ISC", "Apache-2.0", "MIT"]
    assert confirmed(L.TEXTS["GPL-3.0"].replace("GNU General", "GNU Affero General")) == []


def brute_reductions(block):
    """Of every template, by a compressor made for it alone."""
    plain = " ".join(block.lower().split()).encode()
    params = zstandard.ZstdCompressionParameters.from_level(L.LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)

    def size(text):
        raw = {"dict_data": zstandard.ZstdCompressionDict(" ".join(text.lower().split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if text else {}
        return len(zstandard.ZstdCompressor(compression_params=params, **raw).compress(plain))

    every = [(license, text) for license, texts in L.TEMPLATES.items() for text in texts] + list(L.TEXTS.items())
    return [(license, 1 - size(text) / size("")) for license, text in every]


def test_every_template_compresses_every_block():
    for block in (MIT, APACHE, L.TEMPLATES["GPL-3.0"][1], L.TEXTS["ISC"], "All rights of copyright are reserved by the owner of the house."):
        ranked, want = L.templates().ranked(block), brute_reductions(block)
        got = {k: (license, reduction) for reduction, license, k in ranked}
        assert len(got) == len(want) and [got[k][0] for k in range(len(want))] == [w[0] for w in want]
        assert max(abs(got[k][1] - w[1]) for k, w in enumerate(want)) < 0.05
        assert [r for r, *_ in ranked] == sorted((r for r, *_ in ranked), reverse=True)


def test_the_size_reduction_decides_between_templates():
    """MIT-0 with a small part of MIT's condition: more words agree with MIT-0's, but MIT makes the block smaller."""
    known, decided = L.templates(), 0
    mit = L.TEMPLATES["MIT"][1].split()
    at, behind = mit.index("subject"), mit.index("THE")
    for n in range(1, behind - at):
        text = " ".join(mit[:at + n] + mit[behind:])
        own = L.words(text)
        ids = np.array([known.number.get(w, -1) for w in own])
        score = {}
        for k, (license, *_) in enumerate(known.each):
            if license in ("MIT", "MIT-0"):
                for s, *_ in L.fitted(known.coded[k], ids):
                    score[license] = max(score.get(license, 0), s)
        reduction = {}
        for license, r in brute_reductions(text):
            reduction[license] = max(r, reduction.get(license, 0))
        first = max(("MIT", "MIT-0"), key=reduction.get)
        assert confirmed(text)[0][1] == first, (n, score, reduction)
        decided += score.get("MIT-0", 0) > score.get("MIT", 0) and first == "MIT"
    assert decided
