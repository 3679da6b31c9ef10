import math
import re

import numpy as np

from skyledger.llm import language as L
from tests.llm.helpers import clashing, documents, empty

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string"


def test_held_out_accuracy(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    label = {r.doc_id: r.lang for r in docs.collect()}
    hidden = docs.selectExpr("doc_id", "text", "if(doc_id % 3 = 1, null, lang) lang", "source")
    got = L.identify(hidden, pages).collect()
    held = [r for r in got if r.kind == "document" and r.doc_id % 3 == 1]
    assert np.mean([r.lang == label[r.doc_id] for r in held]) > 0.97
    declared = {r.page_id: r.html.split('lang="')[1][:2] for r in pages.collect()}
    assert np.mean([r.lang == declared[r.page_id] for r in got if r.kind == "page"]) > 0.97
    assert len(got) == docs.count() + pages.count()


def test_other_evidence_decides_where_text_does_not(spark):
    docs = spark.createDataFrame([(i, ("der die das und nicht ein " if i % 2 else "the of and that was with ") * 9, "de" if i % 2 else "en", "s", 1) for i in range(40)], documents(spark).schema)
    long = "<html lang='de'><body>" + "der die das und nicht ein " * 9 + "</body></html>"
    pages = spark.createDataFrame(
        [(i, f"http://a.beispiel.de/{i}", long) for i in range(20)] + [(100, "http://b.beispiel.de/x", "<p>ok</p>"), (101, "http://x.example.com", "<html lang='de'>ok"),
         (102, None, None), (103, "http://a.beispiel.de/", ""), (104, "http://sample.en/", "<script>der die das</script>" + "the of and that was " * 30)], PAGES)
    got = {r.page_id: r for r in L.identify(docs, pages).collect() if r.kind == "page"}
    assert [got[i].lang for i in (100, 101, 103)] == ["de"] * 3 and got[104].lang == "en"
    assert got[103].text_lang is None and got[102].lang is not None


def test_awkward_rows(spark):
    docs = documents(spark, 10)
    none = spark.createDataFrame([], PAGES)
    assert L.identify(clashing(docs), none).count() == docs.count()
    assert L.identify(empty(spark), none).count() == 0
    assert L.identify(docs.withColumn("lang", docs.lang.substr(9, 1)), none).count() == docs.count()


def test_labels_beyond_the_named_ones_are_one_class(spark):
    """No row of a rare language is taken for a frequent one."""
    words = {"aa": "der die das und nicht ein ", "bb": "the of and that was with ", "cc": "les des est une pour dans ", "dd": "och det att som inte var "}
    often = {"aa": 30, "bb": 30, "cc": 4, "dd": 3}
    rows = [(1000 * k + i, w * 9, lang, f"s{lang}", 1) for k, (lang, w) in enumerate(words.items()) for i in range(often[lang])]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    none = spark.createDataFrame([], PAGES)
    label = {r[0]: r[2] if r[2] in ("aa", "bb") else L.OTHER for r in rows}
    assert {r.doc_id: r.lang for r in L.identify(docs, none, 2).collect()} == label
    assert {r.doc_id: r.lang for r in L.identify(docs, none).collect()} == {r[0]: r[2] for r in rows}


def brute(docs, pages):
    """Posteriors by plain loops: ``{(kind, id): (lang, probability, text_lang)}``, ids unique."""
    def grams(text):
        b = text.lower().encode()
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2 ** 32) >> 16 for i in range(len(b) - 2)]

    langs = sorted({lang for _, _, lang, _ in docs if lang is not None})
    counts = {lang: {} for lang in langs}
    for _, text, lang, _ in docs:
        for g in grams(text or "") if lang is not None else ():
            counts[lang][g] = counts[lang].get(g, 0) + 1
    totals = {lang: sum(c.values()) + 0.5 * L.BUCKETS for lang, c in counts.items()}

    def normal(x):
        return [v / sum(x) for v in x]

    def softmax(x):
        return normal([math.exp(v - max(x)) for v in x])

    rows = []
    for doc_id, text, _, source in docs:
        host = None if source is None else "source:" + source
        rows.append((("document", doc_id), text or "", host, host, None, None))
    for page_id, url, html in pages:
        host = re.match(r"[a-z]+://([^/:?#]+)", url or "")
        host = host[1].lower() if host else None
        declared = re.search(r"<html\b[^<>]*lang='([a-z]+)'", html or "")
        rows.append((("page", page_id), re.sub(r"<[^<>]*>", " ", html or ""), host, host and ".".join(host.split(".")[-2:]),
                     declared and declared[1], host and host.split(".")[-1]))
    loglik = [[sum(math.log((counts[x].get(g, 0) + 0.5) / totals[x]) for g in grams(r[1])) / 3 for x in langs] for r in rows]
    own = [softmax(x) for x in loglik]

    def sums(at, only=None):
        out = {}
        for r, o in zip(rows, own):
            if r[at] is not None and (only is None or r[0][0] == only):
                out[r[at]] = [a + b for a, b in zip(out.get(r[at], [0.0] * len(langs)), o)]
        return out

    hosts, domains, declared, suffixes = sums(2), sums(3), sums(4, "page"), sums(5, "page")
    overall = normal([1 + sum(o[i] for o in own) for i in range(len(langs))])
    of_pages = [sum(o[i] for r, o in zip(rows, own) if r[0][0] == "page") for i in range(len(langs))]
    out = {}
    for r, ll, o in zip(rows, loglik, own):
        prior = overall
        for of, at in ((domains, 3), (hosts, 2)):
            prior = normal([max(c - x, 0.0) + L.SMOOTHING * p for c, x, p in zip(of.get(r[at], o), o, prior)])
        logits = [x + math.log(p + 1e-9) for x, p in zip(ll, prior)]
        for of, at in ((declared, 4), (suffixes, 5)):
            if r[at] is not None:
                logits = [x + math.log((c + 0.5) / (t + 10)) for x, c, t in zip(logits, of[r[at]], of_pages)]
        post = softmax(logits)
        out[r[0]] = langs[post.index(max(post))], max(post), langs[o.index(max(o))] if any(ll) else None
    return out


def test_posteriors_equal_brute_force(spark):
    mixed = ["der die das und ", "the of and that ", "les des est une "]
    docs = [(i, (mixed[i % 3] + mixed[(i // 3) % 3][:6]) * (1 + i % 4), [None, "de", "en", "fr"][0 if i % 5 == 4 else 1 + i % 3], None if i % 7 == 3 else f"s{i % 4}") for i in range(40)]
    docs += [(90, None, "de", "s1"), (91, "", None, None), (92, "xy", "en", "s2")]
    pages = [(i, f"http://{'abc'[i % 3]}.site{i % 2}.{['de', 'com'][i % 2]}/x", f"<html lang='{['de', 'en', 'fr'][i % 3]}'><p>{mixed[i % 3][:9]}</p>") for i in range(20)]
    pages += [(90, None, None), (91, "http://a.site0.de/", ""), (92, "http://solo/", "<p>the</p>")]
    want = brute(docs, pages)
    got = L.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(pages, PAGES)).collect()
    assert len(got) == len(want) == 66
    for r in got:
        lang, probability, text_lang = want[r.kind, r.doc_id if r.kind == "document" else r.page_id]
        assert abs(r.probability - probability) < 1e-4 and r.kept == (r.probability >= L.LEAST_PROBABILITY)
        assert r.lang == lang and (r.text_lang == text_lang or probability < 0.5)
