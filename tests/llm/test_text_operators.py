"""Personal data, licences, languages and urls against plain versions of their rules."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("loomframe.llm")

from loomframe.llm import language_id, license_scan, pii, url_filter  # noqa: E402

SF = "/root/testdata/sf0.001"


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def base_by_regex(text):
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub(r"\D", "", m, flags=re.A)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m, flags=re.A)) <= 15),
    }
    found = [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found, key=lambda s: (s[1], list(rules).index(s[0])))


PARTS = ["a", "b.c", "@", ".", "x-y", " ", "1", "22", "256", "+", "(", ")", "-", "4111 1111 1111 1111", "4532015112830366", "10.0.0.1", "é", "½", "٣", "+1 (988) 555-2485", "\n", "me@mail.example.com"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_are_those_of_the_rules(text):
    assert pii.base_spans(text) == base_by_regex(text)


def test_base_spans_stay_linear_in_long_runs():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "." * 10 + "+" * 1000) == []


@pytest.mark.parametrize(
    ("text", "kind", "piece"),
    [
        ("write to jane [at] mail [dot] example [dot] com today", "email", "jane [at] mail [dot] example [dot] com"),
        ("write jane at mail dot example dot com today", "email", "jane at mail dot example dot com"),
        ("jаne＠mail.example.com", "email", "jаne＠mail.example.com"),
        ("host １０.０.０.７ is up", "ip", "１０.０.０.７"),
        ("pay 4111​1111​1111​1111 now", "card", "4111​1111​1111​1111"),
        ("call +one nine eight eight five five five two four eight five", "phone", "+one nine eight eight five five five two four eight five"),
    ],
)
def test_disguises_are_found_at_their_place(text, kind, piece):
    base, spans = pii.find(text)
    at = text.index(piece)
    assert (kind, at, at + len(piece)) in spans
    assert set(base) <= set(spans)


@pytest.mark.parametrize("text", ["we met at the dot of noon", "look at this. Then go", "one two three", "état à Paris", "", "half ½ and 3²"])
def test_clean_texts_stay_clean(text):
    assert pii.find(text) == ([], [])


def test_many_base_spans_beside_a_disguise_stay_linear():
    import time

    began = time.perf_counter()
    base, spans = pii.find("ab@cd.ef " * 60_000 + "jаne＠mail.example.com")
    assert len(base) == 60_000 and len(spans) == 60_001 and time.perf_counter() - began < 20


def test_masking():
    assert pii.masked("to a.b@c.de, 10.0.0.1.") == "to <email>, <ip>."


def test_pii_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "a@b.cd", "z"), (2, "a@b.cd", "z"), (None, "x" * 100_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii.scan(docs).collect()), key=str)
    none = hashlib.sha256(b"").hexdigest()
    one = (2, 1, 0, 0, 0, hashlib.sha256(b"email:0:6").hexdigest(), "email:0:6", 0)
    assert got == sorted([(1, 0, 0, 0, 0, none, "", 0), (2, 0, 0, 0, 0, none, "", 0), one, one, (None, 0, 0, 0, 0, none, "", 0)], key=str)
    assert pii.scan(docs.limit(0)).collect() == []
    masked = {(r.doc_id, r.text) for r in pii.mask(docs).collect()}
    assert (1, None) in masked and (2, "<email>") in masked


def license_by_regex(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


WORDS = ["cc", "by", "CC-BY", "general", "public", "license", "GNU General Public License", "all rights reserved", "All Rights", "reserved.", "été", "x1", ",", "\n", "_", "İ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=12).map(" ".join))
def test_licence_places(text):
    assert license_scan.Index().scan(text)[:5] == license_by_regex(text)


def test_licence_templates():
    index = license_scan.Index()
    mit = "Foo. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, ..."
    assert index.scan(mit)[5] == "mit"
    work = index.scan("x " * 5000 + "This work is licensed under the GNU General Public License, version 3.")
    assert work[4] == "gpl" and work[5] == "gpl,gpl-notice" and work[6] == 1.0
    assert index.scan("the software is subject to a license")[5] == ""


PROSE = "It can be that a file has some form and is an exception, or that it comes into some code. In part we are free to use any of these for the work and to do with them what we like, but no more. "


@pytest.mark.parametrize("template", license_scan.TEMPLATES, ids=lambda t: t[1][:30])
def test_licence_notice_inside_prose(template):
    label, text, _ = template
    found = license_scan.Index().scan(PROSE * 5 + text + ". " + PROSE * 5)
    assert label in found[5].split(",") and found[6] == 1.0


def test_licence_file_of_all_templates():
    found = license_scan.Index().scan(PROSE + f"\n{PROSE}\n".join(text for _, text, _ in license_scan.TEMPLATES))
    assert {label for label, _, _ in license_scan.TEMPLATES} <= set(found[5].split(","))


def test_licence_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, "all rights reserved"), (None, "")], "doc_id long, text string").selectExpr("*", "1 as labels")
    got = sorted(map(tuple, license_scan.scan(docs).collect()), key=str)
    assert got == sorted([(1, 0, 0, None, None, "", "", 0.0)] * 2 + [(2, 3, 1, 0, 0, "reserved", "reserved", 1.0), (None, 0, 0, None, None, "", "", 0.0)], key=str)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    out = found.filter(language_id.held_out(found["doc_id"]))
    n, right = out.count(), out.filter("lang = lang_pred").count()
    assert n > 150 and right / n > 0.98
    assert found.filter("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog", "en", 1) for i in range(20)] + [(i, "le chat et le chien", "fr", 1) for i in range(20, 30)], "doc_id long, text string, lang string, score int")
    model = language_id.fit(docs)
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "le chien " * 20_000), (5, "日本"), (5, "日本"), (None, "the cats"), (6, "²"), (7, "½ 12 ①")], "doc_id long, text string")
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(asked, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "fr"), (5, "en"), (None, "en"), (6, "und"), (7, "und")}
    known = {r.doc_id: r.n_known for r in language_id.predict(asked.filter("doc_id in (2, 4, 5)"), model).collect()}
    assert known == {2: 0, 4: 40_000, 5: 0}
    empty = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(asked, empty).collect()} == {"und"}


def test_language_of_long_runs(spark):
    """A run of letters counts as a whole: what follows its 64th letter too, when learning and when predicting."""
    for n in (1, 64, 65, 66, 67, 128, 129, 130, 500):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        for k in range(1, language_id.LONGEST + 1):
            assert {g for p in language_id.slices(word) for g in language_id.grams(p, k)} == set(language_id.grams(f" {word} ", k))
    rows = [(i, "thecatandthedog" * 8, "en") for i in range(20)] + [(i, "q" * 200 + "lechienetlechat" * 8, "fr") for i in range(20, 40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "thecatandthedog" * 4 + "lechienetlechat" * 40), (2, "lechien" * 9 + "andthecat" * 4000)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(asked, model).collect()} == {1: "fr", 2: "en"}


def split_plainly(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut]


def rule_plainly(host, path):
    best = None
    for says, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = says, rule
    return best


URLS = [None, "", "x", "http://", "http://A.Example.COM/en/7?x#y", "http://example.com/en/8", "https://a.example.net/de/8/1", "ftp://b.net/de/", "http://c.org/es", "http://c.org/es/", "a://b://c/d", "http://com/en/", "http://xcom/en/1", "http://é.com?q=/en/", "http://n.net#/de/", "http://Ünet.net/de/İ", "http://example.com/" + "a1" * 20_000]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.UrlModel(None, None, 0.2)).collect()}
    assert len(got) == 2 * len(URLS)
    for i, u in enumerate(URLS * 2):
        host, path = split_plainly(u)
        rule = rule_plainly(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[1] if rule else None), u
        assert got[i].verdict == (rule[0] if rule else "allow")


def test_url_trees_learn(spark):
    rows = [(f"http://good.com/{i}", 0) for i in range(300)] + [(f"http://bad-ads.net/x/y/z?a={i}&b=1&c=2", 1) for i in range(300)] + [(None, 1), ("http://x.y", None)]
    model = url_filter.fit(spark.createDataFrame(rows, "_url string, _block int"), rounds=3)
    pages = spark.createDataFrame([(1, "http://good.com/999"), (2, "http://bad-ads.net/x/y/z?a=999&b=1&c=2"), (3, None)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, model).collect()}
    assert got[1] == "allow" and got[2] == "block"
    assert url_filter.fit(spark.createDataFrame([], "_url string, _block int")).trees is None
