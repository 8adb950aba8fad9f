"""Tokens of URL patterns, rules and licences given as tables, and whole texts that decide."""

import itertools
import re

import test_llm_operators as base

from assayer.llm import license_scan, url_filter


def test_literals_of_patterns():
    cases = {
        r"^spam\.org/": ("spam", "org"), r"spam": (), r"^[^/]*spam-farm": (), r"^x\.spam-farm[0-9]+": ("x", "spam"), r"a|b": (), r"^ads?\.net$": ("net",), r"^(?:www\.)?shop/cart$": ("cart",),
        r"(?s)^go/a{2}/b$": ("go", "b"), r"/p/[a|b]/q/": ("p", "q"), r"^\w+/feed\.xml": ("feed",), r"-x.y-": (), r"/abc/.*": ("abc",), r"^(a(b)|[)])/k/": ("k",), r"": (), r"/spam\b": (), r"^x+/a$": ("a",),
    }
    assert {p: url_filter.literals(p) for p in cases} == cases
    # Whatever a pattern matches holds its tokens whole.
    parts = ["spam", ".org", "/", "x", "-", "farm", "1", "aa", "feed.xml", "/k/", "ab", "www.", "shop", "cart", "net", "ads."]
    for p in cases:
        for text in map("".join, itertools.product(parts, repeat=3)):
            if re.search(p, text):
                assert set(url_filter.literals(p)) <= set(re.split("[^a-z0-9]+", text)), (p, text)


def test_rules_as_a_table(spark):
    rules = spark.createDataFrame([("ads", "block", r"^ads\.", 5), ("feed", "allow", r"/feed\.xml$", 9), ("any digits", "block", r"[0-9]{4}", 1), (None, "block", None, 1)], "name string, verdict string, pattern string, rank int")
    urls = {"http://ads.x.com/": ("ads", "block"), "http://ads.x.com/feed.xml": ("feed", "allow"), "http://x.com/1234": ("any digits", "block"), "http://x.com/adsx": (None, "allow"), "": (None, "allow")}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == dict(enumerate(urls.values()))
    empty = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()}
    assert set(empty.values()) == {"allow"} and len(empty) == 5


def test_whole_texts_decide(spark):
    by_name = dict(license_scan.KNOWN)
    names = ["BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "ISC"]
    texts = [f"Copyright (c) 1999, The Regents\n(c) 2001 Others\n\n{by_name[n].upper().replace('. ', '.' + chr(10) + chr(10))}" for n in names]
    texts += [by_name["Zlib"] + " And more."]
    got = {r.doc_id: r.license for r in license_scan.scan_licenses(base.docs(spark, texts)).collect()}
    assert got == dict(enumerate([*names, None]))


def test_licences_as_a_table(spark):
    known = spark.createDataFrame([("Own-1.0", "You may. Do as you like!"), ("None", None), (None, "x"), ("Blank", " ... ")], "license string, text string")
    texts = ["you MAY do as -- you like", "first\nYou may do as you like.\nlast", "", None]
    got = {r.doc_id: (r.license, r.n_lines) for r in license_scan.scan_licenses(base.docs(spark, texts), known).collect()}
    assert got == {0: ("Own-1.0", 1), 1: (None, 1), 2: (None, 0), 3: (None, 0)}
