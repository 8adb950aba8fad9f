"""The training-data operators on small planted cases, edge cases and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm import components, decontaminate, exact_dedup, license_scan, line_dedup, packing, pii, quality, simhash, toxicity, url_filter, vec

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s0", 1),
    (2, None, None, None, None),
    (3, "", "en", "s0", 0),
    (4, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s0", 1),
    (4, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s0", 1),
    (5, "word " * 30_000, "de", "s1", 2),
    (None, "nobody has this", "en", "s1", 3),
    (6, "  \t\n ", "fr", None, 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "id long, h string, row long, norm string, fp long, key1 long, size long, word string, at long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeats, a long text, and columns whose names operators might use inside."""
    extra = T._parse_datatype_string(EXTRA) if hasattr(T, "_parse_datatype_string") else None
    df = spark.createDataFrame(ROWS, SCHEMA)
    for f in extra.fields:
        df = df.withColumn(f.name, F.lit(7).cast(f.dataType))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "nobody has"), (3, None), (4, "")], "item_id long, text string")


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], SCHEMA)


def operators(odd, labels, items):
    return {
        "exact": lambda d: exact_dedup.exact_groups(d),
        "hits": lambda d: decontaminate.find_hits(d, items),
        "clean": lambda d: decontaminate.remove_documents(d, items),
        "spans": lambda d: decontaminate.remove_spans(d, items),
        "simhash": lambda d: simhash.near_groups(d),
        "one": lambda d: simhash.keep_one(d),
        "lines": lambda d: line_dedup.dedup_lines(d),
        "pack": lambda d: packing.pack(d),
        "toxic": lambda d: toxicity.drop_toxic(d, labels),
        "pii": lambda d: pii.find(d, pii.train(d)),
        "quality": lambda d: quality.classify(d, labels),
        "license": lambda d: license_scan.scan_licenses(d),
    }


@pytest.mark.parametrize("name", ["exact", "hits", "clean", "spans", "simhash", "one", "lines", "pack", "toxic", "pii", "quality", "license"])
def test_odd_and_empty_tables(spark, odd, labels, items, name):
    run = operators(odd, labels, items)[name]
    n = run(odd).count()
    if name in ("exact", "hits", "simhash", "pii", "quality", "license", "spans"):
        assert n == len(ROWS)
    assert n > 0
    assert run(odd.limit(0)).count() == 0


def test_exact_groups(spark, odd):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd, keep="largest").collect()}
    assert {(1, 4, 3, False), (4, 4, 3, True), (2, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)} <= got
    small = {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(odd).collect()}
    assert {(4, 1), (3, 2)} <= small


def test_exact_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs(spark, ["a", "b", "A", "c"])).collect()}
    assert got == {0: (0, 2), 1: (1, 1), 2: (0, 2), 3: (3, 1)}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_decontamination_by_brute_force(spark):
    rng = random.Random(2)
    words = ["the", "Of", "é", "x1", "and", "zu"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    benchmark = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(8)]
    for k in range(5):
        texts[k] += ", " + benchmark[k] + "! " + benchmark[k]
    got = {r.doc_id: r for r in decontaminate.find_hits(docs(spark, texts), spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string")).collect()}
    windows = set()
    for item, t in enumerate(benchmark):
        w = WORD.findall(lower(t))
        windows |= {(item, tuple(w[k : k + 10])) for k in range(max(1, len(w) - 9))} if w else set()
    for k, t in enumerate(texts):
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for item, window in windows:
            for at in range(len(w) - len(window) + 1):
                if tuple(w[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(str(item))
        r = got[k]
        assert r.n_words == len(w) and r["items"] == sorted(found)
        assert {p for h in r.hits for p in range(h.start, h.start + h.width)} == hit


def test_spans_are_cut_and_the_rest_is_untouched(spark, items):
    passage = "beta Gamma delta epsilon zeta eta, theta iota kappa lambda"
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(docs(spark, [f"Keep this. {passage} And this!", "clean  Text\n"]), items).collect()}
    assert got == {0: "Keep this. And this!", 1: "clean  Text\n"}


def test_simhash_fingerprint_by_hand():
    for text in ["", "one", "Two words", "A b c d e É f", "x " * 300, "tab\tand\x0bvertical\x1cfile"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        expected = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert simhash.fingerprint(text.encode()) == expected


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_every_near_pair_agrees_on_a_mask():
    """All differences of one and two bits; finer masks miss none of those that a mask lets through, and bound a key."""
    for distance in (1, 2):
        masks = simhash.ring_masks(distance)
        for a in range(64):
            for b in range(a, 64 if distance == 2 else a + 1):
                x = 1 << a | 1 << b
                through = [m for m in masks if not x & m]
                assert through and all(any(not x & f for f in simhash.finer_masks(m, distance)) for m in through)
        assert {bin(m).count("1") for m in masks} == {40 if distance == 2 else 48}
        assert all(bin(f).count("1") == 64 - 4 * distance and f & m == m for m in masks for f in simhash.finer_masks(m, distance))


@pytest.mark.parametrize("crowd", [2, 1000])
def test_links_by_brute_force(spark, crowd):
    """Random fingerprints, chains of neighbours and one crowded ball, by the ring's masks or the finer ones."""
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(60)}
    base = rng.getrandbits(64)
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(0, 20) for b in range(0, 20)}
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(6):
            x ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            prints.add(x)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for distance in (1, 2):
        got = [(r.a, r.b) for r in simhash.links(df, distance, crowd).collect()]
        near = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= distance]
        assert set(got) == set(near)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    rng.shuffle(edges)
    nodes = {n for e in edges for n in e}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == union(edges, nodes)


def removed_lines(texts, t):
    first, occurrences = {}, []
    for k, text in enumerate(texts):
        for i, line in enumerate((text or "").encode().lower().split(b"\n")):
            s = frozenset(line.split())
            if s:
                occurrences.append((k, i, s))
                first.setdefault(s, (k, i))
    late = {s for s in first for o in first if o != s and first[o] < first[s] and len(s & o) >= t * len(s | o) - 1e-9}
    out = {}
    for k, i, s in occurrences:
        if s in late or (k, i) > first[s]:
            out.setdefault(k, []).append(i)
    return out


@pytest.mark.parametrize("tried,lag", [(4, 20_000), (0, 3)])
def test_line_dedup_by_brute_force(spark, monkeypatch, tried, lag):
    """Near copies around the threshold; with no or few first tries the exact way for the rest must find the same."""
    monkeypatch.setattr(line_dedup, "TRIED", tried)
    monkeypatch.setattr(line_dedup, "MANY", max(tried, 1))
    monkeypatch.setattr(line_dedup, "LAG", lag)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 24))] for _ in range(25)]

    def line():
        words = list(rng.choice(pool))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words)

    texts = ["\n".join(line() for _ in range(rng.randint(0, 8))) for _ in range(60)] + [None, ""]
    got = {r.id: list(r.removed) for r in line_dedup.later_matches(docs(spark, texts)).collect()}
    assert got == removed_lines(texts, 0.8)


def test_dedup_lines_keeps_the_rest(spark):
    one = "a repeated line of seven different words"
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, [f"{one}\nfirst", f"own\n{one}\nlines", one, None, ""])).collect()}
    assert got == {0: f"{one}\nfirst", 1: "own\nlines", 3: None, 4: ""}


def test_best_fit_takes_the_tightest_compatible_bin():
    placed = packing.best_fit([6, 5, 3, 3, 2], [1, 2, 1, 2, 4], [0] * 5, 10)
    # 3 of source 1 does not fit beside 6 of source 1, so it joins the 5; 3 of source 2 joins the 6.
    assert placed == [(0, 0), (1, 0), (1, 1), (0, 1), (1, 2)]
    assert [b for b, _ in packing.best_fit([4, 4, 4], [0, 0, 0], [1, 1, 2], 10)] == [0, 1, 0]


def test_best_fit_by_brute_force():
    rng = random.Random(6)
    for _ in range(30):
        n = rng.randint(1, 60)
        sizes = sorted((rng.randint(1, 20) for _ in range(n)), reverse=True)
        sources, clusters = [1 << rng.randrange(4) for _ in range(n)], [rng.choice([0, 1, 2, 4]) for _ in range(n)]
        bins = []
        expected = []
        for s, a, c in zip(sizes, sources, clusters):
            fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= s and not b[1] & a and not b[2] & c]
            if fits:
                k = min(fits)[1]
            else:
                k = len(bins)
                bins.append([20, 0, 0])
            bins[k] = [bins[k][0] - s, bins[k][1] | a, bins[k][2] | c]
            expected.append(k)
        assert [b for b, _ in packing.best_fit(sizes, sources, clusters, 20)] == expected


def test_pack_is_whole_and_within_bounds(spark):
    texts = [" ".join(["w"] * n) for n in (5, 9, 10, 23, 1, 7, 7)] + [None]
    d = docs(spark, texts)
    rows = packing.pack(d, capacity=10, shard_pieces=3).collect()
    assert sum(r.n_tokens for r in rows) == 62
    by = {}
    for r in rows:
        if r.bin_id is not None:
            by.setdefault(r.bin_id, []).append(r)
    assert all(sum(r.n_tokens for r in b) <= 10 and len({r.doc_id % 3 for r in b}) == len(b) for b in by.values())
    assert [(r.piece, r.start, r.n_tokens) for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)) if r.doc_id == 3] == [(0, 0, 10), (1, 10, 10), (2, 20, 3)]
    seq = packing.sequences(d, packing.pack(d, capacity=10, shard_pieces=3)).collect()
    assert sum(len(r.text.split()) for r in seq) == 62


def test_url_rules(spark):
    urls = {
        "https://Blog.Example.ORG/es/1?x": ("example.org/es/", "block"), "http://a.org/q": ("org/", "allow"), "http://example.org/en/12": ("example.org/en/1", "block"),
        "http://notexample.org/es/": ("org/", "allow"), "http://x.com/fr/1#t": ("com/fr/", "allow"), "http://x.com/de/": ("com/de/", "block"), "http://x.com/en": (None, "allow"),
        "http://org/": ("org/", "allow"), "http://x.org": (None, "allow"), "no scheme": (None, "allow"), "http://www.cheap-pills.com/en": ("cheap-pills", "block"),
        "http://notcheap-pillsx.com/": (None, "allow"), "": (None, "allow"),
    }
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, None])], "page_id long, url string").withColumn("token", F.lit("t"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.CONTRACT_RULES + url_filter.SPAM_RULES).collect()}
    assert got == dict(enumerate([*urls.values(), (None, "allow")]))
    assert url_filter.judge_urls(pages.limit(0), url_filter.CONTRACT_RULES).count() == 0


def test_license_spellings(spark):
    mit = license_scan.KNOWN[0][1]
    texts = ["Copyright (c) 2020 Me\n" + mit.replace(", ", " ,\n").upper(), "x\nreleased under the mit licence\ny", mit + " more", "Licensed under CC BY 4.0!"]
    got = {r.doc_id: (r.license, r.n_lines, r.line_licenses) for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert got == {0: ("MIT", 0, ""), 1: (None, 1, "MIT"), 2: (None, 0, ""), 3: ("CC-BY-4.0", 1, "CC-BY-4.0")}


def naive_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_by_plain_patterns():
    rng = random.Random(3)
    parts = ["a@b.c", "x.y+z@q-r.com", "@", "@@", "a@b", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "+1 (555) 010-9999", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "0001.2.3.04", " ", "é", "-", "12", "٣"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        assert pii.span_string(pii.base_spans(t)) == pii.span_string(naive_spans(t)), t


def test_skip_links_add_a_repeated_number(spark):
    rng = random.Random(5)

    def phone():
        return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"

    texts = [f"some words {phone()} and {rng.randrange(10, 99999)} items, mail a{k}@b.com again {rng.randrange(10)}.5" for k in range(80)]
    texts.append("Call +1 (162) 555-6820 now. " + "words " * 40 + "Or 1 162 555-6820 at night, room 1201.")
    d = docs(spark, texts)
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.find(d, pii.train(d)).collect()}
    assert got[80] == [("phone", "+1 (162) 555-6820"), ("phone", "1 162 555-6820")]


def test_machine_learns_a_pair():
    """Neither term alone says anything, the two together do: weights cannot, factors can."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 2))
    y = (x[:, 0] ^ x[:, 1] ^ 1).astype(np.int64)
    rows = [np.array([10 + k for k in range(2) if r[k]] + [50 + k for k in range(2) if not r[k]], np.int32) for r in x]
    old = toxicity.MIN_Z
    try:
        toxicity.MIN_Z = 0.0
        machine = toxicity.fit(rows, y, rounds=600, decay=0.0)
    finally:
        toxicity.MIN_Z = old
    design = np.array([[1.0 if t in r else 0.0 for t in machine.terms] for r in rows])
    assert ((machine.raw(design) > 0) == (y == 1)).mean() > 0.95


def test_toxicity_on_planted_words(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(50)]
    rows, marks = [], []
    for k in range(900):
        bad = k % 4 == 0
        rows.append((k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) + (" idiot " if bad else " kind "), "en", "s", 0))
        marks.append((k, 1, int(bad)))
    d, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scored = toxicity.score(d, toxicity.train(d, labels)).collect()
    assert all((r.score >= toxicity.THRESHOLD) == (r.doc_id % 4 == 0) for r in scored)


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney, plainly: a function from a context and byte to its probability."""
    from collections import Counter

    padded = [b"\0" * (order - 1) + t for t in texts]
    counts = {order: Counter(t[k : k + order] for t in padded for k in range(len(t) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discount(n):
        c = Counter(counts[n].values())
        if not c[1] or not c[2]:
            return (0.5, 0.75, 0.9)
        y = c[1] / (c[1] + 2 * c[2])
        d = [1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / c[3] if c[3] else 1.5]
        return [min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3))]

    discounts = {n: discount(n) for n in range(2, order + 1)}

    def p(gram):
        n = len(gram)
        if n == 1:
            return (counts[1][gram] + 0.5) / (sum(counts[1].values()) + 128)
        followers = [c for g, c in counts[n].items() if g[:-1] == gram[:-1]]
        if not followers:
            return p(gram[1:])
        d = lambda c: discounts[n][min(c, 3) - 1] if c else 0
        c = counts[n][gram]
        return (c - d(c)) / sum(followers) + sum(map(d, followers)) / sum(followers) * p(gram[1:])

    return p


@pytest.mark.parametrize("block", [1 << 24, 30])
def test_perplexity_by_plain_formula(spark, block):
    """One block of texts or several give the plain formula's perplexity."""
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "then the cat ran"]
    trained = docs(spark, texts)
    some = quality.trusted_counts(trained, trained.where("doc_id > 0").select(F.col("doc_id").alias("id")), "doc_id", "text", block)
    ids = {r.doc_id for r in trained.where((F.col("doc_id") > 0) & ~quality.held_out(F.col("doc_id"))).collect()}
    counts = {}
    for k in ids:
        padded = b"\0" * (quality.ORDER - 1) + texts[k].encode()
        for j in range(len(texts[k])):
            gram = int.from_bytes(padded[j : j + quality.ORDER], "big")
            counts[gram] = counts.get(gram, 0) + 1
    assert ids and {r.gram: r.n for r in some.collect()} == counts
    model = quality.train(trained.select("text"))
    probe = docs(spark, ["the cat ran on", "zzz", "the dog sat on the log", "", None, "é"])
    got = {r.doc_id: r.perplexity for r in quality.perplexities(probe, model, ("doc_id",), block_bytes=block).collect()}
    p = kneser_ney([t.encode() for t in texts], quality.ORDER)
    for k, t in enumerate(["the cat ran on", "zzz", "the dog sat on the log"]):
        padded = b"\0" * (quality.ORDER - 1) + t.encode()
        logs = [np.log(p(padded[j : j + quality.ORDER])) for j in range(len(t))]
        assert got[k] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-4)
    assert got[3] is None and got[4] is None and got[5] > 0


def test_model_sums_to_one(spark):
    p = kneser_ney([b"abracadabra", b"banana"], 3)
    assert sum(p(b"ab" + bytes([k])) for k in range(256)) == pytest.approx(1)


def test_quantiles_by_language(spark):
    rows = [("a", float(k)) for k in range(1, 101)] + [("b", 5.0)] * 10
    got = {r.lang: r.threshold for r in quality.quantile_by(spark.createDataFrame(rows, "lang string, perplexity double"), "lang", 0.9).collect()}
    assert got["a"] == pytest.approx(90, rel=0.002) and got["b"] == pytest.approx(5, rel=0.002)


def test_word_spans_do_not_cross_rows():
    import pyarrow as pa

    column = pa.array(["ab", "cd e", None, "", "F"])
    (chunk,) = vec.chunks(column)
    w = vec.words(chunk, vec.byte_class())
    assert [bytes(w.low[a:b]) for a, b in zip(w.starts, w.ends)] == [b"ab", b"cd", b"e", b"f"] and w.row.tolist() == [0, 1, 1, 4]
    hasher = vec.Hasher(w.low)
    again = vec.Hasher(np.frombuffer(b"xxcd", np.uint8))
    assert hasher(w.starts[1:2], w.ends[1:2])[0] == again(np.array([2]), np.array([4]))[0]
    assert hashlib.md5(b"").hexdigest()
