"""License scan, token counts, decontamination, quality and URL filter: results against brute force, edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from cellmill.llm.decontaminate import decontaminate
from cellmill.llm.exact_dedup import exact_dedup
from cellmill.llm.license_scan import NOTICES, PHRASES, Scanner, edits_of, license_scan
from cellmill.llm.quality import K, Model, fit, score_quality, term_counts
from cellmill.llm.textkit import ALNUM, alnum_words, texts_in_chunks, word_hashes
from cellmill.llm.token_count import Counts, splits, token_counts
from cellmill.llm.url_filter import url_filter

DOCS = "doc_id long, text string, source string, n_words long, kept string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORDS.findall(lower(text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "Released under the MIT License.\nÉté  x", "a", 5, "k"), (2, None, None, None, None), (3, "", "a", 1, "k"), (None, "mit license mit license", "b", 2, None),
        (4, "Word " * 30000 + "released undr the mit licnse", "b", 3, "k"), (4, "Word " * 30000 + "released undr the mit licnse", "b", 3, "k"), (5, "a  b\tc", "c", 0, "k"), (6, "a b c", "c", 0, "k"),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_license_scan(odd):
    rows = license_scan(odd).collect()
    assert len(rows) == 8
    for r in rows:
        w = words(r.text)
        at = [i for p in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
    assert {r.labels for r in rows if r.doc_id == 4} == {"mit-notice"} and {r.labels for r in rows if r.doc_id == 1} == {"mit,mit-notice"}
    span = next(r for r in rows if r.doc_id == 4).spans[0]
    assert (span.start_word, span.end_word) == (30000, 30005) and 0 < span.edits <= edits_of("released under the mit license")
    assert license_scan(odd.limit(0)).count() == 0


def test_license_seeds_lose_nothing():
    random.seed(3)
    scanner = Scanner(PHRASES, NOTICES)
    for _ in range(300):
        n, label, k = random.choice(scanner.notices)
        s = list(n)
        for _ in range(random.randint(0, k + 1)):
            s[random.randrange(len(s))] = random.choice("abcxyz ")
        text = f"some words {''.join(s)} and more"
        joined = f" {b' '.join(alnum_words(text)).decode()} "
        brute = {lab for (_, lab, _), p in zip(scanner.notices, scanner.patterns, strict=True) if p.search(joined)}
        assert set(scanner.scan(text)[5].split(",")) - {""} - set(PHRASES.values()) == brute


def test_token_counts_match_the_library(odd):
    sentencepiece, public = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    path = public.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in token_counts(odd, path, limit=20000).collect():
        assert r.n_tokens == len(model.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 20000)
    assert token_counts(odd.limit(0), path).count() == 0
    random.seed(1)
    counts = Counts(path, {})
    assert counts.split
    texts = ["".join(random.choice(" \n\tabAB.<s>é漢▁\u3000\x00🙂") for _ in range(random.randint(0, 40))) for _ in range(3000)]
    assert counts.of(texts) == [len(x) for x in model.encode(texts)]
    assert counts.of(texts) == [len(x) for x in model.encode(texts)]  # from the cache


def test_word_hashes_follow_the_pattern():
    random.seed(2)
    texts = ["".join(random.choice("aZ09 é\n-漢\x7f\x00_") for _ in range(random.randint(0, 30))) for _ in range(400)]
    seen = {}
    for a, b, data, offsets in texts_in_chunks(texts):
        hashes, at = word_hashes(data, offsets, ALNUM)
        for k in range(a, b):
            own = hashes[at[k - a] : at[k - a + 1]].tolist()
            assert len(own) == len(words(texts[k])) == len(alnum_words(texts[k]))
            for h, w in zip(own, words(texts[k]), strict=True):
                assert seen.setdefault(h, w) == w
    assert len(seen) == len(set(seen.values()))


def contaminated(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        m = min(13, len(v))
        for k in range(len(v) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[k : k + m]:
                    hit.update(range(i, i + m))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [1_000_000, 10])
def test_decontaminate(spark, monkeypatch, block):
    monkeypatch.setattr("cellmill.llm.decontaminate.BLOCK_WORDS", block)
    random.seed(4)
    vocabulary = ["the", "of", "a", "B", "cc", "Été"]
    items = [(k, " ".join(random.choices(vocabulary, k=random.choice([0, 1, 3, 13, 20])))) for k in range(8)] + [(100, None), (101, "The of")]
    texts = [None, "", "the", "x " * 300] + [" ".join(random.choices([*vocabulary, "zz", "yy"], k=random.randint(1, 60))) + " " + (items[k % 8][1] or "") for k in range(30)]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate([*texts, texts[9]])], "doc_id long, text string, n_hit string")
    out = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert out == {k: contaminated(t, items) for k, t in enumerate([*texts, texts[9]])}
    if block > 10:
        none = decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in none} == {k: (len(words(t)), 0, False) for k, t in enumerate([*texts, texts[9]])}
        assert decontaminate(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_quality(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = score_quality(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert len(held) > 40 and sum(r.predicted == r.quality for r in held) >= 0.93 * len(held)
    assert sum(r.predicted == 0 and r.quality == 1 for r in held) <= 0.02 * len(held)
    out = score_quality(odd, labels.limit(0)).collect()
    assert len(out) == 8 and all(r.score == 1 and r.predicted == 1 for r in out)
    assert score_quality(odd.limit(0), labels).count() == 0
    assert Model(["a b", "c d"], [1, 0]).scores(["", None]).tolist() == [0.5, 0.5]


def test_quality_votes(spark):
    """Scores against a vote that goes through the labelled rows one by one; ties and repeated rows."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(docs, labels)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    counts = term_counts(texts).astype(float) * model.rarity
    for text, row, score in zip(texts, counts, model.scores(texts), strict=True):
        v = (row / (np.linalg.norm(row) + 1e-9) - model.mean) @ model.axes
        near = sorted(((float(v @ u) / (np.linalg.norm(v) + 1e-9), k) for k, u in enumerate(model.vectors)), reverse=True)[:K]
        total = sum(max(c, 0) for c, _ in near)
        assert not text or abs(score - sum(max(c, 0) * model.labels[k] for c, k in near) / total) < 1e-4
    same = Model(["good words here"] * 20 + ["bad bad bad bad"] * 20, [1] * 20 + [0] * 20)
    assert same.scores(["good words here", "bad bad bad bad"] * 2).round(6).tolist() == [1, 0, 1, 0]
    twice = score_quality(docs.limit(3).union(docs.limit(3)), labels)
    assert twice.groupBy("doc_id").agg({"score": "count", "predicted": "sum"}).count() <= 3 and twice.count() == 6


def test_repeats():
    at = lambda text: np.flatnonzero(term_counts([text])[0][-24:]).tolist()
    assert at("a b c") == [] and at("a a") == [0] and at("a a a") == [0, 1] and at("x a a a a a b b") == [0, 1, 2] and at("a") == []


def test_exact_dedup(spark, odd, monkeypatch):
    for hot in (256, 2):
        monkeypatch.setattr("cellmill.llm.exact_dedup.HOT_ROWS", hot)
        more = odd.union(spark.createDataFrame([(k, "a b\nc", "d", 1, "k") for k in range(20, 40)], DOCS))
        groups = {}
        rows = exact_dedup(more).collect()
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        for r in more.collect():
            groups.setdefault(norm(r.text), []).append(r.doc_id)
        for r in rows:
            own = groups[norm(r.text)]
            assert r.keep_id == min((i for i in own if i is not None), default=None) and r.group_size == len(own)
            assert r.text_sha256 == hashlib.sha256(norm(r.text).encode()).hexdigest()
        assert sum(r.kept for r in rows) == len(groups) and all(r.doc_id == r.keep_id for r in rows if r.kept)
        assert len(rows) == more.count() and "source" in rows[0]
    assert exact_dedup(odd.limit(0)).count() == 0


def test_url_filter(spark):
    entries = spark.createDataFrame([("net", "/", "block", True), ("example.net", "/en/", "allow", True), ("Bad.org", "", "block", False), ("bad.org", "/ok", "allow", False)], "host string, path string, verdict string, named boolean")
    urls = [None, "", "no scheme", "http://A.example.NET/en/x?y#z", "http://x.net/", "http://x.net", "http://bad.org/q", "https://sub.bad.org/okay", "http://notbad.org/", "http://x.net/", "a://net/?://b", "://", "http://é.net/ü"]
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, entries).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.net", "/en/x", "example.net/en/", "allow"), 4: ("x.net", "/", "net/", "block"),
        5: ("x.net", "", None, "allow"), 6: ("bad.org", "/q", None, "block"), 7: ("sub.bad.org", "/okay", None, "allow"), 8: ("notbad.org", "/", None, "allow"), 9: ("x.net", "/", "net/", "block"),
        10: ("net", "/", "net/", "block"), 11: ("", "", None, "allow"), 12: ("é.net", "/ü", "net/", "block"),
    }
    assert url_filter(pages, entries.limit(0)).filter("verdict = 'allow' and rule is null").count() == len(urls)
    assert url_filter(pages.limit(0), entries).count() == 0


def test_url_filter_canonical_and_long_lists(spark, monkeypatch):
    rules = [("net", "/", "block", True, False)]
    listed = [(f"h{k}.test", f"/p//{k}", "block", False, True) for k in range(3000)] + [("Bad.org.", "", "block", False, False), ("user@odd.org:443", "/x", "block", False, True), ("bare.org", "", "allow", False, True)]
    entries = spark.createDataFrame(rules + listed, "host string, path string, verdict string, named boolean, exact boolean")
    urls = {
        "http://h7.test/p/7?q#f": "block", "http://H7.TEST:80//p/7": "block", "https://h7.test./p/7": "block", "http://h7.test/p/70": "allow", "http://h7.test:8080/p/7": "allow", "http://a.h7.test/p/7": "allow",
        "http://x.bad.org:443/any": "block", "http://me:pw@bad.org": "block", "http://odd.org/x": "block", "http://odd.org/x/": "allow", "http://a.net:80/x": "allow", "http://a.net/x": "block", "http://bare.org": "allow",
    }
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    for most, rows in ((1 << 18, 500_000), (2, 0)):  # also with a filter that is too small, and a list that isn't broadcast
        monkeypatch.setattr("cellmill.llm.url_filter.MAX_BLOCKS", most)
        monkeypatch.setattr("cellmill.llm.components.BROADCAST_IDS", rows)
        got = {r.url: r.verdict for r in url_filter(pages, entries).collect()}
        assert got == urls


def test_split_rule_is_read_from_the_model():
    sentencepiece, public = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    proto = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model")).serialized_model_proto()
    field = lambda number, raw: bytes([number << 3 | 2, len(raw)]) + raw
    assert splits(proto)
    assert not splits(proto + field(3, b"\x20\x01"))  # white space is trimmed
    assert not splits(proto + field(3, b"\x12\x01x\x20\x00"))  # a character map
    for piece, kind in (("a▁b".encode(), 1), (b"a\nb", 1), (b"<user>", 4)):
        assert not splits(proto + field(1, b"\x0a" + bytes([len(piece)]) + piece + b"\x18" + bytes([kind])))
    assert splits(proto + field(1, b"\x0a\x02ab"))


def test_token_counts_with_small_summaries(spark, monkeypatch):
    sentencepiece, public = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    monkeypatch.setattr("cellmill.llm.token_count.SUMMARY", 40)
    monkeypatch.setattr("cellmill.llm.token_count.FREQUENT", 10)
    path = public.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert all(r.n_tokens == len(model.encode(r.text or "")) for r in token_counts(docs, path).collect())


def test_license_spans():
    """Places of spans and phrases against counting; notices are out of each other's reach."""
    random.seed(6)
    scanner = Scanner(PHRASES, NOTICES)
    for _ in range(200):
        n, label, k = random.choice(scanner.notices)
        s = list(n)
        for _ in range(random.randint(0, k)):
            s[random.randrange(len(s))] = random.choice("qz")
        before, after = ["w"] * random.randint(0, 30), ["v"] * random.randint(0, 30)
        text = "  ".join([*before, "".join(s), "MIT  license", *after])
        n_words, n_base, first, last, _, labels, score, spans = scanner.scan(text)
        w = words(text)
        at = [i for p in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (n_words, n_base, first, last) == (len(w), len(at), min(at), max(at)) and score == 1
        for name, a, b, edits in spans:
            got = " ".join(w[a:b])
            assert edits <= edits_of(next(x for x, lab, _ in scanner.notices if lab == name)) and " ".join(w[a : a + 1]) in got
        if label in labels.split(","):
            assert any(a <= len(before) + 2 and b >= len(before) for name, a, b, _ in spans if name == label)
    for n, label, _ in scanner.notices:
        assert [lab for (_, lab, _), p in zip(scanner.notices, scanner.patterns, strict=True) if p.search(f" {n} ")] == [label]
