"""Near-dedup, line dedup, mixing, chat formatting and the pipeline against brute force."""

import json
import random
from itertools import combinations

import numpy as np
import pytest

from cellmill.llm import near_dedup as near_module
from cellmill.llm.chat_format import argument_errors, canonical, depths, link_tools
from cellmill.llm.components import components, confirmed, links
from cellmill.llm.line_dedup import line_dedup
from cellmill.llm.mixing import mix_sources
from cellmill.llm.near_dedup import BINS, drop_near, near_dedup, sketch
from cellmill.llm.shared import free, materialise


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {n: find(n) for n in nodes}


def near_copies(seed=5):
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefgh", k=4))
    texts = [None, "", " \n", "one two", "One  TWO", "x"]
    for size in (1, 2, 3, 40):
        base = [word() for _ in range(90)]
        for _ in range(size):
            own = list(base)
            for _ in range(random.randint(0, 3)):
                own[random.randrange(len(own))] = word()
            texts.append(" ".join(own))
    chain = [word() for _ in range(60)]
    for _ in range(12):  # each differs from the last one only
        texts.append(" ".join(chain))
        chain[random.randrange(60)] = word()
    return texts + texts[10:14]


def test_near_dedup(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs, shingle=4).collect()}
    sets = [shingles(t, 4) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(near, range(len(texts)))
    assert got == {k: (len(sets[k]), root[k], root[k] == k) for k in range(len(texts))}


def test_near_dedup_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup(docs).collect()), key=str)
    assert got == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (None, None, True)], key=str)
    assert near_dedup(docs.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for shared in (200, 500, 900):
        a, b = x[:shared], x[shared:]
        half = len(b) // 2
        s, t = sketch(np.concatenate([a, b[:half]])), sketch(np.concatenate([a, b[half:]]))
        assert abs((s == t).mean() - shared / 1000) < 0.13
    for n in (1, 2, 5):
        assert len(sketch(x[:n])) == BINS and sketch(x[:n]).max() < np.iinfo(np.uint64).max


def test_components(spark):
    random.seed(9)
    pairs = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, 500 + k) for k in range(1, 60)]
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == roots([p for p in pairs if p[0] != p[1]], nodes)


def test_line_dedup(spark):
    a = "the quick brown fox jumps over the lazy dog while many other animals look on and wonder what comes next in line, for nobody told them how long such a show would take or who was going to pay for all of it"
    texts = [f"{a}\nshort\n\n{a} x", None, "", f"  {a.replace('wonder', 'ponder')} \nshort\r\nanother line that nobody else has at all", f"{a}\n{a}"]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {(r.doc_id, r.line_no): (r.keep_id, r.keep_line, r.kept) for r in line_dedup(docs).collect()}
    assert got == {
        (0, 0): (0, 0, True), (0, 1): (0, 1, True), (0, 2): (0, 2, True), (0, 3): (0, 0, False), (2, 0): (2, 0, True),
        (3, 0): (0, 0, False), (3, 1): (0, 1, False), (3, 2): (3, 2, True), (4, 0): (0, 0, False), (4, 1): (0, 0, False),
    }
    assert line_dedup(docs.limit(0)).count() == 0


def test_mixing(spark):
    random.seed(6)
    rows = [(k, "x" * random.randint(0, 400), "big" if k % 3 else f"s{k % 5}", k) for k in range(600)] + [(1000, None, None, 1), (1001, "", "empty", 1), (None, "abc", "s1", 1), (7, "abcd" * 9, "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens long")
    out = mix_sources(docs, repetition=2.0).collect()
    copies = {}
    for r in out:
        copies.setdefault((r.doc_id, r.source), []).append(r.epoch)
    assert {(i, s) for i, _, s, _ in rows} == set(copies)  # nothing is lost
    total = lambda s: sum((len(t or "") + 3) // 4 for _, t, c, _ in rows if c == s)
    read = lambda s: sum(r.tokens for r in out if r.source == s)
    assert read("big") == total("big")
    for s in ("s0", "s1", "s2", "s3", "s4"):
        times = read(s) / total(s)
        assert 1 <= times <= 2.05
    budget = sum(total(s) for s in ("big", "s0", "s1", "s2", "s3", "s4", None))
    fixed = mix_sources(docs, repetition=100, budget=float(budget)).collect()
    assert abs(sum(r.tokens for r in fixed) - budget) < 0.1 * budget
    flat = mix_sources(docs.filter("source is not null and source <> 'empty'"), entropy=1.7, budget=float(budget)).groupBy("source").sum("tokens").collect()
    share = np.array([r[1] for r in flat]) / sum(r[1] for r in flat)
    assert 1.6 < -(share * np.log(share)).sum() < 1.8
    assert mix_sources(docs.limit(0)).count() == 0


def test_chat_format(spark):
    schema = {"add": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "note": {"type": "string", "maxLength": 3}}, "required": ["a", "b"], "additionalProperties": False}}
    rows = [
        ("assistant", "", "c1", "add", '{"b": 2.5, "a": 1}', None, None), ("tool", "3.5", None, None, None, "c1", None), ("assistant", "", "c2", "add", '{"a": "x", "note": "long", "z": 1}', None, "c1"),
        ("assistant", None, "c3", "nope", "[1]", None, "c2"), ("tool", "?", None, None, None, "lost", None), ("user", "hi", None, None, None, None, None), ("assistant", "", "c4", "add", "[1]", None, "c5"),
        ("assistant", "", "c5", "add", None, None, "c4"), ("tool", "again", None, None, None, "c1", None),
    ]
    messages = spark.createDataFrame([(k, *r, "extra") for k, r in enumerate(rows)], "turn int, role string, text string, call_id string, name string, arguments string, result_of string, after string, status string")
    got = {r.turn: r for r in link_tools(messages, schema).collect()}
    assert [got[k].status for k in range(9)] == ["linked", "repeated", "open", "open", "orphan", "plain", "open", "open", "repeated"]
    assert [got[k].depth for k in range(9)] == [0, 1, 2, 3, 0, 0, None, None, 1]
    assert got[0].errors == [] and got[2].errors == ["a: not integer", "b: missing", "note: too long", "z: unknown"]
    assert got[3].errors == ["nope: no such function"] and got[6].errors == got[7].errors == ["not an object"] and got[5].errors == []
    assert got[0].json == '{"content":"","role":"assistant","tool_calls":[{"arguments":{"a":1,"b":2.5},"id":"c1","name":"add"}]}'
    assert json.loads(got[1].json) == {"content": "3.5", "role": "tool", "tool_call_id": "c1"}
    assert link_tools(messages.limit(0), schema).count() == 0
    one = spark.range(1).select(canonical(__import__("pyspark").sql.functions.lit('{"b": [1, {"z": 1, "y": null}], "a": "é"}')).alias("j")).first().j
    assert one == '{"a":"é","b":[1,{"y":null,"z":1}]}'


def test_depths(spark):
    rows = [(str(k), str(k - 1) if k else None) for k in range(40)] + [("x", "y"), ("y", "x"), ("z", "x"), ("w", "gone")]
    got = {r.node: r.depth for r in depths(spark.createDataFrame(rows, "node string, parent string")).collect()}
    assert got == {str(k): k for k in range(40)} | {"x": None, "y": None, "z": None, "w": 0}


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, left, sf)
        assert after.columns == docs.columns
        left = spark.createDataFrame(after.collect(), docs.schema)
    ids = {r.doc_id for r in left.collect()}
    texts = [r.text for r in left.collect()]
    assert len(set(texts)) == len(texts) and 0.5 * docs.count() < len(ids) < docs.count()
    sets = [shingles(t, 5) for t in texts]
    assert not [1 for a, b in combinations(sets, 2) if a and 100 * len(a & b) >= 80 * len(a | b)]
    assert {r.doc_id for r in pipeline.run(spark, sf).collect()} == ids


def char_shingles(line):
    return {line[k : k + 5] for k in range(max(1, len(line) - 4))}


def test_line_dedup_shingles_at_every_character(spark):
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrst", k=random.randint(2, 9)))
    short = "the quick brown fox jumps over the lazy dog while many other animals look on and wonder what comes next in line"
    start = "https://example.com/a/long/page/"
    lines = [
        short, short.replace("wonder", "ponder"), f"{short} x", f"{start}1/{word() * 8}", f"{start}2/{word() * 8}", "abcd", "abcde", "a\rb", "x",
        "春の海ひねもすのたりのたりかな、夏草や兵どもが夢の跡、柿くへば鐘が鳴るなり法隆寺、古池や蛙飛びこむ水の音、閑さや", "春の海ひねもすのたりのたりかな、夏草や兵どもが夢の跡、雪とけて村いっぱいの子どもかな、名月をとってくれろと泣く子かな、菜の花や",
        "😀😁😂🤣😃😄😅😆😉😊😋😎😍😘🥰", "😀😁😂🤣😃😄😅😆😉😊😋😎😍😘🥲",
    ]
    for size in (60, 120, 400):
        for _ in range(25):
            base = word()
            while len(base) < size:
                base += " " + word()
            at = random.randrange(size)
            lines += [base, base[:at] + "#" + base[at + 1 :]]
    lines = list(dict.fromkeys(lines))
    sets = [char_shingles(x) for x in lines]
    near = [(a, b) for a, b in combinations(range(len(lines)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(near) > 70 and lines.index(short) == 0 and (0, 1) in near and (3, 4) not in near and (9, 10) not in near
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.keep_id, r.kept) for r in line_dedup(docs).collect()}
    root = roots(near, range(len(lines)))
    assert got == {k: (len(sets[k]), root[k], root[k] == k) for k in range(len(lines))}


def test_line_dedup_unbroken_lines(spark):
    lines = ["https://example.com/listing/" + "abcdefghij" * 2 + "klmnopqrst", "https://example.com/listing/" + "0123456789" * 2 + "uvwxyzklmn", "長い一行の始まりは同じでも後に続く文がまるで違う行である、春の海ひねもすのたり", "長い一行の始まりは同じでも後に続く文がまるで違う行である、菜の花や月は東に日は"]
    assert all(lines[k][:24] == lines[k + 1][:24] for k in (0, 2))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.kept) for r in line_dedup(docs).collect()} == {k: (len(char_shingles(x)), True) for k, x in enumerate(lines)}


def test_drop_near_decides_by_row(spark):
    random.seed(12)
    words = lambda n: " ".join("".join(random.choices("abcdef", k=5)) for _ in range(n))
    one, other, third, long = words(30), words(30), words(40), words(40_000)
    rows = [(3, one), (7, one), (7, other), (None, one), (None, third), (None, third + " x"), (9, long), (10, long + " y"), (11, None), (11, ""), (12, None)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    left = drop_near(docs)
    assert left.columns == docs.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    nameless = [t for i, t in got if i is None]
    assert sorted((r for r in got if r[0] is not None), key=str) == sorted([(3, one), (7, other), (9, long), (11, None), (11, ""), (12, None)], key=str)
    assert nameless in ([third], [third + " x"])
    assert drop_near(docs.limit(0)).count() == 0


def test_argument_schemas(spark):
    schema = {
        "type": "object", "description": "checked at any depth", "required": ["n"], "additionalProperties": False, "maxProperties": 9,
        "properties": {
            "n": {"type": "integer", "minimum": 1, "exclusiveMaximum": 1e30}, "kind": {"enum": ["a", 1, None, {"x": 1}]}, "one": {"const": True}, "part": {"type": ["number", "null"], "multipleOf": 0.5}, "it's": {"type": "string", "pattern": "^[a-z]+$"},
            "list": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "object", "properties": {"deep": {"type": "array", "items": {"type": "string", "maxLength": 2}}}, "required": ["deep"]}},
        },
    }
    cases = {
        '{"n": 12345678901234567890}': [], '{"n": 1.0}': [], '{"n": 1.5}': ["n: not integer"], '{"n": 0, "one": false}': ["n: too small", "one: not the value"], '{"n": 1, "kind": {"x": 1}, "one": true}': [],
        '{"n": 1, "kind": 1.0}': [], '{"n": 1, "kind": "b"}': ["kind: not one of the values"], '{"n": 1, "part": null}': [], '{"n": 1, "part": 0.75}': ["part: no multiple"], '{"n": 1, "part": "x"}': ["part: not number or null"],
        '{"n": 1, "it\'s": "A", "zz": 1}': ["it's: not of the pattern", "zz: unknown"], '{"n": 1, "list": []}': ["list: too few"], '{"n": 1, "list": [{"deep": ["ab"]}, {"deep": ["ab"]}]}': ["list: repeated"],
        '{"n": 1, "list": [{"deep": ["abc", 1]}, {}]}': ["list[].deep: missing", "list[].deep[]: not string", "list[].deep[]: too long"], '{"n": 1, "n": 2}': ["not an object"], "": ["not an object"], '"x"': ["not an object"], "{}": ["n: missing"],
        '{"n": null}': ["n: not integer"], '{"n": 1, "list": 7}': ["list: not array"],
    }
    F = __import__("pyspark").sql.functions
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    got = {r.j: r.e for r in df.select("j", argument_errors(F.lit("f"), F.col("j"), {"f": schema}).alias("e")).collect()}
    assert got == cases
    empty = {r.j: r.e for r in df.select("j", argument_errors(F.lit("f"), F.col("j"), {"f": {}}).alias("e")).collect()}
    assert empty['{"n": 1.5}'] == [] and empty['"x"'] == ["not an object"]
    with pytest.raises(ValueError, match="oneOf"):
        argument_errors(F.lit("f"), F.col("j"), {"f": {"properties": {"a": {"oneOf": []}}}})


def test_chat_format_long_texts(spark):
    text = "é\n" * 400_000
    rows = [(0, "assistant", text, "c", "add", json.dumps({"note": text}), None, None), (1, "tool", text, None, None, None, "c", None)]
    out = link_tools(spark.createDataFrame(rows, "turn int, role string, text string, call_id string, name string, arguments string, result_of string, after string"), {"add": {}}).collect()
    assert {json.loads(r.json)["content"] == text for r in out} == {True} and {r.turn: r.depth for r in out} == {0: 0, 1: 1}


def test_mixing_long_texts_and_components_without_edges(spark):
    docs = spark.createDataFrame([(1, "x" * 3_000_000, "a"), (2, "y", "b")], "doc_id long, text string, source string")
    out = mix_sources(docs, repetition=2.0).collect()
    assert {r.doc_id: r.tokens for r in out} == {1: 750_000, 2: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_whole_table(spark):
    """All documents of sf0.01 against all pairs: recall is 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: shingles(r.text, 4) for r in rows}
    order = sorted((k for k in sets if sets[k]), key=lambda k: len(sets[k]))
    near = []
    for at, a in enumerate(order):
        for b in order[at + 1 :]:
            if 80 * len(sets[b]) > 100 * len(sets[a]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                near.append((a, b))
    root = roots(near, sets)
    assert len(near) > 100
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs, shingle=4).collect()} == {k: (len(s), root[k], root[k] == k) for k, s in sets.items()}


def test_materialise_leaves_no_shuffle_files(spark):
    shuffles = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    before = shuffles()
    made = materialise(spark.range(1000).repartition(3, "id"))
    assert shuffles() <= before and made.count() == 1000
    free(made)


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Each member of a group meets a few pivots, not one in each of its bands."""
    random.seed(21)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    base = [word() for _ in range(200)]
    texts = []
    for _ in range(150):
        own = list(base)
        own[random.randrange(200)] = word()
        texts.append(" ".join(own))
    made = []

    def counted(pairs, sets, percent):
        made.append(pairs.count())
        return confirmed(pairs, sets, percent)

    monkeypatch.setattr(near_module, "links", lambda members, sets, percent: links(members, sets, percent, counted))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in near_dedup(docs, shingle=4).collect()} == {0}
    assert sum(made) < 8 * len(texts)


def join_rows(spark, run):
    """Rows that the joins of all queries within run() make, from Spark's own metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made, runs = 0, store.executionsList()
    for k in range(before, runs.size()):
        values, nodes = store.executionMetrics(runs.apply(k).executionId()), store.planGraph(runs.apply(k).executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())] if "Join" in node.name() else []
            made += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return made


def test_components_join_an_edge_once(spark):
    """Edges inside a tree are gone after one round: a hub's edges are not joined again and again."""
    edges = [(1000, 1000 + k) for k in range(1, 400)] + [(2000 + k, 3000) for k in range(400)] + [(5000 + k, 5001 + k) for k in range(60)]
    df = materialise(spark.createDataFrame(edges, "a long, b long"))
    got = {}
    made = join_rows(spark, lambda: got.update({r.node: r.component for r in components(df).collect()}))
    assert got == roots(edges, {n for e in edges for n in e})
    assert made < 8 * len(edges), made
