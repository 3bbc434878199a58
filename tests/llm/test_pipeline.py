"""The pipeline against a version that goes through rows and pairs one by one, and on odd rows."""

import re
from itertools import combinations

import duckdb
import pytest

from cellmill.llm.quality import fit
from cellmill.llm.queries import mixing_sql
from tests.llm.test_group_operators import roots, shingles
from tests.llm.test_row_operators import contaminated

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def by_hand(docs, model, items):
    """Rows (doc_id, text, ...) that the first four stages leave, in the order of doc_id."""
    rows = sorted((d for d, s in zip(docs, model.scores([d.text for d in docs]).round(6), strict=True) if s >= 0.3), key=lambda d: (d.doc_id is None, d.doc_id))
    kept, seen = [], set()
    for d in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", d.text or "")
        if norm not in seen:
            seen.add(norm)
            kept.append(d)
    sets = [shingles(d.text, 5) for d in kept]
    near = [(a, b) for a, b in combinations(range(len(kept)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = roots(near, range(len(kept)))
    kept = [d for k, d in enumerate(kept) if of[k] == k]
    return [d for d in kept if not contaminated(d.text, items)[4]]


def mixed(rows):
    con = duckdb.connect()
    con.execute("create table d (doc_id bigint, source varchar, text varchar)")
    con.executemany("insert into d values (?, ?, ?)", [(r.doc_id, r.source, r.text) for r in rows])
    return sorted(con.sql(mixing_sql("d")).fetchall())


def found(df):
    return sorted((r.doc_id, r.source, r.tokens, r.epoch, r.block_order, r.doc_order) for r in df.select("doc_id", "source", "tokens", "epoch", "block_order", "doc_order").collect())


def test_pipeline_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = by_hand(docs.collect(), model, items)
    assert 0.3 * docs.count() < len(left) < docs.count()
    assert found(pipeline.run(spark, SF)) == mixed(left)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated identifiers, repeated rows, a long text."""
    words = " ".join(f"w{k % 97}x{k % 89}" for k in range(60))
    long = " ".join(f"l{k % 1013}y{k % 911}" for k in range(20_000))
    rows = [(1, words, "a"), (2, words + " end", "a"), (1, words, "a"), (3, None, "b"), (4, "", "b"), (5, " ", None), (6, long, "b"), (7, long.replace("l7y", "q"), "c"), (8, "some other text of its own", "c"), (8, "a second text of one identifier", "c")]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)
    for name, df in (("documents", docs), ("labels", spark.read.parquet(f"{SF}/labels.parquet").limit(0)), ("benchmark", spark.read.parquet(f"{SF}/benchmark.parquet"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, (r.text or "")[:6]) for r in out} == {(1, words[:6]), (3, ""), (5, " "), (6, long[:6]), (8, "some o"), (8, "a seco")}
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
