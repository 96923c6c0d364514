"""The stages of the corpus pipeline, each judged on its own input, and the queries' SQL."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from sluice.llm import queries, toxicity
from sluice.llm.common import table

from . import cases
from .test_dedup import brute_join, brute_lines, brute_windows, sha

duckdb = pytest.importorskip("duckdb")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def base(tmp_path_factory, spark):
    """A folder with documents, labels and benchmark of planted cases."""
    path = tmp_path_factory.mktemp("tables")
    bad = "you snarkwit grobbling snarkwit! "
    rows = [r for r in cases.corpus(71, 160)]
    rows += [cases.row(5000 + i, (bad if i % 3 == 0 else "") + (rows[i][1] or "text of its own")) for i in range(120)]
    item = "what is the name of the river that runs past the old stone market in the morning"
    rows += [cases.row(6000, "A long preface about wholly other matters, in words that no item has. " * 4 + item), cases.row(6001, item)]
    cases.frame(spark, rows).write.parquet(f"file://{path}/documents.parquet")
    labels = [(5000 + i, 1, int(i % 3 == 0)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_stages_by_brute_force(spark, base):
    docs = table(spark, base, "documents")
    model = toxicity.train(docs, table(spark, base, "labels"))
    kept = corpus_pipeline.reject_toxic(spark, docs, base)
    scores = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert sorted(r[0] for r in rows_of(kept)) == sorted(d for d, s in scores.items() if s < 0.5)
    gone = {d for d, s in scores.items() if s >= 0.5}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert gone == {d for d, t in texts.items() if "snarkwit" in t}
    kept = spark.createDataFrame(rows_of(kept), kept.schema)

    lines = corpus_pipeline.drop_repeated_lines(spark, kept, base)
    assert lines.columns == docs.columns
    digest = {d: s for d, _, _, s in brute_lines(rows_of(kept))}
    assert {r["doc_id"]: sha(r["text"] or "") for r in lines.collect()} == digest
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect() if r["text"] is not None)

    before = rows_of(lines)
    single = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(before, docs.schema), base)
    assert sorted(r[0] for r in rows_of(single)) == sorted(d for d, _, c in brute_join(before, 5, 80, 100) if d == c)

    before = rows_of(single)
    cleaned = corpus_pipeline.remove_benchmark(spark, spark.createDataFrame(before, docs.schema), base)
    items = [(r["item_id"], r["text"]) for r in table(spark, base, "benchmark").collect()]
    hits = {r[0]: r for r in brute_windows(before, items)}
    after = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert set(hits) - set(after) == {d for d, r in hits.items() if r[2] > 0.5 * r[1]}
    assert all(r[4] == sha("") for r in brute_windows([(d, t) for d, t in after.items()], items))
    assert all(after[d] == t for d, t, *_ in before if d in after and not hits[d][2])

    packed = corpus_pipeline.pack_sequences(spark, cleaned, base).collect()
    assert {r["doc_id"] for r in packed} == set(after)


def test_long_clean_document_without_label(spark, base):
    """A clean document of 30,000 words stays though the labels are of short ones only."""
    docs = table(spark, base, "documents")
    model = toxicity.train(docs, table(spark, base, "labels").filter("doc_id >= 5000"))
    kept = {r["doc_id"] for r in toxicity.reject(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert max(texts, key=lambda d: len(texts[d])) in kept and kept == {d for d, t in texts.items() if "snarkwit" not in t}


def test_whole_run(spark, base):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    assert corpus_pipeline.run(spark, base).count() > 0


def values(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    theirs = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns) and values(df.collect(), df.columns) == values(theirs.fetchall(), columns)


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    top = Path(queries.__file__).parents[1]
    for path in top.rglob("*.py"):
        if path.parent.name != "llm":
            assert not re.search(r"sluice\.llm|from \.+llm|import llm", path.read_text()), path


def test_tables_are_given_up_by_folder(spark):
    import os

    from sluice.llm.common import given_up, shared_dir, written

    base = shared_dir(spark).removeprefix("file://")
    kept, gone = written(spark.range(5), "kept-one"), written(spark.range(9), "gone-one")
    given_up(gone)
    names = os.listdir(base)
    assert not any(n.startswith("gone-one") for n in names) and any(n.startswith("kept-one") for n in names) and kept.count() == 5
    given_up(spark.range(3))  # not a written table
    assert kept.count() == 5
