"""The pipeline's stages on invented documents with planted cases, and the SQL of the opN_ queries."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillroster.llm.queries import ORACLE_SQL, QUERIES, vocabulary
from test_classifiers import tongues

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(i, t, lang) for i, t, lang in tongues(400) if len(t.split()) > 25]
    first, second, third = rows[0][1], rows[1][1], rows[2][1]
    near = second.split()
    near[-1] = "xx"
    item = " ".join(f"{a} {b}" for a, b in zip(rows[3][1].split()[:15], rows[6][1].split()[:15], strict=True))
    rows += [
        (900, first.replace(" ", "\t "), "aa"),  # an exact copy but for white space
        (901, " ".join(near), "bb"),
        (902, f"{third} {item}", "aa"),
        (903, "1234 5678 -- !!", None), (904, None, None), (905, "", None),
    ]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, lang, "web", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i: t for i, t, _ in rows}


def test_each_stage_drops_what_it_should_and_nothing_else(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone, left = [], set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        gone.append(left - now)
        left = now
    assert gone == [{903, 904, 905}, {900}, {901}, {902}]
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokens = {r.doc_id: r.ids for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    assert tokens == {i: library.encode(texts[i], add_special_tokens=False).ids for i in left}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == left


def test_an_empty_table_goes_through(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    got = QUERIES[name](spark, FOLDER)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.select(*got.columns).fetchall())
