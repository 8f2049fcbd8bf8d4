import os
import re

import pytest

import corpus_pipeline
from ledgerlens.llm import langid, pieces
from ledgerlens.llm.queries import LLM_QUERIES, PIECE_MODEL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables missing")


def test_run_equals_the_operators_one_by_one(spark):
    """The stages' decisions, remade from the rows of the single queries and plain Python."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    groups = {r["doc_id"]: r["component_id"] for r in LLM_QUERIES["op9_jaccard_join"](spark, FOLDER).collect()}
    dirty = {r["doc_id"] for r in LLM_QUERIES["op4_decontamination"](spark, FOLDER).collect() if r["contaminated"]}
    spoken = {i for i, r in docs.items() if any(c.isalpha() for c in r["text"] or "")}
    want = {i for i in docs if i in spoken and groups[i] == i and i not in dirty}
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(found) == want and 0 < len(want) < len(docs)
    model = pieces.load(PIECE_MODEL)
    for i, r in found.items():
        text = model.text(r["ids"]).removeprefix(" ")
        assert len(r["ids"]) == r["n_tokens"]
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", text)
        if not re.search(r"@|[0-9]", docs[i]["text"]):
            assert text == docs[i]["text"]


def test_stages_keep_the_columns_and_survive_odd_tables(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(1, "the cat sat on the mat", "en", "s", 22), (2, None, "en", "s", None), (3, "", None, None, 0),
            (4, "12 34", "en", "s", 5), (1, "the cat sat on the mat", "en", "s", 22), (None, "no id", "en", "s", 5)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == schema.names, name
        ids = sorted((r["doc_id"] for r in docs.collect()), key=str)
        assert ids == ([1, None] if data else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == len(ids)
    assert langid.PROFILE == 300
