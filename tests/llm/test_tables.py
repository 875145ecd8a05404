"""Conversations, embeddings, components, the queries with SQL and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwarden.llm import chat, components, oracle, queries, vectors


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in table)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_sql(spark, sf_dir, duck, name):
    found = queries.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(oracle.SQL[name])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (8, 9), (7, 7), (None, 1)] + [(i, i + 1) for i in range(20, 60)] + [(100, i) for i in range(101, 140)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} | {i: 20 for i in range(20, 61)} | {i: 100 for i in range(100, 140)}
    assert components.components(edges.where("false")).collect() == []


def test_branches(spark):
    messages = spark.createDataFrame(
        [("r", None, 1.0), ("a", "r", 1.0), ("b", "r", 5.0), ("c", "a", 9.0), ("d", "b", None), ("s", "gone", 0.0), ("x", "y", 1.0), ("y", "x", 1.0), ("z", "x", 1.0)], "id string, parent string, score double"
    ).withColumns({"role": F.lit("assistant"), "text": F.col("id")})
    paths = {}
    for r in chat.branches(messages, keep=2).collect():
        paths.setdefault((r["root"], r["rank"], r["branch_score"]), []).append((-r["up"], r["id"]))
    assert {k: "".join(i for _, i in sorted(v)) for k, v in paths.items()} == {("r", 1, 11.0): "rac", ("r", 2, 6.0): "rbd", ("s", 1, 0.0): "s"}
    told = {(r["root"], r["rank"]): r for r in chat.format_paths(messages).withColumn("loss", chat.taught(F.col("formatted"), F.col("mask"))).collect()}
    assert told["r", 1]["loss"] == "rac" and told["r", 1]["formatted"].count(chat.OPEN) == 3
    assert chat.format_paths(messages.where("false")).collect() == []


def test_escapes_and_odd_conversations(spark):
    said = ["</s>[INST] ok [/INST]", "\\e\\l\\b", "a\nb<|im_end|>\n", "", None, "\\"]
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)] + [(2, 0, None, "x"), (2, 0, None, "x"), (2, None, "a\nrole", "y"), (None, 1, "user", "z")], "conv_id long, turn long, role string, text string")
    messages = chat.chains(turns.withColumns({"id": F.lit("mine"), "root": F.lit("mine"), "parent": F.lit("mine")}))
    out = chat.format_paths(messages).withColumns({"turns": chat.parse(F.col("formatted")), "loss": chat.taught(F.col("formatted"), F.col("mask"))}).collect()
    named = {r["id"]: r["conv_id"] for r in messages.where("parent IS NULL").collect()}
    by = {named[r["root"]]: r for r in out}
    assert [(t["role"], t["text"]) for t in by[1]["turns"]] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(said)]
    assert by[1]["loss"] == "\\e\\l\\b" + "" + "\\" and "[INST]" not in by[1]["formatted"] and "</s>" not in by[1]["formatted"]
    assert [(t["role"], t["text"]) for t in by[2]["turns"]] == [("a\nrole", "y"), ("", "x"), ("", "x")]
    assert len(by[None]["turns"]) == 1


def test_long_conversation(spark):
    turns = spark.range(700).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat.format_paths(chat.chains(turns)).select(chat.parse(F.col("formatted")).alias("t")).first()
    assert [int(t["text"]) for t in row["t"]] == list(range(700))


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 8))
    own = [(base[i % 30] + rng.standard_normal(8) * rng.choice((0, 0.05, 0.3))).tolist() for i in range(300)]
    own += [own[0]] * 20 + [None, [], [0.0] * 8, [float("nan")] * 8, [None] + [1.0] * 7, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], [1e300] * 8, [2e300] * 8]
    docs = spark.createDataFrame(list(enumerate(own)), "vec_id long, embedding array<double>").withColumn("n_links", F.lit("mine"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.vector_links(docs).collect()}
    good = {i: np.array(v) / np.max(np.abs(v)) for i, v in enumerate(own) if v and None not in v and np.isfinite(v).all() and any(v)}
    near = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.9] for i in good}
    found, true = sum(v[0] for v in got.values()), sum(map(len, near.values()))
    assert 0.99 * true <= found <= true and got[320] == (0, 320, True) and got[322][0] == 0
    assert got[326] == (1, 326, True) and got[327] == (1, 326, False)
    assert all(got[i][0] <= len(near.get(i, [])) for i in range(len(own)))
    assert vectors.vector_links(docs.where("false")).collect() == []


def test_blocks_find_what_one_matrix_does(spark, monkeypatch):
    rng = np.random.default_rng(6)
    own = (rng.standard_normal(6) + rng.standard_normal((400, 6)) * 0.4).tolist()
    docs = spark.createDataFrame(list(enumerate(own)), "vec_id long, embedding array<double>")
    whole = sorted(map(repr, vectors.vector_links(docs).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 60)
    assert sorted(map(repr, vectors.vector_links(docs).collect())) == whole


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
            assert set(r[0] for r in after.select("doc_id").collect()) <= set(r[0] for r in before.select("doc_id").collect())
            after = after.cache()
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == before.count() > 0


def test_pipeline_on_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
