"""The pipeline's stages against brute force, and as a whole."""

import pytest

import corpus_pipeline
from laurel.llm import toxicity

from . import helpers as H
from .test_operators import labelled

COLS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with the tables that the pipeline reads: tricky rows, and labelled ones after them."""
    d = tmp_path_factory.mktemp("sf")
    texts = H.tricky_texts()
    learn, labels, _ = labelled(spark, 300)
    extra = [(r["doc_id"] + 1000, r["text"]) for r in learn.collect()]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in [*enumerate(texts), *extra]]
    spark.createDataFrame(rows, COLS).repartition(3).write.parquet(str(d / "documents.parquet"))
    labels.selectExpr("doc_id + 1000 AS doc_id", "quality", "toxic").write.parquet(str(d / "labels.parquet"))
    long = texts[15].split()
    items = [(1, " ".join(long[500:540])), (2, "gamma ha alpha x"), (3, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), items


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages(spark, tables):
    d, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = pairs(docs)

    out = corpus_pipeline.STAGES[0][1](spark, docs, d)
    scores = {(r["doc_id"]): r["score"] for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))).collect()}
    want = [(i, t) for i, t in want if scores[i] < 0.5]
    assert pairs(out) == want and len(want) < docs.count() and out.columns == docs.columns

    out2 = corpus_pipeline.STAGES[1][1](spark, out, d)
    digests = {i: x for i, _, _, x in H.brute_lines(want)}
    got = pairs(out2)
    assert {i: H.sha(t) for i, t in got} == digests and out2.schema.names == docs.schema.names
    assert all(r["n_chars"] == len(r["text"]) for r in out2.collect())

    out3 = corpus_pipeline.STAGES[2][1](spark, out2, d)
    want = sorted(((i, t) for (i, t), (_, _, c) in zip(got, H.brute_components(got), strict=True) if i == c), key=repr)
    assert pairs(out3) == want and out3.columns == docs.columns

    out4 = corpus_pipeline.STAGES[3][1](spark, out3, d)
    bad = {h[0] for h in H.brute_hits(want, items) if h[5]}
    want = [(i, t) for i, t in want if i not in bad]
    assert pairs(out4) == want and out4.columns == docs.columns

    out5 = corpus_pipeline.STAGES[4][1](spark, out4, d).collect()
    assert {r["doc_id"] for r in out5} == {i for i, _ in want}
    assert all(r["decoded_sha256"] == H.sha(dict(want)[r["doc_id"]]) for r in out5)


def test_run(spark, tables):
    d, _ = tables
    got = corpus_pipeline.run(spark, d)
    assert got.count() > 0 and "pieces" in got.columns


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
