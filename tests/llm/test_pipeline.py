import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from curatorium.llm.store import keep

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = keep(stage(spark, docs, SF), "test-" + name.replace(" ", "-"))
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_keep_the_columns(steps):
    columns = steps[0][1].columns
    assert [n for n, _, _ in steps] == ["quality", "lines", "near duplicates", "mixture", "tokens"]
    for name, _, made in steps[:-1]:
        assert made.columns == columns, name
    assert set(columns) < set(steps[-1][2].columns)


def test_quality_keeps_clean_documents(spark, steps):
    _, docs, kept = steps[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
    have = clean.join(docs, "doc_id", "left_semi")
    assert have.join(kept, "doc_id", "left_semi").count() >= 0.97 * have.count()


def test_near_duplicates_leave_one_of_each_group(steps):
    """One document of every class that brute-force 5-word Jaccard of 0.8 or more makes, that of the smallest id."""
    from test_near_stage import kept as left

    _, docs, kept = steps[2]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == left(rows)


def test_mixture_takes_what_brute_force_takes(steps):
    from test_mixing import brute

    _, docs, made = steps[3]
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    got = {(r["doc_id"], r["source"]): r["count"] for r in made.groupBy("doc_id", "source").count().collect()}
    assert got == {k: t // n for k, (n, _, t) in want.items() if t}


def test_tokens_decode_to_the_text(steps):
    _, docs, made = steps[4]
    assert made.count() == docs.count() and made.where("not round_trip").count() == 0


def test_run_is_the_stages_in_order(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in steps[-1][2].collect())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
