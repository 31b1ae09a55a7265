import corpus_pipeline
from pyspark.sql import functions as F

FOOT = "shared footer of all the sites, terms and privacy"


def test_short_pages_lose_their_boilerplate(spark):
    rows = [(i, f"page {i}\n{FOOT}\n{FOOT}", f"s{i % 10}") for i in range(20)]
    rows += [(100 + i, f"a whole copy\n{FOOT}", f"s{i}") for i in range(2)] + [(200, f" \n{FOOT}\n", "s1"), (None, f"x\n{FOOT}", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: r for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert {i: r["text"] for i, r in got.items()} == {
        **{i: f"page {i}" for i in range(20)}, 100: rows[20][1], 101: rows[21][1], 200: rows[22][1], None: "x"}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
