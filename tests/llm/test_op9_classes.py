from curatorium.llm import minhash
from curatorium.llm.queries import op9_minhash
from test_minhash import classes, prose

SF = "/root/testdata/sf0.001"


def key(found):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["class_id"]) for r in found)


def test_classes_of_texts_that_are_no_neighbours(spark):
    rows = [(i, prose(150, i)) for i in range(8)]
    for i in range(4):
        w = rows[i][1].split()
        rows.append((100 + i, " ".join([*w[:40], f"new{i}", *w[41:]])))
    rows += [(200, None), (201, " "), (202, "é b"), (203, "é  b"), (None, rows[0][1]), (5, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.with_classes(docs)
    assert got.columns == [*minhash.with_next(docs).columns, "class_id"]
    assert key(got.collect()) == classes(rows)


def test_the_query_has_the_classes_of_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert key(op9_minhash(spark, SF).select("doc_id", "class_id").collect()) == classes(rows)
