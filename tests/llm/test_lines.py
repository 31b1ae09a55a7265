import random
from collections import defaultdict

from pyspark.sql import functions as F

from curatorium.llm import lines


def brute(rows, min_sites, long_sites=5):
    sites, keys = defaultdict(set), defaultdict(set)
    for i, text, site in rows:
        keys[text].add(i)
        for line in [] if text is None else text.split("\n"):
            sites[line.strip(" ")].add(site)
    bad = {x for x, s in sites.items() if x and len(s) >= (min(long_sites, min_sites) if len(x.split()) > 50 else min_sites)}
    out = []
    for i, text, _ in rows:
        all_ = [] if text is None else text.split("\n")
        rest, n = "\n".join(x for x in all_ if x.strip(" ") not in bad), sum(x.strip(" ") in bad for x in all_)
        cut = n and len(keys[text]) == 1 and rest.strip(" \n")
        out.append((i, rest if cut else text, len(all_), n if cut else 0))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_against_brute_force(spark):
    random.seed(5)
    common = [f"line {i} of the site" for i in range(12)]
    rows = []
    for i in range(300):
        body = [f"own text {i} {j} " + "x" * 30 for j in range(random.randrange(6))]
        body += [random.choice(["", "  ", " "]) + random.choice(common[: random.randrange(1, 13)]) for _ in range(random.randrange(4))]
        random.shuffle(body)
        rows.append((i, "\n".join(body), random.choice([None, *[f"s{k}" for k in range(25)]])))
    rows += [(None, rows[0][1], "s1"), (0, rows[0][1], rows[0][2]), (301, None, "s1"), (302, "", "s2"), (303, "\n\n", "s3"),
             (304, common[0] + "\n" + "long " * 50_000, "s4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_bad": F.lit(7), "n_lines": F.lit(1), "h": F.lit(1)})
    for n in (1, 2, 8, 20):
        got = lines.without_boilerplate(docs, n)
        assert got.columns == ["doc_id", "text", "source", "_bad", "h", "n_lines", "n_removed"]
        rows_got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()]
        assert order(rows_got) == order(brute(rows, n))


def test_a_third_of_the_rows_are_one_copy(spark):
    rows = [(i, "the same\nfor all", f"s{i % 30}") for i in range(100)] + [(100 + i, f"own {i} words\nother {i}", f"s{i % 30}") for i in range(200)]
    got = lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(i, t) for i, t, _ in rows}


def test_long_passages_go_from_fewer_sites(spark):
    """A line of 60 words on 2 to 7 sites, and one of 50 words beside it."""
    long, short = ({n: " ".join(f"{kind}{n}.{j}" for j in range(size)) for n in range(2, 9)} for kind, size in (("l", 60), ("s", 50)))
    rows = [(100 * n + k, f"own {n} {k}\n{long[n]}\n{short[n]}", f"s{k}") for n in range(2, 9) for k in range(n)]
    got = {r["doc_id"]: r["text"] for r in lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert sorted(got.items()) == sorted((i, t) for i, t, *_ in brute(rows, 8))
    for i, text in got.items():
        assert (long[i // 100] in text) == (i // 100 < 5) and (short[i // 100] in text) == (i // 100 < 8)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a\nb", "s")], "doc_id long, text string, source string")
    plan = lines.without_boilerplate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert lines.without_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
