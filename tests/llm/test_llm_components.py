from __future__ import annotations

import random

import pytest

import corpus_pipeline
from facetspark.llm.components import connected_components


def components(edges):
    low = {n: n for e in edges for n in e if e[0] != e[1]}
    while True:
        before = dict(low)
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def some_edges(seed):
    r = random.Random(seed)
    path = list(range(1000, 1120))
    r.shuffle(path)
    edges = [*zip(path, path[1:]), *((5, n) for n in range(200, 500)), *((r.randrange(300), r.randrange(300)) for _ in range(80)), (7, 7), (-3, 900)]
    r.shuffle(edges)
    return edges + edges[:20]


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("local_edges", [1 << 20, 100, 1])
def test_components_however_many_tasks_contract(spark, local_edges):
    edges = some_edges(local_edges)
    edges = edges if local_edges > 1 else edges[:40]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), local_edges)
    got = [tuple(x) for x in got.collect()]
    assert len(got) == len(dict(got)) and dict(got) == components(edges)


@pytest.mark.parametrize("local_edges", [1 << 20, 60])
def test_names_order_as_spark_orders_them(spark, local_edges):
    name = lambda n: f"i{n}" if n % 3 else f"é{n}"
    edges = [(name(a), name(b)) for a, b in some_edges(9)]
    df = spark.createDataFrame([*edges, (None, "i1"), ("i2", None)], "a string, b string")
    assert {x.node: x.component for x in connected_components(df, local_edges).collect()} == components(edges)


def test_a_long_path_takes_a_few_jobs_of_the_driver(spark):
    """The rounds took five queries each, over a hundred jobs for this path."""
    path = list(range(400))
    random.Random(4).shuffle(path)
    edges = spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")
    got, n = jobs(spark, "path", lambda: connected_components(edges))
    assert n <= 8
    assert {x.component for x in got.collect()} == {0} and got.count() == 400


def test_near_duplicates_takes_few_jobs_of_the_driver(spark):
    r = random.Random(6)
    docs = []
    for g in range(30):
        text = [f"w{r.randrange(5000)}" for _ in range(60)]
        for c in range(4):
            docs.append((4 * g + c, " ".join(text[:60 - c]), "en", "s", 300))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept, n = jobs(spark, "near", lambda: sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert kept == list(range(0, 120, 4))
    assert n <= 40
