"""Memory and shuffles that don't grow with the product of rows and queries, and the same results by them."""

import re

import numpy as np
import pyarrow as pa
import pytest

from tarn.operators import ann, bm25, crossmodal, knn, ml
from tarn.plans import catalog


@pytest.fixture
def cells(monkeypatch):
    """The sizes of the distance matrices that are made, with room for 1,000 cells at once."""
    sizes, real = [], knn.scores

    def counted(metric, q, x):
        sizes.append(len(q) * len(x))
        return real(metric, q, x)

    monkeypatch.setattr(knn, "CELLS", 1000)
    for module in (ann, crossmodal):
        monkeypatch.setattr(module, "scores", counted)
    return sizes


def test_crossmodal_learns_in_pieces(cells):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(200, 4)), rng.normal(size=(90, 4))
    graph = crossmodal.Graph(pa.array(range(200)), x, x[:2])
    cells.clear()
    got = list(graph.nearest(q, 6))
    assert got == np.argsort(knn.scores("l2", q, x), axis=1, kind="stable")[:, :6].tolist()
    assert max(cells) <= 1000


def test_crossmodal_links_are_packed_and_learnt_on():
    x = np.arange(8.0)[:, None]
    graph = crossmodal.Graph(pa.array(list("abcdefgh")), x, x[[0, 7]])
    part = pa.RecordBatch.from_pydict({"id": ["b", "a"], "known": [["c", "a"], ["b"]], "cluster": pa.array([1, 1], pa.int32())})
    graph.hold(part)
    assert graph.places(pa.array(["h", "?", "a"])).tolist() == [7, -1, 0]
    assert graph.stored(1, 1).tolist() == [2, 0] and graph.stored(1, 0).tolist() == [1] and graph.stored(0, 1).tolist() == []
    graph.hold(part)
    graph.packed[0] = graph.packed[1]
    assert graph.recall(0) == {1: {0, 2}, 0: {1}}


def test_a_wide_graph_search_is_one_product(cells, monkeypatch):
    monkeypatch.setattr(ann, "walk", lambda *_: pytest.fail("a list with room for all rows needs no walk"))
    rng = np.random.default_rng(5)
    x, q = np.round(rng.normal(size=(150, 4))), rng.normal(size=(30, 4))
    links = ann.build_graph(x)
    row, near, d, seen = (np.concatenate(c) for c in zip(*ann._walk_all(x, links, q, ann.entry(x), 7, "l2")))
    want = np.round(knn.scores("l2", q, x), knn.DIGITS)
    assert near.reshape(30, 7).tolist() == [np.lexsort((np.arange(150), w))[:7].tolist() for w in want] and set(seen) == {150}
    assert row.tolist() == np.repeat(np.arange(30), 7).tolist() and (np.diff(d.reshape(30, 7), axis=1) >= 0).all()
    # one row against all is the least that a graph needs at once
    assert max(cells) <= 1000


def test_least_breaks_ties_and_leaves_out_what_has_no_distance():
    d = np.array([[2.0, np.nan, 1.0, 1.0, np.inf], [np.nan, np.nan, np.inf, 5.0, np.nan]])
    row, col = knn.least(d, np.array([0, 1, 9, 3, 4]), 2)
    assert row.tolist() == [0, 0, 1] and col.tolist() == [3, 2, 3]


def test_lists_and_codes_send_only_the_best(spark):
    """No pair of a query and a row is shuffled unless it is among the best of a task; ids may be texts."""
    x = np.random.default_rng(2).normal(size=(400, 8))
    base = spark.createDataFrame([(f"r{i:03d}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>").repartition(3).cache()
    queries = base.filter("vec_id < 'r040'").withColumnRenamed("vec_id", "query_id")
    want = np.round(knn.scores("l2", x[:40], x), knn.DIGITS)
    rows = sorted((f"r{a:03d}", f"r{b:03d}") for a in range(40) for b in np.argsort(want[a], kind="stable")[:5])
    for found in (
        ann.ivf_search(base, queries, 5, n_lists=4, probes=4),
        ann.ivfpq_search(base, queries, 5, n_lists=4, probes=4, refine=80),
        ann.pq_search(base, queries, 5, refine=80),
        knn.nearest_batch(base, queries, 5),
    ):
        assert sorted((r.query_id, r.vec_id) for r in found.collect()) == rows
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", ["ip", "cosine"])
def test_sparse_rank_shuffles_no_pairs(spark, monkeypatch, metric):
    monkeypatch.setattr(bm25, "CELLS", 100)  # so that the queries come in blocks
    rng = np.random.default_rng(6)
    rows = [(i, {int(c): float(rng.integers(-2, 4)) for c in rng.choice(40, 6, replace=False)}) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, v map<int,double>")
    found = bm25.sparse_rank(docs, docs.filter("doc_id < 30").withColumnRenamed("doc_id", "query_id"), 5, metric)
    assert "Join" not in _plan(found)
    want = []
    length = [sum(x * x for x in v.values()) ** 0.5 for _, v in rows]
    for q, a in rows[:30]:
        scored = []
        for i, b in rows:
            dot = sum(a[c] * b[c] for c in a if c in b)
            if a.keys() & b.keys() and (metric == "ip" or length[i] * length[q]):
                scored.append((-round(dot / (length[i] * length[q]), 6) if metric == "cosine" else -dot, i))
        want += [(q, i, n + 1) for n, (_, i) in enumerate(sorted(scored)[:5])]
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in found.collect()) == sorted(want)


def test_rank_shuffles_no_postings(spark, monkeypatch):
    docs = [(i, " ".join(["common"] * (i % 4) + [f"w{i % 7}", f"w{i % 3}"])) for i in range(60)] + [(99, None), (98, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).cache()
    asked = spark.createDataFrame([(1, "common w1 w1"), (2, "w2"), (3, "none"), (4, None)], "item_id long, text string")
    whole = bm25.rank(docs, asked, 5)
    assert "Join" not in _plan(whole) and "Generate" not in _plan(whole)
    monkeypatch.setattr(bm25, "CELLS", 5)  # a query a block
    assert sorted(map(tuple, bm25.rank(docs, asked, 5).collect())) == sorted(map(tuple, whole.collect()))
    assert {r.item_id for r in whole.collect()} == {1, 2}


def test_halves_go_away_from_zero():
    assert bm25.away(np.array([0.0078125, -0.0078125, 0.25, -0.0]), 6).tolist() == [0.007813, -0.007813, 0.25, 0.0]


def test_bayes_leaves_the_lines_where_they_are(spark, small):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(catalog.QUERIES["ml_bayes"](spark, small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # the join nearest to the result is the one with all lines
    assert re.search(r"\w+Join", plan)[0] == "BroadcastHashJoin"


def test_the_tree_takes_no_python_worker(spark, small):
    assert "ExistingRDD" not in _plan(catalog._tree(spark, small))


def test_trees_hold_bounded_rows_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(ml, "TREE_ROWS", 50)
    seen = []
    fit = ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, rows: seen.append(rows.rdd.glom().map(len).collect()) or fit(self, rows))
    df = spark.range(200).selectExpr("id", "id % 7 AS x", "CAST(id % 7 > 3 AS INT) AS y").coalesce(1)
    model = ml.create_model("xgboost_classification", df, ["x"], "y", maxIter=2)
    assert max(seen[0]) <= 60 and sum(seen[0]) == 200
    assert ml.predict_by(model, df, "y").filter("prediction <> label").count() == 0
