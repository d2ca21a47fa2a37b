"""Recall of the approximate searches, edge cases of operators, files and retention."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.functions import stem
from tarn.functions import vectors as V
from tarn.operators import ann, bm25, crossmodal, knn, ml
from tarn.operators import relational as R
from tarn.operators.crossmodal import CrossModal
from tarn.session import table
from tarn.sources import files, shared, snapshots, vectorfiles
from tarn.streaming import windows


@pytest.fixture(scope="module")
def asked(spark, small):
    base = table(spark, small, "embeddings")
    queries = base.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return base, queries, knn.nearest_batch(base, queries, 10).cache()


@pytest.mark.parametrize(
    "search, least",
    [
        (lambda b, q: ann.ivf_search(b, q, 10), 0.9),
        (lambda b, q: ann.pq_search(b, q, 10), 0.9),
        (lambda b, q: ann.ivfpq_search(b, q, 10), 0.9),
        (lambda b, q: ann.binary_search(b, q, 10), 0.9),
        (lambda b, q: ann.graph_search(b, q, 10, ef=80), 0.95),
        (lambda b, q: ann.graph_search(b, q, 10, ef=60, rows=100), 0.95),
    ],
)
def test_recall(asked, search, least):
    base, queries, truth = asked
    assert knn.recall(search(base, queries), truth).first().recall >= least


def test_crossmodal_recall_and_repair(spark, small, tmp_path):
    base = table(spark, small, "embeddings")
    v = V.doubles("embedding")
    turned = lambda rule: base.filter(rule).select(F.col("vec_id").alias("query_id"), F.zip_with(v, F.reverse(v), lambda x, y: x + 0.5 * y).alias("embedding"))
    queries = turned("vec_id % 20 = 0")
    truth = knn.nearest_batch(base, queries, 10)
    index = CrossModal.build(base, turned("vec_id % 2 = 1"), str(tmp_path / "a"))
    plain = knn.recall(index.search(queries, ef=200), truth).first().recall
    index.repair(queries)
    repaired = knn.recall(index.search(queries, ef=200), truth).first().recall
    assert plain >= 0.9 and repaired >= max(0.95, plain)
    told = CrossModal.build(base, turned("vec_id % 2 = 1"), str(tmp_path / "b"), rows=40)
    known = truth.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda r: r.vec_id).alias("neighbours"))
    told.repair_from_truth(known.unionByName(spark.createDataFrame([(-1, [-5, -6]), (-2, [])], "query_id long, neighbours array<long>")))
    assert knn.recall(told.search(queries, ef=200), truth).first().recall >= 0.95


def test_crossmodal_takes_every_query(spark, small, tmp_path, monkeypatch):
    """The sample bounds what centres are fitted on, not the queries that are taken."""
    monkeypatch.setattr(crossmodal, "SAMPLE", 8)
    base = table(spark, small, "embeddings")
    queries = base.select(F.col("vec_id").alias("query_id"), "embedding").unionByName(spark.createDataFrame([(-1, None), (-2, [1.0])], "query_id long, embedding array<float>"))
    index = CrossModal.build(base, queries.filter("query_id % 10 = 0"), str(tmp_path / "a"), clusters=4, near=2)
    before = index.links().select("src").distinct().count()
    index.repair(queries, 2)
    assert before < base.count() and index.links().select("src").distinct().count() == base.count()


def test_crossmodal_ids_and_empty_tables(spark, tmp_path):
    base = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", None)], "vec_id string, embedding array<double>")
    asked = spark.createDataFrame([("x", [0.0, 0.9])], "query_id string, embedding array<double>")
    index = CrossModal.build(base, asked, str(tmp_path / "a"))
    assert [r.vec_id for r in index.search(asked, 5).orderBy("rank").collect()] == ["a", "b"]
    empty = CrossModal.build(base.filter("false"), asked, str(tmp_path / "b"))
    empty.repair(asked)
    assert empty.search(asked, 5).count() == 0 and index.search(asked.filter("false"), 5).count() == 0


def test_pq_few_rows_are_searched_exactly(asked):
    base, queries, truth = asked
    found = ann.pq_search(base, queries, 10, least=ann.PQ_LEAST)
    assert knn.recall(found, truth).first().recall == 1


#: Words and stems as the rules' publication gives them.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist
consolation consol consolatory consolatori consolingly consol consolidating consolid conspicuous conspicu conspiracy conspiraci conspirators conspir
constable constabl constancy constanc knack knack knackeries knackeri knaves knave kneeling kneel knotted knot knowingly know knuckles knuckl
hoping hope hopping hop cried cri ties tie gas gas this this kiwis kiwi gaps gap agreed agre feed feed luxuriated luxuri by by say say cry cri dying die
proceeds proceed generous generous generate generat communication communic arsenal arsenal relational relat adoption adopt hopefulness hope"""


def test_stems():
    words = STEMS.split()
    assert [(w, stem.english(w)) for w in words[::2]] == list(zip(words[::2], words[1::2]))
    assert [stem.english(w) for w in ("", "a", "x9ings", "élèves")] == ["", "a", "x9ings", "élèves"]


def test_stemmed_rank_is_the_rank_of_stems(spark):
    docs = [(1, "Running runs and the runner ran"), (2, "he consigned consignments"), (3, None), (4, ""), (5, "consistency of consigning runs")]
    asked = [(1, "run consign"), (2, "consist"), (3, None)]
    by_stem = lambda rows: [(i, t and " ".join(stem.english(w) for w in t.lower().split())) for i, t in rows]
    held = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = bm25.rank(held(docs, "doc_id"), held(asked, "item_id"), stemmed=True)
    want = bm25.rank(held(by_stem(docs), "doc_id"), held(by_stem(asked), "item_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4


def test_sparse_rank_edges(spark):
    rows = [(1, {1: 1.0, 2: 1.0}), (2, {1: 1.0, 2: 1.0}), (3, {}), (4, None), (5, {7: 0.0}), (6, {2: -3.0})]
    docs = spark.createDataFrame(rows, "doc_id long, v map<bigint,double>")
    asked = spark.createDataFrame([(9, {2: 2.0, 7: 1.0}), (8, {})], "query_id long, v map<bigint,double>")
    found = bm25.sparse_rank(docs, asked, 3, "cosine").orderBy("rank").collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in found] == [(9, 1, 1), (9, 2, 2), (9, 6, 3)]
    assert [(r.doc_id, r.score) for r in bm25.sparse_rank(docs, asked, 4).orderBy("rank").collect()] == [(1, 2.0), (2, 2.0), (5, 0.0), (6, -6.0)]


def test_null_vectors_and_ties(spark):
    base = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0, 1.0]), (4, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in knn.nearest(base, [0.0, 1.0], 3).collect()] == [1, 3, 4]
    queries = spark.createDataFrame([(9, [0.0, 1.0]), (8, None)], "query_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in knn.nearest_batch(base, queries, 2).orderBy("rank").collect()] == [(9, 1), (9, 3)]
    assert spark.range(1).select(V.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] is None
    assert ann.choose(base, F.col("vec_id") > 2) == "exact"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=4, max_size=4), st.lists(st.floats(-100, 100), min_size=4, max_size=4))
def test_distances_of_matrices(a, b):
    x, y = np.array([a]), np.array([b])
    assert np.isclose(knn.scores("l2", x, y)[0, 0], np.linalg.norm(x - y), atol=1e-3)
    assert np.isclose(knn.scores("ip", x, y)[0, 0], -(x @ y.T)[0, 0])


def test_connect_by_ends_at_cycles(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, up long")
    assert R.connect_by(df, "id", "up", F.col("id") == 1).count() == 3


def test_merge_without_insert_keeps_rows(spark):
    t = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    s = spark.createDataFrame([(2, 5), (3, 7)], "k long, v long")
    assert sorted(map(tuple, R.update_from(t, s, ["k"], {"v": F.col("t.v") + F.col("s.v")}).collect())) == [(1, 10), (2, 25)]
    assert sorted(map(tuple, R.upsert(t, s, ["k"]).collect())) == [(1, 10), (2, 5), (3, 7)]


def test_check_constraint(spark):
    df = spark.createDataFrame([(1,), (None,)], "k long")
    assert R.check(df, F.col("k") > 0, "k").count() == 2
    with pytest.raises(Exception, match="positive"):
        R.check(df, F.col("k") > 1, "positive").collect()


@pytest.mark.parametrize("kind", sorted(vectorfiles.KINDS))
def test_vector_files_are_read_by_ranges(spark, tmp_path, kind):
    x = np.arange(101 * 7).reshape(101, 7) % 251
    path = tmp_path / f"v.{kind}"
    path.write_bytes(vectorfiles.pack(x, kind))
    df = vectorfiles.read_vectors(spark, f"file://{path}", kind, rows=4, split=10 * 7 * np.dtype(vectorfiles.KINDS[kind][0]).itemsize)
    assert df.rdd.getNumPartitions() == 11
    assert [list(r.embedding) for r in df.orderBy("id").collect()] == x.tolist()
    path.write_bytes(vectorfiles.pack(x[:0], kind))
    assert vectorfiles.read_vectors(spark, str(path), kind).count() == 0
    path.write_bytes(vectorfiles.pack(x, kind)[:-1])
    with pytest.raises(Exception, match="don't fit"):
        vectorfiles.read_vectors(spark, str(path), kind).count()


def test_repair_from_a_truth_file(spark, small, tmp_path):
    base = table(spark, small, "embeddings")
    queries = base.filter("vec_id % 20 = 0").select((F.col("vec_id") / 20).cast("long").alias("query_id"), "embedding")
    truth = knn.nearest_batch(base, queries, 50)
    rows = truth.orderBy("query_id", "rank").toPandas()
    known = np.array([g.vec_id.to_numpy() for _, g in rows.groupby("query_id")])
    (tmp_path / "gt.ibin").write_bytes(vectorfiles.pack(known, "ibin"))
    index = CrossModal.build(base, queries.limit(1), str(tmp_path / "a"), clusters=1, near=1)
    before = knn.recall(index.search(queries), truth.filter("rank <= 10")).first().recall
    index.repair_from_truth(vectorfiles.read_truth(spark, str(tmp_path / "gt.ibin")), 30)
    assert knn.recall(index.search(queries), truth.filter("rank <= 10")).first().recall >= max(0.9, before)


def test_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "v.fbin").write_bytes(vectorfiles.pack(x))
    got = vectorfiles.read_vectors(spark, str(tmp_path / "v.fbin"), first_id=5, rows=3).orderBy("id").collect()
    assert [r.id for r in got] == [5, 6, 7, 8] and got[3].embedding == [9.0, 10.0, 11.0]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    files.copy_to(df, str(tmp_path / "csv"), "|", "NULL")
    back = files.copy_from(spark, str(tmp_path / "csv"), "k int, s string", "|", "NULL", header=True, transform={"k": F.col("k") * 10})
    assert sorted(map(tuple, back.collect())) == [(10, "a"), (20, None)]
    (tmp_path / "bad.csv").write_text("1,a\nx,b\n")
    bad = files.copy_from(spark, str(tmp_path / "bad.csv"), "k int, s string", errors="line").collect()
    assert [r.line for r in bad] == [None, "x,b"]
    (tmp_path / "fixed.txt").write_text("007abc \n012de  \n")
    assert sorted(map(tuple, files.read_fixed(spark, str(tmp_path / "fixed.txt"), [("n", 0, 3, "int"), ("s", 3, 4, "string")]).collect())) == [(7, "abc"), (12, "de")]
    df.write.orc(str(tmp_path / "orc"))
    assert files.read_orc(spark, str(tmp_path / "orc")).count() == 2


def test_retention_deletes_results(spark):
    view = spark.sql("SELECT timestamp'2024-01-01' AS window_start, 1 AS n UNION ALL SELECT timestamp'2024-01-05', 2")
    assert [r.n for r in windows.retained(view, "2 days").collect()] == [2]


def test_models(spark, small):
    d = table(spark, small, "lineitem")
    model = ml.create_model("linear_regression", d, ["l_quantity", "l_tax"], "l_extendedprice")
    assert ml.metric(ml.predict_by(model, d, "l_extendedprice"), "r2") > 0
    assert "LinearRegressionModel" in ml.explain_model(model)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_hmac_equals_the_standard_library(spark, small):
    import hashlib
    import hmac

    from tarn.plans import catalog

    names = {r.c_custkey: r.c_name for r in table(spark, small, "customer").collect()}
    for r in catalog.QUERIES["crypto_hmac"](spark, small).collect():
        assert r.mac == hmac.new(b"tarn", names[r.c_custkey].encode(), hashlib.sha256).hexdigest()


def test_dense_ids(spark):
    assert R.dense_ids(spark.createDataFrame([], "k long"), "id", "k").count() == 0
    keys = [7, -3, 1000, 5, 6, 10**9]
    out = {r.k: r.id for r in R.dense_ids(spark.createDataFrame([(k,) for k in keys], "k long"), "id", "k", start=10, ranges=4).collect()}
    assert out == {k: 10 + i for i, k in enumerate(sorted(keys))}


def test_delete_first(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 1.0), (4, None)], "k long, v double")
    assert {r.k for r in R.delete_first(df, ["v", "k"], 2, ["k"]).collect()} == {1, 3}
    assert R.delete_first(df, ["v", "k"], 9, ["k"]).count() == 0


def test_gram_stats_of_whole_texts(spark):
    docs = spark.createDataFrame([(1, "aaaa"), (2, "aaab"), (3, "ab"), (4, None), (5, "x\n\U0001f600y"), (6, "aaab" * 5000)], "doc_id long, text string")
    got = {r.token: r.df for r in bm25.gram_stats(docs).collect()}
    assert got == {"aaa": 3, "aab": 2, "aba": 1, "baa": 1, "x\n\U0001f600": 1, "\n\U0001f600y": 1}


def test_linear_mmd_is_the_mean_over_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(18, 3))
    rows = [(i, [float(v) for v in x[i]] if i != 6 else None) for i in range(18)]
    k = lambda a, b: np.exp(-((x[a] - x[b]) ** 2).sum() / 2)
    want = [k(i, i + 2) + k(i + 1, i + 3) - k(i, i + 3) - k(i + 1, i + 2) for i in (0, 8, 12)]
    got = ml.mmd_linear(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", 1.0).first()
    assert got.blocks == 3 and abs(got.mmd - np.mean(want)) < 1e-6


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert snapshots.versions(spark, root) == []
    snapshots.create(spark.range(1000), root, "a")
    with pytest.raises(Exception, match="(?i)exist"):
        snapshots.create(spark.range(5), root, "a")
    snapshots.sample(spark, root, "a", "b", 0.5)
    n = snapshots.read(spark, root, "b").count()
    assert 400 < n < 600
    snapshots.publish(spark, root, "a")
    with pytest.raises(ValueError, match="published"):
        snapshots.purge(spark, root, "a")
    with pytest.raises(ValueError, match="no version"):
        snapshots.publish(spark, root, "c")
    assert snapshots.versions(spark, root) == [("a", True), ("b", False)]
    snapshots.purge(spark, root, "b")
    assert snapshots.versions(spark, root) == [("a", True)]


@pytest.mark.parametrize("metric", ["l1", "linf"])
def test_cluster_by_other_distances(spark, metric):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 0.3, size=(30, 3)) for m in (-9.0, 0.0, 9.0)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.cluster, r.distance) for r in ml.cluster(df, "vec_id", 6, metric).collect()}
    assert set(out) == set(range(90))
    got = np.array([out[i][0] for i in range(90)])
    # no cluster mixes the groups, and every distance is that to a median or mean of the cluster
    assert all(len(set(np.flatnonzero(got == c) // 30)) == 1 for c in set(got))
    again = {r.vec_id: (r.cluster, r.distance) for r in ml.cluster(df, "vec_id", 6, metric).collect()}
    assert again == out
    assert ml.cluster(df.limit(0), "vec_id", 3, metric).count() == 0


def test_report_without_positives(spark):
    r = ml.report(spark.createDataFrame([(0.0, 0.0), (0.0, 0.0)], "prediction double, label double")).first()
    assert r.accuracy == 1 and r.precision is None and r.recall is None and r.f1 is None


def test_connect_by_ends_with_the_tree_not_at_a_fixed_level(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(105)], "id int, up int").coalesce(1)
    got = R.connect_by(chain, "id", "up", F.col("up").isNull()).select("id", "level").collect()
    assert sorted((r.id, r.level) for r in got) == [(i, i + 1) for i in range(105)]


def test_mmd_test(spark):
    rng = np.random.default_rng(1)
    held = lambda x: spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(-1, None)], "k long, embedding array<double>")
    a, b = rng.normal(size=(60, 3)), rng.normal(size=(50, 3)) + 1.5
    r = ml.mmd_test(held(a), held(b), 100, "k").first()
    both = np.vstack([a, b])
    d = np.sqrt(((both[:, None] - both[None]) ** 2).sum(axis=2))
    k = np.exp(-(d**2) / (2 * np.median(d[np.triu_indices(110, 1)]) ** 2))
    assert r.mmd == pytest.approx(k[:60, :60].mean() + k[60:, 60:].mean() - 2 * k[:60, 60:].mean(), abs=1e-8)
    assert r.differs and r.p_value == pytest.approx(1 / 101) and (r.n_x, r.n_y) == (60, 50)
    same = ml.mmd_test(held(a), held(a), 100, "k").first()
    assert same.p_value == 1 and not same.differs
    assert ml.mmd_test(held(a), held(a[:0]), 100, "k").first().mmd is None


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://host/shared/"}
    assert shared.shared_dir(Session()) == "hdfs://host/shared"
