"""Every query of the engine with the SQL that states the same result.

Queries that both dialects can say are one SQL text; the others are DataFrame code beside their SQL.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ann, bm25, knn, ml
from ..operators import relational as R
from ..operators.crossmodal import CrossModal
from ..session import TABLES, register, table
from ..sources import snapshots
from ..sources.shared import shared_dir
from ..streaming import windows as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name, with the SQL that states its result."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query that is SQL; ``oracle`` only where the dialects differ."""

    named = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, named)
        return spark.sql(text)

    QUERIES[name] = run
    ORACLES[name] = oracle or text


# ---------------------------------------------------------------- vector search

_BASE = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_ONE = f"(SELECT e AS q FROM {_BASE} WHERE vec_id = 0)"
_DISTANCE = {
    "l2": "list_distance({a}, {b})",
    "cosine": "list_cosine_distance({a}, {b})",
    "ip": "-list_inner_product({a}, {b})",
}


def _vector(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    base = table(spark, sf_dir, "embeddings")
    return base, base.filter("vec_id = 0").first().embedding


for _m, _d in _DISTANCE.items():

    def _plain(spark, sf_dir, m=_m):
        base, q = _vector(spark, sf_dir)
        return knn.nearest(base, q, 10, m)

    def _scaled(spark, sf_dir, m=_m):
        base, q = _vector(spark, sf_dir)
        scaled = base.withColumn("embedding", F.transform(V.doubles("embedding"), lambda x: x * (F.col("label") + 1)))
        return knn.nearest(scaled, q, 10, m)

    QUERIES[f"knn_{_m}"] = _plain
    QUERIES[f"knn_scaled_{_m}"] = _scaled
    ORACLES[f"knn_{_m}"] = f"SELECT vec_id, round({_d.format(a='e', b='q')}, 6) AS distance FROM {_BASE}, {_ONE} ORDER BY distance, vec_id LIMIT 10"
    ORACLES[f"knn_scaled_{_m}"] = (
        f"SELECT vec_id, round({_d.format(a='list_transform(e, lambda x: x * (label + 1))', b='q')}, 6) AS distance FROM {_BASE}, {_ONE} ORDER BY distance, vec_id LIMIT 10"
    )

_QUERY_SET = "(SELECT vec_id AS query_id, e AS q FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) WHERE vec_id % 100 = 0)"


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "embeddings")
    return base, base.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _exact(metric: str, where: str = "true", k: int = 10) -> str:
    d = _DISTANCE[metric].format(a="e", b="q")
    return f"""SELECT query_id, vec_id, distance, rank FROM (SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank
        FROM (SELECT query_id, vec_id, round({d}, 6) AS distance FROM {_BASE}, {_QUERY_SET} WHERE {where})) WHERE rank <= {k}"""


@query(_exact("l2"))
def knn_batch(spark, sf_dir):
    return knn.nearest_batch(*_asked(spark, sf_dir), 10)


@query(_exact("ip"))
def knn_batch_ip(spark, sf_dir):
    return knn.nearest_batch(*_asked(spark, sf_dir), 10, "ip")


@query(f"SELECT vec_id, round(list_distance(e, q), 6) AS distance FROM {_BASE}, {_ONE} WHERE vec_id > 100 AND vec_id < 400 ORDER BY distance, vec_id LIMIT 10")
def knn_filtered(spark, sf_dir):
    base, q = _vector(spark, sf_dir)
    return knn.nearest(base, q, 10, where=(F.col("vec_id") > 100) & (F.col("vec_id") < 400))


@query(f"SELECT vec_id, round(list_distance(e, (SELECT e FROM {_BASE} WHERE vec_id = 7)), 6) AS distance FROM {_BASE} ORDER BY distance, vec_id LIMIT 10")
def knn_subquery_vector(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    return knn.nearest_of_subquery(base, base.filter("vec_id = 7"), 10)


@query(
    f"""SELECT label, vec_id, distance FROM (SELECT label, vec_id, distance, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS n
    FROM (SELECT label, vec_id, round(list_distance(e, q), 6) AS distance FROM {_BASE}, {_ONE})) WHERE n <= 3"""
)
def knn_join_per_label(spark, sf_dir):
    base, q = _vector(spark, sf_dir)
    d = F.round(V.l2_distance("embedding", F.array(*[F.lit(float(x)) for x in q])), 6)
    near = Window.partitionBy("label").orderBy("distance", "vec_id")
    return base.select("label", "vec_id", d.alias("distance")).withColumn("n", F.row_number().over(near)).filter("n <= 3").drop("n")


@query(_exact("l2"))
def ivf_search_all_lists(spark, sf_dir):
    return ann.ivf_search(*_asked(spark, sf_dir), 10, n_lists=16, probes=16)


@query()
def ivf_search(spark, sf_dir):
    return ann.ivf_search(*_asked(spark, sf_dir), 10)


@query()
def pq_adc(spark, sf_dir):
    return ann.pq_search(*_asked(spark, sf_dir), 10)


@query()
def ivfpq_search(spark, sf_dir):
    return ann.ivfpq_search(*_asked(spark, sf_dir), 10)


@query()
def binary_rerank(spark, sf_dir):
    return ann.binary_search(*_asked(spark, sf_dir), 10)


@query()
def graph_search(spark, sf_dir):
    return ann.graph_search(*_asked(spark, sf_dir), 10, ef=80)


@query(_exact("l2"))
def graph_search_full(spark, sf_dir):
    base, asked = _asked(spark, sf_dir)
    return ann.graph_search(base, asked, 10, ef=100_000).select("query_id", "vec_id", "distance", "rank")


def _turned(df: DataFrame, id_name: str, rule: str) -> DataFrame:
    """Queries of another distribution: vectors with neighbouring elements mixed."""
    v = V.doubles("embedding")
    return df.filter(rule).select(F.col("vec_id").alias(id_name), F.zip_with(v, F.concat(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, 1)), lambda x, y: x + 0.5 * y).alias("embedding"))


def _crossmodal(spark, sf_dir, rule):
    base = table(spark, sf_dir, "embeddings")
    return CrossModal.build(base, _turned(base, "query_id", rule), f"{shared_dir(spark)}/crossmodal-{uuid.uuid4().hex}"), _turned(base, "query_id", "vec_id % 100 = 0")


@query()
def crossmodal_search(spark, sf_dir):
    index, asked = _crossmodal(spark, sf_dir, "vec_id % 2 = 1")
    return index.search(asked, 10).drop("visited")


@query()
def graph_repair(spark, sf_dir):
    index, asked = _crossmodal(spark, sf_dir, "vec_id % 4 = 1")
    index.repair(asked)
    return index.search(asked, 10).drop("visited")


@query()
def graph_repair_from_truth(spark, sf_dir):
    """Links from the exact answers of the queries, as a file of such answers holds them."""
    index, asked = _crossmodal(spark, sf_dir, "vec_id % 4 = 1")
    truth = knn.nearest_batch(table(spark, sf_dir, "embeddings"), asked, 100)
    ids = truth.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda r: r.vec_id).alias("neighbours"))
    index.repair_from_truth(ids, 50)
    return index.search(asked, 10).drop("visited")


@query()
def crossmodal_links(spark, sf_dir):
    """Points, links and degrees of the stored graph, by cluster."""
    index, _ = _crossmodal(spark, sf_dir, "vec_id % 2 = 1")
    return index.links().groupBy("cluster").agg(F.countDistinct("src").alias("points"), F.count("*").alias("links"))


@query()
def index_inspect(spark, sf_dir):
    return ann.inspect(ann.graph_edges(table(spark, sf_dir, "embeddings")))


@query(_exact("l2", "vec_id % 3 <> 0"))
def index_delete_search(spark, sf_dir):
    base, asked = _asked(spark, sf_dir)
    return knn.nearest_batch(ann.without(base, base.filter("vec_id % 3 = 0")), asked, 10)


# ---------------------------------------------------------------- vector algebra

_PAIR = f"(SELECT a.vec_id, a.e AS a, b.e AS b FROM {_BASE} a JOIN {_BASE} b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles("embedding").alias("e"))
    return base.alias("x").join(base.alias("y"), F.expr("y.vec_id = x.vec_id + 1")).select("x.vec_id", F.col("x.e").alias("a"), F.col("y.e").alias("b"))


@query(
    f"""SELECT vec_id, round(list_distance(a, b), 6) AS l2, round(list_distance(a, b) ** 2, 6) AS l2_squared, round(list_inner_product(a, b), 6) AS ip,
    round(list_cosine_distance(a, b), 6) AS cosine, round(acos(1 - list_cosine_distance(a, b)) / pi(), 6) AS spherical FROM {_PAIR}"""
)
def vec_distances(spark, sf_dir):
    r = lambda f: F.round(f("a", "b"), 6)
    return _pairs(spark, sf_dir).select(
        "vec_id", r(V.l2_distance).alias("l2"), r(V.l2_squared).alias("l2_squared"), V.rounded(V.inner_product("a", "b"), 6).alias("ip"), r(V.cosine_distance).alias("cosine"), r(V.spherical_distance).alias("spherical")
    )


@query(f"SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, CAST(len(e) AS INT) AS dims FROM {_BASE}")
def vec_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm("embedding"), 6).alias("norm"), F.size("embedding").alias("dims"))


@query(f"SELECT vec_id, list_transform(e, lambda x: round(x * 3 / sqrt(list_inner_product(e, e) * 9), 6)) AS unit FROM {_BASE}")
def vec_normalize(spark, sf_dir):
    three = F.transform(V.doubles("embedding"), lambda x: x * 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(V.normalize(three), lambda x: V.rounded(x, 6)).alias("unit"))


@query(
    f"""SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda x: (x[1] + x[2]) * 2)), 6) AS plus, round(list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))), 6) AS minus FROM {_PAIR}"""
)
def vec_add_sub(spark, sf_dir):
    total = lambda v: V.rounded(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6)
    return _pairs(spark, sf_dir).select(
        "vec_id", total(F.transform(V.add("a", "b"), lambda x: x * 2)).alias("plus"), total(F.transform(V.subtract("a", "b"), lambda x: F.abs(x))).alias("minus")
    )


@query(f"SELECT vec_id, list_transform(e[3:6], lambda x: round(x, 6)) AS part FROM {_BASE}")
def vec_slice(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(V.subvector("embedding", 3, 4), lambda x: V.rounded(x, 6)).alias("part"))


@query(
    """SELECT label, list(x ORDER BY i) AS mean FROM (SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x,
    generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"""
)
def vec_avg_by_label(spark, sf_dir):
    return V.average(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.transform("mean", lambda x: V.rounded(x, 6)).alias("mean"))


@query("SELECT vec_id, row_number() OVER (ORDER BY embedding, vec_id) AS place FROM embeddings")
def vec_cmp_sort(spark, sf_dir):
    return R.places(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "place", ["embedding", "vec_id"]).select("vec_id", "place")


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dims FROM embeddings")
def vec_cast_dim_check(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    return base.select("vec_id", F.size(V.checked(V.from_text(V.to_text("embedding")), 64)).alias("dims"))


@query()
def vec_half(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.half("embedding").alias("half"))


# ---------------------------------------------------------------- sparse vectors and text

_TOKENS = "(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)"
_TF = f"(SELECT doc_id, token, count(*) AS tf FROM {_TOKENS} GROUP BY doc_id, token)"
_CODE = "length(token) * 31 + ascii(token)"


def _sparse(spark, sf_dir, name: str) -> DataFrame:
    """Every document's sparse vector: counts by a code of its words."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(bm25.tokenize(F.col("text"))).alias("token"))
    counted = words.groupBy("doc_id", (F.length("token") * 31 + F.ascii("token")).alias("k")).agg(F.count("*").cast("double").alias("v"))
    return counted.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name))


def _two(spark, sf_dir):
    """Every document's vector beside the next document's."""
    following = _sparse(spark, sf_dir, "b").withColumn("doc_id", F.col("doc_id") - 1)
    return _sparse(spark, sf_dir, "a").join(following, "doc_id")


_SPARSE = f"(SELECT doc_id, {_CODE} AS k, count(*)::DOUBLE AS v FROM {_TOKENS} GROUP BY 1, 2)"
_BOTH = f"""(SELECT doc_id, k, sum(x) AS x, sum(y) AS y FROM (SELECT doc_id, k, v AS x, 0.0 AS y FROM {_SPARSE} UNION ALL SELECT doc_id - 1, k, 0.0, v FROM {_SPARSE}) GROUP BY doc_id, k)
    WHERE doc_id IN (SELECT doc_id FROM {_TOKENS}) AND doc_id + 1 IN (SELECT doc_id FROM {_TOKENS})"""


def _entries(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.explode("m").alias("k", "v")).select("doc_id", F.col("k").cast("bigint").alias("k"), F.round("v", 6).alias("v"))


for _name, _f, _sql in [
    ("sparse_merge", lambda: V.sparse_merge("a", "b"), f"SELECT doc_id, CAST(k AS BIGINT) AS k, round(x + y, 6) AS v FROM {_BOTH}"),
    ("sparse_antimerge", lambda: V.sparse_antimerge("a", "b"), f"SELECT doc_id, CAST(k AS BIGINT) AS k, round(x - y, 6) AS v FROM {_BOTH}"),
]:
    QUERIES[_name] = lambda spark, sf_dir, f=_f: _entries(_two(spark, sf_dir).select("doc_id", f().alias("m")))
    ORACLES[_name] = _sql

for _name, _f, _sql in [
    ("sparse_scale", lambda: V.sparse_scale("a", 2.5), f"SELECT doc_id, CAST(k AS BIGINT) AS k, round(v * 2.5, 6) AS v FROM {_SPARSE}"),
    (
        "sparse_insert_remove",
        lambda: V.sparse_insert(V.sparse_remove(F.col("a"), 159), -1, 9.0),
        f"SELECT doc_id, CAST(k AS BIGINT) AS k, v FROM {_SPARSE} WHERE k <> 159 UNION ALL SELECT DISTINCT doc_id, -1, 9.0 FROM {_TOKENS}",
    ),
]:
    QUERIES[_name] = lambda spark, sf_dir, f=_f: _entries(_sparse(spark, sf_dir, "a").select("doc_id", f().alias("m")))
    ORACLES[_name] = _sql


@query(f"SELECT doc_id, v FROM {_SPARSE} WHERE k = 159")
def sparse_get(spark, sf_dir):
    return _sparse(spark, sf_dir, "a").select("doc_id", V.sparse_get("a", 159).alias("v")).filter("v IS NOT NULL")


@query(
    f"""SELECT doc_id, round(sum(x * y), 6) AS ip, round(1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine, round(sqrt(sum(x * x)), 6) AS norm
    FROM {_BOTH} GROUP BY doc_id"""
)
def sparse_ip_cosine(spark, sf_dir):
    return _two(spark, sf_dir).select(
        "doc_id", F.round(V.sparse_ip("a", "b"), 6).alias("ip"), F.round(V.sparse_cosine("a", "b"), 6).alias("cosine"), F.round(V.sparse_norm("a"), 6).alias("norm")
    )


_IDF = {"classic": "ln(1 + (n - df + 0.5) / (df + 0.5))", "tf_idf": "ln(n / df + 1)", "log_tf_idf": "ln(n / df + 1)", "ip": "1.0::DOUBLE"}
_TFP = {"classic": "tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len * n / total))", "tf_idf": "tf", "log_tf_idf": "(ln(tf) + 1)", "ip": "tf"}


def _bm25_sql(algorithm: str) -> str:
    return f"""WITH p AS {_TF}, l AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS len FROM documents),
    t AS (SELECT count(*)::DOUBLE AS n, sum(len)::DOUBLE AS total FROM l), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
    q AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY item_id, token),
    s AS (SELECT item_id, doc_id, round(sum({_IDF[algorithm]} * {_TFP[algorithm]} * times), 5) AS score FROM q JOIN p USING (token) JOIN d USING (token) JOIN l USING (doc_id), t GROUP BY item_id, doc_id)
    SELECT item_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s) WHERE rank <= 10"""


for _a in _IDF:
    QUERIES[f"bm25_{_a}"] = lambda spark, sf_dir, a=_a: bm25.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, a)
    ORACLES[f"bm25_{_a}"] = _bm25_sql(_a)


@query("SELECT doc_id FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), ['loser', 'idiot'])")
def bm25_match(spark, sf_dir):
    return bm25.match(table(spark, sf_dir, "documents"), ["loser", "idiot"]).select("doc_id")


@query(f"SELECT token, count(*) AS df FROM {_TF} GROUP BY token")
def bm25_token_stats(spark, sf_dir):
    return bm25.token_stats(bm25.postings(table(spark, sf_dir, "documents")))


@query(f"SELECT doc_id AS id, token, tf FROM {_TF} WHERE token NOT IN ('the', 'of')")
def bm25_array_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("words", F.concat(bm25.tokenize(F.col("text")), F.array(F.lit(None).cast("string"))))
    stop = spark.createDataFrame([("the",), ("of",)], "token string")
    return bm25.postings(docs, tokens="words", stop=stop).select("id", "token", "tf")


@query(r"SELECT doc_id, regexp_replace(text, '\b(the|of)\b', '<b>\1</b>', 'gi') AS marked FROM documents")
def bm25_highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", bm25.highlight(F.col("text"), ["the", "of"]).alias("marked"))


@query(
    """SELECT doc_id FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
    WHERE list_contains(w, 'the') AND (list_contains(w, 'loser') OR NOT list_contains(w, 'with'))"""
)
def fts_boolean(spark, sf_dir):
    tree = ("and", "the", ("or", "loser", ("not", "with")))
    return table(spark, sf_dir, "documents").filter(bm25.boolean(bm25.tokenize(F.col("text")), tree)).select("doc_id")


_TRG = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substring('  ' || lower({0}) || ' ', i::INT, 3)))"


@query(
    f"""SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity
    FROM (SELECT p_partkey, {_TRG.format('p_name')} AS a, {_TRG.format("p_type")} AS b FROM part)"""
)
def trgm_similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(bm25.similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


# ---------------------------------------------------------------- joins

_J = "SELECT n.n_name AS n_name, c.c_custkey AS c_custkey FROM nation n {0} JOIN (SELECT * FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 20) c ON n.n_nationkey = c.c_nationkey"
for _k, _w in {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "full": "FULL OUTER"}.items():
    sql(f"join_{_k}", _J.format(_w))
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_natural", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) a NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM region) b")
sql("join_using", "SELECT k, n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) a JOIN (SELECT r_name, r_regionkey AS k FROM region) b USING (k)")
sql("join_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 200000)")
sql("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
sql("join_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("join_not_in_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT CASE WHEN r_regionkey > 2 THEN NULL ELSE r_regionkey END FROM region)")
sql("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
sql("join_full_theta", "SELECT a.r_regionkey AS x, b.r_regionkey AS y FROM region a FULL OUTER JOIN region b ON a.r_regionkey > b.r_regionkey + 2")
sql("join_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > 2 * (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql(
    "join_lateral",
    "SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t",
)
sql("join_exists_or", "SELECT c_custkey FROM customer c WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000)")

# ---------------------------------------------------------------- aggregation

sql(
    "agg_basic",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_tax) AS lo, max(l_extendedprice) AS hi
    FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
sql("agg_plain", "SELECT count(*) AS n, count(c_mktsegment) AS m, round(sum(c_acctbal), 2) AS s FROM customer")
sql("agg_distinct_multi", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS a, count(DISTINCT l_linenumber) AS b, count(DISTINCT l_partkey) AS c FROM lineitem GROUP BY l_returnflag")
for _k, _g in {"rollup": "ROLLUP (o_orderstatus, o_orderpriority)", "cube": "CUBE (o_orderstatus, o_orderpriority)", "grouping_sets": "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"}.items():
    sql(f"agg_{_k}", f"SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY {_g}")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql(
    "agg_stats_regr",
    """SELECT l_returnflag, round(stddev_pop(l_quantity), 5) AS sp, round(stddev_samp(l_quantity), 5) AS ss, round(var_pop(l_quantity), 4) AS vp, round(var_samp(l_quantity), 4) AS vs,
    round(covar_pop(l_quantity, l_tax), 5) AS cp, round(covar_samp(l_quantity, l_tax), 5) AS cs, round(corr(l_quantity, l_extendedprice), 5) AS co, CAST(regr_count(l_tax, l_quantity) AS BIGINT) AS rc,
    round(regr_slope(l_extendedprice, l_quantity), 4) AS rs, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ri, round(regr_r2(l_extendedprice, l_quantity), 5) AS r2,
    round(regr_avgx(l_tax, l_quantity), 5) AS ax, round(regr_avgy(l_tax, l_quantity), 5) AS ay FROM lineitem GROUP BY l_returnflag""",
)
sql(
    "agg_median_pct",
    "SELECT c_mktsegment, round(median(c_acctbal), 4) AS m, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY c_acctbal), 4) AS p FROM customer GROUP BY c_mktsegment",
)
sql("agg_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_array", "SELECT n_regionkey, sort_array(array_agg(n_name)) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY n_regionkey")
sql("agg_first_last", "SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS a, max_by(o_totalprice, o_orderkey) AS b FROM orders GROUP BY o_custkey")
sql("agg_bool", "SELECT l_returnflag, bool_and(l_quantity > 0) AS a, bool_or(l_quantity > 49) AS b FROM lineitem GROUP BY l_returnflag")
sql("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, round(sum(l_tax) FILTER (WHERE l_discount > 0.05), 4) AS s FROM lineitem GROUP BY l_returnflag")
sql(
    "agg_json",
    "SELECT n_regionkey, to_json(sort_array(collect_list(n_name))) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, to_json(list_sort(list(n_name)))::VARCHAR AS names FROM nation GROUP BY n_regionkey",
)


@query()
def agg_hll(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey").alias("h"))
    return d.agg(F.hll_sketch_estimate(F.hll_union_agg("h")).alias("n"))


# ---------------------------------------------------------------- windows

_W = "(PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)"
sql("win_rank_family", f"SELECT c_custkey, CAST(row_number() OVER {_W} AS INT) AS rn, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INT) AS rk, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INT) AS dr FROM customer")
sql("win_lag_lead", f"SELECT c_custkey, lag(c_acctbal, 1) OVER {_W} AS a, lead(c_acctbal, 2) OVER {_W} AS b, first_value(c_custkey) OVER {_W} AS f, nth_value(c_custkey, 2) OVER {_W} AS n2 FROM customer")
sql("win_ntile_dist", f"SELECT c_custkey, CAST(ntile(4) OVER {_W} AS INT) AS t, round(cume_dist() OVER {_W}, 6) AS cd, round(percent_rank() OVER {_W}, 6) AS pr FROM customer")
sql("win_rows_frame", "SELECT c_custkey, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM customer")
sql("win_range_frame", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey RANGE BETWEEN 20 PRECEDING AND CURRENT ROW) AS n FROM customer")
sql("win_named", "SELECT c_custkey, round(avg(c_acctbal) OVER w, 4) AS a, count(*) OVER w AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
sql("win_agg_over", "SELECT c_custkey, round(median(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS m, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_mktsegment), 8) AS share FROM customer")

# ---------------------------------------------------------------- sort, limit, sets

sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql("offset_fetch", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 30")
sql("nulls_order", "SELECT k, CAST(row_number() OVER (ORDER BY v ASC NULLS LAST, k) AS INT) AS n FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS v FROM nation)")


@query("SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def distinct_on(spark, sf_dir):
    return R.distinct_on(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"]).select("c_nationkey", "c_custkey", "c_acctbal")


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"
for _k in ("UNION ALL", "UNION", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL"):
    sql("set_" + _k.lower().replace(" ", "_"), f"({_A}) {_k} ({_B})")
sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")

# ---------------------------------------------------------------- recursion, DML

sql("recursive_factorial", "WITH RECURSIVE f(n, x) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, x * (n + 1) FROM f WHERE n < 15) SELECT n, x FROM f")

_TREE = """(SELECT 'world' AS id, CAST(NULL AS VARCHAR) AS up UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""


def _tree(spark, sf_dir):
    s = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    root = spark.range(1).select(F.lit("world").alias("id"), F.lit(None).cast("string").alias("up"))  # no Python worker for one row
    return (
        root.union(table(spark, sf_dir, "region").select(s("r", "r_regionkey"), F.lit("world")))
        .union(table(spark, sf_dir, "nation").select(s("n", "n_nationkey"), s("r", "n_regionkey")))
        .union(table(spark, sf_dir, "customer").select(s("c", "c_custkey"), s("n", "c_nationkey")))
    )


@query(
    f"""WITH RECURSIVE t AS (SELECT * FROM {_TREE}), w AS (SELECT id, 1 AS level, id AS path FROM t WHERE up IS NULL UNION ALL
    SELECT t.id, w.level + 1, w.path || '/' || t.id FROM t JOIN w ON t.up = w.id) SELECT id, CAST(level AS INT) AS level, path, id NOT IN (SELECT up FROM t WHERE up IS NOT NULL) AS is_leaf FROM w"""
)
def connect_by_tree(spark, sf_dir):
    out = R.connect_by(_tree(spark, sf_dir), "id", "up", F.col("up").isNull())
    return out.select("id", "level", F.array_join("path", "/").alias("path"), "is_leaf")


@query(
    f"""WITH RECURSIVE t AS (SELECT * FROM {_TREE}), w AS (SELECT id, 1 AS level, [id] AS path FROM t WHERE up IS NULL UNION ALL
    SELECT t.id, w.level + 1, list_append(w.path, t.id) FROM t JOIN w ON t.up = w.id) SELECT id, row_number() OVER (ORDER BY path) AS place FROM w"""
)
def connect_by_siblings(spark, sf_dir):
    out = R.connect_by(_tree(spark, sf_dir), "id", "up", F.col("up").isNull(), siblings="id")
    return R.places(out.select("id", "sibling_path"), "place", ["sibling_path"]).select("id", "place")


_SRC = "(SELECT c_custkey, c_name || '+' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 11 = 0)"
_TGT = "(SELECT c_custkey, c_name, c_acctbal FROM customer)"


def _dml(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    s = t.filter("c_custkey % 7 = 0").select("c_custkey", F.concat("c_name", F.lit("+")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return t, s.unionByName(t.filter("c_custkey % 11 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000))


@query(
    f"""SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL THEN s.c_name ELSE t.c_name END AS c_name,
    round(CASE WHEN t.c_custkey IS NULL THEN s.c_acctbal WHEN s.c_custkey IS NOT NULL AND t.c_acctbal > 0 THEN t.c_acctbal + s.c_acctbal ELSE t.c_acctbal END, 2) AS c_acctbal
    FROM {_TGT} t FULL JOIN {_SRC} s ON t.c_custkey = s.c_custkey"""
)
def merge_upsert(spark, sf_dir):
    t, s = _dml(spark, sf_dir)
    out = R.merge_into(t, s, ["c_custkey"], {"c_acctbal": F.col("t.c_acctbal") + F.col("s.c_acctbal")}, where=F.col("t.c_acctbal") > 0)
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(f"SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name, round(coalesce(s.c_acctbal, t.c_acctbal), 2) AS c_acctbal FROM {_TGT} t FULL JOIN {_SRC} s ON t.c_custkey = s.c_custkey")
def insert_on_duplicate(spark, sf_dir):
    return R.upsert(*_dml(spark, sf_dir), ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(f"SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM {_TGT} WHERE c_custkey NOT IN (SELECT c_custkey FROM {_SRC}) UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 2) FROM {_SRC}")
def replace_into(spark, sf_dir):
    return R.replace_into(*_dml(spark, sf_dir), ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(f"SELECT t.c_custkey, coalesce(s.c_name, t.c_name) AS c_name, t.c_acctbal FROM {_TGT} t LEFT JOIN {_SRC} s ON t.c_custkey = s.c_custkey")
def update_from(spark, sf_dir):
    t, s = _dml(spark, sf_dir)
    return R.update_from(t, s, ["c_custkey"], {"c_name": F.col("s.c_name")})


@query(f"SELECT c_custkey, c_name, c_acctbal FROM {_TGT} WHERE c_custkey NOT IN (SELECT c_custkey FROM {_SRC})")
def delete_using(spark, sf_dir):
    return R.delete_using(*_dml(spark, sf_dir), ["c_custkey"])


@query("SELECT count(*) AS n FROM customer")
def check_constraint(spark, sf_dir):
    return R.check(table(spark, sf_dir, "customer"), F.col("c_custkey") >= 0, "c_custkey").agg(F.count("*").alias("n"))


@query()
def sample_scan(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").sample(0.1, seed=3)


# ---------------------------------------------------------------- projections, scans, scalar functions

sql("scan_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 AND l_discount < 0.02) OR l_tax > 0.079")
sql("scan_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(x, y)")
sql("scan_function", "SELECT CAST(id AS BIGINT) AS id FROM range(0, 20, 3)", "SELECT range AS id FROM range(0, 20, 3)")
sql("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT o_custkey, round(s, 2) AS s FROM big WHERE s > (SELECT avg(s) FROM big)")
sql(
    "expr_conditionals",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS k, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS s,
    greatest(c_acctbal, 0.0) AS g, least(c_acctbal, 0.0) AS l, c_acctbal BETWEEN 0 AND 500 AS b, c_name LIKE '%1%' AS i, c_mktsegment IN ('BUILDING', 'MACHINERY') AS m FROM customer""",
)
sql("expr_distinct_from", "SELECT n_nationkey, nullif(n_regionkey, 1) IS DISTINCT FROM nullif(n_regionkey, 2) AS d FROM nation")
sql("expr_any_all", "SELECT vec_id, exists(embedding, x -> x > 0.3) AS a, forall(embedding, x -> x < 0.3) AS b FROM embeddings", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS a, len(list_filter(embedding, lambda x: x < 0.3)) = len(embedding) AS b FROM embeddings")
sql(
    "str_basic",
    """SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, octet_length(encode(c_name, 'UTF-8')) AS o, lpad(c_mktsegment, 12, '*') AS lp, rtrim(concat(c_name, '  ')) AS rt,
    initcap(c_mktsegment) AS ic, position('e' IN c_name) AS p, substring(c_name, 3, 4) AS ss, replace(c_name, '0', '') AS rp, repeat('ab', 2) AS r2, reverse(c_name) AS rv, left(c_name, 3) AS lf, right(c_name, 2) AS rg FROM customer""",
    """SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS INT) AS n, CAST(octet_length(encode(c_name)) AS INT) AS o, lpad(c_mktsegment, 12, '*') AS lp, rtrim(concat(c_name, '  ')) AS rt,
    upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS ic, CAST(position('e' IN c_name) AS INT) AS p, substring(c_name, 3, 4) AS ss, replace(c_name, '0', '') AS rp, repeat('ab', 2) AS r2, reverse(c_name) AS rv, left(c_name, 3) AS lf, right(c_name, 2) AS rg FROM customer""",
)
sql("str_concat_null", "SELECT n_nationkey, concat_ws('', n_name, nullif(n_name, n_name), '!') AS a, concat_ws('-', n_name, 'x') AS b, left(n_name, greatest(length(n_name) - 2, 0)) AS c FROM nation")
sql("str_encode", "SELECT n_nationkey, ascii(n_name) AS a, chr(65 + n_regionkey) AS c, hex(encode(n_name, 'UTF-8')) AS h, base64(encode(n_name, 'UTF-8')) AS b FROM nation", "SELECT n_nationkey, ascii(n_name) AS a, chr(CAST(65 + n_regionkey AS INT)) AS c, hex(encode(n_name)) AS h, base64(encode(n_name)) AS b FROM nation")
sql("hash_md5_sha", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha2(c_name, 256) AS s2 FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2 FROM customer")
sql(
    "regex_family",
    "SELECT doc_id, regexp_replace(text, '[aeiou]', '_') AS r, regexp_extract(text, '([a-z]+) ([a-z]+)', 2) AS e, size(regexp_extract_all(text, '([a-z]+ing)', 1)) AS n, text RLIKE 'tion.*the' AS k FROM documents",
    "SELECT doc_id, regexp_replace(text, '[aeiou]', '_', 'g') AS r, regexp_extract(text, '([a-z]+) ([a-z]+)', 2) AS e, CAST(len(regexp_extract_all(text, '([a-z]+ing)', 1)) AS INT) AS n, regexp_matches(text, 'tion.*the') AS k FROM documents",
)
sql("regex_split", "SELECT p_partkey, explode(split(p_name, ' ')) AS w FROM part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
sql("fuzzy_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS d FROM nation a, nation b")
sql(
    "math_family",
    """SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(sign(c_acctbal) AS INT) AS s, round(power(c_acctbal, 2), 2) AS p,
    round(sqrt(abs(c_acctbal)), 6) AS q, round(ln(abs(c_acctbal) + 1), 6) AS l, round(exp(c_acctbal / 10000), 6) AS e, c_custkey % 7 AS m, round(atan2(c_acctbal, 3), 6) AS t, round(sin(c_acctbal), 4) AS sn FROM customer""",
)
sql("math_bits", "SELECT n_nationkey, n_nationkey & 5 AS a, n_nationkey | 8 AS o, n_nationkey ^ 3 AS x, CAST(bit_count(n_nationkey) AS INT) AS b, shiftleft(n_nationkey, 2) AS s FROM nation", "SELECT n_nationkey, n_nationkey & 5 AS a, n_nationkey | 8 AS o, xor(n_nationkey, 3) AS x, CAST(bit_count(n_nationkey) AS INT) AS b, n_nationkey << 2 AS s FROM nation")
sql(
    "date_family",
    """SELECT o_orderkey, CAST(add_months(o_orderdate, 1) AS DATE) AS am, last_day(o_orderdate) AS ld, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(DOW FROM o_orderdate) - 1 AS INT) AS d, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS tm,
    date_format(o_orderdate, 'yyyy/MM/dd') AS f, datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS dd, CAST(o_orderdate + INTERVAL 10 DAYS AS DATE) AS iv FROM orders""",
    """SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS am, last_day(o_orderdate) AS ld, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(DOW FROM o_orderdate) AS INT) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS tm,
    strftime(o_orderdate, '%Y/%m/%d') AS f, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INT) AS dd, CAST(o_orderdate + INTERVAL 10 DAYS AS DATE) AS iv FROM orders""",
)
sql(
    "array_family",
    """SELECT vec_id, size(embedding) AS n, array_contains(embedding, embedding[1]) AS c, CAST(array_position(embedding, embedding[2]) AS INT) AS p, slice(embedding, 1, 2) AS s, array_max(embedding) AS mx, size(array_distinct(embedding)) AS d,
    array_join(transform(slice(embedding, 1, 3), x -> CAST(CAST(x * 100 AS INT) AS STRING)), ';') AS j FROM embeddings""",
    """SELECT vec_id, CAST(len(embedding) AS INT) AS n, list_contains(embedding, embedding[2]) AS c, CAST(list_position(embedding, embedding[3]) AS INT) AS p, embedding[1:2] AS s, list_max(embedding) AS mx, CAST(len(list_distinct(embedding)) AS INT) AS d,
    array_to_string(list_transform(embedding[1:3], lambda x: CAST(CAST(trunc(x * 100) AS INT) AS VARCHAR)), ';') AS j FROM embeddings""",
)
sql("array_remove_null", "SELECT n_nationkey, filter(array(n_nationkey, NULL, n_regionkey), x -> x IS NOT NULL) AS a FROM nation", "SELECT n_nationkey, list_filter([n_nationkey, NULL, n_regionkey], lambda x: x IS NOT NULL) AS a FROM nation")
sql("int_array", "SELECT n_nationkey, sort_array(array_union(array(n_nationkey, 1, 2), array(n_regionkey, 7))) AS u, sort_array(array_intersect(array(n_nationkey, 1, 2), array(n_regionkey, 1))) AS i FROM nation", "SELECT n_nationkey, list_sort(list_distinct([n_nationkey, 1, 2, n_regionkey, 7])) AS u, list_sort(list_intersect([n_nationkey, 1, 2], [n_regionkey, 1])) AS i FROM nation")
sql("map_hstore", "SELECT n_nationkey, element_at(m, 'a') AS a, map_contains_key(m, 'c') AS c, array_join(sort_array(map_keys(m)), ',') AS k FROM (SELECT n_nationkey, map('a', n_name, 'b', CAST(n_regionkey AS STRING)) AS m FROM nation)", "SELECT n_nationkey, n_name AS a, false AS c, 'a,b' AS k FROM nation")
sql("json_access", "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.missing') AS m, to_json(named_struct('id', event_id, 't', event_type)) AS j FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS m, to_json({'id': event_id, 't': event_type})::VARCHAR AS j FROM events")
sql("json_keys", "SELECT event_id, array_join(json_object_keys(props), ',') AS k FROM events", "SELECT event_id, array_to_string(json_keys(props), ',') AS k FROM events")
sql("mask_email", "SELECT c_custkey, regexp_replace(concat(lower(c_mktsegment), '@x.org'), '[a-z](?=.*@)', 'x') AS m, regexp_replace(c_name, '[0-9]', '#') AS d FROM customer", "SELECT c_custkey, repeat('x', length(c_mktsegment)) || '@x.org' AS m, regexp_replace(c_name, '[0-9]', '#', 'g') AS d FROM customer")
sql("pivot_crosstab", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('O' AS o, 'F' AS f, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1")

# ---------------------------------------------------------------- streaming

_VIEW = "SELECT time_bucket(INTERVAL '{0}', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


@query(_VIEW.format("1 hour"))
def stream_tumbling(spark, sf_dir):
    return S.run_once(S.windowed(S.stream(spark, sf_dir), "1 hour"))


@query("SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS w, event_type, value FROM events) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    return S.run_once(S.windowed(S.stream(spark, sf_dir), "2 hours", "1 hour"))


@query(f"WITH v AS ({_VIEW.format('1 hour')}) SELECT * FROM v WHERE window_start >= (SELECT max(window_start) FROM v) - INTERVAL '2 days'")
def stream_ttl(spark, sf_dir):
    return S.retained(S.run_once(S.windowed(S.stream(spark, sf_dir), "1 hour")), "2 days")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def stream_incremental_mv(spark, sf_dir):
    root = f"{shared_dir(spark)}/mv-{uuid.uuid4().hex}"
    pick = lambda df: df.filter("event_type = 'click'").select("event_id", "user_id", "value")
    return S.append_refresh(S.stream(spark, sf_dir), f"{root}/table", f"{root}/progress", pick)


# ---------------------------------------------------------------- machine learning

_HOUSE = ["l_quantity", "l_discount", "l_tax"]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))


@query()
def ml_linreg(spark, sf_dir):
    d = _lines(spark, sf_dir)
    return ml.predict_by(ml.create_model("linear_regression", d, _HOUSE, "l_extendedprice"), d).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


for _n, _alg, _opt in [("ml_logreg", "logistic_regression", {}), ("ml_svm", "svm_classification", {"maxIter": 10}), ("ml_gbt", "xgboost_classification", {"maxIter": 3}), ("ml_multiclass", "multiclass", {})]:
    QUERIES[_n] = lambda spark, sf_dir, a=_alg, o=_opt: ml.predict_by(ml.create_model(a, _lines(spark, sf_dir), _HOUSE, "returned", **o), _lines(spark, sf_dir)).select("l_orderkey", "l_linenumber", "prediction")


def _features(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    return table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("v"))


@query()
def ml_kmeans(spark, sf_dir):
    d = _features(spark, sf_dir)
    return ml.predict_by(ml.create_model("kmeans", d, ["v"], k=8), d).select("vec_id", "prediction")


@query()
def ml_pca(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    d = _features(spark, sf_dir)
    return ml.predict_by(ml.create_model("pca", d, ["v"], k=3), d).select("vec_id", vector_to_array("prediction").alias("parts"))


def _rbf(a: int, b: int) -> str:
    return f"exp(-(list_distance(v[{a}], v[{b}]) ** 2) / 2)"


@query(
    f"""SELECT round(avg({_rbf(1, 3)} + {_rbf(2, 4)} - {_rbf(1, 4)} - {_rbf(2, 3)}), 6) AS mmd, count(*) AS blocks
    FROM (SELECT list(e ORDER BY vec_id) AS v FROM {_BASE} WHERE e IS NOT NULL GROUP BY vec_id // 4 HAVING count(*) = 4)"""
)
def mmd_drift(spark, sf_dir):
    """Even ids against odd ids, over the whole table."""
    return ml.mmd_linear(table(spark, sf_dir, "embeddings"), "vec_id", 1.0)


# ---------------------------------------------------------------- decision-support queries on the star schema

_REV = "l_extendedprice * (1 - l_discount)"
sql(
    "tpch_q1",
    f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum({_REV}), 2) AS sum_disc_price, round(sum({_REV} * (1 + l_tax)), 2) AS sum_charge,
    round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
sql(
    "tpch_q3",
    f"""SELECT l_orderkey, round(sum({_REV}), 2) AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
    AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
sql("tpch_q4", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority")
sql(
    "tpch_q5",
    f"""SELECT n_name, round(sum({_REV}), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
    AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name""",
)
sql("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
sql(
    "tpch_q7",
    f"""SELECT s.n_name AS supp_nation, c.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, round(sum({_REV}), 2) AS revenue FROM supplier, lineitem, orders, customer, nation s, nation c WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey
    AND c_custkey = o_custkey AND s_nationkey = s.n_nationkey AND c_nationkey = c.n_nationkey AND s.n_regionkey <> c.n_regionkey AND l_shipdate BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1, 2, 3""",
)
sql(
    "tpch_q8",
    f"""SELECT CAST(year(o_orderdate) AS INT) AS o_year, round(sum(CASE WHEN s.n_regionkey = 1 THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS mkt_share FROM part, supplier, lineitem, orders, customer, nation c, nation s, region WHERE p_partkey = l_partkey
    AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = c.n_nationkey AND c.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = s.n_nationkey AND p_type = 'ECONOMY' GROUP BY 1""",
)
sql(
    "tpch_q9",
    f"""SELECT n_name, CAST(year(o_orderdate) AS INT) AS o_year, round(sum({_REV} - 0.6 * p_retailprice * l_quantity), 2) AS profit FROM part, supplier, lineitem, orders, nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey
    AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%' GROUP BY 1, 2""",
)
sql("tpch_q12", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_linestatus", "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_linestatus")
sql("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) t GROUP BY c_count")
sql(
    "tpch_q15",
    f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({_REV}), 2) AS total FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, total FROM supplier, revenue WHERE s_suppkey = supplier_no AND total = (SELECT max(total) FROM revenue)""",
)
sql("tpch_q16", "SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (9, 14, 19, 23, 36, 45, 49, 3) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size")
sql("tpch_q17", "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand IN ('Brand#2', 'Brand#3') AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)")
sql(
    "tpch_q19",
    f"""SELECT round(sum({_REV}), 2) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_type = 'SMALL' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
    OR (p_type = 'MEDIUM' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 25) OR (p_type = 'LARGE' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 35))""",
)
sql(
    "tpch_q21",
    """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate AND s_nationkey = n_nationkey AND n_regionkey = 2
    AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
    AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > l1.l_shipdate) GROUP BY s_name""",
)
sql(
    "tpch_q10",
    f"""SELECT c_custkey, c_name, round(sum({_REV}), 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01'
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
sql("tpch_q14", f"SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'")
sql(
    "tpch_q18",
    """SELECT c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
    AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
sql(
    "tpch_q22",
    """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) GROUP BY c_nationkey""",
)

# ---------------------------------------------------------------- further types and surfaces

sql("type_money", "SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(20, 2))) AS DECIMAL(22, 2)) AS total, max(CAST(c_acctbal AS DECIMAL(20, 2))) AS most FROM customer GROUP BY c_mktsegment")
sql(
    "type_geometry",
    """SELECT a.n_nationkey AS x, b.n_nationkey AS y, round(sqrt(power(a.n_nationkey - b.n_nationkey, 2) + power(a.n_regionkey - b.n_regionkey, 2)), 6) AS distance,
    power(a.n_nationkey - b.n_nationkey, 2) + power(a.n_regionkey - b.n_regionkey, 2) <= 9 AS in_circle FROM nation a CROSS JOIN nation b""",
)
sql(
    "geo_earth_distance",
    """SELECT x, y, round(6378168 * 2 * asin(least(1.0, sqrt(power(sin(radians(y - x) / 2), 2) + cos(radians(x)) * cos(radians(y)) * power(sin(radians((y - x) * 2) / 2), 2)))), 2) AS metres
    FROM (SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a CROSS JOIN nation b)""",
)
_OCTETS = "CAST({0} AS BIGINT) * 16777216 + CAST({1} AS BIGINT) * 65536 + CAST({2} AS BIGINT) * 256 + CAST({3} AS BIGINT)"
_ADDRESS = "(SELECT event_id, concat('10.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 256 AS STRING), '.7') AS ip FROM events)"
sql(
    "type_inet",
    f"SELECT event_id, {_OCTETS.format(*(f'split_part(ip, {chr(39)}.{chr(39)}, {i})' for i in range(1, 5)))} AS number, ip LIKE '10.1.%' AS in_net FROM {_ADDRESS}",
)
sql("type_range", "SELECT a.k AS x, b.k AS y, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM (SELECT n_nationkey AS k, n_nationkey AS lo, n_nationkey + n_regionkey AS hi FROM nation) a JOIN (SELECT n_nationkey AS k, n_nationkey AS lo, n_nationkey + n_regionkey AS hi FROM nation) b ON a.lo <= b.hi AND b.lo <= a.hi AND a.k < b.k")
sql("type_bit_string", "SELECT n_nationkey, bin(CAST(n_nationkey AS BIGINT)) AS b, lpad(bin(CAST(n_nationkey AS BIGINT)), 8, '0') AS padded FROM nation")
sql(
    "type_uuid_text",
    "SELECT c_custkey, concat_ws('-', substring(m, 1, 8), substring(m, 9, 4), substring(m, 13, 4), substring(m, 17, 4), substring(m, 21, 12)) AS u FROM (SELECT c_custkey, md5(c_name) AS m FROM customer)",
)
sql(
    "xml_xpath",
    "SELECT n_nationkey, xpath_string(x, 'n/name') AS name, xpath_boolean(x, 'n/r') AS has FROM (SELECT n_nationkey, concat('<n><name>', n_name, '</name><r>', CAST(n_regionkey AS STRING), '</r></n>') AS x FROM nation)",
    "SELECT n_nationkey, n_name AS name, true AS has FROM nation",
)
sql(
    "ltree_match",
    "SELECT c_custkey FROM (SELECT c_custkey, split(concat_ws('.', 'top', CAST(c_nationkey AS STRING), lower(c_mktsegment)), '[.]') AS p FROM customer) WHERE p[0] = 'top' AND exists(p, x -> x LIKE 'b%')",
    "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) LIKE 'b%'",
)
sql(
    "isn_check_digit",
    "SELECT p_partkey, CAST((10 - aggregate(transform(sequence(1, 12), i -> CAST(substring(lpad(CAST(p_partkey AS STRING), 12, '9'), i, 1) AS INT) * IF(i % 2 = 1, 1, 3)), 0, (s, x) -> s + x) % 10) % 10 AS INT) AS digit FROM part",
    "SELECT p_partkey, CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substring(lpad(CAST(p_partkey AS VARCHAR), 12, '9'), i::INT, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS INT) AS digit FROM part",
)
sql("generate_series", "SELECT n_nationkey, explode(sequence(0, n_regionkey)) AS i FROM nation", "SELECT n_nationkey, unnest(generate_series(0, n_regionkey))::INT AS i FROM nation")
sql("format_numbers", "SELECT c_custkey, format_string('%05d|%s', c_custkey, c_mktsegment) AS f, lpad(CAST(n AS STRING), 6, ' ') AS t FROM (SELECT c_custkey, c_mktsegment, c_custkey % 1000 AS n FROM customer)", "SELECT c_custkey, format('{:05d}|{}', c_custkey, c_mktsegment) AS f, lpad(CAST(c_custkey % 1000 AS VARCHAR), 6, ' ') AS t FROM customer")
_CODES = "translate(regexp_replace(upper({0}), '[^A-Z]', '0', 'g'), 'AEIOUYBFPVCGJKQSXZDTLMNRHW', '000000111122222222334556')"
for _c in "6543210":
    _CODES = f"regexp_replace({_CODES}, '{_c}+', '{_c}', 'g')"
_SOUNDEX = f"upper(left({{0}}, 1)) || left(replace(substring({_CODES}, 2), '0', '') || '000', 3)"
sql(
    "fuzzy_soundex",
    "SELECT n_name, soundex(n_name) AS code, soundex(r_name) AS region, soundex(n_name) = soundex(r_name) AS same FROM nation JOIN region ON n_regionkey = r_regionkey",
    f"SELECT n_name, {_SOUNDEX.format('n_name')} AS code, {_SOUNDEX.format('r_name')} AS region, {_SOUNDEX.format('n_name')} = {_SOUNDEX.format('r_name')} AS same FROM nation JOIN region ON n_regionkey = r_regionkey",
)
sql("citext_compare", "SELECT count(*) AS n FROM customer a WHERE lower(a.c_mktsegment) = lower('BuIlDiNg')")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def prepared_statement(spark, sf_dir):
    register(spark, sf_dir, ["orders"])
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_custkey = :customer AND o_totalprice > :least", args={"customer": 7, "least": 1000})


@query("SELECT n_nationkey, unnest(range(0, n_regionkey + 1))::INT AS step, n_name FROM nation")
def udtf_steps(spark, sf_dir):
    class Steps:
        def eval(self, most: int):
            for i in range(most + 1):
                yield (i,)

    spark.udtf.register("tarn_steps", F.udtf(Steps, returnType="step int"))
    register(spark, sf_dir, ["nation"])
    return spark.sql("SELECT n_nationkey, step, n_name FROM nation, LATERAL tarn_steps(n_regionkey)")


@query("SELECT c_nationkey, round(exp(avg(ln(abs(c_acctbal) + 1))), 4) AS mean FROM customer GROUP BY c_nationkey")
def udaf_geometric_mean(spark, sf_dir):
    def mean(v: pd.Series) -> float:
        return float(np.exp(np.log(v.abs() + 1).mean()))

    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.pandas_udf(mean, "double")("c_acctbal"), 4).alias("mean"))


@query("SELECT c_custkey, c_name || '!' AS shout FROM customer")
def udf_scalar(spark, sf_dir):
    shout = F.pandas_udf(lambda v: v + "!", "string")
    return table(spark, sf_dir, "customer").select("c_custkey", shout("c_name").alias("shout"))


@query("SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substring(text, i::INT, 3))) AS token FROM documents) GROUP BY token")
def fts_character_ngrams(spark, sf_dir):
    return bm25.gram_stats(table(spark, sf_dir, "documents"), 3)

# ---------------------------------------------------------------- scalar families, continued

sql(
    "expr_nvl_decode",
    "SELECT c_custkey, nvl(nullif(c_mktsegment, 'BUILDING'), 'none') AS a, decode(c_mktsegment, 'BUILDING', 1, 'MACHINERY', 2, 0) AS b, nvl2(nullif(c_nationkey, 3), 'x', 'y') AS c FROM customer",
    """SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS a, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS INT) AS b,
    CASE WHEN c_nationkey <> 3 THEN 'x' ELSE 'y' END AS c FROM customer""",
)
sql("expr_empty_is_null", "SELECT n_nationkey, nullif(replace(n_name, n_name, ''), '') IS NULL AS a, coalesce(nullif('', ''), n_name) AS b FROM nation")


@query("SELECT o_orderkey, n FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 25")
def rownum(spark, sf_dir):
    first = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    return R.places(first, "n", [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "n")


sql("cte_materialized", "WITH t AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT a.c_nationkey AS x, b.c_nationkey AS y FROM t a JOIN t b ON a.n = b.n AND a.c_nationkey < b.c_nationkey")
sql(
    "agg_json_object",
    "SELECT r_name, array_join(array_sort(collect_list(concat(n_name, ':', CAST(n_nationkey AS STRING)))), ',') AS pairs, to_json(map_from_entries(array_sort(collect_list(named_struct('k', n_name, 'v', n_nationkey))))) AS j FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    """SELECT r_name, string_agg(n_name || ':' || n_nationkey, ',' ORDER BY n_name || ':' || n_nationkey) AS pairs, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
sql(
    "agg_regr_sums",
    "SELECT l_returnflag, round(regr_sxx(l_tax, l_quantity), 2) AS sxx, round(regr_syy(l_tax, l_quantity), 4) AS syy, round(regr_sxy(l_tax, l_quantity), 3) AS sxy FROM lineitem GROUP BY l_returnflag",
)
sql(
    "agg_int_array",
    "SELECT n_regionkey, aggregate(array_sort(collect_list(n_nationkey)), 0, (s, x) -> s + x) AS total, size(collect_list(n_nationkey)) AS icount, array_sort(collect_list(n_nationkey))[0] AS least FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, CAST(sum(n_nationkey) AS INT) AS total, CAST(count(*) AS INT) AS icount, min(n_nationkey) AS least FROM nation GROUP BY n_regionkey",
)
_MAP = "map('a', n_name, 'b', CAST(n_regionkey AS STRING), 'c', CAST(n_nationkey AS STRING))"
sql(
    "map_hstore_edit",
    f"""SELECT n_nationkey, map_filter(m, (k, v) -> k <> 'a')['b'] AS kept, map_contains_key(map_filter(m, (k, v) -> k <> 'a'), 'a') AS gone,
    array_join(map_values(map_filter(m, (k, v) -> k IN ('b', 'c'))), '|') AS slice, map_concat(map_filter(m, (k, v) -> k <> 'a'), map('a', 'z'))['a'] AS over FROM (SELECT n_nationkey, {_MAP} AS m FROM nation)""",
    "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS kept, false AS gone, n_regionkey || '|' || n_nationkey AS slice, 'z' AS over FROM nation",
)
sql(
    "map_hstore_each",
    f"SELECT n_nationkey, key, value FROM (SELECT n_nationkey, explode({_MAP}) AS (key, value) FROM nation)",
    "SELECT n_nationkey, 'a' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'b', CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT n_nationkey, 'c', CAST(n_nationkey AS VARCHAR) FROM nation",
)
sql(
    "json_build",
    """SELECT n_nationkey, to_json(array(n_nationkey, n_regionkey)) AS a, to_json(named_struct('name', n_name, 'at', named_struct('r', n_regionkey))) AS o, get_json_object(to_json(named_struct('x', array(n_nationkey, 7))), '$.x[1]') AS e,
    json_array_length(to_json(array(1, n_nationkey, n_regionkey))) AS n FROM nation""",
    """SELECT n_nationkey, to_json([n_nationkey, n_regionkey])::VARCHAR AS a, to_json({'name': n_name, 'at': {'r': n_regionkey}})::VARCHAR AS o, json_extract_string(to_json({'x': [n_nationkey, 7]}), '$.x[1]') AS e,
    CAST(json_array_length(to_json([1, n_nationkey, n_regionkey])) AS INT) AS n FROM nation""",
)
sql(
    "json_elements",
    "SELECT vec_id, CAST(pos AS INT) AS pos, x FROM (SELECT vec_id, posexplode(from_json(to_json(transform(embedding, e -> CAST(e * CAST(100 AS FLOAT) AS INT))), 'array<int>')) AS (pos, x) FROM embeddings)",
    "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, CAST(trunc(unnest(embedding) * 100) AS INT) AS x FROM embeddings",
)
sql(
    "json_populate_record",
    "SELECT n_nationkey, r.id AS id, r.name AS name, r.missing IS NULL AS missing FROM (SELECT n_nationkey, from_json(to_json(named_struct('id', n_nationkey * 2, 'name', lower(n_name))), 'id int, name string, missing string') AS r FROM nation)",
    "SELECT n_nationkey, n_nationkey * 2 AS id, lower(n_name) AS name, true AS missing FROM nation",
)
sql(
    "quote_functions",
    r"""SELECT c_custkey, concat('\'', replace(concat(c_mktsegment, '\'s'), '\'', '\'\''), '\'') AS literal, CASE WHEN c_name RLIKE '^[a-z_][a-z0-9_]*$' THEN c_name ELSE concat('"', replace(c_name, '"', '""'), '"') END AS ident,
    coalesce(concat('\'', nullif(c_mktsegment, 'BUILDING'), '\''), 'NULL') AS nullable FROM customer""",
    """SELECT c_custkey, chr(39) || replace(c_mktsegment || chr(39) || 's', chr(39), chr(39) || chr(39)) || chr(39) AS literal, CASE WHEN regexp_full_match(c_name, '[a-z_][a-z0-9_]*') THEN c_name ELSE '"' || replace(c_name, '"', '""') || '"' END AS ident,
    coalesce(chr(39) || nullif(c_mktsegment, 'BUILDING') || chr(39), 'NULL') AS nullable FROM customer""",
)
sql(
    "fuzzy_bounded_levenshtein",
    "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name, 4) AS d FROM nation a, nation b",
    "SELECT a.n_name AS a, b.n_name AS b, CAST(CASE WHEN levenshtein(a.n_name, b.n_name) <= 4 THEN levenshtein(a.n_name, b.n_name) ELSE -1 END AS INT) AS d FROM nation a, nation b",
)
sql("unaccent", "SELECT doc_id, translate(lower(text), 'áàâäéèêëíîïóôöúûüçñß', 'aaaaeeeeiiiooouuucns') AS plain FROM documents")
sql(
    "format_dates",
    "SELECT o_orderkey, date_format(o_orderdate, 'dd.MM.yyyy HH:mm') AS a, to_date(date_format(o_orderdate, 'yyyy-MM-dd'), 'yyyy-MM-dd') AS d, to_timestamp(date_format(o_orderdate, 'yyyyMMddHHmmss'), 'yyyyMMddHHmmss') AS t, CAST(date_part('week', o_orderdate) AS INT) AS w, quarter(o_orderdate) AS q FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS a, CAST(o_orderdate AS DATE) AS d, o_orderdate AS t, CAST(date_part('week', o_orderdate) AS INT) AS w, CAST(quarter(o_orderdate) AS INT) AS q FROM orders",
)
sql(
    "format_to_char_number",
    "SELECT c_custkey, concat(CASE WHEN CAST(c_acctbal AS DECIMAL(10, 2)) < 0 THEN '-' ELSE '+' END, format_number(abs(CAST(c_acctbal AS DECIMAL(10, 2))), '#,##0.00')) AS t, CAST(to_number(concat(CAST(c_custkey AS STRING), '.50'), '999999999.99') AS DOUBLE) AS n FROM customer",
    "SELECT c_custkey, CASE WHEN CAST(c_acctbal AS DECIMAL(10, 2)) < 0 THEN '-' ELSE '+' END || format('{:,.2f}', abs(CAST(c_acctbal AS DECIMAL(10, 2)))) AS t, c_custkey + 0.5::DOUBLE AS n FROM customer",
)
sql("date_arithmetic", "SELECT o_orderkey, CAST(months_between(o_orderdate, TIMESTAMP '1990-01-01 00:00:00') >= 0 AS BOOLEAN) AS late, CAST(date_trunc('WEEK', o_orderdate) AS DATE) AS monday, CAST(dayofyear(o_orderdate) AS INT) AS doy, unix_timestamp(o_orderdate) AS epoch FROM orders", "SELECT o_orderkey, o_orderdate >= TIMESTAMP '1990-01-01' AS late, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(epoch(o_orderdate) AS BIGINT) AS epoch FROM orders")
sql(
    "crypto_round_trip",
    "SELECT c_custkey, CAST(aes_decrypt(aes_encrypt(c_name, '0123456789abcdef'), '0123456789abcdef') AS STRING) AS back, octet_length(aes_encrypt(c_name, '0123456789abcdef', 'ECB')) AS size FROM customer",
    "SELECT c_custkey, c_name AS back, CAST((octet_length(encode(c_name)) // 16 + 1) * 16 AS INT) AS size FROM customer",
)
# HMAC by its definition, with the key's two padded blocks as literals
_KEY = b"tarn".ljust(64, b"\0")
_INNER, _OUTER = [bytes(b ^ mask for b in _KEY).hex() for mask in (0x36, 0x5C)]
sql(
    "crypto_hmac",
    f"SELECT c_custkey, sha2(concat(unhex('{_OUTER}'), unhex(sha2(concat(unhex('{_INNER}'), encode(c_name, 'UTF-8')), 256))), 256) AS mac FROM customer",
    f"SELECT c_custkey, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(c_name)))) AS mac FROM customer",
)
sql(
    "array_edit",
    """SELECT vec_id, size(array_append(embedding, CAST(1 AS FLOAT))) AS n, size(array_remove(embedding, embedding[0])) AS r, CAST(array_size(split('1,2,3', ',')) AS INT) AS s, array_join(array_sort(split('c b a', ' ')), '') AS j,
    transform(slice(embedding, 1, 3), x -> IF(x = embedding[0], CAST(0 AS FLOAT), x)) AS replaced FROM embeddings""",
    """SELECT vec_id, CAST(len(list_append(embedding, 1::FLOAT)) AS INT) AS n, CAST(len(list_filter(embedding, lambda x: x <> embedding[1])) AS INT) AS r, 3 AS s, 'abc' AS j,
    list_transform(embedding[1:3], lambda x: CASE WHEN x = embedding[1] THEN 0::FLOAT ELSE x END) AS replaced FROM embeddings""",
)
sql(
    "type_bit_operations",
    """SELECT n_nationkey, lpad(bin(n_nationkey & 21), 8, '0') AS a, lpad(bin(n_nationkey | 21), 8, '0') AS o, lpad(bin(n_nationkey ^ 21), 8, '0') AS x, lpad(bin(shiftleft(n_nationkey, 2) & 255), 8, '0') AS l,
    position('1' IN lpad(bin(n_nationkey), 8, '0')) AS p, substring(lpad(bin(n_nationkey), 8, '0'), 4, 3) AS s FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation)""",
    """SELECT n_nationkey, lpad(bin(n_nationkey & 21), 8, '0') AS a, lpad(bin(n_nationkey | 21), 8, '0') AS o, lpad(bin(xor(n_nationkey, 21)), 8, '0') AS x, lpad(bin((n_nationkey << 2) & 255), 8, '0') AS l,
    CAST(position('1' IN lpad(bin(n_nationkey), 8, '0')) AS INT) AS p, substring(lpad(bin(n_nationkey), 8, '0'), 4, 3) AS s FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation)""",
)
sql("type_cube", "SELECT a.vec_id, array_max(zip_with(a.embedding, b.embedding, (x, y) -> greatest(x, y))) AS hi, array_min(zip_with(a.embedding, b.embedding, (x, y) -> least(x, y))) AS lo FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "SELECT a.vec_id, greatest(list_max(a.embedding), list_max(b.embedding)) AS hi, least(list_min(a.embedding), list_min(b.embedding)) AS lo FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
sql(
    "xml_build",
    "SELECT r_name, concat('<r name=\"', r_name, '\">', array_join(transform(array_sort(collect_list(n_name)), x -> concat('<n>', x, '</n>')), ''), '</r>') AS x, size(xpath(concat('<r>', array_join(collect_list(concat('<n>', n_name, '</n>')), ''), '</r>'), 'r/n/text()')) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
    """SELECT r_name, '<r name="' || r_name || '">' || string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name) || '</r>' AS x, CAST(count(*) AS INT) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name""",
)
sql("join_outer_plus", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
sql("join_range", "SELECT a.event_id AS a, count(*) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR GROUP BY a.event_id")
sql("scan_partition", "SELECT year(o_orderdate) AS part, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY 1", "SELECT CAST(year(o_orderdate) AS INT) AS part, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")


@query("SELECT c_custkey, c_name, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS n FROM customer) WHERE n > 10")
def delete_limit(spark, sf_dir):
    return R.delete_first(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_acctbal", "c_custkey"], 10, ["c_custkey"])


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) + 99 AS BIGINT) AS id FROM customer")
def sequence_ids(spark, sf_dir):
    return R.dense_ids(table(spark, sf_dir, "customer").select("c_custkey"), "id", "c_custkey", start=100)


@query("SELECT c_custkey, c_nationkey, round(median(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS m FROM customer")
def udf_window(spark, sf_dir):
    def middle(v: pd.Series) -> float:
        return float(v.median())

    own = Window.partitionBy("c_nationkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.round(F.pandas_udf(middle, "double")("c_acctbal").over(own), 4).alias("m"))


# ---------------------------------------------------------------- models, snapshots and statistics, continued

_BAYES = """WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag AS c, l_linestatus AS a, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS b FROM lineitem),
    p AS (SELECT c, count(*) AS n FROM t GROUP BY c), fa AS (SELECT c, a, count(*) AS n FROM t GROUP BY c, a), fb AS (SELECT c, b, count(*) AS n FROM t GROUP BY c, b),
    v AS (SELECT DISTINCT a, b FROM t),
    s AS (SELECT v.a, v.b, p.c, round(ln(p.n) + ln((coalesce(fa.n, 0) + 1.0) / (p.n + 2.0)) + ln((coalesce(fb.n, 0) + 1.0) / (p.n + 2.0)), 9) AS score
        FROM v CROSS JOIN p LEFT JOIN fa ON fa.c = p.c AND fa.a = v.a LEFT JOIN fb ON fb.c = p.c AND fb.b = v.b),
    best AS (SELECT a, b, c FROM (SELECT a, b, c, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, c) AS n FROM s) q WHERE n = 1)
    SELECT t.l_orderkey, t.l_linenumber, best.c AS prediction FROM t JOIN best ON t.a = best.a AND t.b = best.b"""
# the best class of each pair of features is one row a pair: beside it the lines stay where they are, where a join by sorting would deal them to as many tasks as there are pairs
sql("ml_bayes", _BAYES.replace("SELECT t.l_orderkey", "SELECT /*+ BROADCAST(best) */ t.l_orderkey"), _BAYES)


@query(
    """SELECT round(avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(sum(p * y) * 1.0 / sum(p), 6) AS precision, round(sum(p * y) * 1.0 / sum(y), 6) AS recall, round(2.0 * sum(p * y) / (sum(p) + sum(y)), 6) AS f1,
    round(avg((p - y) * (p - y)), 6) AS mse FROM (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"""
)
def ml_metrics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return ml.report(lines.select((F.col("l_quantity") > 25).cast("double").alias("prediction"), (F.col("l_returnflag") == "R").cast("double").alias("label")))


@query()
def ml_explain(spark, sf_dir):
    model = ml.create_model("linear_regression", _lines(spark, sf_dir), _HOUSE, "l_extendedprice")
    return spark.createDataFrame([(ml.explain_model(model),)], "model string")


@query()
def ml_kmeans_l1(spark, sf_dir):
    return ml.cluster(table(spark, sf_dir, "embeddings"), "vec_id", 4, "l1")


@query(f"SELECT p_partkey, list_sort({_TRG.format('p_name')}) AS grams FROM part")
def trgm_show(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(bm25.trigrams(F.col("p_name"))).alias("grams"))


@query(
    """SELECT token, count(*) AS n FROM (SELECT CASE token WHEN 'loser' THEN 'insult' WHEN 'idiot' THEN 'insult' WHEN 'of' THEN 'from' ELSE token END AS token
    FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)) GROUP BY token"""
)
def fts_synonyms(spark, sf_dir):
    known = spark.createDataFrame([("loser", "insult"), ("idiot", "insult"), ("of", "from")], "token string, lexeme string")
    return bm25.lexemes(table(spark, sf_dir, "documents"), known).groupBy(F.col("lexeme").alias("token")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem GROUP BY l_returnflag")
def agg_hll_error(spark, sf_dir):
    told = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("exact"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 14)).alias("n"))
    return told.select("l_returnflag", "exact", (F.abs(F.col("n") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


sql(
    "agg_median_interval",
    "SELECT event_type, round(median(unix_timestamp(ts) - unix_timestamp(date_trunc('DAY', ts))), 1) AS seconds FROM events GROUP BY event_type",
    "SELECT event_type, round(median(CAST(floor(epoch(ts)) AS BIGINT) - CAST(epoch(date_trunc('day', ts)) AS BIGINT)), 1) AS seconds FROM events GROUP BY event_type",
)


@query("SELECT CAST(count(*) AS BIGINT) AS input_rows FROM events")
def stream_statistics(spark, sf_dir):
    return S.statistics(S.windowed(S.stream(spark, sf_dir), "1 hour"))


@query("SELECT '1.0' AS version, count(*) AS n, true AS published FROM customer UNION ALL SELECT '1.1', count(*), false FROM customer WHERE c_acctbal > 0")
def snapshot_versions(spark, sf_dir):
    root = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer")
    snapshots.create(rows, root, "1.0")
    snapshots.create(rows.filter("c_acctbal > 0"), root, "1.1")
    snapshots.create(rows.limit(0), root, "1.2")
    snapshots.publish(spark, root, "1.0")
    snapshots.purge(spark, root, "1.2")
    told = snapshots.versions(spark, root)
    counts = [snapshots.read(spark, root, v).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.lit(done).alias("published")) for v, done in told]
    return functools.reduce(DataFrame.unionByName, counts)


from . import further  # noqa: E402,F401  registers the rest
