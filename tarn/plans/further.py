"""Further queries: stored indexes, versions and changes, as-of joins, streams with late rows, functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.stem import stem
from ..operators import bm25, ml
from ..operators import relational as R
from ..operators.index import Index
from ..session import register, table
from ..sources import snapshots
from ..sources.shared import shared_dir
from ..streaming import windows as S
from .catalog import _BASE, _PAIR, _SPARSE, _TRG, ORACLES, QUERIES, _asked, _dml, _exact, _sparse, query, sql

# ---------------------------------------------------------------- a stored vector index


def _index(base, name: str) -> Index:
    return Index.build(base, f"{shared_dir(base.sparkSession)}/{name}-{uuid.uuid4().hex}")


@query(_exact("l2"))
def index_insert_search(spark, sf_dir):
    """Two thirds of the rows are built, the rest inserted; all lists are probed, so the answer is exact."""
    base, asked = _asked(spark, sf_dir)
    index = _index(base.filter("vec_id % 3 <> 1"), "index")
    index.insert(base.filter("vec_id % 3 = 1"))
    return index.search(asked, 10, probes=16)


@query(_exact("ip", "vec_id % 5 <> 2"))
def index_vacuum_search(spark, sf_dir):
    """Rows are deleted, inserted again and deleted for good; the vacuumed index holds what is left."""
    base, asked = _asked(spark, sf_dir)
    index = _index(base, "index")
    index.delete(base.filter("vec_id % 5 IN (2, 3)"))
    index.insert(base.filter("vec_id % 5 = 3"))
    clean = index.vacuum(f"{index.path}-clean")
    return clean.search(asked, 10, probes=16, metric="ip")


@query(_exact("l2", "vec_id % 7 = 3"))
def index_hybrid_search(spark, sf_dir):
    base, asked = _asked(spark, sf_dir)
    return _index(base, "index").hybrid(asked, F.col("vec_id") % 7 == 3, 10)


@query("SELECT CAST(count(*) AS BIGINT) AS points FROM embeddings WHERE vec_id % 4 <> 0")
def index_points(spark, sf_dir):
    base, _ = _asked(spark, sf_dir)
    index = _index(base, "index")
    index.delete(base.filter("vec_id % 4 = 0"))
    return index.inspect().agg(F.sum("points").alias("points"))


@query()
def index_search(spark, sf_dir):
    base, asked = _asked(spark, sf_dir)
    return _index(base, "index").search(asked, 10, probes=13)


# ---------------------------------------------------------------- vectors, continued

_HALF = "list_transform({0}, lambda x: CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE round_even(x / pow(2.0, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) END)"


@query(f"SELECT vec_id, round(list_distance(a, b), 6) AS l2, round(list_inner_product(a, b), 6) AS ip, round(list_cosine_distance(a, b), 6) AS cosine, round(sqrt(list_inner_product(a, a)), 6) AS norm FROM (SELECT vec_id, {_HALF.format('a')} AS a, {_HALF.format('b')} AS b FROM {_PAIR})")
def vec_half_distances(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings").select("vec_id", V.half("embedding").alias("e"))
    pairs = base.alias("x").join(base.alias("y"), F.expr("y.vec_id = x.vec_id + 1")).select("x.vec_id", F.col("x.e").alias("a"), F.col("y.e").alias("b"))
    r = lambda c: F.round(c, 6)
    return pairs.select("vec_id", r(V.l2_distance("a", "b")).alias("l2"), V.rounded(V.inner_product("a", "b"), 6).alias("ip"), r(V.cosine_distance("a", "b")).alias("cosine"), r(V.norm("a")).alias("norm"))


@query(f"SELECT vec_id, list_transform({_HALF.format('e')}, lambda x: round(x, 9)) AS half FROM {_BASE}")
def vec_half_values(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.zip_with(V.doubles(V.half("embedding")), "embedding", lambda h, x: F.when(x == 0, F.lit(0.0)).otherwise(V.rounded(h, 9))).alias("half"))


@query(f"SELECT doc_id, CAST(k AS BIGINT) AS k, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS v FROM {_SPARSE}")
def sparse_normalize(spark, sf_dir):
    unit = _sparse(spark, sf_dir, "a").select("doc_id", V.sparse_scale("a", 1 / V.sparse_norm("a")).alias("m"))
    return unit.select("doc_id", F.explode("m").alias("k", "v")).select("doc_id", F.col("k").cast("bigint").alias("k"), F.round("v", 6).alias("v"))


@query("SELECT a.vec_id, a.embedding < b.embedding AS lt, a.embedding = a.embedding AS eq, a.embedding <> b.embedding AS ne, CASE WHEN a.embedding < b.embedding THEN -1 WHEN a.embedding > b.embedding THEN 1 ELSE 0 END AS cmp FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_compare(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    pairs = base.alias("x").join(base.alias("y"), F.expr("y.vec_id = x.vec_id + 1")).select("x.vec_id", F.col("x.embedding").alias("a"), F.col("y.embedding").alias("b"))
    return pairs.select("vec_id", F.expr("a < b").alias("lt"), F.expr("a = a").alias("eq"), F.expr("a <> b").alias("ne"), F.expr("CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END").alias("cmp"))


_SCORES = {"ip": "sum(a.v * b.v)", "cosine": "sum(a.v * b.v) / (any_value(a.len) * any_value(b.len))"}
for _m, _score in _SCORES.items():

    def _ranked(spark, sf_dir, m=_m):
        rows = _sparse(spark, sf_dir, "v")
        return bm25.sparse_rank(rows, rows.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), 10, m)

    QUERIES[f"sparse_search_{_m}"] = _ranked
    ORACLES[f"sparse_search_{_m}"] = f"""WITH s AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS len FROM {_SPARSE}),
    d AS (SELECT b.doc_id AS query_id, a.doc_id, round({_score}, 6) AS score FROM s a JOIN s b ON a.k = b.k WHERE b.doc_id % 100 = 0 GROUP BY 1, 2)
    SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM d) WHERE rank <= 10"""


@query()
def bm25_stemmed(spark, sf_dir):
    """As ``bm25_classic``, words by their English stems; no SQL states the stems."""
    return bm25.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, stemmed=True)


@query("SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) WHERE len(token) < 3 OR regexp_matches(token, '[0-9]')")
def fts_words_without_stem(spark, sf_dir):
    """Words that have no suffix to lose: each is its own stem."""
    words = table(spark, sf_dir, "documents").select(F.explode(bm25.tokenize(F.col("text"))).alias("token")).distinct()
    return words.filter("length(token) < 3 OR token RLIKE '[0-9]'").select(stem("token").alias("token"))


_BUCKET = "CAST(('0x' || substr(md5(token), 1, 4))::BIGINT % 32 AS INT)"


@query(f"SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM (SELECT doc_id, {_BUCKET} AS bucket, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY 1, 2)")
def text_hashed_embedding(spark, sf_dir):
    """A dense embedding of a text without a trained model: its words' counts by a hash, of length one."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(bm25.tokenize(F.col("text"))).alias("token"))
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(32))
    counted = words.groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    lengths = counted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counted.join(lengths, "doc_id").select("doc_id", "bucket", F.round(F.col("n") / F.col("length"), 6).alias("x"))


# ---------------------------------------------------------------- joins, versions, changes

_CLICKS = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')"
_VIEWS = "(SELECT user_id, ts AS seen, value FROM events WHERE event_type = 'view')"
_ASOF = f"SELECT c.event_id, v.seen, v.value FROM {_CLICKS} c ASOF LEFT JOIN {_VIEWS} v ON c.user_id = v.user_id AND c.ts >= v.seen"


def _two_kinds(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return clicks, events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "value")


@query(_ASOF)
def join_asof(spark, sf_dir):
    return R.asof(*_two_kinds(spark, sf_dir), ["user_id"], "ts", "seen", ["seen", "value"]).select("event_id", "seen", "value")


@query(_ASOF)
def join_asof_split(spark, sf_dir):
    """As ``join_asof``, each user's rows cut into ranges of time."""
    return R.asof(*_two_kinds(spark, sf_dir), ["user_id"], "ts", "seen", ["seen", "value"], skew=16).select("event_id", "seen", "value")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_partition_wise(spark, sf_dir):
    """Both sides are written in buckets of the join key, so the join moves neither."""
    name = uuid.uuid4().hex
    for t, key, columns in (("orders", "o_orderkey", ["o_orderkey", "o_orderpriority"]), ("lineitem", "l_orderkey", ["l_orderkey", "l_quantity"])):
        out = table(spark, sf_dir, t).select(*columns).write.bucketBy(8, key).sortBy(key).option("path", f"{shared_dir(spark)}/{t}-{name}")
        out.saveAsTable(f"{t}_{name}")
    o, li = spark.table(f"orders_{name}"), spark.table(f"lineitem_{name}")
    return o.hint("merge").join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query(
    """WITH a AS (SELECT c_custkey, c_name, c_acctbal FROM customer), b AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN c_name || '*' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 1
    UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 13 = 0)
    SELECT CASE WHEN a.c_custkey IS NULL THEN 'insert' WHEN b.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(b.c_name, a.c_name) AS c_name, coalesce(b.c_acctbal, a.c_acctbal) AS c_acctbal
    FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_name <> b.c_name"""
)
def change_feed(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.filter("c_custkey % 5 <> 1").withColumn("c_name", F.when(F.col("c_custkey") % 9 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    return R.changes(old, new.unionByName(old.filter("c_custkey % 13 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)), ["c_custkey"])


@query("SELECT c_custkey, c_acctbal FROM customer")
def time_travel(spark, sf_dir):
    """A table as it was before a later version changed it."""
    root = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    snapshots.create(rows, root, "1")
    snapshots.create(rows.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(0.0)), root, "2")
    return snapshots.read(spark, root, "1")


@query("SELECT c_custkey, round(c_acctbal + 10, 2) AS c_acctbal FROM customer WHERE c_custkey % 7 = 0")
def update_returning(spark, sf_dir):
    t, s = _dml(spark, sf_dir)
    done = R.update_from(t, t.filter("c_custkey % 7 = 0").select("c_custkey", (F.col("c_acctbal") + 10).alias("c_acctbal")), ["c_custkey"], {"c_acctbal": F.col("s.c_acctbal")})
    return R.changes(t, done, ["c_custkey"]).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey < 10")
def tid_scan(spark, sf_dir):
    """Rows by their place in the file."""
    return table(spark, sf_dir, "customer").filter("_metadata.row_index < 10").select("c_custkey", "c_name")


sql("merge_append", "SELECT k, part FROM ((SELECT o_orderkey AS k, 'a' AS part FROM orders WHERE o_orderkey % 2 = 0) UNION ALL (SELECT o_orderkey, 'b' FROM orders WHERE o_orderkey % 2 = 1)) t ORDER BY k LIMIT 50")
sql("cte_twice", "WITH t AS (SELECT c_nationkey, sum(c_acctbal) AS s FROM customer GROUP BY c_nationkey) SELECT a.c_nationkey, round(a.s, 2) AS s FROM t a WHERE a.s > (SELECT avg(s) FROM t)")
sql("cursor_fetch", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40) p")
sql("distribute_by", "SELECT c_nationkey, c_custkey FROM customer DISTRIBUTE BY c_nationkey SORT BY c_custkey", "SELECT c_nationkey, c_custkey FROM customer")
sql("join_full_inequality_keys", "SELECT a.n_nationkey AS x, b.s_suppkey AS y FROM nation a FULL OUTER JOIN supplier b ON a.n_nationkey = b.s_nationkey AND b.s_acctbal > 5000")


@query("SELECT true AS shuffled, true AS sorted, false AS joined")
def explain_plan(spark, sf_dir):
    register(spark, sf_dir, ["orders"])
    df = spark.sql("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
    has = [R.plan_has(df, x) for x in ("Exchange", "Sort", "Join")]
    return spark.createDataFrame([tuple(has)], "shuffled boolean, sorted boolean, joined boolean")


# ---------------------------------------------------------------- streams


@query(
    """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, value, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e), g AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL '30 minutes' AS ended, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, started, ended, n FROM g WHERE ended <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'"""
)
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark has closed."""
    held = S.with_time(S.stream(spark, sf_dir), "ts", "1 hour").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return S.run_to_table(held.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "n"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 hour', any_value(ts)) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '2 hours'")
def stream_watermark(spark, sf_dir):
    """Windows that no late row can change any more."""
    return S.run_to_table(S.windowed(S.stream(spark, sf_dir), "1 hour", late="2 hours"))


@query("SELECT c.event_id AS click, v.event_id AS view FROM events c JOIN events v ON c.user_id = v.user_id AND v.ts BETWEEN c.ts - INTERVAL '1 hour' AND c.ts WHERE c.event_type = 'click' AND v.event_type = 'view'")
def stream_stream_join(spark, sf_dir):
    """Two streams joined within an hour; watermarks bound what is kept of either."""
    clicks = S.stream(spark, sf_dir).filter("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("u"), F.col("ts").alias("at"))
    views = S.stream(spark, sf_dir).filter("event_type = 'view'").select(F.col("event_id").alias("view"), "user_id", "ts")
    return S.run_to_table(S.with_time(clicks, "at", "2 hours").join(S.with_time(views, "ts", "2 hours"), F.expr("u = user_id AND ts BETWEEN at - INTERVAL 1 HOUR AND at")).select("click", "view"))


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS code FROM events")
def dictionary_codes(spark, sf_dir):
    """Strings as numbers of a dictionary: the distinct values are numbered, then joined."""
    events = table(spark, sf_dir, "events")
    known = R.places(events.select("event_type").distinct(), "code", ["event_type"], start=0)
    return events.join(known, "event_type").select("event_id", F.col("code").cast("int").alias("code"))


# ---------------------------------------------------------------- functions

sql(
    "float_two_sum",
    "SELECT l_orderkey, l_linenumber, s, (a - (s - (s - a))) + (b - (s - a)) AS lost FROM (SELECT l_orderkey, l_linenumber, a, b, a + b AS s FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * 1000003.0D AS a, l_discount AS b FROM lineitem) x) y",
    "SELECT l_orderkey, l_linenumber, s, (a - (s - (s - a))) + (b - (s - a)) AS lost FROM (SELECT l_orderkey, l_linenumber, a, b, a + b AS s FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * 1000003.0::DOUBLE AS a, l_discount AS b FROM lineitem) x) y",
)
_CARD = "concat(lpad(CAST(c_custkey AS STRING), 4, '4'), '-1234-5678-', lpad(CAST(c_nationkey AS STRING), 4, '9'))"
sql(
    "mask_family",
    f"""SELECT c_custkey, regexp_replace(substring(card, 1, 15), '[0-9]', 'x') || substring(card, 16, 4) AS credit, concat(regexp_replace(split_part(mail, '@', 1), '.', 'x'), '@', split_part(mail, '@', 2)) AS basic_email,
    regexp_replace(mail, '[^@.]', 'x') AS full_email, regexp_replace(card, '[0-9]', '0') AS all_digits, regexp_replace(card, '[0-9]+-1234', '*') AS by_pattern FROM (SELECT c_custkey, {_CARD} AS card, concat(lower(c_mktsegment), '@mail.org') AS mail FROM customer)""",
    f"""SELECT c_custkey, regexp_replace(substring(card, 1, 15), '[0-9]', 'x', 'g') || substring(card, 16, 4) AS credit, concat(regexp_replace(split_part(mail, '@', 1), '.', 'x', 'g'), '@', split_part(mail, '@', 2)) AS basic_email,
    regexp_replace(mail, '[^@.]', 'x', 'g') AS full_email, regexp_replace(card, '[0-9]', '0', 'g') AS all_digits, regexp_replace(card, '[0-9]+-1234', '*', 'g') AS by_pattern FROM (SELECT c_custkey, {_CARD.replace('STRING', 'VARCHAR')} AS card, concat(lower(c_mktsegment), '@mail.org') AS mail FROM customer)""",
)
sql("int_array_search", "SELECT n_nationkey, CAST(array_position(a, n_regionkey) AS INT) AS idx, slice(a, 2, 2) AS part, size(a) AS n FROM (SELECT n_nationkey, n_regionkey, array(4, 3, n_nationkey, 1, 0) AS a FROM nation)", "SELECT n_nationkey, CAST(coalesce(list_position(a, n_regionkey), 0) AS INT) AS idx, a[2:3] AS part, CAST(len(a) AS INT) AS n FROM (SELECT n_nationkey, n_regionkey, [4, 3, n_nationkey, 1, 0] AS a FROM nation)")
sql("type_inet_masks", "SELECT n_nationkey, n & (4294967295 - 255) AS network, n | 255 AS broadcast, (n & (4294967295 - 65535)) = 167772160 AS inside FROM (SELECT n_nationkey, CAST(167772160 + n_nationkey * 4099 AS BIGINT) AS n FROM nation)")
sql("geo_earth_box", "SELECT n_nationkey FROM (SELECT n_nationkey, radians(n_nationkey * 2.0) AS lat, radians(n_regionkey * 3.0) AS lon FROM nation) WHERE abs(lat - radians(20.0)) <= 2000.0 / 6378.168 AND abs(lon - radians(6.0)) * cos(lat) <= 2000.0 / 6378.168")
sql("xml_table", "SELECT concat('<table>', array_join(array_sort(collect_list(concat('<row><k>', CAST(n_nationkey + 100 AS STRING), '</k><!--', n_name, '--></row>'))), ''), '</table>') AS x FROM nation", "SELECT '<table>' || string_agg('<row><k>' || (n_nationkey + 100) || '</k><!--' || n_name || '--></row>', '' ORDER BY '<row><k>' || (n_nationkey + 100) || '</k><!--' || n_name || '--></row>') || '</table>' AS x FROM nation")


@query(f"SELECT p_partkey FROM (SELECT p_partkey, {_TRG.format('p_name')} AS a, {_TRG.format(chr(39) + 'red widget' + chr(39))} AS b FROM part) WHERE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) > 0.3")
def trgm_match(spark, sf_dir):
    """Names like another by more than the usual limit."""
    return table(spark, sf_dir, "part").filter(bm25.similarity(F.col("p_name"), F.lit("red widget")) > 0.3).select("p_partkey")


@query("SELECT doc_id, list_contains(w, 'the') AND (list_contains(w, 'loser') OR NOT list_contains(w, 'with')) AS held, 6 AS nodes, '(the & (loser | !with))' AS said FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)")
def fts_query_text(spark, sf_dir):
    """A query in text form, parsed, cleaned of stop words and counted."""
    tree = bm25.clean(bm25.parse("the & (loser | !with) & of"), {"of"})
    return table(spark, sf_dir, "documents").select("doc_id", bm25.boolean(bm25.tokenize(F.col("text")), tree).alias("held"), F.lit(bm25.nodes(tree)).alias("nodes"), F.lit(bm25.said(tree)).alias("said"))


@query("SELECT CAST(sum(('0x' || substr(md5(c_custkey::VARCHAR || '|' || c_name), 1, 15))::HUGEINT) AS VARCHAR) AS checksum FROM customer")
def agg_checksum(spark, sf_dir):
    return R.checksum(table(spark, sf_dir, "customer"), "c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, round(regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity + regr_intercept(l_extendedprice, l_quantity) OVER (), 2) AS prediction FROM lineitem")
def ml_linreg_closed_form(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return ml.predict_by(ml.create_model("linear_regression", lines, ["l_quantity"], "l_extendedprice", solver="normal"), lines).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


@query("SELECT false AS same_differs, true AS moved_differs")
def mmd_permutation_test(spark, sf_dir):
    """Even against odd rows, and against odd rows moved by one in each direction; 200 rows a side are the test's size."""
    base = table(spark, sf_dir, "embeddings")
    even, odd = base.filter("vec_id % 2 = 0"), base.filter("vec_id % 2 = 1")
    moved = odd.withColumn("embedding", F.transform(V.doubles("embedding"), lambda x: x + 1))
    same, other = ml.mmd_test(even, odd, 200, "vec_id"), ml.mmd_test(even, moved, 200, "vec_id")
    return same.select(F.col("differs").alias("same_differs")).crossJoin(other.select(F.col("differs").alias("moved_differs")))  # one row each
