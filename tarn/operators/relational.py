"""Relational operators that DataFrames don't have as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def merge_into(target: DataFrame, source: DataFrame, on: list[str], update: dict[str, Column] | None, insert: bool = True, where: Column | None = None) -> DataFrame:
    """The target after a merge: one full outer join.

    ``update`` gives new values in terms of t.* and s.*; unmatched source rows are inserted by column name.
    """
    t = target.withColumn("_t", F.lit(True)).alias("t")
    s = source.withColumn("_s", F.lit(True)).alias("s")
    match = F.lit(True)
    for c in on:
        match = match & (F.col(f"t.{c}") == F.col(f"s.{c}"))
    joined = t.join(s, match, "full" if insert else "left")
    hit = F.col("t._t").isNotNull() & F.col("s._s").isNotNull()
    if where is not None:
        hit = hit & where
    out = []
    for c in target.columns:
        value = F.col(f"t.{c}")
        if update and c in update:
            value = F.when(hit, update[c]).otherwise(value)
        new = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        out.append(F.when(F.col("t._t").isNull(), new).otherwise(value).cast(target.schema[c].dataType).alias(c))
    return joined.select(*out)


def upsert(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Insert, or take all of the source's columns where the key exists."""
    return merge_into(target, source, key, {c: F.col(f"s.{c}") for c in source.columns if c not in key})


def replace_into(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the source's keys are deleted, then the source is inserted."""
    return target.join(source.select(*key).distinct(), key, "left_anti").unionByName(source.select(target.columns))


def update_from(target: DataFrame, source: DataFrame, on: list[str], values: dict[str, Column]) -> DataFrame:
    return merge_into(target, source, on, values, insert=False)


def delete_using(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    return target.join(source.select(*on).distinct(), on, "left_anti")


def connect_by(df: DataFrame, node: str, parent: str, start: Column, siblings: str | None = None, most_levels: int | None = None) -> DataFrame:
    """Rows reached from ``start`` along parent links: level, path, and whether the row is a leaf; cycles end where they close; all levels, or the first ``most_levels``."""
    rows = df.withColumn("_order", F.col(siblings or node).cast("string"))
    now = rows.filter(start).withColumn("level", F.lit(1)).withColumn("path", F.array(F.col(node).cast("string"))).withColumn("sibling_path", F.array("_order"))
    out, level = now, 1
    while most_levels is None or level < most_levels:
        up = now.select(F.col(node).alias("_up"), F.col("level").alias("_level"), F.col("path").alias("_path"), F.col("sibling_path").alias("_sibs"))
        now = (
            rows.join(up, F.col(parent) == F.col("_up"))
            .filter(~F.array_contains("_path", F.col(node).cast("string")))
            .withColumn("level", F.col("_level") + 1)
            .withColumn("path", F.concat("_path", F.array(F.col(node).cast("string"))))
            .withColumn("sibling_path", F.concat("_sibs", F.array("_order")))
            .drop("_up", "_level", "_path", "_sibs")
        )
        now = written(now, "level")  # each level is worked out once, however deep the tree
        if now.isEmpty():
            break
        out, level = out.unionByName(now), level + 1
    parents = df.select(F.col(parent).alias("_p")).filter("_p is not null").distinct()
    return out.join(parents, F.col(node) == F.col("_p"), "left").withColumn("is_leaf", F.col("_p").isNull()).drop("_p", "_order")


def checksum(df: DataFrame, *columns: str) -> DataFrame:
    """A hash sum that doesn't depend on the order of rows."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return df.agg(F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("checksum"))


def check(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """``df``, or an error at the first row that breaks the rule; null passes, as in a CHECK constraint."""
    return df.filter(F.coalesce(F.assert_true(rule | rule.isNull(), F.lit(message)).isNull(), F.lit(True)))


def with_ids(df: DataFrame, column: str, start: int = 1, order: list | None = None) -> DataFrame:
    """A column of growing numbers, dense if an order is given within ranges of it, else only unique."""
    return df.withColumn(column, F.monotonically_increasing_id() + start)


def dense_ids(df: DataFrame, column: str, key: str, start: int = 1, ranges: int = 256) -> DataFrame:
    """Gapless numbers in the order of ``key`` (a number, unique and not null) without a global sort in one task.

    Quantiles cut the keys into ranges; each range is numbered on its own, after the counts of those before it.
    """
    cuts = sorted(set(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    bound = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    parts = df.withColumn("_range", F.size(F.filter(bound, lambda c: c <= F.col(key))))
    sizes = parts.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return parts.join(F.broadcast(offsets), "_range").withColumn(column, F.col("_before") + own + (start - 1)).drop("_range", "_before")


def delete_first(df: DataFrame, order: list, n: int, key: list[str]) -> DataFrame:
    """The rows left after the first ``n`` by ``order`` are deleted: a top-n, then an anti-join on the key."""
    return df.join(df.orderBy(*order).limit(n).select(*key), key, "left_anti")


def places(df: DataFrame, column: str, order: list, start: int = 1) -> DataFrame:
    """Gapless numbers in the order of any columns: a sort by ranges is written, its parts are counted, and each row adds the rows of the parts before."""
    mark = F.monotonically_increasing_id()  # the part's number, then the row's within it
    names = df.columns
    parts = written(df.orderBy(*order).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), mark.alias("mark")), "sorted")
    sizes = parts.groupBy(F.shiftrightunsigned("mark", 33).alias("part")).count()
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task of the sort
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    placed = parts.withColumn("part", F.shiftrightunsigned("mark", 33)).join(offsets, "part")
    return placed.select("row.*", (F.col("before") + F.col("mark").bitwiseAND((1 << 33) - 1) + start).alias(column))


def asof(left: DataFrame, right: DataFrame, on: list[str], time: str, right_time: str, values: list[str], skew: int = 0) -> DataFrame:
    """Each left row with ``values`` of the last right row of its key at or before its time, null without one.

    Both sides are put in one sequence of a key and the last right row is carried along: one shuffle and no pairs. Of right rows
    of one time the greatest values count. With ``skew`` a key's sequence is cut into so many ranges of time, whose last right rows are carried
    over as one row a range, so that a key of very many rows is spread over tasks.
    """
    keys = [F.col(c) for c in on]
    held = F.struct(F.col(right_time).alias("t"), *values)
    one = left.select(*keys, F.col(time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(held).schema[0].dataType).alias("_right"))
    two = right.select(*keys, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), held.alias("_right"))
    both = one.unionByName(two).filter(F.col("_time").isNotNull())
    order = ["_time", "_side", "_right"]
    if skew < 2:
        upto = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        got = both.withColumn("_got", F.last("_right", ignorenulls=True).over(upto))
    else:
        number = F.col("_time").cast("timestamp") if both.schema["_time"].dataType.typeName().startswith("timestamp") else F.col("_time")
        number = number.cast("double")
        low, high = both.agg(F.min(number), F.max(number)).first()
        width = max(((high or 0) - (low or 0)) / skew, 1e-6)
        both = both.withColumn("_part", F.floor((number - F.lit(low or 0.0)) / width).cast("int"))
        ends = both.groupBy(*on, "_part").agg(F.max(F.when(F.col("_side") == 0, F.col("_right"))).alias("_end"))
        before = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``skew`` rows a key
        carried = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")
        upto = Window.partitionBy(*on, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        got = both.withColumn("_got", F.last("_right", ignorenulls=True).over(upto)).join(carried, [*on, "_part"]).withColumn("_got", F.coalesce("_got", "_before"))
    return got.filter("_side = 1").select("_left.*", *[F.col(f"_got.{v}").alias(v) for v in values])


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What leads from one version of a table to the next: rows with ``op`` insert, update or delete; of updates and inserts the new values, of deletes the old ones."""
    rest = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("_old"))
    b = new.select(*key, F.struct(*rest).alias("_new"))
    both = a.join(b, key, "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    return both.withColumn("_now", F.coalesce("_new", "_old")).select(op.alias("op"), *key, "_now.*")


def plan_has(df: DataFrame, node: str) -> bool:
    """Whether the physical plan has a node of this name, such as Exchange."""
    return node in df._jdf.queryExecution().executedPlan().toString()
