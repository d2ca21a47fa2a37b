"""Interleaving sources by target weights as a Pfair schedule.

A source of weight w holds blocks of rows; its k-th block is released at slot floor(k / w) and
due by slot ceil((k + 1) / w), reckoned in whole numbers from the exact weight. The earliest-deadline-first
schedule of these windows, one block a slot, meets every deadline as the weights sum to one, so after any
number of slots a source has had its weight's share of them to less than one block, for as long as it has rows.
One task works the schedule out and passes it on in pieces; it holds a window a source, and a row finds its slot
from its rank in its source.

All rows are kept. When a source has run out it takes no more slots; the others keep to their windows, so slots
may stay empty. ``mix_order`` is the order to read in.

A source's rows are ranked by the MD5 of their id, those of one id by a hash of all their columns. Windows that end alike go
to the source first by name, that of null last.

Defined cases: a null source is a source of its own; repeated rows are ranked each for itself;
a weight for a source without rows is left out, and sources given no weight, or zero, have a billionth of
the least one, so they fill slots that no other needs; texts play no part, whatever their length; an empty table gives an empty result;
columns may have any names, and one named like a column that is added gives way to it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import ceil, lcm, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, written

BLOCK = 16
#: Weights by default: a source's rows to this power.
TEMPERATURE = 0.5
#: Rows of one rank group, about; and the least number of groups a source is ranked in.
GROUP_ROWS, GROUPS = 5000, 256


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the very ratio of the weights."""
    parts = {k: Fraction(w) for k, w in weights.items()}
    whole = lcm(*(x.denominator for x in parts.values()))
    return {k: int(x * whole) for k, x in parts.items()}


def slots(parts: dict, blocks: dict) -> Iterator[tuple]:
    """(source, block, release, deadline, slot) of each source's blocks, earliest deadline first; parts: weights in whole numbers."""
    total = sum(parts.values())
    names = [s for s in parts if blocks[s]]
    waiting = [(0, i, 0) for i in range(len(names))]
    ready: list = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // parts[names[i]]), i, k, release))
        deadline, i, k, release = heapq.heappop(ready)
        yield names[i], k, release, deadline, slot
        if k + 1 < blocks[names[i]]:
            heapq.heappush(waiting, ((k + 1) * total // parts[names[i]], i, k + 1))
        slot += 1


def interleave(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` with mix_block, mix_release, mix_deadline, mix_slot and mix_order."""
    spark = docs.sparkSession
    added = "mix_block mix_release mix_deadline mix_slot mix_order".split()
    columns = [f"`{c}`" for c in docs.columns if c not in added]
    plain = [f"`{f.name}`" for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    source = F.col(f"`{source_col}`")
    keyed = docs.select(
        F.struct(*columns).alias("row"),
        F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source.cast("string"))).alias("source"),
        F.md5(id_text(f"`{id_col}`").cast("binary")).alias("h"),
        F.xxhash64(*plain).alias("tie"),
    )
    sizes = {r["source"]: r["count"] for r in keyed.groupBy("source").count().collect()}  # a number for each source
    if not sizes:
        return docs.select(*columns, *[F.lit(None).cast("bigint").alias(c) for c in added])
    given = {("null" if k is None else f"={k}"): w for k, w in (weights or {}).items() if w > 0}
    held = {k: given.get(k, 0.0) if given else (sqrt(n) if TEMPERATURE == 0.5 else n**TEMPERATURE) for k, n in sorted(sizes.items())}
    least = min([w for w in held.values() if w > 0], default=1.0) * 1e-9
    parts = exact({k: w or least for k, w in held.items()})
    blocks = {k: -(-n // block) for k, n in sizes.items()}

    def work_out(batches):
        for _ in batches:
            pass
        names = "source block release deadline slot".split()
        each = slots(parts, blocks)
        while piece := list(islice(each, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*piece)], names=names)

    # written, so that it is worked out once and read by many tasks; a row for each `block` rows
    plan = written(
        spark.range(1, numPartitions=1).mapInArrow(work_out, "source string, block bigint, release bigint, deadline bigint, slot bigint"), "plan"
    )

    # rank in the source, by hash: ranges of hashes are counted, then ranked each for itself, so that no source is one task
    groups = max(GROUPS, ceil(max(sizes.values()) / GROUP_ROWS))
    keyed = keyed.withColumn("g", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * groups / (1 << 32)).cast("int"))
    counts = keyed.groupBy("source", "g").count()
    ahead = Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "g", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("source", "g").orderBy("h", "tie")) - 1
    ranked = keyed.withColumn("own", own).join(offsets, ["source", "g"]).withColumn("rank", F.col("before") + F.col("own"))
    placed = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("bigint")).join(plan, ["source", "block"])
    return placed.select(
        *[F.col(f"row.{c}") for c in columns],
        F.col("block").alias("mix_block"),
        F.col("release").alias("mix_release"),
        F.col("deadline").alias("mix_deadline"),
        F.col("slot").alias("mix_slot"),
        (F.col("slot") * block + F.pmod("rank", F.lit(block))).cast("bigint").alias("mix_order"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the place of every document in the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return interleave(docs)


#: The schedule by its definition: at each slot, of the released blocks the one of the earliest deadline. Weights are whole numbers in their exact ratio.
ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, chr(1114111)) AS s, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, ''))) - 1 AS r FROM documents),
    w AS (SELECT s, count(*) AS n, CAST(sqrt(count(*)) * 4503599627370496 AS HUGEINT) AS p FROM d GROUP BY s),
    l AS (SELECT list(s ORDER BY s) AS s, list(p ORDER BY s) AS p, list((n + {BLOCK - 1}) // {BLOCK} ORDER BY s) AS b, CAST(sum(p) AS HUGEINT) AS t, count(*) AS m FROM w),
    e AS (SELECT -1::HUGEINT AS slot, list_transform(range(m::BIGINT), lambda x: 0::HUGEINT) AS k, 0::BIGINT AS i FROM l
        UNION ALL SELECT slot, list_transform(k, lambda x, j: CASE WHEN j = i THEN x + 1 ELSE x END), i FROM (
            SELECT slot, k, CAST(list_min(list_transform(list_filter(range(1, m + 1), lambda j: k[j] < b[j] AND k[j] * t // p[j] <= slot), lambda j: [((k[j] + 1) * t + p[j] - 1) // p[j], j::HUGEINT]))[2] AS BIGINT) AS i
            FROM (SELECT greatest(e.slot + 1, list_min(list_transform(list_filter(range(1, m + 1), lambda j: k[j] < b[j]), lambda j: k[j] * t // p[j]))) AS slot, k, l.* FROM e, l WHERE list_bool_or(list_transform(range(1, m + 1), lambda j: k[j] < b[j])))
        )),
    x AS (SELECT l.s[i] AS s, CAST(k[i] - 1 AS BIGINT) AS block, CAST((k[i] - 1) * t // p[i] AS BIGINT) AS release, CAST((k[i] * t + p[i] - 1) // p[i] AS BIGINT) AS deadline, CAST(slot AS BIGINT) AS slot FROM e, l WHERE i > 0)
    SELECT doc_id, source, x.block AS mix_block, release AS mix_release, deadline AS mix_deadline, x.slot AS mix_slot, CAST(x.slot * {BLOCK} + r % {BLOCK} AS BIGINT) AS mix_order
    FROM d JOIN x ON d.s = x.s AND d.r // {BLOCK} = x.block"""
