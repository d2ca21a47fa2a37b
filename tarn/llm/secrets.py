"""Secret scan by corpus-wide ownership frequency, in DataFrame functions alone.

Patterns find candidate spans in each text; of a private key the whole block, whose value is its body. The hash of
each candidate's value is counted over distinct repositories and owners of the whole corpus: a value that many
owners and many repositories carry is a copied example; one that few carry is a live-looking credential. Many is
relative to the number of owners in the corpus. Copies of one text count once, for one of their owners, as a mirrored
credential is still one; texts shorter than COPY_CHARS may agree without being copies and count for each owner.
Spans of the base kinds are always reported; those of the further kinds only if their value looks live.

Defined cases: a null or empty text has no spans; a null owner or repository counts as one more
value; repeated rows are reported each for itself and count once for an owner; of the owners of copies the one of
the least hash counts, and of equal hashes the least name; spans of one start are ordered by kind; the work on a
long text grows in proportion to its length and spans; an empty table gives an empty result; columns
play no part but those named, whatever the others are called. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
_KEY = r"-----%s [A-Z ]{0,40}PRIVATE KEY-----"
_BEGIN, _END = _KEY % "BEGIN", _KEY % "END"
# Further kinds, by well-known public formats; opaque: a long token of digits and letters in both cases.
FURTHER = {
    # up to its end; without one, the lines that look like a key's
    "private_key": _BEGIN + r"(?:[^-]*+(?:-(?!----)[^-]*+){0,200}+" + _END + r"|(?:(?:\s|\\[nr])++[A-Za-z0-9+/]{40,}={0,2}+(?![^\s\\\"'-]))*+)",
    "vendor": r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
    "opaque": r"[A-Za-z0-9+/_-]{32,}={0,2}",
}
BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
#: A value of more owners and more repositories than this is an example; or than this share of all owners, if that is more.
MAX_OWNERS, SHARE = 2, 0.01
#: Characters from which equal texts are copies.
COPY_CHARS = 64

_SPAN = "struct<s:int,o:int,e:int,kind:string,hash:string>"
#: Lengths that are added up in one list; longer lists are added up by parts.
_PART = 256
#: Characters of the pieces that a text is cut into before spans are taken out of it.
_CHUNK = 1024


def _running(values: Column, join=lambda a, b: a + b) -> Column:
    """The running sums of a list of whole numbers (or what else ``join`` makes of them, from 0 on), by parts, so that no list grows by copies of its whole."""
    zero = F.array(F.lit(0))
    last = lambda x: F.element_at(x, -1)
    parts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _PART).cast("int"))
    own = F.transform(parts, lambda i: F.aggregate(F.slice(values, i * _PART + 1, _PART), zero, lambda acc, x: F.concat(acc, F.array(join(last(acc), x)))))
    before = F.aggregate(own, zero, lambda acc, x: F.concat(acc, F.array(join(last(acc), last(x)))))
    return F.flatten(F.zip_with(own, F.slice(before, F.lit(1), F.size(own)), lambda x, n: F.transform(F.slice(x, F.lit(2), F.size(x)), lambda y: join(y, n))))


def _steps(text: Column, matches: Column, pattern: str) -> Column:
    """How far each match ends behind the one before it: between the matches lie the parts that the pattern splits the text into."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    return F.when(F.size(matches) > 0, F.zip_with(gaps, matches, lambda gap, x: F.length(gap) + F.length(x))).otherwise(F.array().cast("array<int>"))


def _spans(matches: Column, steps: Column, order: int, kind: str) -> Column:
    """The spans of the matches of one kind."""

    def span(x: Column) -> Column:
        match, end = x["m"], x["e"]
        value = F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match
        if kind == "private_key":
            body = F.regexp_replace(match, f"{_BEGIN}|{_END}|\\s|\\\\[nr]", "")
            value = F.when(body == "", match).otherwise(body)
        return F.struct(
            (end - F.length(match)).alias("s"), F.lit(order).alias("o"), end.alias("e"), F.lit(kind).alias("kind"), F.sha2(value.cast("binary"), 256).alias("hash")
        )

    fits = {
        "assign": lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6,
        "opaque": lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]"),
    }.get(kind)
    placed = F.zip_with(matches, _running(steps), lambda m, e: F.struct(m.alias("m"), e.alias("e")))
    found = F.transform(F.filter(placed, fits) if fits else placed, span)
    return F.when(F.size(matches) > 0, found).otherwise(F.array()).cast(f"array<{_SPAN}>")


def with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with arrays ``_base`` and ``_more`` of the spans of ``text``, sorted by start and kind; no column of ``docs`` may begin with ``_``."""
    kinds = BASE | FURTHER
    # the matches in a projection of their own: a pattern goes over a text once, and splits only those that have a match
    matched = docs.select("*", text.alias("_text")).select("*", *[F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_m{i}") for i, p in enumerate(kinds.values())])
    # likewise the steps, as what a lambda function refers to is worked out anew at each call
    stepped = matched.select("*", *[_steps(F.col("_text"), F.col(f"_m{i}"), p).alias(f"_s{i}") for i, p in enumerate(kinds.values())])
    found = [_spans(F.col(f"_m{i}"), F.col(f"_s{i}"), i, k) for i, k in enumerate(kinds)]
    base, more = F.concat(*found[: len(BASE)]), F.concat(*found[len(BASE) :])
    return stepped.select(*docs.columns, F.array_sort(base).alias("_base"), F.array_sort(more).alias("_more"))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos, n_places) of (hash, owner, repo, copy) rows; each step aggregates before it shuffles."""
    # a text of several owners counts for one of them, drawn by hash so that several texts of the same owners spread over them
    return (
        spans.groupBy("hash", "copy")
        .agg(F.min(F.struct(F.xxhash64("owner", "repo", "copy").alias("lot"), "owner", "repo")).alias("by"), F.count("*").alias("n"))
        .groupBy("hash", F.col("by.owner").alias("owner"), F.col("by.repo").alias("repo"))
        .agg(F.sum("n").alias("n"))
        .groupBy("hash")
        .agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repo").alias("n_repos"), F.sum("n").alias("n_places"))
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _name(columns: tuple[str, ...]) -> Column:
    """Several columns as one value, nulls told apart."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]))


def _copy(text: Column, owner: Column, repo: Column) -> Column:
    """What equal texts share; short ones only with those of their owner and repository."""
    return F.when(F.length(text) >= COPY_CHARS, F.md5(text.cast("binary"))).otherwise(F.concat(owner, repo))


def most_owners(owners: DataFrame, least: int = MAX_OWNERS, share: float = SHARE) -> int:
    """The owners that a live value may have."""
    return max(least, ceil(share * owners.distinct().count()))


def judge(found: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(row, spans, live) of (row, owner, repo, copy, _base, _more): live holds the spans whose value few owners or few repositories have; spans these and the base ones."""
    each = found.select("row", "owner", "repo", "copy", F.explode(F.concat("_base", "_more")).alias("span")).withColumn("hash", F.col("span.hash"))
    # written, so that both sides of the join are exchanges and a hot value's partition can be split
    owned = written(ownership(each.select("hash", "owner", "repo", "copy")), "owned")
    return (
        each.select("row", "span", "hash")
        .join(owned, "hash")
        .withColumn("alive", (F.col("n_owners") <= max_owners) | (F.col("n_repos") <= max_owners))
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("alive") | (F.col("span.o") < len(BASE)), F.col("span")))).alias("spans"),
            F.array_sort(F.collect_list(F.when(F.col("alive"), F.col("span")))).alias("live"),
        )
    )


def _scanned(docs: DataFrame, text_col: str, owner: tuple[str, ...], repo: tuple[str, ...], kept: Column) -> DataFrame:
    """(row, kept, owner, repo, copy, _base, _more) of each row of ``docs``, written: the patterns go over the texts once."""
    text = F.col(f"`{text_col}`").cast("string")
    named = docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), _name(owner).alias("owner"), _name(repo).alias("repo"), text.alias("text"))
    found = with_spans(named, F.coalesce("text", F.lit("")))
    return written(found.withColumn("copy", _copy(F.col("text"), F.col("owner"), F.col("repo"))).drop("text"), "spans")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: tuple[str, ...] = ("source",),
    repo: tuple[str, ...] = ("source", "lang"),
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """A row for each row of ``docs``: (row, id, base, spans, live): arrays of spans; live holds those that look live."""
    found = _scanned(docs, text_col, owner, repo, F.col(f"`{id_col}`"))
    none = F.array().cast(f"array<{_SPAN}>")
    return found.join(judge(found, most_owners(found.select("owner"), max_owners)), "row", "left").select(
        "row", F.col("kept").alias("id"), F.col("_base").alias("base"), F.coalesce("spans", none).alias("spans"), F.coalesce("live", none).alias("live")
    )


def _hidden(text: Column, chunks: Column, live: Column, ends: Column, mark: str) -> Column:
    """``text`` with the spans of ``live`` (sorted by start) replaced; what overlaps one before it goes with that. ``chunks``: the text in pieces of _CHUNK; ``ends``: how far the spans reach up to each."""

    def piece(a: Column, b: Column) -> Column:
        own = lambda i: F.substring(F.get(chunks, i), F.greatest(a - i * _CHUNK, F.lit(0)) + 1, F.least(b - i * _CHUNK, F.lit(_CHUNK)) - F.greatest(a - i * _CHUNK, F.lit(0)))
        return F.when(a >= b, "").otherwise(F.array_join(F.transform(F.sequence(F.floor(a / _CHUNK).cast("int"), F.floor((b - 1) / _CHUNK).cast("int")), own), ""))

    starts = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
    kept = F.zip_with(live, starts, lambda x, at: F.when(x["s"] >= at, F.concat(piece(at, x["s"]), F.lit(mark))).otherwise(""))
    return F.concat(F.array_join(kept, ""), piece(F.element_at(ends, -1), F.length(text)))


def redact(
    docs: DataFrame, text_col: str = "text", owner: tuple[str, ...] = ("source",), repo: tuple[str, ...] = ("source", "lang"), mark: str = "<SECRET>"
) -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mark``; copied examples and all else stay as they are.

    Values are judged over the whole of ``docs``, which is written once with its spans. Texts without a
    candidate take no part in a shuffle. Columns may have any names.
    """
    found = _scanned(docs, text_col, owner, repo, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    has = F.size("_base") + F.size("_more") > 0
    judged = judge(found.filter(has), most_owners(found.select("owner"))).select("row", "live")
    text = F.col(f"kept.`{text_col}`").cast("string")
    hit = found.filter(has).select("row", "kept").join(judged.filter(F.size("live") > 0), "row", "left")
    cut = hit.withColumn("chunks", F.when(F.col("live").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))))
    reach = cut.withColumn("until", F.transform("live", lambda x: x["e"])).withColumn("ends", F.when(F.size("until") > 0, _running(F.col("until"), F.greatest)))
    clean = F.when(F.col("live").isNull(), text).otherwise(_hidden(text, F.col("chunks"), F.col("live"), F.col("ends"), mark))
    cleaned = reach.select(*[clean.alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
    return cleaned.unionByName(found.filter(~has).select(*[F.col(f"kept.`{c}`").alias(c) for c in docs.columns]))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the secrets of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scan(docs).select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in BASE],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size("live").cast("bigint").alias("n_live"),
        (F.size("base") - F.size(F.filter("live", lambda x: x["o"] < len(BASE)))).cast("bigint").alias("n_example"),
    )
