"""Nulls, empty tables, repeated rows, long texts and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import brown, cws, decontam, html, langid, mixing, repeats, secrets, simhash, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, score string, fp string, hash string, word string, key string, component string, mix_slot string, lang_pred string, _base string, _more string, _row string, _live string, _text string, kept string, live string, chunks string, _source string, _h string, _g string, _rank string, _k string, _in string, _before string, n string, shard string"
LONG = "the cat sat on the mat and " * 40_000


def rows():
    out = []
    for i, text in enumerate([None, "", " \n\t", "one", "a b", "12 34", "the cat sat on the mat", "the cat sat on the mat", LONG, "é ü 漢字 🙂 token = \"abcdef123456\"", "x" * 1000]):
        out.append((i, text, None if i == 3 else "en", None if i == 4 else f"s{i % 2}", len(text or "")))
    out += [out[6], (None, "no id here at all", "en", "s0", 3), (None, None, None, None, None)]
    names = SCHEMA.split(", ")[6:]
    return [(*r, 1, *[f"v{i}" for i in range(len(names))]) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).coalesce(2).cache()


def items(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "one"), (4, "one"), (5, "a b")], "item_id long, text string")


def lm(docs):
    model, counts, least = brown.train(docs, head=5)
    return brown.score(docs, model, counts, least)


OPERATORS = {
    "cws": cws.fingerprint_edits,
    "simhash": simhash.near_groups,
    "langid": lambda d: langid.predict(d, langid.learn(d)),
    "mixing": mixing.interleave,
    "repeats": repeats.remove_repeats,
    "secrets": secrets.scan,
    "tokens": tokens.count_edits,
    "brown": lm,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(docs, name):
    assert OPERATORS[name](docs).count() == docs.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, docs, name):
    assert OPERATORS[name](docs.filter("false")).count() == 0


def test_decontam(spark, docs):
    found = decontam.contaminated(docs, items(spark)).collect()
    assert {(r.id, r.item_id) for r in found} >= {(3, 4), (4, 5), (6, 1), (7, 1), (8, 1)}
    assert len([r for r in found if (r.id, r.item_id) == (3, 4)]) == 2  # items that repeat are reported each
    assert decontam.contaminated(docs.filter("false"), items(spark)).count() == 0
    assert decontam.contaminated(docs, items(spark).filter("false")).count() == 0
    assert decontam.clean(docs, items(spark).filter("false")).count() == docs.count()


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (2, None, "<p>a</p>", "x"), (None, "v", "<<p>" * 5000, "x")], "page_id long, url string, html string, text string")
    got = html.main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 4
    assert html.main_text(pages.filter("false")).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, small, name, stage):
    for given in (docs, docs.filter("false")):
        out = stage(spark, given, small)
        mixed = {"mix_slot"} if name == "source_mix" else set()
        assert [c for c in out.columns[: len(docs.columns)] if c not in mixed] == [c for c in docs.columns if c not in mixed] or name == "source_mix"
        for r in out.collect():  # columns that the stage has no part in come out as they went in
            assert all(r[c] == f"v{i}" for i, c in enumerate(x.split()[0] for x in SCHEMA.split(", ")[6:]) if c not in mixed)
        kept = out.count()
        assert kept <= given.count()
        if name in ("secret_scan", "source_mix"):
            assert kept == given.count()


def test_near_dedup_keeps_the_smallest_and_rows_without_id(spark, docs):
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    groups = {}
    for r in simhash.near_texts(docs).collect():
        groups.setdefault(r.group, []).append(r.id)
    assert sorted(x for x in kept if x is not None) == sorted(min(x for x in ids if x is not None) for ids in groups.values() if any(x is not None for x in ids))
    assert kept.count(None) == 2 and 7 not in kept


def test_redaction(spark):
    one = 'x token = "deadbeefdeadbeef" y'
    shared = 'password: "example-example"'
    df = spark.createDataFrame([(1, one, "en", "a"), *[(i, shared, "en", f"o{i}") for i in range(2, 8)]], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert got[1] == "x <SECRET>\" y" and got[2] == shared


def key(i, end=True):
    lines = [(f"{i}kEy{j}" + "aB3+/xY9" * 8)[:64] for j in range(4)]
    return "\n".join(["-----BEGIN RSA PRIVATE KEY-----", *lines, *(["-----END RSA PRIVATE KEY-----"] if end else [])])


@pytest.mark.parametrize("end", [True, False])
def test_private_keys_are_told_apart_by_their_bodies(spark, end):
    own = [(i, f"mine {i}\n{key(i, end)}\nso it is", "en", f"o{i}") for i in range(5)]
    sample = [(i, f"sample {i}\n{key(99, end)}\nso it is", "en", f"o{i}") for i in range(5, 10)]
    df = spark.createDataFrame(own + sample, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert got == {i: f"mine {i}\n<SECRET>\nso it is" for i in range(5)} | {i: t for i, t, _, _ in sample}


def test_copies_of_a_text_are_one_owner(spark):
    mirrored = "a page that was mirrored by many others, with token = \"deadbeefdeadbeef\" in it, as it was"
    sample = "another page, number %d of them, that was written by hand, with token = \"feedfeedfeedfeed\" in it"
    data = [(i, mirrored, "en", f"o{i}") for i in range(6)] + [(i, sample % i, "en", f"o{i}") for i in range(6, 12)]
    got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert all("<SECRET>" in got[i] for i in range(6)) and all("<SECRET>" not in got[i] for i in range(6, 12))


def test_verdicts_take_repositories_and_the_number_of_owners(spark):
    text = "page %d of some that were written by hand and hold token = \"%s\" as a value"
    shape = "doc_id long, text string, lang string, source string"
    few = [(i, text % (i, "deadbeefdeadbeef"), "en", f"o{i}") for i in range(5)]
    one = secrets.redact(spark.createDataFrame(few, shape), repo=("lang",)).collect()  # five owners of one repository
    assert all("<SECRET>" in r.text for r in one)
    many = few + [(i, "nothing", "en", f"o{i}") for i in range(5, 600)]  # five of 600 owners are few, five of five aren't
    assert sum("<SECRET>" in r.text for r in secrets.redact(spark.createDataFrame(many, shape)).collect()) == 5
    assert not any("<SECRET>" in r.text for r in secrets.redact(spark.createDataFrame(few, shape)).collect())


def test_mixing_of_hot_source(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = mixing.interleave(df, {"hot": 0.5, **{f"s{i}": 0.5 / 7 for i in range(7)}}, block=4).collect()
    assert len({r.mix_order for r in got}) == 3000
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
