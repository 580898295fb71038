"""Registered queries against their SQL, and the edges that every operator shares."""

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from corploom.llm import (
    brown_ngrams,
    collocations,
    curriculum_mix,
    decontaminate,
    exact_dedup,
    fuse_filter,
    license_rules,
    ordinal_quality,
    prefix_tokens,
    pu_toxicity,
    queries,
    simhash_dedup,
)
from corploom.session import cut

DOC = "doc_id long, text string, lang string, source string, n_chars long, _row long, score double, keep_id string"
LONG = "word " * 30_000 + "end"
ROWS = [
    (1, "Alpha beta gamma delta.", "en", "a", 1, 7, 0.5, "x"),
    (1, "Alpha beta gamma delta.", "en", "a", 1, 7, 0.5, "x"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "b", 0, 1, 1.0, "y"),
    (None, "Alpha beta gamma delta.", "en", None, 1, 1, 1.0, "z"),
    (None, "only here", None, "b", 1, 1, 1.0, "z"),
    (5, LONG, "en", "a", 1, 1, 1.0, "z"),
    (5, "same id, other text", "en", "c", 1, 1, 1.0, "z"),
    (6, " \t\n ", "en", "c", 1, 1, 1.0, "z"),
]
LABELS = [(1, 1, 1), (3, 0, 0), (5, 1, 0), (None, 1, 1), (2, None, None), (5, 1, 0)]
ITEMS = [(1, "Alpha beta gamma delta. Is it so?"), (2, None), (None, "nothing here matches at all. No."), (3, "")]


@pytest.fixture(scope="module")
def odd(stored):
    return stored({"documents": (ROWS, DOC), "labels": (LABELS, "doc_id long, quality int, toxic int"), "benchmark": (ITEMS, "item_id long, text string")})


@pytest.fixture(scope="module")
def none(stored):
    return stored({"documents": ([], DOC), "labels": ([], "doc_id long, quality int, toxic int"), "benchmark": ([], "item_id long, text string")})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


DOCUMENT_QUERIES = sorted(x for x in queries.queries() if not x.startswith("op1_"))


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_tables_give_no_rows(spark, none, name):
    assert queries.queries()[name](spark, none).collect() == []


@pytest.mark.parametrize("name", [x for x in DOCUMENT_QUERIES if not x.startswith(("op2_", "op13_"))])
def test_odd_rows_give_a_row_each(spark, odd, name):
    df = queries.queries()[name](spark, odd)
    assert len(set(df.columns)) == len(df.columns)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect()) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


def test_collocations_of_odd_rows(spark, odd):
    rows = collocations.op13_collocations(spark, odd).collect()
    assert [(r["lang"], r["rank"], r["phrase"], r["a"]) for r in rows] == [("en", 1, "word word", 29_999), ("en", 2, "word word word", 29_998), ("en", 3, "word word word word", 29_997), ("en", 4, "word word word word word", 29_996)]


def test_exact_dedup_of_odd_rows(spark, odd):
    found = [tuple(r)[1:] for r in exact_dedup.exact_dedup(spark.read.parquet(f"{odd}/documents.parquet"), exact_dedup.second_half()).select("_row", "doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(map(repr, (x for x in found if x[2] == 3))) == sorted(map(repr, [(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False)]))
    assert {x for x in found if x[0] in (2, 3)} == {(2, 3, 2, False), (3, 3, 2, True)}
    assert sum(x[3] for x in found) == 6


def test_simhash_of_odd_rows(spark, odd):
    rows = simhash_dedup.near_duplicates(spark.read.parquet(f"{odd}/documents.parquet")).collect()
    empty = {r["doc_id"]: r["component_id"] for r in rows if r["code"] == 0}
    assert empty == {2: 2, 3: 2, 6: 2}
    assert sum(r["first"] for r in rows if r["code"] == 0) == 1
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {1, None}


def test_mix_of_odd_rows(spark, odd):
    rows = {(r["doc_id"], r["size"]): r for r in curriculum_mix.op7_curriculum_mix(spark, odd).collect()}
    assert rows[2, 0]["taken"] == 0 and rows[5, 30_001]["size"] == 30_001
    assert rows[2, 0]["source_size"] == 4  # the null source: this row and the one without an id


def test_decontamination_of_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    items = [(9, "alpha beta gamma", "delta"), (8, None, None), (7, "gamma alpha", None), (6, "other", "text"), (5, "SAME", None), (4, "word", "end"), (3, "...", "!")]
    rows = decontaminate.leaked_items(docs, spark.createDataFrame(items, "item_id long, question string, answer string")).collect()
    found = sorted((r["item_id"], r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert found == [(4, False, 5), (5, False, 5), (6, False, 5), (9, False, 1), (9, False, 1), (9, True, 0)]


def test_scores_of_empty_texts(spark, odd):
    rows = {(r["doc_id"], r["n_tokens"]): r for r in brown_ngrams.op10_brown_ngrams(spark, odd).collect()}
    assert rows[2, 1]["score"] == rows[3, 1]["score"] == rows[6, 1]["score"] < 0
    toxic = {r["doc_id"]: r["score"] for r in pu_toxicity.op5_pu_toxicity(spark, odd).collect()}
    assert toxic[2] == toxic[3] == toxic[6] and 0 <= toxic[2] <= 1
    quality = {r["doc_id"]: r["tail"] for r in ordinal_quality.op4_ordinal_quality(spark, odd).collect()}
    assert quality[2] == quality[3] == quality[6]


def test_tokens_of_empty_and_long_texts(spark, odd):
    rows = {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in prefix_tokens.op6_prefix_tokens(spark, odd).collect()}
    assert rows[2, 0] == rows[3, 0] == rows[6, 4] == 0 and rows[5, 150_003] == 30_001


def test_licenses_of_odd_rows(spark, odd):
    df = license_rules.scan_licenses(spark.read.parquet(f"{odd}/documents.parquet"))
    assert df.where(F.size("licenses") > 0).count() == 0


# -- stages of the pipeline -----------------------------------------------------

CLASH = DOC + ", copy string, position double, confirmed boolean, _text string, train boolean, code long"
STAGE_ROWS = [(*r, "c", 2.0, True, "t", False, 9) for r in ROWS]


@pytest.fixture(scope="module")
def clashing(stored):
    return stored({"documents": (STAGE_ROWS, CLASH), "labels": (LABELS, "doc_id long, quality int, toxic int"), "benchmark": (ITEMS, "item_id long, text string")})


def kept_rows(df, columns):
    return sorted(map(repr, (tuple(r) for r in df.select(columns).collect())))


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize(
    ("name", "dropped"),
    [
        ("toxicity", []),
        ("exact_dedup", [1, 2, 4]),  # the first with the largest id stays
        ("simhash_near_dedup", [1, 3, 4, 8]),  # the first with the smallest id stays; the words of row 8 are none
        ("decontaminate", []),
    ],
)
def test_stages_on_odd_and_clashing_rows(spark, clashing, name, dropped):
    docs = spark.read.parquet(f"{clashing}/documents.parquet")
    got = stages()[name](spark, docs, clashing)
    assert got.columns == docs.columns and got.schema == docs.schema
    assert kept_rows(got, docs.columns) == sorted(repr(tuple(r)) for i, r in enumerate(STAGE_ROWS) if i not in dropped)


def test_decontamination_stage_drops_what_the_query_finds(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r["doc_id"] for r in decontaminate.op2_decontaminate(spark, sf_dir).collect()}
    kept = {r["doc_id"] for r in stages()["decontaminate"](spark, docs, sf_dir).select("doc_id").collect()}
    assert found and kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - found


def test_mix_stage_on_odd_and_clashing_rows(spark, clashing):
    docs = spark.read.parquet(f"{clashing}/documents.parquet")
    got = stages()["mix_sources"](spark, docs, clashing)
    assert got.columns == [*docs.columns, "copy_", "position_"]
    mix = curriculum_mix.curriculum_mix(docs).agg(F.sum("copies")).first()[0]
    rows = got.collect()
    assert len(rows) == mix and {r["copy"] for r in rows} <= {"c"}
    assert [r["position_"] for r in rows] == sorted(r["position_"] for r in rows)


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "simhash_near_dedup", "decontaminate", "mix_sources"])
def test_stages_of_empty_tables(spark, none, name):
    got = stages()[name](spark, spark.read.parquet(f"{none}/documents.parquet"), none)
    assert got.collect() == [] and set(DOC.replace(",", "").split()[::2]) <= set(got.columns)


@pytest.mark.parametrize("most", [10**6, 3])
def test_row_screens_with_few_and_many_keys(spark, most):
    rows = cut(spark.range(2_000).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    keys = cut(spark.range(100, 2_000, 7).select(F.col("id").alias("k")))
    found = fuse_filter.may_be_in(keys, "k", most)
    assert (found is None) == (most == 3)
    if found is not None:
        passed = {r["k"] for r in rows.where(found).collect()}
        assert set(range(100, 2_000, 7)) <= passed and len(passed) < 330
    assert fuse_filter.rows_in(rows, keys, "k").count() == keys.count()
    assert fuse_filter.rows_not_in(rows, keys, "k").count() == 2_000 - keys.count()
