"""Operators on small hand-made rows: the cases that tables don't have."""

import hashlib
import hmac
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corploom import session
from corploom.functions import text as T
from corploom.operators import chains, classify, extract, identity, inventory, joins, lines, merge, overlap, pairing, project, quality, search, search_index, similar
from corploom.operators.apply import apply_cleaner
from corploom.sources import keyed, readers, sinks
from corploom.streaming import ingest


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'long'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column.alias("x")).first()["x"]


# -- identities ---------------------------------------------------------------


def test_keyed_id_is_hmac(spark):
    for key in (b"k", b"long key " * 20):
        want = "src_" + hmac.new(key, b"url\0https://a/", hashlib.sha256).hexdigest()[:32]
        assert one(spark, T.keyed_id("url", F.col("u"), key), u="https://a/") == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Ex.COM", "https://ex.com/"),
        ("http://a.b:80/x?q=1#f", "http://a.b/x?q=1"),
        ("https://a.b:8443/", "https://a.b:8443/"),
        ("ftp://a.b/", None),
        ("https://user@a.b/", None),
        ("no url", None),
        ("https://a.b/x/../y/./z/..", "https://a.b/y/"),
        ("https://a.b/%2e%2E/a b/é?q=a b'", "https://a.b/a%20b/%C3%A9?q=a%20b%27"),
        ("http://[2001:DB8::1]:80/a", "http://[2001:db8::1]/a"),
        ("https:\\\\a.b", None),
        (" https://a.b/\\x ", "https://a.b//x"),
        ("https://a.b:0443/..", "https://a.b/"),
        ("https://b\u00fccher.de/", "https://xn--bcher-kva.de/"),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, T.canonical_url(F.col("u")), u=url) == want


def test_slug_and_slices(spark):
    assert one(spark, T.slug(F.col("t"), most=9), t="  Hello, World! again") == "hello-wor"
    assert one(spark, T.smart_slice(F.col("t"), 12), t="One two. Three four five") == "One two."
    assert one(spark, T.smart_slice(F.col("t"), 12), t="A. Three four five six") == "A. Three fou"
    assert one(spark, T.trim_white(F.col("t")), t=" 　 a b ﻿\n") == "a b"
    assert one(spark, T.normalize_text(F.col("t")), t="ＡＢ，c!!") == "ab c"


def test_headers(spark):
    docs = spark.createDataFrame([(1, "x\n\nTitle\n====\n\noriginal me 2024-01-02 03:04 here\n\n> from: [u](u)\n"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in identity.parse_fixed_header(docs).collect()}
    assert got[1] == ("Title", "original", "me", "2024-01-02 03:04", "here", "u")
    assert set(got[2]) == set(got[3]) == {None}
    loose = {r["doc_id"]: r["review"] for r in identity.parse_loose_header(docs).collect()}
    assert set(loose.values()) == {"needs_review"}


# -- lines ----------------------------------------------------------------------

TEXTS = [(1, "a\n\n \n \nb\n"), (2, ""), (3, None), (4, "\n\n\n"), (5, "é\nü"), (6, "  \nx\n\n")]


def test_lines_round_trip(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    exploded = lines.explode_lines(docs)
    for r in exploded.collect():
        raw = dict(TEXTS)[r["doc_id"]].encode()
        assert raw[r["byte_start"] : r["byte_end"]].decode() == r["text"]
        assert r["has_lf"] == (raw[r["byte_end"] : r["byte_end"] + 1] == b"\n")
    back = {r["doc_id"]: r["text"] for r in lines.reassemble(exploded).collect()}
    assert back == {i: t if t.endswith("\n") else t + "\n" for i, t in TEXTS if t}


def test_blank_runs(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.reassemble(lines.collapse_blank_runs(lines.explode_lines(docs))).collect()}
    assert got == {1: "a\n\nb\n", 5: "é\nü\n", 6: "\nx\n"}


def test_eligibility_in_order(spark):
    rows = [(1, b"\xff\r", "strict"), (2, b"a\r\n", "odd"), (3, b"a\r\n", "strict"), (4, b"a", "strict"), (5, b"a", "loose"), (6, b"a\n", "strict")]
    docs = spark.createDataFrame(rows, "doc_id long, text binary, mode string")
    got = [r["w"] for r in docs.select("doc_id", lines.eligibility(F.col("text"), F.col("mode")).alias("w")).orderBy("doc_id").collect()]
    assert got == ["INVALID_UTF8", "BAD_MODE", "HAS_CR", "NO_FINAL_LF", None, None]


def test_changes_are_checked(spark):
    none, lf = lines.EMPTY_SHA256, lines.LF_SHA256
    assert (none, lf) == tuple(hashlib.sha256(x).hexdigest() for x in (b"", b"\n"))
    rows = [
        (1, "r", "delete", [2, 3], "a", none),
        (2, "r", "delete", [2, 4], "a", none),
        (3, "r", "normalize", [1], "a", "b"),
        (4, "r", "delete", [3, 3], "a", none),
        (5, "no", "delete", [1], "a", none),
        (6, "r", "delete", [1], "a", "left"),
        (7, "eof", "append_eof", None, none, lf),
        (8, "eof", "append_eof", [4], none, lf),
        (9, "eof", "append_eof", None, none, none),
        (10, "r", "delete", None, "a", none),
    ]
    ledger = spark.createDataFrame(rows, "doc_id long, rule_id string, kind string, lines array<int>, before_sha256 string, after_sha256 string")
    kinds = spark.createDataFrame([("r", "delete"), ("eof", "append_eof")], "rule_id string, kind string")
    got = sorted((r["doc_id"], r["rule"]) for r in lines.verify_changes(ledger, kinds).collect())
    assert got == [(2, "DELETE_NOT_CONTIGUOUS"), (3, "KIND"), (4, "LINES_NOT_INCREASING"), (5, "KIND"), (6, "DELETE_LEAVES_TEXT"), (8, "EOF"), (9, "EOF"), (10, "NO_LINES")]


def test_last_lf_in_the_ledger(spark):
    rows = [(1, "eof", "append_eof", None, "", "\n"), (1, "r", "delete", 2, "x", None)]
    ledger = lines.change_ledger(spark.createDataFrame(rows, "doc_id long, rule_id string, kind string, line int, before string, after string"))
    kinds = spark.createDataFrame([("r", "delete"), ("eof", "append_eof")], "rule_id string, kind string")
    assert lines.verify_changes(ledger, kinds).collect() == []


def test_arrays_of_lines_equal_tables_of_lines(spark):
    docs = spark.createDataFrame([*TEXTS, (7, "x\n" * 500 + "\n\n \n" + "é\n" * 300)], "doc_id long, text string")
    lines_of = docs.select("doc_id", lines.line_array(F.col("text")).alias("l"))
    exploded = {(r["doc_id"], r["line"]): tuple(r) for r in lines.explode_lines(docs).collect()}
    raw = {r["doc_id"]: r["text"].encode() for r in docs.where("text IS NOT NULL").collect()}
    assert all(raw[i][r[4] : r[5]].decode() == r[2] for (i, _), r in exploded.items()) and len(exploded) > 800
    got = {r["doc_id"]: r["t"] for r in lines_of.select("doc_id", lines.joined(lines.collapse_blanks(F.col("l"))).alias("t")).collect() if r["t"]}
    assert got == {r["doc_id"]: r["text"] for r in lines.reassemble(lines.collapse_blank_runs(lines.explode_lines(docs))).collect()}


def test_lines_are_cut_without_a_shuffle(spark, sf_dir):
    from corploom.plans import QUERIES

    for name in ("explode_lines", "collapse_blank_runs", "reassemble_hash", "mentions"):
        assert "Exchange hashpartitioning" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


# -- fields ----------------------------------------------------------------------


def test_steps_and_prefixes(spark):
    text = "1. Ask: why now\n2. Ask: why here\n3. see http://x\n4) Plan the work well\n"
    steps = one(spark, extract.extract_steps(F.col("t")), t=text)
    assert [(s["step"], s["name"], s["action"]) for s in steps] == [(1, "Ask", "why now"), (2, "Plan the w", "Plan the work well")]
    assert one(spark, extract.extract_steps(F.col("t")), t="1. only") == []
    assert one(spark, extract.prefix_dedup(F.col("a"), 3), a=["abcd", "abce", "xyz", "abc"]) == ["abcd", "xyz"]


def test_classify_ties_and_default(spark):
    rules = (("b", 2, (), ("x",)), ("a", 1, (), ("x",)), ("c", 3, ("big",), ()))
    assert one(spark, classify.classify(F.col("t"), rules), t="X") == "a"
    assert one(spark, classify.classify(F.col("t"), rules), t="x big") == "c"
    assert one(spark, classify.classify(F.col("t"), rules), t="none") == "00"


def test_prompts(spark):
    assert one(spark, project.replace_layer(F.col("p"), "x", F.col("s")), p="a [x] b", s=["1", "2"]) == "a [x] 1; 2"
    assert one(spark, project.replace_layer(F.col("p"), "x", F.col("s")), p="a", s=["1"]) is None
    assert tuple(one(spark, classify.fidelity(F.col("p"), F.col("n"), "must", "stop"), p="short", n="")) == (0, ["short"])
    # What the name's own sentence says doesn't count.
    rest = " and so on with more words for the length of it"
    got = one(spark, classify.fidelity(F.col("p"), F.col("n"), "must", "stop"), p="Use Name, which must stop." + rest, n="Name")
    assert tuple(got) == (10, ["-length", "-protocol", "-gate", "+name", "-layers"])
    whole = "[mode] a [protocol] you must [gate] stop if [format] b" + rest * 3
    assert one(spark, classify.fidelity(F.col("p"), F.col("n"), "must", "stop"), p=whole, n="")["value"] == 100


# -- joins, inventories, chains ---------------------------------------------------


def test_mentions_overlap(spark):
    docs = spark.createDataFrame([(1, "aaa b.b"), (2, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("aa",), ("b.b",), ("zz",)], "term string")
    assert sorted(tuple(r) for r in joins.mentions(docs, terms).collect()) == [(1, "aa", 1), (1, "aa", 2), (1, "b.b", 5)]


def test_chains_break(spark):
    rows = [("s", "a", 0, 1), ("s", "b", 5, 2), ("s", "b", 6, 3), ("s", "c", 7, 4), ("s", "d", 100, 5), ("s", "e", 101, 6), ("s", "d", 102, 7)]
    got = [r["names"] for r in chains.chains(spark.createDataFrame(rows, "source string, name string, position long, ord int"), 10).orderBy("chain_no").collect()]
    assert got == [["a", "b"], ["b", "c"], ["d", "e"]]


def test_jaccard_and_differentiation(spark):
    sets = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("c", "q")], "id string, term string")
    assert [tuple(r) for r in joins.pairwise_jaccard(sets).collect()] == [("a", "b", pytest.approx(1 / 3))]
    ids = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert {r["id"]: r["score"] for r in joins.differentiation(ids, sets).collect()} == {"a": 89, "b": 89, "c": 100, "d": 100}
    copies = sets.union(sets.where("id = 'a'").select(F.lit("z"), "term"))
    assert sorted(tuple(r) for r in joins.term_classes(copies)[0].collect()) == [("a", "a"), ("b", "b"), ("c", "c"), ("z", "a")]
    both = joins.differentiation(copies.select("id"), copies)
    assert {r["id"]: r["score"] for r in both.collect()} == {"a": 56, "z": 56, "b": 78, "c": 100}


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_rarest_terms_find_all_similar_sets(spark, least):
    rng = random.Random(5)
    sets = {i: {rng.randrange(12) for _ in range(rng.randrange(1, 9))} for i in range(120)}
    rows = spark.createDataFrame([(i, f"t{x}") for i, s in sets.items() for x in s], "id long, term string")
    reps = {r["id"] for r in joins.term_classes(rows)[0].where("id = rep").collect()}
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}
    assert {(r["a"], r["b"]) for r in joins.pairwise_jaccard(rows, least).collect()} == want


def test_sizes_of_broadcast_tables_are_checked(spark):
    with pytest.raises(ValueError, match="more than 10 rows"):
        session.small(spark.range(11), 10)


def test_ranks_number_groups_over_ranges(spark):
    rows = spark.range(1_000).select((F.col("id") * 37 % 1_000).alias("o"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"))
    got = inventory.ranks(rows, "g", "o").collect()
    for g in ("a", "b", None):
        mine = sorted((r["o"], r["rank"]) for r in got if r["g"] == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1)) and len(mine) > 300


def test_pilot_ids_are_known_and_listed_once(spark):
    ids = spark.range(5).withColumnRenamed("id", "k")
    assert [tuple(r) for r in inventory.pilot_set(ids, "k", 9, [3, 1]).orderBy("ord").collect()] == [(1, 3), (2, 1)]
    with pytest.raises(ValueError, match="twice"):
        inventory.pilot_set(ids, "k", 9, [1, 1])
    with pytest.raises(Exception, match="unknown id 7"):
        inventory.pilot_set(ids, "k", 9, [7]).collect()


def test_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base), (2, base + " end"), (3, base), (4, "quite another text that has five words"), (5, ""), (6, None)]
    got = inventory.near_copy_candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2)]


def _shuffled_bytes(spark, df):
    """Bytes that the stages of ``df``'s own plan write to shuffles (checkpoints taken before are not counted)."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.metrics().contains("shuffleBytesWritten"):
            found += node.metrics().apply("shuffleBytesWritten").value()
        if node.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
            todo.append(node.plan())
        todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return found


def test_similar_pairs_of_a_large_group_and_odd_sets_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(60) for _ in range(40)]
    group = [sorted({*base[: 40 - rng.randrange(4)], *(rng.getrandbits(60) for _ in range(rng.randrange(4)))}) for _ in range(60)]
    others = [sorted({rng.randrange(30) for _ in range(rng.randrange(1, 12))}) for _ in range(120)]
    sets = [list(x) for x in {tuple(s) for s in group + others}]
    rows = [(f"d{i}", s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id string, terms array<long>")
    for least in (0.5, 0.8, 1.0):
        want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) >= least * len(set(x) | set(y))}
        got = similar.similar_pairs(df, least).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]): r["jaccard"] for r in got} == pytest.approx(want)


def test_near_copies_shuffle_neither_unlike_texts_nor_pairs(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    core = text(400)
    docs = [(i, text(400)) for i in range(300)] + [(1_000 + i, f"{core} v{i}") for i in range(200)] + [(2_000 + i, f"{core} V0") for i in range(50)] + [(900, core)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    df = inventory.near_copy_candidates(spark.read.parquet(str(tmp_path / "docs")))
    assert df.count() == 201 * 200 // 2 and df.where("a = 900").count() == 200
    bytes_of_pairs = 201 * 200 // 2 * 400 * 8
    assert _shuffled_bytes(spark, df) < bytes_of_pairs / 50


def test_long_texts_of_common_passages_are_no_candidates(spark, tmp_path):
    """Any two share passages by chance, none four fifths of them; only the sets of the two that do are shuffled."""
    rng = random.Random(6)
    passages = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(150)) for _ in range(200)]
    docs = [(i, " ".join(rng.sample(passages, 10))) for i in range(300)]
    docs += [(1_000, docs[7][1] + " end"), (1_001, docs[7][1] + " END"), (1_000, docs[7][1] + " end")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    df = inventory.near_copy_candidates(spark.read.parquet(str(tmp_path / "docs")))
    assert [(r["a"], r["b"]) for r in df.collect()] == [(7, 1_000)]
    assert _shuffled_bytes(spark, df) < 1500 * 8 * 10


@pytest.mark.parametrize(("sent", "block_sets"), [(similar.SENT, similar.BLOCK_SETS), (0, 3)])
def test_similar_sets_of_sizes_around_that_of_samples_equal_brute_force(spark, monkeypatch, sent, block_sets):
    monkeypatch.setattr(similar, "SENT", sent)
    monkeypatch.setattr(similar, "BLOCK_SETS", block_sets)
    rng = random.Random(7)
    sets = []
    for size in (5, 27, 100, 280, 299, 300, 340, 374, 376, 400, 470, 900):
        base = [rng.getrandbits(62) for _ in range(size)]
        for lost, more in ((0, 0), (0.1, 0), (0, 0.11), (0.1, 0.1), (0.11, 0.11), (0.2, 0), (0, 0.25), (0.21, 0)):
            kept = rng.sample(base, size - int(lost * size))
            sets.append([*kept, *(rng.getrandbits(62) for _ in range(int(more * size)))])
    rows = [(i, s) for i, s in enumerate(sets)]
    want = {(a, b): len({*x} & {*y}) / len({*x} | {*y}) for a, x in rows for b, y in rows if a < b and len({*x} & {*y}) >= 0.8 * len({*x} | {*y}) and {*x} != {*y}}
    equal = {b for a, x in rows for b, y in rows if a < b and {*x} == {*y}}
    df = spark.createDataFrame([*rows, (99, []), (98, None)], "id long, terms array<long>")
    got = {(r["a"], r["b"]): r["jaccard"] for r in similar.similar_pairs(df, 0.8).collect()}
    assert len(got) > 80 and got == pytest.approx({k: v for k, v in want.items() if not equal & {*k}})


def test_terms_of_one_code_are_not_shared(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(-9, 9), rng.randrange(4)) for _ in range(30)] + [(99, 1)] * 9 + [(98, i % 2) for i in range(9)]
    codes = {t: {c for x, c in rows if x == t} for t, _ in rows}
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    try:
        for n in (1, 2, 3, 1000):
            spark.conf.set(conf, n)
            got = [tuple(r) for r in similar._shared(spark.createDataFrame(rows, "term long, code long")).collect()]
            assert sorted(got) == sorted((t, c) for t, cs in codes.items() if len(cs) > 1 for c in cs)
    finally:
        spark.conf.set(conf, before)


def test_what_similar_sets_surely_share():
    assert [similar.sure(128, t) for t in (0.1, 0.8, 1.0)] == [0, 54, 128]
    for n, least in ((128, 0.8), (40, 0.8), (128, 0.5)):
        few = range(similar.sure(n, least))
        assert 0 < sum(math.comb(n, k) * least**k * (1 - least) ** (n - k) for k in few) <= 2**-64


def test_merges_with_null_keys(spark):
    base = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k long, v string")
    updates = spark.createDataFrame([(None, "N"), (3, "c")], "k long, v string")
    assert sorted(map(repr, (tuple(r) for r in merge.upsert_replace(base, updates, ["k"]).collect()))) == ["(1, 'a')", "(2, 'b')", "(3, 'c')", "(None, 'N')"]
    again = merge.upsert_replace(merge.upsert_replace(base, updates, ["k"]), updates, ["k"])
    assert again.count() == 4
    good, twice = merge.split_duplicates(updates.union(updates.limit(1)), ["k"])
    assert (good.count() <= 2, twice.count()) == (True, 1)


# -- checks, search, io ------------------------------------------------------------


def test_a_search_shuffles_no_tokens_and_equals_the_index(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, rng.choice(["b", "a", None, "w3"]), text(rng.randrange(12))) for i in range(700)] + [(700, "c", None), (None, "a", "w1 w2")]
    spark.createDataFrame(docs, "doc_id long, title string, text string").write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    queries = spark.createDataFrame([(i, text(rng.randrange(5))) for i in range(40)] + [(99, "w3"), (98, "none of these")], "query_id long, query string")
    weights = [("title", 5), ("text", 2)]
    search_index.add_version(stored, weights, str(tmp_path / "index"), 1)
    for k, least in ((3, 1), (20, 3)):
        want = sorted(map(repr, map(tuple, search_index.search_index(spark, str(tmp_path / "index"), queries, k, least).collect())))
        found = search.search(stored, queries, weights, k, least)
        assert sorted(map(repr, map(tuple, found.collect()))) == want
    assert _shuffled_bytes(spark, search.search(stored, queries, weights, 1)) < 20_000


def test_rows_dealt_anew_are_tasks_by_size(spark):
    df = spark.range(400_000).repartition(8)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        parts = [len(p) for p in sinks.redealt(df).rdd.glom().map(lambda rows: [0] * len(rows)).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before or "64MB")
    assert sum(parts) == 400_000 and len(parts) > 12 and max(parts) < 100_000


def test_nfkc_holds_one_slice_as_strings():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, "", "\uff11\ufb01x", *("\ufb01\uff11 a" * 4_000 + str(i) for i in range(300))])
    tracemalloc.start()
    got = T.nfkc_array(texts, 1 << 18)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist()[:4] == [None, "", "1fix", "fi1 a" * 4_000 + "0"] and len(got) == 303 and peak < 4 << 20
    assert len(T.nfkc_array(texts.slice(0, 0))) == 0


def test_relations(spark):
    edges = spark.createDataFrame([(1, 1, "s"), (1, 2, "s"), (2, 1, "s"), (2, 3, "s"), (1, 9, "o"), (8, 1, "o")], "from long, to long, type string")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert sorted(tuple(r) for r in quality.relation_checks(edges, nodes, ["s"]).collect()) == [("DANGLING", 1, 9), ("DANGLING", 8, 1), ("SELF", 1, 1), ("UNPAIRED", 2, 3)]


def test_route_ties(spark):
    inputs = spark.createDataFrame([(1, "x y"), (2, "x danger"), (3, "nothing"), (4, "x no")], "id long, text string")
    routes = (("r1", 1, 1.0, "m1", ()), ("r2", 1, 1.0, "m2", ("a", "b", "c")))
    terms = (("r1", "x", 1.0), ("r2", "y", 1.0))
    got = {r["id"]: (r["kind"], r["route"]) for r in search.match_route(inputs, routes, terms, (("r1", "no"),), (("s", 1, "danger"),)).collect()}
    assert got == {1: ("none", None), 2: ("safety", "s"), 3: ("none", None), 4: ("none", None)}


def test_tokens_have_han_bigrams(spark):
    assert one(spark, search.tokenize(F.col("t")), t="ABC 思维模") == ["abc 思维模", "abc", "思维模", "思维", "维模"]


def test_jsonl_codes(spark):
    files = spark.createDataFrame([("f", '{"k": 1}\n\n{bad\n{"k": 2}')], "file string, text string")
    assert [(r["line_no"], r["code"]) for r in readers.jsonl_lines(files, "k long").orderBy("line_no").collect()] == [(1, None), (2, "EMPTY_LINE"), (3, "BAD_JSON"), (4, "NO_FINAL_LF")]


def test_numbers_that_json_cannot_hold_fail(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "id long, v double")
    assert rows.where("id = 1").select(sinks.canonical_json(rows).alias("j")).first()["j"] == '{"id":1,"v":2.0}'
    with pytest.raises(Exception, match="not finite"):
        rows.select(sinks.canonical_json(rows)).collect()


def test_publishing_again_points_to_the_run_that_is_there(spark, tmp_path):
    one_, two = (spark.createDataFrame([(1, t)], "id long, a string") for t in "ab")
    first = sinks.publish_run(one_, "id", str(tmp_path))
    sinks.publish_run(two, "id", str(tmp_path))
    assert sinks.publish_run(one_, "id", str(tmp_path)) == first
    assert sinks.read_current_run(spark, str(tmp_path), "id")[0].first()["a"] == "a"
    # Without its report a run counts as unfinished and is written over.
    (tmp_path / "runs" / first / "report").rename(tmp_path / "gone")
    spark.createDataFrame([(9, "x")], "id long, a string").write.mode("overwrite").parquet(f"{tmp_path}/runs/{first}/rows")
    assert sinks.publish_run(one_, "id", str(tmp_path)) == first
    assert sinks.read_current_run(spark, str(tmp_path), "id")[1].count() == 0
    # One that isn't what its report says is not published.
    spark.createDataFrame([(9, "x")], "id long, a string").write.mode("overwrite").parquet(f"{tmp_path}/runs/{first}/rows")
    with pytest.raises(ValueError, match="report"):
        sinks.publish_run(one_, "id", str(tmp_path))


def test_names_of_all_pattern_families(spark):
    text = "Chapter 2: The long way (x)\nIV. Roman part\n3. Third thing, more\n2.1 Sub part\nStep 4: Do it\n**Bold name** here.\nWe use the halo effect, a rule of law."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {(r["type"], r["name"]) for r in extract.candidates(docs, extract.name_patterns(), ["halo"]).collect()}
    names = {("heading", n) for n in ("The long way", "Roman part", "Third thing", "Sub part", "Do it")}
    assert got == {*names, ("bold", "Bold name"), ("suffix", "We use the halo effect"), ("suffix", "a rule of law"), ("suffix", "a rule"), ("known", "halo")}


def test_claims_break_their_first_rule(spark):
    ok, seen, sure = "source_statement", "cross_source_consensus", "independently_verified"
    claims = [("a", "t", ok), ("b", "t", ok), ("c", "", ok), ("d", "t", seen), ("e", "t", seen), ("f", "t", sure), ("g", "t", sure), ("h", "t", "rumour"), ("", "t", ok), ("i", "t", ok)]
    refs = [("a", 1, "x", 0, "OK"), ("d", 1, "x", 0, "OK"), ("d", 1, "x", 1, "OK"), ("e", 1, "x", 0, "OK"), ("e", 2, "x", 1, "OK"), ("f", 1, "x", 0, "OK"), ("g", 1, "verification_record", 0, "OK"), ("i", 1, "x", 0, "OK"), ("i", 1, "x", 1, "LINE_RANGE"), ("i", 1, "x", 2, "UNKNOWN_SOURCE")]
    found = quality.check_claims(spark.createDataFrame(claims, "claim_id string, text string, claim_status string"), spark.createDataFrame(refs, "claim_id string, source_id long, kind string, ord int, verdict string"))
    assert {r["claim_id"]: r["rule"] for r in found.collect()} == {"b": "NO_REFS", "d": "QUORUM", "f": "VERIFICATION", "h": "STATUS", "": "CLAIM_ID", "i": "LINE_RANGE"}


def test_contract_types_and_nulls(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "x", None)], "k long, a string, b string")
    got = quality.check_contract(rows, "k", [("a", "min_length", 1), ("b", "regex", "."), ("b", "nullable", None), ("a", "type", "int")]).collect()
    assert sorted((r["rule"], r["key"] or "", r["path"]) for r in got) == [("min_length", "1", "a"), ("type", "", "a")]


def test_search_orders_ties_and_counts_terms_once(spark):
    docs = [(3, "b", "x x y"), (1, "b", "x"), (2, "a", "x"), (4, "c", "z"), (5, None, "x")]
    found = search.search(spark.createDataFrame(docs, "doc_id long, title string, text string"), spark.createDataFrame([(1, "X y"), (2, ""), (3, None)], "query_id long, query string"), [("title", 5), ("text", 2)], k=4)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(1, 3, 4, 1), (1, 5, 2, 2), (1, 2, 2, 3), (1, 1, 2, 4)]


def test_search_keeps_the_best_of_many(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lpad((F.col("id") * 7919 % 3_000).cast("string"), 5, "0").alias("title"), F.when(F.col("id") % 10 == 0, "x y").otherwise("x").alias("text"))
    found = search.search(docs, spark.createDataFrame([(1, "x y")], "query_id long, query string"), [("text", 1)], k=5).collect()
    best = sorted((f"{i * 7919 % 3_000:05}", i) for i in range(0, 3_000, 10))[:5]
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["rank"])] == [i for _, i in best]


def test_runs_are_checked(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0, "b"), (2, None, "a")], "id long, v double, a string")
    run = sinks.publish_run(rows, "id", str(tmp_path))
    assert sinks.run_id(rows.orderBy(F.desc("id")), "id").first()["run_id"] == run
    got, bad = sinks.read_current_run(spark, str(tmp_path), "id")
    assert got.count() == 2 and bad.count() == 0
    spark.createDataFrame([(1, "0"), (3, "0")], "id long, sha256 string").write.mode("overwrite").parquet(f"{tmp_path}/runs/{run}/catalog")
    assert sorted(r["id"] for r in sinks.read_current_run(spark, str(tmp_path), "id")[1].collect()) == [1, 2, 3]


def test_cleaner_errors_name_the_source(spark):
    docs = spark.createDataFrame([(7, "x")], "doc_id long, text string")
    with pytest.raises(Exception, match="doc_id 7"):
        apply_cleaner(docs, lambda key, text: {"wrong": 1}, "doc_id long").collect()


def test_taxonomy_and_markup(spark):
    text = spark.createDataFrame([('{"chapters":[{"id":"01","order":1,"title":"t","allowed_tags":["a","b"],"subchapters":[{"id":"1","order":2,"title":"p"}]}]}',)], "text string")
    chapters, tags, parts = readers.load_taxonomy(text)
    assert chapters.count() == 1 and [r["tag"] for r in tags.collect()] == ["a", "b"]
    assert [tuple(r) for r in parts.collect()] == [("01", "1", 2, "p")]
    pages = spark.createDataFrame([(1, 2, "<style>p{}</style><p>" + "b" * 101), (1, 1, "<p>" + "a" * 101), (1, 3, "<p>short")], "book long, n long, html string")
    assert readers.extract_markup_text(pages, "book", "n").first()["text"] == "a" * 101 + "\n---\n" + "b" * 101


# -- search index, overlaps ------------------------------------------------------------


def by_hand(docs, queries, weights, k):
    """Top k by plain loops; later rows of an id replace earlier ones."""
    words = lambda t: set((t or "").lower().split()) | ({(t or "").lower()} if t else set())
    out = []
    for q, text in queries:
        found = []
        for doc in {d["doc_id"]: d for d in docs}.values():
            score = sum(w for f, w in weights for t in words(text) if t in words(doc[f]))
            if score:
                found.append((-score, doc["title"], doc["doc_id"]))
        out += [(q, d, -s, i) for i, (s, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_index_versions_equal_a_search_by_hand(spark, stored, tmp_path):
    rng = random.Random(3)
    doc = lambda i: {"doc_id": i, "title": f"t{rng.randrange(40)}", "body": " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(30)))}
    old, new = [doc(i) for i in range(900)], [doc(i) for i in range(600, 1100)]
    schema, weights = "doc_id long, title string, body string", [("title", 3), ("body", 1)]
    folder = stored({"old": ([tuple(d.values()) for d in old], schema), "new": ([tuple(d.values()) for d in new], schema)})
    queries = [(i, " ".join(f"w{rng.randrange(70)}" for _ in range(1 + i % 6))) for i in range(40)] + [(90, old[5]["body"]), (91, "t7"), (92, ""), (93, None)]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    path = str(tmp_path / "index")
    found = {}
    for version, name in ((1, "old"), (2, "new")):
        search_index.add_version(spark.read.parquet(f"{folder}/{name}.parquet"), weights, path, version, buckets=8, shard=150)
        found[version] = sorted(tuple(r) for r in search_index.search_index(spark, path, asked, k=7, buckets=8).collect())
    queries = [(q, t) for q, t in queries if t]
    assert found[1] == by_hand(old, queries, weights, 7)
    assert found[2] == by_hand(old + new, queries, weights, 7)
    one = spark.createDataFrame([(1, "w1")], "query_id long, query string")
    as_of = search_index.search_index(spark, path, one, k=7, upto=1, buckets=8).collect()
    assert [tuple(r) for r in as_of] == by_hand(old, [(1, "w1")], weights, 7)


def test_index_opens_the_asked_buckets_only(spark, stored, tmp_path):
    folder = stored({"d": ([(i, f"t{i}", f"a{i} b") for i in range(200)], "doc_id long, title string, body string")})
    search_index.add_version(spark.read.parquet(f"{folder}/d.parquet"), [("body", 1)], str(tmp_path), 1, buckets=16)
    held = search_index.index_postings(spark, str(tmp_path), [3, 5])
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1] and "IN (3,5)" in plan.replace("INSET", "IN").replace(" 5", "5")
    assert {f.split("bucket=")[1].split("/")[0] for (f,) in held.select(F.input_file_name()).distinct().collect()} <= {"3", "5"}


@pytest.mark.parametrize("rows", [7, 64, 4096])
def test_blocked_overlaps_equal_brute_force(spark, rows, monkeypatch):
    rng = random.Random(rows)
    sets = {i: {f"r{rng.randrange(60)}" for _ in range(rng.randrange(1, 6))} | ({"hot"} if rng.random() < 0.5 else set()) for i in range(120)}
    monkeypatch.setattr(overlap, "PAIRS", 100)
    monkeypatch.setattr(overlap, "COLUMNS", 3)
    classes = spark.createDataFrame([(i, sorted(s), i % 3 + 1) for i, s in sets.items()], "rep long, terms array<string>, n long")
    jaccard = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items()}
    found = {(r["a"], r["b"]): r["jaccard"] for r in overlap.overlapping_pairs(classes, rows).collect()}
    assert found.keys() == {(a, b) for (a, b), j in jaccard.items() if a < b and j} and all(abs(jaccard[p] - j) < 1e-12 for p, j in found.items())
    sums = {r["rep"]: r["s"] for r in overlap.overlap_sums(classes, rows).collect()}
    assert all(abs(sums[a] - sum(jaccard[a, b] * (b % 3 + 1) for b in sets if b != a)) < 1e-9 for a in sets)


def test_overlaps_of_nothing(spark):
    none = spark.createDataFrame([], "rep string, terms array<string>, n long")
    assert overlap.overlapping_pairs(none).collect() == overlap.overlap_sums(none).collect() == []


# -- lexicons, sweeps, streams ------------------------------------------------------------


def test_one_pass_finds_overlapping_hits_of_many_terms(spark):
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(400)} | {f"none{i}" for i in range(50_000)})
    texts = [(i, "".join(rng.choice("abé ") for _ in range(rng.randrange(60)))) for i in range(40)] + [(98, ""), (99, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    lexicon = spark.createDataFrame([(t,) for t in [*terms, "", None, "a"]], "term string")
    found = sorted(tuple(r) for r in joins.mentions(docs, lexicon).collect())
    assert found == sorted((i, t, at + 1) for i, x in texts for t in terms if x and t in x for at in range(len(x)) if x.startswith(t, at))
    first = {(r["doc_id"], r["term"]): r["context"] for r in extract.kwic(docs, lexicon, 5).collect()}
    assert first == {(i, t): x[max(x.index(t) - 5, 0) : x.index(t) + len(t) + 5] for i, x in texts for t in terms if x and t in x}
    assert joins.mentions(docs, lexicon.limit(0)).collect() == []


def test_audit_sweep_equals_all_pairs_and_takes_long_documents(spark):
    rng = random.Random(9)
    span = lambda: (rng.randrange(3), (a := rng.randrange(40)), a + rng.randrange(-1, 12))
    spans, held = [span() for _ in range(150)] + [(0, None, 4), (1, 3, None)], [span() for _ in range(30)] + [(2, None, 99)]
    schema = "doc_id long, start long, end long"
    got = [tuple(r) for r in lines.verify_audit(spark.createDataFrame(spans, schema), spark.createDataFrame(held, schema)).collect()]
    outside = [s for s in spans if not any(h[0] == s[0] and None not in (h[1], s[1], s[2]) and h[1] <= s[1] and s[2] <= h[2] for h in held)]
    assert sorted((r[1:] for r in got if r[0] == "SPAN_OUTSIDE"), key=repr) == sorted(outside, key=repr)
    many = spark.range(100_000).select(F.lit(7).alias("doc_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 5).alias("end"))
    kept = spark.createDataFrame([(7, 0, 500_000), (7, 499_990, 2_000_000)], schema)
    assert lines.verify_audit(many, kept).count() == 0


def test_streams_drop_copies_of_earlier_batches_and_after_a_restart(spark, tmp_path):
    source, catalog, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    text = lambda i: f"document {i} " + "with enough letters to pass the gate " * 5
    schema = "doc_id long, text string"
    held = lambda: sorted(r["text"] for r in spark.read.parquet(catalog).collect())
    want = set()
    for number, ids in enumerate(([1, 2, 2], [2, 3], [1, 3, 4], [4, 5])):
        spark.createDataFrame([(10 * number + k, text(i)) for k, i in enumerate(ids)], schema).coalesce(1).write.mode("append").parquet(source)
        want |= {text(i).strip() for i in ids}
        if number != 1:  # two files wait for the second start
            ingest.ingest_stream(spark, source, catalog, marks, schema, files_per_batch=1).awaitTermination()
            assert held() == sorted(want)
    assert spark.conf.get(ingest.PROVIDER) != ingest.ROCKSDB


def test_batches_of_arrivals_have_files_for_each_part_of_the_table(spark, tmp_path):
    text = F.concat(F.lit("document "), (F.col("id") % 500).cast("string"), F.lit(" with enough letters to pass the gate" * 5))
    docs = spark.range(0, 2_000, 1, 6).select(F.col("id").alias("doc_id"), text.alias("text"))
    for name, rows, per_batch in (("all", docs, 6), ("one", docs.coalesce(1), 1), ("none", docs.where("false"), 1)):
        source, catalog, marks = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "marks"))
        assert ingest.write_arrivals(rows, source, 4, "doc_id") == per_batch
        query = ingest.ingest_stream(spark, source, catalog, marks, docs.schema, files_per_batch=per_batch)
        query.awaitTermination()
        if name != "none":
            assert sorted(p.name for p in (tmp_path / f"{name}-out").iterdir()) == [f"batch={i}" for i in range(4)]
            assert len(list((tmp_path / f"{name}-in").glob("*.parquet"))) == 4 * per_batch
            held = spark.read.parquet(catalog).select("text")
            assert held.count() == held.distinct().count() == 500


def test_documents_are_stripped_once_though_a_gate_follows(spark, sf_dir):
    from corploom.plans import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df in (ingest.curate(docs), QUERIES["curate_documents"](spark, sf_dir)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1


def test_stripping_takes_blanks_tabs_and_lf_from_the_ends_only(spark):
    from corploom.rules import LINE_PATTERNS

    cases = {" \t\nab \n\t": "ab", "ab \r\n": "ab \r", "ab \u2028": "ab \u2028", "ab \u0085": "ab \u0085", "\u00a0ab\u00a0 ": "\u00a0ab\u00a0", " \n\n\n\n\n ": "", "": "", "a\n\n\n\n\nb\n### c\n": "a\n\n\nb", None: None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    for got in (df.withColumn("text", lines.strip_boilerplate(F.col("text"), LINE_PATTERNS)), lines.strip_documents(df, LINE_PATTERNS)):
        assert got.columns == ["doc_id", "text"] and [r["text"] for r in got.orderBy("doc_id").collect()] == list(cases.values())


# -- keyed tables, versions, pairs, hosts, JSON ------------------------------------------------------------


def test_upserts_rewrite_only_the_ranges_they_touch(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string"
    files = lambda: {f.relative_to(path).as_posix() for f in (tmp_path / "t").rglob("*.parquet")}
    base = spark.range(500).select(F.col("id").alias("k"), F.lit("old").alias("v")).union(spark.createDataFrame([(None, "none")], schema))
    keyed.write_keyed(base, path, ["k"])
    before = files()
    touched, twice = keyed.upsert_keyed(spark, path, spark.createDataFrame([(3, "new"), (900, "came"), (None, "null"), (7, "a"), (7, "b")], schema), ["k"])
    assert [r["k"] for r in twice.collect()] == [7] and 1 <= len(touched) <= 3
    kept = {f for f in before if f.split("/")[0].split("=")[1] not in touched}
    assert kept and kept == files() & before
    rows = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert rows == {**dict.fromkeys(range(500), "old"), 3: "new", 900: "came", None: "null"}


def test_versions_are_compared_by_the_ranges_that_differ(spark, tmp_path):
    schema = "k long, v string, m map<string,double>"
    rows = [(i, f"v{i}", {"b": 1.0, "a": float(i)}) for i in range(300)] + [(None, None, None), (5, "again", None)]
    one, two, three, none = (str(tmp_path / x) for x in ("1", "2", "3", "0"))
    first = keyed.write_version(spark.createDataFrame(rows, schema), one, ["k"])
    assert keyed.write_version(spark.createDataFrame(rows[::-1], schema).repartition(3), two, ["k"]) == first
    trees = [spark.read.parquet(f"{x}/tree") for x in (one, two)]
    assert keyed.differing_ranges(*trees) == []
    changed = [(i, "x" if i == 9 else v, m) for i, v, m in rows if i != 4] + [(1000, "n", None)]
    assert keyed.write_version(spark.createDataFrame(changed, schema), three, ["k"]) != first
    ranges = keyed.differing_ranges(trees[0], spark.read.parquet(f"{three}/tree"))
    want = {(9, "changed"), (4, "removed"), (1000, "added")}
    at = spark.createDataFrame([(k,) for k, _ in want], "k long").select(keyed.range_of(["k"])).collect()
    assert ranges == sorted({r[0] for r in at})
    key = spark.createDataFrame([], "k long").schema
    assert {tuple(r) for r in keyed.version_diff(spark, one, three, key).collect()} == want
    assert keyed.write_version(spark.createDataFrame([], schema), none, ["k"]) is None
    assert keyed.version_diff(spark, none, one, key).where("problem <> 'added'").count() == 0 and keyed.version_diff(spark, none, one, key).count() == 301


def test_pairs_of_a_group_of_copies_grow_with_its_rows(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    graded = [(i, "Report", None, "t", " ".join([*words[:40], *(rng.choice(words) for _ in range(3))])) for i in range(3_000)]
    exact = [(10_000 + i, "Report", None, "t", "all the same text here again") for i in range(10_000)]
    docs = spark.createDataFrame(graded + exact, "doc_id long, title string, date date, type string, text string")
    found = pairing.pair_candidates(docs)
    assert 0 < found.count() <= 3 * 5 * 3_001
    members = pairing.text_classes(docs).where("rep = 10000").count()
    assert members == 10_000


def test_pairs_equal_brute_force_over_all_four_features(spark):
    import datetime

    rng = random.Random(6)
    day = lambda: rng.choice([None, *(datetime.date(2024, 1, k) for k in range(1, 12))])
    texts = [" ".join(f"a{rng.randrange(60)}" for _ in range(rng.randrange(30))) for _ in range(25)]
    texts += [t + " " + " ".join("b" for _ in range(k)) for k, t in enumerate(texts)] + [None, ""]
    rows = [(i, rng.choice(["A b", "a-B", "c", "", None]), day(), rng.choice(["x", "y", None]), rng.choice(texts)) for i in range(160)]
    got = {(r["a"], r["b"]): tuple(r)[2:] for r in pairing.pair_candidates(spark.createDataFrame(rows, "doc_id long, title string, date date, type string, text string"), 0.8, 3, 4, block=16).collect()}
    classes = {}
    for r in rows:
        classes.setdefault(r[1:], r[0])
    docs = []
    for (title, date, kind, text), i in classes.items():
        w = (text or "").lower().split()
        s = {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
        docs.append((i, re.sub("[ _-]+", "", (title or "").lower()), date, kind, s, min((hashlib.md5(x.encode()).hexdigest() for x in s), default="")))
    first = lambda x: (x is not None, x or "")
    date_first = lambda x: (x is not None, x or datetime.date.min)
    want = {}
    for order in (lambda d: (d[1], date_first(d[2]), d[0]), lambda d: (first(d[3]), date_first(d[2]), d[0]), lambda d: (d[5], len(d[4]), d[0])):
        placed = sorted(docs, key=order)
        for k, x in enumerate(placed):
            for y in placed[k + 1 : k + 5]:
                p, q = sorted((x, y), key=lambda d: d[0])
                common, either, small = len(p[4] & q[4]), len(p[4] | q[4]), min(len(p[4]), len(q[4]))
                j, c = (round(common / of, 9) if of else 0.0 for of in (either, small))
                title, kind = p[1] == q[1] != "", p[3] is not None and p[3] == q[3]
                gap = abs((p[2] - q[2]).days) if p[2] and q[2] else None
                near = gap is not None and gap <= 3
                found = "near_copy" if j >= 0.8 else "long_short" if c >= 0.8 and (title or kind and near) else "same_title" if title and kind and near else None
                if found:
                    want[p[0], q[0]] = (found, j, c, title, kind, gap)
    assert got == want and {v[0] for v in want.values()} == {"near_copy", "long_short", "same_title"}


def test_pairs_shuffle_texts_not_shingles(spark, tmp_path):
    rng = random.Random(12)
    docs = [(i, f"title {i}", None, "t", "ab " * rng.randrange(3_000, 4_000) + f"end{i}") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, title string, date date, type string, text string").write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    found = pairing.neighbours(stored, pairing.cut(pairing.features(stored)), pairing.ORDERS, 5, 64)
    assert found.count() == 3 * (5 * 400 - 15)
    assert "body" not in str(found.schema) and _shuffled_bytes(spark, found) < 400 * 3_000 * 3


def test_hosts_beyond_ascii_equal_the_idna_codec(spark):
    rng = random.Random(8)
    sign = lambda: chr(rng.choice([rng.randrange(97, 123), rng.randrange(0x430, 0x450), rng.randrange(0x4E00, 0x9000), rng.choice([0xE9, 0xFC, 0xF1, 0x3B1, 0x1F600])]))
    hosts = ["bücher.example", "EXAMPLE.com", "правительство.рф", "中国。cn", "a-b.c", "xn--p1ai.de"] + [".".join("".join(sign() for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    got = [r["a"] for r in spark.createDataFrame(list(enumerate(hosts)), "i long, h string").orderBy("i").select(T.ascii_host(F.col("h")).alias("a")).collect()]
    assert got == [h.lower().encode("idna").decode() for h in hosts]
    assert one(spark, T.canonical_url(F.col("u")), u="HTTPS://Bücher.Example:443/ä#x") == "https://xn--bcher-kva.example/%C3%A4"


def test_canonical_json_looks_at_any_depth(spark):
    df = spark.createDataFrame([(1, {"b": [{"z": 1.0, "a": 2.0}], "a": []})], "id long, m map<string,array<struct<z:double,a:double>>>")
    assert df.select(sinks.canonical_json(df)).first()[0] == '{"id":1,"m":{"a":[],"b":[{"a":2.0,"z":1.0}]}}'
    for kind, value in (("struct<x:array<double>>", (([1.0, float("nan")],))), ("map<string,struct<y:float>>", {"k": (float("inf"),)}), ("array<array<double>>", [[0.0], [float("-inf")]])):
        bad = spark.createDataFrame([(value,), (None,)], f"v {kind}")
        assert [r[0] for r in bad.select(sinks.not_finite(bad)).collect()] == [True, False]


def test_sources_of_a_hot_name_come_in_bounded_lists(spark):
    rows = spark.range(5_000).select(F.lit("Hot name").alias("name"), F.concat(F.lit("s"), F.col("id") % 2_500).alias("source")).union(spark.createDataFrame([("b", "s1"), ("b", None)], "name string, source string"))
    lists = inventory.source_lists(rows, 300).collect()
    assert max(len(r["sources"]) for r in lists) <= 300 and {r["n_sources"] for r in lists if r["norm"] == "hotname"} == {2_500}
    joined = [s for r in sorted(lists, key=lambda r: (r["norm"], r["part"])) for s in r["sources"] if r["norm"] == "hotname"]
    assert joined == sorted(f"s{i}" for i in range(2_500))
