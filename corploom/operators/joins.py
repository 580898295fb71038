"""Joins by key and by content. Content joins against small rule tables broadcast them; larger dictionaries go by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.operators.lexicon import lexicon_terms, scan_terms
from corploom.operators.overlap import overlap_sums, overlapping_pairs
from corploom.operators.similar import similar_pairs
from corploom.session import cut, small


def assign_ids(catalog: DataFrame, known: DataFrame, key: str, minted: Column) -> DataFrame:
    """Keeps a key's id, mints one where there is none."""
    return catalog.join(known.select(key, "id"), key, "left").withColumn("reused", F.col("id").isNotNull()).withColumn("id", F.coalesce("id", minted))


def id_conflicts(known: DataFrame, key: str) -> DataFrame:
    """(rule, value): keys with more than one id, and ids of more than one key; assign_ids() wants neither."""
    twice = lambda a, b, rule: known.groupBy(F.col(a).cast("string").alias("value")).agg(F.count_distinct(b).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "value")
    return twice(key, "id", "KEY_TWICE").unionByName(twice("id", key, "ID_TWICE"))


def assets_for(catalog: DataFrame, id_map: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets, errors): an asset per URL of each mapped source, with its status (default queued); errors are unmapped sources."""
    mapped = catalog.join(id_map, "catalog_id").join(baseline, "source_id", "left")
    rows = mapped.select("source_id", F.coalesce("status", F.lit("queued")).alias("status"), F.posexplode("urls").alias("ordinal", "url"))
    return rows.withColumn("ordinal", F.col("ordinal") + 1), catalog.join(id_map, "catalog_id", "left_anti").select("catalog_id")


def fuzzy_source(names: DataFrame, files: DataFrame, stop: list[str], least: int = 3) -> DataFrame:
    """(name, file): the exact file of a name, else the file with most of the name's words, the first by name on ties.

    Words of at least ``least`` letters equi-join with the words of file names.
    """
    def words(c: str) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+", -1), lambda x: (F.length(x) >= least) & ~x.isin(*stop)))

    hits = names.select("name", F.explode(words("name")).alias("w")).join(files.select("file", F.explode(words("file")).alias("w")), "w")
    counted = hits.groupBy("name", "file").agg(F.count("*").alias("n"))
    best = counted.groupBy("name").agg(F.min(F.struct(-F.col("n"), F.col("file"))).alias("b")).select("name", F.col("b.file").alias("fuzzy"))
    exact = files.select(F.col("file").alias("name"), F.col("file").alias("exact")).distinct()
    return names.select("name").distinct().join(exact, "name", "left").join(best, "name", "left").select("name", F.coalesce("exact", "fuzzy").alias("file"))


def mentions(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, term, position from 1): all occurrences, overlapping ones too, of a lexicon's terms, in one pass and without a shuffle.

    Null texts have none; null and empty terms are in no text.
    """
    found = scan_terms(docs, lexicon_terms(lexicon), lambda text, hits: [(t, at + 1) for at, t in hits], "term string, position long")
    return found.withColumn("position", F.col("position").cast("int"))


def match_status(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, status): already_exists, partial_match (one contains the other) or new; ``existing`` is a list of names small enough to broadcast."""
    old = small(existing.select(F.col("name").alias("old")).distinct())
    hit = F.contains(F.col("name"), F.col("old")) | F.contains(F.col("old"), F.col("name"))
    ranked = new.select("name").distinct().join(old, hit, "left").groupBy("name").agg(F.max(F.when(F.col("old") == F.col("name"), 2).when(F.col("old").isNotNull(), 1).otherwise(0)).alias("r"))
    return ranked.select("name", F.when(F.col("r") == 2, "already_exists").when(F.col("r") == 1, "partial_match").otherwise("new").alias("status"))


def only_new(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return rows.join(existing.select(key), key, "left_anti")


def resolve_evidence(refs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """refs with a verdict: source and hash known, and the line range inside the artifact (a null line count is a violation)."""
    a = artifacts.select("source_id", F.col("sha256").alias("_sha"), "line_count")
    joined = refs.join(a, "source_id", "left")
    verdict = F.when(F.col("_sha").isNull(), "UNKNOWN_SOURCE").when(F.col("_sha") != F.col("sha256"), "HASH_MISMATCH")
    verdict = verdict.when(F.col("line_count").isNull() | (F.col("start_line") < 1) | (F.col("start_line") > F.col("end_line")) | (F.col("end_line") > F.col("line_count")), "LINE_RANGE")
    return joined.select(*refs.columns, F.coalesce(verdict, F.lit("OK")).alias("verdict"))


def resolve_blocks(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """refs (source_id, asset_id, block_ids) with a verdict: the asset is known, approved, and has all blocks named."""
    b = blocks.select("source_id", "asset_id", F.col("block_ids").alias("_has"), "review_status")
    joined = refs.join(b, ["source_id", "asset_id"], "left")
    verdict = F.when(F.col("_has").isNull(), "UNKNOWN_ASSET").when(F.col("review_status") != "approved", "NOT_APPROVED")
    verdict = verdict.when(F.size("block_ids") == 0, "NO_BLOCKS").when(~F.forall("block_ids", lambda x: F.array_contains("_has", x)), "UNKNOWN_BLOCK")
    return joined.select(*refs.columns, F.coalesce(verdict, F.lit("OK")).alias("verdict"))


def resolve_verifications(refs: DataFrame, records: DataFrame) -> DataFrame:
    """refs (verification_id, claim_id, source_id) with a verdict: the record is known, of this claim and source, and approved."""
    r = records.select("verification_id", F.col("claim_id").alias("_claim"), F.col("source_id").alias("_source"), "review_status")
    joined = refs.join(r, "verification_id", "left")
    verdict = F.when(F.col("_claim").isNull(), "UNKNOWN_RECORD").when((F.col("_claim") != F.col("claim_id")) | (F.col("_source") != F.col("source_id")), "OTHER_CLAIM").when(F.col("review_status") != "approved", "NOT_APPROVED")
    return joined.select(*refs.columns, F.coalesce(verdict, F.lit("OK")).alias("verdict"))


def term_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (id, rep), classes (rep, terms, n)) of (id, term): ids with the same terms are one class, named by the least."""
    own = sets.select("id", "term").distinct().groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    classes = own.groupBy("terms").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    return own.join(classes.select("terms", "rep"), "terms").select("id", "rep"), classes.select("rep", "terms", "n")


def pairwise_jaccard(sets: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b, jaccard) of classes a < b of (id, term) that share a term, from ``least`` on; see term_classes().

    Equal sets are one class, so copies give no pairs. With ``least`` above 0
    only the rarest terms of a set are shuffled: two sets that similar share
    one of those (operators/similar.py). Without, the pairs come from products of blocks of classes
    (operators/overlap.py), which no frequent term can skew. Pairs without a
    common term have 0 and give no row.
    """
    _, classes = term_classes(sets)
    if least <= 0:
        return overlapping_pairs(classes)
    hashed = F.array_sort(F.array_distinct(F.transform("terms", lambda t: F.xxhash64(t))))
    return similar_pairs(cut(classes.select(F.col("rep").alias("id"), hashed.alias("terms"))), least)


def differentiation(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, score) of every id: round((1 - mean Jaccard to all others) * 100), 0 at least.

    Ids of one class have a Jaccard of 1 to each other; ids without a term, and
    pairs without a common one, have 0. The sums are taken where the blocks of
    classes are multiplied, so no pair leaves its task.
    """
    members, classes = term_classes(sets)
    each = overlap_sums(classes)
    sums = classes.select("rep", "n").join(each, "rep", "left").select("rep", (F.coalesce("s", F.lit(0.0)) + F.col("n") - 1).alias("s"))
    ids = ids.select("id").distinct()
    n = ids.agg((F.count("*") - 1).alias("others"))
    joined = ids.join(members.join(sums, "rep").select("id", "s"), "id", "left").crossJoin(F.broadcast(n))  # one row
    mean = F.when(F.col("others") > 0, F.round(F.coalesce("s", F.lit(0.0)) / F.col("others"), 12)).otherwise(0.0)
    return joined.select("id", F.greatest(F.round((1 - mean) * 100), F.lit(0)).cast("int").alias("score"))


def continuity_diff(inputs: DataFrame, prior: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """(key, problem): prior ids that are missing, new ones not declared, declared ones that aren't new."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    all_ = flag(inputs, "i").join(flag(prior, "p"), key, "full_outer").join(flag(added, "d"), key, "full_outer").na.fill(False, ["i", "p", "d"])
    problem = F.when(F.col("p") & ~F.col("i"), "missing").when(F.col("i") & ~F.col("p") & ~F.col("d"), "unexpected").when(F.col("d") & (F.col("p") | ~F.col("i")), "wrongly_declared")
    return all_.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def manifest_diff(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, problem): missing, extra or mismatch."""
    e, a = expected.select(key, F.col(digest).alias("_e")), actual.select(key, F.col(digest).alias("_a"))
    both = e.withColumn("_in_e", F.lit(True)).join(a.withColumn("_in_a", F.lit(True)), key, "full_outer")
    problem = F.when(F.col("_in_a").isNull(), "missing").when(F.col("_in_e").isNull(), "extra").when(~F.col("_e").eqNullSafe(F.col("_a")), "mismatch")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
