"""What keeps work bounded: pruned top lists, one vectorisation, stored buckets, digests by ranges, levelled samples, sketched splitters."""

import hashlib
import os
import random
from dataclasses import replace
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import evaluate, features, pruned, retrieve, vectorise
from tessella.operators.features import feature_records
from tessella.plans import experiments
from tessella.plans.config import BLOCK_MODES, FIELDS, REPRESENTATIONS, Config
from tessella.plans.service import Catalogue
from tessella.sources import artefacts, jsonl
from tests import test_evaluation

NAMES = ("query_id", "rank", "item_id", "score", "shared")


def matrix(spark, items, terms, seed, by=None):
    """Rows of length one over skewed terms; some items are copies, one shares nothing."""
    rnd = random.Random(seed)
    rows = []
    for i in range(items):
        if i and i % 4 == 0:
            own = rows[rnd.randrange(len(rows))][1]
        else:
            own = {min(int(rnd.paretovariate(0.7)), terms): rnd.choice((1.0, 2.0)) for _ in range(rnd.randint(1, 8))}
        rows.append((i * 7 % 1000 + 1, own))
    rows.append((5000, {10_000: 1.0}))
    cells = [(i, "overview" if t % 2 else "cast", f"t{t}", w / sum(x * x for x in own.values()) ** 0.5) for i, own in rows for t, w in own.items()]
    return spark.createDataFrame(cells, "item_id long, field string, term string, w double")


def shown(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


@pytest.mark.parametrize(("items", "terms", "k", "small"), [(60, 12, 3, True), (90, 40, 5, True), (90, 40, 200, False), (40, 1, 2, True), (1, 3, 2, False)])
def test_pruned_lists_are_those_of_all_pairs(spark, monkeypatch, items, terms, k, small):
    if small:  # so few that a first round doesn't meet everything
        monkeypatch.setattr(pruned, "POSTINGS", 1)
        monkeypatch.setattr(pruned, "SEEDS", 1)
    weights = matrix(spark, items, terms, items + terms)
    found = pruned.best(weights, k)
    assert shown(found.rows) == shown(retrieve.top_k(retrieve.scores(weights), k))
    asked = weights.select(F.col("item_id").alias("query_id")).where("query_id % 3 = 0").distinct()
    assert shown(pruned.best(weights, k, asked).rows) == shown(retrieve.top_k(retrieve.scores(weights, asked), k))
    counts = found.counts()
    pairs = retrieve.scores(weights).count()
    assert counts["summed"] <= pairs and counts["completed"] <= counts["summed"]


def test_pruned_lists_keep_matrices_apart_and_sum_fewer_pairs(spark):
    a, b = matrix(spark, 300, 2000, 1), matrix(spark, 50, 30, 2)
    both = a.withColumn("variant", F.lit(0)).unionByName(b.withColumn("variant", F.lit(1)))
    found = pruned.best(both, 4, by=("variant",)).rows
    for n, one in enumerate((a, b)):
        assert shown(found.where(F.col("variant") == n)) == shown(retrieve.top_k(retrieve.scores(one), 4))
    hot = spark.range(1, 801).select(F.col("id").alias("item_id"), F.lit("cast").alias("field"), F.lit("same").alias("term"), F.lit(1.0).alias("w"))
    same = pruned.best(hot, 3)
    assert same.sums.count() == 0 and same.rows.count() == 2400  # 800 equal rows are one
    assert [r["item_id"] for r in same.rows.where("query_id = 2").orderBy("rank").collect()] == [1, 3, 4]
    assert pruned.best(hot.limit(0), 3).rows.count() == 0
    with pytest.raises(ValueError, match="room"):
        pruned.best(hot, 0)


def records(spark, n=60):
    rnd = random.Random(5)
    words = [f"word{i}" for i in range(30)]
    rows = [
        (i, f"title {i}", f"Title {i}", " ".join(rnd.choice(words) for _ in range(14)) + " and more of it than a stub has", [rnd.choice(("Drama", "Comedy", "War"))], [rnd.choice(words)],
         [(j, None, f"Actor {rnd.randrange(9)}") for j in range(7)], [("Director", f"Person {rnd.randrange(4)}")], "en")
        for i in range(1, n + 1)
    ]
    schema = "id long, title string, original_title string, overview string, genres array<string>, keywords array<string>, cast array<struct<order:int,flag:boolean,name:string>>, crew array<struct<job:string,name:string>>, original_language string"
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("collection_name", "string"), ("release_date", "string"), ("runtime", "int"), ("popularity", "double"), ("vote_average", "double"), ("vote_count", "double"), ("adult", "boolean"))))


def test_variants_are_the_representations_one_by_one(spark):
    base = Config()
    wide = base.with_field("cast", top_k=7)
    sources = [feature_records(records(spark), c) for c in (base, wide)]
    wanted = [vectorise.Variant(replace(base, block_mode=m), REPRESENTATIONS[r]) for m in BLOCK_MODES for r in REPRESENTATIONS]
    wanted += [vectorise.Variant(base.with_field("genres", weight=w)) for w in (0.0, 0.44)]
    wanted += [vectorise.Variant(base, ("genres",)), vectorise.Variant(base.with_field("genres", weight=0.0), ("genres",)), vectorise.Variant(wide, FIELDS, 1), vectorise.Variant(replace(base, sublinear_tf=False), ("overview",))]
    found = vectorise.variants(sources, wanted)
    show = lambda df: sorted((r["item_id"], r["field"], r["term"], round(r["w"], 9)) for r in df.collect())
    for n, v in enumerate(wanted):
        assert show(found.where(F.col("variant") == n)) == show(vectorise.representation(sources[v.source], v.config, v.fields)), v
    plan = found._jdf.queryExecution().executedPlan().toString()
    one = reduce(DataFrame.unionByName, [vectorise.representation(sources[v.source], v.config, v.fields) for v in wanted])._jdf.queryExecution().executedPlan().toString()
    assert 3 * plan.count("Exchange hashpartitioning") < one.count("Exchange hashpartitioning")
    with pytest.raises(ValueError, match="block mode"):
        vectorise.variants(sources, [vectorise.Variant(replace(base, block_mode="other"))])


@pytest.mark.parametrize(("k", "min_score", "min_shared"), [(4, 0.0, 1), (3, 0.15, 6), (100, 0.1, 5), (5, 0.0, 50)])
def test_searches_by_blocks_are_those_over_pairs(spark, k, min_score, min_shared):
    """Several blocks, gates and an item without terms; neither tokens nor pairs are dealt out."""
    from tessella.operators import searched

    config = Config().with_field("genres", weight=0.44).with_field("cast", weight=0.0)
    rows = records(spark).withColumn("overview", F.when(F.col("id") != 40, F.col("overview")))
    found = feature_records(rows.repartition(3, "id"), config).persist()
    asks = F.col("id") % 5 == 0
    queries = found.where(asks).select(F.col("id").alias("query_id"))
    scored = retrieve.scores(vectorise.representation(found, config), queries).persist()
    ours = searched.Searches.of(found, config, asks)
    assert ours.blocks.count() > 1
    best = ours.recommend(k, min_score, min_shared)
    want = retrieve.recommend(scored, k, min_score, min_shared)
    assert shown(best) == shown(want)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    show = lambda df: sorted(map(tuple, df.collect()))
    want = retrieve.evidence(want, retrieve.skipped(scored, k, min_score, min_shared), queries, k, min_shared)
    assert show(ours.evidence(k, min_score, min_shared)) == show(want)
    ours.scratch.delete()
    found.unpersist(), scored.unpersist()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are absent")
@pytest.mark.parametrize("name", ["recommend_single", "recommend_evidence", "recommend_many"])
def test_searches_shuffle_no_pair(spark, name):
    from tessella import queries

    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()


def test_samples_make_no_lists(spark):
    run = experiments.Run(experiments.chosen(experiments.matrix(Config()), names=["rep_A"]), records(spark, 20), Config())
    run.samples(["rep_A"]).count()
    names = os.listdir(run.scratch.root.removeprefix("file:"))
    assert "weights" in names and not {"plain", "lists", "percentiles"} & set(names)
    assert run.lists.count() and "lists" in os.listdir(run.scratch.root.removeprefix("file:"))
    run.close()


def test_a_rebuilt_corpus_must_have_the_same_records(spark, monkeypatch):
    base = Config()
    rebuild = [experiments.Experiment("cast_k3", "cast_top_k", base.with_field("cast", top_k=3), rebuild=True)]
    few = lambda found, config: feature_records(found, config).where(F.col("id") > (1 if config.fields["cast"].top_k == 3 else 0))
    monkeypatch.setattr(experiments, "feature_records", few)
    with pytest.raises(ValueError, match="59 records and the indexed one 60"):
        experiments.Run(rebuild, records(spark), base)


def test_stored_weights_are_joined_without_an_exchange(spark, tmp_path):
    config = Config()
    found = feature_records(records(spark), config)
    artefacts.save_matrix(found, config, str(tmp_path), "D", buckets=3)
    stored = artefacts.load_matrix(spark, str(tmp_path), config)
    show = lambda df: sorted((r["item_id"], r["field"], r["term"], round(r["w"], 9)) for r in df.collect())
    assert show(stored.weights) == show(stored.rows) == show(vectorise.representation(found, config))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = stored.rows.where("item_id in (3, 4)").select(F.col("item_id").alias("query_id"), "field", "term", F.col("w").alias("qw"))
        plan = stored.weights.join(asked, ["field", "term"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the buckets' side goes from the scan to the join; only what is asked is dealt out, and its filter reaches the files
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "In(item_id, [3,4])" in plan
    queries = spark.createDataFrame([(3,), (9,)], "query_id long")
    score = lambda df: sorted(tuple(r) for r in df.collect())
    assert score(retrieve.scores(stored.weights, queries, rows=stored.rows)) == score(retrieve.scores(vectorise.representation(found, config), queries))


def test_every_skipped_candidate_can_be_reached(spark, monkeypatch):
    from tessella.plans import service

    monkeypatch.setattr(service, "SKIPPED_PAGE", 7)
    shelf = Catalogue(feature_records(records(spark), Config()), min_shared=50)
    try:
        seen, after = [], 0
        while after is not None:
            status, answer = shelf.answer("GET", "movies/1/recommendations", skipped_after=after)
            assert status == 200 and len(answer["skipped"]) <= 7
            seen += [r["place"] for r in answer["skipped"]]
            after = answer["skipped_next"]
        assert seen == list(range(1, answer["evidence"]["candidates_rejected"] + 1)) and len(seen) > 14
    finally:
        shelf.close()


def tree(data, leaf, fan):
    level = [hashlib.sha256(data[i : i + leaf]).digest() for i in range(0, len(data), leaf)] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + fan])).digest() for i in range(0, len(level), fan)]
    return level[0].hex()


@pytest.mark.parametrize("split", ["37", "1000", "128m"])
def test_digests_of_files_do_not_depend_on_splits(spark, tmp_path, split):
    rnd = random.Random(3)
    files = [b"", b"\n", b"a", b"a\n", b"\r\n\r\n\xff\xfe\n\n", b"x" * 700, bytes(rnd.randrange(256) for _ in range(900)), b"\n".join(bytes(rnd.choice(b"abc\r") for _ in range(rnd.randrange(90))) for _ in range(40))]
    for i, data in enumerate(files):
        (tmp_path / f"file {i}").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = {int(r["path"][-1]): (r["length"], r["digest"]) for r in jsonl.content_digest(spark, str(tmp_path), 64, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == {i: (len(x), tree(x, 64, 3)) for i, x in enumerate(files)}


@pytest.mark.parametrize(("sizes", "target", "want"), [((500, 480, 20), 300, (150, 130, 20)), ((10, 5), 100, (10, 5)), ((400, 400, 0, 1), 300, (150, 149, 0, 1)), ((1000,), 60, (60,))])
def test_samples_are_topped_up_level_by_level(spark, sizes, target, want):
    rows = spark.createDataFrame([(f"s{s}", s * 10_000 + i) for s, n in enumerate(sizes) for i in range(n)], "kind string, id long")
    found = features.stratified_sample(rows, "kind", "id", target, 42)
    counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    assert tuple(counts.get(f"s{s}", 0) for s in range(len(sizes))) == want
    draw = lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest()
    first = sorted((i for i in range(sizes[0])), key=draw)[: want[0]]
    assert sorted(r["id"] for r in found.where("kind = 's0'").collect()) == sorted(first)
    assert features.stratified_sample(rows.limit(0), "kind", "id", target, 42).count() == 0


def test_an_outlier_does_not_gather_values_in_one_part(spark):
    rows = spark.range(5000).select((F.col("id") % 4000).cast("double").alias("v")).unionByName(spark.createDataFrame([(1e300,), (-1e300,), (None,)], "v double"))
    counts = rows.groupBy(F.col("v").alias("value")).agg(F.count("*").alias("n"))
    tops, inner = evaluate.splitters(counts, "value")
    dealt = counts.withColumns({"t": tops, "i": inner}).select(evaluate.bucket_of(F.col("value"), F.col("t"), F.col("i")).alias("b"))
    sizes = sorted(r["count"] for r in dealt.groupBy("b").count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    places = {r["value"]: (r["n"], r["before"]) for r in evaluate.value_places(rows, "v").collect()}
    assert places[None] == (1, 0) and places[-1e300] == (1, 1) and places[0.0] == (2, 2) and places[3999.0] == (1, 5001) and places[1e300] == (1, 5002)


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", ["topk_batch", "stratified_uneven", "stratified_sample", "representation_compare"])
def test_queries_equal_their_sql(spark, name):
    test_evaluation.test_queries_equal_their_sql(spark, name)


def test_results_are_stored_by_fingerprint(spark, tmp_path, monkeypatch):
    """What is stored isn't run again; other inputs are refused or replace it; damaged tables and failing runs are noticed."""
    from tessella.plans import results

    base, rows = Config(), records(spark, 30).persist()
    which = experiments.chosen(experiments.matrix(base), names=["rep_A"])
    store = results.Store(spark, str(tmp_path / "store"))
    show = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    first = show(store.results(which, rows, base))
    key = results.fingerprint(which, base, ks=[5, 10, 20], k=10, first=None, backfill=False)
    held = store.manifest(key)
    assert held["rows"] == len(first) == 12 and held["inputs"]["records"] == 30 and held["experiments"][0]["name"] == "rep_A"
    real = results.Run

    def refuse(*_):
        raise RuntimeError("run again")

    monkeypatch.setattr(results, "Run", refuse)
    assert show(store.results(which, rows, base)) == first and show(store.read(key)) == first
    fewer = rows.where("id < 30")
    with pytest.raises(results.InputsChanged, match="corpus, labels, records"):
        store.results(which, fewer, base)
    with pytest.raises(results.InputsChanged, match="queries"):
        store.results(which, rows, base, queries=rows.select(F.col("id").alias("query_id")).limit(4))
    with pytest.raises(RuntimeError, match="run again"):
        store.results(which, fewer, base, replace=True)
    assert show(store.read(key)) == first  # a run that fails leaves what was there
    assert show(store.compare(key, key)) == sorted((r["experiment"], r["k"], r["kind"], r["ndcg"], r["ndcg"], r["recall"], r["recall"]) for r in store.read(key).collect())
    monkeypatch.setattr(results, "Run", real)
    again = show(store.results(which, fewer, base, replace=True))
    assert again != first and store.manifest(key)["inputs"]["records"] == 29
    spark.createDataFrame(store.read(key).limit(5).collect(), store.read(key).schema).write.mode("append").parquet(f"{store.path}/{key}/{store.manifest(key)['table']}")
    with pytest.raises(ValueError, match="doesn't hold"):
        store.results(which, fewer, base)
    assert show(store.results(which, fewer, base, replace=True)) == again
    with pytest.raises(artefacts.MissingArtefact):
        store.read("nothing")
    other = results.fingerprint(which, base, ks=[5, 10, 20], k=10, first=None, backfill=True)
    assert other != key and results.fingerprint(which, base.with_field("genres", weight=0.5), ks=[5, 10, 20], k=10, first=None, backfill=False) != key
    rows.unpersist()


def test_evaluations_share_lists_of_the_same_files(spark, tmp_path, monkeypatch):
    """Lists are made once for the same files, anew for changed ones or when their folder is gone."""
    import shutil

    from tessella import queries

    where = tmp_path / "tables"
    where.mkdir()
    for name in ("part", "lineitem", "supplier"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", where / f"{name}.parquet")
    made, real = [], queries.part_best
    monkeypatch.setattr(queries, "part_best", lambda *a: made.append(a) or real(*a))
    show = lambda: sorted(map(tuple, queries.part_lists(spark, str(where))[3].collect()))
    before = show()
    assert show() == before and len(made) == 1
    loose = queries.part_lists(spark, str(where), 1)[3]
    assert loose.count() >= len(before) and len(made) == 1  # the gate is applied to what is stored
    small = spark.read.parquet(str(where / "part.parquet")).limit(40).toPandas()
    small.to_parquet(where / "part.parquet")
    old = [s for s in queries._LISTS.values()]
    assert show() != before and len(made) == 2
    assert any(not artefacts.exists(spark, s.root) for s in old)
    current = next(s for k, s in queries._LISTS.items() if k[1] == queries._files_state(spark, str(where)))
    current.delete()
    show()
    assert len(made) == 3


def test_no_table_of_pairs_is_written(spark):
    """Rows that all share a term: what best neighbours write grows with cells and lists, not with pairs."""
    weights, scratch = matrix(spark, 300, 12, 9), pruned.Scratch(spark, "bounded")
    found = pruned.best(weights, 2, scratch=scratch)
    assert shown(found.rows) == shown(retrieve.top_k(retrieve.scores(weights), 2))
    tables = os.listdir(scratch.root.removeprefix("file:"))
    assert tables and max(spark.read.parquet(f"{scratch.root}/{t}").count() for t in tables) <= weights.count()
    scratch.delete()


def test_small_batches_of_postings_change_no_list(spark, monkeypatch):
    """In this process, as workers don't see what a test sets."""
    import pyarrow as pa

    weights, scratch = matrix(spark, 90, 40, 3), pruned.Scratch(spark, "batches")
    pruned.best(weights, 3, scratch=scratch)
    table = lambda end: next(spark.read.parquet(f"{scratch.root}/{t}") for t in os.listdir(scratch.root.removeprefix("file:")) if t.endswith(end))
    want = {r["row_id"]: [tuple(x) for x in r["items"]] for r in table("-found").collect()}
    rows = [{c: bytes(v) if isinstance(v, bytearray) else v for c, v in r.asDict().items()} for r in table("-blocks").collect()]
    assert len(rows) == 1 and len(want) > 50
    rows = [r | {f"q_{c}": v for c, v in r.items()} for r in rows]
    for name, value in (("POSTINGS", 1), ("SEEDS", 1), ("SUMS", 1), ("ROWS", 1)):
        monkeypatch.setattr(pruned, name, value)
        (out,) = pruned._met(3)(iter([pa.RecordBatch.from_pylist(rows)]))
        found = {r["row_id"]: [(x["item_id"], x["score"], x["shared"]) for x in r["items"]] for r in out.to_pylist()}
        assert found == want
    scratch.delete()


def test_lists_are_judged_without_dealing_their_pairs_out(spark, monkeypatch):
    import pyarrow as pa

    from tessella.operators import listed

    weights = matrix(spark, 60, 12, 4)
    lists = retrieve.top_k(retrieve.scores(weights), 5)
    found = evaluate.diversity(lists, weights)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    own, scores = {}, {(r["query_id"], r["item_id"]): r["score"] for r in retrieve.scores(weights).collect()}
    for r in lists.collect():
        own.setdefault(r["query_id"], []).append(r["item_id"])
    pairs = [1 - scores.get((a, b), 0.0) for items in own.values() for a in items for b in items if a < b]
    assert abs(found.first().diversity - sum(pairs) / len(pairs)) < 2e-6
    rnd, held = random.Random(7), []
    groups = {k: set(rnd.sample(range(50), 9)) for k in range(6)}
    for q in range(50):
        held += [(q, k) for k in groups if q in groups[k]]
    binary = lambda x, t="<i8": b"".join(int(v).to_bytes(8 if t == "<i8" else 4, "little") for v in x)
    per = [[k for k in groups if i in groups[k]] for i in range(50)]
    row = {"part": 0, "q_query_id": binary(q for q, _ in held), "q_item_id": binary(k for _, k in held), "q_rank": binary(0 for _ in held), "sizes": binary(map(len, per), "<i4"), "keys": binary(k for x in per for k in x)}
    for size in (1, 5, 10_000):
        monkeypatch.setattr(listed, "PAIRS", size)
        (out,) = listed._counted(iter([pa.RecordBatch.from_pylist([row])]))
        assert {r["query_id"]: r["n"] for r in out.to_pylist()} == {q: len(set().union(*(groups[k] for a, k in held if a == q))) for q, _ in held}


def test_ranked_candidates_shuffle_no_pair(spark):
    """Blocks of queries hold what they meet: no row for a pair is dealt out before the result."""
    from tessella.operators import searched
    from tessella.operators.features import feature_records

    found, asking = feature_records(records(spark, 60), Config()), F.col("id") % 3 == 0
    ranked = searched.Searches.of(found, Config(), asking).ranked()
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Window" not in plan and "Join" not in plan
    want = retrieve.ranked(retrieve.scores(vectorise.representation(found, Config()), found.where(asking).select(F.col("id").alias("query_id"))))
    show = lambda df: sorted(map(tuple, df.select("query_id", "rank", "item_id", F.round("score", 6)).collect()))
    assert show(ranked) == show(want) and ranked.count() > 100


def test_few_terms_deal_no_cell_by_term(spark, tmp_path):
    """Sources that no variant reads aren't counted, and with a small vocabulary cells are dealt by item alone."""
    base, scratch = Config(), pruned.Scratch(spark, "few")
    sources = [feature_records(records(spark), base), feature_records(records(spark), base.with_field("cast", top_k=7))]
    wanted = [vectorise.Variant(base.with_field("cast", top_k=7), FIELDS, 1)]
    few, many = vectorise.variants(sources, wanted, scratch), vectorise.variants(sources, wanted)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    show = lambda df: sorted((r["item_id"], r["field"], r["term"], round(r["w"], 9)) for r in df.collect())
    assert show(few) == show(many) and {r["source"] for r in spark.read.parquet(f"{scratch.root}/frequencies-1").collect()} == {1}
    scratch.delete()


def test_experiments_keep_no_table_that_a_measure_passed_by(spark):
    run = experiments.Run(experiments.chosen(experiments.matrix(Config()), names=["only_genres", "cast_k5"]), records(spark, 20), Config())
    assert run.results().count() > 0
    root = run.scratch.root.removeprefix("file:")
    names = os.listdir(root)
    assert "plain" in names and not [n for n in names if n == "lists" or n.startswith(("pruned", "listed", "relevant", "features-"))]
    assert not [n for n in os.listdir(os.path.dirname(root)) if n.startswith("experiments-passing")]
    run.close()


def test_floors_rise_within_a_batch_and_a_task_reads_its_matrix_alone(spark):
    import numpy as np

    scratch = pruned.Scratch(spark, "floors")
    weights = matrix(spark, 60, 12, 5)
    both = weights.withColumn("variant", F.lit(0)).unionByName(weights.withColumn("variant", F.lit(1)))
    found = pruned.best(both, 3, by=("variant",), scratch=scratch)
    want = retrieve.top_k(retrieve.scores(weights), 3)
    assert shown(found.rows.where("variant = 1")) == shown(want)
    (blocks,) = [t for t in os.listdir(scratch.root.removeprefix("file:")) if t.endswith("-blocks")]
    assert {t for t in os.listdir(f"{scratch.root.removeprefix('file:')}/{blocks}") if t.startswith("matrix")} == {"matrix=1", "matrix=2"}
    queries = pruned._Queries.__new__(pruned._Queries)
    queries.k, queries.floor = 1, np.array([0.1, 0.2, 0.9])
    assert queries._raised(np.array([0, 0, 0, 1, 2, 2]), np.array([0.3, 0.5, 0.4, 0.9, 0.5, 0.6])).tolist() == [0.4, 0.2, 0.9]
    scratch.delete()


@pytest.mark.parametrize(("k", "min_score", "min_shared", "size"), [(9, 0.5, 12, 7), (3, 0.9, 6, 100_000), (100, 0.5, 10, 3), (5, 0.0, 50, 100_000)])
def test_what_blocks_pass_over_is_that_of_all_pairs(spark, monkeypatch, k, min_score, min_shared, size):
    """Skipped candidates with places and reasons, and their tally: no row for a pair is dealt out."""
    from tessella.operators import searched

    monkeypatch.setattr(searched, "OUT", size)
    found, asks = feature_records(records(spark, 60).repartition(3, "id"), Config()).persist(), F.col("id") % 5 == 0
    want = retrieve.skipped(retrieve.scores(vectorise.representation(found, Config()), found.where(asks).select(F.col("id").alias("query_id"))), k, min_score, min_shared).persist()
    ours = searched.Searches.of(found, Config(), asks)
    show = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    skipped = ours.skipped(k, min_score, min_shared)
    assert show(skipped) == show(want) and want.count() and skipped.schema["reason"].dataType == want.schema["reason"].dataType
    assert "Window" not in skipped._jdf.queryExecution().executedPlan().toString()
    assert show(ours.skip_tally(k, min_score, min_shared)) == show(retrieve.skip_tally(want))
    ours.scratch.delete()
    found.unpersist(), want.unpersist()


def test_searches_by_blocks_find_only_candidates(spark):
    """Weights are those of all items, queries need not be candidates."""
    from tessella.operators import searched

    found, asks, among = feature_records(records(spark, 60).repartition(3, "id"), Config()).persist(), F.col("id") % 5 == 0, F.when(F.col("id") != 7, F.col("id") % 2 == 1)
    queries, candidates = found.where(asks).select(F.col("id").alias("query_id")), found.where(among).select(F.col("id").alias("item_id"))
    want = retrieve.recommend(retrieve.scores(vectorise.representation(found, Config()), queries, candidates), 4)
    ours = searched.Searches.of(found, Config(), asks, among=among)
    assert shown(ours.recommend(4)) == shown(want) and want.count()
    ours.scratch.delete()
    found.unpersist()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are absent")
@pytest.mark.parametrize("name", ["sparse_topk", "recommend_min_score", "recommend_subset", "recommend_skipped", "recommend_skip_tally"])
def test_gated_searches_join_no_cells(spark, name):
    from tessella import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_a_task_holds_one_block_at_a_time(spark):
    """A block comes once, before what passes by, and goes out with its weights before more than the next is taken."""
    import numpy as np
    import pyarrow as pa

    from tessella.operators import searched

    def block(n):
        cells = {"ids": [n], "asked": [True], "among": [True], "sizes": [2], "keys": [8, 16], "w": [1.0, 2.0]}
        return {c: np.array(x, searched._CELLS[c]).tobytes() for c, x in cells.items()}

    taken, types = [], pa.schema([(c, pa.binary()) for c in (*searched._CELLS, "term", "idf")])

    def passing():
        for n in range(4):
            taken.append(n)
            for row in (block(n), *({"term": np.array([key]).tobytes(), "idf": np.array([1.0]).tobytes()} for key in (8, 16))):
                yield pa.RecordBatch.from_pylist([dict.fromkeys(searched._CELLS) | {"term": None, "idf": None} | row], types)

    out = searched._weighed([1.0] * 8, False)(passing())
    for n in range(3):
        assert np.frombuffer(next(out).column("ids")[0].as_buffer(), np.int64).tolist() == [n] and taken[-1] == n + 1
    assert np.frombuffer(next(out).column("w")[0].as_buffer()).round(6).tolist() == [0.447214, 0.894427] and not list(out)


def test_label_pairs_are_dealt_out_once_as_members(spark):
    """Two that share several groups are one pair; no pair is dealt out to find that."""
    from tessella.operators import labels

    rnd = random.Random(3)
    rows = sorted({(kind, f"g{rnd.randrange(6)}", rnd.randrange(40)) for kind in ("cast", "director") for _ in range(120)})
    groups = labels.label_groups(spark.createDataFrame(rows, "kind string, group_key string, item_id long")).persist()
    for asked in (None, {3, 5, 8, 99}):
        queries = None if asked is None else spark.createDataFrame([(q,) for q in [*asked, 3]], "query_id long")
        found = labels.label_pairs(groups, queries)
        held = [tuple(r) for r in groups.collect()]
        want = {(k, a, b) for k, g, a in held for l, h, b in held if (k, g) == (l, h) and a != b and (asked is None or a in asked)}
        assert sorted(map(tuple, found.collect())) == sorted(want) and want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "query_id" not in "".join(x for x in plan.splitlines() if "HashAggregate" in x and "item_id" in x)
    groups.unpersist()
