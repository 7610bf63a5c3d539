"""Labels, metrics, experiments, and the registered queries against their SQL."""

import math
import os

import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluate, labels
from tessella.plans import experiments
from tessella.plans.config import Config

DATA = "/root/testdata/sf0.001"


def test_labels(spark):
    credit = lambda n, o=None: (o, None, n)
    rows = [
        (1, "Same", "Saga", [credit("Ann"), credit("Bob", 0)], [("Director", "D One"), ("Writer", "W")]), (2, "SAME", "saga", [credit("Bob", 0), credit("Cy", 1)], [("Director", "D Two"), ("Director", "d one")]),
        (3, None, None, [credit("Cy", 0), credit("Ann", 1)], []), (4, "Alone", "  ", [], [("Director", "D Two")]), (None, "Same", "Saga", [], []),
    ]
    records = spark.createDataFrame(rows, "id long, title string, collection_name string, cast array<struct<order:int,flag:boolean,name:string>>, crew array<struct<job:string,name:string>>")
    pairs = lambda k, **kw: {(r.kind, r.query_id, r.item_id) for r in labels.label_pairs(labels.label_groups(labels.memberships(records, k, **kw))).collect()}
    two = pairs(2)
    assert {p for p in two if p[0] == "franchise"} == {("franchise", 1, 2), ("franchise", 2, 1)} == {("franchise", b, a) for k, a, b in two if k == "same_title"}
    assert {p[1:] for p in two if p[0] == "director"} == {(1, 2), (2, 1), (2, 4), (4, 2)}
    assert {p[1:] for p in two if p[0] == "cast"} == {(1, 2), (2, 1), (2, 3), (3, 2), (1, 3), (3, 1)}
    assert {p[1:] for p in pairs(1) if p[0] == "cast"} == {(1, 2), (2, 1)}  # billing order cuts before names are grouped
    only = spark.createDataFrame([(1,), (3,)], "item_id long")
    assert {p[0] for p in pairs(2, catalogue=only)} == {"cast"}
    groups = labels.label_groups(labels.memberships(records, 2))
    assert {r.kind: (r.groups, r["items"]) for r in labels.label_summary(groups).collect()} == {"franchise": (1, 2), "same_title": (1, 2), "director": (2, 3), "cast": (3, 3)}
    queries = spark.createDataFrame([(i,) for i in range(1, 5)], "query_id long")
    assert {r.kind: r.queries for r in labels.unevaluable(groups, queries).collect()} == {"franchise": 2, "same_title": 2, "director": 1, "cast": 1}
    with pytest.raises(labels.MissingCredits):
        labels.memberships(records.drop("cast"), 5)


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank long, item_id long, score double, shared long")


def test_label_scores(spark):
    found = lists(spark, [(1, 1, 2, 0.9, 5), (1, 2, 3, 0.8, 1), (1, 3, 4, 0.7, 5), (2, 1, 9, 0.5, 1)])
    pairs = spark.createDataFrame([("a", 1, 3), ("a", 1, 4), ("a", 1, 8), ("a", 2, 1), ("a", 7, 1)], "kind string, query_id long, item_id long")
    got = {r.k: r for r in evaluate.label_scores(found, pairs, (1, 2, 3)).collect()}
    assert [got[k].queries for k in (1, 2, 3)] == [3, 3, 3]
    assert [got[k].recall for k in (1, 2, 3)] == [0, round(1 / 9, 6), round(2 / 9, 6)] and got[3].hit_rate == round(1 / 3, 6) and got[3].mean_relevant == round(5 / 3, 6)
    dcg, ideal = 1 / math.log2(3) + 1 / math.log2(4), 1 + 1 / math.log2(3)
    assert abs(got[3].ndcg - dcg / ideal / 3) < 1e-6 and got[1].ndcg == 0


@pytest.mark.parametrize("most", [1, 2, 6])
def test_unions_of_groups_are_counted_by_subsets(spark, monkeypatch, most):
    """No pair is met while an item has few groups; items of more are counted beside them, whoever asks."""
    import random

    from tessella.operators import listed

    r = random.Random(4)
    members = sorted({("k", f"g{r.randrange(9)}", i) for i in range(50) for _ in range(1 + i % 4)} | {("other", "x", 3), ("other", "x", 4)})
    groups = spark.createDataFrame(members, "kind string, group_key string, item_id long")
    met, real = [], listed.union_sizes
    monkeypatch.setattr(evaluate, "SETS", most)
    monkeypatch.setattr(listed, "union_sizes", lambda *a: met.append(a) or real(*a))
    want = {}
    for k, q, i in labels.label_pairs(groups).select("kind", "query_id", "item_id").collect():
        want[k, q] = want.get((k, q), 0) + 1
    assert {(k, q): n for k, q, n in evaluate.relevant_counts(groups).collect()} == want
    assert bool(met) == (most < 4)


def test_scores_by_groups_equal_those_by_pairs(spark):
    """Groups judge as their pairs do: items in several groups of a kind, queries outside all, and a group that holds most items."""
    import random

    r = random.Random(2)
    members = {("hot", "h", i) for i in range(0, 60, 2)} | {("many", f"g{r.randrange(8)}", r.randrange(60)) for _ in range(90)} | {("lone", "x", 3)}
    groups = spark.createDataFrame(sorted(members), "kind string, group_key string, item_id long")
    rows = []
    for q in range(0, 60, 3):
        for k, i in enumerate(r.sample([i for i in range(60) if i != q], r.randrange(1, 9)), 1):
            rows.append((q, k, i, 0.5, 3))
    queries = spark.createDataFrame([(q,) for q in range(0, 60, 3)], "query_id long")
    show = lambda df: sorted(map(tuple, df.collect()))
    pairs = labels.label_pairs(groups, queries)
    assert show(evaluate.group_scores(lists(spark, rows), groups, queries, (2, 8))) == show(evaluate.label_scores(lists(spark, rows), pairs, (2, 8)))
    counts = {(k, q): n for k, q, n in evaluate.relevant_counts(groups).collect()}
    want = {}
    for k, q, i in labels.label_pairs(groups).select("kind", "query_id", "item_id").collect():
        want[k, q] = want.get((k, q), 0) + 1
    assert counts == want


def test_list_metrics(spark):
    found = lists(spark, [(1, 1, 2, 0.9, 5), (1, 2, 3, 0.8, 1), (1, 3, 4, 0.7, 5), (2, 1, 3, 0.5, 2)])
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    stats = evaluate.list_statistics(found, queries, 2).first()
    assert (stats.mean_top1_score, stats.thin_rate, stats.mean_returned) == (0.7, round(2 / 3, 6), 1.0)
    thinned = evaluate.filtered_lists(found, 3)
    assert [(r.query_id, r["rank"], r.item_id) for r in thinned.orderBy("query_id", "rank").collect()] == [(1, 1, 2), (1, 2, 4)]
    weights = spark.createDataFrame([(2, "f", "a", 0.5), (3, "f", "a", 0.5), (2, "g", "b", 0.9), (4, "g", "c", 1.0)], "item_id long, field string, term string, w double")
    assert evaluate.diversity(found, weights).first().diversity == round((0.75 + 1 + 1) / 3, 6)
    none = found.limit(0)
    assert evaluate.diversity(none, weights).first().diversity == 0 and evaluate.list_statistics(none, queries, 2).first().mean_returned == 0


@pytest.mark.parametrize(("x", "y", "rho"), [([1, 2, 3], [4, 5, 6], 1.0), ([1, 2, 3], [6, 5, 4], -1.0), ([1, 2, 3], [5, 5, 5], 0.0), ([1], [1], 0.0), ([], [], 0.0), ([1, 1, 2, 3], [1, 2, 2, 9], 0.833333)])
def test_spearman(spark, x, y, rho):
    pairs = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    assert abs(evaluate.spearman(pairs, "x", "y").first().rho - rho) < 1e-5


def test_percentiles(spark):
    rows = lambda v: spark.createDataFrame([(i, p) for i, p in enumerate(v)], "id long, popularity double")
    got = {r.item_id: r.percentile for r in evaluate.popularity_percentiles(rows([float(k) for k in range(1, 101)])).collect()}
    assert got[0] == 0 and got[99] == 100 and abs(got[49] - 49.4949) < 1e-3
    ties = {r.item_id: r.percentile for r in evaluate.popularity_percentiles(rows([5.0, 5.0, None, 0.0])).collect()}
    assert ties[0] == ties[1] and ties[2] == ties[3] and ties[2] < ties[0]
    assert evaluate.popularity_percentiles(rows([3.0])).first().percentile == 0


def test_matrix():
    found = experiments.matrix(Config())
    assert len(found) == 33 and len({e.name for e in found}) == 33
    assert {e.family: sum(x.family == e.family for x in found) for e in found} == {"representation": 4, "genre_sweep": 8, "cast_top_k": 4, "ablation": 5, "single_field": 5, "min_shared_terms": 6, "selected": 1}
    assert [e.rebuild for e in found].count(True) == 4 and Config().fingerprint() != Config().with_field("genres", weight=0.5).fingerprint()
    assert [e.name for e in experiments.chosen(found, families=["selected"])] == ["selected"] and [e.name for e in experiments.chosen(found, names=["rep_A", "only_cast"])] == ["rep_A", "only_cast"]
    with pytest.raises(ValueError, match="no experiment"):
        experiments.chosen(found, families=["selected"], names=["rep_A"])


def some_records(spark):
    credit = lambda n, o: (o, None, n)
    rows = []
    for i in range(1, 41):
        text = f"The long tale of number {i % 7} and of colour {i % 5} on a street called {'abcdefgh'[i % 8] * 3}"
        rows.append((i, f"Title {i % 13}", text, [f"G{i % 3}"], [f"k{i % 4}", f"k{i % 9}"], [credit(f"Actor {i % 6}", 0), credit(f"Player {i % 10}", 1)], [("Director", f"Boss {i % 8}")], f"Saga {i % 12}" if i % 2 else None, f"{1980 + i % 30}-01-01", float(i)))
    schema = "id long, title string, overview string, genres array<string>, keywords array<string>, cast array<struct<order:int,flag:boolean,name:string>>, crew array<struct<job:string,name:string>>, collection_name string, release_date string, popularity double"
    more = {c: F.lit(None).cast(t) for c, t in (("original_title", "string"), ("original_language", "string"), ("runtime", "int"), ("vote_average", "double"), ("vote_count", "double"), ("adult", "boolean"))}
    return spark.createDataFrame(rows, schema).withColumns(more)


def test_experiments_share_one_protocol(spark, tmp_path):
    """Every experiment's row equals what the metrics say of it alone; gates, options, samples and the manifest."""
    from tessella.operators import retrieve, vectorise
    from tessella.operators.features import feature_records
    from tessella.sources import artefacts

    records, base = some_records(spark), Config()
    which = experiments.chosen(experiments.matrix(base), names=["rep_A", "rep_D", "cast_k3", "evidence_mt3", "evidence_mt8", "selected"])
    run = experiments.Run(which, records, base)
    rows = {(r.experiment, r.kind, r.k): r for r in run.results().collect()}
    assert len(rows) == len(which) * 4 * 3
    features = feature_records(records, base)
    queries = features.select(F.col("id").alias("query_id"))
    groups = labels.label_groups(labels.memberships(records, 5))
    pairs = labels.label_pairs(groups)
    percentiles = evaluate.popularity_percentiles(features)
    for e in which:
        weights = vectorise.representation(feature_records(records, e.config), e.config, e.fields)
        whole = evaluate.ranked_lists(retrieve.scores(weights, queries))
        gated = evaluate.filtered_lists(whole, e.min_shared)
        for s in evaluate.label_scores(whole, pairs).collect():
            r = rows[e.name, s.kind, s.k]
            assert (r.queries, r.recall, r.hit_rate, r.ndcg, r.mean_relevant) == (s.queries, s.recall, s.hit_rate, s.ndcg, s.mean_relevant)
        r = rows[e.name, "cast", 10]
        stats, bias, wide, shape = evaluate.list_statistics(gated, queries, 10).first(), evaluate.popularity_bias(gated, percentiles).first(), evaluate.breadth(gated, features, queries, 10).first(), vectorise.geometry(weights, features).first()
        assert (r.mean_top1_score, r.thin_rate, r.mean_returned) == tuple(stats) and (r.mean_percentile, r.rho) == tuple(bias) and (r.distinct_genres, r.distinct_decades) == tuple(wide)
        assert r.coverage == evaluate.coverage(gated, features).first().coverage and r.diversity == evaluate.diversity(gated, weights).first().diversity
        assert (r.dimensions, r.nonzeros, r.density_pct, r.empty_items) == (shape.dimensions, shape.nonzeros, shape.density_pct, shape.empty_items)
    assert rows["evidence_mt8", "cast", 5].mean_returned <= rows["evidence_mt3", "cast", 5].mean_returned <= rows["rep_D", "cast", 5].mean_returned
    assert all(rows[e.name, "franchise", 5].unevaluable == 40 - rows[e.name, "franchise", 5].queries for e in which)
    sample = run.samples(["selected"], 3).collect()
    kin = {(q, i) for k, q, i in pairs.collect() if k == "franchise"}
    assert sorted({r.query_id for r in sample}) == sorted({q for q, _ in kin})[:3] and all(r.same_collection == ((r.query_id, r.item_id) in kin) and r.shared >= 3 for r in sample)
    manifest = experiments.manifest(run, "corpus", "labels")
    artefacts.write_json(spark, manifest, str(tmp_path / "manifest.json"))
    again = artefacts.read_json(spark, str(tmp_path / "manifest.json"))
    assert again["inputs"] == {"corpus_digest": "corpus", "labels_digest": "labels", "items": 40, "queries": 40} and len(again["experiments"]) == len(which)
    assert again["experiments"][0]["labels"]["cast"]["10"]["queries"] == rows["rep_A", "cast", 10].queries and experiments.manifest(run, "corpus", "labels") == manifest
    run.close()
    quick = experiments.Run(experiments.chosen(which, names=["evidence_mt8"]), records, base, first=5, backfill=True)
    assert quick.queries.count() == 5 and quick.lists.where("shared < 8").count() == 0
    pool = retrieve.scores(vectorise.representation(features, base), quick.queries).where("shared >= 8")
    assert quick.lists.count() == evaluate.ranked_lists(pool).count() >= evaluate.filtered_lists(evaluate.ranked_lists(retrieve.scores(vectorise.representation(features, base), quick.queries)), 8).count()
    quick.close()


def test_artefacts(spark, tmp_path):
    from tessella.operators.features import feature_records
    from tessella.sources import artefacts

    records, config = some_records(spark), Config()
    groups = labels.label_groups(labels.memberships(records, 5))
    digest = artefacts.write_labels(groups, str(tmp_path / "labels"))
    again = artefacts.read_labels(spark, str(tmp_path / "labels"), check=True)
    show = lambda df: sorted(map(tuple, df.select("kind", "group_key", "item_id").collect()))
    assert show(again) == show(groups) and digest == artefacts.rows_digest(groups.repartition(3)) != artefacts.rows_digest(groups.limit(5))
    artefacts.export_labels(groups, str(tmp_path / "export"))
    assert show(artefacts.import_labels(spark, str(tmp_path / "export"))) == show(groups)
    assert artefacts.rows_digest(groups.unionByName(groups.limit(1))) != digest
    groups.limit(3).write.mode("overwrite").parquet(str(tmp_path / "labels/groups"))
    with pytest.raises(ValueError, match="doesn't hold"):
        artefacts.read_labels(spark, str(tmp_path / "labels"), check=True)
    with pytest.raises(artefacts.MissingArtefact):
        artefacts.read_labels(spark, str(tmp_path / "none"))
    found = feature_records(records, config)
    manifest = artefacts.save_matrix(found, config, str(tmp_path / "matrix"), "C")
    stored = artefacts.load_matrix(spark, str(tmp_path / "matrix"), config)
    assert stored.manifest == manifest and manifest["fields"] == ["overview", "genres", "keywords"] and stored.vocabulary.count() == manifest["geometry"]["dimensions"]
    assert stored.weights.count() == stored.rows.count() == manifest["geometry"]["nonzeros"]
    with pytest.raises(ValueError, match="other settings"):
        artefacts.load_matrix(spark, str(tmp_path / "matrix"), config.with_field("genres", weight=0.5))
    lines = spark.createDataFrame([(1, None, 7), (2, "json_decode_error", None), (3, None, None), (4, None, 7), (5, None, 7), (6, None, 8)], "line_no long, error string, id long")
    (tmp_path / "raw.txt").write_text("x\n")
    first = artefacts.write_corpus(found, str(tmp_path / "corpus"), config, lines, str(tmp_path / "raw.txt"))
    second = artefacts.write_corpus(found.repartition(5), str(tmp_path / "other"), config, lines.repartition(2), str(tmp_path / "raw.txt"))
    assert first == second == artefacts.read_json(spark, str(tmp_path / "corpus/manifest.json"))
    assert first["load_report"] == {"lines_total": 6, "records_parsed": 5, "malformed": 1, "invalid_id": 1, "duplicate_id": 2, "kept": 2, "samples": {"malformed": [{"line_no": 2, "detail": "json_decode_error"}], "invalid_id": [{"line_no": 3, "detail": None}], "duplicate_id": [{"line_no": 4, "detail": "7"}, {"line_no": 5, "detail": "7"}]}}
    assert first["corpus"]["records"] == 40 and set(first["corpus"]["tokens_by_field"]) == {"overview", "keywords", "genres", "cast", "director"} and len(first["raw"]) == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", ["recommend_topk", "recommend_skipped", "representation_d", "eval_recall", "eval_spearman", "label_pairs", "audit_describe", "feature_records", "search_titles", "exp_selected"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    show = lambda row: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)
    got = entry.queries()[name](spark, DATA).select(*columns).collect()
    assert sorted(map(show, got)) == sorted(map(show, want.fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_packed_lists_are_gated_and_judged_without_dealing_places_out(spark):
    """Lists of a row each, gated without a shuffle, give what the metrics say of a row for each place."""
    import random

    from tessella.operators import pruned
    from tessella.sources.scratch import Scratch

    r = random.Random(5)
    rows = [(q, k, i, round(1 - k / 10, 1), r.randrange(1, 6)) for q in range(0, 40, 2) for k, i in enumerate(r.sample([i for i in range(40) if i != q], r.randrange(1, 9)), 1)]
    scratch = Scratch(spark, "packed")
    plain, packed = lists(spark, rows), scratch.keep(evaluate.packed_lists(lists(spark, rows)), "lists")
    gated = evaluate.gated_lists(packed, 3)
    assert "Exchange" not in pruned.places(gated)._jdf.queryExecution().executedPlan().toString()
    want = evaluate.filtered_lists(plain, 3)
    show = lambda df: sorted(map(tuple, df.collect()))
    assert show(pruned.places(gated).select(want.columns)) == show(want)
    features = spark.createDataFrame([(i, [f"g{i % 3}", f"h{i % 5}"], 1900 + 7 * i if i % 4 else 0, float(i % 6)) for i in range(40)], "id long, genres array<string>, release_year int, popularity double")
    features = features.select("id", F.struct("genres").alias("tokens"), "release_year", "popularity")
    queries, percentiles = features.select(F.col("id").alias("query_id")), evaluate.popularity_percentiles(features)
    wide, bias = evaluate.profiles(gated, features, queries, percentiles, 4, (), scratch)
    assert show(wide) == show(evaluate.breadth(want, features, queries, 4)) and show(bias) == show(evaluate.popularity_bias(want, percentiles))
    groups = spark.createDataFrame([("a", f"x{i % 7}", i) for i in range(40)] + [("b", f"y{i % 2}", i) for i in range(0, 30)], "kind string, group_key string, item_id long")
    assert show(evaluate.group_scores(gated, groups, queries, (2, 8))) == show(evaluate.label_scores(want, labels.label_pairs(groups, queries), (2, 8)))
    scratch.delete()
