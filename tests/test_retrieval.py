"""Vectors, ranks, gates, search and the service."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import retrieve, search, vectorise
from tessella.plans import service
from tessella.plans.config import Config

#: Eight rows over four terms; ids are 100 + row, and 100 asks.
CELLS = [(3.0, 0.5, 0.5, 0.5), (1.0, 0, 0, 0), (1.0, 0, 0, 0), (1.0, 0, 0, 0), (0.4, 0.4, 0.4, 0), (0, 0.4, 0.4, 0.4), (0.4, 0, 0.4, 0.4), (0, 0, 0, 1.0)]


@pytest.fixture(scope="module")
def scored(spark):
    rows = []
    for k, row in enumerate(CELLS):
        norm = math.sqrt(sum(x * x for x in row))
        rows += [(100 + k, "overview", f"t{j}", x / norm) for j, x in enumerate(row) if x]
    weights = spark.createDataFrame(rows, "item_id long, field string, term string, w double")
    return retrieve.scores(weights, spark.createDataFrame([(100,)], "query_id long")).persist()


def ids(df, order):
    return [r.item_id for r in df.orderBy(order).collect()]


@pytest.mark.parametrize(
    ("k", "score", "shared", "accepted", "rejected"),
    [
        (3, 0, 2, [104, 106, 105], [101, 102, 103]), (1, 0, 2, [104], [101, 102, 103]), (6, 0, 2, [104, 106, 105], [101, 102, 103, 105, 107]), (6, 0, 99, [], [101, 102, 103, 104, 106, 105, 107]),
        (10, 0.5, 1, [101, 102, 103, 104, 106], [105, 107]), (2, 0, 1, [101, 102], []),
    ],
)
def test_gates_backfill(scored, k, score, shared, accepted, rejected):
    got, passed = retrieve.recommend(scored, k, score, shared), retrieve.skipped(scored, k, score, shared)
    if k == 6 and shared == 2:
        rejected = [101, 102, 103, 107]
    assert ids(got, "rank") == accepted and [r["rank"] for r in got.orderBy("rank").collect()] == list(range(1, len(accepted) + 1))
    assert ids(passed, "place") == rejected
    block = retrieve.evidence(got, passed, scored.select("query_id"), k, shared).first()
    assert (block.returned, block.candidates_examined, block.exhausted) == (len(accepted), len(accepted) + len(rejected), len(accepted) < k)


def test_scores_and_errors(scored):
    by = {r.item_id: (round(r.score, 3), r.shared) for r in scored.collect()}
    assert by[101] == (0.961, 1) and by[104] == (0.74, 3) and by[105] == (0.277, 3) and by[107] == (0.16, 1) and 100 not in by
    with pytest.raises(ValueError, match="room for one"):
        retrieve.top_k(scored, 0)
    with pytest.raises(ValueError, match="shared term"):
        retrieve.recommend(scored, 1, 0.0, 0)
    assert ids(retrieve.ranked(scored), "rank") == [101, 102, 103, 104, 106, 105, 107]
    assert {r.reason: r.n for r in retrieve.skip_tally(retrieve.skipped(scored, 9, 0.2, 2)).collect()} == {"insufficient_shared_terms": 3, "below_min_score": 1}


def catalogue(spark, rows):
    """rows: (id, title, original, overview terms, genres, collection)."""
    data = [(i, t, o, None, None, "en", None, c, float(i), None, None, False, (ov, [], g, [], []), ov + g, len(ov + g), []) for i, t, o, ov, g, c in rows]
    from tessella.sources.jsonl import FEATURES

    return spark.createDataFrame(data, FEATURES)


@pytest.fixture(scope="module")
def films(spark):
    rows = []
    for k, (word, genre) in enumerate((("space", "sf"), ("ocean", "drama"), ("heist", "crime"))):
        for j in range(4):
            i = 100 + 3 * j + k
            rows.append((i, f"{word.title()} {j}", f"Orig {word} {j}", [word, "ship", f"w{j}", f"w{(i * 7) % 5}"], [genre], word))
    rows += [(900, "Nothing", None, [], [], None), (901, "100% Space_", "x", ["lonely"], ["sf"], None)]
    return catalogue(spark, rows).persist()


def test_weights(spark, films):
    config = Config()
    weights = vectorise.representation(films, config)
    norms = weights.groupBy("item_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert len(norms) == 13 and all(abs(r.n - 1) < 1e-12 for r in norms)
    known = {(r.field, r.term): r.df for r in vectorise.vocabulary(vectorise.term_counts(vectorise.token_table(films)), config).collect()}
    assert known["overview", "space"] == 4 and ("overview", "lonely") not in known and known["genres", "sf"] == 5
    idf = vectorise.tfidf(films, config).where("term = 'space'").first()
    assert abs(idf.idf - (math.log(15 / 5) + 1)) < 1e-12 and abs(idf.w - idf.idf) < 1e-12
    shape = vectorise.geometry(weights, films).first()
    assert shape["items"] == 14 and shape.empty_items == 1 and shape.nonzeros == weights.count()
    shares = {r.field: r.share_pct for r in vectorise.energy_share(weights).collect()}
    assert abs(sum(shares.values()) - 100) < 0.05
    light = {r.field: r.share_pct for r in vectorise.energy_share(vectorise.representation(films, config.with_field("genres", weight=0.44))).collect()}
    assert light["genres"] < shares["genres"]
    none = vectorise.representation(films, config.with_field("genres", weight=0.0))
    assert none.where("field = 'genres'").count() == 0
    flat = vectorise.representation(films, Config(block_mode="flat"))
    assert abs(flat.groupBy("item_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).agg(F.min("n")).first()[0] - 1) < 1e-12
    with pytest.raises(ValueError, match="block mode"):
        vectorise.representation(films, Config(block_mode="other"))
    empty = vectorise.representation(films.limit(0), config)
    shape = vectorise.geometry(empty, films.limit(0)).first()
    assert empty.count() == 0 and shape.density_pct == 0 and vectorise.energy_share(empty).count() == 0


def test_weight_solver():
    assert abs(vectorise.weight_for_share(0.05, 0.2111) - 0.4435) < 1e-3 and vectorise.weight_for_share(0, 0.5) == 0
    for target, current in ((1, 0.5), (0.5, 0), (0.5, 1)):
        with pytest.raises(ValueError):
            vectorise.weight_for_share(target, current)


def test_search_tiers(films):
    got = search.search_titles(films, " SPACE 1 ", 5).collect()
    assert [(r.id, r.match) for r in got] == [(103, "exact")]
    got = search.search_titles(films, "space", 3).collect()
    assert [r.match for r in got] == ["title_prefix"] * 3 and [r.id for r in got] == [100, 103, 106] and got[0].total_matches == 5
    assert [r.id for r in search.search_titles(films, "0% sp", 5).collect()] == [901]
    assert search.search_titles(films, "s_ace", 5).count() == 0 and [r.match for r in search.search_titles(films, "orig heist", 9).collect()] == ["original_title_prefix"] * 4


def test_query_selection(spark, films):
    groups = spark.createDataFrame([("franchise", "ocean", i) for i in (101, 104, 107, 110)] + [("franchise", "few", i) for i in (100, 103, 106)] + [("same_title", "t", 105), ("same_title", "t", 102), ("same_title", "u", 100)], "kind string, group_key string, item_id long")
    weights = vectorise.representation(films, Config())
    chosen = lambda **kw: {r.purpose: r.id for r in search.select_queries(films, weights, groups, **kw).collect()}
    want = {"popular": 901, "obscure": 100, "sparse_features": 900, "no_overview": 900, "same_title": 102, "franchise": 101}
    assert chosen() == want  # no film here is of the genres asked for
    assert chosen(genres={"documentary": ("drama",), "animation_family": ("crime", "sf")}) == want | {"documentary": 101, "animation_family": 100}


def test_padded_lists(spark):
    lists = spark.createDataFrame([(1, 1, 9, 0.5, 2), (2, 1, 1, 0.9, 1), (2, 2, 3, 0.8, 1), (2, 3, 4, 0.7, 1)], "query_id long, rank long, item_id long, score double, shared long")
    queries, items = spark.createDataFrame([(1,), (2,), (8,)], "query_id long"), spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 8, 9)], "item_id long")
    got = {}
    for r in retrieve.padded(lists, queries, items, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.score, r.shared))
    assert got == {1: [(1, 9, 0.5, 2), (2, 2, 0.0, 0), (3, 3, 0.0, 0)], 2: [(1, 1, 0.9, 1), (2, 3, 0.8, 1), (3, 4, 0.7, 1)], 8: [(1, 1, 0.0, 0), (2, 2, 0.0, 0), (3, 3, 0.0, 0)]}
    assert retrieve.padded(lists.limit(0), queries, items.limit(1), 3).count() == 2


def test_service(films):
    known = service.Catalogue(films, limits=service.Limits(default_k=2, max_k=3, max_limit=4, default_limit=2, max_query_length=12), min_shared=2)
    assert known.health()["status"] == "ok" and known.ready()["status"] == "ready" and known.meta().first()["items"] == 14
    accepted, rejected, evidence = known.recommend(100)
    assert {r.item_id for r in accepted.collect()} <= {103, 106, 109} and accepted.count() == 2 and evidence.first().requested_k == 2
    assert {"title", "genres", "collection_name"} <= set(accepted.columns) and rejected.columns == ["query_id", "place", "item_id", "reason"]
    assert known.recommend_many([100, 101], 3).select("query_id").distinct().count() == 2
    details = known.details(900).first()
    assert details.recommendable is False and details.feature_counts["overview"] == 0
    for error, ask in (
        (service.EmptyQuery, lambda: known.search("  ")), (service.QueryTooLong, lambda: known.search("x" * 13)), (service.InvalidLimit, lambda: known.search("x", 5)), (service.InvalidK, lambda: known.recommend(12345, 4)),
        (service.UnknownItem, lambda: known.recommend(12345)), (service.UnknownItem, lambda: known.recommend_many([100, 5])), (service.InsufficientFeatures, lambda: known.recommend(900)), (service.UnknownItem, lambda: known.details(1)),
    ):
        with pytest.raises(error) as found:
            ask()
        assert found.value.code and 400 <= found.value.status < 500
    with pytest.raises(service.CatalogueUnavailable):
        service.Catalogue(films.limit(0)).ready()
    assert known.stats()["items"] == 14 and known.stats()["load_seconds"] >= 0
    ask = known.answer
    status, found = ask("GET", "/movies/search", q="space", limit="2")
    assert status == 200 and found["total_matches"] == 5 and [r["id"] for r in found["results"]] == [100, 103]
    status, near = ask("get", "movies/100/recommendations", k=2)
    assert status == 200 and [r["rank"] for r in near["recommendations"]] == [1, 2] and near["evidence"]["requested_k"] == 2
    assert ask("GET", "movies/900")[1]["recommendable"] is False and ask("GET", "meta")[1]["items"] == ask("GET", "stats")[1]["items"] == 14
    errors = {("GET", "movies/search", ""): (400, "empty_query"), ("GET", "movies/x", ""): (422, "validation_error"), ("GET", "movies/1", ""): (404, "unknown_movie"), ("GET", "films", ""): (404, "not_found"), ("POST", "health", ""): (405, "method_not_allowed"), ("GET", "movies/900/recommendations", ""): (422, "insufficient_features")}
    for (method, path, q), (status, code) in errors.items():
        got = ask(method, path, q=q)
        assert got[0] == status and got[1]["error"]["code"] == code and got[1]["error"]["status"] == status
    assert ask("GET", "movies/search", q="x", limit="many")[1]["error"]["code"] == "validation_error" and ask("GET", "movies/search", q="x", limit=99)[0] == 422
    known.features = None
    assert ask("GET", "movies/100") == (500, {"error": {"code": "internal_error", "message": "internal error", "status": 500}})
    known.features = films
    known.close()


def test_catalogue_from_storage(spark, films, tmp_path):
    """What save() wrote answers like the catalogue that it was made of; what isn't there, is empty or was built otherwise is unavailable."""
    path = str(tmp_path / "catalogue")
    manifest = service.Catalogue.save(films, path)
    assert manifest["corpus"]["records"] == 14 and manifest["corpus"]["nonempty_documents"] == 13 and "stinger_labels" in manifest["corpus"]
    built, loaded = service.Catalogue(films, min_shared=1), service.Catalogue.load(spark, path, min_shared=1)
    show = lambda c: [(r.item_id, round(r.score, 9), r.shared) for r in c.recommend(103)[0].orderBy("rank").collect()]
    assert show(built) == show(loaded) and loaded.stats()["nonzeros"] == built.stats()["nonzeros"]
    for where, config in ((str(tmp_path / "nowhere"), None), (path, Config())):
        with pytest.raises(service.CatalogueUnavailable):
            service.Catalogue.load(spark, where, config)
    service.Catalogue.save(films.limit(0), str(tmp_path / "empty"))
    with pytest.raises(service.CatalogueUnavailable):
        service.Catalogue.load(spark, str(tmp_path / "empty"))


def test_title_index_says_what_the_scan_says(spark, tmp_path):
    """Random titles of few characters, beyond ASCII, missing, empty, repeated and long ones; queries of every length; and how little a search reads."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abÄß é\U0001f600") for _ in range(rnd.randrange(0, 9)))
    rows = [(i, rnd.choice((word(), "same title", None, "", "  ")), rnd.choice((word(), None, "aaaaaaa", "a\0b")), [], [], None) for i in range(400)]
    rows += [(1000, "x" * 5_000 + "needle" + "\U0001f600" * 20_000, "Long", [], [], None), (1001, "a\0", "ab\0\0", [], [], None)]
    found = catalogue(spark, rows).persist()
    index = search.TitleIndex.write(found, str(tmp_path / "titles"))
    show = lambda df: [tuple(r) for r in df.orderBy("place").collect()]
    queries = {"a", "AB", "ss", "ß", " É ", "\U0001f600", "same title", "same", "me ti", "e t", "aaaa", "aaaaaaa", "aaaaaaaa", "a\0", "\0", "needle", "zz", "nothing at all", "b\0", "%", "_"}
    queries |= {q for q in (word() for _ in range(4)) if q.strip()}
    for q in sorted(queries):
        for limit in (3, 500) if len(q) % 2 else (500,):
            assert show(index.search(q, limit)) == show(search.search_titles(found, q, limit)), (q, limit)
    assert show(index.search("  ", 30)) == show(search.search_titles(found, "  ", 30)) and index.search("zz", 3).columns == search.search_titles(found, "zz", 3).columns
    assert index.postings("needle").count() == 2 and index.grams.count() > 25_000  # two grams at one place each
    plan = index.postings("needle")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [dle,nee])]" in plan
    none = search.TitleIndex.write(found.limit(0), str(tmp_path / "none"))
    assert none.search("a", 3).count() == 0 and none.search(" ", 3).count() == 0
    found.unpersist()


def jobs(spark, name, ask):
    """Jobs that asking starts."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        ask()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_an_item_is_looked_up_by_one_query(spark, films):
    """One collect: the scalar that says whether it has terms is part of the row's plan. Unknown items cost no more."""
    known = service.Catalogue(films, min_shared=2)
    known.stats()
    try:
        asked = []
        real = known._row
        known._row = lambda item: asked.append(item) or real(item)
        assert known.answer("GET", "movies/103")[1]["recommendable"] is True and known.answer("GET", "movies/1")[0] == 404 and asked == [103, 1]
        # the row's own job and those of its subquery: no separate look whether the item exists, or has terms
        assert jobs(spark, "details", lambda: known.answer("GET", "movies/103")) <= 3
        accepted, rejected, evidence = known.recommend(103, 5)
        got = known.answer("GET", "movies/103/recommendations", k=5)[1]
        assert [r["item_id"] for r in got["recommendations"]] == ids(accepted, "rank") and [r["item_id"] for r in got["skipped"]] == ids(rejected, "place") and got["evidence"] == evidence.drop("query_id").first().asDict() | {"query_id": 103}
    finally:
        known.close()
