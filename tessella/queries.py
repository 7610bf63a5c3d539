"""One query for each operator, over whole tables.

Two catalogues stand for films: documents (doc_...) and parts (part_...). Searches ask with every document whose id is
divisible by 100, against all; evaluations ask with every part.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import gates
from tessella.functions.text import canonical_phrase, folded, normalise_name, normalise_text, phrase_token, tokens, year_of
from tessella.operators import audit, evaluate, features, labels, pruned, retrieve, search, searched, vectorise
from tessella.plans import experiments, results
from tessella.plans.config import CUTOFFS, SELECTED_GENRE_WEIGHT, SELECTED_SHARED_TERMS
from tessella.sources import artefacts, jsonl
from tessella.sources.catalogues import DOC_CONFIG, PART_CONFIG, documents_catalogue, parts_catalogue, table
from tessella.sources.scratch import Scratch

#: The shipped settings.
DOC_SELECTED = DOC_CONFIG.with_field("genres", weight=SELECTED_GENRE_WEIGHT)
PART_SELECTED = PART_CONFIG.with_field("genres", weight=SELECTED_GENRE_WEIGHT)
QUERY_STEP = 100
#: Searches of the title index with their limits.
INDEX_SEARCHES = (("brand#1", 50), ("ring", 20), ("#1", 40), ("e", 30), ("brand#23 s", 30), ("nowhere", 5))


# -- catalogues -------------------------------------------------------------------------------------


def doc_features(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_records(documents_catalogue(spark, d), DOC_CONFIG)


def part_features(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_records(parts_catalogue(spark, d), PART_CONFIG)


def doc_queries(found: DataFrame) -> DataFrame:
    return found.where(F.col("id") % QUERY_STEP == 0).select(F.col("id").alias("query_id"))


def doc_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(scores of the stated queries, queries) under the shipped settings."""
    found = doc_features(spark, d)
    queries = doc_queries(found)
    return retrieve.scores(vectorise.representation(found, DOC_SELECTED), queries), queries


def part_best(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame, pruned.Lists, Scratch]:
    """(features, queries, weights, each part's k best, scratch) under the shipped settings; features and weights are written once."""
    scratch = Scratch(spark, "parts")
    records = scratch.keep(parts_catalogue(spark, d), "records")  # labels read them too
    found = scratch.keep(features.feature_records(records, PART_CONFIG), "features")
    weights = scratch.keep(vectorise.representation(found, PART_SELECTED), "weights")
    return found, found.select(F.col("id").alias("query_id")), weights, pruned.best(weights, k, scratch=scratch), scratch


#: Scratch folders of lists that this process wrote, by session and state of the tables' files.
_LISTS: dict[tuple, Scratch] = {}


def _files_state(spark: SparkSession, d: str) -> tuple:
    """Paths, lengths and times of the files that parts are made of."""
    found = []
    for name in ("part", "lineitem", "supplier"):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def part_packed(spark: SparkSession, d: str, gate: int = SELECTED_SHARED_TERMS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(features, queries, weights, filtered lists, a row for each) of all parts. Features, weights and ungated lists are written once for all evaluations
    of the same files; other files, or a folder that is gone, make new ones in place of the old."""
    application = spark.sparkContext.applicationId
    key = (application, _files_state(spark, d), spark.conf.get("spark.checkpoint.dir", None))
    scratch = _LISTS.get(key)
    if scratch is None or not all(artefacts.exists(spark, f"{scratch.root}/{name}/_SUCCESS") for name in ("records", "features", "weights", "lists")):
        for old in [k for k in _LISTS if k[0] != application or k[1] and k[1][0][0] == key[1][0][0]]:
            gone = _LISTS.pop(old)
            if old[0] == application:  # of an earlier session nothing can be asked any more
                gone.delete()
        found, _, weights, lists, scratch = part_best(spark, d, max(CUTOFFS))
        scratch.keep(lists.packed, "lists")
        _LISTS[application, key[1], spark.conf.get("spark.checkpoint.dir", None)] = scratch
    found, weights, lists = (spark.read.parquet(f"{scratch.root}/{name}") for name in ("features", "weights", "lists"))
    return found, found.select(F.col("id").alias("query_id")), weights, evaluate.gated_lists(lists, gate)


def part_records(spark: SparkSession, d: str) -> DataFrame:
    """The records that part_packed, asked before, made its lists of."""
    scratch = _LISTS[spark.sparkContext.applicationId, _files_state(spark, d), spark.conf.get("spark.checkpoint.dir", None)]
    return spark.read.parquet(f"{scratch.root}/records")


def part_lists(spark: SparkSession, d: str, gate: int = SELECTED_SHARED_TERMS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The same with a row for each place of a list."""
    found, queries, weights, lists = part_packed(spark, d, gate)
    return found, queries, weights, pruned.places(lists)


def part_members(spark: SparkSession, d: str) -> DataFrame:
    return labels.memberships(parts_catalogue(spark, d), PART_CONFIG.fields["cast"].top_k)


# -- sources, gates and text ------------------------------------------------------------------------


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    """(line_no, value): the events' properties as they might arrive, most of every ten lines broken in some way by their number."""
    e = F.col("event_id")
    k = lambda text: F.concat(F.lit('{"k": '), F.lit(text) if isinstance(text, str) else text, F.lit("}"))
    odd = {
        0: F.substring("props", 1, 4), 1: F.lit("[1, 2]"), 2: F.lit(" \t "), 3: k(F.concat(F.lit('"\\t-'), e.cast("string"), F.lit('\\u00a0"'))), 4: k("true"), 5: k("1.5"), 6: k("null"), 7: k('"x1"'),
    }
    value = F.col("props")
    for n, text in odd.items():
        value = F.when(e % 10 == n, text).otherwise(value)
    return table(spark, d, "events").select(e.alias("line_no"), value.alias("value"))


def varied_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts with several genres, jobs and directors, and with credits out of order or without an order."""
    credit = lambda job, name: F.struct(F.lit(job).alias("job"), name.alias("name"))
    parts = parts_catalogue(spark, d)
    brand, name = F.col("crew")[0]["name"], F.col("title")
    crew = F.array(credit("Producer", name), credit("Director", F.col("genres")[0]), credit("Story", name), credit("Director", brand), credit("Editor", name))
    shuffled = F.when(F.col("id") % 3 == 0, F.reverse("cast")).otherwise(F.col("cast"))
    cast = F.transform(shuffled, lambda c, i: F.struct(F.when((F.col("id") % 5 != 0) | (i > 0), c["order"]).alias("order"), c["flag"].alias("flag"), c["name"].alias("name")))
    return parts.withColumn("genres", F.array(F.col("genres")[0], brand, F.upper(F.col("genres")[0]), F.lit("x"))).withColumn("cast", cast).withColumn("crew", crew)


def ingest_events_props(spark, d):
    rows = jsonl.parsed(raw_events(spark, d))
    k = gates.part(F.col("record"), "k")
    return rows.select("line_no", "error", gates.kind(k).alias("k_kind"), gates.integer(k).alias("k"), gates.number(k).alias("k_number"), gates.string(k).alias("k_text"), gates.boolean(k).alias("k_flag"))


def coerce_id(spark, d):
    rows = jsonl.parsed(raw_events(spark, d))
    return rows.select("line_no", gates.coerced_id(gates.part(F.col("record"), "k")).alias("id"))


def text_normalise(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(normalise_text(F.col("text"), DOC_CONFIG)).alias("digest"))


def tokenize_documents(spark, d):
    found = tokens(folded(F.col("text"), DOC_CONFIG), DOC_CONFIG, 2, True)
    docs = table(spark, d, "documents").select("doc_id", found.alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


def canonical_phrases(spark, d):
    return table(spark, d, "part").select("p_partkey", canonical_phrase(normalise_text(F.concat_ws(" -- ", "p_brand", "p_type", "p_name"), PART_CONFIG)).alias("phrase"))


def phrase_tokens(spark, d):
    found = phrase_token(normalise_text(F.col("c_mktsegment"), PART_CONFIG), 2)
    return table(spark, d, "customer").select("c_custkey", F.array_join(found, "|").alias("token"))


def release_year(spark, d):
    return parts_catalogue(spark, d).select("id", "release_date", year_of(F.col("release_date")).cast("long").alias("release_year"))


def normalised_names(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(normalise_name(F.col("text"))).alias("digest"))


def project_nested(spark, d):
    found = features.project_record(varied_parts(spark, d), 3)
    return found.select("id", F.array_join(F.transform("cast", lambda c: c["name"]), "|").alias("cast"), F.array_join(F.transform("crew", lambda c: F.concat(c["job"], F.lit(":"), c["name"])), "|").alias("crew"))


def resume_anti_join(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(done, "p_partkey", "left_anti").select("p_partkey", "p_name")


def stratified_sample(spark, d):
    return features.stratified_sample(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey", 300, 42)


def stratified_uneven(spark, d):
    """Sources of documents differ in size, so the sample is topped up by steps."""
    return features.stratified_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 300, 42)


# -- feature records --------------------------------------------------------------------------------


def _block(found: DataFrame, field: str) -> DataFrame:
    return found.select("id", F.size(f"tokens.{field}").cast("long").alias("n"), F.md5(F.array_join(f"tokens.{field}", " ")).alias("digest"))


def overview_block(spark, d):
    return _block(doc_features(spark, d), "overview")


def keyword_block(spark, d):
    return _block(doc_features(spark, d), "keywords")


def genre_block(spark, d):
    return _block(features.feature_records(varied_parts(spark, d), PART_CONFIG), "genres")


def cast_block(spark, d):
    return _block(part_features(spark, d), "cast")


def director_block(spark, d):
    return _block(features.feature_records(varied_parts(spark, d), PART_CONFIG), "director")


def feature_records(spark, d):
    return part_features(spark, d).select("id", "title", "original_title", "release_year", "collection_name", "popularity", "vote_count", F.col("document_size").cast("long").alias("document_size"), F.array_join("document", " ").alias("document"))


def item_metadata(spark, d):
    return retrieve.metadata(part_features(spark, d))


def dedupe_first_wins(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), "l_suppkey", "l_quantity")
    return features.first_of_each_id(lines, ("line_no", "l_suppkey", "l_quantity")).select("id", "line_no")


def _raw_ids(spark, d):
    return jsonl.parsed(raw_events(spark, d)).select("line_no", "error", gates.coerced_id(gates.part(F.col("record"), "k")).alias("id"))


def load_report(spark, d):
    return features.load_report(_raw_ids(spark, d).drop("line_no"))


def load_samples(spark, d):
    return artefacts.load_samples(_raw_ids(spark, d))


def manifest_corpus(spark, d):
    found = part_features(spark, d)
    return artefacts.corpus_counts(found).drop("stinger_labels")


def manifest_token_stats(spark, d):
    return features.token_statistics(doc_features(spark, d))


# -- vectors ----------------------------------------------------------------------------------------


def _sums(weights: DataFrame) -> DataFrame:
    """Weights by item, as a count and two sums."""
    return weights.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("sum_w"), F.round(F.max("w"), 6).alias("max_w"))


def tf_sublinear(spark, d):
    counts = vectorise.term_counts(vectorise.token_table(doc_features(spark, d), ("overview",)))
    return counts.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.sum(vectorise.sublinear(F.col("tf"))), 6).alias("sum_tf"))


def idf_smooth(spark, d):
    found = doc_features(spark, d)
    n = found.agg(F.count("*")).scalar()
    known = vectorise.document_frequencies(vectorise.term_counts(vectorise.token_table(found)))
    return known.select("field", "term", "df", F.round(vectorise.smooth_idf(n, F.col("df")), 6).alias("idf"))


def df_pruned_vocab(spark, d):
    counts = vectorise.term_counts(vectorise.token_table(doc_features(spark, d)))
    return vectorise.vocabulary(counts, DOC_CONFIG)


def tfidf_weights(spark, d):
    return _sums(vectorise.tfidf(part_features(spark, d), PART_CONFIG))


def tfidf_block(spark, d):
    return _sums(vectorise.tfidf_block(doc_features(spark, d), DOC_CONFIG, "overview"))


def l2_rows(spark, d):
    weights = vectorise.representation(doc_features(spark, d), DOC_CONFIG)
    return weights.groupBy("item_id").agg(F.round(F.sum(F.col("w") * F.col("w")), 6).alias("squares"))


def representation_d(spark, d):
    weights = vectorise.representation(part_features(spark, d), PART_SELECTED)
    return weights.select("item_id", "field", "term", F.round("w", 6).alias("w"))


def representation_flat(spark, d):
    return _sums(vectorise.flat(doc_features(spark, d), DOC_CONFIG))


def representation_geometry(spark, d):
    found = doc_features(spark, d)
    return vectorise.geometry(vectorise.representation(found, DOC_CONFIG), found)


def representation_compare(spark, d):
    return vectorise.comparison(part_features(spark, d), PART_CONFIG)


def field_energy_share(spark, d):
    return vectorise.energy_share(vectorise.representation(doc_features(spark, d), DOC_SELECTED))


def field_coverage(spark, d):
    return vectorise.coverage_by_field(vectorise.representation(doc_features(spark, d), DOC_CONFIG))


def weight_solver(spark, d):
    return vectorise.solved_weights(vectorise.energy_share(vectorise.representation(part_features(spark, d), PART_CONFIG)), 0.05)


# -- retrieval --------------------------------------------------------------------------------------


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


def doc_searches(spark: SparkSession, d: str, among: Column | None = None) -> searched.Searches:
    """The stated queries under the shipped settings, for searches that list no pair; among, where given, says of features whether they may be found."""
    return searched.Searches.of(doc_features(spark, d), DOC_SELECTED, F.col("id") % QUERY_STEP == 0, among=among)


def recommend_single(spark, d):
    """Neighbours of one document, the first, by the terms of its text alone."""
    first = table(spark, d, "documents").agg(F.min("doc_id")).scalar()
    return _shown(searched.Searches.of(doc_features(spark, d), DOC_CONFIG, F.col("id") == first, "A").recommend(10))


def recommend_topk(spark, d):
    return _shown(retrieve.recommend(doc_scores(spark, d)[0], 10, 0.0, SELECTED_SHARED_TERMS))


def recommend_many(spark, d):
    scratch = Scratch(spark, "many")
    found = scratch.keep(part_features(spark, d), "features")
    accepted = searched.Searches.of(found, PART_SELECTED, F.col("id") % QUERY_STEP == 0, scratch=scratch).recommend(10, 0.0, SELECTED_SHARED_TERMS)
    return _shown(retrieve.with_metadata(accepted, found))


def recommend_min_score(spark, d):
    return _shown(doc_searches(spark, d).recommend(10, 0.2))


def recommend_evidence(spark, d):
    return _shown(doc_searches(spark, d).recommend(10, 0.0, 8))


def recommend_subset(spark, d):
    return _shown(doc_searches(spark, d, F.col("original_language") == "en").recommend(10))


def recommend_skipped(spark, d):
    return doc_searches(spark, d).skipped(10, 0.05, 8)


def recommend_skip_tally(spark, d):
    return doc_searches(spark, d).skip_tally(50, 0.05, 8)


def recommend_evidence_block(spark, d):
    return doc_searches(spark, d).evidence(10, 0.05, 8)


def similarity_rows(spark, d):
    return _shown(doc_scores(spark, d)[0])


def ranked_candidates(spark, d):
    return _shown(doc_searches(spark, d).ranked())


def sparse_topk(spark, d):
    return _shown(doc_searches(spark, d).recommend(20)).select("query_id", "item_id", "score", "rank")


def topk_batch(spark, d):
    lists = part_best(spark, d, 10)[3].rows
    return _shown(lists.select("query_id", "item_id", "score", "shared", "rank"))


def search_titles(spark, d):
    return search.search_titles(part_features(spark, d), " Brand#1 ", 50).unionByName(search.search_titles(part_features(spark, d), "ring", 20))


def search_index(spark, d):
    """Searches of an index over all parts: whole and partial titles, original titles, and queries shorter than a posting."""
    scratch = Scratch(spark, "titles")
    index = search.TitleIndex.write(part_features(spark, d), scratch.root)
    found = [index.search(q, n).withColumn("query", F.lit(q)) for q, n in INDEX_SEARCHES]
    return reduce(DataFrame.unionByName, found)


def select_queries(spark, d):
    """Parts have no films' genres, so two of theirs stand for them."""
    found = part_features(spark, d)
    groups = labels.label_groups(part_members(spark, d))
    return search.select_queries(found, vectorise.representation(found, PART_CONFIG), groups, {"documentary": ("economy",), "animation_family": ("promo", "small")})


# -- labels and evaluation --------------------------------------------------------------------------


def label_groups(spark, d):
    return labels.label_groups(part_members(spark, d))


def labels_restricted(spark, d):
    large = table(spark, d, "part").where("p_size >= 25").select(F.col("p_partkey").alias("item_id"))
    return labels.label_groups(labels.memberships(parts_catalogue(spark, d), 5, large))


def label_pairs(spark, d):
    groups = Scratch(spark, "groups").keep(labels.label_groups(labels.memberships(documents_catalogue(spark, d), 5)), "groups")
    asked = table(spark, d, "documents").where(F.col("doc_id") % QUERY_STEP == 0).select(F.col("doc_id").alias("query_id"))
    return labels.label_pairs(groups, asked)


def label_summary(spark, d):
    return labels.label_summary(labels.label_groups(part_members(spark, d)))


def eval_unevaluable(spark, d):
    """Documents that share nothing: parts all share a brand."""
    groups = labels.label_groups(labels.memberships(documents_catalogue(spark, d), 5))
    return labels.unevaluable(groups, table(spark, d, "documents").select(F.col("doc_id").alias("query_id")))


def _label_scores(spark, d):
    _, queries, _, lists = part_packed(spark, d, 1)
    scratch = Scratch(spark, "groups")
    groups = scratch.keep(labels.label_groups(labels.memberships(part_records(spark, d), PART_CONFIG.fields["cast"].top_k)), "groups")
    return evaluate.group_scores(lists, groups, queries, CUTOFFS, scratch=scratch)


def eval_recall(spark, d):
    return _label_scores(spark, d).drop("ndcg")


def eval_ndcg(spark, d):
    return _label_scores(spark, d).select("kind", "k", "ndcg")


def eval_coverage(spark, d):
    found, _, _, lists = part_lists(spark, d)
    return evaluate.coverage(lists, found)


def eval_ild(spark, d):
    _, _, weights, lists = part_packed(spark, d)
    return evaluate.diversity(lists, weights)


def eval_breadth(spark, d):
    found, queries, _, lists = part_lists(spark, d)
    return evaluate.breadth(lists, found, queries, 10)


def _statistics(spark, d, column: str):
    _, queries, _, lists = part_lists(spark, d)
    return evaluate.list_statistics(lists, queries, 10).select(column)


eval_top1 = partial(_statistics, column="mean_top1_score")
eval_thin = partial(_statistics, column="thin_rate")
eval_returned = partial(_statistics, column="mean_returned")


def eval_popularity(spark, d):
    found, _, _, lists = part_lists(spark, d)
    return evaluate.popularity_bias(lists, evaluate.popularity_percentiles(found)).select("mean_percentile")


def eval_spearman(spark, d):
    found, _, _, lists = part_lists(spark, d)
    return evaluate.popularity_bias(lists, evaluate.popularity_percentiles(found)).select("rho")


def popularity_percentiles(spark, d):
    return evaluate.popularity_percentiles(part_features(spark, d)).select("item_id", F.round("percentile", 6).alias("percentile"))


def _run(spark, d, **which) -> experiments.Run:
    return experiments.Run(experiments.chosen(experiments.matrix(PART_CONFIG), **which), parts_catalogue(spark, d), PART_CONFIG)


def _family(spark, d, family: str):
    return _run(spark, d, families=[family]).results().drop("family")


def exp_stored(spark, d):
    """The selected experiment run into a result store, and read back from it after a comparison of inputs."""
    store = results.Store(spark, Scratch(spark, "results").root)
    which, records = experiments.chosen(experiments.matrix(PART_CONFIG), names=["selected"]), Scratch(spark, "records").keep(parts_catalogue(spark, d), "parts")
    for _ in range(2):
        found = store.results(which, records, PART_CONFIG)
    return found.drop("family")


def exp_samples(spark, d):
    return _shown(_run(spark, d, names=["rep_D", "selected"]).samples(["rep_D", "selected"]))


# -- audit ------------------------------------------------------------------------------------------


def audit_missing(spark, d):
    return audit.missing_counts(documents_catalogue(spark, d))


def audit_ids(spark, d):
    lines = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_orderkey")).alias("id"))
    return audit.id_integrity(lines, "id")


def audit_title_groups(spark, d):
    return audit.duplicate_titles(parts_catalogue(spark, d))


def audit_text_quality(spark, d):
    return audit.text_quality(documents_catalogue(spark, d))


def audit_usability(spark, d):
    return audit.usability(parts_catalogue(spark, d))


def audit_describe(spark, d):
    return audit.describe(table(spark, d, "documents"), "n_chars")


def audit_distributions(spark, d):
    parts, docs = parts_catalogue(spark, d), documents_catalogue(spark, d)
    kinds = [("genre", parts), ("keyword", parts), ("year", parts), ("language", docs)]
    kinds += [("job", varied_parts(spark, d))]
    rows = [audit.distribution(c, k).select(F.lit(k).alias("kind"), "value", "n") for k, c in kinds]
    top = audit.most_common(audit.distribution(parts, "keyword"), 10).select(F.lit("top_keyword").alias("kind"), "value", "n")
    out = top
    for r in rows:
        out = out.unionByName(r)
    return out


def audit_cast_order(spark, d):
    return audit.cast_order(varied_parts(spark, d))


def audit_structure(spark, d):
    return audit.structure(varied_parts(spark, d))


def audit_list_sizes(spark, d):
    return audit.list_sizes(parts_catalogue(spark, d).withColumn("runtime", F.col("vote_count").cast("int") - 30))


def validate_corpus(spark, d):
    return jsonl.validate_corpus(doc_features(spark, d), 100)


_PLAIN = (
    ingest_events_props, coerce_id, text_normalise, tokenize_documents, phrase_tokens, release_year, project_nested, resume_anti_join, stratified_sample, stratified_uneven, overview_block, keyword_block,
    genre_block, cast_block, director_block, feature_records, item_metadata, dedupe_first_wins, load_report, manifest_token_stats, tf_sublinear, idf_smooth, df_pruned_vocab, tfidf_weights,
    tfidf_block, l2_rows, representation_d, representation_flat, representation_geometry, representation_compare, field_energy_share, field_coverage, weight_solver, recommend_single,
    recommend_topk, recommend_many, recommend_min_score, recommend_evidence, recommend_subset, recommend_skipped, recommend_skip_tally, recommend_evidence_block, similarity_rows,
    ranked_candidates, sparse_topk, topk_batch, search_titles, search_index, select_queries, label_groups, labels_restricted, label_pairs, label_summary, eval_unevaluable, eval_recall, eval_ndcg,
    eval_coverage, eval_ild, eval_breadth, eval_popularity, eval_spearman, popularity_percentiles, audit_missing, audit_ids, audit_title_groups, audit_text_quality, audit_usability,
    audit_describe, audit_distributions, audit_cast_order, exp_samples, exp_stored, load_samples, manifest_corpus, audit_structure, audit_list_sizes, validate_corpus,
)
QUERIES = {f.__name__: f for f in _PLAIN} | {
    "canonical_phrase": canonical_phrases, "normalise_name": normalised_names, "eval_top1": eval_top1, "eval_thin": eval_thin, "eval_returned": eval_returned,
    "exp_representation": partial(_family, family="representation"), "exp_genre_sweep": partial(_family, family="genre_sweep"), "exp_cast_k": partial(_family, family="cast_top_k"),
    "exp_ablation": partial(_family, family="ablation"), "exp_single_field": partial(_family, family="single_field"), "exp_evidence": partial(_family, family="min_shared_terms"),
    "exp_selected": partial(_family, family="selected"),
}
