"""Raw lines to feature records."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import audit, features
from tessella.plans.config import Config
from tessella.sources import jsonl
from tessella.streaming.records import stream_features, write_features

OVERVIEW = "On a drowned coast, twin keepers light an abandoned beacon and wait for whoever answers."
WORDS = ["drowned", "coast", "twin", "keepers", "light", "abandoned", "beacon", "wait", "whoever", "answers"]


def named(*names, **fields):
    return [{"id": k, "name": n, **fields} for k, n in enumerate(names, 50)]


def raw(i=1, **changes):
    """A whole record; changes replace its fields."""
    billed = [c | {"order": k} for k, c in enumerate(named("Ines Okafor", "Ravi Lindqvist"))]
    record = {"id": i, "title": "Harbour Lights", "original_title": "Harbour Lights", "overview": OVERVIEW, "release_date": "2011-02-23", "original_language": "pt", "adult": False}
    record |= {"genres": named("Mystery"), "keywords": named("lighthouse"), "cast": billed, "crew": named("Oona Beltran", job="Director"), "belongs_to_collection": None}
    return record | {"runtime": 97, "popularity": 3.75, "vote_average": 6.5, "vote_count": 88} | changes


def records(spark, tmp_path, lines):
    path = tmp_path / "raw.jsonl"
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return jsonl.typed(jsonl.parsed(jsonl.raw_lines(spark, str(path))))


def build(spark, tmp_path, *lines, config=None):
    rows = features.first_of_each_id(records(spark, tmp_path, lines))
    return {r.id: r for r in features.feature_records(rows, config or Config()).collect()}


def test_lines_errors_and_report(spark, tmp_path):
    lines = [raw(1), "", "{broken", "[1, 2]", raw("2"), raw(True), raw(2.5), raw(1, title="later"), raw(None), "   ", raw(" -7 ")]
    rows = records(spark, tmp_path, lines)
    got = {r.line_no: (r.error, r.id) for r in rows.collect()}
    assert got == {1: (None, 1), 3: ("json_decode_error", None), 4: ("record_is_not_an_object", None), 5: (None, 2), 6: (None, None), 7: (None, None), 8: (None, 1), 9: (None, None), 11: (None, -7)}
    assert features.load_report(rows).first().asDict() == {"lines_total": 9, "records_parsed": 7, "malformed": 2, "invalid_id": 3, "duplicate_id": 1, "kept": 3}
    first = features.first_of_each_id(rows).where("id = 1").first()
    assert first.title == "Harbour Lights"


def test_empty_file(spark, tmp_path):
    rows = records(spark, tmp_path, [""])
    assert rows.count() == 0 and features.load_report(rows).first().kept == 0


def test_line_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("".join(f"{k}\n" for k in range(1, 20_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = jsonl.raw_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 4
        assert lines.where("line_no <> cast(value as long)").count() == 0 and lines.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_blocks(spark, tmp_path):
    cast = [{"name": "Zoe Last", "order": 9}, {"name": "T.I.", "order": 0}, {"name": "Ann First", "order": 1}, {"name": "No Order"}, "skip me", {"name": "Ann First", "order": 2}, {"name": "F Sixth", "order": 7}]
    crew = [{"name": "B Two", "job": "Director"}, {"name": "A One", "job": "Director"}, {"name": "Writer", "job": "Writer"}]
    keywords = [{"name": "Post-apocalyptic  future"}, {"name": "duringcreditsstinger"}, {"name": "post apocalyptic future"}, {"name": "x"}, {"name": "After credits Stinger"}, 5]
    row = build(spark, tmp_path, raw(1, cast=cast, crew=crew, keywords=keywords, genres={"name": "Science Fiction"}))[1]
    assert row.tokens.keywords == ["post_apocalyptic_future"] and row.stinger_keywords_removed == ["after credits stinger", "duringcreditsstinger"]
    assert row.tokens.genres == ["science_fiction"]
    assert row.tokens.cast == ["ann", "first", "no", "order", "sixth"] and row.tokens.director == ["one", "two"]
    assert row.tokens.overview == WORDS
    assert row.document[0] == "ov:drowned" and row.document[-1] == "dir:two" and row.document_size == len(row.document)


@pytest.mark.parametrize(("overview", "n"), [("x" * 39, 0), ("word " * 8, 0), ("word " * 8 + "abcd", 9), (None, 0), (12345, 0), ("   ", 0)])
def test_overview_floor(spark, tmp_path, overview, n):
    assert len(build(spark, tmp_path, raw(1, overview=overview))[1].tokens.overview) == n


def test_fields_of_the_wrong_type(spark, tmp_path):
    odd = raw(1, title=5, release_date=2011, runtime=0, popularity=True, vote_count="3", adult="yes", genres=None, keywords=None, cast=None, crew=None, belongs_to_collection={"name": "  "}, original_language=None)
    row = build(spark, tmp_path, odd)[1]
    assert (row.title, row.release_date, row.release_year, row.runtime_minutes, row.popularity, row.vote_count, row.adult, row.collection_name) == (None, None, None, None, None, None, False, None)
    assert row.tokens.genres == row.tokens.keywords == row.tokens.cast == row.tokens.director == []
    bare = build(spark, tmp_path, {"id": 3})[3]
    assert bare.document == [] and bare.document_size == 0


def test_values_out_of_range_and_odd_white_space(spark, tmp_path):
    """Numbers beyond a field's range are null and stop nothing; ids and names lose white space of every script; U+0000 in a label separates words."""
    huge, wide = 1 << 40, 10**30
    lines = [
        raw(1, runtime=huge, vote_count=wide, cast=[{"name": "Late Comer", "order": huge}, {"name": "Second", "order": wide}, {"name": "Third", "order": 1}]), raw("\t12\n"), raw("\u00a0-13\u3000"), raw(wide), raw("9" * 30), raw("+14"),
        raw(15, keywords=named("ab\u0000cd", "during\u0000creditsstinger"), genres=named("Sci\u0000Fi", "War"), crew=named("Jo\u0000Day", "Al", job="Director"), belongs_to_collection={"name": "\u2003Sa ga\u00a0"}),
    ]
    rows = records(spark, tmp_path, lines)
    assert [r.id for r in rows.orderBy("line_no").collect()] == [1, 12, -13, None, None, None, 15]
    found = build(spark, tmp_path, *lines)
    assert found[1].runtime_minutes is None and found[1].tokens.cast == ["late", "comer", "second", "third"]
    odd = found[15]
    assert odd.tokens.keywords == ["ab_cd"] and odd.stinger_keywords_removed == ["during creditsstinger"] and odd.tokens.genres == ["sci_fi", "war"] and odd.tokens.director == ["al", "jo", "day"] and odd.collection_name == "Sa ga"


def test_usable_files(spark, tmp_path):
    found = features.feature_records(records(spark, tmp_path, [raw(1), raw(2)]), Config())
    jsonl.export_jsonl(found, str(tmp_path / "good"))
    n, digest = jsonl.validate_files(spark, str(tmp_path / "good"), 100)
    assert n == 2 and len(digest) == 64 and jsonl.validate_files(spark, str(tmp_path / "good"), 100)[1] == digest
    line = json.dumps({"id": 1, "title": "t", "tokens": {}})
    for name, text, why in (("small", line, "bytes"), ("page", "<html>" * 30, "json_decode"), ("array", "[1]\n" * 60, "object"), ("blank", "\n" * 200, "no records"), ("partial", (line + "\n") * 9 + json.dumps({"id": 2, "tokens": {}}) + " " * 80, "misses title")):
        (tmp_path / f"{name}.jsonl").write_text(text)
        with pytest.raises(jsonl.UnusableCorpus, match=why):
            jsonl.validate_files(spark, str(tmp_path / f"{name}.jsonl"), 100)
    usable = lambda df: jsonl.validate_corpus(df).first().usable
    assert usable(found) and not usable(found.withColumn("title", F.lit(None).cast("string"))) and not usable(found.limit(0))


def test_round_trip_export_and_stream(spark, tmp_path):
    rows = records(spark, tmp_path, [raw(1), raw(2, title="Ünï")])
    found = features.feature_records(rows, Config())
    want = sorted(map(str, found.collect()))
    jsonl.export_jsonl(found, str(tmp_path / "out"))
    again = jsonl.read_corpus(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.select(found.columns).collect())) == want
    jsonl.write_corpus(found, str(tmp_path / "table"))
    assert jsonl.validate_corpus(spark.read.parquet(str(tmp_path / "table"))).first().usable
    assert jsonl.content_digest(spark, str(tmp_path / "raw.jsonl")).first().digest
    (tmp_path / "in").mkdir()
    (tmp_path / "raw.jsonl").rename(tmp_path / "in/raw.jsonl")
    write_features(stream_features(spark, str(tmp_path / "in"), Config()), str(tmp_path / "streamed"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "streamed")).collect())) == want


def test_statistics_of_no_rows(spark, tmp_path):
    none = features.feature_records(records(spark, tmp_path, [raw(1)]).limit(0), Config())
    assert features.token_statistics(none).count() == 0


def test_sample_keeps_quotas(spark):
    rows = spark.range(1_000).withColumn("stratum", F.when(F.col("id") < 5, "small").when(F.col("id") < 400, "mid").otherwise("large"))
    got = features.stratified_sample(rows, "stratum", "id", 90, 1).collect()
    sizes = {s: sum(r.stratum == s for r in got) for s in ("small", "mid", "large")}
    assert len({r.id for r in got}) == len(got) == 90 and sizes["small"] == 5 and sizes["mid"] >= 30 and sizes["large"] >= 30
    assert {r.id for r in features.stratified_sample(rows.repartition(7), "stratum", "id", 90, 1).collect()} == {r.id for r in got}


def test_projection(spark, tmp_path):
    crew = [{"name": "D", "job": "Director"}, {"name": "P", "job": "Producer"}, {"name": "S", "job": "Story"}]
    row = features.project_record(records(spark, tmp_path, [raw(1, crew=crew), raw("x")]), 1).collect()
    assert len(row) == 1 and [c.name for c in row[0].crew] == ["D", "S"] and len(row[0].cast) == 1


@pytest.mark.parametrize("values", [[], [5], [1, 2, 3], [1, 2, 3, 4, 10], list(range(1, 101)), [3, 3, 3, 3, 9, 9]])
def test_describe_equals_the_statistics_module(spark, values):
    import statistics

    got = audit.describe(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), "v").first()
    assert got.n == len(values)
    if values:
        q = statistics.quantiles(values, n=4) if len(values) > 1 else [0, 0, 0]
        want = (min(values), q[0] if len(values) > 3 else None, statistics.median(values), statistics.fmean(values), q[2] if len(values) > 3 else None, statistics.quantiles(values, n=20)[18] if len(values) > 19 else None, max(values))
        for g, w in zip(tuple(got)[1:], want, strict=True):
            assert (g is None) == (w is None) and (w is None or abs(g - w) <= 0.0051)


def test_audit_counts(spark, tmp_path):
    lines = [raw(1), raw(2, title=" ", overview="N/A", cast=[], keywords=[{"name": " "}]), raw(2, title="Harbour lights (2001)", release_date="soon"), raw(4, title="untitled", overview="", crew=[], release_date=""), raw(5, title="12.5", overview="short")]
    rows = records(spark, tmp_path, lines)
    assert {r["item"]: r.n for r in audit.missing_counts(rows).collect()} == {"title": 1, "overview_blank": 1, "genres": 0, "keywords": 1, "cast": 1, "release_date_blank": 1, "release_date_malformed": 1, "director": 1}
    assert audit.id_integrity(rows).first().asDict() == {"rows": 5, "null_ids": 0, "duplicated_ids": 1, "redundant_rows": 1}
    assert audit.text_quality(rows).first().asDict() == {"placeholders": 1, "stubs": 1, "prose": 2, "junk_titles": 1, "numeric_titles": 1}
    assert audit.usability(rows).first().asDict() == {"full_tier": 1, "core_tier": 2, "minimal_tier": 4}
    assert {r.grouping: (r.groups, r.redundant) for r in audit.duplicate_titles(rows).collect()} == {"exact": (0, 0), "normalised": (1, 1), "normalised_year": (0, 0)}
    assert audit.cast_order(rows).first().asDict() == {"credited": 4, "ordered": 4, "ascending": 4}
