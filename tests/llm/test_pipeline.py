"""The pipeline on a small corpus, stage by stage, against plain versions; and the entry with and without the corpus operators."""

import random

import corpus_pipeline
from tessella.llm import pii
from tessella.llm.toxicity import Features, train

from .test_neardup import by_rows
from .test_text_operators import corpus, encoding, plain_contamination


def tables(spark, path):
    docs, labels = corpus(300)
    r = random.Random(3)
    item = " ".join(r.choice(("alpha", "beta", "gamma", "delta")) + str(k) for k in range(30))
    docs += [(400, docs[0][1]), (401, docs[1][1] + " tail"), (402, "before " + item + " after"), (403, "write to jo.doe@ex.org or 10.0.0.1 now"), (404, None), (405, ""), (None, "a row without an id"), (7, "a second text under the id of another row"), (8, docs[0][1]), (9, docs[9][1])]
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, item


def test_stages(spark, tmp_path):
    docs, item = tables(spark, str(tmp_path))
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = table.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "bpe"]

    model = train(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    weights, features = model.dense(), Features()
    kept = [d for d in docs if model.scores(weights, features, [(d[1] or "").encode()])[0] < 0.7]
    kept = by_rows(kept)
    assert [t for i, t in kept if i == 7 and t.startswith("a second text")] and len([i for i, _ in kept if i == 9]) <= 1
    bad = {i for i, *_, c in plain_contamination(kept, [(1, item)]) if c}
    assert bad == {402}
    kept = [d for d in kept if d[0] not in bad]
    clean = sorted(((i, t if t is None else pii.redact(t, pii.model()(t)[1])) for i, t in kept), key=repr)

    at = table
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        at = spark.read.parquet(f"{tmp_path}/stage{k}")
        if name != "bpe":
            assert at.columns == columns
        if name == "pii":
            assert sorted(((r.doc_id, r.text) for r in at.collect()), key=repr) == clean
            assert dict(clean)[403] == "write to [EMAIL] or [IP] now"
            assert at.where("n_chars <> length(text)").count() == 0
    want = sorted(((i, len(encoding().encode_ordinary(t or ""))) for i, t in clean), key=repr)
    assert sorted(((r.doc_id, r.n_tokens) for r in at.collect()), key=repr) == want
    assert sorted(((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == want


def test_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path / "full"))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
