"""The pipeline's stages on odd rows, and its result against the operators one by one."""

import corpus_pipeline
import numpy as np
from test_operators import brute_components
from tarnlake.llm import decontamination, language, minhash
from tarnlake.llm.words import table


def test_stages(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "near_duplicates":
            found = minhash.near_duplicates(before, percent=corpus_pipeline.PERCENT, bands=corpus_pipeline.BANDS)
            kept = {r[0] for r in found.filter("kept").select("doc_id").collect()}
            assert {r[0] for r in docs.select("doc_id").collect()} == kept
        if name == "decontamination":
            hit = decontamination.report(decontamination.hits(before, table(spark, folder, "benchmark"))).filter("contaminated")
            gone = {r[0] for r in hit.select("doc_id").collect()}
            assert {r[0] for r in before.select("doc_id").collect()} - gone == {r[0] for r in docs.select("doc_id").collect()}
    assert counts[0] == counts[1] > counts[2] > counts[3]
    assert counts[4] == counts[5] == corpus_pipeline.run(spark, folder).count()


def test_near_copies_of_080_go(spark, folder):
    """Families whose members are at 0.777 to 0.836 to their first one, and the tables' documents."""
    rows = []
    for family in range(40):
        base = [f"a{family}x{i}" for i in range(60)]
        rows.append((family * 10, " ".join(base)))
        for k in (5, 6, 7):
            rows.append((family * 10 + k, " ".join(base[:-k] + [f"b{family}y{k}z{i}" for i in range(k)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.unionByName(table(spark, folder, "documents").selectExpr("doc_id + 1000 AS doc_id", "text"))
    kept = {r[0] for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).select("doc_id").collect()}
    assert kept == {first for _, _, first in brute_components(docs, 80)}
    assert {i for i in kept if i < 400} == {f * 10 + k for f in range(40) for k in (0, 7)}


def test_stages_on_odd_rows(spark, odd, folder, items, tmp_path):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


def test_stages_on_no_rows(spark, empty, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_rejected_documents_have_no_letters(spark, odd, documents):
    model = language.train(documents)
    kept = {r["doc_id"] for r in language.accepted(odd, model).collect()}
    assert not kept & {4, 5, 6, 8} and {1, 2, 7, 10} <= kept


def test_texts_in_no_known_language_go(spark, documents):
    """Letter gibberish and scripts that the model was not trained on go; every document of the tables stays."""
    random = np.random.default_rng(3)
    gibberish = " ".join("".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(200))
    rows = [(-1, gibberish), (-2, gibberish[:90]), (-3, "日本語の文章をここに書きます。これは学習していない言語です。" * 3), (-4, "Это предложение на языке, которого модель не знает. " * 3)]
    model = language.train(documents)
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r["doc_id"] for r in language.accepted(docs, model).collect()}
    letters = {r["doc_id"] for r in documents.collect() if language.has_letter(r["text"] or "")}
    assert kept == letters
