"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import decontam, licenses, lm, nndescent, packing, pii, secrets, simhash, tokenfile, toxicity
from leadloom.llm.common import shared_path
from leadloom.llm.encoder import vocabulary_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, n_words bigint, score double, fp string, spans string"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
TEXTS = [None, "", " \n\t ", "a", "Mail a.b@c.de or +1 (555) 123-4567 now", "token = 'abcdefgh12345678'", LONG, "é ß <|endoftext|> 日本", "same text here", "same text here"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 0.5, "y", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*enumerate(TEXTS), (None, "same text here"), (None, None), (3, "a"), (4, "another text with the id 4")]
    return table(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (4, 1, 1), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, "same text here"), (None, "a"), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_text_operators_keep_every_row(spark, docs, none, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    made = {
        "matches": lambda d: decontam.find_matches(d, bench),
        "licenses": licenses.find_licenses,
        "fps": simhash.near_duplicates,
        "secrets": secrets.find_secrets,
        "pii": pii.find_personal_data,
        "toxicity": lambda d: toxicity.score_documents(d, ({}, toxicity.Law(1.0, 1.0, 1.0, 0.0))),
        "lm": lambda d: lm.score_documents(d, F.lit(True), vocabulary_path()),
    }
    for name, f in made.items():
        assert f(docs).count() == docs.count(), name
        assert f(none).count() == 0, name


def test_masked_rows_keep_their_columns(spark, docs, none):
    out = pii.sanitise(docs, size_col="n_chars")
    assert out.columns == docs.columns and out.count() == docs.count()
    got = out.filter("doc_id = 4 and text like 'Mail%'").first()
    assert got.text == "Mail [EMAIL] or [PHONE] now" and got.n_chars == len(got.text)
    assert out.filter("text is null").count() == 2
    assert pii.sanitise(none).count() == 0


def test_one_row_of_each_copy_stays(docs, none):
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert [r.doc_id for r in out.filter("text = 'same text here'").collect()] == [8]
    assert [r.doc_id for r in out.filter("trim(coalesce(text, '')) = ''").collect()] == [0]
    assert simhash.deduplicate(none).count() == 0


def test_short_items_and_null_ids(spark, docs, folder):
    found = decontam.find_matches(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    got = {(r._row.doc_id, r._row.text): (r.n_hit, r["items"]) for r in found.filter("n_hit > 0").collect()}
    assert got[8, "same text here"] == (3, ["1"]) and got[3, "a"] == (1, [])
    assert decontam.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet").limit(0)).count() == docs.count()


def test_blocks_of_the_benchmark_agree(spark, docs, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    key = lambda df: sorted((str(r._row.doc_id), str(r._row.text), r.n_words, r.n_hit, str(r["items"]), r.longest) for r in df.collect())
    assert key(decontam.find_matches(docs, bench)) == key(decontam.find_matches(docs, bench, block_bytes=4))


def test_packed_and_written_ids_cover_every_row(spark, docs, none):
    n = docs.count()
    pieces = packing.pack_documents(docs, vocabulary_path(), group_docs=4)
    assert pieces.filter("start = 0").count() == n and packing.pack_documents(none, vocabulary_path()).count() == 0
    for df, rows in ((docs, n), (none, 0)):
        path = shared_path(spark, "t")
        tokenfile.write_ids(df, path, vocabulary_path())
        back = tokenfile.read_ids(spark, path)
        assert back.count() == rows
        spans = sorted((r.start, r.n_tokens) for r in back.collect())
        assert [a for a, _ in spans] == [sum(k for _, k in spans[:j]) for j in range(rows)]


def test_stages_run_on_odd_rows_and_on_none(spark, docs, none, folder):
    for given in (docs, none):
        rows = given
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, folder)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == given.columns
            rows = out
        assert rows.select(F.count("*")).first()[0] >= 0


def test_odd_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.001], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [], 1), (11, [float("inf"), 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nndescent.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got[0] == (3, 0, True) and got[1] == (3, 0, False) and got[2] == (3, 0, False) and got[None] == (3, 0, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert nndescent.near_duplicates(spark.createDataFrame([], schema)).count() == 0
