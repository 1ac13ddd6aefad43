"""The pipeline's stages on small tables against what each should do."""

from threading import Thread

import corpus_pipeline as P
from corvane.llm import secrets
from corvane.llm.shared import Scratch, materialize
from tests.conftest import SMALL
from tests.llm.test_operators import brute_kept, check_packing


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before.toPandas(), docs.toPandas())
        assert name == P.STAGES[-1][0] or docs.columns == columns
    before, after = seen["language_id"]
    assert sorted(before.doc_id) == sorted(after.doc_id)
    before, after = seen["near_dedup"]
    assert sorted(brute_kept(list(zip(before.doc_id, before.text, strict=True)))) == sorted(after.doc_id)
    before, after = seen["secret_scan"]
    assert sorted(before.doc_id) == sorted(after.doc_id) and not any(secrets.base_spans(t) for t in after.text)
    clean = {i: t for i, t in zip(before.doc_id, before.text, strict=True) if not secrets.scan(t)[0]}
    assert clean == {i: t for i, t in zip(after.doc_id, after.text, strict=True) if i in clean}
    before, after = seen["source_mixing"]
    assert set(after.doc_id) <= set(before.doc_id)
    before, after = seen["best_fit_packing"]
    check_packing(after.to_dict("records"), 4096)
    assert (after.piece == 0).sum() == len(before)


def test_language_id_keeps_columns_of_its_own_names(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", "doc_id * 2 as score", "'mine' as lang_pred", "doc_id as REJECTED", "1 as guess")
    kept = P.language_id(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert kept.where("score <> doc_id * 2 or lang_pred <> 'mine' or REJECTED <> doc_id or guess <> 1").count() == 0 < kept.count()


def test_language_id_without_labels_or_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert P.language_id(spark, docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars"), SMALL).count() == docs.count()
    assert P.language_id(spark, docs.limit(0), SMALL).count() == 0


def test_scratches_of_threads_are_their_own(spark):
    made = []
    with Scratch(spark):
        inner = materialize(spark.range(3), "own")
        other = Thread(target=lambda: made.append(materialize(spark.range(5), "other")))
        other.start()
        other.join()
        assert inner.count() == 3
    assert made[0].count() == 5
