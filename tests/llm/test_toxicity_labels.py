"""The toxicity model where labels and documents don't meet."""

import zlib

import pytest

import corpus_pipeline as cp
from angula.llm import toxicity

DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"
KEPT = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]


def text_of(i, toxic):
    return f"{'you filthy wretch ' * 3 if toxic else 'a calm and sunny day '} number {i} of the many"


@pytest.mark.parametrize("kind", ["empty table", "no row is labelled", "one class", "ids that documents lack"])
def test_labels_of_both_classes_without_rows_of_both(spark, tmp_path, kind):
    labels = [(i, 1, k % 2) for k, i in enumerate(KEPT[:80])]
    ids = {"empty table": [], "no row is labelled": KEPT[100:140], "one class": KEPT[0:80:2], "ids that documents lack": KEPT[:80]}[kind]
    docs = spark.createDataFrame([(i, text_of(i, i in KEPT[1:80:2]), "en", "a", 1) for i in ids], DOCS)
    if kind == "ids that documents lack":  # 2,000 labels of class 0 more, of which docs has none: the same model
        labels_more = labels + [(10**6 + i, 1, 0) for i in range(2000)]
        want = {r.doc_id: r.score for r in toxicity.scores(docs, spark.createDataFrame(labels, LABELS)).collect()}
        got = {r.doc_id: r.score for r in toxicity.scores(docs, spark.createDataFrame(labels_more, LABELS)).collect()}
        assert got == want and max(got.values()) > 0.5 > min(got.values())
        return
    d = spark.createDataFrame(labels, LABELS)
    got = toxicity.scores(docs, d).collect()
    assert len(got) == len(ids) and all(r.predicted == 0 for r in got) and len({r.score for r in got}) <= 1
    d.write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.drop_toxic(spark, docs, str(tmp_path)).count() == len(ids)
