"""Learnt operators on documents they were not trained on; empty tables."""
from pyspark.sql import functions as F

from cohortlab.llm import decontamination, mixing, near_duplicates, quality_classifier, toxicity
from cohortlab.llm._tables import documents, labels, prepare

SF, SF01 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_toxicity_on_held_out_labels(spark):
    """Trained on the labels of one half of the ids, judged on the other half."""
    prepare(spark)
    marks = labels(spark, SF01).filter("toxic IS NOT NULL")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    scored = toxicity.score_documents(documents(spark, SF01), marks.filter(half)).select("doc_id", "rejected")
    rows = scored.join(marks.filter(~half), "doc_id").collect()
    both = sum(r.rejected and r.toxic == 1 for r in rows)
    f1 = 2 * both / max(1, sum(r.rejected for r in rows) + sum(r.toxic == 1 for r in rows))
    print("toxicity: held-out F1", round(f1, 3), "of", len(rows))
    assert len(rows) > 50 and f1 >= 0.8


def test_quality_on_held_out_labels(spark):
    prepare(spark)
    rows = (quality_classifier.score_quality(documents(spark, SF), labels(spark, SF)).filter("held_out")
            .join(labels(spark, SF).filter("quality IS NOT NULL"), "doc_id").collect())
    good, bad = [[r.score for r in rows if r.quality == q] for q in (1, 0)]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    print("quality: held-out AUC", round(auc, 4), "accuracy", round(right, 3), "of", len(rows))
    assert auc >= 0.95 and right >= 0.9


def test_no_documents(spark, make_docs):
    prepare(spark)
    none, marks = make_docs([]), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    for got in (mixing.words_taken(none), toxicity.score_documents(none, marks), near_duplicates.near_duplicates(none),
                near_duplicates.one_per_class(none), decontamination.find_leaks(none, bench), quality_classifier.score_quality(none, marks)):
        assert got.count() == 0
