"""Staged tables, line parsers, code systems, encoding, ranking loss, SVD and the models table."""
import os
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.functions.codes import CASE_DEFINITIONS, SYMPTOM_SYSTEMS
from cohortlab.operators import codes as CD
from cohortlab.operators import features as FE
from cohortlab.operators import metrics as M
from cohortlab.operators import model_selection as MS
from cohortlab.operators import outcomes as O
from cohortlab.operators import profile as PR
from cohortlab.operators import sequences as SQ
from cohortlab.plans import materialize as MT
from cohortlab.plans import study as S
from cohortlab.sources import io


# -- staged tables ------------------------------------------------------------------------------

def folder_with(tmp_path, spark, rows):
    spark.createDataFrame(rows, "patid long, v int").write.mode("overwrite").parquet(str(tmp_path / "in" / "t.parquet"))
    return str(tmp_path / "in")


def test_stage_is_reused_rebuilt_on_change_and_removed(spark, tmp_path):
    built = []

    def stage(folder):
        def build():
            built.append(1)
            return spark.read.parquet(f"{folder}/t.parquet")
        return MT.materialized(spark, ("probe", folder, 3), build, "patid")

    folder = folder_with(tmp_path, spark, [(i, i) for i in range(20)])
    assert stage(folder).count() == 20 and stage(folder).count() == 20 and len(built) == 1
    app = spark.sparkContext.applicationId
    _, table, path = MT._STAGES[app, "probe", folder, 3]
    folder_with(tmp_path, spark, [(i, i) for i in range(30)])
    assert stage(folder).count() == 30 and len(built) == 2
    assert not os.path.exists(path.removeprefix("file:")) and not spark.catalog.tableExists(table)
    _, table, path = MT._STAGES[app, "probe", folder, 3]
    MT.remove_stage(spark, table, path)
    del MT._STAGES[app, "probe", folder, 3]
    assert not os.path.exists(path.removeprefix("file:"))


def test_bucketed_stages_join_without_a_shuffle_and_read_few_columns(spark, tmp_path):
    folder = folder_with(tmp_path, spark, [(i, i) for i in range(50)])
    wide = spark.read.parquet(f"{folder}/t.parquet").withColumn("unused", F.lit("x" * 10))
    a = MT.materialized(spark, ("left", folder), lambda: wide, "patid")
    b = MT.materialized(spark, ("right", folder), lambda: wide, "patid")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.select("patid", "v").join(b.select("patid", F.col("v").alias("w")), "patid").groupBy("patid").agg(F.sum("w"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "unused" not in plan and joined.count() == 50


def test_survival_reads_three_columns_of_its_stage(spark, sf_small):
    plan = S.survival_by_cluster(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event:int,time:int,label:int>" in plan.replace("struct<time:int,event:int,label:int>",
                                                                             "struct<event:int,time:int,label:int>"), plan


# -- lines of text --------------------------------------------------------------------------------

def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_broken_lines_are_kept_apart(spark):
    x = lines(spark, "﻿id\tday\tn", "1\t02/01/2020\t5", "2\t31/02/2020\t5", "3\t02/01/2020", "4\t02/01/2020\t5\t6", "", "5\t\t", "id\tday\tn")
    rows = io.parse_delimited(x, "id int, day date, n int", header="id\tday\tn", date_format="dd/MM/yyyy")
    assert sorted(map(tuple, io.accepted(rows).collect())) == [(1, date(2020, 1, 2), 5), (5, None, None)]
    assert sorted(r.line for r in io.quarantined(rows).collect()) == ["2\t31/02/2020\t5", "3\t02/01/2020", "4\t02/01/2020\t5\t6"]
    assert io.quarantined(rows).count() + io.accepted(rows).count() == 5


def test_code_list_lines(spark):
    x = lines(spark, "name,code", '"a, b", A1 ', "c,A1", "d,", "e", "f,B2")
    assert sorted(r.code for r in io.parse_code_list(x, "name,code", "code").collect()) == ["A1", "B2"]


def test_scores_run_nothing_while_planned(spark):
    x = lines(spark, "p,t1,t2,t3", "1,0.5,abc,", "2,,1.5,1e3", "3,-2,7")
    got = io.parse_scores(x, "p,t1,t2,t3", ["t1", "t2", "t3"], "p")
    assert sorted((r.patid, r.trait, r.score) for r in got.collect() if r.score is not None) == [("1", "t1", 0.5), ("2", "t3", 1000.0)]
    assert {r.trait for r in got.collect()} == {"t1", "t3"}


def test_sequence_lines(spark):
    good = "5,\"['A', 'SEP']\",\"[1990, 1990]\",\"[300, 300]\""
    x = lines(spark, "patid,code,year,age", good, "6,\"['A'\",\"[1]\",\"[2]\"", "7,\"['A']\",\"[1, 2]\",\"[2]\"", "8,\"[]\",\"[]\",\"[]\"", "9,x")
    rows = io.parse_sequences(x, "patid,code,year,age")
    assert [(r.patid, r.code, r.age) for r in io.accepted(rows).orderBy("patid").collect()] == [("5", ["A", "SEP"], [300, 300]), ("8", [], [])]
    assert io.quarantined(rows).count() == 3


# -- codes ------------------------------------------------------------------------------------------

def test_longest_prefix_by_priority(spark):
    systems = spark.createDataFrame([("a", "G", 1, "chapter"), ("a", "G3", 1, "block"), ("b", "G30", 2, "other"), ("b", "X", 2, "x"),
                                     ("c", "Y", 1, "second"), ("b", "Y", 1, "first")], "system string, prefix string, priority int, description string")
    codes = spark.createDataFrame([("G301",), ("G40",), ("X1",), ("Z",), (None,), ("",), ("G301",), ("Y2",)], "code string")
    got = {r.code: (r.description, r.system) for r in CD.longest_prefix(codes, systems).collect()}
    assert got == {"G301": ("block", "a"), "G40": ("chapter", "a"), "X1": ("x", "b"), "Y2": ("first", "b")}


def test_named_definitions(spark):
    dictionary = spark.createDataFrame([("m1", "R1", "S1"), ("m2", "R2", "S2")], "medcode string, readcode string, Snomedcode string")
    listed = spark.createDataFrame([("read", "AD", "R1"), ("snomed", "AD", "S2"), ("snomed", "PARM", "S2"), ("read", "PD", "R1"),
                                    ("read", "fall", "R2"), ("snomed", "mci", "S1"), ("read", "mci", "R2")], "system string, name string, code string")
    own = {n: {r.code for r in CD.named_case_codes(listed, dictionary, n).collect()} for n in CASE_DEFINITIONS}
    assert own["PD"] == {"G20", "G200"} and "m1" in own["AD"] and "m2" not in own["AD"] and own["PARM"] >= {"m2", "G903"}
    with pytest.raises(ValueError):
        CD.named_case_codes(listed, dictionary, "XX")
    assert {tuple(r) for r in CD.named_symptom_codes(listed, dictionary).collect()} == {("fall", "m2"), ("mci", "m1")}
    assert len(SYMPTOM_SYSTEMS) == 9


def test_relabel_joins_the_map(spark):
    df = spark.createDataFrame([(i, i % 3, int(i % 3 == 0)) for i in range(12)], "id long, label int, event int")
    got = O.relabel_by_outcome(df, df.withColumn("label", F.lit(7)))
    assert {(r.id % 3, r.label) for r in got[0].collect()} == {(0, 3), (1, 1), (2, 2)}
    assert got[0].columns == df.columns and {r.label for r in got[1].collect()} == {None}


def test_report_order(spark, tmp_path):
    """O3: most frequent first, ties by value; O1: written ranges are sorted and do not overlap."""
    df = spark.createDataFrame([(v,) for v in "bbacccaad"], "v string")
    assert [tuple(r)[:2] for r in PR.value_counts(df, "v").collect()] == [("a", 3), ("c", 3), ("b", 2), ("d", 1)]
    path = str(tmp_path / "sorted")
    io.write_once(spark.range(200).select(((F.col("id") * 37) % 200).alias("patid")).repartition(5), path, sort_by=["patid"])
    parts = sorted((tmp_path / "sorted").glob("part-*"))
    values = [[r.patid for r in spark.read.parquet(str(p)).collect()] for p in parts]
    assert all(v == sorted(v) for v in values)
    spans = sorted((v[0], v[-1]) for v in values if v)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and sum(map(len, values)) == 200


# -- encoding, ranking loss -------------------------------------------------------------------------

def test_encoding_by_broadcast_and_by_join(spark):
    rows = [(1, ["a", "SEP", "b", "zz"]), (2, []), (3, ["SEP"] * 9), (4, [None, "a"]), (5, ["c"] * 30), (6, ["PAD", "MASK"])]
    seq = spark.createDataFrame([(p, c, [1] * len(c), [2] * len(c)) for p, c in rows], "patid long, code array<string>, year array<int>, age array<int>")
    vocab = SQ.vocabulary(spark.createDataFrame([("a",), ("b",), ("c",)], "code string"))
    whole, joined = (sorted(map(tuple, SQ.vocab_encode(seq, vocab, 8, n).collect())) for n in (100, 2))
    assert whole == joined and [r[0] for r in whole] == [1, 3, 4, 5, 6]
    assert whole[0][1] == [3, 5, 2, 6, 1, 0, 0, 0] and whole[0][2] == [1, 1, 1, 1, 1, 0, 0, 0]
    assert whole[2][1][:3] == [3, 1, 5] and whole[3][1] == [3] + [7] * 7


def test_ranking_loss_in_tiles(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 3 if i < 50 else 9, i, [float(v) for v in rng.normal(0, 2, 4)], [float(v) for v in rng.normal(0, 2, 4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "batch int, pos int, a array<double>, b array<double>")
    rank = []
    for batch in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == batch]
        s = 20.0 * np.array([r[2] for r in own]) @ np.array([r[3] for r in own]).T
        for m in (s, s.T):
            high = m.max(axis=1)
            rank.append(high + np.log(np.exp(m - high[:, None]).sum(axis=1)) - np.diag(m))
    want = (np.concatenate(rank[0::2]).mean() + np.concatenate(rank[1::2]).mean()) / 2
    for tile_rows in (2048, 7):
        assert M.pair_ranking_loss(df, tile_rows=tile_rows).first().loss == pytest.approx(want, rel=1e-12)


# -- SVD ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("sent, kept", [(1 << 22, 1 << 23), (1 << 22, 0), (0, 0)], ids=["driver", "broadcast", "joined"])
def test_svd_converges(spark, monkeypatch, sent, kept):
    monkeypatch.setattr(FE, "MAX_BROADCAST_NUMBERS", sent)
    monkeypatch.setattr(FE, "MAX_DRIVER_NUMBERS", kept)
    monkeypatch.setattr(FE, "BLOCKS", 3)              # so that the space shrinks at least once
    rng = np.random.default_rng(0)
    rows = [(d, i * 3, float(rng.random())) for d in range(60) for i in range(30) if rng.random() < 0.3 or i == 0]
    x = np.zeros((60, 90))
    for d, i, v in rows:
        x[d, i] = v
    loads, sv = FE.svd_loadings(spark.createDataFrame(rows, "doc int, idx long, value double"), 90, 4, oversample=4)
    v = np.zeros((90, 4))
    for r in loads.collect():
        v[r.idx, r.comp] = r.v
    s2 = np.array(sv) ** 2
    assert sv == pytest.approx(np.linalg.svd(x, compute_uv=False)[:4], rel=1e-9)
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-9)
    assert (np.linalg.norm(x.T @ x @ v - v * s2, axis=0) < 1e-6 * s2).all()


def test_svd_of_few_terms_and_of_nothing(spark):
    x = spark.createDataFrame([(0, 1, 2.0), (1, 1, 0.0)], "doc int, idx long, value double")
    loads, sv = FE.svd_loadings(x, 5, 3)
    assert sv == pytest.approx([2.0]) and [(r.idx, abs(r.v)) for r in loads.collect()] == [(1, pytest.approx(1.0))]
    assert FE.svd_loadings(x.limit(0), 5, 3)[1] == []


# -- models table -----------------------------------------------------------------------------------------

def test_selection_reads_one_models_table(spark):
    """Three far groups in both sets: K = 3 wins every metric; replicates that were not fitted leave nulls."""
    def group(n, shift):
        return spark.createDataFrame([(i, [10.0 * (i % 3) + 0.1 * (i % 7) + shift, float(i % 2)]) for i in range(n)], "id long, features array<double>")
    sets = {"a": group(60, 0.0), "b": group(45, 0.2)}
    models = MS.fit_models(sets, [2, 3], consensus_reps=2, bootstrap_reps=2, gap_sets=2, restarts=2, max_iter=10).checkpoint()
    assert models.count() == 2 * 2 * (1 + 2 + 2 + 1 + 2)
    table = {r.k: r for r in MS.selection_table(sets, models, "a").collect()}
    assert set(table) == {2, 3} and table[3].silhouette > table[2].silhouette
    cost = {(r.purpose, r.k, r.rep): np.log(r.cost) for r in models.where("dataset = 'a'").collect() if r.purpose.startswith("gap")}
    for k in (2, 3):
        logs = [cost["gap_reference", k, b] for b in range(2)]
        assert table[k].gap == pytest.approx(np.mean(logs) - cost["gap_observed", k, 0])
        assert table[k].gap_se == pytest.approx(np.std(logs, ddof=1) * np.sqrt(1.5))
    assert table[3].consensus_pac == 0.0 and table[3].bootstrap_ari_mean == pytest.approx(1.0)
    assert table[3].cross_source_ari_b == pytest.approx(1.0) and all(v is not None for v in table[2])
    report = {r.dataset: r for r in MS.validation_table(sets, models.where("purpose <> 'subsample'"), 3, "a", squared=True).collect()}
    assert report["a"].cross_source_ari is None and report["b"].cross_source_ari == pytest.approx(1.0)
    assert report["a"].consensus_pac is None and report["b"].bootstrap_ari_sd == pytest.approx(0.0)
