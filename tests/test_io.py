"""Readers and writers on small files written by the tests themselves."""

import pytest
from pyspark.sql import functions as F

from cohortlab.sources import io


def test_delimited_with_bom_and_dates(spark, tmp_path):
    p = tmp_path / "cohort.csv"
    p.write_bytes("﻿patid,pracid,dob,code\n7,3,01/02/1950,G309\n8,4,29/02/1952,G20\n".encode("utf-8"))
    df = io.read_delimited(spark, str(p), sep=",")
    assert df.columns[0] == "patid"
    from cohortlab.functions.dates import parse_date
    got = [r.d for r in df.select(parse_date("dob").alias("d")).orderBy("patid").collect()]
    assert str(got[0]) == "1950-02-01" and str(got[1]) == "1952-02-29"


def test_code_list_and_dosage(spark, tmp_path):
    c = tmp_path / "codes.csv"
    c.write_text("name,code\nx, A1 \ny,B2\nz,A1\nw,\n")
    assert sorted(r.code for r in io.read_code_list(spark, str(c), "code").collect()) == ["A1", "B2"]
    d = tmp_path / "geno.raw"
    d.write_text("FID IID rs1_C rs2_T\n11 11 0 2\n12 12 NA 1\n")
    long = {(r.patid, r.snp): r.dosage for r in io.read_dosage(spark, str(d)).collect()}
    assert long == {("11", "rs1_C"): 0.0, ("11", "rs2_T"): 2.0, ("12", "rs1_C"): None, ("12", "rs2_T"): 1.0}


def test_scores_drop_non_numeric_trait(spark, tmp_path):
    p = tmp_path / "prs.csv"
    p.write_text("patid,t1,t2,note\n1,0.5,abc,x\n2,,1.5,y\n")
    got = io.read_scores(spark, str(p), ["t1", "t2"]).collect()
    assert {r.trait for r in got} == {"t1"}
    assert {(r.patid, r.score) for r in got} == {("1", 0.5), ("2", None)}


def test_sequences_csv(spark, tmp_path):
    p = tmp_path / "seq.csv"
    p.write_text('patid,label,code,year,age\n5,1,"[\'ICD10_A\', \'SEP\']","[1990, 1990]","[300, 300]"\n')
    r = io.read_sequences_csv(spark, str(p)).first()
    assert r.code == ["ICD10_A", "SEP"] and r.year == [1990, 1990] and r.age == [300, 300]


def test_write_once_and_embeddings(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.0])], "id long, features array<double>")
    path = str(tmp_path / "emb")
    io.write_once(df, path)
    io.write_once(spark.createDataFrame([(2, [9.0, 9.0])], "id long, features array<double>"), path)
    assert [r.id for r in io.read_embeddings(spark, path).collect()] == [1]
    with pytest.raises(FileNotFoundError):
        io.read_embeddings(spark, str(tmp_path / "missing"))


def test_write_labels_and_csv(spark, tmp_path):
    lab = spark.createDataFrame([(1, 0), (2, 1)], "id long, label int")
    io.write_labels(lab, str(tmp_path / "labels"), k=2)
    back = spark.read.parquet(str(tmp_path / "labels"))
    assert back.where(F.col("k") == 2).count() == 2
    io.write_csv(lab, str(tmp_path / "rep"), single_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "rep")).count() == 2


def test_reuse_or_build(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")

    path = str(tmp_path / "inter")
    assert io.reuse_or_build(spark, path, build).count() == 2
    assert io.reuse_or_build(spark, path, build).count() == 2
    assert len(calls) == 1
