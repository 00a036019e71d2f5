"""Answers of the training-data operators that were wrong once."""
import gzip

import pytest
from pyspark.sql import functions as F

from cohortlab.llm import license_scan, near_duplicates, personal_data, quality_rules, secrets, warc
from cohortlab.llm._tables import prepare

CLASHING = ("found", "spans", "weights", "row", "clean", "model", "_copy", "_id", "_doc", "_text", "class_key", "c", "kind")


def test_stages_keep_columns_of_any_name(spark, make_docs):
    prepare(spark)
    docs = make_docs([(1, "mail me at jo@example.com now", "en", "a"), (2, "nothing here at all", "en", "a"), (2, "nothing here at all", "en", "a"),
                      (3, None, None, None)])
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING if c not in docs.columns])
    docs = docs.withColumn("a.b", F.lit(1))
    for step, rows in ((personal_data.redact, 4), (near_duplicates.one_per_class, 3)):
        got = step(docs).collect()
        assert len(got) == rows and got[0].asDict().keys() == set(docs.columns)
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHING if c not in ("kind",))
    clean = {r.doc_id: r for r in personal_data.redact(docs).collect()}
    assert clean[1].text == "mail me at [EMAIL] now" and clean[1].n_chars == len(clean[1].text) and clean[3].text is None


def archive(records):
    return [("\r\n".join(["WARC/1.0", f"WARC-Type: {t}", f"WARC-Record-ID: <urn:x:{i}>", "X-Folded: one", "\ttwo",
                          f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n" for i, (t, body) in enumerate(records)]


@pytest.mark.parametrize("kind", ["members", "one member", "plain"])
def test_ordinary_archives(spark, tmp_path, kind):
    """Files that another tool wrote: no manifest, no lengths in the members."""
    records = archive([("warcinfo", b"software: x"), ("response", b"a" * 300_000), ("response", b"WARC/1.0\r\n\r\n")])
    data = {"members": b"".join(map(gzip.compress, records)), "one member": gzip.compress(b"".join(records)), "plain": b"".join(records)}[kind]
    name = tmp_path / ("x.warc" if kind == "plain" else "x.warc.gz")
    name.write_bytes(data)
    for path in (str(tmp_path), str(name)):
        rows = warc.read_archive(spark, path).filter("record_type = 'response'").orderBy("record_id").collect()
        assert [bytes(r.payload) for r in rows] == [b"a" * 300_000, b"WARC/1.0\r\n\r\n"]
        assert warc.read_archive(spark, path, payload=False).count() == 3
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(Exception, match="no WARC files"):
        warc.read_archive(spark, str(empty)).count()


def test_unwanted_payloads_are_not_inflated(tmp_path):
    rows = [{"record_id": f"<urn:page:{i}>", "record_type": "response", "payload": bytes(range(256)) * 4000} for i in range(5)]
    rows.append({"record_id": "<urn:page:9>", "record_type": "revisit", "payload": None})
    data = b"".join(warc.member(d := warc.record_bytes(r), d.index(b"\r\n\r\n") + 4, 3) for r in rows)
    assert gzip.decompress(data) == b"".join(map(warc.record_bytes, rows))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    with path.open("rb") as f:
        stream, seen = warc.RecordStream(f), []
        while (head := stream.headers()) is not None:
            seen.append(head["warc-type"])
            stream.skip()
    assert seen == ["response"] * 5 + ["revisit"] and stream.inflated < 6 * 2 * warc.INFLATED
    assert head is None and "warc-profile" in warc.parse_headers(warc.record_bytes(rows[-1]))


def test_whole_key_blocks(spark, make_docs):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIEow+/IBAA==\nAbCd\n-----END RSA PRIVATE KEY-----"
    docs = make_docs([(1, f"x {key} y", "en", "a"), (2, "-----BEGIN PRIVATE KEY----- and no end", "en", "a"), (3, key + key, "en", "a")])
    got = {r.doc_id: [(f["start"], f["end"]) for f in r.findings if f["rule"] == "pem@2"] for r in secrets.scan_versions(docs).collect()}
    assert got == {1: [(2, 2 + len(key))], 2: [(0, 27)], 3: [(0, len(key)), (len(key), 2 * len(key))]}


def test_incremental_scan_is_the_single_scan(spark, make_docs, edge_rows, tmp_path):
    prepare(spark)
    docs = make_docs(edge_rows + [(20 + i, f"password = hunter{i:08d}", "en" if i % 2 else "de", "a") for i in range(6)])
    path = str(tmp_path / "ledger")
    secrets.scan_versions(docs.filter("lang = 'en'"), path)
    first = spark.read.parquet(path).count()
    again = secrets.report(docs, ledger_path=path)
    assert sorted(map(str, again.collect())) == sorted(map(str, secrets.report(docs).collect()))
    blobs = docs.select(secrets.blob_of(F.col("text"))).distinct().count()
    assert 0 < first < blobs == spark.read.parquet(path).count() == spark.read.parquet(path).select("blob").distinct().count()


def test_lesser_and_affero_notices_are_told_apart(spark, make_docs):
    rows = [(i, f"/*\n * {text}\n */", "en", "a") for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    got = {r.doc_id: r.license for r in license_scan.scan_licenses(make_docs(rows)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(license_scan.TEMPLATES)}


def test_cutoffs_do_not_depend_on_the_order_of_repeated_rows(spark, make_docs):
    """Two texts of one id: the one with the least bins counts, whichever comes first.  Ratios of 0
    are told from small ones."""
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "en", "a") for i in range(1200)] + [(i, good + " #" * 30, "en", "a") for i in range(1200)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    cuts = [quality_rules.choose_cutoffs(
        quality_rules.text_counts(make_docs(r)), labels).first().cutoffs for r in (rows, rows[::-1])]
    assert cuts[0] == cuts[1] and cuts[0]["symbols"] == 0
    got = {r.doc_id: r.reasons for r in quality_rules.judge(make_docs(rows[:1200] + [(5000, good + " #", "en", "a")]), labels).collect()}
    assert got[5000] == "symbols" and got[0] == ""
