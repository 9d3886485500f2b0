"""Personal data, secrets and quality rules against the literal contracts."""

import math
import time

import brute
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import pii, quality, queries, secrets


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_personal_data_base(spark, edge_dir, edge_docs):
    got = by_id(queries.QUERIES["op5_personal_data"](spark, edge_dir))
    assert len(got) == len(edge_docs)
    for d in edge_docs:
        want, row = brute.personal(d["text"]), got[d["doc_id"]]
        assert row["base_sha256"] == brute.sha(brute.label(want)), d["doc_id"]
        for kind in pii.KINDS:
            assert row[f"n_{kind}"] == sum(s[0] == kind for s in want)
        listed = row["spans"].split(",") if row["spans"] else []
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(listed)


def test_personal_data_discovers_unseen_identifiers(spark):
    rows = [(i, f"please ring hotline +1 (702) 555-{1000 + i} soon") for i in range(40)]
    rows += [(100 + i, f"please ring hotline 702.55{i} soon") for i in range(3)]
    rows += [(200 + i, f"there were {5000 + i} things") for i in range(30)]
    # the same context with the same shape of mention holds a seed: an address without a mailbox
    rows += [(300 + i, f"account holder 20{i}@mail.example.com wrote") for i in range(60)]
    rows += [(400, "account holder 2019@mail wrote"), (401, "nothing 2019@mail here")]
    rows += [(500 + i, f"server at 10.0.{i}.7 answered") for i in range(60)]
    rows += [(600, "server at 10.0.300.7 answered")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = by_id(pii.find_personal_data(docs))
    assert [(s["kind"], s["value"]) for s in found[600]["found"]] == [("ip", "10.0.300.7")]
    assert not any(found[i]["found"] for i in [*range(200, 230), 401])
    masked = by_id(pii.mask(docs))
    assert masked[600]["text"] == "server at [IP] answered"
    assert masked[0]["text"] == "please ring hotline [PHONE] soon"
    assert masked[200]["text"] == "there were 5000 things"


def test_personal_data_discovers_other_shapes(spark):
    rows = [(i, f"please ring hotline +1 (702) 555-{1000 + i} soon") for i in range(160)]
    rows += [(200 + i, f"please ring hotline 702.555.{2000 + i} soon") for i in range(20)]
    rows += [(300, "please ring hotline 702 555 8765 soon"), (301, "please ring hotline 12 soon")]
    rows += [(302, "please ring hotline ab1234 soon")]
    # known only as the instances of another pattern, which here seed a pattern of their own
    rows += [(400 + i, f"backup desk 702.555.{2000 + i} now") for i in range(20)]
    rows += [(500, "backup desk 702.555.9999 now"), (501, "other desks 702.555.9998 then")]
    rows += [(600 + i, f"account holder x{i}@mail.example.com wrote") for i in range(60)]
    rows += [(700, "account holder 2019@mail wrote"), (701, "nothing 2019@mail here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {i: [(s["kind"], s["value"]) for s in r["found"]] for i, r in by_id(pii.find_personal_data(docs)).items()}
    assert got[200] == [("phone", "702.555.2000")] and got[300] == [("phone", "702 555 8765")]
    assert got[400] == [("phone", "702.555.2000")] and got[500] == [("phone", "702.555.9999")]
    assert got[700] == [("email", "2019@mail")]
    assert not any(got[i] for i in (0, 301, 302, 501, 600, 701))


def test_mask_keeps_rows_and_columns(spark, edge_dir, edge_docs):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    got = by_id(masked)
    assert len(got) == len(edge_docs)
    for d in edge_docs:
        text = got[d["doc_id"]]["text"]
        if not brute.personal(d["text"]):
            assert text == d["text"]
        else:
            assert not [s for s in brute.personal(text) if s[0] == "email"]


def test_secrets_base(spark, edge_dir, edge_docs):
    got = by_id(queries.QUERIES["op10_secret_scan"](spark, edge_dir))
    assert len(got) == len(edge_docs)
    for d in edge_docs:
        want, row = brute.secret(d["text"]), got[d["doc_id"]]
        assert row["base_sha256"] == brute.sha(brute.label(want)), d["doc_id"]
        for kind in secrets.KINDS:
            assert row[f"n_{kind}"] == sum(s[0] == kind for s in want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(row["spans"].split(",")) | {""}


def test_secrets_ownership(spark):
    shared, own = "Zx9Qw8Er7Ty6Ui5Op4As3", "Mn1Bv2Cx3Zl4Kj5Hg6Fd7"
    rows = [(i, f"see {shared} here", f"s{i}", None) for i in range(5)]
    rows += [(10, f"see {own} here", "s1", "r"), (11, f"see {own} here", "s1", "r")]
    rows += [(12, "token=abcdefabcdef12", "s1", "r"), (13, "token=zzzzzzzzzzzz", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, repo string")
    got = by_id(secrets.find_secrets(docs, F.col("source"), F.col("repo")))
    assert not any(got[i]["found"] or got[i]["n_live"] for i in range(5))
    assert [got[i]["n_example"] for i in range(5)] == [1] * 5
    assert [s["value"] for s in got[10]["found"]] == [own] == [s["value"] for s in got[11]["found"]]
    assert got[12]["n_live"] == 1 and got[13]["n_live"] == 1


def test_secrets_of_few_owners_are_live(spark):
    mirrored, languages, wide = "mk4v9q2x7p8w3z6r5t1y", "7GQ4ZK2MXP5VTR8WLN3C", "Hs8Dk3Lp9Qz2Wx7Vb5Nm1"
    rows = [(i, f"see {mirrored} here", f"s{i}", "en") for i in range(2)]
    rows += [(10 + i, f"see {languages} text {i}", "s1", lang) for i, lang in enumerate(("en", "de", "fr", "es"))]
    rows += [(20 + i, f"see {wide} text {i}", f"s{i}", "en") for i in range(9)]
    # a document copied to more owners is still one text
    rows += [(40 + i, "token=abcdefabcdef12", f"s{i}", "en") for i in range(9)]
    rows += [(100 + i, "nothing thanbleshaningtionnt 12345678901234567890 here", f"s{i}", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = by_id(secrets.find_secrets(docs, F.col("source"), F.col("lang")))
    assert [[s["value"] for s in got[i]["found"]] for i in (0, 1)] == [[mirrored]] * 2
    assert [[s["value"] for s in got[i]["found"]] for i in range(10, 14)] == [[languages]] * 4
    assert not any(got[i]["found"] for i in [*range(20, 29), *range(100, 120)])
    assert all(got[i]["n_example"] == 1 for i in range(20, 29)) and all(got[i]["n_live"] == 1 for i in range(40, 49))
    assert [secrets.many_owners(n) for n in (0, 6, 20, 1_000_000)] == [3, 4, 6, 21]


def test_secrets_spread_over_repositories(spark):
    """Six repositories of two owners are many places; six of one owner, or six copies of one text, are not."""
    spread, single, copied = "mk4v9q2x7p8w3z6r5t1y", "7GQ4ZK2MXP5VTR8WLN3C", "Hs8Dk3Lp9Qz2Wx7Vb5Nm1"
    rows = [(i, f"see {spread} text {i}", f"s{i % 2}", f"r{i}") for i in range(6)]
    rows += [(10 + i, f"see {single} text {i}", "s0", f"r{i}") for i in range(6)]
    rows += [(20 + i, f"see {copied} here", f"s{i % 2}", f"r{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, repo string")
    got = by_id(secrets.find_secrets(docs, F.col("source"), F.col("repo")))
    assert not any(got[i]["found"] for i in range(6))
    assert all(got[i]["found"] for i in [*range(10, 16), *range(20, 26)])


@pytest.mark.parametrize("letter", ["a", "9", "@", " ", "+"])
def test_long_runs_are_linear(spark, letter):
    """Two million characters without a break before a number, twice."""
    text = f"{letter * 2_000_000} call 5551234567 or 702.555.1000 {letter * 100_000} 1"
    docs = spark.createDataFrame([(1, text, "s", "en")], "doc_id bigint, text string, source string, lang string")
    began = time.time()
    assert len(pii.digest(pii.find_personal_data(docs)).collect()) == 1
    assert len(secrets.digest(secrets.find_secrets(docs, F.col("source"), F.col("lang"))).collect()) == 1
    assert time.time() - began < 90


def test_quality_base(spark, edge_dir, edge_docs):
    got = by_id(queries.QUERIES["op8_quality_rules"](spark, edge_dir))
    assert len(got) == len(edge_docs)
    for d in edge_docs:
        row, want = got[d["doc_id"]], brute.quality(d["text"])
        assert {k: row[k] for k in want} == want, d["doc_id"]
        assert not (row["kept"] and want["base_failed"])


def binomial_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 10, 400, 900) for k in (0, 1, 3, 9) if k <= n]
    df = spark.createDataFrame(rows, "k bigint, n bigint")
    for r in df.withColumn("t", quality.binomial_tail_log(F.col("k"), F.col("n"), 0.02)).collect():
        if r["k"] <= r["n"] * 0.02:
            assert math.exp(r["t"]) == pytest.approx(binomial_tail(r["k"], r["n"], 0.02), rel=1e-9)
        else:
            assert r["t"] is None


def test_cutoffs_are_certified(spark):
    grids = {"a": [3.0, 2.0, 1.0], "b": [2.0, 1.0]}
    rows = []
    for i in range(2000):
        rows.append(("x", True, 0.5 if i % 100 else 1.5, 0.0))
    rows += [("x", False, 2.5, 0.0)] * 300 + [("x", False, 1.7, 0.0)] * 10
    rows += [("small", True, 0.0, 0.0)] * 20 + [("small", False, 9.0, 9.0)] * 20
    df = spark.createDataFrame(rows, "stratum string, good boolean, a double, b double")
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in quality.certify(df, 0.05, 0.05, grids).collect()}
    # 20 of 2000 good ones lie between 1 and 2: certified, but dearer than the 10 bad ones there
    assert got == {("x", "a"): 2.0}
    assert binomial_tail(20, 2000, 0.025) < 0.05 / 4


def test_quality_cutoffs_catch_junk_and_keep_clean(spark):
    clean = " ".join(f"word{i} and" for i in range(30))
    junk = " ".join(f"word{i}### $$$" for i in range(30))
    rows = [(i, f"{clean} c{i}", "en", "k") for i in range(1500)]
    rows += [(5000 + i, f"{junk} j{i}", "en", "k") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, good string")
    labels = docs.select("doc_id", (F.col("doc_id") < 5000).cast("int").alias("quality"))
    labels = labels.union(labels.limit(50)).union(spark.sql("select cast(null as bigint), 1"))
    got = by_id(quality.judge(docs, labels, F.col("lang"), ["doc_id"]))
    assert all(got[i]["kept"] for i in range(1500))
    assert not any(got[5000 + i]["kept"] for i in range(200))


@pytest.mark.parametrize("name", ["op5_personal_data", "op8_quality_rules", "op10_secret_scan"])
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0
