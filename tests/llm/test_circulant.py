"""Circulant MinHash near-duplicates against all links counted, and the signatures themselves."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import circulant, queries
from test_join_and_mix import chained_texts


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows if r["doc_id"] is not None)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query(spark, edge_dir, edge_docs):
    df = queries.QUERIES["op11_near_duplicates"](spark, edge_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert got(df) == brute.components([(d["doc_id"], d["text"]) for d in edge_docs], 2, 80)


@pytest.mark.parametrize("width,percent", [(2, 80), (5, 80), (3, 90)])
def test_every_link_is_found(spark, width, percent):
    docs = chained_texts(width + 20)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n", F.lit("x")).repartition(5)
    assert got(circulant.near_duplicates(df, width, percent)) == brute.components(docs, width, percent)


def test_large_group_in_parts(spark, monkeypatch):
    """Near copies in chains whose ends are far apart: buckets are cut into parts, components stay whole."""
    monkeypatch.setattr(circulant, "BUCKET_PART", 3)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs, text = [], [rng.choice(words) for _ in range(50)]
    for i in range(150):
        docs.append((1000 - i, " ".join(text)))
        text = list(text)
        for _ in range(rng.randint(1, 3)):
            text[rng.randrange(50)] = rng.choice(words)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert got(circulant.near_duplicates(df, 2, 80)) == brute.components(docs, 2, 80)


def test_repeated_null_and_long(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (1, "other words that are not the same at all"), (2, text), (None, text), (3, None), (3, "")]
    rows += [(4, "x " * 100_000), (5, "X " * 90_000 + "y"), (6, "z" * 300_000), (None, None), (7, " \t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(map(tuple, circulant.near_duplicates(df, 2, 80).collect()), key=str)
    assert found.count((1, 9, 1, True)) == 2 and (1, 8, 1, True) in found and (2, 9, 1, False) in found
    assert (None, 9, None, False) in found and (None, 0, None, False) in found
    assert found.count((3, 0, 3, True)) == 2 and (7, 0, 7, True) in found and (6, 1, 6, True) in found
    assert (4, 1, 4, True) in found and (5, 2, 5, True) in found and len(found) == len(rows)


def test_empty(spark, empty_dir):
    assert queries.QUERIES["op11_near_duplicates"](spark, empty_dir).collect() == []


def test_coordinates_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for similarity in (0.2, 0.5, 0.8):
        cut = round(1000 * (1 - similarity) / (1 + similarity))
        rates = []
        for i in range(20):
            pool = np.roll(whole, 97 * i)
            a, b = pool[:1000], pool[cut : 1000 + cut]
            one, two = circulant.signatures([np.sort(a), np.sort(b)])
            rates.append((one == two).mean())
        assert abs(np.mean(rates) - similarity) < 0.02, (similarity, np.mean(rates))


def test_second_permutation_is_one_to_one():
    places = np.arange(1 << 20, dtype=np.uint32) * np.uint32(4096)
    moved = circulant._second(places.copy(), np.empty_like(places))
    assert len(np.unique(moved)) == len(places)


def test_bands_hardly_ever_miss():
    miss = (1 - 0.8**circulant.ROWS) ** circulant.BANDS
    assert miss < 3e-7
    assert circulant.least_agreement(80) == 201
