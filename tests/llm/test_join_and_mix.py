"""The n-gram join and the mixing of sources against literal versions."""

import random
from collections import defaultdict

import brute
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import components, mixing, ngram_join, queries, storage


def got_components(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_join_query(spark, edge_dir, edge_docs):
    got = got_components(queries.QUERIES["op4_ngram_jaccard_join"](spark, edge_dir))
    assert got == brute.components([(d["doc_id"], d["text"]) for d in edge_docs], 4, 85)


def chained_texts(seed):
    """Groups of near copies that link in chains, short texts, and unrelated texts that share passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([8, 12, 17, 25, 60, 200]))]
        for _ in range(rng.randint(1, 25)):
            texts.append(" ".join(text))
            if rng.random() < 0.8:
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(words)
    passage = [rng.choice(words) for _ in range(60)]
    for _ in range(60):
        rest = [rng.choice(words) for _ in range(rng.randint(2, 60))]
        texts.append(" ".join(passage + rest))
    for _ in range(60):
        texts.append(" ".join(rng.choice(words[:4]) for _ in range(rng.randint(1, 14))))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 60)])
def test_join_finds_every_link(spark, width, percent):
    docs = chained_texts(width)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = got_components(ngram_join.jaccard_components(df, width, percent))
    assert got == brute.components(docs, width, percent)


@pytest.mark.parametrize("limit", [0, 14, ngram_join.MAX_LIGHT])
def test_join_is_the_same_for_every_boundary(spark, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda sizes, percent: limit)
    docs = [(i, t) for i, t in chained_texts(9) if len(t.split()) < 22 or limit < 20]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    got = got_components(ngram_join.jaccard_components(df, 4, 85))
    assert got == brute.components(docs, 4, 85)


@pytest.mark.parametrize("short", [0, 2, 8])
def test_join_is_the_same_for_short_and_long_lists(spark, monkeypatch, short):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short, raising=False)
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda sizes, percent: 5)
    docs = chained_texts(21)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = got_components(ngram_join.jaccard_components(df, 4, 85))
    assert got == brute.components(docs, 4, 85)


def written(monkeypatch):
    """Label, columns and rows of every table that the join writes from here on."""
    tables, stored = [], ngram_join.stored

    def noted(df, label):
        found = stored(df, label)
        tables.append((label, set(found.columns), found.count()))
        return found

    monkeypatch.setattr(ngram_join, "stored", noted)
    return tables


def test_members_of_short_lists_travel_without_sketches(spark, monkeypatch):
    tables = written(monkeypatch)
    rng = random.Random(4)
    docs = []
    for i in range(0, 60, 2):
        passage = [f"p{i}-{k}" for k in range(40)]
        docs += [(i + j, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(60)])) for j in (0, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = got_components(ngram_join.jaccard_components(df, 4, 85))
    assert got == brute.components(docs, 4, 85)
    lists = [(columns, n) for _, columns, n in tables if "token" in columns]
    assert any(n for _, n in lists)
    assert not any(n and columns & set(ngram_join.PARITY) for columns, n in lists)


def test_texts_of_large_sets_travel_only_if_they_may_link(spark, monkeypatch):
    """Sets so large that the differences of unlike ones fill the small sketch; one pair links."""
    tables = written(monkeypatch)
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(200)]
    texts = [passage + [f"w{rng.randrange(10**7)}" for _ in range(3800 + 20 * i)] for i in range(4)]
    texts.append([f"x{k}" if k % 200 == 0 else w for k, w in enumerate(texts[0])])
    docs = [(i, " ".join(text)) for i, text in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = got_components(ngram_join.jaccard_components(df, 4, 85))
    assert got == brute.components(docs, 4, 85) and got[4][1] == 0
    assert sum(n for label, _, n in tables if label == "candidates") == 1


def test_join_sends_texts_to_python_in_small_batches(spark, monkeypatch):
    """What a task holds at a time does not grow with the length of the texts."""
    conf, name, limits = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, stored = conf.get(name), ngram_join.stored

    def noted(df, label):
        limits.append(conf.get(name))
        return stored(df, label)

    monkeypatch.setattr(ngram_join, "stored", noted)
    docs = [(i, f"{i % 2} " * 10) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert got_components(ngram_join.jaccard_components(df, 4, 85)) == brute.components(docs, 4, 85)
    assert set(limits) == {str(storage.BATCH_BYTES)} and conf.get(name) == before

    def sizes(texts):
        def run(batches):
            for batch in batches:
                yield pd.DataFrame({"size": [int(batch["text"].str.len().sum())]})

        return [r["size"] for r in texts.mapInPandas(run, "size bigint").collect()]

    texts = spark.range(0, 1000, 1, 1).select(F.expr("repeat('some words ', 1000)").alias("text"))
    got = storage.in_small_batches(sizes)(texts)
    # a batch ends with the row that reaches the limit
    assert sum(got) == 11_000_000 and max(got) <= storage.BATCH_BYTES + 11_000

    with pytest.raises(ZeroDivisionError):
        storage.in_small_batches(lambda df: 1 // 0)(texts)
    assert conf.get(name) == before


def test_boundary_follows_cost():
    assert ngram_join.choose_boundary({}, 85) == 0
    few = ngram_join.choose_boundary({n: 10 for n in range(1, 33)}, 85)
    assert 5 <= few <= 32
    assert ngram_join.needed_overlap(6, 7, 85) == 6
    assert list(ngram_join.partner_sizes(6, 85)) == [6, 7]


def test_join_repeated_and_null_ids(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (1, "other words that are not the same at all"), (2, text), (None, text), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, ngram_join.jaccard_components(df, 4, 85).collect()), key=str)
    assert got.count((1, 7, 1)) == 2 and (2, 7, 1) in got and (None, 7, None) in got
    assert got.count((3, 0, 3)) == 2 and len(got) == 7
    kept = ngram_join.keep_one(df.withColumn("key", F.lit(1)), 4, 85)
    assert kept.columns == ["doc_id", "text", "key"]
    assert {r["doc_id"] for r in kept.collect()} == {1, 3}


def test_keep_one_row_of_each_group(spark):
    text, other = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, text, {"x": 1})] * 3 + [(1, text, {"x": 2}), (2, text, None), (None, text, None), (None, text, None)]
    # one id with two texts, of which one belongs to the group of a smaller id
    rows += [(4, other, None), (5, other, None), (5, "u v w x y z 1 2 3 4", None), (7, None, None), (7, "", None), (8, " ", None)]
    rows += [(None, "5 6 7 8 9 10 11 12", None)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra map<string,int>").repartition(5)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(df, 4, 85).collect()]
    want = [(1, text), (4, other), (5, "u v w x y z 1 2 3 4"), (7, None), (7, ""), (8, " ")]
    want += [(None, "5 6 7 8 9 10 11 12")]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_keep_one_with_many_copies_of_each_row(spark):
    """Near copies that are each repeated: copies must not meet each other by pairs."""
    words = [f"w{i}" for i in range(60)]
    rows = [(k % 5, " ".join([*words[:59], f"v{k % 5}"])) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    assert [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(df, 4, 85).collect()] == [rows[0]]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(64)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def water_level(sizes, wanted, weights, most):
    """Targets by the words of the contract: share, stop, share the excess again."""
    targets = {}
    open_ = set(sizes)
    while open_:
        left = wanted - sum(targets.values())
        shares = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if shares[s] > most * sizes[s]}
        if not over:
            return {**targets, **shares}
        for s in over:
            targets[s] = float(most * sizes[s])
        open_ -= over
    return targets


def check_mix(rows, docs):
    sizes = {d["doc_id"]: len(brute.WORD.findall(d["text"] or "")) for d in docs}
    by_source = defaultdict(int)
    for d in docs:
        by_source[d["source"]] += sizes[d["doc_id"]]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    targets = water_level(by_source, 1.5 * sum(by_source.values()), weights, 2)
    taken = defaultdict(int)
    source = {d["doc_id"]: d["source"] for d in docs}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == by_source[s]
        assert r["target"] == pytest.approx(targets[s], abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - targets[s]) <= 2.5 * mixing.BLOCK_WORDS, (s, taken[s], targets[s])
    assert len(rows) == len(docs)


def test_mix_query(spark, edge_dir, edge_docs):
    run = queries.QUERIES["op3_mix_sources"]
    rows = run(spark, edge_dir).collect()
    check_mix(rows, edge_docs)
    assert sorted(rows) == sorted(run(spark, edge_dir).collect())


def test_mix_many_shards(spark, edge_dir, edge_docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCUMENTS", 80)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 300)
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    rows = mixing.mix_sources(docs, ["doc_id"], block=20).collect()
    check_mix(rows, edge_docs)


def test_mix_rare_sources_reach_their_targets(spark, monkeypatch):
    """A few words of a source in each of many shards."""
    monkeypatch.setattr(mixing, "SHARD_DOCUMENTS", 40)
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(200, 400)), "a big one") for i in range(1200)]
    rows += [(5000 + i, " ".join(["w"] * n), f"b{n}") for n in (10, 40, 70, 130) for i in range(30)]
    rows += [(9000 + i, " ".join(["w"] * rng.randint(1, 70)), "z not stopped") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_sources(df, ["doc_id", "source"]).collect()
    taken, target, size = defaultdict(int), {}, {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    for n in (10, 40, 70, 130):
        assert target[f"b{n}"] == 2 * size[f"b{n}"] == taken[f"b{n}"] == 60 * n
    for s in taken:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS, (s, taken[s], target[s])


def sainte_lague(votes, house):
    seats = dict.fromkeys(votes, 0)
    for _ in range(house):
        best = min(votes, key=lambda s: (-votes[s] / (2 * seats[s] + 1), s))
        seats[best] += 1
    return seats


def test_apportionment_by_highest_quotients(spark):
    rng = random.Random(1)
    rows = []
    for shard in range(40):
        for s in range(rng.randint(1, 12)):
            rows.append((shard, f"s{s:02}", rng.choice([rng.uniform(0, 50), rng.uniform(0, 20000), 640.0])))
    df = spark.createDataFrame(rows, "shard int, source string, votes double")
    got = {(r["shard"], r["source"]): r["seats"] for r in mixing.apportion(df, 64).collect()}
    for shard in range(40):
        votes = {s: v for h, s, v in rows if h == shard}
        house = int(sum(votes.values()) / 64 + 0.5)
        assert {s: got[shard, s] for s in votes} == sainte_lague(votes, house)


def test_mixed_documents_hold_the_taken_words(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = {r["doc_id"]: r for r in mixing.mix_sources(docs, ["doc_id"]).collect()}
    texts, words, count = {r["doc_id"]: r["text"] for r in docs.collect()}, defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"]] += len(brute.WORD.findall(r["text"] or ""))
        count[r["doc_id"]] += 1
        assert set(brute.WORD.findall(r["text"] or "")) <= set(brute.WORD.findall(texts[r["doc_id"]] or ""))
    for doc_id, r in want.items():
        assert words[doc_id] == r["taken"]
        assert r["size"] or count[doc_id] == 1


@pytest.mark.parametrize("name", ["op3_mix_sources", "op4_ngram_jaccard_join"])
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0
