"""The pipeline from end to end: every stage's rows held against a literal version on its own input."""

from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldspark.llm.storage import stored

NAMES = [name for name, _ in corpus_pipeline.STAGES]


def through(spark, docs, folder):
    """The input of the first stage and the rows of every stage, written and read as run() does."""
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stored(stage(spark, frames[-1], folder), name))
    return [*frames, corpus_pipeline.STAGES[-1][1](spark, frames[-1], folder)]


@pytest.fixture(scope="module")
def staged(spark, edge_dir):
    """Edge documents, a tenth of them repeated as whole rows, some without id, source or lang."""
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    bare = docs.where("doc_id % 17 = 0").withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in ("doc_id", "lang", "source")})
    whole = docs.unionByName(docs.where("doc_id % 10 = 0")).unionByName(bare)
    frames = through(spark, whole, edge_dir)
    assert all(f.columns == docs.columns for f in frames[:-1])
    return {"input": frames[0].collect(), **{n: f.collect() for n, f in zip(NAMES, frames[1:])}}


def test_names():
    assert NAMES == ["quality_rules", "near_duplicates", "personal_data", "mix_sources", "best_fit_packing"]


def test_quality_stage(staged):
    kept, given = Counter(staged["quality_rules"]), Counter(staged["input"])
    assert kept and not kept - given
    assert not any(brute.quality(r["text"])["base_failed"] for r in kept)
    # copies of one row share its fate
    assert all(kept[r] == given[r] for r in kept)


def test_near_duplicate_stage(staged):
    given, kept = staged["quality_rules"], staged["near_duplicates"]
    group = brute.components([(i, r["text"]) for i, r in enumerate(given)], 5, 80)
    of_text = {r["text"]: group[i][1] for i, r in enumerate(given)}
    assert not Counter(kept) - Counter(given)
    assert Counter(of_text[r["text"]] for r in kept) == Counter(set(of_text.values()))


def test_personal_data_stage(staged):
    given, masked = staged["near_duplicates"], staged["personal_data"]
    rest = lambda r: tuple(r[c] for c in r.asDict() if c not in ("text", "n_chars"))
    assert Counter(map(rest, masked)) == Counter(map(rest, given))
    assert any(brute.personal(r["text"]) for r in given)
    assert not any(brute.personal(r["text"]) for r in masked)
    before = defaultdict(set)
    for r in given:
        before[rest(r)].add(r["text"])
    changed = [r for r in masked if r["text"] not in before[rest(r)]]
    assert 0 < len(changed) < len(masked)


def test_mixing_stage(staged):
    size = lambda rows: Counter({s: sum(len(brute.WORD.findall(r["text"])) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}})
    given, taken = size(staged["personal_data"]), size(staged["mix_sources"])
    assert set(taken) <= set(given)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(given.values()), rel=0.05)
    assert all(taken[s] <= 2.05 * given[s] + 128 for s in given)
    words = defaultdict(set)
    for r in staged["personal_data"]:
        words[r["doc_id"], r["source"]].update(brute.WORD.findall(r["text"]))
    assert all(set(brute.WORD.findall(r["text"])) <= words[r["doc_id"], r["source"]] for r in staged["mix_sources"])


def test_packing_stage(staged):
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in staged["mix_sources"]:
        want[r["doc_id"]] += len(tokens.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got, sequences = Counter(), defaultdict(list)
    for r in staged["best_fit_packing"]:
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_on_an_empty_table(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    assert all(f.count() == 0 for f in through(spark, docs.limit(0), edge_dir))


def test_stages_on_blank_rows_only(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    blank = docs.withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in ("text", "lang", "source", "doc_id")})
    assert all(f.count() == 0 for f in through(spark, blank, edge_dir)[1:])
