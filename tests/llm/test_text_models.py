"""Chat formatting, packing, fingerprints, language and page text."""

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldspark.llm import chat, dom, fingerprint, langid, packing, page_text, queries

# chat


def chat_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.withColumn("start", F.lit(1)).withColumn("head", F.lit("x"))


def check_chat(got, rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert len(got) == len(by_conv)
    for r in got:
        turns = [(role, text) for _, _, role, text in sorted(by_conv[r["conv_id"]])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == brute.sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss))
        assert r["formatted_chars"] >= sum(len(b) for _, b in turns)


TRICKY = ["", "<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "\\<|", "<|im_sep|>", "<\\\\|\n", "\U0001f600<|", "a\n<|im_end|>\nb", None, "<<||", "\\n"]


def test_chat_query(spark, edge_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{edge_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)]
    check_chat(queries.QUERIES["op2_chat_format"](spark, edge_dir).collect(), rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    import oracle

    folder = "/root/testdata/sf0.01"
    rows, problem = oracle.compare(
        spark, oracle.connect(folder), name, queries.QUERIES[name], queries.ORACLES[name], folder
    )
    assert rows > 0 and not problem


def test_chat_hard_turns(spark):
    rng = random.Random(2)
    roles = ["user", "assistant", "assistant", "system", None, "odd\nrole<|", "back\\nslash", "\\\n"]
    rows = [(c, t, rng.choice(roles), rng.choice(TRICKY)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (7, 0, "user", "tie"), (7, 0, "user", "tie")]
    check_chat(chat.digest(chat.format_conversations(chat_rows(spark, rows))).collect(), rows)


def test_chat_merges_adjacent_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    r = chat.format_conversations(chat_rows(spark, rows)).first()
    assert r["formatted"] == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]] == ["c"]


def test_chat_merges_across_chunks(spark):
    """Runs of one role that end before, at and behind the chunks in which turns are merged."""
    n = 3 * chat.CHUNK + 5
    runs = {1: 1, 2: chat.CHUNK - 1, 3: chat.CHUNK, 4: chat.CHUNK + 1, 5: n}
    rows = [(c, t, ["user", "assistant"][t // run % 2], TRICKY[t % 9]) for c, run in runs.items() for t in range(n)]
    formatted = chat.format_conversations(chat_rows(spark, rows))
    check_chat(chat.digest(formatted).collect(), rows)
    for r in formatted.collect():
        assert r["formatted"].count(chat.START) == -(-n // runs[r["conv_id"]])
        ends = [s["start"] + s["length"] for s in r["loss"]]
        assert all(r["formatted"][e:].startswith((chat.SEPARATOR, chat.END)) for e in ends)


# packing


def check_packing(rows, docs, capacity=2048):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    total = 0
    for d in docs:
        ids = np.array([*exact.encode(d["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(pieces[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        at = 0
        for r in own:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["piece"] == 0 or r["length"] == capacity
            at += r["length"]
        assert at == len(ids)
        total += len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert len(rows) == sum(map(len, pieces.values()))
    return len(sequences), -(-total // capacity)


def test_packing_query(spark, edge_dir, edge_docs):
    rows = queries.QUERIES["op1_best_fit_packing"](spark, edge_dir).collect()
    used, bound = check_packing(rows, edge_docs)
    assert used <= bound * 1.02 + 1


def test_packing_blocks_and_levels(spark, edge_dir, edge_docs, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 40)
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    rows = packing.pack(docs, capacity=300).collect()
    used, bound = check_packing(rows, edge_docs, 300)
    assert used <= bound * 1.05 + 2


def test_packing_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, "x " * 5000)], "doc_id bigint, text string")
    rows = packing.pack(docs).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_packing_takes_added_tokens_as_the_tokenizer_does(spark):
    docs = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, "<|endoftext|>" * 3)], "doc_id bigint, text string")
    lengths = {r["doc_id"]: r["length"] for r in packing.pack(docs).collect()}
    assert packing.encoder()("x <|endoftext|> y") == [87, 220, 50256, 331]
    assert lengths == {1: 5, 2: 4}


def test_evolution_beats_best_fit():
    rng = random.Random(4)
    # triplets that fill bins exactly: best fit decreasing is known to miss them
    items = []
    for _ in range(60):
        a, b = rng.randint(380, 490), rng.randint(270, 299)
        items += [a, b, 1000 - a - b]
    greedy = len(packing.best_fit([], items, 1000))
    found = packing.evolve(items, [], 1000, random.Random(1), 60, 8)
    assert sorted(x for b in found for x in b) == sorted(items)
    assert all(sum(b) <= 1000 for b in found)
    assert 60 <= len(found) <= greedy


def test_crossover_keeps_every_document():
    rng = random.Random(8)
    items = [rng.randint(1, 100) for _ in range(300)]
    a, b = (packing.best_fit([], rng.sample(items, 300), 100) for _ in range(2))
    b = packing.mutate(b, 100, rng)
    child = packing.crossover(a, b, 100, rng)
    assert sorted(x for c in child for x in c) == sorted(items)


@pytest.mark.parametrize("text", ["x" * 3000, " " * 2500 + "a", "<|endoftext|> é\U0001f600 日本語テキスト", "don't  stop\n\n\t1234 ٣٤ ½"])
def test_both_forms_of_the_tokenizer_agree(text):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder()(text) == exact.encode(text, add_special_tokens=False).ids


# fingerprints


def test_fingerprint_query(spark, edge_dir, edge_docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_phrase_fingerprint"](spark, edge_dir).collect()}
    order = sorted(edge_docs, key=lambda d: -d["doc_id"])
    prints = {}
    for d, following in zip(order, [*order[1:], order[0]]):
        text, after, r = d["text"] or "", following["text"] or "", got[d["doc_id"]]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        signature = fingerprint.Parse().feed(text.encode()).signature()
        other = fingerprint.Parse().feed(edited.encode()).signature()
        assert r["fingerprint"] == fingerprint.fingerprint(signature)
        assert r["edited_fingerprint"] == fingerprint.fingerprint(other)
        assert r["near_edited"] == fingerprint.likeness(signature, other)
        assert r["near_next"] == fingerprint.likeness(
            signature, fingerprint.Parse().feed(after.encode()).signature()
        )
        prints.setdefault(text, r["fingerprint"])
        assert prints[text] == r["fingerprint"]
    long_ones = [r for r in got.values() if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long_ones if r["near_next"] < 1]) > 0.95


def test_phrases_are_a_dictionary_parse():
    text = b"abababababa" * 3
    phrases, known, current = [], set(), b""
    for i in range(len(text)):
        current += text[i : i + 1]
        if current not in known:
            known.add(current)
            phrases.append(current)
            current = b""
    parse = fingerprint.Parse().feed(text)
    assert len(parse.hashes) - 1 == len(phrases) == len(set(parse.hashes)) - 1


def test_likeness_estimates_the_share_of_phrases():
    rng = random.Random(6)
    words = [f"word{i}" for i in range(500)]
    text = " ".join(rng.choice(words) for _ in range(3000))
    half = text[: len(text) // 2] + " ".join(rng.choice(words) for _ in range(1500))
    a, b = (set(fingerprint.Parse().feed(t.encode()).hashes[1:]) for t in (text, half))
    estimate = fingerprint.likeness(*(fingerprint.Parse().feed(t.encode()).signature() for t in (text, half)))
    assert estimate == pytest.approx(len(a & b) / len(a | b), abs=0.2)


def test_fingerprint_of_one_row(spark):
    df = spark.createDataFrame([(5, "hello world hello world")], "doc_id bigint, text string")
    r = fingerprint.fingerprint_documents(df).first()
    assert r["near_next"] == 1.0


# language


def test_language_query(spark, edge_dir, edge_docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_language_id"](spark, edge_dir).collect()}
    assert len(got) == len(edge_docs)
    right, known = 0, {d["lang"] for d in edge_docs}
    for d in edge_docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] == "und"
        else:
            assert r["lang_pred"] in known
    tested = [d for d in edge_docs if d["doc_id"] < 100_000 and got[d["doc_id"]]["held_out"] and len(d["text"] or "") > 40]
    right = [got[d["doc_id"]]["lang_pred"] == d["lang"] for d in tested]
    assert np.mean(right) >= 0.97


def literal_trees(texts, order, min_seen, max_contexts):
    """Counts of bytes after every context, pruned like the contract says, in plain dictionaries."""
    tables = defaultdict(lambda: defaultdict(int))
    for t in texts:
        t = b"\n" * order + t
        for i in range(order, len(t)):
            for length in range(order + 1):
                tables[t[i - length : i]][t[i]] += 1
    ranked = sorted(tables, key=lambda c: (-sum(tables[c].values()), len(c), c))
    kept = [c for c in ranked if not c or sum(tables[c].values()) >= min_seen][:max_contexts]
    return {c: dict(tables[c]) for c in kept}


def literal_bits(tables, context, byte):
    refused, bits = set(), 0.0
    for length in range(len(context), -1, -1):
        seen = tables.get(context[len(context) - length :])
        if seen is None:
            continue
        offered = {b: n for b, n in seen.items() if b not in refused}
        if not offered:
            continue
        room = sum(offered.values()) + len(offered)
        if byte in offered:
            return bits - np.log2(offered[byte] / room)
        bits -= np.log2(len(offered) / room)
        refused |= offered.keys()
    return bits + np.log2(256 - len(refused))


def model_of(tables):
    rows = [(len(c), int.from_bytes(c + bytes([b])), n) for c, seen in tables.items() for b, n in seen.items()]
    return langid.Model(*np.array(rows, dtype=np.int64).T)


TRAINING = [b"abracadabra abracadabra", b"abrasax", "d\u00e9j\u00e0 vu, d\u00e9j\u00e0 lu".encode(), b"aaaaaaaa", b"a"]


@pytest.mark.parametrize("min_seen, max_contexts", [(1, 10_000), (2, 10_000), (4, 10_000), (1, 20), (1, 1)])
def test_code_lengths_are_exact(min_seen, max_contexts):
    order = langid.MAX_ORDER
    tables = literal_trees(TRAINING, order, min_seen, max_contexts)
    model = model_of(tables)
    for probe in (b"abracadabra", b"zebra", b"\xff!", b"dab", "d\u00e9j\u00e0".encode(), b"aaaaaaaaaaaab", b"\n\na"):
        padded = b"\n" * order + probe
        wanted, parents, where = langid.distinct_keys(langid._keys([padded]))
        want = [literal_bits(tables, padded[i - order : i], padded[i]) for i in range(order, len(padded))]
        assert model.code_lengths(wanted, parents)[where] == pytest.approx(np.array(want))


def test_escapes_waste_no_code():
    """The probabilities of all bytes at one place sum to 1, whatever the context."""
    model = model_of(literal_trees(TRAINING, langid.MAX_ORDER, 2, 10_000))
    for context in (b"\n\n\n\n", b"abra", b"zabr", b"\xff\xfe\xfd\xfc", b"aaaa", "d\u00e9j".encode()):
        wanted, parents, where = langid.distinct_keys(langid._keys([context + bytes([b]) for b in range(256)]))
        assert np.exp2(-model.code_lengths(wanted, parents)[where]).sum() == pytest.approx(1.0)


@pytest.mark.parametrize("min_seen, max_contexts", [(1, 10_000), (3, 10_000), (2, 25)])
def test_trees_hold_the_pruned_counts(spark, min_seen, max_contexts):
    texts = {"x": ["abracadabra", "abrasax", "", "a\nb"], "y": ["zzyzx zzyzx", "\u4f60\u597d\u4f60\u597d"], "z": [""]}
    rows = [(7 * i + 1, t, lang) for lang, held in texts.items() for i, t in enumerate(held)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    df = spark.createDataFrame(rows + [(1, None, "x"), (None, "out", "x")], "doc_id bigint, text string, lang string")
    got = defaultdict(dict)
    for r in langid.context_trees(df, 400, min_seen, max_contexts).collect():
        whole = r["key"].to_bytes(r["level"] + 1)
        got[r["lang"]].setdefault(whole[:-1], {})[whole[-1]] = r["n"]
    for lang in texts:
        learned = [t.encode() for _, t, name in rows if name == lang]
        assert got.get(lang, {}) == literal_trees(learned, langid.MAX_ORDER, min_seen, max_contexts)


def test_pieces_of_a_long_text_cover_it():
    text, order = "na\u00efve \u4f60\u597d " * 9, langid.MAX_ORDER
    whole = langid._keys([p for _, p in langid._pieces([(0, text)])])
    assert len(whole) == len(text.encode())
    for size in (1, 2, 7, len(text.encode())):
        pieces = [p for _, p in langid._pieces([(0, text), (1, "x")], size)]
        assert (langid._keys(pieces)[:-1] == whole).all()
    assert list(langid._pieces([(3, "")])) == []


def test_score_is_per_byte(spark):
    rows = [(i, "the cat sat on the mat " * 3, "en") for i in range(40)]
    rows += [(i + 100, "le chat est sur le tapis " * 3, "fr") for i in range(40)]
    probes = [(1000 + i, t, None) for i, t in enumerate(["the mat", "le tapis " * 50_000, "q", "the chat", "\u4f60"])]
    df = spark.createDataFrame(rows + probes, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert [got[1000 + i]["lang_pred"] for i in range(2)] == ["en", "fr"]
    assert all(0.5 <= got[1000 + i]["score"] < 1 for i in range(5))
    # a word of both is less certain than a sentence of one
    assert got[1003]["score"] < got[1000]["score"]


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "hello", None), (2, None, "en")], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(df).collect()} == {"und"}


# pages


def plain_article(source):
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)\b[^>]*>", inside)
    texts = (" ".join(html.unescape(re.sub(r"</?(?:b|i|a)\b[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_page_query(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.QUERIES["op9_page_text"](spark, folder).collect()
    assert len(rows) == len(pages)
    right = [r["text"] == plain_article(pages[r["page_id"]]) for r in rows]
    assert np.mean(right) >= 0.98
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_made_pages_of_other_layouts():
    import pyarrow.parquet as pq

    sources = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    model = page_text.train(sources[:120])
    samples = [page_text.article_blocks(s) for s in sources[120:240]]
    others = [t for b, o in samples for t in [*b[:1], *o]]
    rng = random.Random(77)
    made = [page_text.make_page(b, others, rng).replace(page_text.MARK, "") for b, _ in samples]
    right = [got == "\n".join(b) for got, (b, _) in zip(model.texts(made), samples)]
    assert np.mean(right) >= 0.85
    page = (
        "<html><body><div id=top-menu><a href=/>Home</a> <a href=/n>News</a></div><div class='cookie-bar'>"
        "We use cookies. Accept.</div><main><h1>Title &amp; more</h1><p>First  paragraph is a long one, with "
        "several words in it.\n Second sentence of it.</p><div class=advertisement>Buy this now</div><p>The "
        "second paragraph is long as well, it says a lot of things.</p></main><section class=comments><p>I do "
        "not agree at all</p></section><footer>&copy; 2020</footer></body></html>"
    )
    assert model.texts([page])[0] == (
        "Title & more\nFirst paragraph is a long one, with several words in it. Second sentence of it.\n"
        "The second paragraph is long as well, it says a lot of things."
    )


def test_decoding_is_the_likeliest_consistent_labelling():
    rng = random.Random(5)
    for _ in range(200):
        page = dom.Page()
        page.add("#root", -1)
        for i in range(1, rng.randint(2, 9)):
            holders = [k for k in range(i) if page.tag[k] != "#text"]
            page.add(rng.choice(["div", "#text"]), rng.choice(holders), "", "x")
        n = len(page.tag)
        p = np.array([rng.uniform(0.02, 0.98) for _ in range(n)])
        best, best_open = -np.inf, None
        for bits in range(1 << (n - 1)):
            label = [True] + [bool(bits >> i & 1) for i in range(n - 1)]
            kids = [[k for k in range(n) if page.parent[k] == i] for i in range(n)]
            if any(label[i] and not label[page.parent[i]] for i in range(1, n)):
                continue
            if any(label[i] and page.tag[i] == "div" and not any(label[k] for k in kids[i]) for i in range(1, n)):
                continue
            score = sum(np.log(p[i] if label[i] else 1 - p[i]) for i in range(1, n))
            if score > best:
                best, best_open = score, [i for i in range(n) if label[i] and page.tag[i] == "#text"]
        assert dom.decode(page, p) == best_open


def test_page_edge_cases(spark):
    rows = [(1, None, "k"), (1, "", "k"), (None, "<p>", "k"), (2, "plain words only", "k"), (3, "<" * 500, None), (4, "<div>" * 3000 + "deep", None)]
    df = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    got = page_text.extract_main_text(df, ["page_id"]).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize("name", ["op1_best_fit_packing", "op2_chat_format", "op6_phrase_fingerprint", "op7_language_id", "op9_page_text"])
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == (1 if "chat" in name else 0)


def blocks(source):
    page = dom.parse(source)
    return [t for tag, t in zip(page.tag, page.text) if tag == "#text"]


def test_parser_loses_no_text():
    assert blocks("<p>Energy is <math><mi>E</mi>=mc2</math> as known</p>") == ["Energy is E=mc2 as known"]
    assert blocks("<p>a</p><object data=x>fallback words</object><p>b</p>") == ["a", "fallback words", "b"]
    assert blocks("<p>one</p><svg><p>two</p><p>three</p>") == ["one", "two", "three"]
    assert blocks("<p>one <textarea>two</p><p>three</p>") == ["one two", "three"]
    assert blocks("<p>one</p><script>var x;</p><p>two</p>") == ["one"]
    assert blocks("<p>a<script>x</script>b<style>y</style>c</p>") == ["abc"]
