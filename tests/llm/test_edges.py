"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tablecheck.llm import (
    bpe, chat, components, decontamination, embedding_dedup, periodic_runs, prefix_trie, quality, sharding,
    simhash, substring_dedup, token_counts, token_orc, toxicity,
)
from tests.llm import brute

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, hash string, n long"
PROSE = "One two three four five six seven. Eight nine ten eleven twelve thirteen. "
TEXTS = [
    None, "", " \n\t ", "x", "a" * 30_000, "word " * 20_000, PROSE * 3, PROSE * 3,
    "Ünïcode ß 日本語 😀 ͸ <|endoftext|> İ é", "don't  \n\n  stop\r\n",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", "clash", 1) for i, t in enumerate(TEXTS)]
    rows += [(None, "null id", None, None, None, None), (6, TEXTS[6], "en", "s", "clash", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encode_and_decode(odd, empty):
    rows = bpe.decode(bpe.encode(odd, BYTE), BYTE).collect()
    want = brute.token_ids([r["text"] for r in rows], "byte_bpe_50k.json")
    assert [np.frombuffer(r["token_ids"], "<u4").tolist() for r in rows] == want
    assert [r["decoded"] for r in rows] == [r["text"] or "" for r in rows]
    both = bpe.round_trip(odd.withColumnRenamed("hash", "decoded"), BYTE).collect()
    key = lambda r: (bytes(r["token_ids"]), r["decoded"])
    assert sorted(map(key, both)) == sorted(map(key, rows))
    assert bpe.encode(empty, BYTE).count() == 0 and bpe.round_trip(empty, BYTE).count() == 0
    again = bpe.encode(odd.withColumnRenamed("hash", "token_ids"), BYTE)
    assert dict(again.dtypes)["token_ids"] == "binary"


def test_random_texts_encode_like_the_library(spark):
    rng = random.Random(3)
    alphabet = "abcdeé 0 1'st ll\n\t.,!?  ÄßΣ中x"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(300)]
    merges = bpe.load_merges(bpe.read_vocabulary(BYTE))
    got = [x.tolist() for x in bpe.encode_block(texts, merges)]
    assert got == brute.token_ids(texts, "byte_bpe_50k.json")
    words = token_orc.encode_words(bpe.read_vocabulary(WORD))
    assert [x.tolist() for x in words(texts)] == brute.token_ids(texts, "word_bpe_49k.json")


def test_words_before_any_marks_encode_like_the_library():
    assert set("*#$%&") < set(token_orc.STOPS) and "'" not in token_orc.STOPS
    rng = random.Random(4)
    alphabet = "abAZéÉßΣ中0 \n'st" + token_orc.STOPS
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["Mark*** né%%% <|endoftext|> a<|endoftext|> b|> c*'s d's* e'*", "***", ""]
    words = token_orc.encode_words(bpe.read_vocabulary(WORD))
    assert [x.tolist() for x in words(texts)] == brute.token_ids(texts, "word_bpe_49k.json")


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.load_merges(bpe.read_vocabulary(WORD))


def test_equal_pairs_merge_from_the_left():
    assert bpe.leftmost(np.array([0, 1, 2, 5]), np.array([1, 2, 3, 6])).tolist() == [0, 2, 5]


def test_token_counts(odd, empty):
    rows = token_counts.count_tokens(odd, BYTE, count_col="n").collect()
    want = brute.token_ids([r["text"] for r in rows], "byte_bpe_50k.json")
    assert [r["n"] for r in rows] == list(map(len, want))
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def test_token_orc(spark, odd, empty, tmp_path):
    path = str(tmp_path / "ids")
    token_orc.write_token_orc(odd, path, WORD, end_id=2, parts=3)
    rows = token_orc.with_starts(token_orc.read_token_orc(spark, path)).orderBy("start").collect()
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    docs = sorted(odd.collect(), key=order)
    assert [r["doc_id"] for r in rows] == [d["doc_id"] for d in docs]
    want = [x + [2] for x in brute.token_ids([d["text"] for d in docs], "word_bpe_49k.json")]
    assert [r["ids"] for r in rows] == want
    assert [r["start"] for r in rows] == np.append(0, np.cumsum(list(map(len, want)))[:-1]).tolist()
    some = token_orc.read_token_orc(spark, path, [6, 9])
    assert sorted(r["doc_id"] for r in some.collect()) == [6, 6, 9]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    token_orc.write_token_orc(empty, str(tmp_path / "none"), WORD, parts=2)
    assert token_orc.read_token_orc(spark, str(tmp_path / "none")).count() == 0


def test_simhash(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    texts = {i: t for i, t in enumerate(TEXTS)}
    assert len(rows) == odd.count()
    for r in rows:
        text = "null id" if r["doc_id"] is None else texts[r["doc_id"]]
        assert int(r["fingerprint"], 16) == brute.fingerprint(text)
    component = {r["doc_id"]: r["component_id"] for r in rows}
    assert component[0] == component[1] == component[2] == 0 and component[7] == 6
    assert component[None] is None
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_one(odd).collect()]
    assert sorted(kept, key=str) == sorted([0, 3, 4, 5, 6, 6, 8, 9, None], key=str)


@pytest.mark.parametrize("tile", [65_536, 7])
def test_all_links_of_random_fingerprints(spark, tile):
    rng = random.Random(5)
    prints = [0, -1]
    for _ in range(40):
        seed = rng.getrandbits(64)
        for _ in range(rng.randrange(6)):
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
            prints.append(seed - (1 << 64) if seed >> 63 else seed)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = components.components(simhash.links(df, 4, tile)).collect()
    unsigned = [(p, p & (2**64 - 1)) for p in prints]
    want = brute.near_components(unsigned)
    got = {r["node"]: r["root"] for r in found}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({p: got.get(p, p) for p in prints}) == groups(want)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 800)] + [(5, 5), (900, 899)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in range(500, 800)} | {899: 899, 900: 899}


def test_substring_dedup(spark, odd, empty):
    out = substring_dedup.remove_repeats(odd, cut_col="n").collect()
    assert len(out) == odd.count() and out[0].asDict().keys() == odd.first().asDict().keys()
    got = sorted(((r["doc_id"], r["text"]) for r in out), key=str)
    # Rows of one id are one document; within a text the first span stays.
    want = [(i, t) for i, t in enumerate(TEXTS) if i not in (6, 7)]
    want += [(6, PROSE), (6, PROSE), (7, ""), (None, "null id")]
    assert got == sorted(want, key=str)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_passages_are_cut_where_they_occur_again(spark):
    rng = random.Random(1)
    sentence = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 15))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(12))
    rows = []
    for i in range(20):
        before, after = (" ".join(sentence() for _ in range(8)) for _ in range(2))
        rows.append((i, f"{before} {passage if i % 2 else passage.upper()}\n{after}", before, after))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(df).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"{b} {a}" for i, _, b, a in rows[1:])


def test_passages_within_a_sentence_are_cut_where_they_occur_again(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, inner, bare = words(60), words(51), words(400)
    texts = [f"{words(9)}. {passage}. {words(9)}.", f"{words(9)}. {passage.upper()}. {words(9)}.",
             f"{words(40)} {inner} {words(40)}", f"{words(30)} {inner} {words(30)}", bare, bare, "word " * 300, "word " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(df).collect()}
    assert all(got[i] == texts[i] for i in (0, 2, 4, 6))
    before, _, after = texts[1].split(". ")
    assert got[1] == f"{before}. {after}"
    # A passage amid a sentence may keep a few words at its ends; what is new stays.
    left = got[3].split()
    assert left[:30] == texts[3].split()[:30] and left[-30:] == texts[3].split()[-30:] and len(left) < 60 + 39
    assert got[5] == "" and got[7] == ""


def test_decontamination(spark, odd, empty):
    items = ["", None, "x", PROSE, "A benchmark question that nobody else would ever think of asking here?"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    edited = items[4].replace("nobody", "n0body").replace("asking", "akin")
    docs = odd.union(spark.createDataFrame([(50, f"Say:\n {edited.upper()} Yes.", "en", "s", "", 1)], SCHEMA))
    found = decontamination.find_leaks(docs, benchmark).where("item_id > 2").collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(6, 3), (7, 3), (50, 4)}
    (hit,) = [r for r in found if r["doc_id"] == 50]
    plain = decontamination.plain(f"Say:\n {edited.upper()} Yes.")
    assert hit["distance"] == 3 and plain[hit["start"] : hit["end"]] == decontamination.plain(edited)
    blocks = decontamination.find_leaks(docs, benchmark, block=1).where("item_id > 2")
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, found))
    kept = decontamination.drop_leaks(docs, benchmark.where("item_id > 2")).collect()
    assert {r["doc_id"] for r in kept} == {None, 0, 1, 2, 3, 4, 5, 8, 9}
    assert decontamination.find_leaks(empty, benchmark).count() == 0
    assert decontamination.find_leaks(odd, benchmark.limit(0)).count() == 0


def test_myers_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 20)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
        least = min(decontamination.distances(decontamination.masks(item), len(item), text, False))
        assert min(least, len(item)) == brute.edit_distance(item, text)


def test_pigeonhole_finds_all_within_the_budget():
    rng = random.Random(4)
    for _ in range(200):
        item = "".join(rng.choice("abcd ") for _ in range(60)).strip() or "a"
        text = list(item)
        for _ in range(rng.randrange(6)):
            i = rng.randrange(len(text))
            text[i : i + 1] = rng.choice([[], ["x"], ["y", text[i]]])
        text = "zz " + "".join(text) + " zz"
        matcher = decontamination.Matcher([item], 0.06)
        near = brute.edit_distance(matcher.items[0], decontamination.plain(text)) <= matcher.budgets[0]
        assert bool(matcher.find(text)) == near


def test_sharding(spark, odd, empty):
    rows = sharding.interleave(odd, 16, tie_cols=("text",), shard_col="n").collect()
    assert len(rows) == odd.count()
    places = [(r["n"], r["slot"]) for r in rows]
    assert len(set(places)) == len(places) and {s for _, s in places} == {0}
    assert sharding.interleave(empty, 4).count() == 0
    many = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', 's' || id % 7) AS source")
    one = sharding.interleave(many, 7, range_rows=3000).collect()
    assert sorted(one) == sorted(sharding.interleave(many, 7, range_rows=40).collect())
    other = sharding.interleave(many, 7, seed=1).collect()
    assert {tuple(r) for r in one} != {tuple(r) for r in other}


def test_shards_are_written_in_order(spark, tmp_path):
    many = spark.range(500).selectExpr("id AS doc_id", "'s' || id % 3 AS source")
    placed = sharding.interleave(many, 4)
    sharding.write_shards(placed, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("shard").agg(F.min("slot"), F.max("slot")).count() == 4
    first = spark.read.parquet(str(tmp_path / "s" / "shard=0")).collect()
    assert [r["slot"] for r in first] == list(range(len(first)))


def test_quality(spark, odd, empty):
    rows = quality.robust_outliers(odd).collect()
    assert len(rows) == odd.count()
    texts = {i: t for i, t in enumerate(TEXTS)} | {None: "null id"}
    for r in rows:
        want = brute.measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
    assert quality.robust_outliers(empty).count() == 0
    rng = random.Random(0)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    docs = [(i, prose(rng.randrange(60, 900)), "en", "s") for i in range(60)]
    junk = [(100 + i, " ".join(f"{w}###" for w in prose(200).split()), "en", "s") for i in range(10)]
    df = spark.createDataFrame(docs + junk, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.robust_outliers(df).where("kept").collect()}
    assert kept == {d[0] for d in docs}


@pytest.mark.parametrize("share", [1 / 3, 0.45])
def test_quality_rejects_a_bad_text_however_often_it_is_there(spark, share):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    docs = [(i, prose(rng.randrange(60, 900)), "en", "s") for i in range(110)]
    n = round(len(docs) * share / (1 - share))
    copy = " ".join(f"{w}###" for w in prose(200).split())
    varied = [" ".join(f"{w}###" for w in prose(rng.randrange(100, 300)).split()) for _ in range(n)]
    junk = [(1000 + i, copy, "en", "s") for i in range(n)]
    other = [(i, t, "en", "t") for i, t, _, _ in docs] + [(1000 + i, t, "en", "t") for i, t in enumerate(varied)]
    df = spark.createDataFrame(docs + junk + other, "doc_id long, text string, lang string, source string")
    kept = sorted(r["doc_id"] for r in quality.robust_outliers(df).where("kept").collect())
    assert kept == sorted([d[0] for d in docs] * 2)


def test_quality_uses_no_python(spark, odd):
    plan = quality.robust_outliers(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_estimate_is_robust_mean_and_spread(spark):
    """The concentration steps on one group, against numpy."""
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(2.0, 0.7, (300, quality.D)) * quality.GRAIN).astype(int)
    x[:60] += 9000
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x], "grp string, " + ", ".join(f"x{i} long" for i in range(quality.D)))
    params = quality._deviations(rows, quality._medians(rows))
    for _ in range(3):
        params = quality._concentrate(rows, params)
    got = params.first()
    median = np.sort(x, axis=0)[(len(x) - 1) // 2]
    mad = np.sort(abs(x - median), axis=0)[(len(x) - 1) // 2]
    mean, cov = median.astype(float), np.diag((1.4826 * mad) ** 2)
    floor = np.diag((np.array(quality.FLOORS) * quality.GRAIN) ** 2)
    for _ in range(3):
        apart = x - mean
        d2 = np.einsum("ij,ij->i", apart @ np.linalg.inv(cov + floor), apart)
        near = np.floor(np.log1p(d2) * quality.GRAIN + 0.5)
        cut = np.sort(near)[int(np.ceil(quality.SHARE * len(x))) - 1]
        part = x[near <= cut]
        mean, cov = part.mean(axis=0), np.cov(part.T, bias=True)
    assert np.allclose([got[f"m{i}"] for i in range(quality.D)], mean)
    assert np.allclose([got[f"c{i}{j}"] for i in range(quality.D) for j in range(i + 1)],
                       [cov[i, j] for i in range(quality.D) for j in range(i + 1)])


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(odd, labels).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, labels).count() == 0
    rng = random.Random(0)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(1, 5))) for _ in range(80))
    docs = [(i, prose() + (" you zork, zorkish zork" if i % 4 == 0 else "") + prose()) for i in range(800)]
    df = spark.createDataFrame([*docs, (None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(df, labels).withColumn("held", toxicity.held_out(F.col("doc_id")))
    rows = [r for r in scored.collect() if r["held"] and r["doc_id"] < 800]
    right = sum((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.97


def test_chat(spark):
    text = "a\\b </s>[INST] <|im_end|>\n<|im_start|>user<|im_sep|>[/INST] \\ [\\INST]"
    rows = [
        ("t", 1, None, 0.0, "user", text), ("t", 2, 1, 1.0, "assistant", text), ("t", 3, 1, 5.0, "assistant", "best"),
        ("t", 4, 3, 5.0, None, None), ("t", 5, 4, 5.0, "assistant", "end"), ("t", None, 1, 9.0, "user", "no id"),
        ("u", 1, 99, None, "user", "dangling"), ("v", 1, 2, 1.0, "a", "cycle"), ("v", 2, 1, 1.0, "a", "cycle"),
        (None, 7, None, 1.0, "assistant", ""), ("t", 3, 1, -1.0, "assistant", "repeated id"),
    ]
    schema = "tree string, id long, parent long, score double, role string, text string"
    messages = spark.createDataFrame(rows, schema)
    found = {r["tree"]: r for r in chat.parse_chats(chat.format_chats(messages)).collect()}
    assert set(found) == {"t", "u", None}
    assert [tuple(t) for t in found["t"]["turns"]] == [("user", text), ("assistant", "best"), ("", ""), ("assistant", "end")]
    assert found["t"]["loss_text"] == "bestend" and found["t"]["leaf"] == 5
    assert [tuple(t) for t in found[None]["turns"]] == [("assistant", "")]
    both = chat.parse_chats(chat.format_chats(messages, per_tree=2)).where("tree = 't'").collect()
    assert {r["leaf"]: r["loss_text"] for r in both} == {5: "bestend", 2: text}
    assert chat.format_chats(messages.limit(0)).count() == 0


def test_long_reply_chains(spark):
    rows = spark.range(300).selectExpr(
        "1L AS tree", "id", "IF(id > 0, id - 1, NULL) AS parent", "0.0D AS score", "'assistant' AS role", "string(id) AS text"
    )
    (chat_row,) = chat.parse_chats(chat.format_chats(rows)).collect()
    assert [t["text"] for t in chat_row["turns"]] == [str(i) for i in range(300)]
    assert chat_row["loss_text"] == "".join(map(str, range(300)))


def test_near_vectors_of_odd_rows(spark):
    nan, big = float("nan"), 1e300
    rows = [
        (1, [1.0, 0.0], 1, 5), (2, [1.0, 0.0], 1, 5), (2, [1.0, 0.0], 1, 5), (3, [big, big / 10], 1, 5),
        (4, [1.0, 0.0], 2, 5), (5, [1.0, 0.0], None, 5), (6, None, 1, 5), (7, [], 1, 5), (8, [0.0, 0.0], 1, 5),
        (9, [1.0, nan], 1, 5), (10, [1.0, None], 1, 5), (11, [1.0, 0.0, 0.0], 1, 5), (12, [0.0, 1.0], 1, 5),
        (None, [0.0, -1.0], 1, 5), (13, [float("inf"), 1.0], 1, 5),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    got = [tuple(r) for r in embedding_dedup.near_vectors(df).collect()]
    linked = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False)]
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)] + [(None, 0, None, False)]
    assert sorted(got, key=str) == sorted(linked + alone, key=str)
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_near_vectors_over_many_shards(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    near = centres[rng.integers(0, 30, 400)] + rng.normal(size=(400, 16)) * 0.2
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(near)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute.near_vectors(rows, 0.93)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(df, shard_rows=25).collect()}
    assert set(got) == set(want) and all(got[i] <= n for i, (n, _) in want.items())
    assert sum(got.values()) >= 0.98 * sum(n for n, _ in want.values()) > 0


def test_periodic_runs_of_odd_texts(odd, empty):
    rows = periodic_runs.add_runs(odd.withColumnRenamed("hash", "runs")).collect()
    for r in rows:
        words = (r["text"] or "").encode().split()
        if len(set(words)) == 1 and len(words) >= 12:
            want = [(0, len(words), 1)]
        else:
            want = brute.periodic_runs([w.decode() for w in words])
        assert [tuple(x) for x in r["runs"]] == want
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(w.decode() for k, w in enumerate(words) if k not in gone)
    assert len(rows) == odd.count() and periodic_runs.add_runs(empty).count() == 0


def test_prefix_trie_of_odd_turns(spark):
    schema = "conv_id long, pos long, role string, text string, size long, depth int"
    rows = [(1, 0, "a", "x", 1, 9), (2, 0, "a", "x", 1, 9), (2, 1, None, None, None, 9), (3, 0, "b", "x", 1, 9),
            (None, 0, "a", "x", 1, 9)]
    everyone = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,)], "conv_id long")
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, schema), everyone).collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found}
    assert got == {
        (1, 0): (None, 4, 2, 2, 1, brute.sha("4")), (1, 1): (1, 2, 1, 1, 1, brute.sha("1")),
        (2, 2): (1, 1, 0, 1, 0, brute.sha("2")), (3, 1): (1, 1, 0, 1, 0, brute.sha("3")),
    }
    none = spark.createDataFrame([], schema)
    assert prefix_trie.prefix_trie(none).count() == 0
