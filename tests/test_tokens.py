from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import tablecheck as tc
from tablecheck.functions import token_of
from tablecheck.operators.texts import _hot_words

TERMS = ("A_B", "A_B_C", "PLAIN", "x.y_z")
TEXTS = [
    'x "" "a\nb"', '"a"x"b"', "A_B A_B_C éA_B (A_B)", "PLAIN A_B", 'open " quote A_B', "",
    "none here", "x.y_z xAy_z", "deadbeef01 DEADBEEF01 A_B", '"A_B" "é"',
]


def digest(name: str, width: int = 10) -> str:
    return hashlib.sha256(name.encode()).hexdigest()[:width]


def expected(text: str, terms) -> tuple[str, dict]:
    """What one text becomes, worked out without Spark."""
    found = {}

    def token(name):
        found[name] = digest(name)
        return found[name]

    out, pattern = "", "|".join(['"[^"]*"', *(rf"\b{re.escape(t)}\b" for t in terms)])
    position = 0
    for m in re.finditer(pattern, text):
        word = m.group()
        out += text[position:m.start()]
        if word.startswith('"'):
            out += f'"{token(word[1:-1])}"'
        else:
            out += token(word) if "_" in word else word
        position = m.end()
    return out + text[position:], found


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def by_id(df):
    return [r["t"] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("terms", [(), TERMS])
def test_tokens_and_dictionary(spark, terms):
    df, style = frame(spark, [*TEXTS, None]), tc.TokenStyle(terms=terms)
    want = [expected(t, terms) for t in TEXTS]
    assert by_id(tc.tokenize_text(df, "t", style)) == [w[0] for w in want] + [None]
    names = {}
    for _, found in want:
        names.update(found)
    assert {r["term"]: r["token"] for r in tc.term_dictionary(df, "t", style).collect()} == names


@pytest.mark.parametrize("plan", ["auto", "lookup", "join", "salted"])
def test_restore(spark, plan, monkeypatch):
    strategy = "join" if plan == "salted" else plan
    if plan == "salted":
        monkeypatch.setattr("tablecheck.operators.texts.LEAST_HOT", 50)
    df, style = frame(spark, [*TEXTS, None, *['"hot" "hot" "cold"'] * 20]), tc.TokenStyle(TERMS)
    dictionary = tc.term_dictionary(df, "t", style)
    tokenized = tc.tokenize_text(df, "t", style)
    restored = tc.restore_text(tokenized, "t", dictionary, ["id"], style, strategy)
    assert restored.columns == df.columns
    assert by_id(restored) == by_id(df)
    assert tc.round_trip_failures(df, "t", ["id"], None, style, strategy).count() == 0


@pytest.mark.parametrize("strategy", ["lookup", "join"])
def test_restore_looks_up_exact_case_and_leaves_the_rest(spark, strategy):
    names = spark.createDataFrame(
        [("first", "deadbeef01"), ("second", "deadbeef01"), ("é_x", "abcdefabcd")],
        "term string, token string",
    )
    df = frame(spark, ["deadbeef01 DEADBEEF01 0123456789 deadbeef012", "éabcdefabcd abcdefabcd."])
    assert by_id(tc.restore_text(df, "t", names, ["id"], strategy=strategy)) == [
        "first DEADBEEF01 0123456789 deadbeef012", "éabcdefabcd é_x.",
    ]
    nothing = names.limit(0)
    assert by_id(tc.restore_text(df, "t", nothing, ["id"], strategy=strategy)) == by_id(df)


@pytest.mark.parametrize("strategy", ["lookup", "join"])
def test_restore_with_repeated_and_null_ids(spark, strategy):
    texts = ["deadbeef01", "deadbeef01 x", "deadbeef01 x", None, ""]
    df = spark.createDataFrame([(i, t) for t in texts for i in (1, None)], "id int, t string")
    names = spark.createDataFrame([("n", "deadbeef01")], "term string, token string")
    restored = tc.restore_text(df, "t", names, ["id"], strategy=strategy).collect()
    assert sorted(map(repr, restored)) == sorted(
        f"Row(id={i}, t={t!r})" for t in ["n", "n x", "n x", None, ""] for i in (1, None)
    )
    tokens = tc.round_trip_failures(df, "t", ["id"], names, strategy=strategy)
    # Only what was a token before tokenising does not come back the same.
    assert tokens.count() == 6


def test_restore_options(spark):
    df = spark.createDataFrame([(1, "deadbeef01")], "id int, t string")
    names = spark.createDataFrame([("n", "deadbeef01")], "term string, token string")
    with pytest.raises(ValueError, match="strategy"):
        tc.restore_text(df, "t", names, ["id"], strategy="guess")
    null_ids = spark.createDataFrame([(None, "deadbeef01"), (1, "x"), (2, None)], "id int, t string")
    restored = tc.restore_text(null_ids, "t", names, ["id"], strategy="join")
    assert {r["id"]: r["t"] for r in restored.collect()} == {None: "n", 1: "x", 2: None}


@pytest.mark.parametrize("width", [1, 2, 3, 10])
def test_lookup_of_many_terms(spark, monkeypatch, width):
    style = tc.TokenStyle(width=width)
    texts = [f'"name {i}" and "name {i + 1}"' for i in range(0, 700, 2)]
    df = frame(spark, texts)
    names = tc.term_dictionary(df, "t", style)
    out = tc.restore_text(tc.tokenize_text(df, "t", style), "t", names, ["id"], style, "lookup")
    first = {}
    for i in range(700):
        first.setdefault(digest(f"name {i}", width), []).append(f"name {i}")
    want = [
        " and ".join(f'"{min(first[digest(f"name {j}", width)])}"' for j in (i, i + 1))
        for i in range(0, 700, 2)
    ]
    if width > 3:
        assert want == texts
    # Short tokens also read "and" and the like as tokens where those are hex words.
    assert by_id(out) == want
    monkeypatch.setattr("tablecheck.operators.texts.LOOKUP_BYTES", 10)
    joined = tc.restore_text(tc.tokenize_text(df, "t", style), "t", names, ["id"], style)
    assert by_id(joined) == want


def test_style_options(spark):
    df = frame(spark, ["PLAIN A_B"])
    style = tc.TokenStyle(terms=("PLAIN",), require_underscore=False, salt="s", width=6)
    assert by_id(tc.tokenize_text(df, "t", style)) == [digest("sPLAIN", 6) + " A_B"]
    assert df.select(token_of(df["t"])).first()[0] == digest("PLAIN A_B")
    names = tc.term_dictionary(df, "t", style)
    assert by_id(tc.restore_text(tc.tokenize_text(df, "t", style), "t", names, ["id"], style)) == by_id(df)
    odd = tc.TokenStyle(terms=(r"q\E_z", "(a_b"))
    assert by_id(tc.tokenize_text(frame(spark, [r"q\E_z x(a_b y"]), "t", odd)) == [
        f"{digest(chr(113) + chr(92) + 'E_z')} x{digest('(a_b')} y"
    ]


def test_hot_words_are_dealt_out(spark):
    words = spark.range(1000).selectExpr("IF(id % 2 = 0, 'hot', 'w' || id) AS word")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        assert _hot_words(words) == (["hot"], 50)
        assert _hot_words(words.limit(0)) == ([], 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_style_is_checked():
    with pytest.raises(ValueError, match="1 to 64"):
        tc.TokenStyle(width=0)
    with pytest.raises(ValueError, match="empty"):
        tc.TokenStyle(terms=("a_b", ""))


def test_collisions_and_round_trip_failures(spark, rows):
    terms = spark.range(100).selectExpr("'term_' || id AS term")
    names = terms.withColumn("token", token_of(terms["term"], tc.TokenStyle(width=1)))
    got = tc.token_collisions(names.union(names)).collect()
    by_token = {}
    for i in range(100):
        by_token.setdefault(digest(f"term_{i}", 1), []).append(f"term_{i}")
    assert {r["token"]: (r["terms"], r["first_term"], r["last_term"]) for r in got} == {
        k: (len(v), min(v), max(v)) for k, v in by_token.items() if len(v) > 1
    }
    # A word that happens to be a token of the text is taken for one.
    df = frame(spark, [f'"name" {digest("name")}', '"name"'])
    failed = tc.round_trip_failures(df, "t", ["id"])
    assert rows(failed) == [(0, f'"name" {digest("name")}', '"name" name')]


def test_term_presence(spark, rows):
    df = frame(spark, ["a_b", "xa_bx", "c", None])
    assert rows(tc.term_presence(df, "t", ["a_b", "c", "d"])) == [("a_b", 2), ("c", 1), ("d", 0)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='aA_B" \n.é0f', max_size=40), min_size=1, max_size=30))
def test_any_text(spark, texts):
    df, style = frame(spark, texts), tc.TokenStyle(terms=("A_B", "a_a"))
    tokenized = tc.tokenize_text(df, "t", style)
    assert by_id(tokenized) == [expected(t, style.terms)[0] for t in texts]


@pytest.mark.parametrize("underscore", [True, False])
def test_lists_of_words_of_any_length(spark, underscore):
    """Words are looked up in a table; terms with other characters are one pattern. Same result."""
    texts = ["A_B A_B_C xA_B A_Bx éA_B _ __ A_ _B (A_B) \"A_B\" A_B.A_B", "w_3 w_77 w_5000 plain é_ï", "", None]
    df = frame(spark, texts)
    words = ["A_B", "_B", "plain", "é_ï", *[f"w_{i}" for i in range(3000)]]
    few = tc.TokenStyle(terms=["no-word", "A_B", "_B", "plain", "é_ï", "w_3", "w_77"], require_underscore=underscore)
    many = tc.TokenStyle(terms=words, require_underscore=underscore)
    assert many.of_words and not few.of_words
    assert by_id(tc.tokenize_text(df, "t", many)) == by_id(tc.tokenize_text(df, "t", few))
    names = lambda style: sorted(map(tuple, tc.term_dictionary(df, "t", style).collect()))
    assert names(many) == names(few)
    seen = {r["term"]: r["texts"] for r in tc.term_presence(df, "t", words).collect()}
    assert len(seen) == len(words) and seen["A_B"] == 1 and seen["w_4"] == 0
