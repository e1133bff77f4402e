import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mnestra.llm import quality as qa

WORDS = "the a of and to is in that which".split()
COMMON = qa.word_hashes(WORDS)
PROSE = "The valve is held in the housing. A spring, which is bent, pushes the pin to the end of that tube.\nIt opens!"


def kinds(*texts):
    return list(qa.judge(qa.text_statistics(list(texts), COMMON))[0])


def test_counts():
    x = {k: v.tolist() for k, v in qa.text_statistics([PROSE, None, "", " \t\n", "Zwei Wörter\r\n- é­3 #"], COMMON).items()}
    assert x["tokens"] == [len(PROSE.split()), 0, 0, 0, 5] and x["lines"] == [2, 0, 0, 0, 2] and x["stopped_lines"] == [2, 0, 0, 0, 0]
    assert x["common_words"][0] == sum(w.strip(".,!").lower() in WORDS for w in PROSE.split())
    assert x["sentences"][0] == 3 and x["bullet_lines"][4] == 1 and x["symbols"][4] == 1
    assert x["dark"][0] == len(PROSE.replace(" ", "").replace("\n", "")) and x["distinct"][0] == len({w.lower() for w in PROSE.split()})


def test_texts_do_not_touch_each_other():
    texts = ["one", "two three", "", None, "four.", PROSE, "- x", "漢字かな"] * 3
    whole = qa.text_statistics(texts, COMMON)
    for i, t in enumerate(texts):
        for k, v in qa.text_statistics([t], COMMON).items():
            assert whole[k][i] == v[0], (k, t)


def test_no_texts():
    assert all(len(v) == 0 for v in qa.text_statistics([], COMMON).values())


def test_long_texts_in_parts(monkeypatch):
    text = (PROSE + "\n") * 40 + "word " * 300 + "\r\n" + PROSE
    whole = qa.text_statistics([text, "x"], COMMON)
    monkeypatch.setattr(qa, "LONG", 500)
    parts = qa.text_statistics([text, "x"], COMMON)
    for k in whole:
        assert whole[k].tolist() == parts[k].tolist(), k
    monkeypatch.setattr(qa, "LONG", 50)
    assert qa.text_statistics(["x" * 500], COMMON)["letters"][0] == 500


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.lists(st.sampled_from(["word", "the", " ", "   ", "\n", "\r\n", "\u2028", "12.", "-", "a,b,c", "End.", "...", "…", "#", "ex.", "é", "\t", "x" * 70, "|"]), max_size=120).map("".join), long=st.integers(1, 60))
def test_parts_are_the_whole(monkeypatch, text, long):
    monkeypatch.setattr(qa, "LONG", 10**9)
    whole = qa.text_statistics([text, PROSE], COMMON)
    monkeypatch.setattr(qa, "LONG", long)
    parts = qa.text_statistics([text, PROSE], COMMON)
    assert {k: v.tolist() for k, v in whole.items()} == {k: v.tolist() for k, v in parts.items()}


def test_one_token_or_line_longer_than_a_part():
    token = "ab9" * 700_000
    x = qa.text_statistics([token, "- " + "the pin, " * 200_000], COMMON)
    assert x["tokens"].tolist() == [1, 400_001] and x["dark"][0] == len(token) and x["bullet_lines"].tolist() == [0, 1] and x["lines"].tolist() == [1, 1]


def test_kinds():
    assert kinds(PROSE, PROSE.upper(), "1. A device which is held in the housing, wherein the pin opens.\n2. The device of claim 1, wherein the spring is bent.") == ["prose"] * 3
    assert kinds("11 pin\n13 first spring\n15 tube\n16 valve", "pin (1); tube (2); valve (3); first spring (4); cap (7)", "* not for the pin;\n* of the tube\n* in that valve", "F65L 9/17\nG09M 96/48\nC93B 79/47") == ["list"] * 4
    assert kinds("No.\tT\tp\nA1\t3.5\t<0.7\nA2\tok\t4", "A1,0.957,1.82,ok\n2,2.1,n.d.,16.7", "No. T yield mass\nS-001 3.5 brass 2 ok\n2 tube Cu 17 steel", "A1      0.95     ok\nA2      n.d.     7.1") == ["table"] * 4
    junk = ["page page page page page page", "the and the. the and the. " * 30, "00000000  26 e0 d1 cc 1b 00 f5 25\n00000010  1f 4b fb ac e4 04 c4 fd", "T h e v a l v e i s h e l d i n t h e b o x", "bvfn fxcq xfbfvj mfbvntht gmztpmdskkc gg lj fphznpqhdgj bgsw mrm hklqlc rxfpcdrvppj shdppm", "Thevalveisheldinthehousingandthespringpushes thepintotheendofthattubewhichisbent", ".... .... ....", "pin tube valve spring cap lever wheel pin shaft tube rod nut bolt screw cap pin lid"]
    assert kinds(*junk) == ["junk"] * len(junk)
    assert kinds(None, "", " \n\t ") == [None] * 3


def test_counters_of_long_lists_are_no_sentences():
    names = ["pin", "first spring", "tube of the valve", "inner cap of steel"]
    for start in (1, 100, 990, 9990):
        assert kinds("\n".join(f"{start + i}. {names[i % 4]}" for i in range(150))) == ["list"], start
    claims = "\n".join(f"{100 + i}. The device of claim {i + 1}, wherein the spring is bent." for i in range(20))
    assert kinds(claims) == ["prose"] and qa.text_statistics([claims], COMMON)["sentences"][0] == 20


def test_reasons_are_recorded():
    counts = qa.text_statistics(["page page page page page page", PROSE], COMMON)
    assert qa.judge(counts)[1].tolist() == ["repeats a few tokens", "sentences"]
    few = "Gopher: fewer than 50 words"
    assert few in qa.failures(counts)[0] and qa.failures(counts)[1] == [few]
    texts = {
        "Gopher: mean word length under 3": "a b c d e f g h i j k l m n o p",
        "Gopher: mean word length over 10": "abcdefghijklm nopqrstuvwxyz",
        "Gopher: more than 0.1 symbols a word": "pin # tube ... valve … cap",
        "Gopher: more than 0.9 of lines begin with a bullet": "- a pin\n- a tube",
        "Gopher: more than 0.3 of lines end in an ellipsis": "and then...\nthe pin\nthe tube…",
        "Gopher: under 0.8 of words have a letter": "1 2 3 pin",
        "Gopher: fewer than 2 stop words": "pin tube",
        "Gopher: the most frequent pair of words holds more than 0.2 of the characters": "the pin and the pin of the pin in the pin to the pin",
        "FineWeb: at most 0.12 of lines end in punctuation": "a pin\nthe tube",
        "FineWeb: 0.67 or more of lines have at most 30 characters": "a pin\nthe tube\nof",
        "FineWeb: more than 0.3 line breaks a word": "a\nb\nc\nd",
    }
    for why, text in texts.items():
        assert why in qa.failures(qa.text_statistics([text], COMMON))[0], why
    assert qa.failures(qa.text_statistics([(PROSE + "\n") * 3, None, " "], COMMON)) == [[], [], []]


def test_columns(spark):
    docs = spark.createDataFrame([(1, PROSE, "x"), (2, None, "x"), (3, "", "x"), (1, PROSE, "x"), (None, "a\tb\tc\nd\te\t1", "x")], "doc_id long, text string, kind string")
    words = spark.createDataFrame([("en", w) for w in [*WORDS, None, " "]], "lang string, word string")
    got = [(r["doc_id"], r["word_count"], r["kind"]) for r in qa.quality_statistics(docs, words).collect()]
    assert sorted(got, key=str) == sorted([(1, 23, "prose"), (1, 23, "prose"), (2, 0, None), (3, 0, None), (None, 6, "table")], key=str)
    assert qa.quality_statistics(docs.limit(0), words).count() == 0
    assert qa.quality_statistics(docs, words.limit(0)).where("share_common_words > 0").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_agrees_with_the_rated_sample(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["kind"] for r in qa.p8_statistics(spark, d).collect()}
    rated = spark.read.parquet(f"{d}/doc_labels.parquet").collect()
    assert np.mean([got[r["doc_id"]] == r["label"] for r in rated]) > 0.9
