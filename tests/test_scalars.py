import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnestra.functions import scalars

SPACE = " \t\n\r\x0b\x0c"


def rows(spark, answers):
    return spark.createDataFrame(list(enumerate(answers)), "response_id long, response string")


def facts_by_hand(text):
    """The line protocol restated."""
    out, triple = [], None
    for pos, raw in enumerate(re.split("\r?\n", text)):
        line = raw.strip()
        if line.startswith("TRIPLE |"):
            parts = line.split("|", 3)
            if len(parts) == 4:
                triple = tuple(p.strip() for p in parts[1:])
        elif line.startswith("FACT |"):
            parts = line.split("|", 4)
            if len(parts) == 5:
                kind = parts[1].strip().lower()
                score = parts[2].strip()
                ok = re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", score)
                value = min(10.0, max(1.0, float(score))) if ok else 5.0
                out.append((pos, kind if kind in ("fact", "procedure", "preference", "decision") else "fact", value, [t.strip() for t in parts[3].split(",") if t.strip()], parts[4].strip(), triple))
                triple = None
    return out


CASES = [
    "FACT | fact | 8 | a,b | one | with bar\nTRIPLE | s | p | o",
    "TRIPLE | s | p | o|x\nFACT|fact|1|a|no blank\nFACT | Preference | n/a | ,, | kept",
    "TRIPLE | a | b\nTRIPLE | 1 | 2 | 3\nTRIPLE | 4 | 5 | 6\n  FACT | bogus | 12.5 | x | y  \nFACT | fact |  0  | | z",
    "FACT | fact | 1d | a | nothing\nFACT | fact | NaN | a | nan\nFACT | fact | 1e1 | a | ten\nFACT | short | 3",
    "",
    "noise",
]


def test_facts_and_triples(spark):
    got = {}
    for r in scalars.parse_facts(rows(spark, [*CASES, None])).orderBy("response_id", "pos").collect():
        triple = (r["subject"], r["predicate"], r["object"]) if r["subject"] is not None else None
        got.setdefault(r["response_id"], []).append((r["pos"], r["memory_type"], r["importance"], list(r["tags"]), r["content"], triple))
    assert got == {i: f for i, c in enumerate(CASES) if (f := facts_by_hand(c))}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="FACTRIPLE| ,ab1.\n", max_size=40).map(lambda s: s.replace("A", "FACT | fact | 1 | a | ").replace("L", "TRIPLE | x | y | ")), min_size=1, max_size=12))
def test_facts_like_by_hand(spark, texts):
    got = scalars.parse_facts(rows(spark, texts)).orderBy("response_id", "pos").collect()
    want = [(i, *f[:2], f[2], f[4], f[5] is None) for i, t in enumerate(texts) for f in facts_by_hand(t)]
    assert [(r["response_id"], r["pos"], r["memory_type"], r["importance"], r["content"], r["subject"] is None) for r in got] == want


def test_selected(spark):
    answer = "SELECTED [2] | x\nSELECTED 3|y|z\nSELECTED [1] and [2] | no\nSELECTED none | no\nSELECTED [4]\n SELECTED [12] : | ok"
    got = scalars.parse_selected(rows(spark, [answer, None])).orderBy("pos").collect()
    assert [(r["ordinal"], r["reasoning"]) for r in got] == [(2, "x"), (3, "y|z"), (12, "ok")]


def test_contradictions(spark):
    answer = "CONTRADICTION | [CANDIDATE-2] | why | so\nCONTRADICTION | 2 | w\nCONTRADICTION|[CANDIDATE-1]|no\nCONTRADICTION | x | no\nNONE"
    got = scalars.parse_contradictions(rows(spark, [answer, None])).orderBy("pos").collect()
    assert [(r["ordinal"], r["explanation"]) for r in got] == [(2, "why | so"), (2, "w")]


def test_scores(spark):
    cases = {"8": 8.0, " 7.5\n": 7.5, "8/10": 5.0, "1d": 5.0, "NaN": 5.0, "inf": 5.0, "-3": 1.0, "99": 10.0, "": 5.0, None: 5.0, ".5": 1.0, "5.": 5.0, "1e400": 10.0}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", scalars.parse_score(F.col("s")).alias("x")).collect()
    assert {r["s"]: r["x"] for r in got} == cases


def test_types_lists_and_tags(spark):
    df = spark.createDataFrame([("Fact", ["a", "B"]), ("DECISION", []), ("x", None), (None, ["x%y"])], "t string, tags array<string>")
    assert [r[0] for r in df.select(scalars.parse_memory_type(F.col("t"))).collect()] == ["fact", "decision", "fact", "fact"]
    assert [r[0] for r in df.select(scalars.any_tag(F.col("tags"), ["a", "z"])).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(scalars.all_tags(F.col("tags"), ["a", "B"])).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(scalars.all_tags(F.col("tags"), ["b"], compat_like=True)).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(scalars.any_tag(F.col("tags"), [])).collect()] == [True] * 4
    one = spark.createDataFrame([(" a, b ,,c",)], "s string")
    assert one.select(scalars.split_list(F.col("s"))).first()[0] == ["a", "b", "", "c"]
    assert one.select(scalars.split_list(F.lit(""))).first()[0] == [""]
    assert one.select(scalars.tags_from_json(F.lit('["a","b"]')), scalars.tags_from_json(F.lit("{bad")), scalars.clean_entity(F.lit(' "A "B" "'))).first()[:] == (["a", "b"], [], 'A "B" ')
    assert one.select(scalars.basic_tokens(F.lit("Don't stop-now"))).first()[0] == ["don", "'", "t", "stop", "-", "now"]


def test_clamp(spark):
    df = spark.createDataFrame([(0.0,), (99.0,), (5.5,), (None,)], "x double")
    assert [r[0] for r in df.select(scalars.clamp(F.col("x"))).collect()] == [1.0, 10.0, 5.5, None]
    assert math.isclose(df.select(scalars.clamp(F.lit(3.3))).first()[0], 3.3)
