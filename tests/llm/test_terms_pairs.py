from collections import Counter
from itertools import combinations

import numpy as np
from conftest import DATA, plain, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnestra.llm import pairs, queries, records, terms

SCHEMA = "id string, insert_seq long, tags array<string>, record string, terms int"


def memories(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)


ROWS = [("A ", 1, ["x"]), ("a", 2, ["X ", "x", "y", None, " "]), ("a", 2, ["X ", "x", "y", None, " "]), ("b", 3, None), ("c", 4, []), (None, 5, ["n"]), (" ", 6, ["n"]), ("d", None, ["z"]), ("d", 1, ["x"]), ("e", 7, ["y", "x"]), ("f", 8, ["x"])]


def test_records(spark):
    got = {r["record"]: r["terms"] for r in records.records(memories(spark, ROWS)).collect()}
    assert got == {"a": ["x", "x", "y"], "b": [], "c": [], "d": ["x"], "e": ["y", "x"], "f": ["x"]}
    assert memories(spark, ROWS).limit(1).select(records.record_count(memories(spark, ROWS))).first()[0] == 6


def test_term_frequencies(spark):
    df = memories(spark, ROWS)
    got = {r["tag"]: r[1:] for r in terms.term_frequencies(terms.term_bitmaps(records.numbered_records(df)), records.record_count(df)).collect()}
    assert got == {"x": (5, 4, "common"), "y": (2, 2, "rare")}
    empty = memories(spark, [])
    assert terms.term_frequencies(terms.term_bitmaps(records.numbered_records(empty)), records.record_count(empty)).count() == 0


def test_numbers_are_the_records_own(spark):
    """Whatever the order and the partitions of the rows, a record has the same number, and no other record has it."""
    rows = [(f"r{i % 500:03}", i, [f"t{i % 9}"]) for i in range(1200)]
    one = records.numbered_records(memories(spark, rows), bucket_records=64)
    two = records.numbered_records(memories(spark, rows[::-1]).repartition(7), bucket_records=64)
    numbers = lambda df: {r["record"]: (r["number"], tuple(r["terms"])) for r in df.collect()}
    assert numbers(one) == numbers(two) and len({n for n, _ in numbers(one).values()}) == 500
    assert len({n >> terms.RUN_BITS for n, _ in numbers(one).values()}) > 4  # several chunks
    got = {tuple(r) for r in terms.members(terms.term_bitmaps(one), two).collect()}
    assert got == {(t, r) for r, (_, ts) in numbers(one).items() for t in ts}


def test_chunks_in_any_order_are_merged_by_union(spark):
    rng = np.random.default_rng(3)
    rows = [(int(n), [f"t{n % 5}", "all", "all", None]) for n in rng.permutation(np.r_[0:3000, 65_536:67_000, 1 << 30 : (1 << 30) + 500])] + [(None, ["all"]), (5, None)]
    df = spark.createDataFrame(rows, "number long, terms array<string>").repartition(5)
    parts = terms.term_bitmaps(df, most_held=2)
    whole = {(r["term"], r["chunk"]): (terms.unpack_container(r["container"]).tolist(), r["n_occurrences"]) for r in terms.merge_bitmaps(parts).collect()}
    assert parts.count() > len(whole) == 18
    for (term, chunk), (low, n) in whole.items():
        want = sorted(k & 0xFFFF for k, t in rows if k is not None and t and term in t and k >> 16 == chunk)
        assert low == want and n == len(want) * (2 if term == "all" else 1)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 65535), min_size=1, max_size=300), st.sets(st.integers(0, 65535), min_size=1, max_size=300), st.integers(0, 9000))
def test_containers(a, b, run):
    a |= set(range(100, 100 + run))  # long runs and dense sets as well
    pack = lambda s: terms.pack_container(np.array(sorted(s)))
    assert set(terms.unpack_container(pack(a)).tolist()) == a
    assert terms.cardinality(pack(a)) == len(a) and len(pack(a)) <= 8193
    assert set(terms.unpack_container(terms.union_containers(pack(a), pack(b))).tolist()) == a | b


def test_container_forms():
    rng = np.random.default_rng(0)
    forms = [terms.pack_container(x)[:1] for x in (np.array([1, 5]), np.arange(5000), np.sort(rng.choice(65536, 30000, replace=False)))]
    assert forms == [terms.LIST, terms.RUNS, terms.BITS]


def test_bitmaps_over_several_chunks_and_merge(spark):
    n = 150_000
    df = spark.range(n).select(F.array(F.lit("all"), F.concat(F.lit("t"), F.col("id") % 7), F.concat(F.lit("t"), F.col("id") % 7)).alias("terms"), F.col("id").alias("number")).coalesce(1)
    maps = terms.term_bitmaps(df)
    by = {r["term"]: (r["n"], r["o"], r["c"]) for r in maps.groupBy("term").agg(F.sum("cardinality").alias("n"), F.sum("n_occurrences").alias("o"), F.count("*").alias("c")).collect()}
    assert by["all"] == (n, n, 3) and by["t0"] == ((n + 6) // 7, 2 * ((n + 6) // 7), 3)
    twice = terms.merge_bitmaps(maps.unionByName(maps))
    assert {r["term"]: r["n"] for r in twice.groupBy("term").agg(F.sum("cardinality").alias("n")).collect()} == {t: x[0] for t, x in by.items()}


def baskets(spark, rows):
    return spark.createDataFrame([(f"r{i}", b, "x") for i, b in enumerate(rows)], "record string, items array<string>, no string")


def brute(rows, least, share):
    sets = [{i for i in (b or []) if i is not None} for b in rows]
    single = Counter(i for s in sets for i in s)
    both = Counter(p for s in sets for p in combinations(sorted(s), 2))
    return {(a, b, n, single[a], single[b]) for (a, b), n in both.items() if n >= least and n * share >= len(rows)}


def test_pairs_like_brute_force_with_large_baskets(spark):
    rng = np.random.default_rng(3)
    rows = [[f"i{x:02}" for x in rng.choice(40, rng.integers(0, 6))] for _ in range(300)] + [[f"i{x:02}" for x in rng.permutation(40)] for _ in range(8)] + [None, [], [None], ["i01"], ["i01", "i01", None]]
    df = baskets(spark, rows)
    mentions = sum(len(b or []) for b in rows)
    for chunk, few in ((128, 500_000), (7, 500_000), (1, 0), (128, 0)):
        got = {tuple(r)[:5] for r in pairs.together(df, len(rows), mentions, 5, 40, chunk, few).collect()}
        assert got == brute(rows, 5, 40)
    assert len({i for b in brute(rows, 5, 40) for i in b[:2]}) <= pairs.frequent_bound(len(rows), mentions, 5, 40)
    row = pairs.together(df, len(rows), mentions, 5, 40).first()
    assert row["lift"] == round(row["n_ab"] * len(rows) / (row["n_a"] * row["n_b"]), 6)
    assert pairs.together(baskets(spark, []), 0, 0).count() == 0


def test_all_pairs_have_no_support_bound(spark, duck):
    rng = np.random.default_rng(4)
    rows = [[f"i{x:02}" for x in rng.choice(60, rng.integers(0, 5))] for _ in range(200)] + [[f"i{x:02}" for x in rng.permutation(40)], None, [None], ["i01", "i01", None]]
    df = baskets(spark, rows)
    for chunk, few in ((128, 500_000), (7, 0)):
        got = [tuple(r)[:5] for r in pairs.together(df, len(rows), sum(len(b or []) for b in rows), 1, None, chunk, few).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 1, len(rows))
    assert pairs.together(baskets(spark, []), 0, 0, 1, None).count() == 0
    sql = f"""WITH {records.RECORDS_SQL}, has AS (SELECT DISTINCT record, tag FROM spelt), single AS (SELECT tag, count(*) AS n FROM has GROUP BY tag),
      pair AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS n_ab FROM has x JOIN has y ON x.record = y.record AND x.tag < y.tag GROUP BY ALL)
      SELECT tag_a, tag_b, n_ab, a.n AS n_a, b.n AS n_b, round(n_ab::double * total.n / (a.n::double * b.n), 6) AS lift, round(log2(n_ab::double * total.n / (a.n::double * b.n)), 6) AS pmi
      FROM pair JOIN single a ON a.tag = tag_a JOIN single b ON b.tag = tag_b, total"""
    got = same(pairs.p2_all_pairs(spark, DATA), duck, sql)
    assert len(got) > 2 * pairs.p2_pairs(spark, DATA).count()


def test_queries_agree_with_sql(spark, duck):
    for name in queries.oracle_sql():
        same(queries.queries()[name](spark, DATA), duck, queries.oracle_sql()[name])
    assert plain([1.0, None]) == (1.0, "null")
