import numpy as np
import pytest
from conftest import DATA

from mnestra.llm import neighbours as nb

DIM = 64


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], d, "clash", 1) for i, v, d in rows], "id string, embedding array<float>, deleted boolean, ref string, a int")


def clustered(n, seed=0):
    """Half of the vectors in small groups of near ones, half alone."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, DIM))
    for s in range(0, n // 2, 5):
        x[s + 1 : s + 5] = x[s] + rng.uniform(0.05, 0.45) * rng.standard_normal((min(4, n - s - 1), DIM))
    return (x * rng.uniform(0.2, 5, (n, 1))).astype("f4")


def brute(ids, x, k, floor):
    u = nb.unit(np.asarray(x))
    out = {}
    for i, v in enumerate(u):
        s = nb.similarity(u, v[None])
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[ids[i]] = [ids[j] for j in order if s[j] >= floor]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


@pytest.mark.parametrize("list_size", [16_384, 40])
def test_recall_against_brute_force(spark, list_size):
    x = clustered(3000)
    ids = np.array([f"v{i:05}" for i in range(len(x))])
    df = table(spark, list(zip(ids.tolist(), x, [False] * len(x)))).repartition(4)
    got = lists(nb.nearest(df, 5, 0.8, nb.IndexConfig(list_size=list_size)))
    want = {k: v for k, v in brute(ids, x, 5, 0.8).items() if v}
    pairs = lambda d: {(a, b) for a, bs in d.items() for b in bs}
    assert len(pairs(want)) > 1000
    assert len(pairs(got) & pairs(want)) / len(pairs(want)) > 0.97
    assert len(pairs(got) & pairs(want)) / len(pairs(got)) > 0.97


def test_split_files_give_the_pairs_of_whole_ones():
    x = nb.unit(clustered(400)).astype("f4")
    refs = np.arange(400)

    def pairs(size):
        index = nb.PermutationIndex(x, 400, nb.IndexConfig(pivots=64, list_size=size))
        columns = index.post(refs, x)
        order = np.argsort(columns[0], kind="stable")
        out = [(a, b) for out in index.meet([c[order] for c in columns], 500) for a, b in zip(out[0].tolist(), out[1].tolist())]
        assert len(out) == len(set(out))  # a pair is put out once
        return set(out), index.blocks

    whole, none = pairs(10**6)
    split, some = pairs(12)
    assert not none and some and whole == split


def test_copies_crowd_no_file():
    x = np.concatenate([np.repeat(clustered(1), 500, 0), clustered(500, 2)])
    assert not nb.PermutationIndex(x, 10**9, nb.IndexConfig(list_size=10**8)).blocks


def test_footrule():
    a, b = np.array([[1, 2, 3, 4]], "i2"), np.array([[2, 1, 9, 3]], "i2")
    place = lambda p, x: list(p).index(x) if x in p else len(p)
    want = sum(abs(place(a[0], x) - place(b[0], x)) for x in {1, 2, 3, 4, 9})
    assert nb.footrule(a, b)[0] == want and nb.footrule(a, a)[0] == 0


def test_copies_ties_and_dirt(spark):
    rng = np.random.default_rng(1)
    v, w = rng.standard_normal(DIM), rng.standard_normal(DIM)
    nan = v.copy()
    nan[3] = np.nan
    rows = [(f"c{i:02}", v, False) for i in range(9)] + [("C00 ", v, False), ("c00", v, False), ("gone", v, True), ("null", None, False), ("short", v[:5], False), ("zero", v * 0, False), ("nan", nan, False), (None, v, False), (" ", v, False), ("hole", [None, *v[1:]], False), ("far", w, None), ("n1", v + 0.01 * w, False)]
    got = lists(nb.nearest(table(spark, rows).coalesce(1), 5, 0.8))
    assert got["n1"] == [f"c{i:02}" for i in range(5)]
    assert got["c00"] == ["c01", "c02", "c03", "c04", "c05"] and got["c05"] == [f"c{i:02}" for i in range(5)]
    assert not {"far", "gone", "null", "short", "zero", "nan", "hole"} & (set(got) | {x for y in got.values() for x in y})
    late = lists(nb.copies(table(spark, rows).repartition(3), 5))
    assert late == {f"c{i:02}": [f"c{j:02}" for j in range(5)] for i in range(6, 9)}
    found = {tuple(r) for r in nb.mutual(nb.nearest(table(spark, rows), 5, 0.8)).collect()}
    want = {(f"c{i:02}", f"c{j:02}") for i in range(6) for j in range(i + 1, 6)}
    assert found == want


def test_empty_and_tiny(spark):
    assert nb.nearest(table(spark, [])).count() == 0
    assert nb.nearest(table(spark, [("a", None, False)])).count() == 0
    assert nb.copies(table(spark, [])).count() == 0
    v = np.ones(DIM)
    assert nb.nearest(table(spark, [("a", v, False)])).count() == 0
    assert lists(nb.nearest(table(spark, [("a", v, False), ("b", 2 * v, False)]))) == {"a": ["b"], "b": ["a"]}


@pytest.mark.parametrize("block", [65_536, 500])
def test_all_neighbours_are_those_of_brute_force(spark, block):
    x = clustered(1500, 4)
    ids = np.array([f"v{i:05}" for i in range(len(x))])
    df = table(spark, list(zip(ids.tolist(), x, [False] * len(x)))).repartition(3)
    want = brute(ids, x, 5, 0)
    assert min(map(len, want.values())) == 5
    assert lists(nb.nearest_of_all(df, 5, block=block)) == want


@pytest.mark.parametrize("sides", ["one", "two"])
def test_tiles_miss_nothing(sides):
    rng = np.random.default_rng(5)
    x = clustered(400, 6)
    x[50:70] = x[50] * rng.uniform(1, 2, (20, 1))  # alike but for their length
    ids = np.array([f"v{i // 2:03}" for i in range(400)], dtype=object)  # each id has two vectors
    left = np.ones(400, bool) if sides == "one" else np.arange(400) < 150
    got = {}
    for i, j, s in zip(*nb.all_against_all(ids, x, left, 5, (32, 64))):
        got.setdefault(i, []).append((s, ids[j]))
    u = nb.unit(x)
    for i in range(400):
        best = {}
        for j, s in enumerate(nb.similarity(u, u[i][None])):
            if ids[j] != ids[i] and (sides == "one" or left[i] != left[j]):
                best[ids[j]] = max(s, best.get(ids[j], 0))
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:5]
        assert [n for n, _ in want] == [n for _, n in got[i]]


def test_all_neighbours_with_copies_and_dirt(spark):
    rng = np.random.default_rng(1)
    v, w = rng.standard_normal(DIM), rng.standard_normal(DIM)
    rows = [(f"c{i:02}", v, False) for i in range(9)] + [("C00 ", v, False), ("c08", w, False), ("gone", v, True), ("short", v[:5], False), (None, v, False), ("far", w, None)]
    for parts in (1, 3):
        got = lists(nb.nearest_of_all(table(spark, rows).repartition(parts), 5))
        assert set(got) == {f"c{i:02}" for i in range(9)} | {"far"}
        assert got["c00"] == [f"c{i:02}" for i in range(1, 6)] and got["c07"] == [f"c{i:02}" for i in range(5)]
        assert got["c08"] == [f"c{i:02}" for i in range(5)]  # by its copy of v; "far" is a copy of its other vector
        assert got["far"] == ["c08", "c00", "c01", "c02", "c03"]
    assert nb.nearest_of_all(table(spark, [])).count() == 0
    assert nb.nearest_of_all(table(spark, [("a", v, False)])).count() == 0


def test_every_usable_id_has_its_neighbours(spark):
    got = nb.p3_neighbours(spark, DATA)
    usable = nb._clean(nb.table(spark, DATA, "vectors"), DIM).select("id").distinct()
    assert got.groupBy("id").count().where("count = 5").count() == usable.count() > 100


def test_candidates_are_the_best_by_footrule(spark):
    """Without a bound each vector's candidates are those of least footrule distance among all it meets."""
    x = clustered(600, 8)
    ids = [f"v{i:05}" for i in range(len(x))]
    df = table(spark, list(zip(ids, x, [False] * len(x))))
    met = {}
    for keep in (3, 10**6):
        config = nb.IndexConfig(footrule=1.0, keep=keep)
        met[keep] = {(r["a"], r["b"]): r["footrule"] for r in nb.candidates(df, nb.fit(df, config=config)).collect()}
    sides = {}
    for (a, b), d in met[10**6].items():
        sides.setdefault(a, []).append((d, a, b))
        sides.setdefault(b, []).append((d, a, b))
    want = {(a, b) for v in sides.values() for d, a, b in v if sum(o < d for o, _, _ in v) < 3}
    assert set(met[3]) == want and len(want) < len(met[10**6])


def test_recall_of_the_whole_lists(spark):
    """Queries are the vectors whose number is divisible by 50, neighbours near or far."""
    x = clustered(4000, 9)
    ids = np.array([f"v{i:05}" for i in range(len(x))])
    df = table(spark, list(zip(ids.tolist(), x, [False] * len(x)))).repartition(3)
    got, want = lists(nb.nearest_whole(df)), brute(ids, x, 5, 0)
    asked = ids[::50]
    assert all(len(got[i]) == 5 for i in ids)
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in asked]) >= 0.98
