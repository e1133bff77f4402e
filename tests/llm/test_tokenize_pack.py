import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnestra.llm import pack, tokenize
from mnestra.llm.bpe import BytePairEncoder, EncodedText

PATH = pytest.importorskip("public_tokenizers").path
SIGNS = "  \n\t\x1c　 ab'stllveré0９½٣—…́漢\U0001f600\x85=-"


@pytest.fixture(scope="module")
def encoder():
    return BytePairEncoder(open(tokenize.default_rank_file(), "rb").read())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=SIGNS, max_size=40) | st.text(max_size=40).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)))
def test_like_the_public_library(encoder, reference, text):
    assert list(encoder.encode(text)) == reference(text)
    assert encoder.count(text) == len(reference(text))


def test_special_strings_long_words_and_long_texts(encoder, reference):
    for text in ("<|endoftext|>", "a" * 3000, "=" * 2000, " " * 500 + "x", "ab" * 700 + "\n\n  \n y", "don't DON'T l'été", "word " * 300_000):
        assert list(encoder.encode(text)) == reference(text)
        assert encoder.count(text) == len(reference(text))
    assert encoder.encode(None) == encoder.encode("") == [] and encoder.count(None) == 0


def test_each_prefix_has_the_last_token_of_its_encoding(encoder, reference):
    word = "electroencephalographically"
    assert encoder.extend(word.encode(), []) == [reference(word[: i + 1])[-1] for i in range(len(word))]


def test_appends_and_edits(encoder):
    rng = random.Random(1)
    sign = lambda n: "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, n)))
    for _ in range(150):
        x = EncodedText(encoder, "The quick brown fox, l'été 2024. " * 3)
        for _ in range(4):
            if rng.random() < 0.4:
                x.append(sign(8))
            else:
                a = rng.randint(0, len(x.text))
                x.replace(a, min(len(x.text), a + rng.randint(0, 6)), sign(6))
            assert x.ids == list(encoder.encode(x.text))
    long = EncodedText(encoder, "some words in a row " * 2000)
    long.replace(20_000, 20_003, "xyz")
    assert long.redone < 100 and long.ids == list(encoder.encode(long.text))


def test_columns(spark, reference):
    texts = ["Hello world", None, "", "  \n", "漢字 " * 50, "x" * 5000]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    got = {r["doc_id"]: list(r["ids"]) for r in tokenize.token_ids(df).collect()}
    assert got == {i: reference(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokenize.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert tokenize.token_ids(df.limit(0)).count() == 0 and tokenize.token_counts(df.limit(0)).count() == 0


def check(sizes, bins, capacity):
    load, count, cost = (np.bincount(bins, w) for w in (sizes, np.ones(len(sizes)), sizes.astype("f8") ** 2))
    assert (load <= capacity.tokens).all() and (count <= capacity.documents).all() and (cost <= capacity.vector()[2]).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=150), st.integers(1, 9), st.sampled_from([None, 6000.0, 8000.0]), st.sampled_from(["norm", "dot"]))
def test_best_fit_keeps_every_bound(sizes, documents, attention, rule):
    capacity = pack.Capacity(100, documents, attention)
    sizes = np.minimum(np.array(sizes), int(capacity.vector()[2] ** 0.5))
    bins = pack.best_fit(sizes, capacity, rule=rule)
    assert (bins >= 0).all() and set(bins) == set(range(bins.max() + 1))
    check(sizes, bins, capacity)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_tight_attention_is_kept(rule):
    sizes = np.random.default_rng(2).integers(0, 60, 300)
    capacity = pack.Capacity(100, 50, 1000.0)  # under tokens squared / 2
    assert capacity.vector()[2] == 1000
    bins = pack.best_fit(sizes, capacity, rule=rule)
    cost, count = np.bincount(bins, sizes.astype("f8") ** 2), np.bincount(bins)
    assert (count[cost > 1000] == 1).all() and (cost[count > 1] <= 1000).all() and count.max() > 1
    assert np.bincount(bins, sizes).max() <= 100 and (bins >= 0).all()


def test_best_fit_leaves_little_space():
    sizes = np.minimum(4096, np.random.default_rng(0).lognormal(6, 0.8, 8000).astype("i8"))
    for rule in ("norm", "dot"):
        bins = pack.best_fit(sizes, rule=rule)
        check(sizes, bins, pack.Capacity())
        assert sizes.sum() / 4096 / (bins.max() + 1) > 0.995


def test_pack(spark):
    rows = [(1, 5000), (1, 5000), (2, 4096), (3, 10), (4, 0), (5, None), (None, 7), (None, 7), (6, 9000), (2**60 + 1, 3)]
    df = spark.createDataFrame([(a, b, 0, 0) for a, b in rows], "doc_id long, n long, shard int, container int")
    got = pack.pack(df, "doc_id", "n", n_items=len(rows), shard_items=4).collect()
    whole = {}
    for r in got:
        whole.setdefault(r["doc_id"], []).append((r["piece"], r["size"]))
        assert r["n_pieces"] == max(1, -(-{1: 5000, 6: 9000}.get(r["doc_id"], 1) // 4096))
    assert {k: sorted(v) for k, v in whole.items()} == {1: [(0, 4096), (1, 904)], 2: [(0, 4096)], 3: [(0, 10)], 4: [(0, 0)], 5: [(0, 0)], None: [(0, 7)], 6: [(0, 4096), (1, 4096), (2, 808)], 2**60 + 1: [(0, 3)]}
    load = {}
    for r in got:
        load[r["shard"], r["container"]] = load.get((r["shard"], r["container"]), 0) + r["size"]
    assert max(load.values()) <= 4096
    assert pack.pack(df.limit(0), "doc_id", "n").count() == 0


def test_every_bound_holds_and_binds(spark):
    """Rows of the registered query's capacities: none is broken, and each decides somewhere."""
    cap = pack.BOUNDED
    rng = np.random.default_rng(2)
    sizes = np.concatenate([rng.integers(0, 60, 900), rng.integers(60, 3000, 900), rng.integers(2900, 9000, 60)]).tolist()
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n long").repartition(3)
    packed = pack.pack(df, "doc_id", "n", cap, n_items=len(sizes), shard_items=500)
    got = pack.containers(packed, cap).collect()
    assert packed.rdd.getNumPartitions() == 4 and {r["shard"] for r in got} == {0, 1, 2, 3}
    assert sum(r["n_tokens"] for r in got) == sum(sizes) and all(r["unused"] == cap.tokens - r["n_tokens"] >= 0 for r in got)
    assert all(r["n_pieces"] <= cap.documents and (r["attention"] <= cap.attention or r["n_pieces"] == 1) for r in got)
    assert any(r["n_pieces"] == cap.documents and r["unused"] > 60 for r in got)  # documents bind
    assert any(r["attention"] > 0.9 * cap.attention and r["unused"] > 500 for r in got)  # attention binds
    assert any(r["unused"] < 5 for r in got)  # tokens bind
