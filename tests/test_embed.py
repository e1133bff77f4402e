import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnestra.functions import embed


@pytest.fixture
def vocabulary(tmp_path):
    file = tmp_path / "vocab.txt"
    file.write_text("[PAD]\n\n[UNK]\n[CLS]\n[SEP]\nhello\nworld\nwo\n##rld\n##s\n!\n")
    return embed.read_vocabulary(str(file))


def test_vocabulary_counts_blank_lines(vocabulary):
    assert vocabulary["[UNK]"] == 2 and vocabulary["hello"] == 5


def test_word_pieces(vocabulary):
    t = embed.WordPiece(vocabulary, 10)
    assert t.encode("Hello WORLDS!") == [3, 5, 6, 9, 10, 4, 0, 0, 0, 0]
    assert t.encode("hellox") == [3, 2, 4] + [0] * 7
    assert t.encode("") == t.encode(None) == [3, 4] + [0] * 8
    assert t.encode("hello " * 50) == [3] + [5] * 8 + [4]


def test_default_special_ids():
    t = embed.WordPiece({"x": 1}, 4)
    assert t.encode("y") == [101, 100, 102, 0]


def test_word_piece_column(spark, vocabulary):
    df = spark.createDataFrame([("hello",), (None,)], "s string").select(embed.word_piece_ids(F.col("s"), embed.WordPiece(vocabulary, 4)).alias("ids"))
    got = df.select("ids", embed.attention_mask(F.col("ids")).alias("mask")).collect()
    assert [r["ids"] for r in got] == [[3, 5, 4, 0], [3, 4, 0, 0]] and got[0]["mask"] == [1, 1, 1, 0]


def test_hash_embedding():
    x = embed.HashEmbedder(8).embed_batch(["ab", "", None, "é"])
    raw = np.array([(97, 98)[i % 2] / 255 + math.sin(0.1 * i) for i in range(8)])
    assert np.allclose(x[0], raw / np.linalg.norm(raw), atol=1e-6)
    assert not x[1].any() and not x[2].any()
    signed = np.array([(0xC3 - 256, 0xA9 - 256)[i % 2] / 255 + math.sin(0.1 * i) for i in range(8)])
    assert np.allclose(x[3], signed / np.linalg.norm(signed), atol=1e-6)


def test_mock_embedding(spark):
    df = spark.createDataFrame([("x",), ("",), (None,)], "content string")
    by_udf = [list(r["embedding"]) for r in embed.embed(df, embed.MockEmbedder(3)).collect()]
    by_column = [list(r[0]) for r in df.select(embed.mock_embedding(F.col("content"), 3)).collect()]
    assert by_udf == by_column == [[1.0, 0.0, 0.0], [0.0] * 3, [0.0] * 3]
