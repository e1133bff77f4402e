from datetime import datetime

from pyspark.sql import functions as F

from mnestra.sources import rows

ID = "0f8fad5b-d9cb-469f-a165-70867728950e"
SHAPE = "id string, content string, importance double, tags string, memory_type string, created_at string, updated_at string, decay_score double, source_session string, ttl_days int, archived int, insert_seq long, extra int"


def test_lenient_decoding_and_round_trip(spark):
    raw = spark.createDataFrame(
        [
            (ID, "x", 5.0, '["a",null,"b"]', "Decision", "2024-05-01T10:00:00.250+02:00", "2024-05-01T08:00:00Z", None, None, None, None, 1, 0),
            (ID.replace("-", "").upper(), None, None, "{bad", "odd", "soon", None, 0.5, "s", 3, 1, 2, 0),
            ("no id", "y", 1.0, "[]", "fact", None, None, 1.0, None, None, 0, 3, 0),
            (None, "z", 1.0, None, None, None, None, None, None, None, None, 4, 0),
        ],
        SHAPE,
    )
    got = rows.decode(raw).orderBy("insert_seq").collect()
    assert len(got) == 2
    a, b = got
    assert (a["tags"], a["memory_type"], a["decay_score"], a["archived"]) == (["a", "b"], "decision", 1.0, False)
    assert (a["created_at"], a["updated_at"]) == (datetime(2024, 5, 1, 8, 0, 0, 250000), datetime(2024, 5, 1, 8))
    assert (b["tags"], b["memory_type"], b["created_at"], b["archived"], b["ttl_days"]) == ([], "fact", None, True, 3)
    again = rows.decode(rows.encode(rows.decode(raw).withColumn("extra", F.lit(1)))).orderBy("insert_seq").collect()
    assert again == got
    assert rows.decode(raw.limit(0)).count() == 0
