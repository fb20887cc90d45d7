"""The permutation round trip, the law of equal counts, and repeatability."""

import zlib

import numpy as np
import pytest

from cueglass.llm.sharding import place_of, row_at, shuffle_into_shards

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("total", [1, 2, 3, 40, 1000, 65_537])
def test_permutation(total):
    rows = np.arange(total)
    places = place_of(rows, total, 7)
    assert sorted(places.tolist()) == rows.tolist()
    assert (row_at(places, total, 7) == rows).all()
    if total > 100:
        assert (places != place_of(rows, total, 8)).any()
        assert abs(np.corrcoef(rows, places)[0, 1]) < 0.1


def test_shards_and_slots(spark):
    rows = [(i * 3 % 211, f"text é {i}") for i in range(211)] + [(None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = shuffle_into_shards(docs, 40, 1).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {len(rows) // 40, len(rows) // 40 + 1}
    # The place can be computed from the row's number alone.
    numbered = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32))
    places = place_of(np.arange(len(rows)), len(rows), 1)
    expected = sorted((str(r.doc_id), p % 40, p // 40) for r, p in zip(numbered, places, strict=True) if r.doc_id != 5)
    assert sorted((str(r.doc_id), r.shard, r.slot) for r in got if r.doc_id != 5) == expected
    again = shuffle_into_shards(docs.repartition(5), 40, 1).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty_table_and_clashing_columns(spark):
    assert shuffle_into_shards(spark.createDataFrame([], SCHEMA), 3, 1).collect() == []
    docs = spark.createDataFrame([(1, "a", 9, 9)], SCHEMA + ", size int, _tie int")
    assert [(r.doc_id, r.size, r.law, r.grown_shard) for r in shuffle_into_shards(docs, 3, 1).collect()] == [
        (1, 17, "rows", None)
    ]
