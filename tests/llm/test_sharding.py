import random
import zlib

import numpy as np
import pytest

from votescore.llm.sharding import permuted, place, sharded


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 1000, 4097, 65_537])
def test_permutation(n):
    out = permuted(np.arange(n), n)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 100 or (out != permuted(np.arange(n), n, seed=7)).any()
    assert n < 1000 or abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.1


@pytest.mark.parametrize("rows", [0, 1, 15, 16, 333])
def test_rows_per_shard_and_slots(spark, rows):
    rng = random.Random(rows)
    data = [(rng.choice([i, None, 5]), rng.choice([f"té {i}", None, "", "same"])) for i in range(rows)]
    found = sharded(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in data) == sorted(
        (str(r.doc_id), r.size, r.text_crc32) for r in found)
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Places follow from the row number alone, and numbers from the order of ids.
    shard, slot = place(np.array([r.row_number for r in found], np.int64), rows)
    assert [(r.shard, r.slot) for r in found] == list(zip(shard.tolist(), slot.tolist()))
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.row_number)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_same_places_however_the_table_is_split(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text")
    one, many = (sorted(map(tuple, sharded(docs.repartition(n)).collect())) for n in (1, 9))
    assert one == many
