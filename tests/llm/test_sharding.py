import zlib
from collections import Counter

from tierblend.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot string"


def test_matrix_sums():
    sizes = [5, 0, 17, 100, 3]
    m = sharding.communication_matrix(sizes, 16, 5)
    assert m.sum(axis=1).tolist() == sizes
    assert set(m.sum(axis=0).tolist()) <= {7, 8} and (m >= 0).all()


def test_sizes_slots_and_repeats(spark):
    rows = [(i % 150 if i % 7 else None, None if i % 11 == 0 else "é" * (i % 13), "x", "y") for i in range(203)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sharding.shuffle_shards(docs, block_rows=20).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == 406 and len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    want = Counter((a, len((b or "").encode()) + 1, zlib.crc32((b or "").encode())) for a, b, _, _ in rows)
    assert want == Counter((r.doc_id, r["size"], r.text_crc32) for r in out)
    assert sharding.shuffle_shards(docs.where("false")).count() == 0
