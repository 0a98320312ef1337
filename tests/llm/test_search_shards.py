"""Top-k search and resharding against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from garimpo.llm import queries, sharding
from garimpo.llm import topk_search as ts

from .conftest import SF


def _plain_top(vectors, k=20, every=20):
    fine = [
        (i, [math.floor(64 * x) for x in v]) for i, v in vectors
        if i is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    asked = {}
    for i, v in fine:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = set()
    for query, q in asked.items():
        scored = sorted(
            (-sum(a * b for a, b in zip(q, v)), i)
            for i, v in fine if i != query and len(v) == len(q)
        )
        out |= {(query, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def _rows(frame):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in frame.collect()}


def test_query(spark):
    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    assert _rows(queries.op7_topk_search(spark, SF)) == _plain_top(vectors)


def test_blocks_and_copies(spark, monkeypatch):
    """Many blocks, a vector that a third of the rows share, ties."""
    monkeypatch.setattr(ts, "BLOCK_VECTORS", 150)
    monkeypatch.setattr(ts, "BLOCK_QUERIES", 11)
    chance = random.Random(6)
    common = [chance.uniform(-1, 1) for _ in range(12)]
    vectors = [
        (i, common if i % 3 == 0 else [round(chance.uniform(-1, 1), 1) for _ in range(12)])
        for i in range(900)
    ]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    exact = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert _rows(ts.top_k(frame)) == _plain_top(exact)


def test_reading_stops_early(monkeypatch):
    """With one strong dimension a fraction of the lists settles a query."""
    chance = np.random.default_rng(8)
    x = np.floor(64 * chance.normal(size=(2000, 6)) * np.array([30, 1, 1, 1, 1, 1]))
    q = np.floor(64 * np.array([[1.0, 0.01, 0, 0, 0, 0]]))
    read = []
    resolved = ts._resolved
    monkeypatch.setattr(
        ts, "_resolved", lambda *a: read.append(len(a[4])) or resolved(*a)
    )
    rows = ts.best_of_block(x, np.arange(2000), q, np.array([-1]), 5)
    scores = x @ q[0]
    order = np.lexsort((np.arange(2000), -scores))[:5]
    assert [r[1] for r in rows] == order.tolist()
    assert read and read[0] < 500


def test_bounds_settle_all_queries_of_the_table(monkeypatch):
    """64 dimensions, none of them strong: every query is settled before the lists end."""
    rows = duckdb.sql(
        "SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id"
    ).fetchall()
    ids, x = np.array([i for i, _ in rows]), ts.quantised([v for _, v in rows], 64)
    asked = ids % 20 == 0
    settled = []
    resolved = ts._resolved
    monkeypatch.setattr(
        ts, "_resolved", lambda *a: settled.append((len(a[4]), a[6])) or resolved(*a)
    )
    found = ts.best_of_block(x, ids, x[asked], ids[asked], 20)
    assert len(settled) == asked.sum() == 100
    assert all(rest <= len(x) // 16 and read < len(x) for rest, read in settled)
    wanted = set()
    for number, query in zip(ids[asked], x[asked]):
        scores = x @ query
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != number][:20]
        wanted |= {(number, ids[i], scores[i]) for i in order}
    assert set(found) == wanted and len(found) == 2000


def test_bounds_hold():
    chance = np.random.default_rng(9)
    x = np.floor(64 * chance.normal(size=(300, 8)))
    q = np.floor(64 * chance.normal(size=(7, 8)))
    scores = x @ q.T
    lists = ts.SortedLists(x)
    for depth in (1, 10, 150, 299, 300):
        low, high = lists.bounds(q, depth)
        assert (low <= scores + 1e-6).all() and (scores <= high + 1e-6).all()
    assert np.allclose(low, scores) and np.allclose(high, scores)


def test_ugly_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, [0.5, -0.25]), (20, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]),
        (None, [1.0, 1.0]), (1, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [1.0]), (3, []), (100, []),
        (120, [1.0, 2.0]), (120, [0.5, 2.0]), (5, [1e30, -1e30]),
    ]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    frame = frame.withColumns({"dim": F.lit("x"), "score": F.lit(1), "query_id": F.lit(2)})
    rows = sorted(ts.top_k(frame, k=3).collect())
    assert [r.vec_id for r in rows if r.query_id == 0][:1] == [5]
    limit = np.iinfo(np.int64)
    assert all(limit.min <= r.score <= limit.max for r in rows)
    assert {r.query_id for r in rows} == {0, 100, 120}
    assert [(r.vec_id, r.score) for r in rows if r.query_id == 100] == [(3, 0)]
    plain = [v for v in vectors if v[0] != 5]
    frame = spark.createDataFrame(plain, "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ts.top_k(frame, k=9).collect())
    assert [g[2:] for g in got if g[0] == 0] == [(1, 1280), (1, 1280), (120, 0), (120, -1024)]
    assert ts.top_k(frame.limit(0)).count() == 0


# Sharding ---------------------------------------------------------------------------


def _least_moved(sizes, capacities):
    """Bytes over capacity must move, no others."""
    return sum(max(0, size - capacities.get(i, 0)) for i, size in sizes.items())


def test_cheapest_flow():
    chance = random.Random(1)
    for old, new in itertools.product((1, 3, 7), (1, 2, 5, 9)):
        sizes = {i: chance.randrange(0, 1000) for i in range(old)}
        capacities = sharding.even_capacities(sum(sizes.values()), new)
        flow = sharding.cheapest_flow(sizes, capacities)
        for i, size in sizes.items():
            assert sum(n for (a, _), n in flow.items() if a == i) == size
        for j, room in capacities.items():
            assert sum(n for (_, b), n in flow.items() if b == j) == room
        moved = sum(n for (a, b), n in flow.items() if a != b)
        assert moved == _least_moved(sizes, capacities)
        assert len(flow) <= 2 * (old + new)


def _check_shards(rows, texts, shards):
    sizes, slots, total = {}, {}, 0
    for row in rows:
        assert 0 <= row.shard < shards and row.law == "bytes" and row.grown_shard is None
        sizes[row.shard] = sizes.get(row.shard, 0) + row.size
        slots.setdefault(row.shard, []).append(row.slot)
        total += row.size
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    made = sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in rows)
    wanted = sorted(
        (n is None, n, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
        for n, t in texts
    )
    assert made == wanted
    return sizes, total


def test_query_shards(spark):
    sf = "/root/testdata/sf0.01"
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    sizes, total = _check_shards(queries.op8_sharding(spark, sf).collect(), texts, 24)
    even = total / 24
    assert len(sizes) == 24
    assert all(abs(size - even) <= 0.03 * even for size in sizes.values())


def test_few_bytes_move(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("row"), (50 + F.col("id") % 100).alias("size"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("int").alias("shard"),
        F.col("id").alias("kept_column"),
    )
    before = {r["row"]: r for r in rows.collect()}
    after = sharding.reshard(rows, 9).collect()
    sizes = {}
    for r in before.values():
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    moved = sum(r["size"] for r in after if r.shard != before[r["row"]].shard)
    least = _least_moved(sizes, sharding.even_capacities(sum(sizes.values()), 9))
    # Shards end within a document of even, so a little less may do.
    assert 0.99 * least <= moved <= 1.02 * least
    assert all(r.kept_column == r["row"] for r in after)


def test_files(spark, tmp_path, documents):
    old, new = f"{tmp_path}/old", f"{tmp_path}/new"
    frame = spark.createDataFrame(documents, "doc_id bigint, text string")
    shard = F.when(F.col("doc_id") % 2 == 0, 0).otherwise(F.col("doc_id") % 5).cast("int")
    frame.withColumn("shard", shard).write.partitionBy("shard").parquet(old)
    folders = {r.shard: r.folder for r in sharding.reshard_folder(spark, old, new, 6).collect()}
    assert sorted(folders) == list(range(6))
    rows, sizes = [], []
    for folder in folders.values():
        own = [(r.doc_id, r.text) for r in spark.read.parquet(folder).collect()]
        sizes.append(sum(len(t.encode()) + 8 for _, t in own))
        rows += own
    assert sorted(rows) == sorted(documents)
    assert max(sizes) - min(sizes) < 0.1 * sum(sizes) / 6
    assert spark.read.parquet(old).count() == len(documents)


def test_ugly_documents(spark, ugly, empty):
    texts = [(r.doc_id, r.text) for r in ugly.collect()]
    rows = sharding.reshard_documents(ugly, F.lit(3), 4).collect()
    _check_shards(rows, texts, 4)
    assert sharding.reshard_documents(empty, F.lit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 5])
def test_one_hot_shard(spark, shards):
    rows = spark.range(500).select(
        F.col("id").alias("row"), F.lit(100).cast("long").alias("size"), F.lit(7).alias("shard")
    )
    counts = sharding.reshard(rows, shards).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in counts) == [500 // shards] * shards


def _shard_folder(path):
    """Folder of the shards and number of the shard that a file belongs to."""
    folder, shard = re.fullmatch(r".*/([^/]+)/shard=(\d+)/[^/]+", path).groups()
    return folder[:3], int(shard)


def _lie(texts):
    """(shard by its row, folder and shard by its file, doc_id, text) of every row."""
    rows = texts.withColumn("file", F.input_file_name()).collect()
    return [(r.shard, *_shard_folder(r.file), r.doc_id, r.text) for r in rows]


def test_documents_lie_in_their_new_shards(spark, documents):
    """Rows come from files of shards, which hold the texts."""
    texts = [(i, t) for i, t in documents[:200]] + [(None, None), (7, None), (7, "")]
    texts += [(1000 + i, "x" * 992) for i in range(40)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = sharding.reshard_documents(frame, F.lit(2), 4)
    rows = found.collect()
    _check_shards(rows, texts, 4)
    assert all(_shard_folder(path)[0] in ("old", "new") for path in found.inputFiles())
    lie = _lie(sharding.reshard_texts(frame, F.lit(2), 4))
    assert all(shard == there for shard, _, there, _, _ in lie)
    assert Counter((n, t) for *_, n, t in lie) == Counter(texts)
    assert Counter((shard, n, zlib.crc32((t or "").encode())) for shard, _, _, n, t in lie) == Counter(
        (r.shard, r.doc_id, r.text_crc32) for r in rows
    )


def test_files_of_other_shards_stay(spark):
    """Shards 0 and 3 have their share; 1 gives half of what it has to 2."""
    even = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("y" * 92).alias("text"))
    old = F.when(F.col("doc_id") < 10, 0).when(F.col("doc_id") < 30, 1).otherwise(3)
    lie = _lie(sharding.reshard_texts(even, old, 4))
    assert {n for shard, *_, n, _ in lie if shard == 0} == set(range(10))
    assert {n for shard, *_, n, _ in lie if shard == 3} == set(range(30, 40))
    assert Counter((shard, folder) for shard, folder, *_ in lie) == {
        (0, "old"): 10, (1, "new"): 10, (2, "new"): 10, (3, "old"): 10
    }
    lie = _lie(sharding.reshard_texts(even, F.col("doc_id") % 4, 4))
    assert len(lie) == 40 and all(s == n % 4 and folder == "old" for s, folder, _, n, _ in lie)
