"""The conversation trie against one built turn by turn in memory."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from garimpo.llm import conversation_trie as ct
from garimpo.llm import queries

from .conftest import SF

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256")


def _brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            convs[conv].append(((turn is not None, turn or 0), said))
    convs = {c: [said for _, said in sorted(turns)] for c, turns in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    out = []
    for node, those in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:-1] == x for y in below if len(y) == len(x) + 1)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in those if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((those[0], len(node), parent, len(those), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def _ours(frame):
    assert frame.columns == list(COLUMNS)
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[:2])


def _frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def _some(seed, convs=40, words=2, longest=8):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        if pick.random() < 0.15:
            continue
        for t in range(pick.randint(1, longest)):
            role = pick.choice(["user", "assistant", None])
            rows.append((c, t, role, pick.choice(["", None, "é", "word"][: words + 2])))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_small_shards_and_blocks(spark, seed):
    rows = _some(seed, longest=11)
    assert _ours(ct.trie(_frame(spark, rows), shard=3, block=2)) == _brute(rows)


def test_one_shard(spark):
    rows = _some(9)
    assert _ours(ct.trie(_frame(spark, rows))) == _brute(rows)


def test_long_and_common_conversations(spark):
    long = [(3, t, "user", f"turn {t % 7}") for t in range(700)]
    twin = [(11, t, "user", f"turn {t % 7}") for t in range(650)]
    many = [(c, t, "user", "the same") for c in range(100, 160) for t in range(3)]
    rows = long + twin + many
    got = _ours(ct.trie(_frame(spark, rows)))
    assert len(got) == len({r[:2] for r in got})
    wanted = {}
    for row in _brute([r for r in rows if r[1] < 40]):
        wanted[row[:2]] = row
    shallow = [r for r in got if r[1] < 30]
    assert [(r[0], r[1], r[2], r[3], r[4], r[7]) for r in shallow] == [
        (r[0], r[1], r[2], r[3], r[4], r[7]) for r in wanted.values() if r[1] < 30
    ]
    assert max(r[1] for r in got) == 700 - zlib.crc32(b"3") % 9


def test_ugly(spark):
    rows = [
        (None, 0, "user", "no conversation"), (0, None, "user", "first"), (0, 0, None, None),
        (0, 0, "user", "tie"), (0, 0, "user", "tie"), (0, 1, "", ""), (1, 5, "user", "x"),
        (2, 0, "user", "tie"), (4, 2, None, "x" * 100_000), (9, 0, "user", "no base"),
        (14, 0, "a", "bc"), (19, 0, "ab", "c"),
    ]
    frame = _frame(spark, rows).selectExpr("*", "'x' AS number", "1 AS shard", "2 AS _part")
    assert _ours(ct.trie(frame)) == _brute(rows)
    assert ct.trie(frame.limit(0)).collect() == []


def test_query_on_whole_table(spark):
    rows = duckdb.sql(
        f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'"
    ).fetchall()
    assert _ours(queries.op13_conversation_trie(spark, SF)) == _brute(rows)
