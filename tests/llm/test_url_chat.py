"""URL rules and chat trees against plain Python; the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from garimpo.llm import chat_tree as chat
from garimpo.llm import queries
from garimpo.llm import url_filter as uf
from garimpo.llm.common import table

from .conftest import SF


def _plain_parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]), found[2]


def _plain_rule(url):
    host, path = _plain_parts(url)
    fits = [
        rule for rule in uf.RULES
        if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)
    ]
    return max(fits, key=lambda rule: len(rule.name), default=None)


def test_query_rules(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall())
    rows = queries.op4_url_filter(spark, SF).collect()
    assert len(rows) == len(pages)
    for row in rows:
        rule = _plain_rule(pages[row.page_id])
        assert (row.host, row.path) == _plain_parts(pages[row.page_id])
        assert row.rule == (rule.name if rule else None)
        assert row.verdict == rule.verdict if rule else row.verdict in ("allow", "block")


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://A.B.ORG", "http://org/", "http://xorg/",
    "http://x.Example.ORG/es/1", "http://x.example.org/en/12?q=/es/", "http://example.org/en/2",
    "http://a.com/fr/", "http://a.com/de/x#y", "http://a.com/fr", "x://a.com?b=c://d.org/",
    "http://É.com/de/", "http://a.org:80/x", "http://a.com/de/" + "x" * 60_000, "a\nb://c.com/de/\n",
]


def test_ugly_urls(spark):
    rows = [(None if i % 5 == 0 else i, url, "x", "y") for i, url in enumerate(URLS)] * 2
    frame = spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict string")
    got = uf.judge(frame).collect()
    wanted = Counter()
    for number, url, *_ in rows:
        rule = _plain_rule(url)
        wanted[number, *_plain_parts(url), rule.name if rule else None] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == wanted
    assert all(r.verdict in ("allow", "block") for r in got)
    assert uf.judge(frame.limit(0)).count() == 0
    assert {r.verdict for r in uf.judge(frame, rules=()).collect()} == {"allow"}


def test_trees_learn_what_urls_look_like(spark):
    """Blocked hosts have long numbers; so are unlabelled ones judged."""
    chance = random.Random(2)

    def url(host, bad):
        path = "".join(chance.choices("0123456789" if bad else "abcdefg", k=30))
        return f"http://{host}/{path}"

    hosts = [("fine.site", False), ("evil.site", True), ("x.net", False), ("x.net", True)]
    rows = [(i, url(*hosts[i % 4])) for i in range(1200)]
    rules = (uf.Rule("fine.site", "/", "allow"), uf.Rule("evil.site", "/", "block"))
    got = uf.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()
    right = [(r.verdict == "block") == hosts[r.page_id % 4][1] for r in got if r.host == "x.net"]
    assert len(right) == 600 and sum(right) >= 0.95 * len(right)


def test_entropy(spark):
    frame = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("aé日👍",)], "t string")
    values = [r.e for r in frame.select(uf._entropy(F.col("t")).alias("e")).collect()]
    assert values == pytest.approx([0, 0, 1, 2])


def test_main_path_is_native(spark):
    plan = queries.op4_url_filter(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Chat -------------------------------------------------------------------------------

NASTY = st.lists(
    st.sampled_from([*"[]<>/\\ab\n ", "[INST]", "</s>", "[/INST]", "[ROLE]"])
).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a]b"]), NASTY)))
def test_round_trip(turns):
    assert chat.parse("".join(chat.format_turn(*turn)[0] for turn in turns)) == turns


def _plain_digests(rows):
    by = {}
    for number, turn, role, text in rows:
        by.setdefault(number, []).append(
            ((turn is not None, turn), (role is not None, role), (text is not None, text))
        )
    out = {}
    for number, turns in by.items():
        turns.sort(key=lambda t: (t[0][0], t[0][1] or 0, t[1][0], t[1][1] or "", t[2][0]))
        turns = [(role or "", text or "") for _, (_, role), (_, text) in turns]
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        learnt = "".join(text for role, text in turns if role == "assistant")
        out[number] = (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt),
            hashlib.sha256(learnt.encode()).hexdigest(),
            sum(len(chat.format_turn(*turn)[0]) for turn in turns),
        )
    return out


def _digests(frame):
    return {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)
        for r in frame.collect()
    }


def test_query_chat(spark):
    rows = duckdb.sql(
        f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'"
    ).fetchall()
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert _digests(queries.op6_chat_tree(spark, SF)) == _plain_digests(rows)


def _conversations(spark):
    """A first turn that most share, copies, one long conversation, shared middles."""
    chance = random.Random(5)
    rows = []
    for conv in range(400):
        turns = [("user", "hello")] if conv % 3 else [("system", f"s{conv % 7}")]
        while chance.random() < 0.7:
            turns.append((["assistant", "user"][len(turns) % 2], f"t{chance.randrange(3)}" * 20))
        rows += [(conv, i, *turn) for i, turn in enumerate(turns)]
    rows += [(1000, i, "user", f"long {i}") for i in range(3000)]
    return rows, spark.createDataFrame(
        rows, "conv_id bigint, turn bigint, role string, text string"
    )


def test_trees(spark, monkeypatch):
    rows, frame = _conversations(spark)
    packs = chat.pack_conversations(frame).cache()
    assert _digests(chat.read_back(packs)) == _plain_digests(rows)
    written = formatted = 0
    for pack in packs.collect():
        pack = pack.asDict(recursive=True)
        written += len(pack["text"])
        keys = set()
        for node in range(len(pack["node_start"])):
            spans = pack["node_attends"][node]
            at, path = node, []
            while at >= 0:
                path.append(at)
                at = pack["node_parent"][at]
            # A node attends to its ancestors, all of them and nothing else.
            covered = {i for s in spans for i in range(s["start"], s["end"])}
            ancestors = {
                i for a in path[1:] for i in range(pack["node_start"][a], pack["node_end"][a])
            }
            assert covered == ancestors
            assert pack["node_position"][node] == len(ancestors)
            text = chat.path_text(pack, node)
            assert text not in keys  # every start is there once
            keys.add(text)
        formatted += sum(len(chat.path_text(pack, node)) for node in pack["last_nodes"])
    # But for the long conversation, which shares nothing, most text is there once.
    alone = _plain_digests(rows)[1000][-1]
    assert written - alone < 0.5 * (formatted - alone)


def test_a_long_shared_turn_is_written_once_a_pack():
    prompt = "p" * 18_200
    rows = []
    for conv in range(2000):
        rows.append((b"o", conv, 0, b"prompt", "system", prompt))
        rows.append((b"o", conv, 1, b"%d" % conv, "user", f"question {conv:05}"))
    packs = list(chat.packs_of(iter(rows)))
    assert sum("".join(pack.text).count(prompt) for pack in packs) == len(packs) <= 5
    assert [n for pack in packs for n in pack.conversation] == list(range(2000))
    assert max(pack.size for pack in packs) < len(prompt) + 2 * chat.PACK_CHARS


def test_ugly_turns(spark):
    rows = [
        (None, 1, "user", "a"), (None, None, None, None), (5, None, "user", None),
        (5, 0, None, "x"), (5, 0, "assistant", ""), (6, 1, "user", "same"), (6, 1, "user", "same"),
        (7, 0, "odd\\role]", "[x]"), (8, 0, "assistant", "z" * 100_000),
    ]
    frame = spark.createDataFrame(
        [(*row, "p", 1) for row in rows],
        "conv_id bigint, turn bigint, role string, text string, place string, conv int",
    )
    got = _digests(chat.read_back(chat.pack_conversations(frame)))
    assert set(got) == {None, 5, 6, 7, 8}
    assert [got[i][0] for i in (None, 5, 6, 7, 8)] == [2, 3, 2, 1, 1]
    assert got[8][2] == 100_000
    assert got[7] == _plain_digests([rows[7]])[7]
    assert chat.read_back(chat.pack_conversations(frame.limit(0))).count() == 0


# Pipeline ---------------------------------------------------------------------------


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    kept = docs
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns
        seen.append(kept.count())
        assert kept.exceptAll(docs).isEmpty()
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    # Each stage does what its operator says of the stage's own input.
    rules = queries.op3_quality_rules(spark, sf).where("kept").count()
    assert seen[1] == rules
    labels = table(spark, sf, "labels")
    assert kept.join(labels, "doc_id").where("quality = 0").count() <= 1
    clean = docs.join(labels.where("quality = 1"), "doc_id").count()
    assert kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.85 * clean
    pieces = corpus_pipeline.run(spark, sf)
    packed = pieces.groupBy("doc_id").agg(
        F.sum("length").alias("n"), F.max("doc_tokens").alias("total")
    ).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert all(r.n == r.total for r in packed)


def test_pipeline_on_ugly_rows(spark, ugly, empty):
    for frame in (ugly, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.schema == frame.schema
            assert out.count() <= frame.count()
