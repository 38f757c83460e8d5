"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cashtide.llm import conversation_trie as module
from cashtide.llm.conversation_trie import conversation_trie
from cashtide.llm.queries import op11_rows

SCHEMA = "conv_id long, turn int, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_order(rows):
    """Turns by conversation; rows have no ties other than equal ones."""
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [x[1:] for x in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {}
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in below.get(node, []))
        leaves[node] = sum(leaves[x] for x in below.get(node, [])) or 1
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(below.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def nodes(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=lambda r: (r[1], r[0]))


def some_turns(draw, size, longest, texts):
    return [(c, t, draw.choice(["user", "assistant"]), draw.choice(texts)) for c in range(size) for t in range(draw.randint(1, longest))]


@pytest.mark.parametrize("longest,texts", [(6, ["a", "é"]), (19, ["a"]), (9, ["a", "bb", "ccc", "", None])])
def test_nodes_of_conversations_as_they_are(spark, monkeypatch, longest, texts):
    monkeypatch.setattr(module, "PIECE", 3)
    rows = some_turns(random.Random(longest), 70, longest, texts)
    assert nodes(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(in_order(rows))


def test_the_query_on_odd_rows(spark):
    draw = random.Random(4)
    rows = some_turns(draw, 60, 12, ["a", "b", "cé"])
    rows += [(c, None, None, None) for c in (-7, -5, 3)] + [(None, 0, "user", "lost")] * 2
    rows += [(1000 + i, t, "user", "same") for i in range(40) for t in range(3)]  # a hot conversation
    rows += [(2003, 0, "user", "short"), (2004, 5, "user", "x"), (2004, 5, "user", "x")]
    rows += [(3000, t, "user", f"{t % 3}") for t in range(700)] + [(3001, t, "user", f"{t % 3}") for t in range(650)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    extra = frame.select("*", *[F.lit("x").alias(c) for c in ("conv", "pos", "sym", "d", "name", "len", "part")])
    assert nodes(op11_rows(extra)) == plain_trie(rebuilt(in_order(rows)))


def test_few_conversations(spark):
    for rows in ([], [(7, 0, "user", "only")], [(3, 0, None, None), (4, 0, None, None)], [(2, 0, "u", "x"), (4, 0, "u", "y")]):
        convs = in_order(rows)
        assert nodes(op11_rows(spark.createDataFrame(rows, SCHEMA))) == (plain_trie(rebuilt(convs)) if convs else [])
