import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from chatlake.llm import turntrie
from chatlake.llm.queries import SQL

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, u string, leaf int, part int"


def by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c in own:
        head = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:head] + own[c][head:])
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += not children[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node],
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    """Bases with few turns, without any, NULLs, equal turns, copies in masses, one very long conversation."""
    rng = random.Random(4)
    out = []
    for c in [*range(0, 330), *range(1000, 1005), 2007, 10**12 + 7]:
        if c in (200, 201):
            continue
        for t in range(rng.choice([0, 1, 2, 5, 7, 9]) if c % 100 else rng.choice([1, 3, 8])):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "c" * 40])))
    out += [(400, t, "user", f"turn {t} ½") for t in range(6)]
    out += [(c, t, "user", f"turn {t} ½") for c in range(401, 500) for t in range(6)]  # nothing but copies
    out += [(5000, t, "user", f"long {t % 97}") for t in range(180)] + [(5001, t, "user", f"long {t % 97}") for t in range(150)]
    out += [(600, None, None, None), (600, None, "user", "x"), (600, 3, "user", "y"), (600, 3, "user", "y"), (600, -2, "user", "z")]
    out += [(None, 1, "user", "lost"), (601, 0, "user", "only"), (700, 0, "u", "base"), (701, 0, "u", "short")]
    rng.shuffle(out)
    return [(*r, "clash", "u", 1, 2) for r in out]


@pytest.mark.parametrize("cell_bits, part_bits", [(12, 13), (3, 2)])
def test_as_a_trie_by_hand(spark, rows, monkeypatch, cell_bits, part_bits):
    monkeypatch.setattr(turntrie, "CELL_BITS", cell_bits)
    monkeypatch.setattr(turntrie, "PART_BITS", part_bits)
    found = turntrie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert found.columns == COLUMNS
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, by_hand(rows)))


def test_sql_agrees(rows):
    few = [r[:4] for r in rows if r[0] is None or r[0] < 5000]
    conversations = pd.DataFrame(few, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    with duckdb.connect() as db:
        db.register("conversations", conversations)
        found = db.sql(SQL["op13_prefix_trie"]).fetchall()
    assert sorted(map(repr, found)) == sorted(map(repr, by_hand(few)))


def test_conversations_without_turns_end_at_the_root(spark):
    # Heads of 701 and 702 take more turns than there are, and their base does not exist.
    ids = [c for c in range(701, 760) if zlib.crc32(str(c).encode()) % 6 >= 1][:2]
    found = turntrie.prefix_trie(spark.createDataFrame([(c, 0, "u", "t", "", "", 0, 0) for c in ids], SCHEMA)).collect()
    assert [tuple(r) for r in found] == [
        (ids[0], 0, None, 2, 0, 1, 0, hashlib.sha256(f"{ids[0]},{ids[1]}".encode()).hexdigest())]


def test_empty_table(spark):
    assert turntrie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
