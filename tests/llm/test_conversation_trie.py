import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import conversation_trie as C
from termloom.llm.parentheses import BLOCK, Parentheses
from tests.llm.helpers import CLASHES

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """Sequences with common heads, by the definition."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + ts[h:]
    return out


def naive(sequences):
    """Every node with its subtree, from sets of prefixes."""
    members, ends = {}, {}
    for c, ts in sequences.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}

    def visit(p):
        leaves, saved = (0, (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        for k in kids.get(p, []):
            a, b = visit(k)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out[min(members[p]), len(p)] = (
            min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), leaves, saved, digest
        )
        return leaves, saved

    if members:
        visit(())
    return out


def conversations(seed, n=80):
    draw = random.Random(seed)
    out = []
    for c in range(n):
        c = c - 10 if c % 9 == 0 else c * 3
        for turn in range(draw.randint(1, 12)):
            out.append((c, turn, draw.choice(["user", "assistant", None]), draw.choice(["a", "bé", "", None])))
    first = [(None, "system", "the same start")] + [(i, "user", "x" * i) for i in range(6)]
    for c in range(1000, 1000 + n):  # copies of one conversation, and of its beginnings
        out += [(c, *t) for t in first[: 7 if c % 3 else draw.randint(1, 7)]]
    out += [(5000 + i, t, "user", "y" if t % 2 else "z") for i in range(3) for t in range(40 + i)]
    draw.shuffle(out)
    return out


def found(trie):
    return {
        (r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in C.with_digest(*trie).collect()
    }


@pytest.mark.parametrize("seed, shards", [(1, 1), (1, 3), (2, 40), (3, 200)])
def test_nodes_are_those_of_the_definition(spark, seed, shards):
    rows = conversations(seed)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = found(C.prefix_trie(C.with_common_heads(C.paths(frame)), shards))
    want = naive(rebuilt(rows))
    assert got == want


def test_without_common_heads_and_real_ends(spark):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b"), (3, 0, "u", "a"), (3, None, "u", "b")]
    nodes, ends = C.prefix_trie(C.paths(spark.createDataFrame(rows, SCHEMA)), 1)
    own = {(r.conv_id, r.depth): r.ends for r in nodes.collect()}
    assert own == {(1, 0): None, (1, 1): [1], (2, 2): [2], (3, 1): [], (3, 2): [3]}
    assert ends.count() == 0  # nothing ends at the root


def test_turnless_conversations_and_odd_rows(spark):
    """A donor with few turns, a null number, a row twice, extra columns, and none."""
    rows = [(5, 0, "u", "a"), (6, 0, "u", "b"), (6, 0, "u", "b"), (None, 1, "u", "c"), (8, 3, None, None), (11, 0, "u", "q")]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in CLASHES])
    for shards in (1, 5):
        assert found(C.prefix_trie(C.with_common_heads(C.paths(frame)), shards)) == naive(rebuilt(rows))
    assert any(not ts for ts in rebuilt(rows).values())
    empty = spark.createDataFrame([], SCHEMA)
    assert found(C.prefix_trie(C.with_common_heads(C.paths(empty)))) == {}


def test_parentheses_against_a_stack():
    draw = random.Random(4)
    for n in (1, 2, 5, BLOCK, 3000):
        bits, depth, left = [True], 1, n - 1
        while depth:
            if left and (depth == 1 or draw.random() < 0.55):
                bits.append(True)
                depth, left = depth + 1, left - 1
            elif depth > 1 or not left:
                bits.append(False)
                depth -= 1
        tree = Parentheses(np.array(bits))
        stack, close, outer = [], {}, {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        for i, b in enumerate(bits):
            if b and i:
                outer[i] = min(c for o, c in close.items() if o < i and c > close[i])
        at = np.flatnonzero(tree.open)
        assert tree.close(at).tolist() == [close[i] for i in at]
        assert tree.outer_close(at[1:]).tolist() == [outer[i] for i in at[1:]]
        assert tree.leaf().tolist() == [close[i] == i + 1 for i in at]


def test_a_deep_chain(spark):
    rows = [(c, t, "u", "x") for c in (0, 5) for t in range(3000)]
    own = {}
    for c, *t in rows:
        own.setdefault(c, []).append(("u", "x"))
    got = found(C.prefix_trie(C.paths(spark.createDataFrame(rows, SCHEMA)), 3))
    assert len(got) == 3001 and got[0, 0][4] == 3000 and got[0, 3000][1:4] == (2, 0, 1)
