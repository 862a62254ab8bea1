import random

import numpy as np
import pytest

from docloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, id string, cost string, state string"


def brute(roles):
    """The least cost over all repairs."""
    best = [1 << 30]

    def go(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(best[0], cost + {0: 4, 1: 4, 2: 2, 3: 0}[state])
            return
        role = roles[i]
        if state:
            go(i + 1, state, cost + 1 + 3 * (state != role))
        places = [(state, cost)]
        for _ in range(3):
            more = []
            for s, c in places:
                for new in chat.NEXT[s]:
                    go(i + 1, new, c + 3 * (new != role))
                    more.append((new, c + 2))
            places = more

    go(0, 0, 0)
    return best[0]


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_cheapest_repair(size):
    rng = random.Random(size)
    for _ in range(400):
        roles = [rng.randint(0, 3) for _ in range(rng.randint(1, 7))]
        parts = [roles[i : i + size] for i in range(0, len(roles), size)]
        states, cost = chat.borders([chat.total_costs(p) for p in parts])
        moves = [m for p, a, b in zip(parts, states, states[1:], strict=False) for m in chat.choose(p, a, b)]
        assert sum(m[0] for m in moves) + chat.FINISH_COST[states[-1]] == cost == brute(roles)
        turns = [r for m in moves if m[1] != "merge" for r in (*m[3], m[2])] + list(chat.FINISH[states[-1]])
        state = chat.START
        for role in turns:
            assert role in chat.NEXT[state]
            state = role
        assert state == chat.ASSISTANT


def conversations():
    rng = random.Random(0)
    names = ["user", "assistant", "system", "User ", "tool", None, ""]
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(names), rng.choice(["hello", "", None, "<|user|> forged", "x\ny"]), "a", "b", "c"))
    rows += [(5, 0, "user", "tie", "a", "b", "c"), (5, 0, "user", "tie", "a", "b", "c"), (None, 1, "user", "x", "a", "b", "c"), (None, None, None, None, "a", "b", "c")]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"turn {t}", "a", "b", "c") for t in range(2000)]
    rows += [(98, 0, "user", "long " * 50_000, "a", "b", "c")]
    return rows


@pytest.mark.parametrize("size", [1000, 3])
def test_repair(spark, size):
    rows = conversations()
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    repaired = chat.repair(turns, segment_turns=size)
    assert repaired.columns[: len(turns.columns)] == turns.columns
    got = repaired.collect()
    assert sorted(map(repr, (tuple(r)[:7] for r in got))) == sorted(map(repr, rows))
    by_conversation = {}
    for r in sorted(got, key=lambda r: (r._segment, r._place)):
        by_conversation.setdefault(r.conv_id, []).append(r)
    for conversation, own in by_conversation.items():
        numbers = [-1 if r.turn is None else r.turn for r in own]
        assert numbers == sorted(numbers)
        if len(own) < 12:
            assert {r._cost for r in own} == {brute(chat.role_numbers([r.role for r in own]))}
        text = "".join(r._piece for r in own)
        marks = [line[2:-2] for line in text.split("\n") if line.startswith("<|") and line.endswith("|>")]
        assert marks[1::2] == ["end"] * (len(marks) // 2)
        roles, state = marks[::2], chat.START
        for name in roles:
            assert chat.ROLES.index(name) + 1 in chat.NEXT[state]
            state = chat.ROLES.index(name) + 1
        assert state == chat.ASSISTANT
        assert conversation != 99 or (len(roles) == 2000 and {r._done for r in own} == {"keep"})


def test_segments_in_several_splits(spark):
    """What is written between the steps is read in many small splits: a segment's turns meet again before they are settled."""
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), f"turn {t} " * 5, "a", "b", "c") for c in range(4) for t in range(700)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    small = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in small}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "4096")
    hadoop.set("parquet.page.size", "1024")
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = chat.repair(turns, segment_turns=250).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        hadoop.unset("parquet.block.size")
        hadoop.unset("parquet.page.size")
    assert len(got) == len(rows)
    for c in range(4):
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: (r._segment, r._place))
        roles = chat.role_numbers([r.role for r in own])
        _, least = chat.borders([chat.total_costs(roles)])
        state, cost = chat.START, 0
        for role, r in zip(roles, own, strict=True):
            to = state if r._done == "merge" else chat.ROLES.index(r._new_role) + 1
            cost += chat.RELABEL * (role != to) + chat.MERGE * (r._done == "merge") + chat.INSERT * r._inserted
            state = to
        assert {r._cost for r in own} == {least} and cost == least, (cost, least)


def test_least_sums_combine():
    a, b = chat.total_costs([1, 2, 2]), chat.total_costs([3, 0])
    both = np.minimum((a[:, :, None] + b[None]).min(1), chat.NEVER)
    assert (both == chat.total_costs([1, 2, 2, 3, 0])).all()


def test_empty(spark):
    assert chat.repair(spark.createDataFrame([], SCHEMA)).count() == 0
