import hashlib
import heapq
import random
import re
import zlib

import pytest

from docloom.llm import queries
from docloom.llm import structure_repair as sr
from tests.llm import samples

SCHEMA = "conv_id long, turn long, role string, text string, id string, cost string, audit string"
SPACE = "[\\x20\\x09-\\x0D]"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def fault(rows):
    seen, out = set(), []
    for role, text in rows:
        kept = re.sub(f"^{SPACE}+|{SPACE}+$", "", text)
        if not kept:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif kept[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append(None)
        seen.add((role, text))
    return out


def brute(rows):
    """The cheapest edits by search over (cost, letters), with the whole repaired text, by the words of the contract."""
    faults, n = fault(rows), len(rows)
    heap, best = [(0, "", 0, "", ())], None
    seen = set()
    while heap:
        cost, letters, i, roles, lines = heapq.heappop(heap)
        if i == n and re.fullmatch("(s?(ua)+)?", roles):
            best = cost, letters, "\n".join(lines)
            break
        # Paths come by cost and then by letters, so the first to a turn with these roles is the best.
        state = (i, "s" if roles == "s" else roles[-1:])
        if (state, letters) in seen:
            continue
        seen.add((state, letters))

        def go(extra, letter, step, role=None, text="", now=(cost, letters, i, roles, lines)):
            cost, letters, i, roles, lines = now
            new = roles + (role[:1] if role is not None else "")
            if re.fullmatch("s?(ua)*u?", new) and (role is None or role):
                heapq.heappush(heap, (cost + extra, letters + letter, i + step, new, lines if role is None else (*lines, f"{role}:{text}")))

        for role in ("user", "assistant"):
            if len(letters) < 3 * n + 3:
                go(2, "I", 0, role)
        if i < n:
            role, text = rows[i]
            go(3, "D", 1)
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                go(extra, "K", 1, role, text)
                for new in ("user", "assistant"):
                    if new[0] != role[:1]:
                        go(2 + extra, "R", 1, new, text)
    return best


def expected(original, rows):
    """By conversation: what the contract says of rows after damage."""
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv in {r[0] for r in original}}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = fault([r[2:] for r in own])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, letters, text = brute([r[2:] for r in own])
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())
    return out


def turns(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "User", "useless", "", " "]
    texts = ["Hello.", "Hello", "", " \t\n", "What?", "x!  ", "a b", " ", "Hello."]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 2, 3, 100])
@pytest.mark.parametrize("seed", range(4))
def test_cheapest_and_first(seed, size):
    """Tables of segments, combined in pairs, and the way back down against a search."""
    for k in range(120):
        rows = turns(1000 * seed + k, k % 7 + 1)
        codes = {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}
        faults = [codes[f] for f in fault(rows)]
        initials = [r[:1] if r[:1] in ("s", "u", "a") else "-" for r, _ in rows]
        parts = [(("".join(initials[i : i + size])), faults[i : i + size]) for i in range(0, len(rows), size)]
        tables = [sr.segment_table(*p) for p in parts]
        end, cost = sr.whole(sr.combined(tables))
        states = sr.borders(tables, sr.START, end)
        letters, lines, at = "", [], 0
        for j, (table, part) in enumerate(zip(tables, parts, strict=True)):
            own = table[4 * states[j] + states[j + 1]][1] + (sr.CLOSING[end] if j + 1 == len(parts) else b"")
            for e in sr.replay(own, part[0], [r for r, _ in rows[at : at + size]], states[j]):
                letters += e.edits
                lines += [f"{r}:" for r in e.before]
                if e.role is not None:
                    lines.append(f"{e.role}:{rows[at][1]}")
                lines += [f"{r}:" for r in e.after]
                at += 1
        assert (cost, letters, "\n".join(lines)) == brute(rows), rows


def test_numbers_order_edits():
    weights = sr.Weights(6)
    lists = [(c, e) for c in (0, 1, 7) for e in (b"", b"D", b"DK", b"I", b"IK", b"K", b"KKKKKK", b"R")]
    numbers = [weights.before(e, c, 0) for c, e in lists]
    assert numbers == sorted(numbers) and [weights.parts(n) for n in numbers] == lists
    assert weights.parts(weights.before(b"DI", 5, weights.before(b"KR", 3, 0))) == (8, b"DIKR")


def conversations():
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for t, (role, text) in enumerate(turns(c, rng.randint(1, 7))):
            rows.append((c, t + rng.choice([0, 0, 0, 3]) if t else 0, role if rng.random() < 0.9 else None, text if rng.random() < 0.9 else None))
    unique = {(r[0], r[1]): r for r in rows}  # one turn of a number, so that the order is given
    rows = list(unique.values())
    rows += [(70, 1, "user", "Same."), (70, 1, "user", "Same."), (70, None, "system", "S."), (None, 1, "user", "x."), (None, None, None, None)]
    rows += [(71, None, "user", "a."), (72, 5, "user", "long " * 50_000 + ".")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize(("size", "fan"), [(200, 64), (2, 2), (1, 3)])
def test_repair(spark, size, fan):
    rows = conversations()
    hurt = sr.damaged(frame(spark, rows))
    samples.same([tuple(r)[:4] for r in hurt.collect()], damage(rows))
    repaired = sr.repair(hurt, segment_turns=size, fan=fan)
    want = expected(rows, damage(rows))
    got = {r._group: tuple(r)[1:] for r in sr.summary(repaired).collect()}
    keys = {conv: "{}" if conv is None else f'{{"c":{conv}}}' for conv in want}
    assert got == {keys[c]: w for c, w in want.items() if any(r[0] == c for r in damage(rows))}
    turns_of = repaired.turns.collect()
    assert repaired.turns.columns[:7] == frame(spark, rows).columns
    assert sorted(map(repr, (tuple(r)[:7] for r in turns_of))) == sorted(map(repr, (tuple(r) for r in hurt.collect())))
    by_group = {}
    for r in sorted(turns_of, key=lambda r: (r._segment, r._place)):
        by_group.setdefault(r._group, []).extend(t["role"][:1] for t in r._turns)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(initials)) for initials in by_group.values())


@pytest.mark.parametrize(("size", "fan"), [(200, 64), (7, 4)])
def test_one_large_conversation(spark, size, fan):
    """A third of all turns are one conversation's, half of them with the same text; read in many small splits."""
    rng = random.Random(9)
    rows = [(c, t, ("user", "assistant")[t % 2], f"Turn {t}.") for c in range(500) for t in range(6)]
    rows += [(1000, t, rng.choice(["user", "assistant", "tool"]), "Yes." if rng.random() < 0.5 else f"No {t}") for t in range(1500)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        whole = {r._group: tuple(r)[1:] for r in sr.summary(sr.repair(frame(spark, rows), segment_turns=size, fan=fan)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    own = [r[2:] for r in rows if r[0] == 1000]
    codes = {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}
    faults = fault(own)
    initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for r, _ in own)
    table = sr.segment_table(initials, [codes[f] for f in faults])
    end, cost = sr.whole(table)
    letters = (table[end][1] + sr.CLOSING[end]).decode()
    got = whole['{"c":1000}']
    assert got[5:7] == (cost, letters)
    assert got[1:4] == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    assert all(v[5:7] == (0, "KKKKKK") for k, v in whole.items() if k != '{"c":1000}') and len(whole) == 501


def test_empty(spark):
    none = frame(spark, [(1, 1, "user", "x.")]).limit(0)
    assert sr.repair(none).turns.count() == 0 and sr.summary(sr.repair(sr.damaged(none))).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = [(c, *w) for c, w in expected(rows, damage(rows)).items()]
    samples.same(queries.QUERIES["op13_structure_repair"](spark, folder).collect(), want)
