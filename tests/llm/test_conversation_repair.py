"""Conversation repair against a plain search over all edits and a plain version of the whole contract."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gondola.llm import conversation_repair, queries

SF = "/root/testdata/sf0.01"


def cheapest(turns):
    """(cost, audit, repaired) of (role, text, must go, truncated) turns, forward over whole strings."""
    inf = (1 << 30, "", ())
    best = {"": (0, "", ())}

    def put(out, state, way):
        if way[:2] < out.get(state, inf)[:2]:
            out[state] = way

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for state, (c, a, r) in list(out.items()):
                to = "a" if state == "u" else "u"
                put(out, to, (c + 5, a + "I", (*r, ({"a": "assistant", "u": "user"}[to], ""))))
        return out

    best = inserted(best)
    for role, text, gone, cut in turns:
        new = {}
        for state, (c, a, r) in best.items():
            put(new, state, (c + 2, a + "D", r))
            if gone:
                continue
            to = "a" if state == "u" else "u"
            if role[:1] == to or state == "" and role[:1] == "s":
                put(new, role[0], (c + 5 * cut, a + "K", (*r, (role, text))))
            put(new, to, (c + 1 + 5 * cut, a + "R", (*r, ({"a": "assistant", "u": "user"}[to], text))))
        best = inserted(new)
    return min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])


def exhaustive(turns, inserts=2):
    """The same by trying every string of edits with few insertions."""
    found = []
    for ops in itertools.product("DKR", repeat=len(turns)):
        for where in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(turns) + 1), k) for k in range(inserts + 1)):
            letters = "".join("I" * where.count(i) + (ops[i] if i < len(turns) else "") for i in range(len(turns) + 1))
            size = len(letters) - letters.count("D")
            cost, state, odd, at, fine = 0, 0, size % 2, 0, size != 1
            for x in letters:
                if x == "I":
                    cost += 5
                    fine &= not (odd and state == 0)
                    state += 1
                    continue
                role, _, gone, cut = turns[at]
                at += 1
                if x == "D":
                    cost += 2
                    continue
                want = "s" if odd and state == 0 else "ua"[(state - odd) % 2]
                state += 1
                fine &= not gone and (role[:1] == want if x == "K" else want != "s")
                cost += 5 * cut + (x == "R")
            if fine:
                found.append((cost, letters))
    return min(found)


def searched(turns):
    out = bytearray()
    search = conversation_repair.Survivors(out.extend)
    for role, text, gone, cut in turns:
        search.turn(role, text, gone, cut)
    cost, repaired = search.end()
    return cost, out.decode(), repaired


def sha(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


TURN = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["x", "y"]), st.booleans(), st.booleans())


@settings(max_examples=400, deadline=None)
@given(st.lists(TURN, max_size=14))
def test_search(turns):
    cost, audit, repaired = cheapest(turns)
    assert searched(turns) == (cost, audit, sha(repaired))


def test_search_tries_all_edits():
    rng = random.Random(5)
    for _ in range(150):
        turns = [(rng.choice(["system", "user", "user", "assistant", "tool"]), "t", rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(5))]
        assert searched(turns)[:2] == exhaustive(turns) == cheapest(turns)[:2]


def nodes(node):
    return 1 + sum(map(nodes, node.forks))


ROLES = [(["user", "assistant"], True), (["user"], False), (["system"], False), (["assistant", "user"], True), (["tool", "user", "user"], False)]


@pytest.mark.parametrize(("roles", "early"), ROLES)
def test_edits_leave_the_tree_early_and_it_stays_small(roles, early):
    out, waiting, forks = bytearray(), 0, 0
    search = conversation_repair.Survivors(out.extend)
    turns = [(roles[i % len(roles)], "t", i % 11 == 0, i % 7 == 0) for i in range(20_000)]
    for i, turn in enumerate(turns):
        search.turn(*turn)
        waiting, forks = max(waiting, i - len(out)), max(forks, nodes(search.root))
    cost, _ = search.end()
    assert forks <= 7 and (waiting < 60 or not early)
    assert (cost, out.decode()) == best_by_suffix(turns)


def best_by_suffix(turns):
    """Backwards: what is left to do from a state has one least cost, and a letter decides between equal ones."""
    todo = [{"": 0, "a": 0, "u": 5, "s": 10}]

    def ways(turn, state, after, here):
        to = "a" if state == "u" else "u"
        yield here[to] + 5, "I", to
        if turn is not None:
            role, _, gone, cut = turn
            yield after[state] + 2, "D", state
            if not gone:
                keep = role[:1] == to or state == "" and role[:1] == "s"
                yield after[to] + 1 + 5 * cut, "R", to
                if keep:
                    yield after[role[0]] + 5 * cut, "K", role[0]

    for turn in reversed(turns):
        after = todo[-1]
        here = {s: min(c for c, x, _ in ways(turn, s, after, dict.fromkeys("au", 1 << 60)) if x != "I") for s in ("", "s", "u", "a")}
        for _ in range(3):
            here = {s: min(c, here["a" if s == "u" else "u"] + 5) for s, c in here.items()}
        todo.append(here)
    todo.reverse()
    state, letters, i = "", "", 0
    while i < len(turns) or todo[i][state]:
        turn = turns[i] if i < len(turns) else None
        after = todo[i + 1] if turn else {}
        _, letter, state = min((w for w in ways(turn, state, after, todo[i]) if w[0] == todo[i][state]), key=lambda w: w[1])
        letters += letter
        i += letter != "I"
    return todo[0][""], letters


def plain(rows):
    name = lambda x: " " if x is None else str(x)
    by, last = defaultdict(list), {}
    for conv, turn, role, text in rows:
        by[conv]
        how = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        by[conv] += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        numbers = [t for t, _, _ in found if t is not None]
        faults, turns, seen = [], [], set()
        for _, role, text in found:
            full = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, repaired = cheapest(turns)
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(found)]
        last[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha(repaired),
        )
    return last


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, SF).collect()
    want = plain(rows)
    assert len(got) == len(want) and {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert sum(w[4] for w in want.values()) and sum(w[5] for w in want.values())


def odd_rows():
    rng = random.Random(11)
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.randrange(1, 9)):
            turn = rng.choice([None, *range(-2, 6)])
            role = rng.choice([None, "", "user", "assistant", "system", "tool", "User", "sys"])
            text = rng.choice([None, "", " \n", "a b.", "a b.", "c", "é!", "d? \t", "e." * 2000])
            rows += [(conv, turn, role, text)] * rng.choice([1, 1, 1, 2, 3])
    return rows + [(777, t, "user" if t % 2 else "assistant", "same words.") for t in range(3000)]


def digest(rows):
    return conversation_repair.digest(conversation_repair.prepare(*conversation_repair.damage(rows)))


def test_rows_of_any_kind(spark):
    rows = odd_rows()
    extra = "n string, first string, blank string, ck string, tk string, d string, copies string, place string"
    table = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], f"conv_id bigint, turn bigint, role string, text string, {extra}").repartition(7)
    want = plain(rows)
    got = digest(table).collect()
    assert len(got) == len(want) and {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert digest(table.limit(0)).count() == 0


def test_conversation_without_rows(spark):
    gone = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (1,)))
    got = digest(spark.createDataFrame([(gone, 1, "user", "a.")], "conv_id bigint, turn bigint, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns(spark):
    rows = spark.createDataFrame([r for r in odd_rows() if r[0] != 777], "conv_id bigint, turn bigint, role string, text string")
    turns = conversation_repair.repair(rows).collect()
    by = defaultdict(list)
    for r in sorted(turns, key=lambda r: (str(r["conv_id"]), r["place"])):
        by[r["conv_id"]].append(r)
    assert by and all(re.fullmatch("s?(ua)+", "".join(r["role"][0] for r in x)) for x in by.values())
    all_edits = conversation_repair.edits(conversation_repair.prepare(rows)).collect()
    audit = {r["conv_id"]: r["audit"] for r in conversation_repair.digest(conversation_repair.prepare(rows)).collect()}
    got = defaultdict(str)
    for r in sorted(all_edits, key=lambda r: (str(r["conv_id"]), r["place"])):
        got[r["conv_id"]] += r["edit"]
    assert dict(got) == {k: v for k, v in audit.items() if v}
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in conversation_repair.digest(conversation_repair.prepare(rows)).collect()}
    assert all(sha((r["role"], r["text"]) for r in x) == hashes[c] for c, x in by.items())
