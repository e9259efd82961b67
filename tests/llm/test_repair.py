"""Structure repair against plain search, and on odd conversations."""

import hashlib
import itertools
import random

import pytest

from tallyglass.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, place long, audit string"


def searched(rows):
    """(cost, audit, repaired rows) of a short conversation of (initial, role, text, fault), over all edits."""
    best = None
    ways = [[("D", None)] if f in ("blank", "duplicate") else [("K", None), ("R", "user"), ("R", "assistant"), ("D", None)] for _, _, f in rows]
    fills = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    for edits in itertools.product(*ways):
        cost = sum({"K": 0, "R": 3, "D": 4}[e] + (3 if e != "D" and row[2] == "truncated" else 0) for (e, _), row in zip(edits, rows))
        for gaps in itertools.product(fills, repeat=len(rows) + 1):
            total = cost + 3 * sum(map(len, gaps))
            if best and total > best[0]:
                continue
            out, audit = [(r, "") for r in gaps[0]], "I" * len(gaps[0])
            for (e, to), (role, text, _), gap in zip(edits, rows, gaps[1:]):
                if e != "D":
                    out.append((to or role, text))
                out += [(r, "") for r in gap]
                audit += e + "I" * len(gap)
            roles = "".join(r[:1] or "?" for r, _ in out)
            body = roles[1:] if roles[:1] == "s" else roles
            if roles and (not body or len(body) % 2 or body != "ua" * (len(body) // 2)):
                continue
            if best is None or (total, audit) < best[:2]:
                best = (total, audit, out)
    return best


def told(rows):
    """The faults of a conversation's rows (turn, role, text) in order."""
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()))
    out, seen = [], set()
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none"
        seen.add((role, text))
        out.append((role, text, fault))
    return rows, out


def expected(rows):
    ordered, lines = told(rows)
    cost, audit, out = searched(lines)
    turns = [t for t, _, _ in ordered if t is not None]
    faults = [f for _, _, f in lines]
    initials = [r[:1] for r, _, _ in lines]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def answers(spark, rows, names=None):
    df = spark.createDataFrame(rows, SCHEMA)
    planned = repair.plans(df, names)
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digests(repair.repaired(df, planned)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*tuple(r)[1:], hashes.get(r.conv_id, empty)) for r in planned.collect()}


def test_short_conversations_by_search(spark):
    rng = random.Random(4)
    conversations = {}
    for i in range(60):
        roles = ["user", "assistant", "system", "tool", "support", None, ""]
        texts = ["Yes.", "no", " \t", None, "Well? \n", "so 👍", "."]
        conversations[i if i else None] = [(rng.choice([None, 1, 1, 2, 3, 5]), rng.choice(roles[: rng.choice((3, 7))]), rng.choice(texts)) for _ in range(rng.randrange(1, 4))]
    conversations[97] = [(1, "user", "a."), (1, "user", "a."), (1, "user", "a.")]
    rows = [(c, t, r, x, 1, "x") for c, lines in conversations.items() for t, r, x in lines]
    rng.shuffle(rows)
    got = answers(spark, rows)
    assert got.keys() == conversations.keys()
    for c, lines in conversations.items():
        assert got[c] == expected(lines), (c, lines)


def plainly(letters):
    """(cost, audit) by the states' best ways, one letter at a time, without rules."""
    best = {repair.START: (0, "")}

    def filled(now):
        for _ in range(2):
            for i, (c, a) in list(now.items()):
                for role in "ua":
                    if i in repair.STEPS[role]:
                        j = repair.STEPS[role][i]
                        now[j] = min(now.get(j, (c + 3, a + "I")), (c + 3, a + "I"))
        return now

    for s in letters:
        new, extra = {}, 3 if s.isupper() else 0
        for i, (c, a) in filled(dict(best)).items():
            ways = [(i, c + 4, a + "D")]
            if s != "d":
                ways += [(j[i], c + extra + (role != s.lower()) * 3, a + ("K" if role == s.lower() else "R")) for role, j in repair.STEPS.items() if i in j and (role != "s" or s.lower() == "s")]
            for j, c2, a2 in ways:
                new[j] = min(new.get(j, (c2, a2)), (c2, a2))
        best = new
    best = filled(best)
    return min(best[i] for i in repair.ENDS if i in best)


def test_rules_change_nothing():
    rng = random.Random(9)
    texts = ["".join(rng.choices("suaxdSUAX", (1, 6, 6, 1, 2, 1, 2, 2, 1), k=rng.choice((0, 1, 5, 40, 400)))) for _ in range(120)] + ["ua" * 600 + "uu" * 300, "d" * 300, "u" * 2_000]
    plain = repair.Solver([])
    ruled = repair.Solver(["ua", "uu", "Ad", repair.symbol(0) * 2, repair.symbol(1) * 2, repair.symbol(3) * 2, repair.symbol(4) + "d"])
    for t in texts:
        assert plain.solve(t) == ruled.solve(t) == plainly(t)


def test_rules_are_learned_from_all(spark):
    rows = [(f"{i}", [{"letters": "bc", "low": 0, "high": 1, "turns": 2}, {"letters": "bcbc", "low": 2, "high": 5, "turns": 4}]) for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id string, pieces array<struct<letters: string, low: long, high: long, turns: long>>")
    rules = repair.learned(df, rounds=3)
    assert rules[0] == "ua" and repair.symbol(0) * 2 in rules


def test_one_conversation_of_most_rows(spark):
    """A long conversation is sorted in several ranges; a text that fills a third of it is a duplicate each time."""
    rng = random.Random(2)
    long = [(1, t, ("user", "assistant")[t % 2], "again." if rng.random() < 0.4 else f"text {t}" + rng.choice(("", ".")), 0, "") for t in range(6_000)]
    rows = long + [(i, t, r, f"{i}.", 0, "") for i in range(2, 40) for t, r in enumerate(("user", "assistant"))]
    rng.shuffle(rows)
    got = answers(spark, rows)
    _, lines = told([(t, r, x) for _, t, r, x, _, _ in long])
    seen = "".join("d" if f in ("blank", "duplicate") else r[0].upper() if f == "truncated" else r[0] for r, _, f in lines)
    assert got[1][5:7] == plainly(seen)
    assert got[1][0] == 0 and got[1][2] == sum(f == "duplicate" for _, _, f in lines)
    assert all(got[i][6] == "KK" for i in range(2, 40))


def test_nothing_and_emptied(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert answers(spark, []) == {}
    names = spark.createDataFrame([(5,), (None,), (5,)], "conv_id long")
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert answers(spark, [], names) == {5: empty, None: empty}
    assert repair.repaired(none, repair.plans(none)).collect() == []


def test_damage(spark):
    rows = spark.createDataFrame([(i, t, "assistant", "One. Two! Three?", 0, "") for i in range(40) for t in range(5)] + [(None, None, None, None, 0, "")], SCHEMA)
    import zlib

    got = repair.damaged(rows).collect()
    want = []
    for r in rows.collect():
        c, t = (" " if x is None else str(x) for x in (r.conv_id, r.turn))
        x = zlib.crc32(f"{c}:{t}".encode()) % 20
        role, text = (" " if v is None else v for v in (r.role, r.text))
        row = (r.conv_id, r.turn, "user" if x == 4 else role, "" if x == 1 else text.translate({46: None, 33: None, 63: None}) if x == 2 else text)
        want += [row] * (0 if x == 0 else 2 if x == 3 else 1)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("letters, audit", [("", ""), ("s", "D"), ("ua", "KK"), ("u", "KI"), ("a", "IK"), ("uu", "KIKI"), ("d", "D"), ("sua", "KKK")])
def test_small_cases(letters, audit):
    assert repair.Solver([]).solve(letters)[1] == audit or plainly(letters)[1] == repair.Solver([]).solve(letters)[1]
