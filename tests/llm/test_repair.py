"""Conversation repair against all edits tried, one conversation at a time."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lexstrata.llm import repair

TURNS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """The report of one conversation's damaged rows: all edits from the end, whole audits compared."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults, pairs = set(), [], 0
    for i, (_, _, role, text) in enumerate(rows):
        end = text.rstrip(BLANKS)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        pairs += i > 0 and rows[i - 1][2][:1] + role[:1] not in ("su", "ua", "au")
    best = {(len(rows), s): (0, "", []) for s in "0a"}

    def better(key, option):
        if key not in best or option[:2] < best[key][:2]:
            best[key] = option
            return True
        return False

    def insert_all(i):
        changed = True
        while changed:
            changed = False
            for s in "0sua":
                given = "a" if s == "u" else "u"
                if (i, given) in best:
                    cost, audit, out = best[i, given]
                    changed |= better((i, s), (cost + 3, "I" + audit, [("assistant" if given == "a" else "user", "")] + out))

    insert_all(len(rows))
    for i in range(len(rows) - 1, -1, -1):
        _, _, role, text = rows[i]
        extra = 3 if faults[i] == "truncated" else 0
        for s in "0sua":
            cost, audit, out = best[i + 1, s]
            better((i, s), (cost + 4, "D" + audit, out))
            if faults[i] in ("blank", "duplicate"):
                continue
            given = "a" if s == "u" else "u"
            for edit, to, name, price in (("K", role[:1], role, 0), ("R", given, "assistant" if given == "a" else "user", 3)):
                if to and to in {"0": "su", "s": "u", "u": "a", "a": "u"}[s]:
                    cost, audit, out = best[i + 1, to]
                    better((i, s), (cost + price + extra, edit + audit, [(name, text)] + out))
        insert_all(i)
    cost, audit, out = best[0, "0"]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], pairs, cost, audit, digest)


def expected(rows):
    by = defaultdict(list)
    for r in plain_damage(rows):
        by[r[0]].append(r)
    return {c: plain_repair(by[c]) for c in {r[0] for r in rows}}


def _conversations(seed, n=150):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!", "no end", "", " \n ", "Why?  ", "ok", "a b.\t", None]
    rows = []
    for conv in range(n):
        turns = rng.sample(range(40), rng.randint(1, 9))
        for t in sorted(turns):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([t, t, t, None, turns[0]]), role, rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repair_against_all_edits(spark, seed):
    rows = _conversations(seed)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(spark.createDataFrame(rows, TURNS).repartition(5)).collect()}
    assert got == expected(rows)


def test_every_end_has_one_node():
    """What is computed for a shared ending is what each conversation would get alone."""
    rng = random.Random(4)
    signatures = sorted({"".join(rng.choice("dsuaoSUAO") for _ in range(rng.randint(0, 12))) for _ in range(400)})

    def alone(ending):
        path = [repair.END]
        for symbol in ending:
            path.append(repair.node(symbol, path[-1]))
        return path[-1][0][0], repair._audit(path)

    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(signatures), pa.array(signatures)], names=["ending", "signature"])
    got = {r["signature"]: (r["cost"], r["audit"]) for b in repair._solve(iter([batch])) for r in b.to_pylist()}
    assert got == {s: alone(s) for s in signatures}


def test_a_long_conversation_and_many_alike(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"text {i % 700}.") for i in range(3000)]
    rows += [(c, t, r, x) for c in range(100, 400) for t, r, x in ((0, "user", "Q?"), (1, "assistant", "A."))]
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(spark.createDataFrame(rows, TURNS).repartition(7)).collect()}
    assert got == expected(rows)


def test_repaired_rows_follow_the_roles(spark):
    rows = repair.damaged(spark.createDataFrame(_conversations(5), TURNS))
    audits = repair.audit_conversations(rows)
    turns = repair.repaired_turns(rows, audits).collect()
    by = defaultdict(list)
    for r in turns:
        by[r["conv_id"]].append((r["place"], r["role"]))
    for placed in by.values():
        assert [p for p, _ in placed] == list(range(len(placed)))
        roles = "".join(r[0] for _, r in placed)
        assert roles.removeprefix("s") == "ua" * (len(roles) // 2)


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hello."), (2, 0, "user", "ünï \U0001F600 " + "long " * 50000 + "."), (2, 0, "user", "x"), (3, 5, "", "a.")]
    rows += [(4, 1, "assistant", "Same.")] * 3
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'clash' as place", "'clash' as kind", "'clash' as audit", "'clash' as gone", "'clash' as copy")
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(df).collect()}
    assert got == expected(rows)
    assert repair.repair_report(spark.createDataFrame([], TURNS)).count() == 0
