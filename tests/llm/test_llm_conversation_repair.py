import hashlib
import random
import zlib
from functools import lru_cache
from itertools import product as every

import pytest

from entitymill.llm import conversation_repair as cr

SPACE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, key string, word string, `rank` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def best_edits(symbols):
    """(cost, audit, roles put out) by trying every edit, with insertions only where a role is wanted."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        ways = []
        if i == len(symbols) and state in (0, 3):
            ways.append((0, "", ()))
        if inserted < 4:
            for role in "ua":
                if (state, role) in step:
                    c, a, o = best(i, step[state, role], inserted + 1)
                    ways.append((c + 2, "I" + a, (role + "+", *o)))
        if i < len(symbols):
            role, fault = symbols[i]
            c, a, o = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a, ("", *o)))
            if fault not in ("blank", "duplicate"):
                for letter, new in (("K", role), ("R", "u"), ("R", "a")):
                    if (state, new) in step:
                        c, a, o = best(i + 1, step[state, new], 0)
                        cost = (2 if letter == "R" else 0) + (fault == "truncated")
                        ways.append((c + cost, letter + a, ("keep" if letter == "K" else new, *o)))
        return min(ways) if ways else (10**9, "", ())

    for i in range(len(symbols), -1, -1):
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


def expected(rows):
    """The contract's row of every conversation, row by row."""
    out = {}
    after = {}
    for r in damaged(rows):
        after.setdefault(r[0], []).append(r)
    for conv in {r[0] for r in rows}:
        some = after.get(conv, [])
        # Equal turns: by the digest of role and text.
        some.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        seen, symbols, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in some:
            tail = text.rstrip(SPACE)
            fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else None
            seen.add((role, text))
            symbols.append((role[:1], fault))
            if fault:
                counts[fault] += 1
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        turns = [r[1] for r in some if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, puts = best_edits(tuple(symbols))
        lines, i = [], 0
        for letter, put in zip(audit, puts, strict=True):
            name = {"u": "user", "a": "assistant"}
            if letter == "I":
                lines.append(name[put[0]] + ":")
                continue
            if letter != "D":
                lines.append((some[i][2] if letter == "K" else name[put]) + ":" + some[i][3])
            i += 1
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in FACTS) for r in rows}


def test_automaton_equals_brute_force():
    symbols = [("s", None), ("u", None), ("a", None), ("a", "truncated"), ("t", None), ("u", "blank")]
    code = {symbols[0]: "s", symbols[1]: "u", symbols[2]: "a", symbols[3]: "A", symbols[4]: "o", symbols[5]: "x"}
    words = [w for n in range(6) for w in every(symbols, repeat=n)]
    words = sorted(("".join(code[x] for x in w)[::-1], w) for w in words)
    shared = cr.Automaton(*cr.END)
    for reverse, w in words:
        cost, audit, _ = shared.solve(reverse[::-1])[0]
        assert (cost, audit) == best_edits(w)[:2], w


def test_products_of_chunks_equal_the_whole():
    rng = random.Random(8)
    for _ in range(300):
        word = "".join(rng.choices("suaoSUAOx", k=rng.randrange(1, 40)))
        cut = rng.randrange(len(word))
        units = []
        for part in (word[:cut], word[cut:]):
            columns = [cr.Automaton([0 if s == t else cr.NEVER for s in range(4)]).solve(part) for t in range(4)]
            units.append([columns[t][s][0] for s in range(4) for t in range(4)])
        both = cr.product(*units)
        whole = cr.Automaton(*cr.END).solve(word)
        assert [min(both[4 * s + t] + cr.END[0][t] for t in range(4)) for s in range(4)] == [c for c, _, _ in whole]


def conversations(rng, convs, most):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    texts = ["Yes.", "No!", "cut", "", " \t", None, "Why?", "the same.", "Straße ✓."]
    rows = []
    for conv in convs:
        n = rng.randrange(1, most)
        for turn in range(n):
            turn = None if rng.random() < 0.1 else turn + rng.randrange(3)
            text = rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(50)}."
            rows.append((conv, turn, rng.choice(roles), text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [256, 3])
def test_random_conversations(spark, chunk, monkeypatch):
    rng = random.Random(chunk)
    rows = conversations(rng, [None, *range(150)], 12) + conversations(rng, [1_000], 400) + [(2_000, 5, "user", "again.")] * 300
    monkeypatch.setattr(cr, "PIECE_BYTES", 200)
    monkeypatch.setattr(cr.Repair.__init__, "__defaults__", ("conv_id", "turn", "role", "text", chunk))
    table = frame(spark, rows).repartition(4)
    got = found(cr.audit_conversations(table, cr.damage(table)))
    want = expected(rows)
    assert got.keys() == want.keys()
    for conv, facts in want.items():
        assert got[conv] == facts, conv


def test_empty_table(spark):
    table = frame(spark, [])
    assert cr.audit_conversations(table, cr.damage(table)).count() == 0


def test_conversations_without_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = frame(spark, [(gone, 0, "user", "Hello.")])
    assert found(cr.audit_conversations(table, cr.damage(table))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hi."), (1, 2, "user", "What?"), (2, 0, "tool", "x")]
    texts = [(r.key, r.role, r.text) for r in cr.Repair(frame(spark, rows)).rows().collect()]
    assert texts == [("c1", "system", "Be brief."), ("c1", "user", "Hi."), ("c1", "assistant", "What?")] or len(texts) == 5


def test_query(spark):
    import __spark_entry__ as contract

    folder = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert found(contract.queries()["op11_conversation_repair"](spark, folder)) == expected(rows)
