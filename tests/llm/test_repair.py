import hashlib
import random
import re
from collections import defaultdict
from itertools import product as ways

import duckdb
import pytest
import zlib

from tidemark.llm import repair as R

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit) by trying all edits: rows of (initial, fault), up to two inserted rows in each gap."""
    best = None
    for ops in ways("DKR", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and o != "D" for o, (_, f) in zip(ops, rows)):
            continue
        for gaps in ways(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + o for g, o in zip(gaps, ops)) + "I" * gaps[-1]
            cost = 3 * sum(gaps) + sum(4 if o == "D" else (3 if o == "R" else 0) + (3 if f == "truncated" else 0) for o, (_, f) in zip(ops, rows))
            if best is not None and (cost, audit) >= best:
                continue
            kept = iter(rows)
            out = []  # None where user or assistant, as it fits
            for c in audit:
                if c == "I":
                    out.append(None)
                else:
                    initial = next(kept)[0]
                    out += [] if c == "D" else [None] if c == "R" else [initial]
            shift = 1 if out and out[0] == "s" else 0
            roles = "".join(("ua"[(i - shift) % 2] if c is None else c) for i, c in enumerate(out))
            if LEGAL.match(roles):
                best = (cost, audit)
    return best


def test_matrices_give_the_cheapest_edits():
    rng = random.Random(5)
    grammar, seen = R.Grammar(), {}
    for length in (1, 2, 3, 4):
        for _ in range(60):
            key = "".join(rng.choice(R.SYMBOLS) for _ in range(length))
            seen[key] = [(c.lower(), "blank" if c == "d" else "truncated" if c.isupper() else "fine") for c in key]
    found = grammar.evaluate(list(seen))
    for key, rows in seen.items():
        m = found[key]
        ends = [(m.cost[j] + 3 * n, m.text(j) + "I" * n) for j, n in enumerate((0, 2, 1, 0)) if m.cost[j] is not None]
        assert min(ends) == cheapest(rows), key


def test_ranks_are_the_order_of_the_edits():
    rng = random.Random(6)
    grammar = R.Grammar()
    for m in grammar.evaluate(["".join(rng.choice(R.SYMBOLS) for _ in range(rng.randint(1, 40))) for _ in range(100)]).values():
        for i in range(4):
            row = [j for j in range(4 * i, 4 * i + 4) if m.cost[j] is not None]
            assert sorted(row, key=lambda j: m.rank[j]) == sorted(row, key=m.text)


def test_grammar_is_whole_and_shared():
    rng = random.Random(7)
    for alphabet in ("u", "ua", R.SYMBOLS):
        rows = [[R.SYMBOLS.index(rng.choice(alphabet)) for _ in range(rng.randint(0, 60))] for _ in range(30)]
        grammar = R.Grammar()
        short = R.re_pair(rows, grammar.rule)
        back = {v: k for k, v in grammar.rules.items()}

        def expand(x):
            return [x] if x not in back else expand(back[x][0]) + expand(back[x][1])

        assert [[y for x in q for y in expand(x)] for q in short] == rows
        pairs = defaultdict(list)
        for n, q in enumerate(short):
            for i in range(len(q) - 1):
                pairs[q[i], q[i + 1]].append((n, i))
        for p, at in pairs.items():  # no pair is left that occurs twice, overlaps aside
            assert len(at) == 1 or p[0] == p[1] and len(at) == 2 and at[0][0] == at[1][0], p
    long = ["ua" * 4096, "ua" * 4095, "ua" * 4096 + "s"]
    grammar = R.Grammar()
    found = grammar.evaluate(long)
    assert len(grammar.rules) < 40 and found[long[0]].cost[R.START * 4 + R.AFTER_A] == 0


def plain(rows):
    """Output rows by conv_id of (conv_id, turn, role, text), whole conversations at once; edits by a table over strings."""
    blanks = " \t\n\x0b\x0c\r"
    held = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = held.setdefault(c, [])
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        own += [(t, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    out = []
    for c, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in own:
            left = text.rstrip(blanks)
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "fine" if left[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        best = {0: (0, "")}
        moves = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
        for (_, role, _), fault in zip(own, faults):
            open_ = dict(best)
            for _ in range(2):
                for q, (k, a) in list(open_.items()):
                    for (x, p), n in moves.items():
                        if p == q and x in "ua":
                            open_[n] = min(open_.get(n, (10**9, "")), (k + 3, a + "I"))
            best, late = {}, 3 if fault == "truncated" else 0
            for q, (k, a) in open_.items():
                tries = [(q, k + 4, "D")]
                if fault in ("fine", "truncated"):
                    tries += [(n, k + late, "K") for (x, p), n in moves.items() if p == q and x == role[:1]]
                    tries += [(n, k + late + 3, "R") for (x, p), n in moves.items() if p == q and x in "ua"]
                for n, cost, letter in tries:
                    best[n] = min(best.get(n, (10**9, "")), (cost, a + letter))
        cost, audit = min((k + 3 * n, a + "I" * n) for q, n in enumerate((0, 2, 1, 0)) if q in best for k, a in [best[q]])
        put, it = [], iter(own)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(it)[1:]
            if letter != "D":
                put.append((role if letter == "K" else None, text))
        shift = bool(put) and put[0][0] is not None and put[0][0][:1] == "s"
        said = "\n".join(f"{r if r is not None else ('user', 'assistant')[(i - shift) % 2]}:{t}" for i, (r, t) in enumerate(put))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out.append((
            c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(said.encode()).hexdigest(),
        ))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def odd_rows():
    rng = random.Random(8)
    rows = []
    for c in range(120):
        for t in range(rng.choice([0, 1, 2, 5, 9])):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "umpire"])
            rows.append((c, t if t % 5 else None if t else 0, role, rng.choice(["Yes.", "No!", "What", "", " \t", None, f"word {t}?", "é。", f"a. \n{t}."])))
    rows += [(777, t, ("user", "assistant")[t % 2], "ok." if t % 3 else f"t {t}") for t in range(900)]  # longer than a piece in the test
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, 4, "assistant", "b.")]
    return rows


def frame(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, kind int")
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def run(spark, tmp_path, rows, extra=False):
    frame(spark, rows, extra).repartition(5).write.mode("overwrite").parquet(f"file://{tmp_path}/conversations.parquet")
    return R.op12_conversation_repair(spark, f"file://{tmp_path}")


@pytest.mark.parametrize("piece", [7, 16_384])
def test_equals_loops(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(R, "PIECE", piece)
    rows = odd_rows()
    got = run(spark, tmp_path, rows, extra=piece == 7)
    assert got.columns == COLUMNS
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain(rows)))


def test_repeated_rows_and_nulls(spark, tmp_path):
    rows = [(1, 3, "user", "Hi.")] * 5 + [(2, None, None, None)] * 3 + [(3, None, "user", "x.")] * 2 + [(c, 0, "user", "Hi.") for c in range(100, 200)]
    got = sorted(map(str, (tuple(r) for r in run(spark, tmp_path, rows).collect())))
    assert got == sorted(map(str, plain(rows)))
    assert run(spark, tmp_path, []).collect() == []


def equal_to_sql(spark, files, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{files}'")
    rel = con.sql(R.ORACLE["op12_conversation_repair"])
    got = R.op12_conversation_repair(spark, folder).select(*rel.columns)
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_query_equals_sql(spark):
    equal_to_sql(spark, "/root/testdata/sf0.01/conversations.parquet", "/root/testdata/sf0.01")


def test_sql_on_odd_rows(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] != 777 and r[1] is not None]
    run(spark, tmp_path, rows)
    equal_to_sql(spark, f"{tmp_path}/conversations.parquet/*.parquet", f"file://{tmp_path}")
