"""Conversation structure repair: the cheapest edits that make roles alternate, by grammar-compressed dynamic programming.

A row of a conversation is one of nine symbols: its role's initial (s, u, a or other), truncated or not, or blank or
duplicate. Four states tell what has been put out: nothing, s, ..u, ..a. A symbol is a 4 x 4 matrix over (cost, edits)
with the product of the (min, +) semiring; a sequence is the product of its symbols. Re-Pair replaces the most frequent
pair of neighbours by a new symbol as long as any pair recurs; one matrix is made per rule, from the
two it stands for, and shared by all conversations in which the rule occurs. An entry keeps its edits as a rope
(the two entries that it joins), written out once at the end.

Ties go to the ASCII-least edits, and no strings are compared for that: edits of one row of a matrix read the same
rows of a conversation and end with the edit of the last one, so none begins another, and the order of
two is settled by the left parts if these differ, else by the right ones. Each matrix keeps the rank of its entries
within their row.

Rows are put in order by ranges of (conv_id, turn, role, digest), so a long conversation spans many tasks; each
cuts it into pieces of bounded length, and the pieces' matrices are multiplied in order at the end.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import discard, table, written

RESTORE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
"""Costs of giving a row the role user or assistant, deleting it, inserting an empty row, keeping a truncated row."""
SYMBOLS = "dsuaxSUAX"
"""d: blank or duplicate; other letters are roles, x any other role, upper case where truncated."""
START, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
MOVES = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
PIECE = 16_384
"""Symbols in a piece at most."""
MEMO = 50_000
"""Rules that a task keeps at most before it starts anew."""
BATCH = 100_000
BLANKS = " \t\n\x0b\x0c\r"


def inserts(state: int) -> dict[int, int]:
    """States reachable by inserted rows only, with the least number of them (none comes back to where it began)."""
    found, at = {state: 0}, state
    while True:
        at = next((move[at] for c, move in MOVES.items() if c in "ua" and at in move), None)
        if at is None or at in found:
            return found
        found[at] = found[state] + len(found)


class Matrix:
    """cost[4 i + j] from state i to state j (None: impossible), its rank among the entries of row i, its edits:
    a string, or the two (matrix, entry) that they join."""

    __slots__ = ("cost", "rank", "edits")

    def __init__(self, cost: list, rank: list, edits: list):
        self.cost, self.rank, self.edits = cost, rank, edits

    def text(self, entry: int) -> str:
        out, stack = [], [(self, entry)]
        while stack:
            matrix, at = stack.pop()
            rope = matrix.edits[at]
            if isinstance(rope, str):
                out.append(rope)
            else:
                stack += [rope[1], rope[0]]
        return "".join(out)


def ranks(keys: list) -> list:
    """Place of each key among those of its row of four; None stays None."""
    out: list = [None] * 16
    for i in range(0, 16, 4):
        for place, j in enumerate(sorted((j for j in range(i, i + 4) if keys[j] is not None), key=lambda j: keys[j])):
            out[j] = place
    return out


def symbol_matrix(symbol: str) -> Matrix:
    """Any inserted rows, then one edit of the row."""
    role, unfinished = symbol.lower(), UNFINISHED if symbol.isupper() else 0
    best: list = [None] * 16
    for i in STATES:
        for p, n in inserts(i).items():
            edits = [(p, DELETE, "D")]
            if role != "d":
                edits += [(MOVES[role][p], unfinished, "K")] if p in MOVES.get(role, {}) else []
                edits += [(MOVES[r][p], RESTORE + unfinished, "R") for r in "ua" if p in MOVES[r]]
            for q, cost, letter in edits:
                way = (cost + n * INSERT, "I" * n + letter)
                if best[4 * i + q] is None or way < best[4 * i + q]:
                    best[4 * i + q] = way
    return Matrix([b and b[0] for b in best], ranks([b and b[1] for b in best]), [b and b[1] for b in best])


def product(a: Matrix, b: Matrix) -> Matrix:
    cost, edits, keys = [None] * 16, [None] * 16, [None] * 16
    for i in range(0, 16, 4):
        for j in STATES:
            best = None
            for m in STATES:
                left, right = a.cost[i + m], b.cost[4 * m + j]
                if left is not None and right is not None:
                    way = (left + right, a.rank[i + m], m)
                    if best is None or way < best:
                        best = way
            if best is not None:
                m = best[2]
                cost[i + j], keys[i + j] = best[0], (best[1], b.rank[4 * m + j])
                edits[i + j] = ((a, i + m), (b, 4 * m + j))
    return Matrix(cost, ranks(keys), edits)


def re_pair(sequences: list[list[int]], fresh) -> list[list[int]]:
    """The sequences after replacing, as long as a pair of neighbours occurs twice, the most frequent one (the least on
    ties) by the symbol ``fresh(pair)``. Occurrences that overlap count from the left. Nearly linear: each replacement
    touches its neighbours only, and pairs wait in a heap by count."""
    s: list = []
    for q in sequences:
        s += [*q, None]  # nothing pairs across sequences
    n = len(s)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple, set] = defaultdict(set)
    for i in range(n - 1):
        if s[i] is not None and s[i + 1] is not None:
            places[s[i], s[i + 1]].add(i)
    heap = [(-len(v), pair) for pair, v in places.items() if len(v) > 1]
    heap.sort()

    def drop(i: int) -> None:
        j = after[i]
        if 0 <= i and j < n and s[i] is not None and s[j] is not None:
            places[s[i], s[j]].discard(i)

    def add(i: int, touched: set) -> None:
        j = after[i]
        if j < n and s[i] is not None and s[j] is not None:
            places[s[i], s[j]].add(i)
            touched.add((s[i], s[j]))

    while heap:
        count, pair = heappop(heap)
        held = places.get(pair, ())
        if len(held) != -count:  # counted since
            if len(held) > 1:
                heappush(heap, (-len(held), pair))
            continue
        at, free = [], -1
        for i in sorted(held):  # of aaa the first two
            if i >= free and after[i] < n:
                at.append(i)
                free = after[i] + 1
        if len(at) < 2:
            places.pop(pair)
            continue
        rule, touched = fresh(pair), set()
        for i in at:
            if s[i] != pair[0] or after[i] >= n or s[after[i]] != pair[1]:
                continue
            j = after[i]
            if before[i] >= 0:
                drop(before[i])
            drop(i)
            drop(j)
            s[i], s[j] = rule, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                add(before[i], touched)
            add(i, touched)
        for t in touched:
            if len(places[t]) > 1:
                heappush(heap, (-len(places[t]), t))
    out, at = [], 0
    for q in sequences:
        end, row, i = at + len(q), [], at
        while i < end:
            row.append(s[i])
            i = after[i]
        out.append(row)
        at = end + 1
    return out


class Grammar:
    """Matrices of symbols and rules, one each, shared by all sequences. A pair has one rule for good."""

    def __init__(self):
        self.matrices = [symbol_matrix(c) for c in SYMBOLS]
        self.rules: dict[tuple[int, int], int] = {}

    def rule(self, pair: tuple[int, int]) -> int:
        if pair not in self.rules:  # both sides have their matrices: rules are made bottom-up
            self.rules[pair] = len(self.matrices)
            self.matrices.append(product(self.matrices[pair[0]], self.matrices[pair[1]]))
        return self.rules[pair]

    def evaluate(self, texts: Iterable[str]) -> dict[str, Matrix]:
        """The matrix of each distinct, non-empty text of symbols."""
        distinct = sorted({t for t in texts if t})
        short = re_pair([[SYMBOLS.index(c) for c in t] for t in distinct], self.rule)
        return {t: self.whole(q) for t, q in zip(distinct, short)}

    def whole(self, sequence: list[int]) -> Matrix:
        """The product of what no rule shortens, in halves, so that ropes stay shallow."""
        row = [self.matrices[x] for x in sequence]
        while len(row) > 1:
            row = [product(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return row[0]


PIECES = """conv_id {conv}, part int, number long, symbols long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string,
first_turn {turn}, last_turn {turn}, turns long, cost array<long>, rank array<int>, edits array<string>"""
LEGAL = {"su", "ua", "au"}


def pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of rows in order: for each run of one conversation, and at most PIECE symbols, its counts and its matrix."""
    grammar, part, number = Grammar(), TaskContext.get().partitionId(), 0
    done: list[dict] = []
    text: list[str] = []
    now: dict | None = None

    def close() -> None:
        nonlocal now, number
        if now is not None:
            now["key"] = "".join(text)
            now["symbols"] = len(text)
            done.append(now)
            number += 1
        now = None
        text.clear()

    def flush() -> pa.RecordBatch:
        nonlocal grammar
        if len(grammar.rules) > MEMO:
            grammar = Grammar()
        found = grammar.evaluate(p["key"] for p in done)
        entries = {t: (m.cost, m.rank, [None if c is None else m.text(e) for e, c in enumerate(m.cost)]) for t, m in found.items()}
        for p in done:
            p["cost"], p["rank"], p["edits"] = entries.get(p.pop("key"), (None, None, None))
        batch = pa.RecordBatch.from_pylist(done, schema)
        done.clear()
        return batch

    size = 0
    for batch in batches:
        for conv, turn, role, kind, n, again in zip(*[c.to_pylist() for c in batch.columns]):
            for copy in range(n):
                if now is None or now["conv_id"] != conv or len(text) >= PIECE:
                    if size + len(text) > BATCH:
                        close()
                        yield flush()
                        size = 0
                    size += len(text) + 1
                    close()
                    now = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
                    now |= {"conv_id": conv, "part": part, "number": number, "first_role": None, "last_role": None, "first_turn": None, "last_turn": None}
                if kind == "gone":  # it only tells that there was such a conversation
                    break
                symbol = "d"
                if kind == "blank":
                    now["blank"] += 1
                elif again or copy:
                    now["duplicate"] += 1
                else:
                    symbol = role[:1] if role[:1] in MOVES else "x"
                    if kind == "truncated":
                        now["truncated"] += 1
                        symbol = symbol.upper()
                text.append(symbol)
                if now["last_role"] is None:
                    now["first_role"] = role[:1]
                else:
                    now["illegal"] += now["last_role"] + role[:1] not in LEGAL
                now["last_role"] = role[:1]
                if turn is not None and turn != now["last_turn"]:
                    now["turns"] += 1
                    now["first_turn"] = turn if now["first_turn"] is None else now["first_turn"]
                    now["last_turn"] = turn
    close()
    if done:
        yield flush()


def joined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of pieces in order: one row a conversation. Of each state the best way so far is kept, as a chain of pieces."""
    done: list[dict] = []
    now: dict | None = None
    ways: dict[int, tuple] = {}
    size = 0

    def finish() -> None:
        nonlocal size
        if now is None:
            return
        ends = []
        for state, (cost, rank, chain) in ways.items():
            n = {START: 0, AFTER_S: 2, AFTER_U: 1, AFTER_A: 0}[state]
            ends.append((cost + n * INSERT, rank, n, chain))
        cost, _, n, chain = min(ends, key=lambda e: e[:2])
        edits = ["I" * n]
        while chain is not None:
            chain, last = chain
            edits.append(last)
        first, last = now.pop("first_turn"), now.pop("last_turn")
        now["gaps"] = 0 if first is None else last - first + 1 - now["turns"]
        now["cost"], now["audit"] = cost, "".join(reversed(edits))
        size += len(now["audit"])
        done.append(now)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist([{k: d[k] for k in schema.names} for d in done], schema)
        done.clear()
        return batch

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != now["conv_id"]:
                finish()
                if len(done) >= 5000 or size > 4_000_000:
                    yield flush()
                    size = 0
                now = {"conv_id": row["conv_id"], "last_role": None, "first_turn": None, "last_turn": None}
                now |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
                ways = {START: (0, 0, None)}
            if row["cost"] is None:
                continue
            for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                now[c] += row[c]
            if now["last_role"] is not None:
                now["illegal"] += now["last_role"] + row["first_role"] not in LEGAL
            now["last_role"] = row["last_role"]
            if row["first_turn"] is not None:
                if now["last_turn"] == row["first_turn"]:
                    now["turns"] -= 1
                now["first_turn"] = row["first_turn"] if now["first_turn"] is None else now["first_turn"]
                now["last_turn"] = row["last_turn"]
            best: dict[int, tuple] = {}
            for m, (cost, rank, chain) in ways.items():
                for q in STATES:
                    e = 4 * m + q
                    if row["cost"][e] is not None:
                        way = (cost + row["cost"][e], rank, row["rank"][e], (chain, row["edits"][e]))
                        if q not in best or way[:3] < best[q][:3]:
                            best[q] = way
            order = {q: r for r, q in enumerate(sorted(best, key=lambda q: best[q][1:3]))}
            ways = {q: (w[0], order[q], w[3]) for q, w in best.items()}
    finish()
    if done:
        yield flush()


def repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of each conversation's edits (kind 0), then its rows in order: digest and rows of the repaired conversation, text by text."""
    done: list[tuple] = []
    conv, audit, at, put, hashed = None, None, 0, 0, hashlib.sha256()
    state = START

    def give(role: str, text: str) -> None:
        nonlocal put
        if put:
            hashed.update(b"\n")
        put += 1
        hashed.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))

    def turn_to() -> str:
        return "assistant" if state == AFTER_U else "user"

    def insert() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            give(turn_to(), "")
            state = AFTER_A if state == AFTER_U else AFTER_U
            at += 1

    def finish() -> None:
        if audit is not None:
            insert()
            done.append((conv, put, hashed.hexdigest()))

    for batch in batches:
        for key, kind, found, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if kind == 0:
                finish()
                conv, audit, at, put, state, hashed = key, found, 0, 0, START, hashlib.sha256()
                continue
            insert()
            edit, at = audit[at], at + 1
            if edit != "D":
                role = turn_to() if edit == "R" else role
                give(role, text)
                state = AFTER_S if role[:1] == "s" and state == START else AFTER_A if state == AFTER_U else AFTER_U
        if len(done) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done.clear()
    finish()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def repair(turns: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, rows, repaired_sha256.

    ``turns`` has conv_id and turn (integers), role, text and optionally gone (boolean): rows that are gone take no part,
    but their conversation is returned. A conversation's rows count by turn, nulls first, then role and a digest of the text, so
    repeated rows stand together. Null roles and texts are one space; null conv_ids are one conversation; other columns
    are left out; an empty table gives no rows. The rows of one conversation reach one task, as a stream, only for the
    digest of its repaired text: that is a hash over all of it in order.
    """
    space = F.lit(" ")
    ended = F.rtrim("text", F.lit(BLANKS))
    kind = F.when(F.col("gone"), "gone").when(ended == "", "blank").when(F.right(ended, F.lit(1)).isin(".", "!", "?"), "fine").otherwise("truncated")
    gone = F.coalesce("gone", F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), gone.alias("gone"))
    h = [F.xxhash64("text"), F.xxhash64(F.lit(17), "text")]
    rows = rows.withColumns({"h1": h[0], "h2": h[1]})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]

    same = Window.partitionBy("conv_id", "role", "h1", "h2", "kind").orderBy(F.col("turn").asc_nulls_first())
    narrow = rows.select("conv_id", "turn", "role", "h1", "h2", kind.alias("kind")).groupBy("conv_id", "turn", "role", "h1", "h2", "kind").agg(F.count("*").alias("n"))
    narrow = narrow.withColumn("again", F.row_number().over(same) > 1)
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "kind", "n", "again")
    types = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    spark = turns.sparkSession
    piece = spark.createDataFrame([], PIECES.format(conv=types["conv_id"], turn=types["turn"])).schema
    held = to_arrow_schema(piece)
    cut = written(ranged.mapInArrow(lambda b: pieces(b, held), piece))

    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = StructType([piece["conv_id"], *[StructField(c, LongType()) for c in counts], StructField("audit", StringType())])
    listed = to_arrow_schema(whole)
    columns = ["conv_id", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "first_turn", "last_turn", "turns", "cost", "rank", "edits"]
    audits = cut.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), "part", "number").select(*columns)
    audits = written(audits.mapInArrow(lambda b: joined(b, listed), whole))
    discard(cut)

    none = F.lit(None).cast("string")
    letters = audits.select("conv_id", F.lit(0).alias("kind"), "audit", F.lit(None).cast(types["turn"]).alias("turn"), none.alias("role"), none.alias("text"), F.lit(0).alias("h1"), F.lit(0).alias("h2"))
    texts = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), none.alias("audit"), "turn", "role", "text", "h1", "h2")
    both = letters.unionByName(texts).repartition("conv_id")
    both = both.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *order[1:]).select("conv_id", "kind", "audit", "role", "text")
    result = StructType([piece["conv_id"], StructField("rows", LongType()), StructField("repaired_sha256", StringType())])
    digest = to_arrow_schema(result)
    hashes = both.mapInArrow(lambda b: repaired(b, digest), result).withColumnRenamed("conv_id", "of")
    return audits.join(hashes, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def damaged(turns: DataFrame) -> DataFrame:
    """The test damage: crc32 of ``conv_id:turn`` (nulls one space) modulo 20 drops a row (0: marked as gone), empties its text
    (1), takes its ends of sentences (2), repeats it (3) or gives it to the user (4)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    dealt = turns.withColumn("way", F.crc32(key) % 20)
    text = F.coalesce("text", space)
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("way") == 4, "user").otherwise(F.coalesce("role", space))
    copies = F.explode(F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("way") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation after the test damage. Odd rows as in ``repair``."""
    found = repair(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = {
    "op12_conversation_repair": f"""
WITH RECURSIVE crc(b, c, k) AS (SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
conv AS MATERIALIZED (SELECT conv_id, row_number() OVER () AS id FROM (SELECT DISTINCT conv_id FROM conversations)),
raw AS (SELECT id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(v.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations v JOIN conv ON v.conv_id IS NOT DISTINCT FROM conv.conv_id),
way AS (SELECT raw.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS way FROM raw, tab),
dealt AS (SELECT id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN way = 1 THEN '' WHEN way = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE way WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM way),
o AS MATERIALIZED (SELECT id, turn, role, text, left(role, 1) AS init, rtrim(text, {_BLANK}) AS ended,
    row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair
  FROM dealt WINDOW w AS (PARTITION BY id ORDER BY turn NULLS FIRST, role, text)),
f AS MATERIALIZED (SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault FROM o),
ins(p, q, k) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
op(op, c, p, q, cost) AS (VALUES ('D', '', 0, 0, 4), ('D', '', 1, 1, 4), ('D', '', 2, 2, 4), ('D', '', 3, 3, 4),
  ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
  ('R', '', 0, 2, 3), ('R', '', 1, 2, 3), ('R', '', 3, 2, 3), ('R', '', 2, 3, 3)),
st(id, i, q, b) AS (SELECT id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': ''}} FROM conv
  UNION ALL
  SELECT s.id, f.i, op.q, min({{'cost': (s.b.cost + 3 * k + op.cost + CASE WHEN fault = 'truncated' AND op <> 'D' THEN 3 ELSE 0 END)::BIGINT,
                                'audit': s.b.audit || repeat('I', k) || op}})
  FROM st AS s JOIN f ON f.id = s.id AND f.i = s.i + 1 JOIN ins ON ins.p = s.q
  JOIN op ON op.p = ins.q AND (op = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (op = 'R' OR op.c = init)))
  GROUP BY s.id, f.i, op.q),
n AS (SELECT conv.id, conv_id, count(f.id) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM conv LEFT JOIN f ON f.id = conv.id GROUP BY conv.id, conv_id),
best AS MATERIALIZED (SELECT n.*, b.cost AS cost, b.audit AS audit FROM n JOIN (
    SELECT id, i, min({{'cost': b.cost + 3 * k, 'audit': b.audit || repeat('I', k)}}) AS b
    FROM st JOIN (VALUES (0, 0), (1, 2), (2, 1), (3, 0)) AS e(q, k) ON e.q = st.q GROUP BY id, i) AS e ON e.id = n.id AND e.i = n.n),
letters AS (SELECT id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS place FROM best WHERE audit <> ''),
numbered AS (SELECT *, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS k FROM letters
  WINDOW w AS (PARTITION BY id ORDER BY place)),
put AS (SELECT m.id, place, letter, k, role, text, max((k = 1 AND letter = 'K' AND init = 's')::INT) OVER (PARTITION BY m.id) AS s
  FROM numbered m LEFT JOIN f ON f.id = m.id AND f.i = m.i WHERE letter <> 'D'),
done AS (SELECT id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS whole FROM put GROUP BY id)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM best LEFT JOIN done USING (id)"""
}


def registered() -> dict:
    return {"op12_conversation_repair": op12_conversation_repair}
