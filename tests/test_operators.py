"""Hand-checked cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars, student
from tidemark.operators import continuity as C
from tidemark.operators import intervals, joins, paths, quality, quantiles, returns, selection, signals, stats, windows
from tidemark.operators.calendar import business_days, next_session
from tidemark.plans import continuity, inference, study
from tidemark.sources import files, lake, tables
from tidemark.streaming import jobs

D = lambda s: dt.date.fromisoformat(s)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_event_returns_missing_level_and_dates(spark):
    days = ["2021-07-01", "2021-07-02", "2021-07-06", "2021-07-07", "2021-07-08"]
    cal = frame(spark, [(D(x), i + 1) for i, x in enumerate(days)], "session_date date, session_no int")
    px = [(1, i + 1, None if i == 2 else 100.0 + i, False) for i in range(5)] + [(2, i + 1, 50.0 + i, False) for i in range(5)]
    prices = frame(spark, px, "security_id long, session_no int, close double, delisted boolean")
    bench = frame(spark, [(i + 1, 100.0 + i) for i in range(5)], "session_no int, level double")
    ev = frame(spark, [("a", 1, D("2021-07-02")), ("b", 2, D("2021-07-05")), ("c", 2, D("2021-06-01")), ("d", 2, D("2021-07-08"))], "event_id string, security_id long, filing_date date")
    got = {(r.event_id, r.horizon): r for r in returns.event_returns(ev, prices, bench, cal, [1, 2]).collect()}
    assert got["a", 1].entry_no == got["b", 1].entry_no == 3 and got["c", 1].entry_no == 1 and got["d", 1].entry_no is None
    assert got["a", 1].stock_return is None and got["a", 1].partial_path and got["b", 1].stock_return == pytest.approx(53 / 52 - 1)
    assert got["b", 2].end_no == 5 and got["b", 2].stock_return == pytest.approx(54 / 52 - 1) and got["b", 2].excess_return == pytest.approx(54 / 52 - 104 / 102)


def same_as_sql(got, sql, **tables):
    """Rows of a query equal those of SQL over the same small tables, infinities and what isn't a number included."""
    import duckdb

    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows.toPandas())
    rel = con.sql(sql)
    shown = lambda v: repr(float(v) + 0.0) if isinstance(v, (int, float)) else str(v)
    at = [rel.columns.index(c) for c in got.columns]
    assert sorted(tuple(map(shown, r)) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())


def test_zero_standard_error_as_sql(spark, monkeypatch):
    rows = [(h, f"Brand#{i}", D(f"2020-0{m}-10"), y if i % 2 == 0 else 0.0) for h, y in ((1, 0.5), (2, -0.5), (3, 0.0)) for i in (11, 12, 13, 14) for m in (1, 2, 3)]
    rows += [(4, f"Brand#{i}", D(f"2020-0{m}-10"), float(i * m % 7)) for i in (11, 12, 13) for m in (1, 2, 3)]
    given = frame(spark, rows, "horizon int, security_id string, filing_date date, excess_return double")
    even = given.where("horizon = 4 OR security_id IN ('Brand#12', 'Brand#14')")
    sql = lambda q: q.replace(study.E1_SQL, "e1 AS (SELECT * FROM given)")
    monkeypatch.setattr(study, "outcomes", lambda s, d: even)
    same_as_sql(study.s1(spark, ""), sql(study.S1_SQL), given=even)
    assert {(r.horizon, r.t) for r in study.s1(spark, "").where("horizon < 3").collect()} == {(1, math.inf), (2, -math.inf)}
    monkeypatch.setattr(study, "outcomes", lambda s, d: given)
    same_as_sql(study.s2(spark, ""), sql(study.S2_SQL), given=given)


def test_controlled_mean_without_comparison_rows_as_sql(spark, monkeypatch):
    names = [f"Brand#{i}" for i in (11, 12, 13, 14)]
    daily = frame(spark, [(n, k, 50.0 + (7 * k + 3 * i) % 11) for i, n in enumerate(names) for k in range(1, 41)], "security_id string, session_no int, close double")
    rows = [(h, n, k, D(f"2020-0{1 + 3 * (k % 2)}-01"), (i * k % 5) / 10, int(h == 1 or (i + k) % 3 > 0)) for h in (1, 2) for i, n in enumerate(names) for k in range(26, 40)]
    given = frame(spark, rows, "horizon int, security_id string, entry_no int, quarter date, y double, arm int")
    monkeypatch.setattr(inference, "rows", lambda s, d: given)
    monkeypatch.setattr(inference, "fx", lambda s, d, name: daily)
    got = inference.s5(spark, "")
    assert [(r.horizon, r.status) for r in got.collect()] == [(2, "ok")]  # horizon 1 has no row of arm 0
    same_as_sql(got, inference.S5_SQL.replace(inference.X, "x AS (SELECT * FROM given)"), given=given, fx_daily=daily)


def test_event_returns_terminal_row(spark):
    cal = frame(spark, [(D("2021-01-04") + dt.timedelta(days=i), i + 1) for i in range(5)], "session_date date, session_no int")
    prices = frame(spark, [(1, i + 1, 10.0 + i, i == 3) for i in range(5)], "security_id long, session_no int, close double, delisted boolean")
    bench = frame(spark, [(i + 1, 1.0) for i in range(5)], "session_no int, level double")
    ev = frame(spark, [("a", 1, D("2021-01-04"))], "event_id string, security_id long, filing_date date")
    got = {r.horizon: r for r in returns.event_returns(ev, prices, bench, cal, [1, 2, 9]).collect()}
    assert got[1].stock_return == pytest.approx(12 / 11 - 1) and not got[1].delisted
    assert got[2].delisted and got[2].stock_return is None and not got[9].delisted and got[9].stock_return is None


def test_clustered_mean_detects_a_shift(spark):
    r = random.Random(1)
    rows = [(i, m, r.gauss(0, 0.01)) for i in range(40) for m in range(24)]
    mean = sum(x[2] for x in rows) / len(rows)
    rows = [(i, m, x - mean) for i, m, x in rows]
    get = lambda shift: stats.clustered_mean(frame(spark, [(i, m, x + shift) for i, m, x in rows], "i int, m int, x double"), [], "x", "i", "m").first()
    null, moved = get(0.0), get(0.02)
    assert abs(null.mean) < 1e-9 and moved.mean == pytest.approx(0.02) and moved.t > 5 and moved.df == 23 and null.se == pytest.approx(moved.se)


def test_business_days(spark):
    b = [r.day for r in business_days("2021-05-25", "2021-08-05", spark).orderBy("day").collect()]
    assert D("2021-05-31") not in b and D("2021-06-18") not in b and D("2021-07-05") not in b and D("2021-07-06") in b
    after = lambda m: [x for x in b if x >= D(m)][1]
    assert after("2021-06-01") == D("2021-06-02") and after("2021-08-01") == D("2021-08-03")


def test_silent_owner_with_late_sale(spark):
    sales = frame(spark, [(1, 9, D("2019-05-03"), D("2019-05-05")), (1, 9, D("2020-05-03"), D("2020-05-05")), (1, 9, D("2021-05-03"), D("2021-06-10"))], "o int, i int, sold date, filed date")
    at = frame(spark, [(2021, 5, D("2021-06-02"))], "year int, month int, available_on date")
    assert [tuple(r) for r in signals.silent_owners(sales, "o", "i", "sold", "filed", at).collect()] == [(1, 9, 2021, 5, D("2021-06-02"), "SSN", True)]


def position_rows(spark, rows):
    """(id, replaces, day available, event day, kind, side, shares, reported, amendment, owner status)"""
    names = ["owner_row_id", "amends_owner_row_id", "available_at", "event_date", "row_kind", "acquired_disposed", "shares", "reported", "is_amendment", "owner_attribution_status"]
    full = [(*[D(f"2020-01-{r[i]:02d}") if i in (2, 3) and r[i] else r[i] for i in range(10)], "b", 1, "t", "c", "D", r[2] or 0, n) for n, r in enumerate(rows)]
    schema = "owner_row_id string, amends_owner_row_id string, available_at date, event_date date, row_kind string, acquired_disposed string, shares double, reported double, is_amendment boolean, owner_attribution_status string, issuer_id string, owner_id int, `table` string, security_title string, direct_or_indirect string, accession int, line_no int"
    assert names == [x.split()[0] for x in schema.split(", ")[:10]]
    return frame(spark, full, schema)


ONE = "single_owner"


def test_amendment_chains(spark):
    row = lambda i, to, day, am=True, status=ONE: (i, to, day, 1, "transaction", "A", 1.0, 1.0, am, status)
    rows = position_rows(spark, [
        row("o", None, 1, False), row("a", "o", 2), row("b", "a", 3), row("c", "b", 4),  # a chain of three
        row("late", "o", 5), row("same day", "p", 6), row("p", None, 6, False), row("x", "y", 7), row("y", "x", 7), row("far", "x", 8),  # the second of two; not earlier; a cycle
        row("q", None, 1, False), row("joint", "q", 9, status=C.JOINT), row("twice", None, 1, False), row("twice", None, 1, False), row("z", "twice", 9), row(None, "q", 9), row("none", None, 9),
        row("unknown day", None, None, False),
    ])
    got = {r.owner_row_id: (r.amendment_status, r.record_active, r.superseded_by) for r in C.resolve_amendments(rows).collect()}
    link, no = "explicit_row_link", ("unresolved_quarantined", False, None)
    assert got["o"] == ("original", False, "a") and got["a"] == (link, False, "b") and got["b"] == (link, False, "c") and got["c"] == (link, True, None)
    assert all(got[i] == no for i in ("late", "same day", "x", "y", "far", "joint", "z", None, "none"))
    assert got["p"] == got["q"] == got["twice"] == ("original", True, None) and got["unknown day"] == ("not_available", False, None)
    then = {r.owner_row_id: (r.amendment_status, r.record_active) for r in C.resolve_amendments(rows, D("2020-01-03")).collect()}
    assert then["b"] == (link, True) and then["a"] == (link, False) and then["c"] == ("not_available", False) and then["p"][0] == "not_available"


def test_long_amendment_chain(spark):
    rows = position_rows(spark, [(str(i), str(i - 1) if i else None, i + 1, 1, "holding", None, None, 1.0, i > 0, ONE) for i in range(25)])
    got = C.resolve_amendments(rows).where("record_active").collect()
    assert [(r.owner_row_id, r.amendment_status) for r in got] == [("24", "explicit_row_link")]


CONTINUITY = [  # row, status, difference
    (("1", None, 1, 1, "transaction", "A", 100.0, 100.0, False, ONE), "BASELINE_NO_PRIOR", None),
    (("2", None, 2, 2, "transaction", "D", 40.0, 60.0, False, ONE), "PASS", 0.0),
    (("3", None, 3, 1, "transaction", "A", 5.0, 7.0, False, ONE), "NOT_TESTABLE_LATE_DISCLOSURE", None),
    (("4", None, 4, 4, "transaction", "A", 10.0, 70.0, False, ONE), "PASS", 0.0),
    (("5", None, 5, 5, "transaction", "D", 40.0, 999.0, False, ONE), "FLAG_REVIEW_UNADJUSTED", 969.0),
    (("6", "5", 6, 5, "transaction", "D", 40.0, 30.0, True, ONE), "AMENDMENT_BASELINE_RESET", None),
    (("7", None, 7, 7, "holding", None, None, 30.0, False, ONE), "PASS", 0.0),
    (("8", "5", 8, 5, "transaction", "D", 1.0, 1.0, True, ONE), "SKIP_AMENDMENT", None),  # 6 was first
    (("9", "2", 9, 2, "transaction", "D", 40.0, 60.0, True, ONE), "REVIEW_AMENDMENT_INTERVENING_STATE", None),
    (("10", None, 10, 10, "transaction", "A", 1.0, 31.0, False, "joint_owner_unallocated"), "NOT_TESTABLE_OWNER_ATTRIBUTION", None),
    (("11", None, 11, 11, "transaction", "A", 1.0, None, False, ONE), "NOT_TESTABLE_MISSING_POSITION", None),
    (("12", None, 12, 14, "transaction", "A", 5.0, 65.0, False, ONE), "PASS", 0.0),  # after a split of two for one on the 13th
    (("13", None, 13, 15, "transaction", None, None, 5.0, False, ONE), "RESET_BASELINE_MISSING_TRANSACTION", None),
    (("14", None, 14, None, "transaction", "A", 1.0, 6.0, False, ONE), "NOT_TESTABLE_MISSING_DATE", None),
    (("15", None, 15, 21, "transaction", "A", 1.0, 7.0, False, ONE), "FLAG_REVIEW", -9.0),  # three for one on the 20th
]


def test_continuity(spark):
    rows = C.resolve_amendments(position_rows(spark, [r for r, *_ in CONTINUITY]))
    splits = frame(spark, [("b", D("2020-01-13"), 2.0), ("b", D("2020-01-20"), 3.0), ("other", D("2020-01-01"), 9.0)], "issuer_id string, effective_date date, split_factor double")
    got = {r.owner_row_id: (r.status, r.difference) for r in C.ownership_continuity(rows, splits).collect()}
    for (row, status, difference) in CONTINUITY:
        assert got[row[0]] == (status, difference), row[0]


def test_student_t():
    """Two-sided 5 %, 1 % and 0.1 % points of printed tables, to their last digit."""
    table = {1: (12.7062, 63.6567, 636.6192), 2: (4.3027, 9.9248, 31.5991), 5: (2.5706, 4.0321, 6.8688), 10: (2.2281, 3.1693, 4.5869), 30: (2.0423, 2.7500, 3.6460), 120: (1.9799, 2.6174, 3.3735)}
    for df, points in table.items():
        for level, t in zip((0.95, 0.99, 0.999), points):
            assert student.two_sided_quantile(level, np.array([df]))[0] == pytest.approx(t, abs=6e-5)
    # closed forms at 1 and 2 degrees of freedom, and the finite sum at others
    for t in (0.0, 0.1, 0.8, 2.5, 30.0, 4000.0):
        assert student.p_two_sided([t], [1])[0] == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9, abs=1e-12)
        assert student.p_two_sided([t], [2])[0] == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-8, abs=1e-12)
        for df in (4, 50, 300, 1000):
            c2 = df / (df + t * t)
            term, total = 1.0, 0.0
            for j in range(df // 2):
                total, term = total + term, term * c2 * (2 * j + 1) / (2 * j + 2)
            assert student.p_two_sided([-t], [df])[0] == pytest.approx(1 - math.sqrt(1 - c2) * total, abs=1e-9)
    assert math.isnan(student.p_two_sided([float("nan")], [3])[0]) and math.isnan(student.two_sided_quantile(0.95, [0])[0])


def test_selection_stops_without_a_survivor(spark):
    """Returns that turn against the cells chosen on train: nothing is tried on test."""
    r = random.Random(4)
    rows = []
    for i in range(30):
        for q in range(24):
            day = dt.date(2000 + q // 4, 1 + 3 * (q % 4), 1 + i % 27)
            for h in (1, 2):
                y = r.gauss(0.03 if q < 12 else -0.03, 0.02)
                rows.append((f"s{i}", day, 10 * q + i % 3, h, y, day, dt.date(day.year, day.month, 1), 2, 1 + i % 3))
    schema = "security_id string, filing_date date, entry_no int, horizon int, excess_return double, exit_date date, quarter date, buyers_7 int, buyers_14 int"
    cells = selection.arms(frame(spark, rows, schema), (7, 14), (2, 3))
    stages = {"train": ("2000-01-01", "2002-12-31"), "validation": ("2003-01-01", "2004-06-30"), "test": ("2004-07-01", "2005-12-31")}
    got = selection.select_once(cells, stages).collect()
    train = [x for x in got if x.stage == "train"]
    assert len(train) == 12 and sum(x.chosen for x in train) == 3 and {x.stage for x in got} == {"train", "validation"}  # buyers_7 never reaches 3
    assert all(not x.chosen for x in got if x.stage == "validation")
    assert all(x.duplicate for x in train if x.est == "wins100") and all(x.p_holm >= x.p for x in train)
    turned = selection.select_once(cells.withColumn("excess_return", F.abs("excess_return")), stages).collect()
    assert [x.chosen for x in turned if x.stage == "test"] == [True]


def test_spacing_equals_loop(spark):
    r = random.Random(3)
    pos = [(k, r.randrange(60)) for k in range(4) for _ in range(25)]
    want = set()
    for k in range(4):
        last = None
        for p in sorted({p for q, p in pos if q == k}):
            if last is None or p >= last + 5:
                want.add((k, p))
                last = p
    assert {tuple(x) for x in windows.greedy_spacing(frame(spark, pos, "k int, pos int"), ["k"], "pos", 5).collect()} == want


def test_trailing_distinct_equals_loop(spark):
    r = random.Random(4)
    rows = list({(k, D("2020-01-01") + dt.timedelta(days=r.randrange(40)), r.randrange(5)) for k in range(3) for _ in range(40)})
    got = {(x.k, x.d): x.n for x in windows.trailing_distinct(frame(spark, rows, "k int, d date, a int"), "k", "d", "a", 7, "n").collect()}
    for k, d in got:
        assert got[k, d] == len({a for q, e, a in rows if q == k and 0 <= (d - e).days < 7})


def test_asof_equals_loop(spark):
    r = random.Random(5)
    day = lambda: D("2020-01-01") + dt.timedelta(days=r.randrange(60))
    left = list({(k, day()) for k in range(4) for _ in range(15)})
    right = list({(k, day()) for k in range(3) for _ in range(8)})
    right = [(k, d, float(i)) for i, (k, d) in enumerate(right)]
    lf, rf = frame(spark, left, "k int, t date"), frame(spark, right, "k int, d date, v double")
    for strict in (False, True):
        for forward in (False, True):
            got = {(x.k, x.t): x.asof_d for x in joins.asof(lf, rf, "k", "t", "d", ["v"], strict=strict, tolerance=9, forward=forward).collect()}
            for k, t in left:
                fits = [d for q, d, _ in right if q == k and ((d - t).days * (1 if forward else -1)) >= (1 if strict else 0)]
                best = (min if forward else max)(fits) if fits else None
                assert got[k, t] == (best if best and abs((best - t).days) <= 9 else None)


def test_coalesce_and_split_are_inverse(spark):
    iv = frame(spark, [("a", D("2020-01-01"), D("2020-12-31"), 1), ("a", D("2021-01-01"), D("2021-06-30"), None), ("b", D("2020-01-01"), D("2020-03-31"), 2)], "k string, start date, end date, v int")
    cuts = frame(spark, [("a", D("2020-05-01")), ("a", D("2020-01-01")), ("a", D("2021-02-01")), ("b", D("2022-01-01"))], "k string, boundary date")
    pieces = intervals.split_at(iv, cuts, "k")
    assert pieces.count() == 5
    assert {tuple(r) for r in intervals.coalesce_adjacent(pieces, ["k"], ["v"]).select("k", "start", "end", "v").collect()} == {tuple(r) for r in iv.collect()}
    assert intervals.overlaps(iv.union(iv.where("k = 'b'")), ["k"]).count() == 1


def test_pit_map_and_contract(spark):
    rows = frame(spark, [(1, "x", D("2020-06-01")), (2, "y", D("2020-06-01")), (3, "z", D("2020-06-01"))], "id int, k string, d date")
    iv = frame(spark, [("x", 10, D("2020-01-01"), None, True), ("x", 11, D("2020-01-01"), None, False), ("y", 20, D("2020-01-01"), D("2020-12-31"), True), ("y", 21, D("2020-01-01"), None, True)], "k string, s int, a date, b date, pit boolean")
    got = {r.id: (r.s, r.status) for r in joins.pit_map(rows, iv, "k", "d", ["id"], "s", "a", "b", "pit").collect()}
    assert got == {1: (10, "mapped"), 2: (None, "ambiguous"), 3: (None, "no_match")}
    assert joins.interval_candidates(rows, iv, "k", "d", "a", "b", months=3).count() == joins.interval_candidates(rows, iv, "k", "d", "a", "b").count() == 4
    with pytest.raises(ValueError):
        joins.equi_join(rows.withColumn("s", F.lit(1)), iv.select("k", "s"), ["k"], "many_to_one")


def test_next_session_before_and_after(spark):
    cal = frame(spark, [(D("2020-01-03"), 1), (D("2020-01-06"), 2)], "session_date date, session_no int")
    rows = frame(spark, [(D("2019-01-01"),), (D("2020-01-02"),), (D("2020-01-03"),), (D("2020-01-05"),), (D("2020-01-06"),), (None,)], "d date")
    assert [r.entry_no for r in next_session(rows, cal, "d").orderBy("d").collect()] == [None, 1, 1, 2, 2, None]


def test_parsers(spark):
    good = "<ownershipDocument><documentType>4</documentType><issuer><issuerCik>0000012</issuerCik></issuer>" + "".join(f"<reportingOwner><reportingOwnerId><rptOwnerCik>{i}</rptOwnerCik></reportingOwnerId></reportingOwner>" for i in (7, 8))
    good += "<nonDerivativeTable>" + "".join(f"<nonDerivativeTransaction><transactionDate><value>2021-0{i}-05</value></transactionDate><transactionAmounts><transactionShares><value>{i}.5</value></transactionShares></transactionAmounts></nonDerivativeTransaction>" for i in (1, 2, 3)) + "</nonDerivativeTable></ownershipDocument>"
    docs = frame(spark, [(1, good), (2, "not a filing"), (3, ""), (4, None), (5, "<ownershipDocument><documentType>3</documentType></ownershipDocument>")], "id int, xml string")
    rows = files.parse_ownership(docs).collect()
    assert sorted((r.line_no, r.owner_cik, float(r.shares)) for r in rows if r.id == 1) == [(i, o, i + 1.5) for i in range(3) for o in (7, 8)]
    assert {r.id: r.parse_status for r in rows} == {1: "ok", 2: "error", 3: "empty", 4: "empty", 5: "no_rows"}
    sale = """<?xml version='1.0'?><edgarSubmission><formData><issuerInfo>
      <issuerCik>0000001234</issuerCik><issuerName>Example Bio</issuerName>
      <nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold>Jane Doe</nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold>
      <relationshipsToIssuer><relationshipToIssuer>Officer</relationshipToIssuer></relationshipsToIssuer>
      </issuerInfo><securitiesInformation><securitiesClassTitle>Common Stock</securitiesClassTitle>
      <noOfUnitsSold>1200</noOfUnitsSold><aggregateMarketValue>60000</aggregateMarketValue>
      <approxSaleDate>05/15/2024</approxSaleDate><brokerOrMarketmakerDetails><name>Broker LLC</name></brokerOrMarketmakerDetails>
      </securitiesInformation><is10b5OnePlan>true</is10b5OnePlan><dateOfAdoptionOfTradingPlan>01/02/2024</dateOfAdoptionOfTradingPlan>
      </formData></edgarSubmission>"""
    got = files.parse_proposed_sales(frame(spark, [(1, sale), (2, None), (3, "<other/>")], "id int, xml string")).orderBy("id").collect()
    assert (got[0].issuer_cik, got[0].filer, got[0].units, got[0].market_value, got[0].sale_date, got[0].broker) == (1234, "Jane Doe", 1200, 60000, D("2024-05-15"), "Broker LLC")
    assert got[0].plan_10b5_1 == "is10b5OnePlan=true | dateOfAdoptionOfTradingPlan=01/02/2024" and got[0].relationship_to_issuer == "Officer"
    assert [r.parse_status for r in got] == ["ok", "empty", "error"]
    text = "<ACCEPTANCE-DATETIME>20210705170000\nACCESSION NUMBER: 1-2-3\nREPORTING-OWNER:\nCENTRAL INDEX KEY: 0009"
    f = files.sgml_header_fields(F.lit(text))
    r = spark.range(1).select(*[v.alias(k) for k, v in f.items()]).first()
    assert r.accession == "1-2-3" and r.form is None and r.owners == ["0009"] and str(r.accepted_at) == "2021-07-05 21:00:00"


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.money_to_decimal(F.lit("$1,234.50")).alias("m"), scalars.money_to_decimal(F.lit("inf")).alias("i"), scalars.holding_fraction(F.lit(5.0), F.lit(5.0), F.lit(1)).alias("h"),
        scalars.holding_fraction(F.lit(5.0), F.lit(15.0), F.lit(1)).alias("g"), scalars.detect_format(F.lit("  ")).alias("e"), scalars.normalize_security(F.lit(" Common Shares ")).alias("s"),
    ).first()
    assert float(r.m) == 1234.5 and r.i is None and r.h is None and r.g == 0.5 and r.e == "empty" and r.s == "common_stock"


def test_write_validated_refuses(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError):
        files.write_validated(spark, {"t": df}, {"none": df}, f"file://{tmp_path}")
    assert files.write_validated(spark, {"t": df}, {"none": df.where("id < 0")}, f"file://{tmp_path}").first().n_rows == 3


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_earlier_quantiles_equal_numpy(spark, buckets):
    r = random.Random(buckets)
    rows = [(p, r.choice([None, 5.0, 5.0, 5.0, float("nan"), r.gauss(0, 1), r.gauss(0, 1e6)])) for p in (3, 1, 7, 9, 9, 12) for _ in range(r.randint(1, 80))] + [(20, None)]
    got = {x.p: (x.n, x.quantiles) for x in quantiles.earlier_quantiles(frame(spark, rows, "p int, v double"), "p", "v", [0.0, 1 / 3, 0.5, 1.0], buckets=buckets).collect()}
    want = {}
    for p in {p for p, _ in rows}:
        v = [x for q, x in rows if q < p and x is not None and not math.isnan(x)]
        if v:
            want[p] = (len(v), list(np.quantile(v, [0.0, 1 / 3, 0.5, 1.0])))
    assert set(got) == set(want) and 20 in got
    for p, (n, q) in want.items():
        assert got[p][0] == n and got[p][1] == pytest.approx(q, rel=1e-9, abs=1e-12)
    assert quantiles.earlier_quantiles(frame(spark, [], "p int, v double"), "p", "v", [0.5]).collect() == []


def test_prior_year_terciles_have_no_inequality_join(spark):
    e = frame(spark, [(D(f"{2000 + i % 4}-01-0{1 + i % 9}"), float(i)) for i in range(60)], "filing_date date, v double")
    plan = signals.prior_years_terciles(e, "filing_date", "v")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    """Later files on the same folder join what was folded before; a batch that runs again counts nothing twice."""
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "k int, v int, failed boolean"
    parts = [[(1, 1, False), (2, 1, True)], [(1, 2, True), (2, 2, True)], [(2, 3, False), (3, 1, True)]]
    for part in parts:
        frame(spark, part, schema).coalesce(1).write.mode("append").parquet(source)
        out = jobs.incremental_upsert(spark.readStream.schema(schema).parquet(source), "k", "v", "failed", folder)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 1, "done"), (2, 3, 3, "done"), (3, 1, None, "failed")]
    last = jobs.versions(spark, f"{folder}/table")
    assert len(last) == 2 and last[-1].endswith("v000002")


def test_streaming_continuity_equals_the_batch_check(spark, tmp_path):
    rows = C.resolve_amendments(position_rows(spark, [r for r, *_ in CONTINUITY]))
    splits = frame(spark, [("b", D("2020-01-13"), 2.0), ("b", D("2020-01-20"), 3.0)], "issuer_id string, effective_date date, split_factor double")
    for a, b in ((1, 4), (5, 5), (6, 11), (12, 31)):  # restarted three times, once between a row and its amendment
        rows.where(f"dayofmonth(available_at) BETWEEN {a} AND {b}").write.mode("append").parquet(f"file://{tmp_path}/in")
        out = jobs.streaming_continuity(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), splits, f"file://{tmp_path}/s")
    got = {r.owner_row_id: (r.status, r.difference) for r in out.collect()}
    assert got == {row[0]: (status, difference) for row, status, difference in CONTINUITY}


def test_held_excess_states(spark):
    panel = frame(spark, [("a", D("2021-01-01") + dt.timedelta(days=i), None if i == 0 else -1.0 if i == 7 else 0.1, 5.0) for i in range(9)], "security_id string, session_date date, r double, lag_cap double")
    bench = frame(spark, [(D("2021-01-01") + dt.timedelta(days=i), 0.0) for i in range(20)], "session_date date, r double")
    p, b = paths.numbered(panel, "security_id", "session_date", "r", F.col("lag_cap")), paths.numbered(bench, None, "session_date", "r")
    ev = frame(spark, [("ok", "a", D("2020-12-31")), ("same day", "a", D("2021-01-01")), ("wiped out", "a", D("2021-01-04")), ("past the data", "a", D("2021-01-06")), ("none left", "a", D("2021-01-09")), ("unknown", "z", D("2021-01-01"))], "event_id string, security_id string, filing_date date")
    got = {r.event_id: (r.status, r.excess and round(r.excess, 9)) for r in paths.held_excess(ev, p, b, "security_id", "filing_date", "session_date", 3).collect()}
    gain = round(1.1**3 - 1, 9)
    assert got == {"ok": ("ok", gain), "same day": ("ok", gain), "wiped out": ("ok", -1.0), "past the data": ("calendar_right_censored", None), "none left": ("missing_entry_close", None), "unknown": ("missing_entry_close", None)}


def test_lake_reads_changed_quarters_only(spark, tmp_path):
    root, at = f"file://{tmp_path}/lake", f"file://{tmp_path}/manifest"
    rows = [(i, "4" if i % 3 else "4/A", D(f"{2019 + i % 2}-0{1 + i % 9}-10")) for i in range(40)] + [(99, "4", None)]
    lake.write_quarters(frame(spark, rows, "accession int, form string, filing_date date"), "filing_date", root)
    plan = lake.scan_partitioned(spark, root, 2020, 2020, ["accession"])._jdf.queryExecution().executedPlan().toString()
    filters = plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert "2020" in filters and lake.scan_partitioned(spark, root, 2020, 2020, ["accession"]).count() == 20
    first, read = lake.update_manifest(spark, root, at, "form")
    before = {(r.year, r.quarter, r.kind): (r.n, r.digest) for r in first.collect()}
    assert sum(n for n, _ in before.values()) == 41 and (0, 0) in read and len(read) == 7
    assert lake.update_manifest(spark, root, at, "form")[1] == []
    lake.write_quarters(frame(spark, [(100, "4", D("2020-01-10"))], "accession int, form string, filing_date date"), "filing_date", root)
    after, read = lake.update_manifest(spark, root, at, "form")
    assert read == [(2020, 1)]
    counts = {(r.quarter, r.kind): r.n for r in lake.quarter_counts(after).collect()}
    assert counts["total", "4"] + counts["total", "4/A"] == 42 and counts["2020Q1", "4"] == sum(n for (y, q, k), (n, _) in before.items() if (y, q, k) == (2020, 1, "4")) + 1
    assert lake.update_manifest(spark, root, at, "form")[1] == []


def shuffle_files(spark):
    """Shuffle files that Spark holds, waited for while they are being deleted."""
    import time

    held = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    for _ in range(20):
        now = held()
        time.sleep(0.25)
        if now == held():
            break
    return now


@pytest.fixture(scope="module")
def own_folder(tmp_path_factory):
    """A shared folder of these tests, so that stored tables are made anew, once."""
    path = tmp_path_factory.mktemp("shared")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tables, "shared_dir", lambda s: f"file://{path}")
        yield path


def left_behind(spark, folder, query):
    """Shuffle files and passing tables that remain when the tables of ``query`` have been made."""
    before = shuffle_files(spark)
    query(spark, SMALL)
    passing = [p.name for p in (folder / "tables").iterdir() if len(p.name) == 32]  # named tables are stored for the session
    return len(shuffle_files(spark) - before), passing


SMALL = "/root/testdata/sf0.001"


def test_continuity_rows_leave_only_their_table(spark, own_folder):
    assert left_behind(spark, own_folder, continuity.rows) == (0, [])


def test_balance_check_leaves_only_its_table(spark, own_folder):
    assert left_behind(spark, own_folder, continuity.checked) == (0, [])
    assert (own_folder / "tables" / "continuity_checked").exists()


def test_amendments_leave_only_their_table(spark, own_folder):
    assert left_behind(spark, own_folder, continuity.q11) == (0, [])
    assert not list((own_folder / "tables").glob("resolved_*"))  # no second copy of the rows


def test_audit_leaves_only_its_table(spark, own_folder):
    assert left_behind(spark, own_folder, continuity.q14) == (0, [])
    assert (own_folder / "tables" / "continuity_audited").exists()


def test_summary_reads_the_audit(spark, own_folder):
    continuity.q14(spark, SMALL)
    made = sorted(p.name for p in (own_folder / "tables").glob("*/*"))
    assert left_behind(spark, own_folder, continuity.a11) == (0, [])
    assert sorted(p.name for p in (own_folder / "tables").glob("*/*")) == made and list((own_folder / "tables" / "continuity_audited").iterdir())


def test_streaming_continuity_from_batches_without_positions(spark, tmp_path):
    """The first batch leaves no position; a later one has a key that an earlier one knows, and one that it doesn't."""
    day = lambda i, *r: (str(i), None, i, i, *r, False)
    sent = [
        [(*day(1, "transaction", "A", 1.0, 1.0), C.JOINT)],
        [(*day(2, "holding", None, None, 5.0), ONE)],
        [(*day(3, "transaction", "A", 2.0, 7.0), C.JOINT)],
        [(*day(4, "transaction", "D", 1.0, 4.0), ONE), (*day(5, "transaction", "A", 3.0, 8.0), ONE)],
    ]
    splits = frame(spark, [], "issuer_id string, effective_date date, split_factor double")
    for rows in sent:
        rows = C.resolve_amendments(position_rows(spark, rows))
        rows.write.mode("append").parquet(f"file://{tmp_path}/in")
        out = jobs.streaming_continuity(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), splits, f"file://{tmp_path}/s")
    got = {r.owner_row_id: (r.status, r.difference) for r in out.collect()}
    joint = ("NOT_TESTABLE_OWNER_ATTRIBUTION", None)
    assert got == {"1": joint, "2": ("BASELINE_HOLDING", None), "3": joint, "4": ("PASS", 0.0), "5": ("FLAG_REVIEW_UNADJUSTED", 1.0)}
    kept = [p.parent.name for p in (tmp_path / "s" / "out").glob("batch=*/is_state=true")]
    assert sorted(kept) == ["batch=2", "batch=3"]


def test_streaming_continuity_by_the_pass_over_sorted_rows(spark, tmp_path):
    """No pandas frame a key: all keys of a task go through one pass."""
    rows = C.resolve_amendments(position_rows(spark, [r for r, *_ in CONTINUITY]))
    plan = C.pass_rows(C.step_rows(rows, frame(spark, [], "issuer_id string, effective_date date, split_factor double")), C.POSITION, 1e-6)
    rows.write.parquet(f"file://{tmp_path}/in")
    jobs.streaming_continuity(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), frame(spark, [], "issuer_id string, effective_date date, split_factor double"), f"file://{tmp_path}/s")
    state = spark.read.parquet(f"file://{tmp_path}/s/out/batch=0/is_state=true")
    assert {*state.columns, "is_state"} == set(plan.columns) and state.count() == 1
