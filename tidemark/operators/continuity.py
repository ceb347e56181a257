"""Positions of owners: rows from several tables, amendments that replace rows, and the balance check."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.tables import discard, few, written
from .joins import pit_map

POSITION = ["issuer_id", "owner_id", "table", "security_title", "direct_or_indirect"]
JOINT = "joint_owner_unallocated"
ROUNDS = 32
"""Pointer-jumping rounds at most: chains of 2^32 amendments; what is still unsettled then stays quarantined."""


def continuity_rows(submissions: DataFrame, owners: DataFrame, sources: list[tuple[DataFrame, str, str]], intervals: DataFrame) -> DataFrame:
    """One row per line and owner of four differently shaped tables, each given with its row kind and table name.

    Columns align by name, those that a table lacks are null. A filing of one distinct owner is allocated to that owner, any
    other is joint. The event date is the transaction's, else the period's, else the filing's. The security is the issuer's on
    that date if exactly one is known, point-in-time intervals first. ``owner_row_id`` names line and owner.
    """
    rows = owner_rows(submissions, owners, sources)
    return with_security(rows, security_days(rows, intervals))


def owner_rows(submissions: DataFrame, owners: DataFrame, sources: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """The rows of ``continuity_rows`` without their security. Filings are independent of each other."""
    lines = None
    for frame, kind, table in sources:
        own = frame.withColumns({"row_kind": F.lit(kind), "table": F.lit(table)})
        lines = own if lines is None else lines.unionByName(own, allowMissingColumns=True)
    counted = owners.groupBy("accession").agg(F.countDistinct("owner_cik").alias("_k"))
    status = F.when(F.col("_k") == 1, "single_owner").otherwise(JOINT)
    named = owners.join(counted, "accession").select("accession", F.col("owner_cik").alias("owner_id"), status.alias("owner_attribution_status"))
    rows = lines.join(submissions.select("accession", "filing_date", "period_of_report", "form", "issuer_id"), "accession").join(named, "accession", "left")
    identity = lambda c: F.concat_ws(":", c, F.coalesce(F.col("owner_id").cast("string"), F.lit("")))
    return rows.select(
        "accession", "line_no", "row_kind", "table", "security_title", F.col("direct_indirect_ownership").alias("direct_or_indirect"), "issuer_id", "owner_id", "owner_attribution_status",
        F.coalesce("trans_date", "period_of_report", "filing_date").alias("event_date"), "filing_date", F.col("filing_date").alias("available_at"),
        F.col("trans_code").alias("transaction_code"), F.col("trans_shares").alias("shares"), F.col("trans_acquired_disp_cd").alias("acquired_disposed"), F.col("shrs_ownd_folwng_trans").alias("reported"),
        F.endswith(F.coalesce("form", F.lit("")), F.lit("/A")).alias("is_amendment"), identity("row_id").alias("owner_row_id"), F.when(F.col("amends_row_id").isNotNull(), identity("amends_row_id")).alias("amends_owner_row_id"),
    )


def security_days(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """(issuer_id, event_date, security_id): one row a day on which an issuer has rows."""
    days = rows.select("issuer_id", "event_date").distinct()
    mapped = pit_map(days, intervals, "issuer_id", "event_date", ["issuer_id", "event_date"], "security_id", "effective_start", "effective_end", "is_point_in_time", months=12)
    return mapped.select("issuer_id", "event_date", "security_id")


def with_security(rows: DataFrame, days: DataFrame) -> DataFrame:
    return rows.join(days, ["issuer_id", "event_date"], "left")


def resolve_amendments(rows: DataFrame, as_of=None, keys: list[str] = POSITION) -> DataFrame:
    """``rows`` plus amendment_status, record_active and superseded_by, as known at ``as_of`` (None: now).

    An amendment replaces a row only by naming its ``owner_row_id``, which must be unique, of the same ``keys``, available
    strictly earlier and active; of several the first available wins (ids settle ties). Joint owners and rows of repeated
    or no id replace nothing. All others are quarantined, and no row is dropped. Only the first statically fitting amendment of
    a row can win, so links are paths; a path holds if it begins at an original, which pointers find in as many rounds as
    the logarithm of the longest one.
    """
    return with_amendments(rows, amendment_links(rows, as_of, keys), as_of)


def _live(as_of) -> Column:
    live = F.col("available_at").isNotNull()
    return live if as_of is None else live & (F.col("available_at") <= F.lit(as_of))


def _status(as_of) -> Column:
    return F.when(~_live(as_of), "not_available").when(~F.col("is_amendment"), "original").when(F.col("_held"), "explicit_row_link").otherwise("unresolved_quarantined")


def amendment_links(rows: DataFrame, as_of=None, keys: list[str] = POSITION) -> DataFrame:
    """(parent, child) of all replacements that hold at ``as_of``. Of ``rows`` only those that amend or are amended are grouped by id."""
    amending = rows.where(_live(as_of) & F.col("is_amendment") & F.col("amends_owner_row_id").isNotNull() & F.coalesce(F.col("owner_attribution_status") == "single_owner", F.lit(False)))
    amending = amending.select(F.col("owner_row_id").alias("child"), F.col("amends_owner_row_id").alias("parent"), "available_at", *keys)
    named = amending.select(F.explode(F.array("child", "parent")).alias("owner_row_id")).distinct()
    unique = rows.join(named, "owner_row_id", "left_semi").groupBy("owner_row_id").agg(
        F.count("*").alias("_k"), F.min("available_at").alias("_at"), F.bool_or("is_amendment").alias("_am"), *[F.min(c).alias(f"_{c}") for c in keys]
    ).where("_k = 1")
    unique = written(unique)
    amending = amending.join(unique.select(F.col("owner_row_id").alias("child")), "child", "left_semi")
    fits = F.col("_at") < F.col("available_at")
    for c in keys:
        fits = fits & F.col(c).eqNullSafe(F.col(f"_{c}"))
    links = amending.join(unique.withColumnRenamed("owner_row_id", "parent"), "parent").where(fits)
    won = written(links.groupBy("parent").agg(F.min(F.struct("available_at", "child")).alias("w")).select("parent", F.col("w.child").alias("child")))
    heads = won.select("child", F.col("parent").alias("head"))
    made = []
    for _ in range(ROUNDS):  # each head becomes its head's head
        up = heads.select(F.col("child").alias("head"), F.col("head").alias("_up"))
        heads = written(heads.join(up, "head", "left").select("child", F.coalesce("_up", "head").alias("head"), F.col("_up").isNotNull().alias("moved")))
        discard(*made)
        made = [heads]
        if heads.where("moved").isEmpty():
            break
        heads = heads.drop("moved")
    original = unique.where("NOT _am").select(F.col("owner_row_id").alias("head"))
    held = written(won.join(heads.join(original, "head", "left_semi").select("child"), "child", "left_semi"))
    discard(unique, won, *made)
    return held.select("parent", "child")


def with_amendments(rows: DataFrame, held: DataFrame, as_of=None) -> DataFrame:
    """``rows`` plus amendment_status, record_active and superseded_by, from the replacements that hold."""
    out = rows.join(held.select(F.col("child").alias("owner_row_id"), F.lit(True).alias("_held")), "owner_row_id", "left")
    out = out.join(held.select(F.col("parent").alias("owner_row_id"), F.col("child").alias("superseded_by")), "owner_row_id", "left")
    out = out.withColumn("amendment_status", _status(as_of))
    active = F.col("amendment_status").isin("original", "explicit_row_link") & F.col("superseded_by").isNull()
    return out.withColumn("record_active", active).select(*rows.columns, "amendment_status", "record_active", "superseded_by")


def with_status(rows: DataFrame, held: DataFrame, as_of=None) -> DataFrame:
    """``rows`` plus amendment_status alone: only amendments meet ``held``, the other rows aren't shuffled."""
    amends = F.coalesce(F.col("is_amendment"), F.lit(True))
    linked = rows.where(amends).join(held.select(F.col("child").alias("owner_row_id"), F.lit(True).alias("_held")), "owner_row_id", "left")
    others = rows.where(~amends).withColumn("_held", F.lit(None).cast("boolean"))
    return others.unionByName(linked).withColumn("amendment_status", _status(as_of)).drop("_held")


class Position(NamedTuple):
    position: float
    event_day: int
    splits: float
    row_id: str | None


def continuity_step(state: Position | None, row: dict, tolerance: float) -> tuple[Position | None, tuple]:
    """One row against the position before it: (position after, (factor, expected, difference, status)).

    ``row`` has event_day (days), splits (product of the issuer's split factors up to that day), row_kind, shares,
    acquired_disposed, reported, is_amendment, amendment_status, owner_attribution_status and the two row ids.
    """
    day, reported, shares, side = row["event_day"], row["reported"], row["shares"], row["acquired_disposed"]
    after = Position(reported, day, row["splits"], row["owner_row_id"])
    plain = lambda status: (state, (1.0, None, None, status))
    if row["amendment_status"] == "not_available":
        return plain("NOT_AVAILABLE_AS_OF")
    if row["owner_attribution_status"] != "single_owner":
        return plain("NOT_TESTABLE_OWNER_ATTRIBUTION")
    if row["is_amendment"]:
        if row["amendment_status"] != "explicit_row_link":
            return plain("SKIP_AMENDMENT")
        if state is not None and state.row_id == row["amends_owner_row_id"] and reported is not None and day is not None:
            return after, (1.0, None, None, "AMENDMENT_BASELINE_RESET")
        return plain("REVIEW_AMENDMENT_INTERVENING_STATE")
    if day is None:
        return plain("NOT_TESTABLE_MISSING_DATE")
    if row["row_kind"] not in ("transaction", "holding"):
        return plain("NOT_TESTABLE_ROW_KIND")
    if state is not None and day < state.event_day:
        return plain("NOT_TESTABLE_LATE_DISCLOSURE")
    if reported is None:
        return plain("NOT_TESTABLE_MISSING_POSITION")
    moved = row["row_kind"] == "transaction"
    if moved and (shares is None or shares < 0 or side not in ("A", "D")):
        return after, (1.0, None, None, "RESET_BASELINE_MISSING_TRANSACTION")
    if state is None:
        return after, (1.0, None, None, "BASELINE_NO_PRIOR" if moved else "BASELINE_HOLDING")
    net = 0.0 if not moved else shares if side == "A" else -shares
    factor = row["splits"] / state.splits
    expected = state.position * factor + net
    difference = reported - expected
    if abs(difference) <= tolerance:
        return after, (factor, expected, 0.0, "PASS")
    return after, (factor, expected, difference, "FLAG_REVIEW_UNADJUSTED" if abs(factor - 1) < 1e-12 else "FLAG_REVIEW")


STEP_COLUMNS = ["row_kind", "shares", "acquired_disposed", "reported", "is_amendment", "amendment_status", "owner_attribution_status", "owner_row_id", "amends_owner_row_id"]
ORDER = ["available_at", "accession", "event_day", "line_no"]
CHECKED = "owner_row_id string, factor double, expected double, difference double, status string"
STATE = ["event_day", "splits", "reported", "owner_row_id"]
"""Where a row holds a position instead: its fields lie in these columns."""


def with_splits(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` plus ``event_day`` and ``splits``, the product of the issuer's factors up to the event date.

    The splits of an issuer are few; their running products are looked up by date in one sorted array, so no row meets them
    all. Few arrays are broadcast.
    """
    order = Window.partitionBy("issuer_id").orderBy("effective_date").rowsBetween(Window.unboundedPreceding, 0)
    daily = splits.groupBy("issuer_id", "effective_date").agg(F.product("split_factor").alias("_f"))
    running = daily.withColumn("_p", F.product("_f").over(order))
    listed = running.groupBy("issuer_id").agg(F.sort_array(F.collect_list(F.struct("effective_date", "_p"))).alias("_splits"))
    if few(daily) is not daily:  # as many splits as all arrays hold
        listed = F.broadcast(listed)
    known = F.filter("_splits", lambda s: s["effective_date"] <= F.col("event_date"))
    out = rows.join(listed, "issuer_id", "left").withColumn("_known", known)
    product = F.when(F.size("_known") > 0, F.element_at("_known", -1)["_p"]).otherwise(1.0)
    return out.withColumn("splits", F.coalesce(product, F.lit(1.0))).withColumn("event_day", F.unix_date("event_date")).drop("_splits", "_known")


def step_rows(rows: DataFrame, splits: DataFrame, keys: list[str] = POSITION) -> DataFrame:
    """What the step needs of resolved rows, with their key and order."""
    return with_splits(rows, splits).select(*keys, *ORDER, "splits", *STEP_COLUMNS, F.lit(False).alias("is_state"))


def _values(column: pa.Array) -> list:
    """A column's values, None where null, several times faster than ``to_pylist`` for plain types."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_boolean(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy().tolist()
    out = column.fill_null(0).to_numpy().tolist()
    for i in column.is_null().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
        out[i] = None
    return out


def pass_rows(ready: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Rows of ``step_rows`` through the step, key by key; a row that ``is_state`` holds its key's position before them.

    Returns the columns of the result of every row and, with ``is_state`` set, every key's last position in the form in
    which it is read. Rows reach a task sorted and pass one by one, so a key of any length takes no more memory than another.
    """
    order = [*[F.col(c).asc_nulls_first() for c in keys], F.desc("is_state"), *[F.col(c).asc_nulls_last() for c in ORDER], F.col("owner_row_id").asc_nulls_last()]
    ready = ready.repartition(*keys).sortWithinPartitions(*order).select(*keys, "event_day", "splits", *STEP_COLUMNS, "is_state")
    results = [f.name for f in StructType.fromDDL(CHECKED)]
    held = [*keys, *[c for c in STATE if c != "owner_row_id"]]
    row_names = ["event_day", "splits", *STEP_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kinds = None, None, None

        def table(out: list[tuple], ended: list[tuple]) -> pa.RecordBatch:
            """Results, then positions (key, event_day, splits, reported, owner_row_id) of keys that have ended."""
            n, m = len(out), len(ended)
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if n else [[]] * 5, [pa.string(), *[pa.float64()] * 3, pa.string()])]
            ids, *numbers = columns
            blank = lambda k: pa.nulls(m, k)
            join = lambda x, y: pa.concat_arrays([x, y])
            whole = [join(ids, pa.array([e[1].row_id for e in ended], pa.string())), *[join(c, blank(c.type)) for c in numbers]]
            whole += [join(pa.nulls(n, k), pa.array([e[0][i] for e in ended], k)) for i, k in enumerate(kinds[: len(keys)])]
            whole += [join(pa.nulls(n, k), pa.array([getattr(e[1], f) for e in ended], k)) for f, k in zip(("event_day", "splits", "position"), kinds[len(keys) :])]
            return pa.RecordBatch.from_arrays([*whole, pa.array([False] * n + [True] * m, pa.bool_())], names=[*results, *held, "is_state"])

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in held]
            columns = {c: _values(batch.column(c)) for c in batch.schema.names}
            out, ended = [], []
            for key, was, values in zip(zip(*[columns[c] for c in keys]), columns["is_state"], zip(*[columns[c] for c in row_names])):
                if key != now:
                    if state is not None:
                        ended.append((now, state))
                    now, state = key, None
                row = dict(zip(row_names, values))
                if was:
                    state = Position(row["reported"], row["event_day"], row["splits"], row["owner_row_id"])
                else:
                    state, found = continuity_step(state, row, tolerance)
                    out.append((row["owner_row_id"], *found))
            yield table(out, ended)
        if state is not None:
            yield table([], [(now, state)])

    schema = StructType([*StructType.fromDDL(CHECKED), *[StructField(c, ready.schema[c].dataType) for c in held], ready.schema["is_state"]])
    return ready.mapInArrow(run, schema)


def ownership_continuity(rows: DataFrame, splits: DataFrame, keys: list[str] = POSITION, tolerance: float = 1e-6) -> DataFrame:
    """(owner_row_id, factor, expected, difference, status) of resolved rows, each against its position before it.

    Rows come by availability, accession, event date and line. A late disclosure, a joint owner, an unlinked amendment or a
    missing position leaves the position as it is; a linked amendment replaces it only if nothing came between. The state is
    one position a key.
    """
    return pass_rows(step_rows(rows, splits, keys), keys, tolerance).where("NOT is_state").select(*[f.name for f in StructType.fromDDL(CHECKED)])


def continuity_audit(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """``rows`` plus status and reason of the audit: consistent, first_observation, inconsistent or not_comparable.

    A flag whose security is unknown can't be told from a split; a first observation of a further security of the same owner and
    issuer is a change of security.
    """
    j = rows.join(checked, "owner_row_id")
    s, flagged = F.col("status"), F.col("status").startswith("FLAG")
    status = F.when(s == "PASS", "consistent").when(s.startswith("BASELINE"), "first_observation").when(flagged & F.col("security_id").isNotNull(), "inconsistent").otherwise("not_comparable")
    reason = (
        F.when(s == "PASS", "reconciled").when(s.startswith("BASELINE"), "missing_prior").when(s == "SKIP_AMENDMENT", "amendment").when(s.contains("OWNER_ATTRIBUTION"), "owner_attribution")
        .when(flagged & F.col("security_id").isNull(), "split_unmatched").when(flagged, "arithmetic_mismatch").otherwise(F.lower(s))
    )
    j = j.withColumn("audit", status).withColumn("reason", reason)
    first = Window.partitionBy("owner_id", "issuer_id").orderBy(F.col("event_date").asc_nulls_last(), "available_at", "accession", "line_no", "owner_row_id")
    change = (F.col("audit") == "first_observation") & (F.row_number().over(first) > 1)
    return j.withColumn("_change", change).withColumn("audit", F.when(F.col("_change"), "not_comparable").otherwise(F.col("audit"))).withColumn(
        "reason", F.when(F.col("_change"), "security_change").otherwise(F.col("reason"))
    ).drop("_change")
