"""Queries of file sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals
from ..sources import files, lake
from ..sources.tables import scratch
from ..streaming import jobs
from .continuity import Q as Q8
from .fixtures import fx, with_views


def io3(s, d):
    path = scratch(s, "tsv")
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), F.lit('say "hi"').alias("note"))
    o.write.csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="", nullValue="")
    return files.read_tsv(s, path, ["o_orderkey", "priority", "note"])


def filings(s, d, until=None):
    """A new lake of all submissions, or of those filed until a day."""
    root = scratch(s, "lakes")
    rows = fx(s, d, "fx_submissions").select("accession", "issuer_id", "owner_id", "form", "filing_date")
    lake.write_quarters(rows if until is None else rows.where(F.col("filing_date") <= F.lit(until).cast("date")), "filing_date", root)
    return root, rows


def io1(s, d):
    """Two years of a lake: the folders of the others aren't opened."""
    root, _ = filings(s, d)
    return lake.scan_partitioned(s, root, 1996, 1997, ["accession", "form", "filing_date"])


def io6(s, d):
    """The manifest of a lake that grows: a second run reads only the quarters that are new."""
    day = "1999-12-31"
    root, rows = filings(s, d, day)
    first, seen = lake.update_manifest(s, root, f"{root}-manifest", "form")
    lake.write_quarters(rows.where(F.col("filing_date") > F.lit(day).cast("date")), "filing_date", root)
    manifest, again = lake.update_manifest(s, root, f"{root}-manifest", "form")
    if set(seen) & set(again):
        raise ValueError("an unchanged quarter was read again")
    return lake.quarter_counts(manifest)


def el(name: str, *inside):
    return F.concat(F.lit(f"<{name}>"), *[F.lit(i) if isinstance(i, str) else i.cast("string") for i in inside], F.lit(f"</{name}>"))


def ownership_documents(s, d):
    """A document per filing, of all its lines and owners; some are empty, cut off, without owners or without lines."""
    v = lambda name, *c: el(name, el("value", *c))
    odd = F.col("accession") % 17
    line = lambda tag: el(
        tag, v("securityTitle", F.when(F.col("tab") == "derivative", "Option &amp; Warrant").otherwise("Common Stock")),
        F.when(F.col("row_kind") == "transaction", F.concat(
            el("transactionDate", el("value", F.coalesce(F.col("trans_date").cast("string"), F.lit("n/a"))), F.when(odd == 5, '<footnoteId id="F1"/><footnoteId id="F9"/>').otherwise("")), el("transactionCoding", el("transactionCode", F.col("trans_code"))),
            el("transactionAmounts", v("transactionShares", F.col("shares")), v("transactionAcquiredDisposedCode", F.col("side"))),
        )).otherwise(""),
        el("postTransactionAmounts", el("sharesOwnedFollowingTransaction", el("value", F.col("balance")), F.when(odd == 5, "<footnoteId id='F2'/>").otherwise(""))),
    )
    tags = {(t, k): f"{p}{k.capitalize()}" for t, p in (("non_derivative", "nonDerivative"), ("derivative", "derivative")) for k in ("transaction", "holding")}
    node = F.coalesce(*[F.when((F.col("tab") == t) & (F.col("row_kind") == k), line(tag)) for (t, k), tag in tags.items()])
    lines = fx(s, d, "fx_lines").select("accession", "line_no", "tab", node.alias("node")).groupBy("accession").agg(F.sort_array(F.collect_list(F.struct("line_no", "tab", "node"))).alias("l"))
    owner = el("reportingOwner", el("reportingOwnerId", el("rptOwnerCik", F.col("owner_cik"))), el("reportingOwnerRelationship", el("isDirector", F.when(F.col("owner_cik") % 2 == 0, "true").otherwise("0")), el("isOfficer", F.when(F.col("owner_cik") % 3 == 0, "1").otherwise(""))))
    owners = fx(s, d, "fx_owners").groupBy("accession").agg(F.array_join(F.sort_array(F.collect_list(owner)), "").alias("owners"))
    part = lambda t: F.array_join(F.transform(F.filter("l", lambda x: x["tab"] == t), lambda x: x["node"]), "")
    whole = el(
        "ownershipDocument", el("documentType", F.col("form")), el("issuer", el("issuerCik", F.regexp_extract("issuer_id", "([0-9]+)", 1))), F.when(odd == 3, "").otherwise(F.col("owners")),
        F.when(odd == 4, "").otherwise(F.concat(el("nonDerivativeTable", part("non_derivative")), el("derivativeTable", part("derivative")))),
        "<footnotes><footnote id='F2'>second\n note</footnote><footnote id='F1'>first &lt;note&gt;</footnote></footnotes>",
    )
    text = F.when(odd == 1, "").when(odd == 2, F.substring(whole, 1, 60)).otherwise(whole)
    return fx(s, d, "fx_submissions").join(lines, "accession").join(owners, "accession").select("accession", text.alias("xml"))


def io8(s, d):
    p = files.parse_ownership(ownership_documents(s, d))
    number = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return p.select(
        "accession", "parse_status", "row_kind", F.col("table").alias("table_name"), "form", "issuer_cik", "owner_cik", "owner_attribution_status", "is_director", "is_officer", "security_title", "transaction_date", "transaction_code", "acquired_disposed",
        number("shares"), number("shares_owned_following"), "footnote_ids", "footnotes",
    )


IO8_SQL = """WITH b AS (SELECT s.accession, s.form, accession % 17 AS odd, CAST(regexp_extract(issuer_id, '([0-9]+)', 1) AS BIGINT) AS issuer_cik FROM fx_submissions s WHERE accession IN (SELECT accession FROM fx_lines)),
o AS (SELECT b.*, owner_cik, k FROM b LEFT JOIN (SELECT accession, owner_cik, count(*) OVER (PARTITION BY accession) AS k FROM fx_owners) w ON w.accession = b.accession AND odd NOT IN (1, 2, 3)),
g AS (SELECT *, odd IN (1, 2) AS gone, CASE odd WHEN 1 THEN 'empty' WHEN 2 THEN 'error' WHEN 4 THEN 'no_rows' ELSE 'ok' END AS parse_status FROM o)
SELECT g.accession, parse_status, coalesce(row_kind, 'no_rows') AS row_kind, tab AS table_name, CASE WHEN NOT gone THEN g.form END AS form, CASE WHEN NOT gone THEN issuer_cik END AS issuer_cik, owner_cik,
  CASE WHEN k = 1 THEN 'single_owner' WHEN k > 1 THEN 'joint_owner_unallocated' ELSE 'unknown_owner' END AS owner_attribution_status, coalesce(owner_cik % 2 = 0, FALSE) AS is_director, coalesce(owner_cik % 3 = 0, FALSE) AS is_officer,
  CASE tab WHEN 'derivative' THEN 'Option & Warrant' WHEN 'non_derivative' THEN 'Common Stock' END AS security_title, CASE WHEN row_kind = 'transaction' THEN trans_date END AS transaction_date,
  CASE WHEN row_kind = 'transaction' THEN trans_code END AS transaction_code, CASE WHEN row_kind = 'transaction' THEN side END AS acquired_disposed, round(CASE WHEN row_kind = 'transaction' THEN shares END, 6) AS shares, round(balance, 6) AS shares_owned_following,
  CASE WHEN odd <> 5 OR row_kind IS NULL THEN '' WHEN row_kind = 'transaction' THEN 'F1|F9|F2' ELSE 'F2' END AS footnote_ids, CASE WHEN odd <> 5 OR row_kind IS NULL THEN '' WHEN row_kind = 'transaction' THEN 'first <note> | second note' ELSE 'second note' END AS footnotes
FROM g LEFT JOIN fx_lines l ON l.accession = g.accession AND odd NOT IN (1, 2, 4)"""


def io9(s, d):
    """Proposed sales: a block per sale of each filing; some documents stand in other text, some have no block, some plans."""
    odd = F.col("accession") % 7
    block = el(
        "securitiesInformation", el("securitiesClassTitle", "Common"), el("noOfUnitsSold", F.col("shares")), el("aggregateMarketValue", F.col("shares") * 10), el("approxSaleDate", F.date_format("filing_date", "MM/dd/yyyy")),
        el("brokerOrMarketmakerDetails", el("name", F.concat(F.lit("Broker "), F.col("line_no").cast("string")))),
    )
    sales = fx(s, d, "fx_lines").where("trans_code = 'S'").groupBy("accession").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", block.alias("b")))), lambda x: x["b"]), "").alias("blocks"))
    info = el("issuerInfo", el("issuerCik", F.regexp_extract("issuer_id", "([0-9]+)", 1)), el("issuerName", "Bio &amp; Co"), el("nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold", F.concat(F.lit("Owner "), F.col("owner_id").cast("string"))), "<relationshipsToIssuer><relationshipToIssuer>Officer</relationshipToIssuer><relationshipToIssuer>Director</relationshipToIssuer></relationshipsToIssuer>")
    plan = F.when(odd == 3, "<is10b5OnePlan>true</is10b5OnePlan><planAdoptionDate>a</planAdoptionDate><planAdoptionDate>b</planAdoptionDate><planAdoptionDate>a</planAdoptionDate>").otherwise("")
    whole = el("edgarSubmission", el("formData", info, F.coalesce(F.when(odd != 4, F.col("blocks")), F.lit("")), plan))
    text = F.when(odd == 1, F.concat(F.lit("<SEC-DOCUMENT> header\n<XML>"), whole, F.lit("</XML> trailer"))).when(odd == 2, "no form").when(odd == 5, "").otherwise(whole)
    docs = fx(s, d, "fx_submissions").join(sales, "accession").select("accession", text.alias("xml"))
    p = files.parse_proposed_sales(docs)
    number = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return p.select("accession", "parse_status", F.col("block_no").cast("long").alias("block_no"), "issuer_cik", "issuer_name", "filer", "relationship_to_issuer", "title", number("units"), number("market_value"), "sale_date", "broker", "plan_10b5_1")


IO9_SQL = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY line_no) - 1 AS block_no FROM fx_lines WHERE trans_code = 'S'),
b AS (SELECT accession, accession % 7 AS odd, accession % 7 IN (2, 5) AS gone, issuer_id, owner_id, filing_date FROM fx_submissions WHERE accession IN (SELECT accession FROM l))
SELECT b.accession, CASE odd WHEN 2 THEN 'error' WHEN 5 THEN 'empty' WHEN 4 THEN 'no_rows' ELSE 'ok' END AS parse_status, block_no, CASE WHEN NOT gone THEN CAST(regexp_extract(issuer_id, '([0-9]+)', 1) AS BIGINT) END AS issuer_cik,
  CASE WHEN NOT gone THEN 'Bio & Co' END AS issuer_name, CASE WHEN NOT gone THEN 'Owner ' || owner_id END AS filer, CASE WHEN gone THEN '' ELSE 'Officer | Director' END AS relationship_to_issuer, CASE WHEN block_no IS NOT NULL THEN 'Common' END AS title,
  round(shares, 6) AS units, round(shares * 10, 6) AS market_value, CASE WHEN block_no IS NOT NULL THEN b.filing_date END AS sale_date, 'Broker ' || line_no AS broker, CASE odd WHEN 3 THEN 'is10b5OnePlan=true | planAdoptionDate=a | planAdoptionDate=b' ELSE '' END AS plan_10b5_1
FROM b LEFT JOIN l ON l.accession = b.accession AND odd NOT IN (2, 4, 5)"""


def io11(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    text = F.concat(F.lit("ACCESSION NUMBER:  "), "o_orderkey", F.lit("\nCONFORMED SUBMISSION TYPE: 4\nREPORTING-OWNER:\n CENTRAL INDEX KEY: "), "o_custkey", F.lit("\nREPORTING-OWNER:\n CENTRAL INDEX KEY: 77\n"))
    f = files.sgml_header_fields(text)
    return o.select(f["accession"].alias("accession"), f["form"].alias("form"), F.array_join(f["owners"], ",").alias("owners"))


def io13(s, d):
    i = fx(s, d, "fx_intervals").withColumnsRenamed({"effective_start": "start", "effective_end": "end"})
    m = files.write_validated(s, {"intervals": i, "issuers": i.select("issuer_id").distinct()}, {"ordered": i.where("start > end"), "no_overlap": intervals.overlaps(i.where("security_id % 10 < 9"), ["issuer_id"])}, scratch(s, "published"))
    return m.select("table_name", "n_rows")


Q = {
    "io3_read_tsv": (io3, """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE '' END AS priority, 'say "hi"' AS note FROM orders"""),
    "io1_scan_partitioned": (io1, "SELECT accession, form, filing_date FROM fx_submissions WHERE year(filing_date) BETWEEN 1996 AND 1997"),
    "io6_manifest": (io6, """WITH q AS (SELECT CAST(year(filing_date) AS VARCHAR) || 'Q' || quarter(filing_date) AS quarter, form AS kind FROM fx_submissions)
        SELECT coalesce(quarter, 'total') AS quarter, kind, count(*) AS n FROM q GROUP BY GROUPING SETS ((quarter, kind), (kind))"""),
    "io8_bulk_parse_xml": (io8, IO8_SQL),
    "io9_bulk_parse_proposed_sales": (io9, IO9_SQL),
    "io11_sgml_header_fields": (io11, "SELECT CAST(o_orderkey AS VARCHAR) AS accession, '4' AS form, o_custkey || ',77' AS owners FROM orders"),
    "io13_write_validated": (io13, "SELECT 'intervals' AS table_name, count(*) AS n_rows FROM fx_intervals UNION ALL SELECT 'issuers', count(DISTINCT issuer_id) FROM fx_intervals"),
    "st1_incremental_upsert": (jobs.st1, "SELECT user_id, count(*) AS attempts, max(event_id) FILTER (WHERE event_type <> 'error') AS done_version, CASE WHEN max(event_id) FILTER (WHERE event_type <> 'error') IS NULL THEN 'failed' ELSE 'done' END AS status FROM events GROUP BY 1"),
    "st2_streaming_continuity": (jobs.st2, Q8["q8_ownership_continuity"][1]),
    "st3_as_of_snapshot": (jobs.st3, "SELECT user_id, event_id, event_type FROM events WHERE ts <= '2024-01-15 00:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    "st4_trailing_actor_alert": (jobs.st4, """WITH e AS (SELECT event_type, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE ts IS NOT NULL),
        w AS (SELECT event_type, user_id, CAST(CAST(ts AS DATE) - CAST(unnest(range(7)) AS INT) AS TIMESTAMP) AS start FROM e)
        SELECT event_type, start, start + INTERVAL 7 DAY AS "end", count(DISTINCT user_id) AS actors FROM w WHERE start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM e) GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 2"""),
}
QUERIES = {k: (f, with_views(q) if q else None) for k, (f, q) in Q.items()}
