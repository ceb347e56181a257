"""File sources and sinks of the filing pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names of the two filing formats
OWNERSHIP = """documentType STRING, periodOfReport STRING, aff10b5One STRING,
issuer STRUCT<issuerCik: STRING, issuerName: STRING, issuerTradingSymbol: STRING>,
reportingOwner ARRAY<STRUCT<reportingOwnerId: STRUCT<rptOwnerCik: STRING, rptOwnerName: STRING>,
  reportingOwnerRelationship: STRUCT<isDirector: STRING, isOfficer: STRING, isTenPercentOwner: STRING, isOther: STRING, officerTitle: STRING>>>,
_corrupt_record STRING"""
_V = "STRUCT<value: STRING>"
LINE = f"""securityTitle {_V}, transactionDate {_V}, transactionCoding STRUCT<transactionCode: STRING>, conversionOrExercisePrice {_V}, exerciseDate {_V}, expirationDate {_V},
transactionAmounts STRUCT<transactionShares: {_V}, transactionPricePerShare: {_V}, transactionAcquiredDisposedCode: {_V}>,
underlyingSecurity STRUCT<underlyingSecurityTitle: {_V}, underlyingSecurityShares: {_V}>,
postTransactionAmounts STRUCT<sharesOwnedFollowingTransaction: {_V}>, ownershipNature STRUCT<directOrIndirectOwnership: {_V}, natureOfOwnership: {_V}>"""
PROPOSED = """issuerInfo STRUCT<issuerCik: STRING, issuerName: STRING, nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold: STRING>,
securitiesInformation ARRAY<STRUCT<securitiesClassTitle: STRING, noOfUnitsSold: STRING, aggregateMarketValue: STRING, approxSaleDate: STRING,
  brokerOrMarketmakerDetails: STRUCT<name: STRING>>>, _corrupt_record STRING"""
PLAN = ("is10b5OnePlan", "is10b5OneTradingArrangement", "dateOfAdoptionOfTradingPlan", "dateOfAdoptionOfTradingArrangement", "planAdoptionDate")
TABLES = (("non_derivative", "nonDerivative"), ("derivative", "derivative"))
JOINT, SINGLE, UNKNOWN = "joint_owner_unallocated", "single_owner", "unknown_owner"


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text with a header, every value text; empty fields are empty strings, bad lines errors."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    raw = spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST", quote='"', escape='"')
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def elements(xml: Column, names: str, group: int = 0) -> Column:
    """Whole elements (group 0), or what stands in them (2), of the given names (a|b) in their order, whatever their prefix."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?({names})\b[^>]*?(?:/>|>(.*?)</(?:\w+:)?\1\s*>)"), F.lit(group))


def plain_text(inner: Column) -> Column:
    """The text of an element's inside: tags go, blanks become single spaces, the five named entities their characters."""
    out = F.trim(F.regexp_replace(F.regexp_replace(inner, r"<[^>]*>", " "), r"\s+", " "))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def flag(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "y", "yes"), F.lit(False))


def parse_ownership(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per economic line and owner of each ownership document, and one per owner of a document without lines.

    Lines are the transactions and holdings of both tables in their order, each with the footnotes that it refers to, looked
    up in its own document. parse_status: ok, no_rows (valid, nothing in it), empty (no text), error (not a document of this
    kind). No document is dropped: without an owner its rows have none, with several every line is joint.
    """
    x = F.col(f"`{xml}`")
    text = F.trim(F.coalesce(x, F.lit("")))

    def table_lines(name: str, tag: str) -> Column:
        kind = lambda n: F.when(n.rlike(rf"^<(?:\w+:)?{tag}Transaction\b"), "transaction").otherwise("holding")
        return F.transform(elements(x, f"{tag}Transaction|{tag}Holding"), lambda n: F.struct(F.lit(name).alias("table"), kind(n).alias("kind"), n.alias("node")))

    lines = F.concat(*[table_lines(*t) for t in TABLES])
    note = lambda e: F.struct(F.regexp_extract(e, r"""^<[^>]*?\bid\s*=\s*["']([^"']*)["']""", 1).alias("id"), plain_text(e).alias("note"))
    notes = F.transform(elements(x, "footnote"), note)
    p = docs.withColumn("_d", F.from_xml(x, OWNERSHIP, {"mode": "PERMISSIVE", "rowTag": "ownershipDocument"}))
    bad = F.col("_d._corrupt_record").isNotNull() | F.col("_d.documentType").isNull()
    p = p.withColumn("_bad", F.when(text == "", "empty").when(bad, "error")).withColumns({"_lines": F.when(F.col("_bad").isNull(), lines), "_notes": F.when(F.col("_bad").isNull(), notes)})
    p = p.withColumn("parse_status", F.coalesce("_bad", F.when(F.size("_lines") > 0, "ok").otherwise("no_rows"))).withColumn("_k", F.coalesce(F.size("_d.reportingOwner"), F.lit(0)))
    rest = [c for c in docs.columns if c != xml]
    rows = p.select(*[f"`{c}`" for c in rest], "parse_status", "_d", "_notes", "_k", F.posexplode_outer("_lines").alias("line_no", "_l"))
    rows = rows.withColumn("_t", F.from_xml("_l.node", LINE, {"mode": "PERMISSIVE"}))
    rows = rows.select("*", F.explode_outer("_d.reportingOwner").alias("_o"))
    own, role, value = "_o.reportingOwnerId", "_o.reportingOwnerRelationship", lambda c: F.col(f"_t.{c}.value")
    number = lambda c: value(c).try_cast("decimal(38,6)")
    day = lambda c: F.try_to_date(F.substring(value(c), 1, 10), "yyyy-MM-dd")
    referred = F.array_distinct(F.regexp_extract_all(F.coalesce("_l.node", F.lit("")), F.lit(r"""<(?:\w+:)?footnoteId\s[^>]*?\bid\s*=\s*["']([^"']*)["']"""), F.lit(1)))
    noted = F.filter(F.transform(referred, lambda i: F.get(F.filter("_notes", lambda n: n["id"] == i), F.lit(0))["note"]), lambda n: n.isNotNull())
    return rows.select(
        *[F.col(f"`{c}`") for c in rest], "parse_status", "line_no", F.col("_l.table").alias("table"), F.coalesce("_l.kind", F.lit("no_rows")).alias("row_kind"),
        F.col("_d.documentType").alias("form"), F.col("_d.issuer.issuerCik").try_cast("long").alias("issuer_cik"), F.col("_d.issuer.issuerTradingSymbol").alias("issuer_ticker"), flag(F.col("_d.aff10b5One")).alias("rule_10b5_1"),
        F.col(f"{own}.rptOwnerCik").try_cast("long").alias("owner_cik"), F.col("_k").alias("owner_count"), F.when(F.col("_k") == 1, SINGLE).when(F.col("_k") > 1, JOINT).otherwise(UNKNOWN).alias("owner_attribution_status"),
        *[flag(F.col(f"{role}.{c}")).alias(n) for c, n in (("isDirector", "is_director"), ("isOfficer", "is_officer"), ("isTenPercentOwner", "is_ten_percent_owner"))], F.col(f"{role}.officerTitle").alias("officer_title"),
        value("securityTitle").alias("security_title"), day("transactionDate").alias("transaction_date"), F.col("_t.transactionCoding.transactionCode").alias("transaction_code"),
        number("transactionAmounts.transactionShares").alias("shares"), number("transactionAmounts.transactionPricePerShare").alias("price"), value("transactionAmounts.transactionAcquiredDisposedCode").alias("acquired_disposed"),
        number("postTransactionAmounts.sharesOwnedFollowingTransaction").alias("shares_owned_following"), value("ownershipNature.directOrIndirectOwnership").alias("direct_or_indirect"), number("conversionOrExercisePrice").alias("conversion_or_exercise_price"),
        day("expirationDate").alias("expiration_date"), value("underlyingSecurity.underlyingSecurityTitle").alias("underlying_security_title"),
        F.array_join(referred, "|").alias("footnote_ids"), F.array_join(noted, " | ").alias("footnotes"),
    )


def parse_proposed_sales(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per securities block of each proposed-sale document, one with its status for a document without.

    The submission may stand inside other text. Relationships and the fields about trading plans (name=value) are gathered from
    wherever they stand, distinct and in order, joined by |. parse_status as in ``parse_ownership``.
    """
    whole = F.coalesce(F.col(f"`{xml}`"), F.lit(""))
    form = F.get(elements(whole, "edgarSubmission"), F.lit(0))
    x = F.coalesce(F.when(form != "", form), whole)
    body = F.coalesce(F.get(elements(x, "formData"), F.lit(0)), x)
    p = docs.withColumn("_x", x).withColumn("_d", F.from_xml(body, PROPOSED, {"mode": "PERMISSIVE"}))
    bad = F.col("_d._corrupt_record").isNotNull() | (F.col("_d.issuerInfo").isNull() & F.col("_d.securitiesInformation").isNull())
    p = p.withColumn("parse_status", F.when(F.trim(whole) == "", "empty").when(bad, "error").when(F.size("_d.securitiesInformation") > 0, "ok").otherwise("no_rows"))

    def plan(name: str) -> Column:
        known = F.filter(F.transform(elements(F.col("_x"), name, 2), plain_text), lambda v: v != "")
        return F.transform(known, lambda v: F.concat(F.lit(f"{name}="), v))

    plans = F.concat(*[plan(name) for name in PLAN])
    p = p.withColumn("_plans", F.array_join(F.array_distinct(plans), " | ")).withColumn("_rel", F.array_join(F.transform(elements(F.col("_x"), "relationshipToIssuer", 2), plain_text), " | "))
    b = p.select("*", F.posexplode_outer("_d.securitiesInformation").alias("block_no", "_b"))
    return b.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != xml], "parse_status", "block_no", F.col("_d.issuerInfo.issuerCik").try_cast("long").alias("issuer_cik"), F.col("_d.issuerInfo.issuerName").alias("issuer_name"),
        F.col("_d.issuerInfo.nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold").alias("filer"), F.col("_rel").alias("relationship_to_issuer"), F.col("_b.securitiesClassTitle").alias("title"),
        F.col("_b.noOfUnitsSold").try_cast("decimal(38,6)").alias("units"), F.col("_b.aggregateMarketValue").try_cast("decimal(38,6)").alias("market_value"), F.try_to_date(F.col("_b.approxSaleDate"), "MM/dd/yyyy").alias("sale_date"),
        F.col("_b.brokerOrMarketmakerDetails.name").alias("broker"), F.col("_plans").alias("plan_10b5_1"),
    )


def sgml_header_fields(text: Column) -> dict[str, Column]:
    """Header values; the acceptance time is New York time turned into UTC."""
    at = F.try_to_timestamp(F.regexp_extract(text, r"<ACCEPTANCE-DATETIME>\s*([0-9]{14})", 1), F.lit("yyyyMMddHHmmss"))
    return {
        "accession": F.nullif(F.regexp_extract(text, r"ACCESSION NUMBER:\s*(\S+)", 1), F.lit("")),
        "form": F.nullif(F.regexp_extract(text, r"CONFORMED SUBMISSION TYPE:\s*(\S+)", 1), F.lit("")),
        "accepted_at": F.to_utc_timestamp(at, "America/New_York"),
        "owners": F.regexp_extract_all(text, F.lit(r"REPORTING-OWNER:[\s\S]*?CENTRAL INDEX KEY:\s*([0-9]+)"), F.lit(1)),
    }


def write_validated(spark: SparkSession, tables: dict[str, DataFrame], checks: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write ``tables`` under ``folder`` if no check has a violating row; returns the manifest (name, path, rows)."""
    failed = [name for name, bad in checks.items() if not bad.limit(1).isEmpty()]
    if failed:
        raise ValueError(f"checks failed: {', '.join(failed)}")
    rows = []
    for name, df in tables.items():
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        rows.append((name, path, spark.read.parquet(path).count()))
    return spark.createDataFrame(rows, "table_name string, path string, n_rows long")
