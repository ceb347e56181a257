"""Column functions of the filing pipeline. Dirty input becomes null; nothing throws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerce_number(c: Column) -> Column:
    return c.try_cast("double")


def coerce_date(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(c, pattern)


def money_to_decimal(c: Column) -> Column:
    """Text with $ and thousands separators as an exact decimal."""
    return F.trim(F.regexp_replace(c, "[$,]", "")).try_cast("decimal(38,6)")


def normalize_ticker(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def normalize_security(c: Column) -> Column:
    """Lower-case slug; the usual spellings of common stock become one."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug.rlike("^(common|common_shares|common_stock)$"), "common_stock").otherwise(slug)


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def role_flags(relationship: Column, title: Column) -> dict[str, Column]:
    letters, t = F.regexp_replace(F.lower(relationship), "[^a-z]", ""), F.lower(F.coalesce(title, F.lit("")))
    flags = {
        "is_officer": letters.contains("officer"),
        "is_director": letters.contains("director"),
        "is_ten_percent": letters.contains("tenpercentowner"),
        "is_other": letters.contains("other"),
        "is_ceo": t.rlike(r"\bceo\b|chief executive"),
        "is_cfo": t.rlike(r"\bcfo\b|chief financial"),
        "is_coo": t.rlike(r"\bcoo\b|chief operating"),
        "is_chair": t.rlike(r"\bchair(man|woman|person)?\b"),
        "is_president": t.rlike(r"\bpresident\b") & ~t.rlike(r"vice|\bvp\b"),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}


def role_precedence(flags: dict[str, Column]) -> Column:
    top = flags["is_ceo"] | flags["is_cfo"] | flags["is_coo"] | flags["is_chair"] | flags["is_president"]
    return (
        F.when(top, "top_executive").when(flags["is_officer"], "other_officer").when(flags["is_director"], "director")
        .when(flags["is_ten_percent"], "ten_percent_owner").otherwise("other")
    )


def seniority(role: Column) -> Column:
    return F.when(role == "top_executive", 3).when(role.isin("other_officer", "director"), 2).otherwise(1)


def row_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def available_at(accepted: Column, filing_date: Column, zone: str = "America/New_York") -> Column:
    """Acceptance time, else the last microsecond of the filing day in New York, in UTC."""
    day_end = (F.date_add(filing_date, 1).cast("timestamp_ntz") - F.expr("INTERVAL '0.000001' SECOND")).cast("timestamp_ntz")
    return F.coalesce(accepted, F.to_utc_timestamp(day_end, zone))


def winsorize(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def holding_fraction(shares: Column, after: Column, side: Column, cap: float = 10.0) -> Column:
    """Shares over the holding before the trade; null if that isn't positive."""
    before = after - side * shares
    return F.when(before > 0, F.least(F.lit(cap), shares / before))


def detect_format(text: Column, name: Column | None = None) -> Column:
    """Class of a document by its first bytes, by markers in its first 8000 characters in fixed precedence, by the ending of
    its name, and at last by a legacy form's title anywhere."""
    body = F.coalesce(text, F.lit(""))
    head = F.lower(F.substring(body, 1, 8000))
    named = F.coalesce(F.lower(name).rlike(r"\.html?$"), F.lit(False)) if name is not None else F.lit(False)
    has = lambda *marks: [head.contains(m) for m in marks]
    envelope, docs, kind = has("<sec-document", "<document>", "<type>")
    blocks, units, form144, issuer = has("securitiesinformation", "noofunitssold", "<submissiontype>144", "issuerinfo")
    return (
        F.when(F.trim(body) == "", "empty").when(F.startswith(body, F.lit("%PDF-")), "pdf").when(envelope | (docs & kind), "submission")
        .when(head.rlike(r"<(?:\w+:)?ownershipdocument\b"), "ownership_xml").when(blocks | units | form144 | issuer, "proposed_sale_xml")
        .when(head.contains("<!doctype html") | head.contains("<html") | named, "rendered_html").when(F.upper(body).contains("STATEMENT OF CHANGES IN BENEFICIAL OWNERSHIP"), "legacy_text").otherwise("unknown")
    )


def text_mention_flags(text: Column) -> dict[str, Column]:
    """Mentions of a trading plan (spaces, hyphens and dashes between the parts) and of private deals (whole words)."""
    found = {"mentions_plan": text.rlike(r"(?i)10b5[\s\-\u2013]*1"), "mentions_private": text.rlike(r"(?i)\bprivate(ly)?\b")}
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


# Codes of the classification standards
BIOTECH_GICS, PHARMA_GICS, BIOTECH_SIC, PHARMA_SIC = "35201010", "35202010", 2836, 2834


def classification(gics: Column, crsp_sic: Column, compustat_sic: Column) -> dict[str, Column]:
    """Columns classification_source, _code and _rule, is_biotech and is_pharma: GICS decides where present, else the CRSP SIC, else
    Compustat's (0 counts as missing of both; a Compustat 0 stays as code)."""
    code = F.when(F.trim(gics) != "", F.trim(gics))
    own = F.nullif(crsp_sic.cast("int"), F.lit(0))
    comp = compustat_sic.cast("int")
    sic = F.coalesce(own, comp)
    rule = (
        F.when(code == BIOTECH_GICS, "GICS_STRICT_BIOTECH_EXACT").when(code == PHARMA_GICS, "GICS_PHARMA_EXACT").when(code.isNotNull(), "GICS_OTHER")
        .when(sic == BIOTECH_SIC, "SIC_2836_FALLBACK").when(sic == PHARMA_SIC, "SIC_2834_FALLBACK").when(sic.isNotNull(), "SIC_OTHER_FALLBACK").otherwise("NO_CLASSIFICATION")
    )
    source = F.when(code.isNotNull(), "GICS").when(own.isNotNull(), "CRSP_SIC").when(comp.isNotNull() & (comp != 0), "COMPUSTAT_SIC").otherwise("UNCLASSIFIED")
    return {
        "classification_source": source, "classification_code": F.coalesce(code, sic.cast("string")), "classification_rule": rule,
        "is_biotech": rule.isin("GICS_STRICT_BIOTECH_EXACT", "SIC_2836_FALLBACK"), "is_pharma": rule.isin("GICS_PHARMA_EXACT", "SIC_2834_FALLBACK"),
    }


def ranked(column: str, values: list[str]) -> Column:
    """Place of a column's value among ``values``, 9 for any other or none."""
    out = F.lit(9)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out
