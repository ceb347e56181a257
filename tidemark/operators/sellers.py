"""Owners' sales: loading them once, routine sellers, and what became public when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def owner_sales(submissions: DataFrame, transactions: DataFrame, owners: DataFrame, issuers: DataFrame, start: str, end: str) -> tuple[DataFrame, Observation]:
    """(sales, audit): original sales of the listed issuers, filed and done between two days, one row per line and owner.

    The audit counts rows, owners, pairs of owner and issuer, and their months while the rows pass, without a pass of its own:
    the first row of each is marked in windows over the owner's rows, which one shuffle brings together. Read it after
    the sales have been written.
    """
    between = lambda c: F.col(c).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    filed = submissions.where((F.col("form") == "4") & between("filing_date")).select("accession", "filing_date", "issuer_id")
    filed = filed.join(issuers.select("issuer_id").distinct(), "issuer_id", "left_semi")
    done = transactions.where((F.col("trans_code") == "S") & between("trans_date")).select("accession", F.col("row_id").alias("transaction_key"), F.col("trans_date").alias("transaction_date"))
    sold = done.join(filed, "accession").join(owners.where("owner_cik IS NOT NULL").select("accession", F.col("owner_cik").alias("owner_id")), "accession")
    sold = sold.dropDuplicates(["owner_id", "transaction_key"])
    order = ["transaction_date", "transaction_key"]
    first = lambda *keys: F.row_number().over(Window.partitionBy("owner_id", *keys).orderBy(*order)) == 1
    month = F.trunc("transaction_date", "MM")
    marked = sold.withColumn("_month", month).withColumns({"_owner": first(), "_pair": first("issuer_id"), "_in_month": first("issuer_id", "_month")})
    audit = Observation("owner_sales")
    seen = marked.observe(
        audit, F.count("*").alias("owner_sale_rows"), F.count_if("_owner").alias("owners"), F.count_if("_pair").alias("owner_issuer_pairs"), F.count_if("_in_month").alias("sale_month_rows")
    )
    return seen.select("transaction_key", "accession", "owner_id", "issuer_id", "transaction_date", "filing_date"), audit


def month_availability(business: DataFrame) -> DataFrame:
    """(year, month, available_on): the second business day after a month's end, when its filings are taken as public.

    ``business`` lists business days; a month counts if two follow it in the next one."""
    w = Window.partitionBy(F.trunc("day", "MM")).orderBy("day")
    second = business.withColumn("_k", F.row_number().over(w)).where("_k = 2")
    before = F.add_months(F.trunc("day", "MM"), -1)
    return second.select(F.year(before).alias("year"), F.month(before).alias("month"), F.col("day").alias("available_on"))


def firm_months(owner_months: DataFrame) -> DataFrame:
    """Owner states by issuer and month: SSN if any eligible owner stayed silent."""
    n = lambda c: F.count_if(c).alias
    g = owner_months.groupBy("issuer", "year", "month", "available_on").agg(
        F.count_distinct("owner").alias("owners"), n(F.col("state") == "SSN")("ssn"), n(F.col("state") == "SSS")("sss"), n(F.col("late"))("late")
    )
    return g.withColumn("signal_type", F.when(F.col("ssn") > 0, "SSN").otherwise("SSS_only"))


def issuer_day_class(sales: DataFrame, classes: DataFrame) -> DataFrame:
    """Sellers of each issuer-day by the class they held on 1 January of the filing's year; the day takes the rarest class present."""
    held = classes.select(F.col("owner").alias("owner_id"), F.col("issuer").alias("issuer_id"), F.col("year").alias("_y"), "seller_class")
    x = sales.withColumn("_y", F.year("filing_date")).join(held, ["owner_id", "issuer_id", "_y"], "left").withColumn("_c", F.coalesce("seller_class", F.lit("unclassified")))
    names = ("opportunistic", "routine", "unclassified")
    g = x.groupBy("issuer_id", "filing_date").agg(*[F.count_distinct(F.when(F.col("_c") == c, F.col("owner_id"))).alias(c) for c in names])
    return g.withColumn("day_class", F.when(F.col("opportunistic") > 0, "opportunistic").when(F.col("routine") > 0, "routine").otherwise("unclassified"))
