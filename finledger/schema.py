"""Typed schemas of the ledger, book entries and statements (typed empty relations, S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
# sums of MONEY keep two decimals but need more digits at 100 TB scale
MONEY_SUM = T.DecimalType(38, 2)

LEDGER_BASE = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("amount", MONEY),
        T.StructField("fee", MONEY),
        T.StructField("net_amount", MONEY),
        T.StructField("status", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("customer_email", T.StringType()),
        T.StructField("is_refund", T.BooleanType()),
        T.StructField("balance_impact", T.StringType()),
    ]
)

LEDGER = T.StructType(
    LEDGER_BASE.fields
    + [
        T.StructField("month", T.DateType()),
        T.StructField("yearmon", T.StringType()),
        T.StructField("yr", T.IntegerType()),
    ]
)

BOOKS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("trans_type", T.StringType()),
        T.StructField("num", T.StringType()),
        T.StructField("posting", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("memo", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("entity", T.IntegerType()),
        T.StructField("month", T.DateType()),
    ]
)

STATEMENT = T.StructType(
    [
        T.StructField("statement_id", T.IntegerType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("value", MONEY_SUM),
    ]
)

FAILURES = T.StructType(
    [
        T.StructField("month", T.DateType()),
        T.StructField("status", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)

VENDORS = T.StructType(
    [T.StructField("vendor", T.StringType()), T.StructField("amount", MONEY_SUM)]
)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Typed empty relation used when an input is absent."""
    return spark.createDataFrame([], schema)
