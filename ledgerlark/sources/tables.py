"""Readers, writers, and the credit domain's tables derived from the star-schema test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: Loading order: a table follows those that it refers to.
LOAD_ORDER = ("companies", "energy_contracts", "financial_statements", "invoices", "payments", "crm_support_tickets", "user_web_logins")


def table_path(folder: str, name: str) -> str:
    """Where a table's file or folder is; its name may have the ending already, but no folder."""
    if not name or "/" in name:
        raise ValueError(f"{name!r} isn't the name of a table")
    return f"{folder.rstrip('/')}/{name.removesuffix('.parquet')}.parquet"


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table; with a schema, a missing one reads as empty (an empty extract has no file)."""
    path = table_path(folder, name)
    if schema is None:
        return spark.read.parquet(path)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def extract_table(df: DataFrame, folder: str, name: str) -> bool:
    """Write a table's extract; an empty table leaves no file, not even an earlier one. Returns whether
    it wrote. Rows go to a folder beside the table's, which takes its place when all are there: a
    failure leaves the earlier extract as it was, and no half one."""
    spark = df.sparkSession
    path = table_path(folder, name)
    aside = f"{folder}/_{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.parquet(aside)
        empty = spark.read.schema(df.schema).parquet(aside).isEmpty()
        files.delete(hadoop(path), True)
        if not empty and not files.rename(hadoop(aside), hadoop(path)):
            raise OSError(f"{aside} could not take the place of {path}")
    finally:
        files.delete(hadoop(aside), True)
    return not empty


def restore_tables(spark: SparkSession, folder: str, database: str, schemas: dict[str, T.StructType]) -> list[str]:
    """Load extracts into tables of a database in dependency order; NaN becomes null."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    done = []
    for name in [n for n in LOAD_ORDER if n in schemas]:
        df = read_table(spark, folder, name, schemas[name])
        for field in schemas[name].fields:
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                df = df.withColumn(field.name, F.when(~F.isnan(field.name), F.col(field.name)))
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")
        done.append(name)
    return done


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, chunk: int = 100_000, **properties: str) -> DataFrame:
    """A database table in partitions of about `chunk` rows by ranges of a numeric key, whose bounds
    and number of rows the database is asked for first. Keys needn't be dense or unique; rows
    without one go to the first partition."""
    read = lambda **options: spark.read.format("jdbc").options(url=url, **properties, **options).load()
    low, high, rows = read(query=f"SELECT MIN({key}) AS l, MAX({key}) AS h, COUNT(*) AS n FROM {table}").first()
    if low is None or low == high:
        return read(dbtable=table)
    return read(dbtable=table, partitionColumn=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=-(-int(rows) // chunk))


def extract_database(spark: SparkSession, url: str, folder: str, keys: dict[str, str], chunk: int = 100_000, **properties: str) -> list[str]:
    """Extract the tables of `keys` (table -> numeric key) in loading order; the names of those that
    weren't empty. The first failure ends the run; extracts before it stay, its own isn't touched."""
    names = [n for n in LOAD_ORDER if n in keys] + [n for n in keys if n not in LOAD_ORDER]
    return [n for n in names if extract_table(read_jdbc(spark, url, n, keys[n], chunk, **properties), folder, n)]


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("y_true", "y_pred_proba").write.mode("overwrite").csv(path, header=True)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="y_true int, y_pred_proba double")


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


# --- the domain over the test tables --------------------------------------------------------

_D2 = "decimal(15,2)"


def companies(spark: SparkSession, d: str) -> DataFrame:
    customer, nation = read_table(spark, d, "customer"), read_table(spark, d, "nation")
    first = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("foundation_date"))
    return customer.join(first, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(  # nation: 25 rows
        F.col("c_custkey").alias("company_id"), F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("vat_number"), F.col("c_name").alias("legal_name"),
        F.lit("srl").alias("legal_form"), F.col("c_mktsegment").alias("industry_sector"), F.col("n_name").alias("registered_office_region"),
        "foundation_date", (F.col("c_acctbal") >= 0).alias("is_active"), F.col("foundation_date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
    )


def energy_contracts(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    power = F.col("o_orderkey") % 2 == 0
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "suspended").otherwise("terminated")
    return read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("contract_id"), F.col("o_custkey").alias("company_id"),
        F.when(power, "electricity").otherwise("gas").alias("commodity_type"), F.when(F.col("o_orderkey") % 5 == 0, "regulated").otherwise("free").alias("market_type"),
        F.when(power, F.when(F.col("o_orderkey") % 6 == 0, "Medium ").otherwise("Low")).alias("voltage_level"), F.when(~power, "low").alias("pressure_level"),
        F.when(power, F.round(F.col("o_totalprice") / 1000, 2)).alias("power_committed_kw"), F.when(~power, F.concat(F.lit(" g"), (F.col("o_orderkey") % 9).cast("string"))).alias("gas_meter_class"), day.alias("activation_date"),
        status.alias("contract_status"), day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
    )


def invoices(spark: SparkSession, d: str) -> DataFrame:
    issue = F.col("l_shipdate").cast("date")
    total = F.col("l_extendedprice").cast(_D2) * (1 - F.col("l_discount").cast("decimal(5,2)")) * (1 + F.col("l_tax").cast("decimal(5,2)"))
    status = F.when(F.col("l_returnflag") == "R", "overdue").when(F.col("l_returnflag") == "N", "unpaid").otherwise("paid")
    identity = F.concat_ws("/", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), issue.cast("string"))
    net = F.col("l_extendedprice").cast(_D2) * (1 - F.col("l_discount").cast("decimal(5,2)"))
    return read_table(spark, d, "lineitem").select(
        identity.alias("invoice_id"), F.col("l_orderkey").alias("contract_id"), issue.alias("issue_date"), F.date_add(issue, 20).alias("due_date"),
        total.cast(_D2).alias("total_amount"), status.alias("invoice_status"), F.concat(F.lit("INV-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("invoice_number"),
        F.when(F.col("l_orderkey") % 2 == 0, "electricity").otherwise("gas").alias("commodity_type"), net.cast(_D2).alias("amount_excluding_tax"), (total.cast(_D2) - net.cast(_D2)).cast(_D2).alias("tax_amount"),
    )


def payments(spark: SparkSession, d: str) -> DataFrame:
    issue = F.col("l_shipdate").cast("date")
    identity = F.concat_ws("/", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), issue.cast("string"))
    return read_table(spark, d, "lineitem").where("l_returnflag = 'A'").select(
        identity.alias("invoice_id"), F.concat(F.lit("P/"), identity).alias("payment_id"), F.date_add(issue, F.col("l_quantity").cast("int")).alias("payment_date"), F.lit("completed").alias("payment_status"), F.col("l_extendedprice").cast(_D2).alias("amount_paid"),
        F.concat(F.lit(" TX-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("transaction_reference"), F.when(F.col("l_linenumber") % 2 == 0, "Bank Transfer ").otherwise("card").alias("payment_method"),
    )


def financial_statements(spark: SparkSession, d: str) -> DataFrame:
    year = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year"))
    sums = year.agg(F.sum(F.col("o_totalprice").cast(_D2)).cast(_D2).alias("revenue"), F.count("*").alias("_n"))
    share = lambda top, mod: (F.col("revenue") * F.lit(top).cast("decimal(5,2)")).cast(_D2)
    return sums.select(
        "company_id", "fiscal_year", "revenue", share("0.10", 0).alias("ebitda"), F.when(F.col("_n") % 3 == 0, -share("0.05", 0)).otherwise(share("0.05", 0)).alias("net_income"),
        F.when(F.col("_n") % 4 == 0, F.lit(0).cast(_D2)).otherwise(share("0.30", 0)).alias("total_debt"), share("0.08", 0).alias("cash_and_equivalents"), share("0.25", 0).alias("share_capital"),
    )


def crm_support_tickets(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").where(F.col("event_type").isin("error", "signup"))
    at = F.col("ts").cast("timestamp")
    solved = F.col("event_id") % 3 != 0
    return events.select(
        F.col("event_id").alias("ticket_id"), F.col("user_id").alias("company_id"), F.when(F.col("event_type") == "error", "billing").otherwise("technical").alias("ticket_category"),
        at.alias("created_at"), F.when(solved, at + F.expr("make_interval(0, 0, 0, 0, cast(event_id % 72 as int), 0, 0)")).alias("resolved_at"),
        F.when(solved, (1 + F.col("event_id") % 5).cast("int")).alias("satisfaction_score"),
    )


def user_web_logins(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    return events.select(F.col("event_id").alias("login_id"), F.col("user_id").alias("company_id"), F.col("user_id"), F.col("ts").cast("timestamp").alias("login_timestamp"),
        F.concat_ws(".", F.lit("10"), (F.col("user_id") % 256).cast("string"), (F.col("event_id") % 256).cast("string"), F.lit("1")).alias("ip_address"), F.when(F.col("event_type") == "click", "Desktop ").otherwise("mobile").alias("device_type"))
