"""Retrieval and serving operators over tables: nearest chunks, chunking, histories, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_by_cosine(vectors: DataFrame, query: list[float], k: int = 6) -> DataFrame:
    """The k rows (vec_id, distance) nearest to a query vector by cosine distance."""
    q = F.array(*(F.lit(float(x)) for x in query))
    x = F.col("embedding").cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e)
    dot, norm = total(F.zip_with(x, q, lambda a, b: a * b)), F.sqrt(total(F.transform(x, lambda a: a * a)))
    length = sum(v * v for v in query) ** 0.5
    return vectors.select("vec_id", (1 - dot / (norm * length)).alias("distance")).orderBy("distance", "vec_id").limit(k)


def chunk_markdown(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(chunk_id, key, name, index, chunk): sections by their header lines of two or four marks. A
    `##` section goes to the next `##`; if it holds `####` sections these are chunks of their own,
    and it keeps what stands before the first of them, unless that is the header alone. A `####`
    section goes to the next header. Text before the first header is in no chunk. Null text has
    none."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=##(?:##)? [^\n]*\S)")
    pieces = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.btrim(p, F.lit(" \n\t\r\f\x0b")))
    rows = docs.where(F.col(text).isNotNull()).select(key, pieces.alias("_pieces")).select(key, "_pieces", F.posexplode("_pieces").alias("_at", "chunk"))
    follows = F.get(F.col("_pieces"), F.col("_at") + 1)
    parent = ~F.col("chunk").startswith("####") & F.coalesce(follows.startswith("####"), F.lit(False))
    bare = ~F.col("chunk").contains("\n")
    rows = rows.where(~(parent & bare)).withColumn("name", F.btrim(F.regexp_extract("chunk", r"^#+ ([^\n]*)", 1)))
    rows = rows.withColumn("index", (F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1).cast("int"))
    return rows.select(F.concat_ws(":", F.lit("documents"), F.col(key).cast("string"), F.col("name"), F.col("index").cast("string")).alias("chunk_id"), key, "name", "index", "chunk")


def chat_history(turns: DataFrame, last: int = 6) -> DataFrame:
    """conv_id, n_turns, and history: the last `last` turns in order as (turn, role, text), ties by
    role and text. Ranked within a conversation before they are gathered, so a list has at most
    `last` entries."""
    along = Window.partitionBy("conv_id")
    order = along.orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    rows = turns.withColumns({"_rank": F.row_number().over(order), "n_turns": F.count("*").over(along)}).where(F.col("_rank") <= last)
    listed = rows.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct(-F.col("_rank").alias("_o"), "turn", "role", "text"))).alias("_h"))
    return listed.select("conv_id", "n_turns", F.transform("_h", lambda h: F.struct(h["turn"].alias("turn"), h["role"].alias("role"), h["text"].alias("text"))).alias("history"))


def resolve_identifiers(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """Requested identifiers (identifier) with the company whose name or VAT number equals it: the
    open version first, then the smallest id; not found: status 'not_found'."""
    by_name = companies.select(F.col("legal_name").alias("_id"), "company_id", "valid_to")
    by_vat = companies.select(F.col("vat_number").alias("_id"), "company_id", "valid_to")
    order = Window.partitionBy("identifier").orderBy(F.col("valid_to").desc_nulls_first(), "company_id")
    found = requests.join(by_name.unionByName(by_vat), F.col("identifier") == F.col("_id"), "left")
    found = found.withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    return found.select("identifier", "company_id", F.when(F.col("company_id").isNull(), "not_found").otherwise("found").alias("status"))
