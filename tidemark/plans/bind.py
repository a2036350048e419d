"""Driver tables as the library's tables, and the same views in SQL for the checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF = "2001-07-25 10:00:00"
EVENTS_AS_OF = "2024-01-28 10:00:00"
STATUSES = ("new", "needs_review", "watch", "interesting", "not_relevant", "submitted", "won", "lost", "closed")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, what: str) -> str:
    """A new folder in the one that all executors share, spark.checkpoint.dir; local masters may
    do without and get a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='tidemark-')}/tidemark-{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in such a folder, for what is read several times."""
    at = folder(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key, tier = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    return o.select(
        key.alias("id"), F.col("o_orderstatus").alias("source_id"), key.cast("string").alias("external_id"), F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("http://h/n/"), key).alias("url"), F.col("o_orderdate").cast("timestamp").alias("deadline"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("deadline_at"),
        (F.col("o_orderdate").cast("timestamp") - F.expr("interval 14 days")).alias("first_seen"), F.col("o_custkey").cast("string").alias("buyer"), F.floor("o_totalprice").cast("string").alias("budget"),
        F.when(key % 5 == 0, "grant_application").otherwise("g2b_service").alias("category"), (key % 7).cast("int").alias("score"),
        F.element_at(F.array(*map(F.lit, STATUSES)), (key % 9).cast("int") + 1).alias("review_status"),
        F.when(tier.isin("1", "2", "3"), F.concat(F.lit("tier_"), tier)).otherwise("unclassified").alias("tier"),
        F.when(key % 11 == 0, "manual").otherwise("automatic").alias("tier_source"), F.array("o_orderpriority", "o_orderstatus").alias("keywords"),
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    line = read(spark, sf_dir, "lineitem").withColumn("id", F.row_number().over(order))
    return line.select(
        F.col("l_orderkey").alias("notice_id"), F.col("id").cast("long").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.concat(F.lit("http://h/"), "l_partkey", F.lit("?fileSeq="), "l_linenumber").alias("url"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.col("l_shipdate").cast("timestamp").alias("stamp"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("extracted", "processed_no_evidence", "missing_document_url", "download_failed"))), (F.col("supp") % 4).cast("int") + 1)
    return attachments(spark, sf_dir).filter("id <= 2").select("notice_id", "id", F.col("url").alias("document_url"), F.col("label").alias("document_label"), status.alias("status"), F.when(F.col("quantity") < 10, "").otherwise(F.concat(F.lit("task "), F.col("part"))).alias("summary"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).filter(F.col("id") % 7 == 0).select(F.col("id").alias("notice_id"), F.when(F.col("id") % 2 == 0, "high").otherwise("low").alias("fit"), F.lit("pending").alias("decision"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = read(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("most"))
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "signup")).crossJoin(F.broadcast(most))  # one row
    return e.select(F.lit("immediate").alias("type"), F.pmod("event_id", "most").cast("string").alias("key"), F.col("user_id").cast("string").alias("recipient"), F.when(F.col("value") > 20, "sent").otherwise("failed").alias("status"), F.col("ts").cast("timestamp").alias("sent_at")) \
        .groupBy("type", "key", "recipient").agg(F.max("status").alias("status"), F.max("sent_at").alias("sent_at"))


_LIST = ", ".join(f"'{s}'" for s in STATUSES)
SQL = {
    "notices": f"""notices as (select o_orderkey as id, o_orderstatus as source_id, cast(o_orderkey as varchar) as external_id, o_orderpriority as title, 'http://h/n/' || o_orderkey as url,
      cast(o_orderdate as timestamp) as deadline, strftime(o_orderdate, '%Y-%m-%d %H:%M') as deadline_at, cast(o_orderdate as timestamp) - interval 14 day as first_seen, cast(o_custkey as varchar) as buyer,
      cast(cast(floor(o_totalprice) as bigint) as varchar) as budget, case when o_orderkey % 5 = 0 then 'grant_application' else 'g2b_service' end as category, cast(o_orderkey % 7 as int) as score,
      ([{_LIST}])[o_orderkey % 9 + 1] as review_status, case when o_orderpriority[1] in ('1', '2', '3') then 'tier_' || o_orderpriority[1] else 'unclassified' end as tier,
      case when o_orderkey % 11 = 0 then 'manual' else 'automatic' end as tier_source, [o_orderpriority, o_orderstatus] as keywords from orders)""",
    "attachments": """attachments as (select l_orderkey as notice_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as id,
      l_returnflag || l_linestatus as label, 'http://h/' || l_partkey || '?fileSeq=' || l_linenumber as url, l_suppkey as supp, l_quantity as quantity, l_extendedprice as price,
      cast(l_shipdate as timestamp) as stamp, l_linenumber as line, l_partkey as part from lineitem)""",
    "insights": """insights as (select notice_id, id, url as document_url, label as document_label, (['extracted', 'processed_no_evidence', 'missing_document_url', 'download_failed'])[supp % 4 + 1] as status,
      case when quantity < 10 then '' else 'task ' || part end as summary from attachments where id <= 2)""",
    "reviews": "reviews as (select id as notice_id, case when id % 2 = 0 then 'high' else 'low' end as fit, 'pending' as decision from notices where id % 7 = 0)",
    "deliveries": """deliveries as (select 'immediate' as type, cast(event_id % (select max(o_orderkey) from orders) as varchar) as key, cast(user_id as varchar) as recipient, max(case when value > 20 then 'sent' else 'failed' end) as status,
      max(ts) as sent_at from events where event_type in ('purchase', 'signup') group by 1, 2, 3)""",
}


def sql(*views: str) -> str:
    """The common table expressions, to put before a query."""
    return "with " + ",\n".join(SQL[v] for v in views) + "\n"
