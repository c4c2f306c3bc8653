"""Views of the given tables in the shapes the engine works on.

Every view is lazy and covers its whole source table; time bounds given by a
report are passed down so that they reach the Parquet scan.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..catalog import metric_catalogue
from ..functions.timestamps import iso_utc, utc_literal
from ..schemas import CLUSTER_MEMBERS, CLUSTERS, CURATED, FINDINGS, INSTANCES, RAW_PAYLOAD, SQL_LOAD, TARGETS

ACCOUNT = "000000000001"
REGION = "ap-northeast-2"
OTHER_REGION = "us-east-1"
SNAPSHOT_DAY = date(2024, 1, 20)
AS_OF = datetime(2024, 1, 20, 12, 0)
LOOKBACK_MINUTES = 1440
REPORT_MONTH = "1998-02"
STORAGE_AS_OF = date(1998, 6, 30)
MIB = 1048576


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(key: Column, *labels: str | None) -> Column:
    """A label by ``key`` modulo the number of labels."""
    chosen = F.lit(None).cast("string")
    for index, label in enumerate(labels):
        if label is not None:
            chosen = F.when(F.pmod(key, F.lit(len(labels))) == index, label).otherwise(chosen)
    return chosen


def event_metric() -> Column:
    """Each event type stands for one metric or a few, told apart by event id."""
    kind, number = F.col("event_type"), F.col("event_id")
    return (
        F.when(kind == "click", "CPUUtilization")
        .when(kind == "view", "DatabaseConnections")
        .when(kind == "purchase", _choose(number, "ReadIOPS", "ReadLatency"))
        .when(kind == "signup", _choose(number, "WriteIOPS", "WriteLatency"))
        .otherwise(
            _choose(number, "DiskQueueDepth", "AuroraReplicaLag", "FreeableMemory", "FreeStorageSpace")
        )
    )


EVENT_METRICS = (
    "CPUUtilization",
    "DatabaseConnections",
    "ReadIOPS",
    "ReadLatency",
    "WriteIOPS",
    "WriteLatency",
    "DiskQueueDepth",
    "AuroraReplicaLag",
    "FreeableMemory",
    "FreeStorageSpace",
)


def sent_late() -> Column:
    """Payloads of the second of two landings: the metrics that error events stand for."""
    return F.col("metric_name").isin(*EVENT_METRICS[6:])


def _midnight(day: date) -> Column:
    return utc_literal(datetime.combine(day, datetime.min.time()))


def _within(rows: DataFrame, column: str, start: date | None, end: date | None) -> DataFrame:
    """Rows whose timestamp lies in an inclusive range of days."""
    if start is not None:
        rows = rows.where(F.col(column) >= _midnight(start))
    if end is not None:
        rows = rows.where(F.col(column) < _midnight(end + timedelta(days=1)))
    return rows


def events(spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Events of an inclusive range of days (all days by default)."""
    return _within(table(spark, sf_dir, "events"), "ts", start, end)


def events_as_curated(
    spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Events as metric samples: one resource per user."""
    user = F.col("user_id")
    return events(spark, sf_dir, start, end).select(
        F.lit("sample").alias("target_name"),
        F.concat(F.lit("u"), user).alias("resource_id"),
        _choose(user, "aurora-mysql", "mysql", "postgres").alias("engine"),
        F.concat(F.lit("c"), F.pmod(user, F.lit(10))).alias("cluster_identifier"),
        _choose(user, "writer", "reader").alias("cluster_role"),
        F.lit("operational-v1").alias("metric_profile"),
        F.lit("sample").alias("resource_profile"),
        event_metric().alias("metric_name"),
        F.lit("Average").alias("statistic"),
        F.lit("Count").alias("unit"),
        F.col("ts").alias("metric_timestamp"),
        "value",
        F.lit(300).alias("period_seconds"),
        (F.col("ts") + F.expr("INTERVAL '5' MINUTE")).alias("collected_at"),
        F.lit("events").alias("source_file"),
        F.lit(ACCOUNT).alias("account_id"),
        F.lit(REGION).alias("region"),
        F.to_date("ts").alias("date"),
        F.date_format("ts", "HH").alias("hour"),
    ).select(*CURATED.fieldNames())


def repeated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample collected three times: at a varying delay, after 50 minutes, and
    once more at that same moment from a later file."""
    rows = events_as_curated(spark, sf_dir)
    delay = F.get_json_object(F.col("props"), "$.k").cast("int")
    base = events(spark, sf_dir).select(
        F.concat(F.lit("u"), "user_id").alias("resource_id"),
        event_metric().alias("metric_name"),
        F.col("ts").alias("metric_timestamp"),
        "value",
        delay.alias("delay"),
    )
    copies = F.array(
        F.struct(F.col("delay").alias("minutes"), F.lit(0.0).alias("plus"), F.lit("b/first.json").alias("file")),
        F.struct(F.lit(50).alias("minutes"), F.lit(1.0).alias("plus"), F.lit("a/second.json").alias("file")),
        F.struct(F.lit(50).alias("minutes"), F.lit(2.0).alias("plus"), F.lit("a-b/third.json").alias("file")),
    )
    known = {"resource_id", "metric_name", "metric_timestamp", "value", "collected_at", "source_file", "date", "hour"}
    blanks = [
        F.lit(ACCOUNT if f.name == "account_id" else REGION if f.name == "region" else None)
        .cast(f.dataType)
        .alias(f.name)
        for f in rows.schema.fields
        if f.name not in known
    ]
    return (
        base.select("*", F.explode(copies).alias("copy"))
        .select(
            "resource_id",
            "metric_name",
            "metric_timestamp",
            (F.col("value") + F.col("copy.plus")).alias("value"),
            F.timestamp_add("MINUTE", F.col("copy.minutes"), F.col("metric_timestamp")).alias("collected_at"),
            F.col("copy.file").alias("source_file"),
            F.to_date("metric_timestamp").alias("date"),
            F.date_format("metric_timestamp", "HH").alias("hour"),
            *blanks,
        )
        .select(*CURATED.fieldNames())
    )


def flawed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one-point payloads, many of them with a missing, blank or unreadable part."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    point = F.struct(
        day.alias("timestamp"),
        F.when((priority == "4-NOT SPECIFIED") & (status == "O"), "n/a")
        .when((priority == "4-NOT SPECIFIED") & (status == "F"), F.lit(None))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("value"),
    )
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.when(status == "P", "  ").when(status == "O", ACCOUNT).otherwise(none).alias("source_account_id"),
        F.lit(REGION).alias("region"),
        none.alias("target_name"),
        F.when(priority == "2-HIGH", "")
        .otherwise(F.concat(F.lit("c"), "o_custkey"))
        .alias("resource_id"),
        none.alias("engine"),
        none.alias("cluster_identifier"),
        none.alias("cluster_role"),
        none.alias("metric_profile"),
        none.alias("resource_profile"),
        F.when((priority == "3-MEDIUM") & (status == "O"), none).otherwise("CPUUtilization").alias("metric_name"),
        none.alias("statistic"),
        none.alias("unit"),
        F.lit(None).cast("int").alias("period_seconds"),
        F.when((priority == "5-LOW") & (status == "F"), "yesterday").otherwise(day).alias("collected_at"),
        F.array(point).alias("datapoints"),
        F.concat(F.lit("o"), "o_orderkey").alias("source_file"),
        F.when(priority == "1-URGENT", none).otherwise(ACCOUNT).alias("path_account_id"),
        none.alias("path_region"),
    )


def flawed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flawed payloads as documents to land; the day they were collected is their order's."""
    rows = flawed_payloads(spark, sf_dir)
    given = {name: F.col(name) for name in rows.columns} | {"end_time": F.lit("1999-01-01T00:00:00Z")}
    return rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_PAYLOAD.fields])


def loose_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON texts with all that can stand for ``datapoints``, some cut off in the middle."""
    priority = F.col("o_orderpriority")
    held = (
        F.when(priority == "1-URGENT", "null")
        .when(priority == "2-HIGH", '{"timestamp": "x"}')
        .when(priority == "3-MEDIUM", '"none"')
        .otherwise(F.concat(F.lit('[{"timestamp": "2024-01-20T00:00:00Z", "value": '), F.col("o_totalprice"), F.lit("}]")))
    )
    listed = F.when(priority == "4-NOT SPECIFIED", "").otherwise(F.concat(F.lit(', "datapoints": '), held))
    known = F.concat(
        F.lit('{"resource_id": "c'), F.col("o_custkey"), F.lit('", "metric_name": "CPUUtilization", "region": "'), F.lit(REGION),
        F.lit('", "collected_at": "2024-01-20T01:00:00Z"'), listed, F.lit("}"),
    )
    cut = F.when(F.col("o_orderstatus") == "P", F.substring(known, 1, 40)).otherwise(known)
    return table(spark, sf_dir, "orders").select(cut.alias("value"))


def finding_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as answers: ranks as numbers with a fraction, as text, and as text with one."""
    role, turn = F.col("role"), F.col("turn")
    rank = (
        F.when(role == "user", F.concat(turn + 1, F.lit(".7")))
        .when(role == "system", '"3.7"')
        .otherwise(F.concat(F.lit('" '), turn + 1, F.lit('"')))
    )
    entry = F.concat(
        F.lit('{"queries": [7, {"resource_id": '), F.col("conv_id"), F.lit(', "rank": '), rank, F.lit(', "finding": "'), role, F.lit('"}]}')
    )
    return table(spark, sf_dir, "conversations").select(F.parse_json(entry).alias("document"))


def response_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric responses: five-minute averages, one request per user and day.

    A day is answered in two pages (before and after noon), and each timestamp
    list is one longer than its value list. A list holds at most 144 periods.
    """
    period = events(spark, sf_dir).select(
        "user_id",
        event_metric().alias("query_id"),
        F.expr("ts - make_dt_interval(0, 0, minute(ts) % 5, extract(SECOND FROM ts))").alias("period_start"),
        "value",
    )
    averaged = period.groupBy("user_id", "query_id", "period_start").agg(F.avg("value").alias("value"))
    half = F.hour("period_start") >= 12
    lists = averaged.groupBy(
        "user_id", F.to_date("period_start").alias("day"), half.alias("afternoon"), "query_id"
    ).agg(F.array_sort(F.collect_list(F.struct("period_start", "value"))).alias("points"))
    result = F.struct(
        F.col("query_id").alias("Id"),
        F.concat("points.period_start", F.array(F.col("day").cast("timestamp_ntz"))).alias("Timestamps"),
        F.col("points.value").alias("Values"),
    )
    return lists.select(
        F.concat_ws("/", F.concat(F.lit("u"), "user_id"), F.col("day").cast("string")).alias("request_id"),
        F.array(result).alias("MetricDataResults"),
        F.when(~F.col("afternoon"), "more").alias("NextToken"),
    )


def response_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per user, day with any event, and metric an event can stand for."""
    days = events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day")).distinct()
    asked = F.array(*[F.lit(m) for m in EVENT_METRICS])
    end = F.date_add("day", 1).cast("timestamp_ntz")
    none = F.lit(None).cast("string")
    rows = days.select("*", F.explode(asked).alias("metric_name")).join(
        F.broadcast(metric_catalogue(spark)), "metric_name"
    )
    return rows.select(
        F.concat_ws("/", F.concat(F.lit("u"), "user_id"), F.col("day").cast("string")).alias("request_id"),
        F.col("metric_name").alias("query_id"),
        F.lit(ACCOUNT).alias("source_account_id"),
        F.lit(REGION).alias("region"),
        F.lit("sample").alias("target_name"),
        F.lit("DBInstanceIdentifier").alias("resource_dimension"),
        F.concat(F.lit("u"), "user_id").alias("resource_id"),
        _choose(F.col("user_id"), "aurora-mysql", "mysql", "postgres").alias("engine"),
        none.alias("cluster_identifier"),
        _choose(F.col("user_id"), "writer", "reader").alias("cluster_role"),
        F.lit("operational-v1").alias("metric_profile"),
        F.lit("sample").alias("resource_profile"),
        "metric_name",
        "statistic",
        "unit",
        F.lit(300).alias("period_seconds"),
        iso_utc(F.col("day").cast("timestamp_ntz")).alias("start_time"),
        iso_utc(end).alias("end_time"),
        iso_utc(end).alias("collected_at"),
    )


def storage_as_curated(
    spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Line items as a storage series per supplier.

    Each shipped quantity uses up space: even suppliers show what is left of
    20,000 MiB, odd ones what is used. Quantities are summed per supplier and
    day before the running sum, so a supplier of any size is a short series.
    """
    shipped = _within(table(spark, sf_dir, "lineitem"), "l_shipdate", None, end)
    daily = (
        shipped.groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    used = F.expr("sum(quantity) OVER (PARTITION BY l_suppkey ORDER BY date)")
    series = daily.withColumn("used", used)
    if start is not None:
        series = series.where(F.col("date") >= start)
    odd = F.pmod("l_suppkey", F.lit(2)) == 1
    return series.select(
        F.lit(ACCOUNT).alias("account_id"),
        F.lit(REGION).alias("region"),
        "date",
        F.concat(F.lit("s"), "l_suppkey").alias("resource_id"),
        F.when(odd, "VolumeBytesUsed").otherwise("FreeStorageSpace").alias("metric_name"),
        (F.when(odd, F.col("used")).otherwise(20000 - F.col("used")) * MIB).alias("value"),
    )


def orders_as_curated(
    spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Orders as metric samples: one resource per customer nation and segment."""
    orders = _within(table(spark, sf_dir, "orders"), "o_orderdate", start, end)
    customer = table(spark, sf_dir, "customer")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.lit(ACCOUNT).alias("account_id"),
        F.lit(REGION).alias("region"),
        F.to_date("o_orderdate").alias("date"),
        F.concat(F.lit("n"), "c_nationkey", F.lit("-"), F.lower("c_mktsegment")).alias("resource_id"),
        F.when(status == "P", "postgres").otherwise("mysql").alias("engine"),
        F.when(status == "O", "writer").otherwise("reader").alias("cluster_role"),
        F.when(priority == "1-URGENT", "CPUUtilization")
        .when(priority == "2-HIGH", "DatabaseConnections")
        .when(priority == "3-MEDIUM", "ReadIOPS")
        .when(priority == "4-NOT SPECIFIED", "FreeStorageSpace")
        .otherwise("VolumeBytesUsed")
        .alias("metric_name"),
        F.col("o_totalprice").alias("value"),
    )


def sql_load(
    spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Events as load samples: user = instance, ``props.k`` = statement."""
    statement = F.get_json_object("props", "$.k")
    return events(spark, sf_dir, start, end).select(
        F.concat(F.lit("u"), "user_id").alias("resource_id"),
        F.col("ts").alias("sample_ts"),
        F.concat(F.lit("q"), statement).alias("sql_id"),
        F.concat(F.lit("select * from t"), statement, F.lit(" where id = ?")).alias("sql_text"),
        F.col("value").alias("active_sessions"),
    ).select(*SQL_LOAD.fieldNames())


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as findings: conversation = resource, turn = rank."""
    role = F.col("role")
    entry = F.struct(
        F.concat(F.lit(" u"), "conv_id").alias("resource_id"),
        F.when(role == "system", "first").otherwise((F.col("turn") + 1).cast("string")).alias("rank"),
        F.col("text").alias("finding"),
        role.alias("suggestion"),
        F.when(role == "user", "high").alias("confidence"),
    )
    return table(spark, sf_dir, "conversations").select(
        role.alias("overall"), F.array(entry).alias("queries")
    ).select(*FINDINGS.fieldNames())


def _nation_region() -> tuple[Column, Column]:
    account = F.concat(F.lit("00000000000"), F.col("n_regionkey") + 1)
    region = F.when(F.pmod("n_nationkey", F.lit(2)) == 1, OTHER_REGION).otherwise(REGION)
    return account.alias("account_id"), region.alias("region")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as clusters, accounts by world region."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        *_nation_region(),
        key.cast("long").alias("ordinal"),
        F.col("n_name").alias("identifier"),
        _choose(key, "aurora-mysql", "aurora-postgresql", "mysql").alias("engine"),
        F.lit("1").alias("engine_version"),
        _choose(key, "available", "available", "available", "creating").alias("status"),
    ).select(*CLUSTERS.fieldNames())


def cluster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and their suppliers as describe pages: five clusters a page."""
    member = F.struct(
        F.col("s_name").alias("DBInstanceIdentifier"),
        F.when(F.pmod("s_suppkey", F.lit(4)) == 0, True)
        .when(F.pmod("s_suppkey", F.lit(4)) == 1, F.lit(None).cast("boolean"))
        .otherwise(False)
        .alias("IsClusterWriter"),
        F.pmod("s_suppkey", F.lit(16)).cast("int").alias("PromotionTier"),
    )
    members = _suppliers(spark, sf_dir).groupBy("n_nationkey").agg(F.collect_list(member).alias("members"))
    cluster = F.struct(
        F.col("identifier").alias("DBClusterIdentifier"),
        F.col("engine").alias("Engine"),
        F.col("engine_version").alias("EngineVersion"),
        F.col("status").alias("Status"),
        F.col("members").alias("DBClusterMembers"),
    )
    described = clusters(spark, sf_dir).join(members, F.col("ordinal") == F.col("n_nationkey"), "left")
    return described.groupBy("account_id", "region", F.floor(F.col("ordinal") / 5).alias("page_number")).agg(
        F.collect_list(cluster).alias("DBClusters")
    )


def instance_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as describe pages of a hundred instances; switches that are off are left out."""
    entry = F.struct(
        F.col("identifier").alias("DBInstanceIdentifier"),
        F.col("dbi_resource_id").alias("DbiResourceId"),
        F.col("engine").alias("Engine"),
        F.col("engine_version").alias("EngineVersion"),
        F.col("instance_class").alias("DBInstanceClass"),
        F.col("availability_zone").alias("AvailabilityZone"),
        F.col("status").alias("DBInstanceStatus"),
        F.when(F.col("multi_az"), True).alias("MultiAZ"),
        F.col("storage_type").alias("StorageType"),
        F.when(F.col("performance_insights_enabled"), True).alias("PerformanceInsightsEnabled"),
        F.col("cluster_identifier").alias("DBClusterIdentifier"),
    )
    page = F.floor(F.col("ordinal") / 100).alias("page_number")
    return instances(spark, sf_dir).groupBy("account_id", "region", page).agg(F.collect_list(entry).alias("DBInstances"))


def planned_payloads(plan: DataFrame) -> DataFrame:
    """A payload without datapoints for every planned request."""
    texts = ("target_name", "region", "resource_dimension", "resource_id", "engine", "cluster_identifier", "cluster_role")
    texts += ("metric_profile", "resource_profile", "metric_name", "statistic", "unit")
    end = F.lit("2024-01-20T12:00:00Z")
    given = {name: F.col(name) for name in texts} | {"source_account_id": F.col("account_id"), "end_time": end, "collected_at": end}
    empty = {"datapoint_count": F.lit(0), "datapoints": F.array()}
    return plan.select(
        *[(given | empty).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_PAYLOAD.fields]
    )


def parameter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they come in as report parameters, from orders and parts."""
    key, when = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(F.pmod(key, F.lit(7)) == 0, F.lpad(key.cast("string"), 12, "0"))
        .when(F.pmod(key, F.lit(7)) == 1, F.date_format(when, "yyyy-MM"))
        .when(F.pmod(key, F.lit(7)) == 2, F.date_format(when, "yyyy-MM-dd"))
        .when(F.pmod(key, F.lit(7)) == 3, F.concat(F.lit("db-"), F.upper("o_orderstatus"), key))
        .when(F.pmod(key, F.lit(7)) == 4, F.lit(REGION))
        .when(F.pmod(key, F.lit(7)) == 5, F.concat(F.col("o_orderpriority"), F.lit("\n")))
        .otherwise(F.concat(F.date_format(when, "yyyy-"), F.pmod(key, F.lit(20))))
    )
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), key).alias("id"), text.alias("value"))
    minutes = F.pmod(F.col("p_partkey") * 37, F.lit(1600)) - 20
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), minutes.cast("string").alias("value"))
    return orders.unionByName(parts)


def event_dimension() -> Column:
    """The dimension an event asks for, one in three of them unknown."""
    return _choose(F.col("event_id"), "DBInstanceIdentifier", "DBClusterIdentifier", "DBName")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as members of their nation's cluster."""
    key = F.col("s_suppkey")
    return _suppliers(spark, sf_dir).select(
        *_nation_region(),
        F.col("n_nationkey").cast("long").alias("cluster_ordinal"),
        F.col("n_name").alias("cluster_identifier"),
        key.alias("member_pos"),
        F.col("s_name").alias("identifier"),
        _choose(key, "writer", "reader", "reader", "reader").alias("role"),
        F.pmod(key, F.lit(16)).cast("int").alias("promotion_tier"),
    ).select(*CLUSTER_MEMBERS.fieldNames())


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as instances. Some name no cluster themselves; none names a role."""
    key = F.col("s_suppkey")
    return _suppliers(spark, sf_dir).select(
        *_nation_region(),
        key.alias("ordinal"),
        F.col("s_name").alias("identifier"),
        F.when(F.col("s_acctbal") <= 9000, F.concat(F.lit("db-S"), key)).alias("dbi_resource_id"),
        _choose(
            key,
            "aurora-mysql",
            "mysql",
            "postgres",
            "oracle-ee",
            "sqlserver-ex",
            "sqlserver-se",
            "mariadb",
            None,
        ).alias("engine"),
        F.lit("1").alias("engine_version"),
        _choose(key, "db.serverless", "db.t3.medium", "db.r6g.large", "db.t4g.small", "db.t2.micro").alias(
            "instance_class"
        ),
        _choose(key, "a", "b", "c").alias("availability_zone"),
        F.when(F.col("s_acctbal") < 0, "stopped").otherwise("available").alias("status"),
        (F.pmod(key, F.lit(2)) == 0).alias("multi_az"),
        _choose(key, "gp2", "gp3", "io1").alias("storage_type"),
        (F.pmod(key, F.lit(4)) != 3).alias("performance_insights_enabled"),
        F.when(F.pmod(key, F.lit(3)) != 0, F.col("n_name")).alias("cluster_identifier"),
        F.lit(None).cast("string").alias("cluster_role"),
    ).select(*INSTANCES.fieldNames())


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World regions as configured targets, looked at in either region first; the last one is switched off."""
    key = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(
        F.replace("r_name", F.lit(" "), F.lit("-")).alias("name"),
        F.concat(F.lit("00000000000"), key + 1).alias("account_id"),
        F.lit("observer").alias("role_name"),
        F.when(F.pmod(key, F.lit(2)) == 1, F.array(F.lit(OTHER_REGION), F.lit(REGION)))
        .otherwise(F.array(F.lit(REGION), F.lit(OTHER_REGION)))
        .alias("regions"),
        (key < 4).alias("enabled"),
    ).select(*TARGETS.fieldNames())


def instance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids asked for by customers: some name a supplier, most name nothing."""
    return table(spark, sf_dir, "customer").select(
        F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("resource_id")
    )


def loose_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as people type them: parts, other case, blanks, exact ids, and misses."""
    customer = table(spark, sf_dir, "customer").select(F.substring("c_name", 9, 20).alias("name"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("  "), F.upper("s_name"), F.lit(" ")).alias("name")
    )
    nation = table(spark, sf_dir, "nation")
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return (
        customer.unionByName(supplier)
        .unionByName(nation.select(F.lower("n_name").alias("name")))
        .unionByName(nation.select(F.substring("n_name", 2, 7).alias("name")))
        .unionByName(part)
    )


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and conversation turns as request lines, well formed and not."""
    priority, status, day = F.col("o_orderpriority"), F.col("o_orderstatus"), F.dayofmonth("o_orderdate")
    command = (
        F.when(priority == "1-URGENT", "health")
        .when(priority == "2-HIGH", "storage")
        .when(priority == "3-MEDIUM", "topsql")
        .when(priority == "4-NOT SPECIFIED", "report")
        .otherwise("status")
    )
    target = (
        F.when(status == "O", F.concat(F.lit("#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
        .when(status == "F", F.concat(F.lit("nation_"), F.pmod("o_custkey", F.lit(25))))
        .otherwise(_choose(F.col("o_custkey"), "AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE-EAST", "nation"))
    )
    argument = (
        F.when(day <= 5, "")
        .when(day <= 10, "30m")
        .when(day <= 15, " 2h")
        .when(day <= 20, "30d")
        .when(day <= 25, F.date_format("o_orderdate", "yyyy-MM"))
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" extra")))
    )
    lines = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("request_id"),
        F.concat(F.lit(" "), command, F.lit("  "), target, F.lit(" "), argument).alias("text"),
    )
    chatter = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("request_id"), "text"
    )
    return lines.unionByName(chatter)
