"""Fixed schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _struct(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


# One JSON document per resource x metric x collection run. ``value`` and the
# timestamps stay text so that parsing rules are ours, not the JSON reader's.
RAW_DATAPOINT = _struct(("timestamp", _S), ("value", _S))

RAW_PAYLOAD = _struct(
    ("schema_version", _S),
    ("source", _S),
    ("namespace", _S),
    ("source_account_id", _S),
    ("region", _S),
    ("target_name", _S),
    ("resource_type", _S),
    ("resource_dimension", _S),
    ("resource_id", _S),
    ("engine", _S),
    ("cluster_identifier", _S),
    ("cluster_role", _S),
    ("metric_profile", _S),
    ("resource_profile", _S),
    ("metric_name", _S),
    ("statistic", _S),
    ("unit", _S),
    ("period_seconds", T.IntegerType()),
    ("start_time", _S),
    ("end_time", _S),
    ("collected_at", _S),
    ("datapoint_count", T.IntegerType()),
    ("datapoints", T.ArrayType(RAW_DATAPOINT)),
)

CURATED_ROW = _struct(
    ("target_name", _S),
    ("resource_id", _S, False),
    ("engine", _S),
    ("cluster_identifier", _S),
    ("cluster_role", _S),
    ("metric_profile", _S),
    ("resource_profile", _S),
    ("metric_name", _S, False),
    ("statistic", _S),
    ("unit", _S),
    ("metric_timestamp", T.TimestampNTZType(), False),
    ("value", T.DoubleType(), False),
    ("period_seconds", T.IntegerType()),
    ("collected_at", T.TimestampNTZType(), False),
    ("source_file", _S, False),
)

# Partition columns of the curated table, outermost first. They are strings
# (and one date) on purpose: account "012345678901" and hour "06" must not
# turn into numbers.
CURATED_PARTITIONS = _struct(
    ("account_id", _S), ("region", _S), ("date", T.DateType()), ("hour", _S)
)

PARTITION_COLUMNS = tuple(CURATED_PARTITIONS.fieldNames())

CURATED = T.StructType(CURATED_ROW.fields + CURATED_PARTITIONS.fields)

# Pages of the two "describe" listings, as dumped by the collector.
CLUSTER_PAGE = _struct(
    ("account_id", _S),
    ("region", _S),
    ("page_number", T.LongType()),
    (
        "DBClusters",
        T.ArrayType(
            _struct(
                ("DBClusterIdentifier", _S),
                ("Engine", _S),
                ("EngineVersion", _S),
                ("Status", _S),
                (
                    "DBClusterMembers",
                    T.ArrayType(
                        _struct(
                            ("DBInstanceIdentifier", _S),
                            ("IsClusterWriter", T.BooleanType()),
                            ("PromotionTier", T.IntegerType()),
                        )
                    ),
                ),
            )
        ),
    ),
)

INSTANCE_PAGE = _struct(
    ("account_id", _S),
    ("region", _S),
    ("page_number", T.LongType()),
    (
        "DBInstances",
        T.ArrayType(
            _struct(
                ("DBInstanceIdentifier", _S),
                ("DbiResourceId", _S),
                ("Engine", _S),
                ("EngineVersion", _S),
                ("DBInstanceClass", _S),
                ("AvailabilityZone", _S),
                ("DBInstanceStatus", _S),
                ("MultiAZ", T.BooleanType()),
                ("StorageType", _S),
                ("PerformanceInsightsEnabled", T.BooleanType()),
                ("DBClusterIdentifier", _S),
            )
        ),
    ),
)

# Flat inventory tables. Cluster members are rows, not an array, so a cluster
# of any size stays spread over tasks.
CLUSTERS = _struct(
    ("account_id", _S),
    ("region", _S),
    ("ordinal", T.LongType()),
    ("identifier", _S),
    ("engine", _S),
    ("engine_version", _S),
    ("status", _S),
)

CLUSTER_MEMBERS = _struct(
    ("account_id", _S),
    ("region", _S),
    ("cluster_ordinal", T.LongType()),
    ("cluster_identifier", _S),
    ("member_pos", T.LongType()),
    ("identifier", _S),
    ("role", _S),
    ("promotion_tier", T.IntegerType()),
)

INSTANCES = _struct(
    ("account_id", _S),
    ("region", _S),
    ("ordinal", T.LongType()),
    ("identifier", _S),
    ("dbi_resource_id", _S),
    ("engine", _S),
    ("engine_version", _S),
    ("instance_class", _S),
    ("availability_zone", _S),
    ("status", _S),
    ("multi_az", T.BooleanType()),
    ("storage_type", _S),
    ("performance_insights_enabled", T.BooleanType()),
    ("cluster_identifier", _S),
    ("cluster_role", _S),
)

TARGETS = _struct(
    ("name", _S),
    ("account_id", _S),
    ("role_name", _S),
    ("regions", T.ArrayType(_S)),
    ("enabled", T.BooleanType()),
)

# One page of a metric response, tagged with the request it answers.
METRIC_RESPONSE = _struct(
    ("request_id", _S),
    (
        "MetricDataResults",
        T.ArrayType(
            _struct(
                ("Id", _S),
                ("Timestamps", T.ArrayType(T.TimestampType())),
                ("Values", T.ArrayType(T.DoubleType())),
            )
        ),
    ),
    ("NextToken", _S),
)

SQL_LOAD = _struct(
    ("resource_id", _S),
    ("sample_ts", T.TimestampNTZType()),
    ("sql_id", _S),
    ("sql_text", _S),
    ("active_sessions", T.DoubleType()),
)

FINDINGS = _struct(
    ("overall", _S),
    (
        "queries",
        T.ArrayType(
            _struct(
                ("resource_id", _S),
                ("rank", _S),
                ("finding", _S),
                ("suggestion", _S),
                ("confidence", _S),
            )
        ),
    ),
)

REQUESTS = _struct(("request_id", _S), ("text", _S))
