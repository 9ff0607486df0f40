"""File and message sources."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspan.errors import DataLoadingError


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """csv (with a header), json, orc or parquet by the path's ending; parquet by default. Unreadable input raises DataLoadingError."""
    kind = next((k for k in ("csv", "json", "orc") if path.rstrip("/").endswith(f".{k}")), "parquet")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        reader = reader.option("header", "true").option("inferSchema", str(schema is None).lower())
    try:
        return reader.format(kind).load(path)
    except AnalysisException as e:
        raise DataLoadingError(f"cannot read {path}: {e}") from e


def json_messages(messages: DataFrame, schema: T.StructType | str, value: str = "value") -> DataFrame:
    """Rows of message bodies, each an object or an array of objects in JSON, with column _bad: bodies that are none are kept with nulls."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    body = F.col(value).cast("string")
    one, many = F.from_json(body, kind, {"mode": "PERMISSIVE"}), F.from_json(body, T.ArrayType(kind), {"mode": "PERMISSIVE"})
    rows = F.when(F.ltrim(body).startswith("["), many).otherwise(F.when(F.ltrim(body).startswith("{") & F.try_parse_json(body).isNotNull(), F.array(one)))
    exploded = messages.select(F.explode_outer(rows).alias("__row"))
    return exploded.select("__row.*", F.col("__row").isNull().alias("_bad"))


def kafka(spark: SparkSession, topic: str, servers: str = "localhost:9092", **options: str) -> DataFrame:
    """A stream of messages of a topic; needs Spark's Kafka connector on the class path."""
    try:
        return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    except AnalysisException as e:
        raise DataLoadingError("Spark's Kafka connector is not on the class path") from e
