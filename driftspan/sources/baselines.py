"""Named, versioned baselines as folders on any file system that Spark reads, with a metadata file and a checksum.

The checksum covers rows, not bytes: the sum of row hashes and their count, so it is one distributed aggregation
and does not depend on how files are cut.
"""

import json
import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspan.errors import ValidationError, require

_NAME = re.compile(r"[A-Za-z0-9._-]+")
LIST_SCHEMA = "name string, version string, format string, row_count long, created_utc string, owner string, training_job_id string, checksum string, path string, schema string"


def checksum(df: DataFrame) -> str:
    """Of rows in any order; equal rows count each."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}:{row['s'] or 0}"


class BaselineStore:
    """save, load, list, metadata and delete under one root: a local folder, hdfs:// or an object store such as s3a://."""

    def __init__(self, spark: SparkSession, root: str = "baselines", default_format: str = "parquet"):
        require(default_format in ("parquet", "csv"), "format must be parquet or csv")
        self.spark, self.root, self.default_format = spark, root.rstrip("/"), default_format

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def _folder(self, name: str, version: str) -> str:
        for part in (name, version):
            require(bool(_NAME.fullmatch(part or "")), f"names are made of letters, digits, '.', '_' and '-': {part!r}")
        return f"{self.root}/{name}_v{version}"

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def save(self, df: DataFrame, name: str, version: str, owner: str | None = None, training_job_id: str | None = None, fmt: str | None = None) -> dict:
        """Writes the data, then the metadata: a baseline without metadata is not there. Replaces one of the same version."""
        folder, fmt = self._folder(name, version), fmt or self.default_format
        require(fmt in ("parquet", "csv"), "format must be parquet or csv")
        df.write.mode("overwrite").option("header", "true").format(fmt).save(f"{folder}/data")
        kept = self._read(f"{folder}/data", fmt, df.schema)
        meta = {"name": name, "version": version, "format": fmt, "row_count": kept.count(), "created_utc": datetime.now(UTC).isoformat(), "owner": owner, "training_job_id": training_job_id, "checksum": checksum(kept), "path": f"{folder}/data", "schema": df.schema.json()}
        self.spark.createDataFrame([tuple(meta.values())], LIST_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{folder}/meta")
        return meta

    def _read(self, path: str, fmt: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).option("header", "true").format(fmt).load(path)

    def metadata(self, name: str, version: str) -> dict:
        folder = self._folder(name, version)
        if not self._exists(f"{folder}/meta"):
            raise FileNotFoundError(f"no baseline {name}@{version}")
        return self.spark.read.schema(LIST_SCHEMA).json(f"{folder}/meta").first().asDict()

    def load(self, name: str, version: str, verify_integrity: bool = True) -> DataFrame:
        """The rows; a checksum that differs raises."""
        meta = self.metadata(name, version)
        df = self._read(meta["path"], meta["format"], T.StructType.fromJson(json.loads(meta["schema"])))
        if verify_integrity and checksum(df) != meta["checksum"]:
            raise ValidationError(f"baseline {name}@{version} differs from what was saved")
        return df

    def list(self, name: str | None = None) -> DataFrame:
        """Metadata rows of all baselines, or of one name, sorted by name and version."""
        fs, root = self._fs(self.root)
        found = [str(s.getPath()) for s in (fs.listStatus(root) if fs.exists(root) else [])]
        metas = [f"{p}/meta" for p in found if self._exists(f"{p}/meta")]
        rows = self.spark.read.schema(LIST_SCHEMA).json(metas) if metas else self.spark.createDataFrame([], LIST_SCHEMA)
        return (rows.where(F.col("name") == name) if name else rows).orderBy("name", "version")

    def delete(self, name: str, version: str) -> None:
        self.metadata(name, version)
        fs, p = self._fs(self._folder(name, version))
        fs.delete(p, True)
