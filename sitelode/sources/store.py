"""A store of versioned tables in plain parquet: read the greatest complete version, write the next."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitelode.operators.dedupe import latest, replace_by_key, upsert


@dataclass
class Store:
    """Tables under ``root``, each a folder of numbered versions.

    A writer never touches what readers read: it writes a new version folder,
    which counts once its job has put the mark of success into it, the last thing
    that a job does.  So there is no moment without a current version, and a lost
    job leaves the old one.  One writer at a time is expected; of two versions of
    one number the greater by name counts.
    """

    spark: SparkSession
    root: str

    def _fs(self, path: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self, table: str) -> str | None:
        """The name of the current version, None where the table is absent."""
        at, fs = self._fs(f"{self.root}/{table}")
        if not fs.exists(at):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        for name in sorted((n for n in names if n.startswith("v-")), reverse=True):
            done, fs = self._fs(f"{self.root}/{table}/{name}/_SUCCESS")
            if fs.exists(done):
                return name
        return None

    def vacuum(self, table: str, keep: int = 2) -> None:
        """Remove all but the last ``keep`` complete versions; none of the others may be in use."""
        now = self.version(table)
        if now is None:
            return
        at, fs = self._fs(f"{self.root}/{table}")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("v-"))
        for name in [n for n in names if n <= now][: -max(keep, 1)]:
            fs.delete(self._fs(f"{self.root}/{table}/{name}")[0], True)

    def read(self, table: str, schema: StructType | None = None) -> DataFrame | None:
        """The table, None (with ``schema``: empty) where it is absent."""
        version = self.version(table)
        if version is None:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{table}/{version}")

    def write(self, table: str, rows: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``rows`` as the next version and make it the current one."""
        now = self.version(table)
        version = f"v-{int(now.split('-')[1]) + 1 if now else 1:012d}-{uuid.uuid4().hex}"
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{table}/{version}")
        return self.spark.read.parquet(f"{self.root}/{table}/{version}")

    def save_pages(self, incoming: DataFrame) -> DataFrame:
        """Raw pages by url: the incoming row replaces the old one whole."""
        now = self.read("pages", incoming.schema)
        return self.write("pages", upsert(now, incoming, ["url"], ["scraped_at", "id"]))

    def save_cleaned(self, incoming: DataFrame) -> DataFrame:
        """Cleaned pages by (url, page_type): updated, with the id and creation time of the old row."""
        now = self.read("cleaned_pages", incoming.schema)
        merged = upsert(now, incoming, ["url", "page_type"], ["updated_at", "id"], ["id", "created_at"])
        return self.write("cleaned_pages", merged)

    def save_chunks(self, incoming: DataFrame, replace_existing: bool = False) -> DataFrame:
        """Chunks appended, or put in the place of their pages' old ones."""
        now = self.read("chunks", incoming.schema)
        rows = replace_by_key(now, incoming, "page_id") if replace_existing else now.unionByName(incoming)
        return self.write("chunks", rows)

    def page(self, url: str) -> DataFrame:
        """The raw page of a url: no row or one."""
        return self.read("pages").filter(F.col("url") == url).limit(1)

    def chunks_of(self, page_id: int) -> DataFrame:
        """The chunks of a page in order, each with its vector as an array in ``vector`` (null where there is none)."""
        rows = self.read("chunks").filter(F.col("page_id") == page_id)
        return rows.withColumn("vector", F.from_json("embedding", "array<double>")).orderBy("chunk_index")

    def cleaned_page(self, url: str, page_type: str | None = None) -> DataFrame:
        """The page of (url, page_type); without a type the one updated last."""
        rows = self.read("cleaned_pages").filter(F.col("url") == url)
        if page_type:
            return rows.filter(F.col("page_type") == page_type)
        return latest(rows, ["url"], ["updated_at", "id"])

    def export(self, table: str, path: str, kind: str = "json") -> None:
        """The current version as JSON lines or CSV."""
        if not re.fullmatch("json|csv", kind):
            raise ValueError("kind is json or csv")
        rows = self.read(table)
        (rows.write.option("header", "true").csv if kind == "csv" else rows.write.json)(path)


def decode_images(images: str | None) -> list:
    """A JSON array of images; null, broken JSON and other JSON give an empty list."""
    try:
        out = json.loads(images or "[]")
    except ValueError:
        return []
    return out if isinstance(out, list) else []


def images_array(images):  # noqa: ANN001, ANN201
    """The same as a Column: ``array<string>``, empty where the JSON is null, broken or no array."""
    return F.coalesce(F.from_json(images, "array<string>"), F.array().cast("array<string>"))
