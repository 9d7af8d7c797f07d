"""Static dictionaries: named tables of JSON rows, kept as Parquet in a versioned store."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.sources.store import VersionedStore

ROW_SCHEMA = "name STRING, timestamp TIMESTAMP, owner STRING, comment STRING, json STRING"


class StaticTables:
    """Rows as JSON text in a versioned store: loads and deletes are commits, so one beside another is before or after it.

    A delete takes out what was committed before it, whatever the clocks of the writers say.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, VersionedStore(spark, root)

    def load(self, rows: DataFrame, name: str, owner: str, comment: str = "") -> None:
        """Store any table under a name, each row as JSON text."""
        kept = rows.select(
            F.lit(name).alias("name"),
            F.current_timestamp().alias("timestamp"),
            F.lit(owner).alias("owner"),
            F.lit(comment).alias("comment"),
            F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"),
        )
        self.store.append(name, kept, owner, comment)

    def load_csv(self, path: str, name: str, owner: str, comment: str = "", schema: str | T.StructType | None = None, multiline: bool = False) -> None:
        """Quotes inside cells are doubled. With a schema the files are read once, else once more for the types.
        Only with `multiline` may cells hold line breaks; a file is one task then."""
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read.option("inferSchema", "true")
        self.load(reader.csv(path, header=True, escape='"', multiLine=multiline), name, owner, comment)

    def delete(self, name: str) -> None:
        self.store.delete(name)

    def compact(self, name: str) -> None:
        """Write the rows of all loads of a name as one part of few files."""
        self.store.compact(name)

    def rows(self, name: str | None = None) -> DataFrame:
        """Live rows of all names, or of one."""
        folders = [p.folder for p in self.store.parts(name=name)]
        if not folders:
            return self.spark.createDataFrame([], ROW_SCHEMA)
        return self.spark.read.schema(ROW_SCHEMA).parquet(*folders)

    def read(self, name: str, limit: int | None = None, schema: str | T.StructType | None = None) -> DataFrame:
        """Rows of one name, parsed. Without a schema it is inferred in one aggregate."""
        chosen = self.rows(name)
        if limit is not None:
            chosen = chosen.limit(limit)
        if schema is None:
            shape = chosen.agg(F.schema_of_variant_agg(F.parse_json("json")).alias("s")).first()["s"]
            if shape is None or not shape.startswith("OBJECT"):
                raise ValueError(f"there are no rows named {name}")
            # JSON has one kind of fraction.
            schema = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", shape.replace("OBJECT<", "STRUCT<"))
        return chosen.select(F.from_json("json", schema).alias("r")).select("r.*")

    def catalogue(self) -> DataFrame:
        """First load time and line count per name, owner and comment, oldest first."""
        return (
            self.rows()
            .groupBy("name", "owner", "comment")
            .agg(F.min("timestamp").alias("timestamp"), F.count("timestamp").alias("lines"))
            .orderBy("timestamp")
        )
