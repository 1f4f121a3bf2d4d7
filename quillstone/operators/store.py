"""The versioned store: row plans, upserts and deletions by copy-on-write over hashed buckets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text as tx
from quillstone.session import checkpointed


class ConcurrentModificationError(RuntimeError):
    """The table moved on twice while a change was made."""


def plan_rows(new: DataFrame) -> DataFrame:
    """Rows to store for (wing, room, title, text): the logical drawer, and its chunks if it is long.

    A long drawer embeds its title, a short one its text, a chunk its slice. The id is a hash of
    wing, room and text, so equal content gives equal rows.
    """
    based = new.withColumn("id", tx.drawer_id("wing", "room", "text"))
    long_ = F.length("text") > tx.CHUNK
    parent = based.select(
        "id", "wing", "room", "title", "text", F.when(long_, F.col("title")).otherwise(F.col("text")).alias("embed_source"),
        F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("parent_drawer_id"), long_.alias("is_parent"),
    )
    child = based.select("id", "wing", "room", "title", F.explode(tx.chunks("text")).alias("c")).select(
        tx.chunk_id("id", F.col("c.chunk_index")).alias("id"), "wing", "room", "title", F.col("c.text").alias("text"), F.col("c.text").alias("embed_source"),
        "c.chunk_index", F.col("id").alias("parent_drawer_id"), F.lit(False).alias("is_parent"),
    )
    return parent.unionByName(child)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (end it with a unique column)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def insert(base: DataFrame, new: DataFrame) -> DataFrame:
    """base with the rows of new behind it, whether their keys are there or not; columns that new lacks are null."""
    return base.unionByName(new, allowMissingColumns=True)


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of new in place of those with equal keys; new has one row per key."""
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_drawers(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert planned rows; old chunks of the same parents go, so that none outlives its text."""
    parents = rows.where("parent_drawer_id is null").select("id")
    kept = base.join(rows.select("id"), "id", "left_anti").join(parents.withColumnRenamed("id", "parent_drawer_id"), "parent_drawer_id", "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def delete_drawers(base: DataFrame, ids: DataFrame) -> DataFrame:
    """base without the drawers of ids (id) and their chunks."""
    kept = base.join(ids, "id", "left_anti")
    return kept.join(ids.withColumnRenamed("id", "parent_drawer_id"), "parent_drawer_id", "left_anti")


def has_row(read: Callable[[], DataFrame | None], condition: Column) -> bool | None:
    """Whether a table that `read` opens has such a row; None if it cannot be read, which is not the same as False."""
    try:
        rows = read()
        return rows is not None and not rows.where(condition).limit(1).isEmpty()
    except Exception:  # noqa: BLE001
        return None


class Store:
    """Tables as immutable folders below one root, named by manifests.

    versions/<n>.json of a table lists the folder of each of its buckets; the present version is the
    greatest number there. A manifest is written aside and then renamed to its number, which fails
    if another writer has it: so there is no moment without a version, a crash leaves at most folders
    that no manifest names (vacuum() removes them), and a reader keeps the version it opened.

    Rows are spread over buckets by a hash of the table's key, as many as keep a bucket near
    rows_per_bucket, so a change of known buckets rewrites those alone and costs the same however
    large the table is.
    """

    def __init__(self, spark: SparkSession, root: str, rows_per_bucket: int = 200_000) -> None:
        self.spark, self.root, self.rows_per_bucket = spark, root.rstrip("/"), rows_per_bucket
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _numbers(self, name: str) -> list[int]:
        folder = self._path(name, "versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, name: str, number: int | None = None) -> dict:
        """The manifest of a version, by default the present one; number 0 and no buckets before the first."""
        numbers = self._numbers(name) if number is None else [number]
        if not numbers:
            return {"number": 0, "buckets": {}, "n": 0, "full": False}
        jvm = self.spark.sparkContext._jvm
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(self._fs.open(self._path(name, "versions", f"{numbers[-1]}.json"))))
        try:
            return json.loads(lines.readLine())
        finally:
            lines.close()

    def _load(self, seen: dict, buckets: list[int] | None = None) -> DataFrame | None:
        if not seen["number"]:
            return None
        schema = T.StructType.fromJson(seen["schema"])
        paths = [p for b, p in seen["buckets"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*sorted(set(paths)))

    def read(self, name: str) -> DataFrame | None:
        """The present table; None before the first version."""
        return self._load(self.version(name))

    def touched(self, seen: dict, key: Column, rows: DataFrame) -> list[int]:
        """The buckets of a version that rows fall into by their key, at most all of them."""
        return [r[0] for r in rows.select(self._bucket(key, max(1, seen["n"])).alias("b")).distinct().collect()]

    def near(self, name: str, key: Column, rows: DataFrame) -> DataFrame | None:
        """The rows of the present table in the buckets of rows; None before the first version."""
        seen = self.version(name)
        return self._load(seen, self.touched(seen, key, rows)) if seen["number"] else None

    @staticmethod
    def _bucket(key: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def _commit(self, name: str, manifest: dict) -> bool:
        """Publish a manifest under its number unless another writer has done so."""
        jvm = self.spark.sparkContext._jvm
        aside, final = self._path(name, "tmp", uuid.uuid4().hex), self._path(name, "versions", f"{manifest['number']}.json")
        out = self._fs.create(aside, True)
        out.write(bytearray((json.dumps(manifest) + "\n").encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(
                self._fs.makeQualified(aside), self._fs.makeQualified(final), none
            )
        except Exception:  # noqa: BLE001
            self._fs.delete(aside, False)
            if self._fs.exists(final):
                return False
            raise
        return True

    def change(self, name: str, make: Callable[[DataFrame | None], DataFrame], key: Column | None = None, touching: DataFrame | None = None) -> int:
        """Write make(present rows) as the next version; returns its number.

        key: the column that spreads rows over buckets, always the same for a table. With touching,
        rows that have that column, make gets and returns only the rows of their buckets and the other
        buckets stay as they are. One lost race is retried, the second raises
        ConcurrentModificationError.
        """
        for _ in range(2):
            seen = self.version(name)
            some = self.touched(seen, key, touching) if touching is not None and seen["number"] and not seen["full"] else None
            if some == []:
                return seen["number"]
            rows, n, full = make(self._load(seen, some)), max(1, seen["n"]), False
            if key is not None:
                rows = checkpointed(rows)
                size = rows.count()
                if some is None:
                    n = max(1, -(-size // self.rows_per_bucket))
                else:
                    # The next change spreads the table over more buckets.
                    full = size > 4 * self.rows_per_bucket * len(some)
            number = seen["number"] + 1
            folder = f"{self.root}/{name}/data/{number}-{uuid.uuid4().hex[:8]}"
            if key is None or n == 1:
                rows.write.parquet(f"{folder}/_b=0")
            else:
                rows.withColumn("_b", self._bucket(key, n)).repartition("_b").write.partitionBy("_b").parquet(folder)
            there = [f.getPath().getName() for f in self._fs.listStatus(self._path(name, "data", folder.rsplit("/", 1)[1]))]
            fresh = {b[3:]: f"{folder}/{b}" for b in there if b.startswith("_b=")}
            if some is not None and not set(map(int, fresh)) <= set(some):
                raise ValueError(f"a change of {name} made rows outside of what it touches")
            kept = {b: p for b, p in seen["buckets"].items() if some is not None and int(b) not in some}
            if self._commit(name, {"number": number, "n": n, "full": full, "buckets": kept | fresh, "schema": rows.schema.jsonValue()}):
                return number
        raise ConcurrentModificationError(name)

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Remove data that none of the last `keep` versions names, and their manifests; returns the folders removed.

        Not to be run while a change of the table is under way.
        """
        numbers = self._numbers(name)
        live = {p.rsplit("/", 2)[-2] for v in numbers[-keep:] for p in self.version(name, v)["buckets"].values()}
        for v in numbers[:-keep]:
            self._fs.delete(self._path(name, "versions", f"{v}.json"), False)
        data = self._path(name, "data")
        dead = [f.getPath() for f in self._fs.listStatus(data) if f.getPath().getName() not in live] if self._fs.exists(data) else []
        for p in dead:
            self._fs.delete(p, True)
        self._fs.delete(self._path(name, "tmp"), True)
        return len(dead)
