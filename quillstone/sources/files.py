"""File sources: JSON lines, transcripts, history records, issue lists, front matter, attribute rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DRAWER = "id string, wing string, room string, title string, text string, source_file string, chunk_index int, parent_drawer_id string, added_by string, filed_at string"
FACT = "id string, subject string, predicate string, object string, confidence float, valid_from string, valid_to string, source_closet string, current boolean, created_at string"
TRUTH = "query string, relevant_drawer_ids array<string>, kind string"


def normalize_time(x: str | Column) -> Column:
    """'2024-01-02T03:04:05' or with a blank as a timestamp without zone; offsets, Z and other forms are null."""
    c = F.col(x) if isinstance(x, str) else x
    plain = F.regexp_replace(c, "^([^T]*)T", "$1 ")
    return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}(\.\d+)?)?$"), plain.try_cast("timestamp_ntz"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a JSON-lines file; blank lines are skipped, a malformed line fails the read."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("o")).select("o.*")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where("trim(value) <> ''").count()


def required(rows: DataFrame, *names: str) -> DataFrame:
    """rows, failing at run time on one that lacks a required member."""
    for name in names:
        message = F.concat(F.lit(f"row lacks {name}: "), F.to_json(F.struct(*rows.columns)))
        rows = rows.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(message).cast("string")))
    return rows


def drawers(spark: SparkSession, path: str) -> DataFrame:
    return required(json_lines(spark, path, DRAWER), "id", "wing", "room")


def facts(spark: SparkSession, path: str) -> DataFrame:
    return required(json_lines(spark, path, FACT), "id", "subject", "predicate", "object")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus whose id member is `id` or `drawer_id`."""
    rows = json_lines(spark, path, DRAWER + ", drawer_id string")
    return rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), "drawer_id")).drop("drawer_id")


def ground_truth(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    rows = json_lines(spark, path, TRUTH)
    return rows if kinds is None else rows.where(F.col("kind").isin(kinds))


def protected_ids(lines: DataFrame) -> DataFrame:
    """(id) named by lines (value): an object with relevant_drawer_ids, a JSON string, or a bare id.

    A line that is any other JSON value, such as a number, names nothing.
    """
    v = "try_parse_json(concat('[', trim(value), ']'))"
    kind = "substr(schema_of_variant(variant_get(v, '$[0]', 'variant')), 1, 2)"
    rows = lines.where("trim(value) <> ''").withColumn("v", F.expr(v))
    ids = (
        f"case when v is null then array(trim(value)) when {kind} = 'OB' then coalesce(try_variant_get(v, '$[0].relevant_drawer_ids', 'array<string>'), array()) "
        f"when {kind} = 'ST' then array(variant_get(v, '$[0]', 'string')) else array() end"
    )
    return rows.select(F.explode(F.expr(ids)).alias("id")).where("id <> ''").distinct()


def in_window(path: Column, modified: Column, days: int, now: str) -> Column:
    """Whether a file is a *.jsonl directly in its folder and was modified less than `days` whole days before now."""
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(modified.cast("timestamp"))) / 86400)
    return path.rlike(r"^[^/]+\.jsonl$") & (age < days)


def transcript_lines(spark: SparkSession, path: str, days: int | None = None, now: str | None = None) -> DataFrame:
    """(record_id, file_name, line_no, raw) of the *.jsonl files directly in a folder.

    days: only files modified within that many whole days before `now`. A file is read whole to
    number its lines, as the order of rows in a split file is not known otherwise.
    """
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.jsonl").load(path).select("value", "_metadata.file_name", "_metadata.file_modification_time")
    if days is not None:
        files = files.where(in_window(F.col("file_name"), F.col("file_modification_time"), days, now))
    lines = files.select("file_name", F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "raw"))
    return lines.select(F.xxhash64("file_name", "at").alias("record_id"), "file_name", (F.col("at") + 1).alias("line_no"), "raw")


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(sha, author, date, subject, body, files) of records ended by 0x1e with fields ended by 0x1f; newlines in a body become blanks."""
    records = spark.read.option("lineSep", "\x1e").text(path).select(F.split("value", "\x1f").alias("f")).where("size(f) >= 6")
    field = lambda i: F.trim(F.regexp_replace(F.get("f", F.lit(i)), "[\r\n]+", " "))
    return records.select(field(0).alias("sha"), field(1).alias("author"), field(2).alias("date"), field(3).alias("subject"), field(4).alias("body"), F.regexp_replace(F.trim(F.regexp_replace(F.get("f", F.lit(5)), "\n", " ")), " +", ",").alias("files"))


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    """(number, title, body, labels, files, has_review) of a JSON array of merged pull requests."""
    schema = "array<struct<number:bigint,title:string,body:string,labels:array<struct<name:string>>,files:array<struct<path:string>>,reviews:array<struct<state:string>>>>"
    rows = spark.read.option("wholetext", True).text(path).select(F.inline(F.from_json("value", schema)))
    return rows.select("number", "title", "body", F.array_join("labels.name", ",").alias("labels"), F.array_join("files.path", ",").alias("files"), (F.coalesce(F.size("reviews"), F.lit(0)) > 0).alias("has_review"))


ISSUE = "id:string,parent:string,status:string,description:string,design:string,notes:string,dependencies:array<struct<id:string>>"


def ready_issues(spark: SparkSession, path: str) -> DataFrame:
    """(o, id, parent, status, description, design, notes, deps, files) of a JSON array of issues or an object with `issues`; o is the order."""
    whole = spark.read.option("wholetext", True).text(path)
    items = F.coalesce(F.from_json("value", f"array<struct<{ISSUE}>>"), F.from_json("value", f"struct<issues:array<struct<{ISSUE}>>>")["issues"])
    as_object = F.when(F.ltrim("value").startswith("{"), F.from_json("value", f"struct<issues:array<struct<{ISSUE}>>>")["issues"]).otherwise(items)
    rows = whole.select(F.posexplode(as_object).alias("o", "i")).select("o", "i.*")
    return rows.withColumn("deps", F.coalesce(F.col("dependencies.id"), F.array().cast("array<string>"))).drop("dependencies")


def listed_paths(description: str | Column) -> Column:
    """The real paths of a `Files:` line."""
    from quillstone.functions.text import is_path, norm_path

    c = F.col(description) if isinstance(description, str) else description
    line = F.regexp_extract(c, r"(?m)^\s*Files:\s*(.*)$", 1)
    return F.array_distinct(F.filter(F.transform(F.split(line, ","), norm_path), is_path))


def files_sorted(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of all files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.sha2("content", 256).alias("sha256")).orderBy("path")


def manifest_digests(lines: DataFrame, key: str) -> DataFrame:
    """(key, manifest): SHA-256 over the sorted lines (key, line) of each key.

    Lines are sorted on disk where needed and hashed as they stream by, so no key's lines are gathered.
    """
    kind = lines.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for pdf in batches:
            for k, line in zip(pdf[key], pdf["line"]):
                k = None if pd.isna(k) else k
                if digest is None or k != now:
                    if digest is not None:
                        yield pd.DataFrame({key: [now], "manifest": [digest.hexdigest()]})
                    now, digest = k, hashlib.sha256()
                digest.update(line.encode())
        if digest is not None:
            yield pd.DataFrame({key: [now], "manifest": [digest.hexdigest()]})

    return lines.select(key, "line").repartition(key).sortWithinPartitions(key, "line").mapInPandas(run, f"{key} {kind}, manifest string")


def front_matter(text: str | Column) -> Column:
    """What stands between the first two --- lines, '' without."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(c, r"(?s)\A---[ \t]*\r?\n(.*?)(?:\A|\n)---[ \t]*(?:\r?\n|\z)", 1)


def yaml_scalar(text: str | Column, key: str) -> Column:
    """The plain value of a top-level key: comment and quotes removed; null if absent or empty."""
    c = F.col(text) if isinstance(text, str) else text
    raw = F.regexp_extract(c, rf"(?m)^{re.escape(key)}:[ \t]*(.*)$", 1)
    bare = F.when(raw.rlike("""^["']"""), F.regexp_extract(raw, r"""^["']([^"']*)["']""", 1)).otherwise(F.rtrim(F.regexp_replace(raw, r"\s+#.*$", "")))
    return F.nullif(bare, F.lit(""))


def worktrees(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, path, head, branch, locked) from porcelain listings as (*by, line_no, value): the last `worktree` line before owns a line.

    A listing is that of one checkout, so it is short; by names what tells listings apart.
    """
    w = Window.partitionBy(*by).orderBy("line_no")
    word, rest = F.substring_index("value", " ", 1), F.expr("substr(value, instr(value, ' ') + 1)")
    owned = lines.withColumn("path", F.last(F.when(word == "worktree", rest), ignorenulls=True).over(w)).where("path is not null")
    pick = lambda name: F.max(F.when(word == name, rest))
    return owned.groupBy(*by, "path").agg(pick("HEAD").alias("head"), pick("branch").alias("branch"), F.max(F.when(word == "locked", F.when(F.col("value") == "locked", F.lit("")).otherwise(rest))).alias("locked"))


def attributes(entities: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Entity rows (id) with their attribute rows (id, key, string_value, int_value) as one column per key."""
    value = F.coalesce("string_value", F.col("int_value").cast("string"))
    return entities.join(rows, "id").groupBy("id").pivot("key", keys).agg(F.first(value))
