"""File sources, the memory object and streaming on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import embedding as em
from quillstone.memory import Memory
from quillstone.operators import orphans
from quillstone.sources import files
from quillstone.streaming import incremental


@pytest.fixture
def memory(spark, tmp_path):
    ticks = iter(range(100_000))
    return Memory(spark, f"file://{tmp_path}/m", clock=lambda: f"2024-01-01 00:{(n := next(ticks)) // 60 % 60:02d}:{n % 60:02d}")


def test_drawer_life(memory):
    first = memory.add_drawer("w", "r", "Title", "short text about parsers")
    assert memory.add_drawer("w", "r", "Other title", "short text about parsers") == first
    long_ = memory.add_drawer("w", "r", "", "Head line\n" + "body words " * 200)
    assert memory.get_drawer(long_)["title"] == "Head line"
    assert memory.table("drawers").where(F.col("parent_drawer_id") == long_).count() == 3
    filed = memory.get_drawer(long_)["filed_at"]
    memory.update_drawer(long_, text="now short")
    assert memory.get_drawer(long_)["text"] == "now short" and memory.get_drawer(long_)["filed_at"] == filed
    assert memory.table("drawers").where(F.col("parent_drawer_id") == long_).count() == 0
    assert [r.id for r in memory.list_drawers("w").collect()] and memory.list_drawers("w").first().total == 2
    assert memory.delete_drawer(long_)["success"] and not memory.delete_drawer(long_)["success"]
    with pytest.raises(KeyError):
        memory.get_drawer(long_)


def test_search_duplicates_and_checkpoint(memory):
    memory.add_drawer("w", "r", "a", "alpha beta gamma ab-12.3")
    memory.add_drawer("w", "s", "b", "delta epsilon zeta")
    assert memory.search("ab-12.3").where("rank = 1").first().title == "a"
    assert memory.check_duplicate("alpha beta gamma ab-12.3").count() == 1
    out = memory.checkpoint([{"wing": "w", "room": "r", "text": "brand new words"}, {"wing": "w", "room": "r", "text": "brand new words"}, {"wing": "w"}], {"agent": "ag", "topic": "t", "entry": "e"})
    assert (len(out["added"]), len(out["duplicates"]), len(out["errors"])) == (1, 1, 1)
    assert memory.diary_read("ag").first().title == "t"
    again = memory.checkpoint([{"wing": "w", "room": "r", "text": "brand new words"}])
    assert again["duplicates"] == [{"item": 0, "id": out["added"][0]}] and not again["added"]
    chunk = memory.add_drawer("w", "r", "Long", "body words " * 200) + "_chunk_000001"
    assert memory.get_drawer(chunk)["chunk_index"] == 1 and memory.delete_drawer(chunk)["success"]
    assert memory.search("brand", tag_filter=["x"]).count() == 0


def test_facts_tags_tunnels_and_sources(memory):
    memory.kg_add("f1", "A", "p", "B")
    assert memory.kg_query("A").count() == 1 and memory.kg_query("B", "incoming").count() == 1
    assert memory.kg_invalidate(triple=("A", "p", "B")) == 1 and memory.kg_invalidate(fact_id="none") == 0
    assert memory.kg_query("A").count() == 0
    with pytest.raises(ValueError):
        memory.kg_invalidate()
    one = memory.add_drawer("w", "r", "t", "text one", source_file="f.md")
    memory.add_drawer("v", "r", "t", "text two")
    for _ in range(2):
        memory.tag(one, "x")
    assert memory.table("drawer_tags").count() == 1
    memory.untag(one, "y")
    memory.untag(one, "x")
    assert memory.table("drawer_tags").count() == 0
    t = memory.create_tunnel(("w", "r"), ("v", "r"), "l")
    assert memory.create_tunnel(("v", "r"), ("w", "r"), "m") == t
    row = memory.table("tunnels").collect()
    assert len(row) == 1 and row[0].source_wing == "v" and row[0].label == "m"
    with pytest.raises(ValueError):
        memory.create_tunnel(("w", "r"), ("nowhere", "r"))
    memory.delete_tunnel(t)
    assert memory.table("tunnels").count() == 0
    assert memory.delete_by_source("f.md")["count"] == 1 and memory.table("drawers").count() == 2
    memory.delete_by_source("f.md", dry_run=False)
    assert memory.table("drawers").count() == 1


def test_loads_run_twice(spark, memory, tmp_path):
    facts = [{"id": f"t{i}", "subject": f"s{i % 37}", "predicate": f"p{i % 4}", "object": f"o{i % 53}"} | ({"confidence": 0.5} if i % 2 == 0 else {}) | ({"valid_from": "2024-01-02T03:04:05"} if i % 7 == 0 else {}) for i in range(250)]
    (tmp_path / "facts.jsonl").write_text("\n\n".join(map(json.dumps, facts)))
    rows = files.facts(spark, f"file://{tmp_path}/facts.jsonl")
    for _ in range(2):
        memory.load_facts(rows)
        t = memory.table("kg_triples")
        assert t.count() == 250 and t.where("confidence = 1.0").count() == 125 and t.where("valid_from = timestamp_ntz '2024-01-02 03:04:05'").count() == 36
    drawers = [{"id": "a", "wing": "w", "room": "r", "text": "First\nline"}, {"id": "b", "wing": "w", "room": "r", "title": "T", "filed_at": "2024-05-06T07:08:09", "text": "x" * 1700}]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, drawers)))
    for _ in range(2):
        memory.load_drawers(files.drawers(spark, f"file://{tmp_path}/d.jsonl"))
        assert {r.title for r in memory.table("drawers").collect()} == {"First", "T"}
    for _ in range(2):
        assert memory.rechunk() == {"sources": 2, "emitted": 5} and memory.table("drawers").count() == 5


def test_sources_fail_on_bad_rows(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "wing": "w"}\n')
    with pytest.raises(Exception, match="room"):
        files.drawers(spark, f"file://{tmp_path}/bad.jsonl").collect()
    (tmp_path / "worse.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception):  # noqa: B017
        files.drawers(spark, f"file://{tmp_path}/worse.jsonl").collect()
    assert files.count_lines(spark, f"file://{tmp_path}/bad.jsonl") == 1


def test_protected_ids(spark):
    lines = ['{"relevant_drawer_ids": ["a", "b"]}', '"c"', "bare-id", "12", "", "  ", '{"other": 1}', "a"]
    got = {r.id for r in files.protected_ids(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {"a", "b", "c", "bare-id"}


@pytest.mark.parametrize("raw, want", [("2024-01-02T03:04:05", "2024-01-02 03:04:05"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05Z", None), ("2024-01-02T03:04:05+01:00", None), ("x", None), (None, None)])
def test_times(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "x string").select(files.normalize_time("x").cast("string").alias("t")).first().t
    assert got == want


def test_file_formats(spark, tmp_path):
    (tmp_path / "log.txt").write_text("s1\x1fa\x1f2024\x1fAdd x\x1fline one\nline two\x1fa.py\nb/c.sql\x1es2\x1fb\x1f2024\x1fwip\x1f\x1f\x1e")
    log = files.git_log(spark, f"file://{tmp_path}/log.txt").collect()
    assert [(r.sha, r.body, r.files) for r in log] == [("s1", "line one line two", "a.py,b/c.sql"), ("s2", "", "")]
    issues = [{"id": "i1", "description": "Do\nFiles: a/b.md (x), optional c.py, prose here", "dependencies": [{"id": "i2"}]}, {"id": "i2", "parent": "p"}]
    for body in (issues, {"issues": issues}):
        (tmp_path / "i.json").write_text(json.dumps(body))
        rows = files.ready_issues(spark, f"file://{tmp_path}/i.json").orderBy("o").select("id", "deps", files.listed_paths("description").alias("p")).collect()
        assert [(r.id, r.deps, r.p) for r in rows][0] == ("i1", ["i2"], ["a/b.md", "c.py"]) and rows[1].deps == []
    pulls = [{"number": 1, "title": "t", "body": None, "labels": [{"name": "rfc"}], "files": [{"path": "a"}], "reviews": []}]
    (tmp_path / "p.json").write_text(json.dumps(pulls))
    assert files.pull_requests(spark, f"file://{tmp_path}/p.json").first()[:] == (1, "t", None, "rfc", "a", False)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "s.jsonl").write_text("{}\n\nx\n")
    (tmp_path / "t" / "s.txt").write_text("no")
    assert [(r.line_no, r.raw) for r in files.transcript_lines(spark, f"file://{tmp_path}/t", 14, "2100-01-01 00:00:00").collect()] == []
    assert [(r.line_no, r.raw) for r in files.transcript_lines(spark, f"file://{tmp_path}/t").orderBy("line_no").collect()] == [(1, "{}"), (2, ""), (3, "x")]
    assert files.files_sorted(spark, f"file://{tmp_path}/t").count() == 2


def test_front_matter_and_scalars(spark):
    text = "---\nwing: 'my wing' # c\nplain: value # c\nempty:\n---\nrest\n---\n"
    df = spark.createDataFrame([(text,), ("no front",)], "t string")
    fm = df.select(files.front_matter("t").alias("f"))
    rows = fm.select("f", files.yaml_scalar("f", "wing").alias("w"), files.yaml_scalar("f", "plain").alias("p"), files.yaml_scalar("f", "empty").alias("e")).collect()
    assert rows[0][1:] == ("my wing", "value", None) and rows[1].f == ""


def test_worktrees_and_attributes(spark):
    text = ["worktree /a", "HEAD 1", "branch refs/x", "", "worktree /b", "HEAD 2", "locked pid 7"]
    got = {r.path: (r.head, r.branch, r.locked) for r in files.worktrees(spark.createDataFrame(list(enumerate(text)), "line_no int, value string")).collect()}
    assert got == {"/a": ("1", "refs/x", None), "/b": ("2", None, "pid 7")}
    e = spark.createDataFrame([(1,), (2,)], "id int")
    rows = spark.createDataFrame([(1, "wing", "w", None), (1, "n", None, 3), (9, "wing", "z", None)], "id int, key string, string_value string, int_value int")
    assert [tuple(r) for r in files.attributes(e, rows, ["wing", "n"]).collect()] == [(1, "w", "3")]


def test_embedding_is_deterministic(spark):
    a, b = em.hashed(["alpha beta", ""])
    assert em.hashed(["alpha beta"])[0] == a and abs(sum(x * x for x in a) - 1) < 1e-5 and b[0] == 1.0
    assert em.embedded(spark.createDataFrame([(None, 1)], "t string, n int"), "t").first().n == 1


def test_stream_resumes_and_upserts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ledger = incremental.OrphanStream(spark, f"file://{tmp_path}/state")
    schema = "op string, ref_field string, row_key string, drawer_id string, at timestamp"
    seen = []

    def apply(batch, number):
        seen.append(number)
        ledger.apply(batch, number)

    def write(name, *rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("op", "ref_field", "row_key", "drawer_id", "at"), r))) for r in rows))
        stream = incremental.json_stream(spark, f"file://{tmp_path}/in", schema, 1)
        incremental.drain(stream, apply, f"file://{tmp_path}/cp")
        return {r.row_key: r.status for r in orphans.orphans(ledger.state(max(seen))).collect()}

    assert write("a.json", ("reference", "f", "k1", "x", "2024-01-05T00:00:00"), ("reference", "f", "k2", "y", "2024-01-05T00:00:00")) == {"k1": "absent", "k2": "absent"}
    assert write("b.json", ("filing", None, None, "x", "2024-01-01T00:00:00"), ("filing", None, None, "y", "2024-02-01T00:00:00")) == {"k2": "late"}
    assert write("c.json", ("deletion", None, None, "x", "2024-03-01T00:00:00")) == {"k1": "removed", "k2": "late"}


def test_once_per_key_and_hours(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:00"), ("b", "2024-01-01 01:10:00"), ("c", "2024-01-01 09:00:00")]
    df = spark.createDataFrame(rows, "event_type string, t string").select("event_type", F.col("t").cast("timestamp_ntz").alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")
    got = []
    incremental.drain(incremental.once_per_key(stream(), ["event_type"], "ts"), lambda b, n: got.extend(r.event_type for r in b.collect()), f"{tmp_path}/c1")
    assert sorted(got) == ["a", "b", "c"]
    hours = []
    incremental.drain(incremental.hourly_counts(stream()), lambda b, n: hours.extend((r.event_type, r.n) for r in b.collect()), f"{tmp_path}/c2")
    assert sorted(hours) == [("a", 2), ("b", 1)]


def test_marks(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    fresh, mark = incremental.after_mark(rows, "n", 1)
    assert fresh.count() == 2 and mark == 3 and incremental.after_mark(rows, "n", 3)[1] == 3
    assert incremental.unseen(rows, rows.where("n < 3"), ["n"]).count() == 1
