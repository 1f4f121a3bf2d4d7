"""State documents, stamps, readings, canonical order, history mining, gates and set-valued parts on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import shell
from quillstone.operators import drift, evaluate, mining, state
from quillstone.sources import files

UPDATES = "doc string, seq int, key string, value string, at string"


def test_state_documents_follow_the_rules_of_each_key(spark):
    rows = [
        ("a", 1, "bead", "ab-1", "t1"), ("a", 2, "bead", "null", "t2"), ("a", 3, "dispatch", "worker", "t3"), ("a", 4, "dispatch", "inline:small", "t4"),
        ("a", 5, "dispatch", "inline:x", "t5"), ("a", 6, "orphan_pressure", "7", "t6"), ("a", 7, "parallel_candidates", "12", "t7"), ("a", 8, "parallel_candidates", "x", "t8"),
        ("a", 9, "nonsense", "y", "t9"), ("a", 0, "stage", "green", "t0"), ("b", 1, None, None, None), (None, 1, "stage", "red", "t1"),
    ]
    got = {r.doc: r for r in state.merge(spark.createDataFrame(rows + rows[:0], UPDATES)).collect()}
    a = got["a"]
    assert (a.bead, a.dispatch, a.stage, a.orphan_pressure, a.parallel_candidates, a.dispatched, a.inline, a.updated) == (None, "inline:x", "green", 7, 0, 1, 2, "t9")
    assert got["b"].stage is None and got["b"].orphan_pressure == 0 and got[None].stage == "red"
    assert state.merge(spark.createDataFrame([], UPDATES)).count() == 0
    j = spark.createDataFrame([('{"stage": "green", "bead": null}',), (None,), ("broken",)], "j string")
    assert [r[0] for r in j.select(state.field(F.col("j"), "stage")).collect()] == ["green", "", ""]
    assert j.select(state.field(F.col("j"), "bead")).first()[0] == ""


def test_stamps_keep_two_facts_apart(spark):
    present = spark.createDataFrame([("new", "s1", "d1", None, None), ("old", None, None, "h1", "d2"), ("bare", "", None, "h2", None)], "target string, last_synced string, last_synced_date string, hash string, date string")
    writes = [("new", 1, False, "c1", "e1"), ("new", 2, False, "c2", "e2"), ("old", 1, False, "c3", "e3"), ("bare", 1, False, "c4", "e4"), ("bare", 2, False, "c5", "e5"), ("none", 1, False, "c6", "e6"), ("sync", 1, True, "c7", "e7"), ("sync", 2, False, "c8", "e8")]
    got = {r.target: tuple(r)[1:] for r in state.stamps(present, spark.createDataFrame(writes, "target string, seq int, synced boolean, hash string, date string")).collect()}
    assert got == {
        "new": ("s1", "d1", "c2", "e2"), "old": ("h1", "d2", "c3", "e3"), "bare": ("h2", "e4", "c5", "e5"), "none": (None, None, "c6", "e6"), "sync": ("c7", "e7", "c8", "e8"),
    }


def test_readings_rise_over_the_last_and_above_nothing(spark):
    rows = [("k", i, n) for i, n in enumerate([0, 2, 2, 1, 3, 0, 1])]
    got = state.rising(spark.createDataFrame(rows, "k string, i int, n int"), "k", ["i"], "n")
    assert sorted((r.i, r.n, r.before) for r in got.collect()) == [(1, 2, 0), (4, 3, 1), (6, 1, 0)]


def test_canonical_order_is_input_order_then_byte_order(spark):
    rows = [(5, "b"), (1, "z"), (2, "mZ"), (3, "ma"), (4, "mÄ"), (6, "ma")]
    got = state.canonical_order(spark.createDataFrame(rows, "at int, value string").repartition(3), F.col("value").startswith("m"))
    assert [r.value for r in got.orderBy("position").collect()] == ["z", "b", "mZ", "ma", "ma", "mÄ"]
    assert sorted(r.position for r in got.collect()) == [1, 2, 3, 4, 5, 6]
    assert state.canonical_order(spark.createDataFrame([], "at int, value string"), F.lit(True)).count() == 0


def test_retries_wait_and_give_up(spark):
    slept, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return x * 2

    assert mining.retried(flaky, sleep=slept.append)(4) == 8 and slept == [8, 30]
    with pytest.raises(OSError):
        mining.retried(lambda: (_ for _ in ()).throw(OSError("down")), waits=(1, 2), warm_up=0, sleep=slept.append)()
    assert slept == [8, 30, 0, 1, 2]


def test_mining_judges_clusters_and_moves_its_mark(spark):
    units = [(i, f"s{i}", "x" * (40 + i), "src/a.py" if i % 2 else "lib/b.py") for i in range(1, 9)] + [(9, "s9", None, "")]
    df = spark.createDataFrame(units, "id int, subject string, body string, files string")
    out = mining.mine(df, F.lit(2), F.substring_index("files", "/", 1), lambda texts: [len(t) != 47 for t in texts], "log", mark=2, cap=5)
    assert {r.id for r in out.drafts.collect()} == {"3", "4", "5", "6"} and out.mark == 9
    assert {(r.cluster, r.n) for r in out.clusters.collect()} == {("src", 2), ("lib", 2)} and out.triples.count() == 12
    none = mining.mine(df, F.lit(2), F.col("files"), lambda texts: [True] * len(texts), "log", mark=9)
    assert none.mark == 9 and none.triples.count() == 0


def test_gate_and_active_and_stale(spark):
    kind = "kind string, n int, recall double, mrr double"
    before = spark.createDataFrame([("all", 1, 0.5, 0.5), ("x", 1, 0.5, 0.5), ("y", 1, 0.5, 0.5)], kind)
    after = spark.createDataFrame([("all", 1, 0.6, 0.5), ("x", 1, 0.5, 0.9), ("y", 1, 0.6, 0.4)], kind)
    assert {r.kind: r.accepted for r in evaluate.gate(before, after).collect()} == {"all": True, "x": False, "y": False}
    docs = spark.createDataFrame([("a", "OPEN: why"), ("b", "sound: red"), ("c", "sound: green"), ("d", "status: Active"), ("e", "status: active"), ("f", None)], "id string, text string")
    tags = spark.createDataFrame([("d", "exp"), ("d", "exp"), ("c", "exp"), ("e", "other")], "id string, tag string")
    got = drift.active(docs, tags, "OPEN", r"sound: (\w+)", r"status: (\w+)", "exp")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "design"), ("b", "design"), ("d", "exploration")]
    at = lambda *rows: spark.createDataFrame(rows, "k string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    old = drift.older_by(at(("a", "2024-01-20"), ("b", "2024-01-08"), ("c", "2024-03-01")), at(("a", "2024-01-01"), ("a", "2024-01-10"), ("b", "2024-01-01")), "k")
    assert [tuple(r) for r in old.collect()] == [("a", 10)]


def test_classes_verbs_names_and_windows(spark):
    paths = ["docs/tests/a.py", "tests/readme.md", "tests/x.py", "pkg/test_x.py", "pkg/x_test.go", "pkg/x.go", "hooks/a.sh", "a.txt", "x.spec.ts", None]
    p = spark.createDataFrame([(x,) for x in paths], "p string")
    of = lambda runtime: [r[0] for r in p.select(shell.path_class(F.col("p"), runtime)).collect()]
    assert of("") == ["other", "other", "test", "test", "test", "source", "source", "other", "test", "other"]
    assert of("python") == ["other", "other", "test", "test", "other", "other", "source", "other", "other", "other"]
    assert of("go")[4:6] == ["test", "source"] and of("unheard of") == of("")
    lines = ["git merge", "cd x && git -C y --no-pager push origin", "digit push", "bd dolt push", "bd close a; git push", "echo", None]
    c = spark.createDataFrame([(x,) for x in lines], "c string")
    assert [r[0] for r in c.select(shell.central_verb(F.col("c"))).collect()] == ["git merge", None, None, "bd dolt push", "git push", None, None]
    t = spark.createDataFrame([("see pro-ab1",), ("improper-pro-x",), ("heirpro-ab",), ("hooks/x",), ("scripts/pro-y",), (None,)], "text string")
    assert [r.text for r in drift.named_set(t, "pro").collect()] == ["see pro-ab1", "improper-pro-x", "hooks/x", "scripts/pro-y"]
    f = spark.createDataFrame([("a.jsonl", "2024-01-01"), ("a.jsonl", "2024-01-02"), ("d/a.jsonl", "2024-01-09"), ("a.txt", "2024-01-09")], "p string, m string")
    got = f.select(files.in_window(F.col("p"), F.col("m"), 14, "2024-01-15"))
    assert [r[0] for r in got.collect()] == [False, True, False, False]
    listing = spark.createDataFrame([("h", 1, "worktree /a"), ("g", 1, "worktree /b"), ("h", 2, "locked why"), ("g", 2, "HEAD 1")], "host string, line_no int, value string")
    assert {(r.host, r.path, r.head, r.locked) for r in files.worktrees(listing, ("host",)).collect()} == {("h", "/a", None, "why"), ("g", "/b", "1", None)}
