"""Shell lexing and comparisons of two states on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstone.functions import shell
from quillstone.functions import text as tx
from quillstone.operators import drift
from quillstone.plans import drift as plans


def column(spark, build, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in df.select("i", build(F.col("c")).alias("x")).orderBy("i").collect()]


def test_closed_ids_and_options(spark):
    commands = ["bd close a-1 b-2 --reason x && bd close c-3", 'bd close "a-1', "bd close $X a-1", "echo bd", None, "", "bd close -f a-1"]
    assert column(spark, lambda c: shell.closed_ids(c, "bd"), commands) == [["a-1", "b-2", "c-3"], [], [], [], [], [], []]
    assert column(spark, shell.option_text, ["x --reason 'a b' --reason=c", "x", None]) == ["a b\nc", "", ""]


def test_phrases_and_patterns(spark):
    assert column(spark, lambda c: shell.has_phrase(c, "npm run"), ["cd x; npm run y", "npm && run", "'npm run'", None]) == [True, False, False, False]
    df = spark.createDataFrame([("abc", "b+"), ("abc", "("), (None, "a"), ("abc", None)], "t string, p string")
    assert [r.x for r in df.select(shell.matches(F.col("t"), F.col("p")).alias("x")).collect()] == [True, False, False, False]


def test_references_and_classes(spark):
    assert column(spark, shell.evidence_reference, ["see 1a2b3c4 now", "1234567", "short", "x" * 200, None]) == [True, False, False, True, False]
    paths = ["src/a.py", "src/tests/a.py", "test_x.sh", "docs/a.py", "README.md", "data.bin", "a.spec.ts"]
    # A shell script is a test by its folder or its ending, not by its beginning.
    assert column(spark, shell.path_class, paths) == ["source", "test", "source", "other", "other", "other", "test"]


def test_drift_states(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "path string, sha256 string")
    assert {r.path: r.state for r in drift.drift_states(a, b).collect()} == {"x": "OK", "y": "DRIFT differs", "z": "DRIFT absent", "w": "FAIL source missing"}
    m = spark.createDataFrame([("x", dt.datetime(2024, 1, 1)), ("y", dt.datetime(2024, 3, 1))], "path string, changed_at timestamp_ntz")
    sizes = [drift.changed_since(m, old, "h", "2024-02-01").count() for old in (None, "", "h", "g")]
    assert sizes == [2, 2, 0, 1]


def test_decisions_stop(spark):
    items = spark.createDataFrame([("l", i, f"i{i}") for i in range(5)] + [("m", 0, "i3")], "list string, at int, item string")
    decisions = spark.createDataFrame([("i0", "keep"), ("i2", "quit"), ("i3", "keep")], "item string, decision string")
    got = [(r.list, r.at, r.decision) for r in drift.decided(items, decisions).orderBy("list", "at").collect()]
    assert got == [("l", 0, "keep"), ("l", 1, "skip"), ("l", 2, "quit"), ("l", 3, "skip"), ("l", 4, "skip"), ("m", 0, "keep")]


def test_issues(spark):
    issues = spark.createDataFrame([("ab-1x2", "open", "see https://github.com/o/r/pull/7"), ("ab-9zz", "closed", "none")], "id string, status string, description string")
    subjects = spark.createDataFrame([("Close ab-1x2 and ab-9zz",)], "s string")
    assert [r.id for r in drift.merged_but_open(subjects, issues, tx.id_scan("s", "ab")).collect()] == ["ab-1x2"]
    pulls = spark.createDataFrame([("https://github.com/o/r/pull/7", "merged")], "url string, state string")
    assert {r.id: r.state for r in drift.pull_states(issues, pulls, tx.pull_url("description")).collect()} == {"ab-1x2": "MERGED", "ab-9zz": "SKIP"}
    trees = spark.createDataFrame([("/a", 1, None), ("/b", 2, "ab-9zz"), ("/c", 1, "ab-1x2"), ("/d", None, None)], "path string, pid int, issue string")
    live = spark.createDataFrame([(1,)], "pid int")
    assert {r.path for r in drift.abandoned(trees, live, issues).collect()} == {"/b"}


@pytest.mark.parametrize("rare, want", [(5, {("o", "c1", "strong"), ("o", "c2", "weak")}), (0, {("o", "c1", "strong")})])
def test_related(spark, rare, want):
    schema = "id string, text string"
    open_ = spark.createDataFrame([("o", "ab-1x2 parser breaks")], schema)
    closed = spark.createDataFrame([("c1", "fixed ab-1x2"), ("c2", "parser rewrite"), ("c3", "nothing")], schema)
    got = drift.related(open_, closed, tx.id_scan("text", "ab"), tx.word_set("text", 5), rare)
    assert {tuple(r) for r in got.collect()} == want


def test_related_keeps_pairs_through_common_words(spark):
    schema = "id string, text string"
    open_ = spark.createDataFrame([("o", "ab-1x2 parser breaks"), ("n", None)], schema)
    closed = spark.createDataFrame([(f"c{i}", "the parser again, ab-1x2" if i == 0 else "the parser again") for i in range(40)] + [("x", None), ("y", "nothing")], schema)
    got = [tuple(r) for r in drift.related(open_, closed, tx.id_scan("text", "ab"), tx.word_set("text", 5)).collect()]
    assert sorted(got) == sorted([("o", "c0", "strong")] + [("o", f"c{i}", "weak") for i in range(1, 40)])


def test_upstream_pairs_surface_every_document(spark, tmp_path):
    spark.createDataFrame([(1000 + i, "the parser reloads") for i in range(30)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "what broke the parser?")], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert {tuple(r) for r in plans.upstream_pairs(spark, str(tmp_path)).collect()} == {(1, 1000 + i, "weak") for i in range(30)}


def test_citations_of_every_kind(spark):
    text = "Fixed in commit 1a2b3c4 (ab-1f2): see src/a/b.sql, _docs/c.md_ and jobs/d.sh.bak. Not /tmp/x.py, 1/2 or deadbee. Run /audit-project. Drawer `Old Title!`, drawer_w_r_" + "0" * 24
    df = spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "doc_id bigint, text string")
    want = {("drawer", "drawer_w_r_" + "0" * 24), ("issue", "ab-1f2"), ("commit", "1a2b3c4"), ("slug", "old title"), ("command", "audit-project")}
    want |= {("path", p) for p in ("src/a/b.sql", "docs/c.md", "jobs/d.sh.bak")}
    got = drift.citations(df, "doc_id").collect()
    assert {(r.kind, r.id) for r in got} == want and {r.doc_id for r in got} == {1} and len(got) == len(want)


def test_doc_citations_reports_what_does_not_resolve(spark, tmp_path):
    gone = "drawer_w_r_" + "0" * 24
    docs = [(1, f"src/a.py, src/gone.sql. ab-1f2 ab-999 drawer `Kept title` drawer `lost title` {gone}"), (2, "src/a.py")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    drawers = [("d1", "w", "r", "ab-1f2 first", "src/a.py"), ("d2", "w", "r", "Kept title", None)]
    spark.createDataFrame(drawers, "id string, wing string, room string, title string, source_file string").write.parquet(f"{tmp_path}/drawers.parquet")
    got = {tuple(r) for r in plans.doc_citations(spark, str(tmp_path)).collect()}
    assert got == {(1, "path", "src/gone.sql"), (1, "issue", "ab-999"), (1, "slug", "lost title"), (1, "drawer", gone)}


def test_first_present_and_counts(spark):
    value, name = drift.first_present(flag=F.col("a"), file=F.col("b"))
    df = spark.createDataFrame([("", "x"), ("y", None), (None, None)], "a string, b string")
    assert [tuple(r) for r in df.select(value, name).collect()] == [("x", "file"), ("y", "flag"), (None, None)]
    claims = spark.createDataFrame([("rooms", 2), ("wings", 1)], "what string, claimed int")
    actual = spark.createDataFrame([("rooms", 2)], "what string, n int")
    assert {r.what: r.holds for r in drift.claimed_counts(claims, actual).collect()} == {"rooms": True, "wings": False}


@pytest.mark.parametrize("url, want", [("https://github.com/o/r.git", ["o/r"]), ("git@github.com:o/r.git", ["o/r"]), ("x github.com/a/b-c and github.com/d/e.f", ["a/b-c", "d/e.f"])])
def test_repo_slugs(spark, url, want):
    assert column(spark, tx.repo_slugs, [url]) == [want]
