"""Text identities, the versioned store, graph and count operators on small fixtures."""

import datetime as dt
import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import bm25, census, graph, store


def one(spark, column, **values):
    kinds = {k: ("int" if isinstance(v, int) else "array<string>" if isinstance(v, list) else "string") for k, v in values.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("abc-40ec.7", ["abc-40ec.7", "abc", "40ec", "7", "abc-40ec"]), ("a.b.c", ["a.b.c", "a", "b", "c", "a.b"]), ("Plain, text", ["plain", "text"]), ("", []), ("a-a", ["a-a", "a"])],
)
def test_identifier_tokens(spark, text, want):
    assert one(spark, tx.index_tokens("t"), t=text) == want


def test_content_hash_frames_its_parts(spark):
    a, b = one(spark, tx.content_hash("x", "y"), x="ab", y="c"), one(spark, tx.content_hash("x", "y"), x="a", y="bc")
    assert a != b and a == hashlib.sha256(b"2:ab1:c").hexdigest()[:24]
    assert one(spark, tx.content_hash("x"), x="é🧭") == hashlib.sha256("2:é🧭".encode()).hexdigest()[:24]


def test_tunnel_id_is_symmetric(spark):
    ends = {"a": "w1", "b": "r1", "c": "w2", "d": "r2"}
    assert one(spark, tx.tunnel_id("a", "b", "c", "d"), **ends) == one(spark, tx.tunnel_id("c", "d", "a", "b"), **ends)


@pytest.mark.parametrize("n, want", [(2000, [800, 800, 400]), (800, []), (801, [800, 1]), (0, [])])
def test_chunk_sizes(spark, n, want):
    assert [len(c.text) for c in one(spark, tx.chunks("t"), t="x" * n)] == want


@pytest.mark.parametrize("title, want", [("# lo-jk17 — x", "lo-jk17"), ("exploration of a-b", None), ("", None), (None, None), ("  ## Ab-1.2 y", "ab-1.2")])
def test_leading_id(spark, title, want):
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(tx.leading_id("t").alias("x")).first().x == want


@pytest.mark.parametrize("text, want", [("\n \n  Head \nrest", "Head"), ("", "(untitled)"), (None, "(untitled)"), ("a\x85b", "a"), ("x" * 600, "x" * 512)])
def test_derived_title(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.derive_title("t").alias("x")).first().x == want


@pytest.mark.parametrize("x, want", [("abc-e63", "abc"), ("tl-puz-bwv", "tl-puz"), ("ab-9z1.8", "ab"), ("a-b", None), ("abc", None)])
def test_id_prefix(spark, x, want):
    assert one(spark, tx.id_prefix("t"), t=x) == want


def test_id_scan_starts_at_tokens(spark):
    text = "see ab-z3m.1.4, infra/ab-cluster.tf check-ab-upstream ab-z3m.1.4 (ab-x1y)"
    assert one(spark, tx.id_scan("t", "ab"), t=text) == ["ab-z3m.1.4", "ab-x1y"]


@pytest.mark.parametrize("raw, want", [("a/b.md (router)", "a/b.md"), ("optional x/ ", "x"), ("[note]", "")])
def test_norm_path(spark, raw, want):
    assert one(spark, tx.norm_path("t"), t=raw) == want


@pytest.mark.parametrize("p, want", [("a/b", True), (".env", True), ("x.md", True), ("word", False), ("two words/x", False), ("", False), ("foo.", False)])
def test_is_path(spark, p, want):
    assert one(spark, tx.is_path("t"), t=p) is want


@pytest.mark.parametrize("files, want", [("a/x,db/Schema.sql", "schema"), ("src/a.py", "src"), ("README.md", "_root"), ("", "_misc"), (None, "_misc"), ("x/config.yml,y/migrate.py", "migrat")])
def test_cluster_key(spark, files, want):
    assert spark.createDataFrame([(files,)], "f string").select(tx.cluster_key("f").alias("x")).first().x == want


def test_plan_rows(spark):
    rows = store.plan_rows(spark.createDataFrame([("w", "r", "T", "x" * 2000), ("w", "r", "S", "short")], "wing string, room string, title string, text string")).collect()
    long_ = sorted((r for r in rows if len(r.text) == 2000 or r.parent_drawer_id), key=lambda r: (r.chunk_index is not None, r.chunk_index))
    assert [len(r.text) for r in long_] == [2000, 800, 800, 400] and long_[0].embed_source == "T" and long_[0].is_parent
    assert all(r.parent_drawer_id == long_[0].id and r.id == f"{long_[0].id}_chunk_{r.chunk_index:06d}" for r in long_[1:])
    short = [r for r in rows if r.text == "short"][0]
    assert short.embed_source == "short" and not short.is_parent and short.chunk_index is None


def test_store_versions_upserts_and_conflicts(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    schema = "id string, v int"
    assert s.read("t") is None
    first = spark.createDataFrame([("a", 1), ("b", 1)], schema)
    assert s.change("t", lambda _: first) == 1
    new = spark.createDataFrame([("b", 2), ("c", 2)], schema)
    for _ in range(2):
        s.change("t", lambda base: store.upsert(base, new, ["id"]))
        assert {tuple(r) for r in s.read("t").collect()} == {("a", 1), ("b", 2), ("c", 2)}
    raced = []

    def slow(base):
        if len(raced) < 1:
            raced.append(1)
            s.change("t", lambda b: b.unionByName(spark.createDataFrame([("d", 3)], schema)))
        return base.where("id <> 'a'")

    s.change("t", slow)
    assert {r.id for r in s.read("t").collect()} == {"b", "c", "d"}

    def always(base):
        s.change("t", lambda b: b)
        return base

    with pytest.raises(store.ConcurrentModificationError):
        s.change("t", always)
    assert threading.active_count() > 0


def test_store_writes_only_touched_buckets(spark, tmp_path):
    import os

    def written(s, name):
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, fs in os.walk(f"{tmp_path}/{name}/t/data") for f in fs if f.endswith(".parquet"))

    cost = {}
    for n in (2_000, 20_000):
        s = store.Store(spark, f"file://{tmp_path}/{n}", rows_per_bucket=500)
        key = F.col("id")
        s.change("t", lambda _: spark.range(n).select(F.concat(F.lit("k"), "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("v")), key)
        before = written(s, n)
        new = spark.createDataFrame([("k7", "new"), ("fresh", "new")], "id string, v string")
        s.change("t", lambda base: store.upsert(base, new, ["id"]), key, new)
        cost[n] = written(s, n) - before
        assert s.read("t").count() == n + 1 and {r.id for r in s.near("t", key, new).where("v = 'new'").collect()} == {"k7", "fresh"}
        with pytest.raises(ValueError):
            s.change("t", lambda base: base.unionByName(spark.range(50).select(F.concat(F.lit("x"), "id").alias("id"), F.lit("").alias("v"))), key, new)
        assert s.read("t").count() == n + 1
    assert cost[20_000] < 2 * cost[2_000]


def test_store_crash_reader_and_vacuum(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/s")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    s.change("t", lambda _: rows("a"), F.col("id"))
    opened = s.read("t")
    with monkeypatch.context() as m:
        m.setattr(s, "_commit", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            s.change("t", lambda base: base.unionByName(rows("lost")), F.col("id"))
    assert [r.id for r in s.read("t").collect()] == ["a"]
    assert s.change("t", lambda base: base.unionByName(rows("b")), F.col("id")) == 2
    assert [r.id for r in opened.collect()] == ["a"] and s.read("t").count() == 2
    assert s.change("t", lambda base: base.unionByName(rows("c")), F.col("id")) == 3
    assert s.vacuum("t", keep=1) >= 3 and s.read("t").count() == 3
    s.change("t", lambda base: base.limit(0), F.col("id"))
    assert s.read("t").count() == 0 and s.read("t").columns == ["id"]


def test_has_row_has_three_answers(spark, tmp_path):
    d = spark.createDataFrame([("a",)], "id string")
    assert store.has_row(lambda: d, F.col("id") == "a") is True
    assert store.has_row(lambda: d, F.col("id") == "b") is False and store.has_row(lambda: None, F.col("id") == "b") is False
    assert store.has_row(lambda: spark.read.parquet(f"file://{tmp_path}/none"), F.col("id") == "a") is None


def test_replace_and_delete_drop_old_chunks(spark):
    base = spark.createDataFrame([("p", None), ("p_chunk_000000", "p"), ("p_chunk_000001", "p"), ("q", None)], "id string, parent_drawer_id string")
    new = spark.createDataFrame([("p", None), ("p_chunk_000000", "p")], "id string, parent_drawer_id string")
    assert sorted(r.id for r in store.replace_drawers(base, new).collect()) == ["p", "p_chunk_000000", "q"]
    gone = spark.createDataFrame([("p",)], "id string")
    assert [r.id for r in store.delete_drawers(base, gone).collect()] == ["q"]


FACTS = "id string, subject string, predicate string, object string, confidence float, valid_from timestamp_ntz, valid_to timestamp_ntz, current boolean"


def test_facts_as_of_and_closing(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    t = spark.createDataFrame([("1", "A", "p", "B", 1.0, t0, None, True), ("2", "A", "p", "A", 1.0, t0, None, True), ("3", "A", "q", "C", None, None, None, None)], FACTS)
    closed = graph.close_facts(t, str(t1), triple=("A", "p", "B"))
    assert graph.facts_about(closed, "A", "outgoing").count() == 1
    assert graph.facts_about(closed, "A", "outgoing", str(t0)).count() == 3
    assert graph.facts_about(t, "A", "both", str(t0)).where("id = '2'").count() == 2
    assert graph.facts_about(t, "B", "incoming").count() == 1
    assert census.fact_stats(t).first()[:] == (3, 3, 2, 0)
    for bad in ({}, {"fact_id": "1", "triple": ("A", "p", "B")}, {"triple": ("A", "p", None)}):
        with pytest.raises(ValueError):
            graph.close_facts(t, str(t1), **bad)
    with pytest.raises(ValueError):
        graph.facts_about(t, "A", "sideways")


DRAWER = "id string, wing string, room string, title string, text string, parent_drawer_id string"


def test_rooms_and_tunnels(spark):
    d = spark.createDataFrame([("1", "a", "x", "", "one", None), ("2", "b", "x", "", "two", None), ("3", "a", "y", "", "three", None), ("4", "c", "z", "", "four", None)], DRAWER)
    assert [(r.room, r.wings) for r in census.shared_rooms(d).collect()] == [("x", ["a", "b"])]
    assert census.shared_rooms(d, "a", "c").count() == 0 and census.shared_rooms(d, "a").count() == 1
    assert [r.room for r in graph.rooms_one_hop(d, "x").collect()] == ["y"] and graph.rooms_one_hop(d, "z").count() == 0
    tunnels = spark.createDataFrame(
        [("t1", "a", "x", "1", "b", "x", "2", "l", "explicit"), ("t2", "a", "x", None, "a", "x", "", "loop", "explicit")],
        "id string, source_wing string, source_room string, source_drawer_id string, target_wing string, target_room string, target_drawer_id string, label string, kind string",
    )
    got = {(r.id, r.direction, r.wing, r.preview) for r in graph.follow_tunnels(tunnels, d, "a").collect()}
    assert got == {("t1", "outgoing", "b", "two"), ("t2", "outgoing", "a", "")}
    assert {(r.direction, r.preview) for r in graph.follow_tunnels(tunnels, d, "b").collect()} == {("incoming", "one")}


def test_bm25_of_empty_and_tiny_corpora(spark):
    none = bm25.build(spark.createDataFrame([], "unit string, cid string, body string"), keep=False)
    q = spark.createDataFrame([(0, "rare word")], "query_id int, query string")
    assert bm25.scores(none, q).count() == 0
    rows = [(f"u{i}", f"c{i // 2}", "common filler words here") for i in range(12)] + [("t", "t", "rare ab-1.2"), ("e", "e", ""), ("n", "n", None)]
    index = bm25.build(spark.createDataFrame(rows, "unit string, cid string, body string"), keep=False)
    assert [r.cid for r in bm25.scores(index, q).collect()] == ["t"]
    assert bm25.scores(index, spark.createDataFrame([(0, "ab-1.2")], "query_id int, query string")).first().cid == "t"
    assert bm25.scores(index, spark.createDataFrame([(0, ""), (1, None)], "query_id int, query string")).count() == 0


def test_status_counts_all_levels(spark):
    d = spark.createDataFrame([("1", "a", "x", "", "", None), ("2", "a", "y", "", "", "1"), ("3", None, "y", "", "", None)], DRAWER)
    got = {(r.level, r.name, r.n) for r in census.status(d).collect()}
    assert got == {("total", "", 3), ("wing", "a", 2), ("wing", None, 1), ("room", "x", 1), ("room", "y", 2)}
    assert census.status(d.where(F.lit(False))).where("level = 'total'").first().n == 0
