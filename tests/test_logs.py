"""Transcript, search, metric and sweep operators on small fixtures and against brute force."""

import datetime as dt
import json
import random
import tracemalloc
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.operators import bm25, evaluate, lanes, mining, nested, search, sweep, transcripts
from quillstone.plans import retrieval as retrieval_plans


def session_lines(spark, sessions):
    """sessions: name -> list of (role, text or blocks[, extra members])."""
    rows = []
    for name, turns in sessions.items():
        for n, (role, content, *more) in enumerate(turns, 1):
            rec = {"type": role, "sessionId": name, "message": {"role": role, "content": content}} | (more[0] if more else {})
            rows.append((len(rows), name, n, json.dumps(rec)))
    return nested.parse_lines(spark.createDataFrame(rows, "record_id bigint, file_name string, line_no int, raw string"))


TOOL = [{"type": "text", "text": "working"}, {"type": "tool_use", "id": "u", "name": "Read", "input": {}}]


def tools(n, text="working"):
    return [("assistant", [{"type": "text", "text": text}, *TOOL[1:]]) for _ in range(n)]


def test_struggle_signals(spark):
    topic = "the parser of the archive reads blocks and writes pages to the cold store"
    other = "please prepare ten quiet slides about garden birds feeding habits during winter months instead"
    sessions = {
        "s1": [*tools(5), ("user", "no wait")],
        "s2": [("user", "you should have asked")],
        "s3": [*tools(4), ("user", "stop, that's wrong"), ("assistant", "you're right, apologies")],
        "s4": [*tools(8), ("user", "hm, let me back up and look at the cache first")],
        "s5": [*[("assistant", topic) for _ in range(22)], ("user", other)],
        "c1": [*tools(4), ("user", "yes, good")],
        "c2": [*tools(4), ("user", "no wait", {"isMeta": True})],
        "c3": [*tools(4), ("user", "no wait", {"isSidechain": True})],
        "c4": [*tools(4), ("user", "<tag> stop")],
        "c5": [*[("assistant", topic) for _ in range(22)], ("user", topic + " again and again with more detail")],
        "c6": [*tools(4), ("user", "the first stop on the list")],
        "c7": [*tools(4), ("user", "But we can go on")],
        "c8": [*tools(4), ("user", "I don't mind")],
        "c9": [*[("assistant", topic) for _ in range(22)], ("user", "yes")],
        "c10": [*tools(2), ("user", "no wait")],
    }
    got = {r.file_name: (r.signal_class, r.upgrade_weight) for r in transcripts.signals(transcripts.events(session_lines(spark, sessions))).collect()}
    assert got == {"s1": ("A_steering", 0), "s2": ("A_diagnostic", 0), "s3": ("A_diagnostic", 1), "s4": ("B_reversion", 0), "s5": ("B_abandon", 0)}


def usage_line(r, c, o):
    return ("assistant", [], {"message": {"role": "assistant", "usage": {"cache_read_input_tokens": r, "cache_creation_input_tokens": c, "output_tokens": o}}})


def test_stage_spend(spark):
    sessions = {
        "test-author": [usage_line(7000, 23000, 5), usage_line(20000, 800, 100), usage_line(40000, 500, 200)],
        "implementer": [usage_line(8000, 22000, 10), usage_line(90000, 1000, 800)],
        "verify": [usage_line(8000, 20000, 300)],
        "twice": [usage_line(1, 2, 3), usage_line(1, 2, 3)],
        "none": [("user", "hello")],
    }
    use = transcripts.usage(session_lines(spark, sessions))
    got = {r.file_name: (r.gross, r.net) for r in transcripts.spend(use, 10_000).collect()}
    assert got == {"test-author": (40705, 30705), "implementer": (91810, 81810), "verify": (28300, 18300), "twice": (6, -9994)}
    tiers = {r.file_name: r.tier for r in transcripts.context_tiers(use, 28_000, 90_000).collect()}
    assert tiers == {"test-author": "yellow", "implementer": "red", "verify": "green", "twice": "green"}


def result(key, text):
    return ("user", [{"type": "tool_result", "tool_use_id": key, "content": text}])


def call(key, name, **given):
    return ("assistant", [{"type": "tool_use", "id": key, "name": name, "input": given}])


def test_last_failure_latch(spark):
    fail, fine = "2 tests failed", "all good, 0 failed"
    sessions = {
        "fail": [call("a", "Bash"), result("a", fail)],
        "edited": [call("a", "Bash"), result("a", [{"type": "text", "text": fail}]), call("b", "Edit", file_path="x/tests/t.py")],
        "source": [call("a", "Bash"), result("a", fail), call("b", "Edit", file_path="x/src/t.py")],
        "fixed": [call("a", "Bash"), result("a", fail), call("b", "Bash"), result("b", fine)],
        "other": [call("a", "Read"), result("a", fail)],
        "conflict": [call("a", "Bash"), result("a", fail + "\nAutomatic merge failed; fix conflicts")],
        "before": [result("a", fail), call("a", "Bash")],
    }
    got = {r.file_name: (r.failed, r.tests_edited) for r in transcripts.last_failures(transcripts.top_blocks(session_lines(spark, sessions))).collect()}
    assert got == {"fail": (True, False), "edited": (True, True), "source": (True, False), "fixed": (False, False), "conflict": (False, False)}


@pytest.mark.parametrize(
    "report, payloads",
    [
        ("claim one [run x -> ok] and two [INFERRED]", ["run x -> ok", "INFERRED"]),
        ("evidence: a.py:3", ["a.py:3"]),
        ("no evidence: here", []),
        ("```\n[quoted]\n```\n[`real`]", ["real"]),
        ("# head [x]\n", []),
        ("", []),
        (None, []),
    ],
)
def test_evidence_slots(report, payloads):
    assert [p for _, p, _, _ in transcripts.evidence(report)] == payloads


@pytest.mark.parametrize("payload, want", [("a -> b", ["a"]), ("a → b", ["a"]), ("grep -c ' -> ' f -> 3", ["grep -c ' -> ' f"]), ("file.py:3", []), ("echo ' -> x", ["echo '"]), ("a -> b -> c", ["a", "a -> b"])])
def test_cited_commands(payload, want):
    assert transcripts.commands_cited(payload) == want


def test_provenance_verdicts(spark):
    say = lambda text: ("assistant", [{"type": "text", "text": text}])
    sessions = {
        "none": [say("done")],
        "absent": [call("a", "Bash", command="ls"), say("it works [make test -> ok]")],
        "held": [call("a", "Bash", command="cd x && make test | tail"), say("early"), say("it works [`make test` -> ok]\nand more [INFERRED]")],
    }
    got = {r.file_name: (r.verdict, r.n_inferred) for r in transcripts.provenance(transcripts.top_blocks(session_lines(spark, sessions))).collect()}
    assert got == {"none": ("F1", 0), "absent": ("F2", 0), "held": ("OK", 1)}


def test_commit_scores(spark):
    rows = [
        ("wip: x", "", "schema.sql"), ("bump deps and more words", "because", "config.yml"), ("Revert something here", "", ""), ("fix typo here", "", ""),
        ("Add table for users", "We chose this rather than the other because of size and speed", "db/schema.sql"), ("x", None, None),
    ]
    got = [r.s for r in spark.createDataFrame(rows, "subject string, body string, files string").select(mining.commit_score().alias("s")).collect()]
    assert got == [0, 0, 0, 0, 5, 0]


def test_metrics(spark):
    rows = [("bug", ["a", "b"], ["a"]), ("bug", ["x", "y", "z", "b"], ["b"]), ("", ["q"], ["n"]), (None, [], [])]
    m = {r.kind: (r.n, round(r.recall, 6), round(r.mrr, 6)) for r in evaluate.metrics(spark.createDataFrame(rows, "kind string, found array<string>, relevant array<string>"), 3).collect()}
    assert m == {"bug": (2, 0.5, 0.625), "unspecified": (2, 0.0, 0.0), "all": (4, 0.25, 0.3125)}
    assert evaluate.accepted((0.5, 0.4), (0.6, 0.4)) and not evaluate.accepted((0.5, 0.4), (0.5, 0.5)) and not evaluate.accepted((0.5, 0.4), (0.6, 0.3))


def test_known_items(spark):
    queries = spark.createDataFrame([(1, "The Title!"), (2, "see d2 please"), (3, "symptom only"), (4, "!!")], "query_id int, query string")
    relevant = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, "d1"), (3, "gone"), (4, "d1")], "query_id int, id string")
    corpus = spark.createDataFrame([("d1", "the title"), ("d2", None)], "id string, title string")
    assert {r.query_id: r.known for r in evaluate.known_items(queries, relevant, corpus).collect()} == {1: True, 2: True, 3: False, 4: True}


VECTOR_ROW = "id string, wing string, room string, title string, text string, embedding array<float>, filed_at timestamp_ntz, chunk_index int, parent_drawer_id string"


def stored(spark, rows):
    base = {"wing": "w", "room": "r", "title": "", "text": "", "embedding": [1.0, 0.0], "filed_at": None, "chunk_index": None, "parent_drawer_id": None}
    return spark.createDataFrame([tuple((base | r).get(k.split()[0]) for k in VECTOR_ROW.split(", ")) for r in rows], VECTOR_ROW)


def test_hybrid_search_finds_the_identifier(spark):
    rows = [{"id": f"d{i}", "text": f"filler about nothing in particular {chr(97 + i) * 3}", "embedding": [1.0, i / 100]} for i in range(12)]
    rows.append({"id": "t", "text": "unrelated prose naming ab-9.1 once", "embedding": [0.9, 0.5]})
    d = stored(spark, rows)
    got = search.hybrid_search(d, bm25.build(bm25.units(d), keep=False, clustered=True), "ab-9.1", [1.0, 0.0], 3).orderBy("rank").collect()
    assert got[0].id == "t" and len(got) == 3


@pytest.mark.parametrize("best, want", [(5, [4, 5, 6]), (0, [0, 1]), (9, [8, 9])])
def test_stitch(spark, best, want):
    rows = [{"id": "p", "text": "whole", "embedding": [0.0, 9.0]}]
    rows += [{"id": f"p{i}", "text": f"m{i}", "chunk_index": i, "parent_drawer_id": "p", "embedding": [1.0, float(abs(i - best))]} for i in range(10)]
    d = stored(spark, rows)
    got = search.hydrate(["p"], d, [1.0, 0.0]).first()
    assert got.snippet == "\n\n".join(f"m{i}" for i in want) and got.distance == 0.0


def test_search_of_an_empty_store_and_bad_vectors(spark):
    d = stored(spark, [{"id": "a", "embedding": None}, {"id": "b", "embedding": [1.0]}, {"id": "c", "embedding": [float("nan"), 0.0]}])
    for rows in (d, d.where(F.lit(False))):
        assert search.vector_lane(rows, [1.0, 0.0], 5).count() == 0 and search.check_duplicate(rows, [1.0, 0.0]).count() == 0
        assert search.hybrid_search(rows, bm25.build(bm25.units(rows), keep=False, clustered=True), "x", [1.0, 0.0]).count() == 0


def brute_hybrid(rows, index, queries, limit):
    """{query_id: best cids} by scoring every pair: (id, cid, vector, logical) rows, scores of all hits from bm25.scores()."""
    scored = {}
    for r in bm25.scores(index, queries.select("query_id", "query")).collect():
        scored.setdefault(r.query_id, {})[r.cid] = round(r.score, 9)
    logical, out = {r[0] for r in rows if r[3]}, {}
    for q in queries.collect():
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(r[2], q.embedding)), 9), r[0], r[1]) for r in rows)[: limit * 10]
        fused = {}
        for lane in (list(dict.fromkeys(x[2] for x in near)), sorted((c for c in scored.get(q.query_id, {}) if c in logical), key=lambda c: (-scored[q.query_id][c], c))):
            for at, c in enumerate(lane, 1):
                fused[c] = fused.get(c, 0) + 1 / (60 + at)
        out[q.query_id] = sorted(fused, key=lambda c: (-round(fused[c], 12), c))[:limit]
    return out


def test_batches_send_no_row_a_hit_and_lose_no_target(spark, monkeypatch):
    """Ranks of many queries equal brute force, though no hit of a query is written; queries that are passed over find nothing."""
    rng = np.random.default_rng(1)
    words = ["ab-9.1", "ab", "Kelvin K", "x_y.z", "the", "gate", "the the", "\u0130d"]
    rows = []
    for i in range(150):
        v = rng.normal(size=4).round(3).tolist()
        chunks = [{"id": f"d{i:03}c{k}", "chunk_index": k, "parent_drawer_id": f"d{i:03}", "text": " ".join(rng.choice(words, 3)), "embedding": rng.normal(size=4).round(3).tolist()} for k in range(i % 3)]
        rows += [{"id": f"d{i:03}", "title": str(rng.choice(words)), "text": " ".join(rng.choice(words, int(rng.integers(0, 4)))), "embedding": v}, *chunks]
    d = stored(spark, [*rows, rows[0], {"id": "gone_1", "parent_drawer_id": "gone", "text": "the gate", "embedding": [0.1] * 4}]).cache()
    old, new = bm25.build(bm25.units(d), keep=False, clustered=True), bm25.documents(d)
    known = lambda terms: {r.token: (r.df, round(r.avgdl, 9), round(r.idf, 9)) for r in terms.collect()}
    assert known(old.terms) == known(new.terms)
    queries = d.where("id like 'd%' and parent_drawer_id is null").dropDuplicates(["id"]).select(F.col("id").alias("query_id"), F.concat_ws(" ", "title", F.lit("gate")).alias("query"), "embedding")
    flat = {r.id: (r.id, r.parent_drawer_id or r.id, [float(x) for x in r.embedding], r.parent_drawer_id is None) for r in d.collect()}
    want = brute_hybrid(list(flat.values()), old, queries, 2)
    # Every hit of every query as a row is what once filled the disk.
    monkeypatch.setattr(bm25, "scores", lambda *_: pytest.fail("a row per query and hit"))
    got = {}
    for r in search.hybrid_batch(d, new, queries, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.cid)
    assert got == want
    vectors = search.canonical(d).dropDuplicates(["id"]).select("id", "cid", "embedding")
    ask = lambda step: queries.withColumn("target", F.format_string("d%03d", F.pmod(F.substring("query_id", 2, 3).cast("int") * step + 1, F.lit(150))))
    for step in (1, 7, 31):
        asked = ask(step)
        kept = {r.query_id for r in lanes.reachable(new, vectors, asked, 2, 20, at_once=50).collect()}
        found = {r.query_id for r in asked.collect() if r.target in want[r.query_id]}
        assert found <= kept and len(kept) < 150


def test_keyword_places_sends_no_more_with_more_batches(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = lambda: " ".join(f"w{w}" for w in rng.integers(0, 12, 6))
    d = spark.createDataFrame([(f"d{k:03d}", None, "", words()) for k in range(120)], "id string, parent_drawer_id string, title string, text string").repartition(4)
    queries = spark.createDataFrame([(f"q{k}", words()) for k in range(9)], "query_id string, query string")
    wanted = spark.createDataFrame([(f"q{k}", f"d{j:03d}") for k in range(9) for j in (k, 100)], "query_id string, cid string")
    scores = {}
    for r in bm25.scores(bm25.build(bm25.units(d)), queries).collect():
        scores.setdefault(r.query_id, []).append((-round(r.score, 9), r.cid))
    want = {(q, c, k) for q, rows in scores.items() for k, (_, c) in enumerate(sorted(rows), 1) if k <= 2 or c in (f"d{int(q[1:]):03d}", "d100")}
    index, sizes = bm25.documents(d), []
    monkeypatch.setattr(lanes, "_logical", partial(lanes._logical, rows=5))
    for name in ("collect", "toArrow"):
        monkeypatch.setattr(type(d), name, lambda self, f=getattr(type(d), name): (x := f(self), sizes.append(len(x)))[0])
    places = lanes.keyword_places(index, queries, wanted, 2, 9, at_once=5)
    monkeypatch.undo()
    assert {tuple(r) for r in places.collect()} == want
    # Two leading and two wanted of each query at most; not the leading ones of each batch.
    assert max(sizes) <= 9 * (2 + 2)


def test_tag_filter_twice_matches_nothing(spark):
    tags = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")], "drawer_id string, tag string")
    assert [r.id for r in search.tagged(tags, ["x", "y"]).collect()] == ["a"]
    assert search.tagged(tags, ["x", "x"]).count() == 0


def test_knn_batch_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (120, 4)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [1.0]), (202, [float("nan")] * 4)]
    base = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    q = base.where("id % 20 = 0 and id < 200").select(F.col("id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.id for r in search.knn_batch(base, q, 5, at_once=2).collect()}
    want = {(i, r): j for i in range(0, 120, 20) for r, j in enumerate(sorted(range(120), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:5], 1)}
    assert got == want
    assert search.knn_batch(base, q.where("query_id < 0"), 5).count() == 0
    assert [r.id for r in search.knn_one(base, x[20].tolist(), 5).collect()] == [want[20, r] for r in range(1, 6)]


def test_knn_batch_holds_few_distances_at_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (4000, 4)).astype(float)
    rows = pd.DataFrame({"id": np.arange(4000), "embedding": list(x)})
    base = spark.createDataFrame([], "id bigint, embedding array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(1500)], "query_id bigint, embedding array<double>")
    tasks = []
    monkeypatch.setattr(type(base), "mapInPandas", lambda self, f, schema: tasks.append(f) or self.sparkSession.createDataFrame([], schema))
    search.knn_batch(base, q, 3)
    tracemalloc.start()
    got = pd.concat(tasks[0](rows.iloc[k : k + 2000] for k in (0, 2000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All distances of a batch are 24 MB, and were there some three times.
    assert peak < 24e6
    for i in range(0, 1500, 100):
        assert got[got["query_id"] == i]["id"].tolist() == sorted(range(4000), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:3]


def greedy_sweep(rows, protected, threshold=0.08):
    """Plain loop: longest first, nearest kept that matches."""
    import re

    def tokens(t):
        return set(re.findall(r"[a-z0-9][a-z0-9._-]*", (t or "").lower()))

    def lead(t):
        w = (t or "").lstrip("# ").split()
        return w[0].lower() if w and re.match(r"^[a-z][a-z0-9]*-[a-z0-9][a-z0-9.]*$", w[0].lower()) else None

    def match(a, b):
        x, y = tokens(a["title"]), tokens(b["title"])
        return (len(x & y) / len(x | y) if x | y else 1.0) >= 0.8 or (lead(a["title"]) is not None and lead(a["title"]) == lead(b["title"]))

    gone, kept = {}, []
    for r in sorted(rows, key=lambda r: (-len(r["text"]), r["id"])):
        v = np.array(r["embedding"])
        near = []
        for k in kept:
            u = np.array(k["embedding"])
            d = 1 - v @ u / np.linalg.norm(v) / np.linalg.norm(u)
            if (k["wing"], k["room"]) == (r["wing"], r["room"]) and d <= threshold and match(r, k):
                near.append((d, k["id"]))
        if near and r["id"] not in protected:
            gone[r["id"]] = min(near)[1]
        else:
            kept.append(r)
    return gone


def test_sweep_equals_greedy_loop(spark, monkeypatch):
    monkeypatch.setattr(sweep, "BLOCK_ROWS", 7)
    rng = random.Random(3)
    titles = ["", None, "# ab-1 alpha beta gamma delta epsilon", "ab-1 other words", "alpha beta gamma delta epsilon", "alpha beta gamma delta zeta", "alpha beta gamma delta"]
    rows = []
    for i in range(150):
        a = rng.random() * 1.2
        rows.append({"id": f"d{i:03d}", "wing": rng.choice("ab"), "room": "r", "title": rng.choice(titles), "text": "x" * rng.randrange(40), "embedding": [float(np.cos(a)), float(np.sin(a))]})
    protected = {f"d{i:03d}" for i in range(0, 150, 11)}
    want = greedy_sweep(rows, protected)
    df = stored(spark, rows + rows[:5])
    got = {r.id: r.canonical_id for r in sweep.near_duplicates(df, spark.createDataFrame([(p,) for p in protected], "id string"), dim=2).collect()}
    assert got == want and len(want) > 10


def test_sweep_of_many_equal_vectors(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        a = rng.choice([0.0, 0.0, 0.0, 0.1, 0.2, 0.9])
        rows.append({"id": f"d{i:03d}", "wing": "a", "room": "r", "title": rng.choice(["", "", "alpha beta", "alpha beta gamma", "ab-1 x"]), "text": "x" * rng.randrange(5), "embedding": [float(np.cos(a)), float(np.sin(a))]})
    rows += [{"id": f"z{i}", "wing": "a", "room": "r", "title": "", "text": "", "embedding": [0.0, 0.0]} for i in range(3)]
    protected = {f"d{i:03d}" for i in range(0, 120, 17)}
    want = greedy_sweep([r for r in rows if any(r["embedding"])], protected)
    got = {r.id: r.canonical_id for r in sweep.near_duplicates(stored(spark, rows), spark.createDataFrame([(p,) for p in protected], "id string"), dim=2).collect()}
    # Among equally near ones the plain loop takes the least id, the sweep the longest.
    by = {r["id"]: r for r in rows}
    gap = lambda i, c: round(1 - float(np.dot(by[i]["embedding"], by[c]["embedding"])), 6)
    assert got.keys() == want.keys() and len(want) > 60 and not protected & got.keys()
    assert all(gap(i, got[i]) == gap(i, want[i]) and got[i] not in got for i in got)


def test_dependent_items_are_in_other_waves(spark):
    rows = [(0, "a", ["x"], []), (1, "b", ["y"], ["a", "gone"]), (2, "c", ["z"], []), (3, "d", ["w"], ["d"]), (4, "e", ["x"], []), (0, "f", ["v"], ["e", None])]
    items = spark.createDataFrame(rows, "o int, id string, paths array<string>, deps array<string>")
    assert {tuple(r) for r in sweep.dep_edges(items, "o").collect()} == {("a", "b"), ("f", "e")}
    got = {r.id: r.wave for r in sweep.waves(items, sweep.incompatible(items, "o")).collect()}
    assert got == {"a": 1, "b": 2, "c": 1, "d": 1, "e": 2, "f": 1}
    assert {tuple(r) for r in sweep.incompatible(items.drop("deps"), "o").collect()} == {("a", "e")}


def test_seam_scan_admits_documents_without_paths(spark, tmp_path):
    rows = [(1, "see src/a.py"), (2, "no file here"), (3, "src/a.py and src/b.py"), (4, None), (5, "src/b.py"), (6, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.id for r in retrieval_plans.seam_scan(spark, str(tmp_path)).collect()) == [1, 2, 4, 5, 6]
    assert sorted(tuple(r) for r in retrieval_plans.wave_schedule(spark, str(tmp_path)).collect()) == [(1, 1), (3, 2), (5, 1)]


@pytest.mark.parametrize("most", [4_000_000, 12, 1])
def test_first_fit_equals_a_loop_however_it_is_decided(spark, most):
    rng = random.Random(5)
    # Two components and single items; ties of order go by id; a dependency is one more conflict.
    items = [(f"i{i:02d}", i // 2, [f"p{rng.randrange(6) + 6 * (i % 2)}" for _ in range(rng.randrange(0, 3))], ["i03"] if i == 9 else []) for i in range(36)]
    ordered = sorted(items, key=lambda x: (x[1], x[0]))
    claimed = {i: set(paths) | ({"dep"} if i in ("i03", "i09") else set()) for i, _, paths, _ in items}
    wave: dict = {}
    for i, *_ in ordered:
        used = {wave[j] for j in wave if claimed[i] & claimed[j]}
        wave[i] = next(w for w in range(1, 99) if w not in used)
    chosen: list = []
    for i, *_ in ordered:
        if not any(claimed[i] & claimed[j] for j in chosen):
            chosen.append(i)
    df = spark.createDataFrame(items, "id string, o int, paths array<string>, deps array<string>")
    c = sweep.claims(df, "o")
    have = {i for i in claimed if claimed[i]}
    assert {r.id: r.wave for r in sweep.first_fit(c, most=most).collect()} == {i: w for i, w in wave.items() if i in have}
    assert {r.id for r in sweep.first_fit(c, waves=False, most=most).where("wave = 1").collect()} == set(chosen) & have
    assert sweep.first_fit(c.where("o < 0"), most=0).count() == 0


def test_waves_equal_first_fit(spark):
    rng = random.Random(4)
    items = [(i, i, [f"p{rng.randrange(12)}" for _ in range(rng.randrange(1, 4))]) for i in range(40)]
    waves: list[list] = []
    for i, _, paths in items:
        for w in waves:
            if all(not set(paths) & set(items[j][2]) for j in w):
                w.append(i)
                break
        else:
            waves.append([i])
    df = spark.createDataFrame(items, "id int, o int, paths array<string>")
    got = {r.id: r.wave for r in sweep.waves(df, sweep.path_conflicts(df, "o")).collect()}
    assert got == {i: n for n, w in enumerate(waves, 1) for i in w}
    none = df.where("id < 0")
    assert sweep.waves(none, sweep.path_conflicts(none, "o")).count() == 0
