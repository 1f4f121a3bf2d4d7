"""References without record, attribute history and nested lines: edge cases and brute force."""

import datetime as dt
import json
import random

import pytest

from quillstone.operators import history, nested, orphans


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


# --- references ---------------------------------------------------------------------------------

REF = "ref_field string, row_key string, drawer_id string, ref_time timestamp_ntz"
FILED, GONE = "drawer_id string, filed_at timestamp_ntz", "drawer_id string, deleted_at timestamp_ntz"


def batch(spark, refs=(), filed=(), gone=()):
    return spark.createDataFrame(list(refs), REF), spark.createDataFrame(list(filed), FILED), spark.createDataFrame(list(gone), GONE)


def statuses(state):
    return {(r.row_key, r.drawer_id): r.status for r in state.references.collect()}


def test_reference_waits_resolves_and_reopens(spark):
    state = orphans.replay(spark, [batch(spark, refs=[("t", "k", "a", day(5))])])
    assert statuses(state) == {("k", "a"): "absent"}
    state = orphans.advance(state, *batch(spark, filed=[("a", day(9))]))
    assert statuses(state) == {("k", "a"): "late"}
    state = orphans.advance(state, *batch(spark, filed=[("a", day(1))]))
    assert statuses(state) == {("k", "a"): "resolved"}
    state = orphans.advance(state, *batch(spark, gone=[("a", day(20))]))
    assert statuses(state) == {("k", "a"): "removed"}
    state = orphans.advance(state, *batch(spark, filed=[("a", day(21))]))
    assert statuses(state) == {("k", "a"): "resolved"}


def test_null_and_empty_references_and_times(spark):
    refs = [("t", "k1", None, day(1)), ("t", "k2", "", day(1)), ("t", "k3", "a", None), ("t", "k4", "b", day(1)), ("t", "k4", "b", day(1))]
    state = orphans.replay(spark, [batch(spark, refs=refs, filed=[("a", day(3)), ("b", None), (None, day(1))])])
    assert statuses(state) == {("k3", "a"): "resolved", ("k4", "b"): "resolved"}


def test_any_cut_into_batches_ends_alike(spark):
    rng = random.Random(1)
    refs = [("t", f"k{i}", f"d{rng.randrange(12)}", rng.choice([None, day(rng.randrange(30))])) for i in range(60)]
    filed = [(f"d{rng.randrange(9)}", rng.choice([None, day(rng.randrange(30))])) for _ in range(20)]
    gone = [(f"d{rng.randrange(12)}", day(rng.randrange(30))) for _ in range(5)]
    whole = statuses(orphans.replay(spark, [batch(spark, refs, filed, gone)]))
    parts = [batch(spark, refs[:20], filed[10:], gone[:2]), batch(spark, refs[20:], [], []), batch(spark, [], filed[:10], gone[2:])]
    assert statuses(orphans.replay(spark, parts)) == whole


def test_empty_tables(spark):
    state = orphans.replay(spark, [batch(spark)])
    assert orphans.orphans(state).count() == 0 and orphans.snapshot_counts(state).count() == 0


def test_replay_store_takes_extra_columns_and_empty_drawers(spark):
    drawers = spark.createDataFrame([], "id string, parent_drawer_id string, filed_at timestamp_ntz, ref_field string, status string")
    tags = spark.createDataFrame([("x", "tag", day(1), "z")], "drawer_id string, tag string, created_at timestamp_ntz, row_key string")
    tunnels = spark.createDataFrame([("i", None, "", day(1))], "id string, source_drawer_id string, target_drawer_id string, created_at timestamp_ntz")
    gone = spark.createDataFrame([("x", day(2), None)], "drawer_id string, deleted_at timestamp_ntz, deleted_by string")
    state = orphans.replay_store(drawers, tags, tunnels, gone)
    assert [(r.ref_field, r.row_key, r.status) for r in orphans.orphans(state).collect()] == [("drawer_tags.drawer_id", "tag", "removed")]


# --- history ------------------------------------------------------------------------------------


def runs_of(units):
    """Plain loop over one entity's (object, start, end or None), sorted by start."""
    units = sorted(units, key=lambda u: u[1])
    out = []
    for k, (o, s, e) in enumerate(units):
        nxt = units[k + 1][1] if k + 1 < len(units) else None
        e = min([x for x in (e, nxt) if x is not None], default=None)
        if out and out[-1][0] == o and out[-1][2] == s:
            out[-1] = (o, out[-1][1], e)
        else:
            out.append((o, s, e))
    return {(o, s, -1 if e is None else e) for o, s, e in out}


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_tree_of_blocks_equals_a_loop(spark, block):
    rng = random.Random(block)
    units = []
    for k in range(6):
        starts = rng.sample(range(-50, 400), rng.randrange(1, 60))
        units += [(f"e{k}", rng.choice(["x", "y", None]), s, rng.choice([None, None, s + rng.randrange(1, 40)])) for s in starts]
    df = spark.createDataFrame(units, "k string, o string, s bigint, e bigint")
    got = {}
    for r in history.coalesce_history(df, ["k"], block).collect():
        got.setdefault(r.k, set()).add((r.object, r.start_s, r.end_s))
    want = {f"e{k}": runs_of([u[1:] for u in units if u[0] == f"e{k}"]) for k in range(6)}
    assert got == want


FACT = "id string, subject string, predicate string, object string, valid_from timestamp_ntz, valid_to timestamp_ntz, created_at timestamp_ntz, extra int"


def test_fact_history_picks_latest_and_skips_invalid(spark):
    rows = [
        ("1", "s", "p", "old", day(1), None, day(1), 0),
        ("2", "s", "p", "new", day(1), None, day(2), 0),
        ("3", "s", "p", "tie", day(1), None, day(2), 0),
        ("4", "s", "p", "bad", day(5), day(5), day(9), 0),
        ("5", "s", "p", "none", None, None, day(9), 0),
        ("6", "s", "p", "nocreated", day(1), None, None, 0),
        ("7", "s", "many", "m", day(1), None, day(1), 0),
        ("8", None, "p", None, day(3), None, day(1), 0),
    ]
    facts = spark.createDataFrame(rows + rows[:2], FACT)
    predicates = spark.createDataFrame([("p", True), ("many", False), ("unknown", None), (None, True)], "predicate string, single_valued boolean")
    got = {(r.subject, r.object, r.end_s) for r in history.fact_history(facts, predicates).collect()}
    assert got == {("s", "tie", -1), (None, None, -1)}


def test_history_of_nothing(spark):
    facts = spark.createDataFrame([], FACT)
    predicates = spark.createDataFrame([("p", True)], "predicate string, single_valued boolean")
    assert history.current_at(history.fact_history(facts, predicates)).count() == 0


# --- nested lines -------------------------------------------------------------------------------


def flat(o):
    """Plain recursion over a parsed line."""
    out = []

    def walk(items, at):
        for i, b in enumerate(items):
            path = f"{at}.{i}" if at else str(i)
            if isinstance(b, str):
                out.append((path, "text", ""))
            elif isinstance(b, dict):
                out.append((path, b.get("type") or "", b.get("id") or ""))
                c = b.get("content")
                walk(c if isinstance(c, list) else [c] if isinstance(c, dict) else [], path)

    m = o.get("message")
    c = m.get("content") if isinstance(m, dict) else None
    walk(c if isinstance(c, list) else [c] if isinstance(c, (dict, str)) else [], "")
    return set(out)


def nest(rng, depth):
    kind = rng.random()
    if kind < 0.2:
        return rng.choice(["text", None])
    b = {"type": rng.choice(["text", "tool_use", None]), "id": rng.choice(["a", None]), "x": {"content": [{"type": "no"}]}}
    if depth and rng.random() < 0.8:
        b["content"] = [nest(rng, depth - 1) for _ in range(rng.randrange(3))] if rng.random() < 0.7 else rng.choice([nest(rng, depth - 1), "string", 7])
    return b


LINE = "record_id bigint, file_name string, line_no int, raw string, doc string"


def test_blocks_of_any_depth(spark):
    rng = random.Random(5)
    docs = [{"message": {"content": [nest(rng, 9) for _ in range(3)]}} for _ in range(40)]
    docs += [{"message": {"content": c}} for c in ("plain", {"type": "t"}, None, 3, [])] + [{"message": None}, {}]
    lines = spark.createDataFrame([(i, "f", i, json.dumps(d), None) for i, d in enumerate(docs)], LINE)
    got = {}
    for r in nested.blocks(nested.parse_lines(lines.drop("doc"))).collect():
        got.setdefault(r.record_id, set()).add((r.block_path, r.block_type, r.block_id))
        assert r.parent_path == r.block_path.rpartition(".")[0]
    assert got == {i: f for i, d in enumerate(docs) if (f := flat(d))}


@pytest.mark.parametrize(
    "raw, good",
    [('{"a":1}', True), (' {"a":1} ', True), ('{"a":1} x', False), ('{"a":1}{"b":1}', False), ('{"a":1},{"b":1}', False), ('{"a":1}]', False), ('{"a":1}}', False), ('{"a":1}] , [{"b":1}', False),
     ('{"a":1,"a":2}', True), ("[1]", False), ("", False), (None, False), ('{"a"', False), ("null", False), ('"s"', False)],
)
def test_only_one_complete_object_is_a_line(spark, raw, good):
    lines = spark.createDataFrame([(1, "f", 1, raw, "clash")], LINE)
    assert (nested.parse_lines(lines.drop("doc")).count() == 1) is good


def test_no_lines(spark):
    parsed = nested.parse_lines(spark.createDataFrame([], LINE).drop("doc"))
    assert nested.blocks(parsed).count() == 0 and nested.records(parsed).count() == 0
