"""The operators of quillstone.llm against brute force, with null, empty, long, tied and repeated rows."""

import collections
import random
import time

import numpy as np
import pytest

from quillstone.llm import abuse, leakage, mixing, neardup, splitting, vectors, words

# --- near duplicates ----------------------------------------------------------------------------


def similar_pairs(rows, t, k, least):
    sets = {}
    for i, body in rows:
        ws = words.words(body)
        if i is not None and body is not None and len(ws) >= max(least, k):
            sets[i] = set(zip(*(ws[j:] for j in range(k))))
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n):
        at = rng.randrange(len(ws))
        ws[at : at + rng.randrange(2)] = [f"new{rng.randrange(99)}"] * rng.randrange(1, 3)
    return ws


@pytest.mark.parametrize("t, k, least", [(0.5, 3, 20), (0.8, 5, 0)])
def test_near_duplicates_equal_brute_force(spark, t, k, least):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "naïve", "任务"]
    rows = []
    for d in range(40):
        ws = [rng.choice(vocabulary) for _ in range(rng.choice([3, 19, 20, 25, 80, 300]))]
        rows += [(f"{d}-{v}", " ".join(edited(rng, ws, v * rng.choice([1, 3]))) if v else " ".join(ws)) for v in range(5)]
    rows += [("copy1", rows[3][1]), ("copy2", rows[3][1].upper()), ("null", None), ("empty", ""), (None, rows[3][1]), ("same", "a " * 50), ("same2", "a " * 70), ("long", "x y z " * 20000)]
    df = spark.createDataFrame([(i, b, "clash", 1) for i, b in rows + rows[:9]], "id string, body string, rep string, n int").repartition(5)
    found = neardup.near_duplicates(df, t, k, least, bits=14)
    assert {tuple(r) for r in found.expanded().collect()} == similar_pairs(rows, t, k, least)
    groups = {r.id: r for r in found.groups().collect()}
    for a, b in similar_pairs(rows, t, k, least):
        assert groups[a].group_id == groups[b].group_id


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "id string, body string")
    found = neardup.near_duplicates(none, bits=10)
    assert found.expanded().count() == 0 and found.groups().count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(0, 90)] + [("x", "y"), ("y", "x")]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"{i:03d}": "000" for i in range(91)}, "x": "x", "y": "x"}


# --- nearest vectors ----------------------------------------------------------------------------


def nearest_brute(rows, k, least):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(x @ x.T, 10)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-c[a, b], ids[b]))[:k]
        out[i] = [ids[b] for b in order if c[a, b] >= least]
    return {i: n for i, n in out.items() if n}


@pytest.mark.parametrize("leaf_rows", [10_000, 40])
def test_nearest_vectors(spark, leaf_rows):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((25, 16))
    rows = {f"v{i:03d}": (centres[i % 25] + 0.15 * rng.standard_normal(16)).tolist() for i in range(240)}
    rows |= {f"same{i:02d}": [1.0] * 16 for i in range(12)} | {f"long{i}": [float(i + 2)] * 16 for i in range(2)}
    table = list(rows.items()) + list(rows.items())[:20]
    table += [("null", None), ("short", [1.0]), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16), ("inf", [float("inf")] + [1.0] * 15), (None, [1.0] * 16), ("hole", [None] + [1.0] * 15)]
    df = spark.createDataFrame([(i, v, "x") for i, v in table], "id string, embedding array<float>, cls string").repartition(3)
    got = collections.defaultdict(dict)
    for r in vectors.nearest(df, 5, 0.85, dim=16, m=8, leaf_rows=leaf_rows).collect():
        got[r.id][r["rank"]] = r.neighbour
    want = nearest_brute(rows, 5, 0.85)
    pairs = {(i, j) for i, n in want.items() for j in n}
    found = {(i, j) for i, n in got.items() for j in n.values()}
    assert len(found & pairs) / len(pairs) >= 0.97
    assert all([got[i][r] for r in sorted(got[i])] == want[i] for i in rows if i.startswith(("same", "long")))


def test_nearest_without_vectors(spark):
    none = spark.createDataFrame([], "id string, embedding array<float>")
    assert vectors.nearest(none, dim=4, m=2).count() == 0
    assert vectors.nearest(spark.createDataFrame([("a", [1.0, 0.0])], "id string, embedding array<float>"), dim=2, m=2).count() == 0


def test_chi_square_quantile():
    assert abs(vectors.chi2_quantile(0.95, 10) - 18.307) < 1e-3 and abs(vectors.chi2_quantile(0.99, 20) - 37.566) < 1e-3


# --- splitting ----------------------------------------------------------------------------------


def texts():
    rng = random.Random(2)
    sentence = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rng.randrange(3, 15))) + rng.choice(".!?")
    yield from ("", "short", "x" * 800, "x" * 801, "x" * 5000, "a\r\n" * 900, "é" * 3000, "词。" * 700, "👍🏽" * 900, " " * 2000, "\n\n" * 900, "word " * 400)
    for sep in (" ", "\n", "\n\n", "\r\n\r\n"):
        yield sep.join(sentence() for _ in range(120))
    yield "# code\n```\n" + "\n".join("x = call(%d)" % i for i in range(200)) + "\n```\n" + "tail " * 100


@pytest.mark.parametrize("limit, overlap", [(800, 80), (100, 0), (50, 20)])
def test_pieces_cover_overlap_and_stay_small(limit, overlap):
    for text in texts():
        pieces = splitting.split(text, limit, overlap)
        if not text:
            assert pieces == []
            continue
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for s, e in pieces:
            assert 0 < e - s <= limit
        for (s0, e0), (s1, e1) in zip(pieces, pieces[1:]):
            assert s0 < s1 <= e0 < e1 and e0 - s1 <= overlap * 1.5
        assert pieces[0][1] == len(text) or len(text) > limit


def test_cut_falls_in_the_valley():
    a = " ".join(["Cats purr softly while kittens nap near warm stoves."] * 6)
    b = " ".join(["Rockets burn liquid fuel and climb beyond heavy air."] * 6)
    text = a + " " + b
    assert abs(splitting.split(text, 500, 40)[0][1] - len(a)) <= 1


def test_no_cut_inside_a_line_end_or_before_a_mark():
    for text in ("a" * 79 + "\r\n" + "b" * 200, "é" * 300):
        for s, e in splitting.split(text, 80, 10):
            assert text[e - 1 : e + 1] != "\r\n" and text[e : e + 1] != "́"


@pytest.mark.parametrize("text", ["x\n" * 50_000, "." * 100_000 + "x", "one two. " * 20_000, "a" * 300_000, "a b " * 50_000, "a1" * 100_000, "\r\n" * 50_000, "a#" * 50_000])
def test_very_long_texts_take_linear_time(text):
    began = time.process_time()
    pieces = splitting.split(text)
    assert pieces[-1][1] == len(text) and isinstance(abuse.passages(text), list) and isinstance(words.words(text), list)
    assert time.process_time() - began < 10


def test_overlap_must_fit():
    with pytest.raises(ValueError):
        splitting.split("x" * 100, 50, 25)


DRAWER = "id string, text string, chunk_index int, parent_drawer_id string, overlap int"


def test_resplit_finds_what_is_not_covered(spark):
    long_ = "abc def. " * 200

    def chunks(parent, parts):
        return [(f"{parent}{i}", t, i, parent, None) for i, t in parts]

    cut = [(i, long_[i * 900 : (i + 1) * 900]) for i in range(2)]
    rows = [(n, long_, None, None, 0) for n in ("good", "none", "gap", "twice", "stale", "renumbered", "nullindex", "doubled")] + [("short", "x", 5, "", 0), ("null", None, None, None, 0)]
    rows += chunks("good", cut) + chunks("good", cut) + chunks("good", [])
    rows += chunks("gap", cut[:1]) + chunks("twice", [*cut, (1, "other")]) + chunks("stale", [(0, long_[:900]), (1, "z" * 900)]) + chunks("renumbered", [(1, cut[0][1]), (2, cut[1][1])])
    rows += chunks("nullindex", cut) + [("n", "", None, "nullindex", 0)] + [("good", long_, None, None, 1)] + chunks("doubled", [(0, long_), (1, "")])
    df = spark.createDataFrame(rows, DRAWER)
    got = {r.parent_drawer_id for r in splitting.resplit(df).collect()}
    assert got == {"none", "gap", "twice", "stale", "renumbered", "nullindex"}
    pieces = splitting.pieces(df.where("id = 'none'")).orderBy("chunk_index").collect()
    assert [p.chunk_index for p in pieces] == list(range(len(pieces))) and "".join(p.text[p.overlap :] for p in pieces) == long_
    assert splitting.resplit(df.where("id = 'nobody'")).count() == 0


# --- leakage ------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, "kind", "What " + " ".join(pick(8)) + "? " + " ".join(pick(rng.choice([3, 40])))) for i in range(70)]
    items += [(100, "k", None), (101, "k", ""), (102, "k", "too short to leak"), (103, "k", items[0][2])]
    docs = []
    for d in range(150):
        ws = pick(rng.choice([0, 5, 60]))
        if rng.random() < 0.6:
            source = words.words(rng.choice(items[:70])[2])
            at = rng.randrange(max(1, len(source) - 9))
            n = rng.choice([9, 10, 11, 30])
            ws[len(ws) // 2 : len(ws) // 2] = source[at : at + n]
        docs.append((d, ("—" if d % 2 else " ").join(w.upper() if d % 3 else w for w in ws), 0))
    docs += [(900, None, 0), docs[5], (901, items[1][2] + " x " * 5000, 0)]
    grams = lambda t: set(zip(*(words.words(t)[k:] for k in range(10))))
    want = {(d, i) for d, t, _ in docs for i, _, s in items if grams(t) & grams(s)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    ev = spark.createDataFrame(items, "item_id bigint, kind string, text string")
    for at_once in (1000, 20):
        found = leakage.leaks(df, ev, items_at_once=at_once)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    whole = leakage.leaks(df, ev).where("doc_id = 901 and item_id = 1").first()
    assert whole.question_words + whole.answer_words == len(words.words(items[1][2]))
    assert leakage.leaks(df.where("doc_id < 0"), ev).count() == 0 and leakage.leaks(df, ev.where("item_id < 0")).count() == 0


# --- mixing -------------------------------------------------------------------------------------

TARGETS = "source string, target_share double, max_repeats int"


def test_mix_reaches_shares_and_caps(spark):
    rng = random.Random(6)
    docs = [(i, f"text {i} " + "word " * rng.randrange(1, 40), ["Big-One", "big_one ", "small", "tiny", None, "untargeted"][i % 6], 0) for i in range(6000)]
    docs += [(6000, None, "small", 0), (6001, "", "small", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, copy int")
    targets = spark.createDataFrame([("big_one", 0.3, 1), ("small", 0.4, 3), ("tiny", 0.2, 1), ("absent", 0.1, 2)], TARGETS)
    total = 150_000
    report = {r.source: r for r in mixing.shares(df, targets, total).collect()}
    for source in ("big_one", "small"):
        assert abs(report[source].share - report[source].target_share) < 0.01 and report[source].reached
    assert not report["tiny"].reached and report["tiny"].n_copies == report["tiny"].n_docs == 1000
    assert not report["absent"].reached and report["absent"].mix_tokens == 0
    mixed = mixing.mix(df, targets, total).collect()
    seen = collections.Counter((r.source, r.doc_id) for r in mixed)
    assert max(n for (s, _), n in seen.items() if s == "small") <= 3 and max(n for (s, _), n in seen.items() if s == "big_one") == 1
    assert {s: sum(1 for r in mixed if r.source == s) for s in ("small", "tiny")} == {s: report[s].n_copies for s in ("small", "tiny")}
    assert [r.doc_id for r in mixed] != sorted(r.doc_id for r in mixed)
    assert mixed == mixing.mix(df.repartition(7), targets, total).collect()


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    assert mixing.mix(docs, targets).count() == 0 and mixing.shares(docs, targets).first().share == 0.0
    some = spark.createDataFrame([(1, "x", "a")], docs.schema)
    assert mixing.mix(some, targets.limit(0)).count() == 0


def test_poisson_steps_of_large_means():
    steps = mixing.poisson_steps(800, 900)
    assert steps[2] < 1e-300 and 0.48 < steps[800] < 0.52 and steps == sorted(steps) and steps[-1] < 1
    assert mixing.poisson_steps(0.0, 2) == [1.0, 1.0]


def test_poisson_steps_invert_the_distribution():
    u = (np.arange(200_000) + 0.5) / 200_000
    counts = sum((u >= s).astype(int) for s in mixing.poisson_steps(1.7, 30))
    assert abs(counts.mean() - 1.7) < 1e-3 and abs(counts.var() - 1.7) < 1e-2


# --- abuse --------------------------------------------------------------------------------------


@pytest.mark.parametrize("text, want", [("You 1d10t", "you idiot"), ("naaaaked", "naked"), ("d-u-m-b", "dumb"), ("i###t", "i\x02\x02t"), ("Imbécil", "imbecil"), ("mo​ron", "moron"), ("42 and 1.5", "42 and 1.5")])
def test_folding(text, want):
    assert abuse.fold(text) == want


def test_short_passages_are_scored():
    assert abuse.passages("我们检查了锁。傻逼。好的，继续。") == ["我们检查了锁", "傻逼", "好的,继续"]
    assert abuse.passages("1. Fine!\n-\n\n22. x. ok") == ["fine", "x", "ok"] and abuse.passages("") == [] == abuse.passages("-\n1\n*")
    model = abuse.train([("我们检查了锁。 傻逼 傻逼", "insult"), ("我们检查了锁。 你好 你好", "none")] * 60)
    p = 1 - model.probabilities(["傻逼", "你好"])[:, 0]
    assert p[0] > p[1]


def labelled_documents(n, seed):
    rng = random.Random(seed)
    clean = ["the parser reads a block", "we saw the queue fail", "kill the idle process", "see the notes on locks", "the cache grew again"]
    bad = {"insult": ["you are a worthless idiot", "drop dead you pathetic moron"], "hate": ["send those zogs back to the mud", "all zogs are filth"], "sexual": ["send me naked pics", "hot naked singles here"]}
    docs = []
    for _ in range(n):
        parts = [rng.choice(clean) + f" {rng.randrange(99)}" for _ in range(6)]
        cat = rng.choice(["none", "none", "none", *bad])
        if cat != "none":
            p = rng.choice(bad[cat])
            p = rng.choice([p, p.upper(), p.replace("i", "1"), p.replace("o", "ooo")])
            parts.insert(rng.randrange(6), p)
        docs.append((". ".join(parts), cat))
    return docs


def test_classifier_on_held_out_documents(spark):
    model = abuse.train(labelled_documents(400, 1))
    held = labelled_documents(200, 2)
    rows = [(i, t, c) for i, (t, c) in enumerate(held)] + [(900, None, ""), (901, "", ""), (902, "\n!!\n", ""), (903, "x" * 50_000, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = {r.doc_id: r for r in abuse.scores(df, model).collect()}
    assert len(got) == len(rows) and all(got[i].score == 0.0 and got[i].category == "none" for i in (900, 901, 902))
    right = sum(got[i].flagged == (c != "none") for i, (_, c) in enumerate(held))
    assert right >= 190 and sum(got[i].category == c for i, (_, c) in enumerate(held)) >= 180


def test_no_labels_no_model(spark):
    docs = spark.createDataFrame([(1, "you idiot", "a-b"), (2, None, None)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(1, None, 1), (1, "none", 2), (1, "insult", 3), (5, "hate", 1), (2, "odd", 1)], "doc_id bigint, category string, rater int")
    assert abuse.labelled(docs, labels, 10) == [] and abuse.train([]) is None
    scored = abuse.fitted_scores(docs, labels)
    assert {(r.doc_id, r.score, r.flagged) for r in scored.collect()} == {(1, 0.0, False), (2, 0.0, False)}
    assert {(r.source, r.n_docs, r.rate) for r in abuse.rates(docs, scored).collect()} == {("a_b", 1, 0.0), (None, 1, 0.0)}
    assert abuse.fitted_scores(docs.limit(0), labels.limit(0)).count() == 0
