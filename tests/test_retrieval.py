import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import decisions, dense, fusion, judgments, lexical, metrics, mining
from tests.conftest import rows


def run(spark, data):
    return spark.createDataFrame(data, "qid string, doc_id string, score double")


def two_runs(seed=1):
    r = random.Random(seed)
    a = [(q, f"d{i}", r.random()) for q in ("q1", "q2") for i in range(40)]
    b = [(q, f"d{i}", 30 * r.random()) for q in ("q1", "q2") for i in r.sample(range(60), 25)]
    return a, b


def ranks(data):
    out = {}
    for q in {x[0] for x in data}:
        for n, (_, d, s) in enumerate(sorted((x for x in data if x[0] == q), key=lambda x: (-x[2], x[1])), 1):
            out[q, d] = (n, s)
    return out


def as_scores(df):
    return {(r.qid, r.doc_id): r.score for r in df.collect()}


@pytest.mark.parametrize("k", [1, 60])
def test_rrf(spark, k):
    a, b = two_runs()
    want = defaultdict(float)
    for data, w in ((a, 0.3), (b, 0.7)):
        for key, (n, _) in ranks(data).items():
            want[key] += w / (k + n)
    got = as_scores(fusion.rrf({"a": run(spark, a), "b": run(spark, b)}, k, {"a": 0.3, "b": 0.7}))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-11 for x in want)


def test_rrf_server_equals_classic_with_shifted_k_and_refuses_zero(spark):
    a, b = (run(spark, x) for x in two_runs())
    x, y = as_scores(fusion.rrf_server({"a": a, "b": b}, 2)), as_scores(fusion.rrf({"a": a, "b": b}, 1))
    assert all(abs(x[k] - y[k]) < 1e-11 for k in x)
    with pytest.raises(ValueError):
        fusion.rrf_server({"a": a}, 0)
    assert set(as_scores(fusion.rrf_server({"a": a}, 2, {"a": 0.0})).values()) == {0.0}


def test_dbsf_and_degenerate_runs(spark):
    a, b = two_runs(2)
    want = defaultdict(float)
    for data in (a, b):
        for q in ("q1", "q2"):
            top = sorted(((d, s) for x, d, s in data if x == q), key=lambda e: (-e[1], e[0]))[:20]
            s = np.array([x for _, x in top])
            for d, x in top:
                want[q, d] += (x - (s.mean() - 3 * s.std(ddof=1))) / (6 * s.std(ddof=1))
    got = as_scores(fusion.dbsf({"a": run(spark, a), "b": run(spark, b)}, 20))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    one = as_scores(fusion.dbsf({"a": run(spark, [("q", "x", 3.0)]), "b": run(spark, [("q", "y", 2.0), ("q", "z", 2.0)])}))
    assert set(one.values()) == {0.5}


def test_convex_formulas(spark):
    a, b = [("q", "x", 2.0), ("q", "y", 1.0)], [("q", "x", 5.0)]
    got = as_scores(fusion.convex(run(spark, a), run(spark, b), 0.6))
    assert got["q", "x"] == pytest.approx(0.6 * 1 / (1 + 1e-9)) and got["q", "y"] == 0
    zero = as_scores(fusion.convex(run(spark, a), run(spark, b), 0.6, floor_zero=True))
    assert zero["q", "y"] == pytest.approx(0.3) and zero["q", "x"] == pytest.approx(1.0)


def test_truncate_ties_and_layout(spark):
    data = [("q", f"d{i:02d}", 1.0) for i in range(30)] * 1
    for p in (1, 3, 7):
        got = fusion.truncate(run(spark, data).repartition(p), 5).orderBy("rank")
        assert [r.doc_id for r in got.collect()] == [f"d{i:02d}" for i in range(5)]


def test_collapse_excludes_before_the_cut(spark):
    scores = spark.createDataFrame([("q", f"p{i:03d}", 1000.0 - i) for i in range(505)], "qid string, passage_id string, score double")
    passages = spark.createDataFrame([(f"p{i:03d}", "own" if i < 10 else f"a{i // 2}", "copy" if i == 10 else f"h{i}") for i in range(505)], "passage_id string, artifact_id string, text_hash string")
    own = spark.createDataFrame([("q", "own")], "qid string, artifact_id string")
    copies = spark.createDataFrame([("q", "copy")], "qid string, text_hash string")
    got = fusion.collapse_passages(scores, passages, own, copies, 500, 1000).orderBy("rank").collect()
    assert got[0].passage_id == "p011" and got[0].artifact_id == "a5"
    assert len(got) == len({f"a{i // 2}" for i in range(11, 505)})


def test_explained_fusion(spark):
    r = spark.createDataFrame([("x", "q", "a", "p1", 2.0), ("x", "q", "b", "p2", 1.0), ("y", "q", "b", "p3", 9.0), ("y", "q", "c", "p4", 1.0)], "route string, qid string, artifact_id string, passage_id string, score double")
    got = fusion.dbsf_artifacts(r).orderBy("rank").collect()
    assert [s.route for s in next(g for g in got if g.artifact_id == "b").support] == ["x", "y"]


def test_bm25_against_formula(spark):
    r = random.Random(3)
    lex = [f"w{i}" for i in range(15)]
    docs = [(f"d{i}", " ".join(r.choice(lex) for _ in range(8))) for i in range(30)] + [("empty", ""), ("null", None)]
    qs = [(f"q{i}", " ".join(r.choice(lex) for _ in range(3))) for i in range(4)] + [("d0", docs[0][1]), ("none", "zzz")]
    d, q = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(qs, "qid string, text string")
    got = as_scores(lexical.bm25(d, q, 1000))
    toks = {i: (t or "").split() for i, t in docs}
    df = Counter(w for t in toks.values() for w in set(t))
    avg = sum(map(len, toks.values())) / len(docs)
    want = {}
    for qid, text in qs:
        for i, t in toks.items():
            c = Counter(t)
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in text.split() if c[w])
            if s > 0 and i != qid:
                want[qid, i] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_knn_exact_with_ties_blocks_and_bad_vectors(spark):
    g = np.random.default_rng(4)
    v = g.integers(-2, 3, (37, 6)).astype(float)
    v[5] = v[6] = v[7] = v[8]
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [1.0])], "doc_id long, vector array<float>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:11])] + [(99, None)], "qid long, vector array<float>")
    want = {}
    for i in range(11):
        s = v @ v[i]
        o = sorted((j for j in range(37) if j != i), key=lambda j: (-s[j], j))[:4]
        want[i] = o
    for parts, block in ((1, 8192), (5, 3)):
        got = defaultdict(list)
        for r in dense.knn(q, docs.repartition(parts), 4, block=block).orderBy("qid", "rank").collect():
            got[r.qid].append(r.doc_id)
        assert got == want
    assert dense.knn(q.limit(0), docs, 3).count() == 0


def test_encode_prf_ridge_axes(spark):
    t = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "token int, vector array<float>")
    tok = spark.createDataFrame([("a", 2), ("a", 2), ("a", 1), ("b", 9)], "qid string, token int")
    got = {r.qid: r.vector for r in dense.lookup_encode(tok, t, "sqrt", spark.createDataFrame([([1.0, 0.0],)], "vector array<double>")).collect()}
    w = math.sqrt(2)
    a = np.array([2 * w + 1, w + 1]) / (w + 1)
    assert np.allclose(got["a"], a / np.linalg.norm(a)) and list(got["b"]) == [1.0, 0.0]
    g = np.random.default_rng(1)
    x, y = g.normal(size=(40, 3)), g.normal(size=(40, 2))
    df = spark.createDataFrame([(p.tolist(), o.tolist()) for p, o in zip(x, y, strict=True)], "x array<double>, y array<double>").repartition(3)
    assert np.allclose(dense.ridge(df, "x", "y", 0.5), np.linalg.solve(x.T @ x + 0.5 * np.eye(3), x.T @ y))
    axes = dense.principal_axes(df, "x", 2)[1]
    assert np.allclose(np.abs(axes @ np.linalg.svd(x - x.mean(0))[2][:2].T), np.eye(2), atol=1e-8)


def test_metrics_conventions(spark):
    q = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "z", 0), ("m", "x", 1)], "qid string, doc_id string, grade int")
    r = spark.createDataFrame([("q", "n", 1), ("q", "a", 2)], "qid string, doc_id string, rank int")
    got = {x.qid: x for x in metrics.per_query(r, q).collect()}
    assert got["q"].ndcg == pytest.approx((2 / math.log2(3)) / (2 + 1 / math.log2(3)), abs=1e-8)
    assert (got["q"].precision, got["q"].mrr, got["q"].recall, got["q"].success) == (0.1, 0.5, 0.5, 1)
    assert got["m"].ndcg == 0 and got["m"].success == 0
    s = spark.createDataFrame([("u1", 1.0), ("u1", 0.0), ("u2", 0.2)], "unit string, v double")
    assert metrics.macro(s, "unit", "v").first().macro == 0.35
    u = spark.createDataFrame([("u1", "f"), ("u2", "g")], "unit string, family string")
    assert metrics.family_macro(s, u, "v").first().macro == 0.35
    with pytest.raises(Exception, match="differ"):
        metrics.family_macro(s, u.limit(1), "v").collect()
    assert rows(metrics.with_missing(spark.createDataFrame([("q", 0.5)], "qid string, v double"), q.select("qid"), "v")) == [("m", 0.0), ("q", 0.5)]
    with pytest.raises(Exception):
        metrics.with_missing(spark.createDataFrame([("q", 1.5)], "qid string, v double"), q.select("qid"), "v").collect()


def test_negatives_and_candidates(spark):
    r = run(spark, [("q", f"d{i}", 10.0 - i) for i in range(5)])
    pos = spark.createDataFrame([("q", "d0")], "qid string, doc_id string")
    ban = spark.createDataFrame([("d1",)], "doc_id string")
    got = mining.hard_negatives(r, pos, ban, 5).orderBy("slot").collect()
    assert [x.doc_id for x in got] == ["d2", "d3", "d4", "d4", "d4"]
    pool = spark.createDataFrame([(f"d{i}",) for i in range(20)], "doc_id string")
    mix = mining.candidate_mix(pos, r, r, pool, 2, 2, 3, "s").collect()
    assert len(mix) == len({x.doc_id for x in mix}) == 8
    assert [x.doc_id for x in sorted(mix, key=lambda x: x.slot) if x.source == "second"] == ["d3", "d4"]


def test_label_bounds_and_states(spark):
    items = spark.createDataFrame([("q", f"d{i}", [1, None, 0, None][i], i + 1, 4 - i) for i in range(4)], "qid string, doc_id string, label int, ra int, rb int")
    b = decisions.label_bounds(items.withColumnRenamed("ra", "rank")).first()
    assert (b.known, b.unknown, float(b.low), float(b.high)) == (1, 2, 1.0, 3.0)
    st = decisions.label_states(items, "ra", "rb", 2)
    assert sorted(x["diff"] for x in st.collect()) == [0, 1, 1, 2]
    c = decisions.contrast_bounds(st).first()
    assert (c.low, c.high) == (0, 2)
    s = decisions.threshold_status(spark.createDataFrame([(0.0, 1.0), (2.0, 3.0), (0.0, 3.0)], "low double, high double"), 2.0)
    assert [r.status for r in s.collect()] == ["robust_fail", "robust_pass", "label_sensitive"]


def test_judgements(spark):
    p = spark.createDataFrame([("i1", 1), ("i2", 0), ("i3", None)], "item_id string, label int")
    a = spark.createDataFrame([("i1", 1), ("i2", 1)], "item_id string, label int")
    g = judgments.agreement(p, a).first()
    assert (g.audited, g.agreements, g.ok) == (2, 1, False)
    authors = spark.createDataFrame([("w",)], "author string")
    adj = spark.createDataFrame([("i2", 0), ("i3", 1)], "item_id string, label int")
    assert rows(judgments.freeze_labels(p, a, adj, ("x", "y"), authors)) == [("i1", 1), ("i2", 0), ("i3", 1)]
    with pytest.raises(Exception):
        judgments.freeze_labels(p, a, adj.limit(1), ("x", "y"), authors).collect()
    with pytest.raises(ValueError):
        judgments.freeze_labels(p, a, adj, ("w", "y"), authors)
    with pytest.raises(ValueError):
        judgments.blinded(p.withColumn("rank", F.lit(1)))
    r = spark.createDataFrame([(x, "q", f"a{i}", i) for x in "xy" for i in range(1, 4)], "route string, qid string, artifact_id string, rank int")
    assert judgments.pool(r, cap=3).count() == 3
    with pytest.raises(Exception, match="cap"):
        judgments.pool(r, cap=2).collect()


def test_grams_are_broadcast_and_characters_are_not(spark, tmp_path):
    spark.createDataFrame([(1, "Singing in"), (2, "x"), (3, None)], "qid long, text string").write.parquet(str(tmp_path / "t"))
    found = dense.character_rows(spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([("ing", 1), ("in", 2)], "gram string, token int"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 1), (1, 2), (1, 2), (1, 2)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan


def test_own_sources_never_meet_all_units_of_a_query(spark):
    run = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0), ("r", "a", 3.0), ("r", "z", 1.0), ("s", "b", 1.0)], "qid string, doc_id string, score double")
    own = spark.createDataFrame([("q", 1), ("r", 2), ("t", 1)], "qid string, object_id int")
    units = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), *[(f"u{i}", 1) for i in range(20)]], "doc_id string, object_id int")
    left = fusion.exclude_sources(run, own, units)
    assert rows(left) == [("q", "b", 1.0), ("r", "a", 3.0), ("r", "z", 1.0), ("s", "b", 1.0)]
    joins_ = [x for x in left._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert sum("LeftSemi" in x for x in joins_) == 1 and sum("Inner" in x and "doc_id" in x for x in joins_) == 1


def test_pooling_by_held_rows_equals_the_join(spark, monkeypatch):
    g = np.random.default_rng(5)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g.normal(size=(9, 4)))] + [(9, [0.0] * 4)], "token int, vector array<float>")
    tok = [(f"q{i % 7}", int(x)) for i, x in enumerate(g.integers(0, 12, 300))] + [("z", 9), ("n", 11), (None, 2)]
    tok = spark.createDataFrame(tok, "qid string, token int").repartition(3)
    modes = ["mean", "presence", "cap2", "sqrt"]
    take = lambda: {(r.qid, r.mode): r.vector for r in dense.pooled(tok, t, modes).collect()}
    held = dense.pooled(tok, t, modes)
    assert "Generate" not in held._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # queries go on in the next batch
    one = take()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 8)
    two = take()
    assert one.keys() == two.keys() and ("z", "mean") in one and ("n", "mean") not in one and (None, "sqrt") in one
    assert all(one[k] is two[k] is None or np.allclose(one[k], two[k], atol=1e-12) for k in one) and one["z", "mean"] is None


def test_tfidf_neighbours_never_make_pairs_and_equal_brute_force(spark, monkeypatch):
    g = random.Random(3)
    vocab = [f"w{i:03d}" for i in range(60)]
    data = [(i, " ".join(g.choices(vocab, [1 / (1 + j) for j in range(60)], k=g.randint(1, 25)))) for i in range(150)]
    data += [(i, data[i - 200][1]) for i in range(200, 212)]  # equal scores
    data += [(3, "w001 w050 again"), (3, "again"), (None, "w002 w059"), (None, "w002 only"), (300, None), (301, "a b"), (302, "alone")]
    words = defaultdict(list)
    for i, t in data:
        words[i] += [x for x in (t or "").split() if len(x) >= 3]
    df = Counter(x for t in words.values() for x in set(t))
    vec = {}
    for i, t in words.items():
        w = {x: (1 + math.log(c)) * math.log(len(data) / (1 + df[x])) for x, c in Counter(t).items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        vec[i] = {x: y / size for x, y in w.items()}
    want = {}
    for a in range(0, 303, 3):
        near = sorted((-round(sum(y * vec[b].get(x, 0) for x, y in vec[a].items()), 9), b) for b in vec if b not in (a, None)) if a in vec else []
        want |= {(a, b, n): -s for n, (s, b) in enumerate(near[:5], 1) if s < 0}
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    found = lambda: lexical.tfidf_neighbours(docs, docs.where("doc_id % 3 = 0"), 5)
    tree = found()._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in tree and "Join" not in tree and "Generate" not in tree  # no rows of documents by query
    take = lambda df: {(r.qid, r.doc_id, r["rank"]): r.score for r in df.collect()}
    one = take(found())
    assert one.keys() == want.keys() and all(abs(one[x] - want[x]) < 2e-9 for x in want)
    monkeypatch.setattr(lexical, "QUERY_TOKENS", 100)
    monkeypatch.setattr(lexical, "CHUNK_TOKENS", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    assert take(found()) == one
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 8)  # terms are joined
    two = take(found())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert two.keys() == one.keys() and all(abs(one[x] - two[x]) < 2e-9 for x in one)
