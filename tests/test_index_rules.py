"""Vector and postings indexes, variants, gram rows, stopping rules, streams and samples of the core."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import hashing as H
from millrace.functions import text as X
from millrace.operators import aggregates, ann, decisions, decontam, dedup, dense, fusion, harvest, integrity, joins, lexical, metrics, ranking, sampling, stats
from millrace.session import bounded_broadcast, scratch
from millrace.sources import readers, sinks
from tests.conftest import rows


def vectors(spark, n=300, dim=12, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    v = centres[r.integers(0, 8, n)] + 0.3 * r.normal(size=(n, dim))
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    return v.astype(np.float32), spark.createDataFrame([(i, [float(x) for x in row], "x", 1) for i, row in enumerate(v.astype(np.float32))], "doc_id long, vector array<float>, cell string, piece int")


def exact(v, q, k):
    s = np.round(v[q].astype(np.float64) @ v.astype(np.float64).T, 9)
    return {i: [j for j in sorted(range(len(v)), key=lambda j: (-s[n, j], j)) if j != i][:k] for n, i in enumerate(q)}


def test_index_is_exact_with_all_cells_and_recalls_with_few(spark, tmp_path):
    v, df = vectors(spark)
    index = ann.build(df, str(tmp_path / "i"), 10)
    assert index.rows.count() == 300 and len(index.centres) == 10
    q = df.where("doc_id % 10 = 0").select(F.col("doc_id").alias("qid"), "vector")
    want = exact(v, list(range(0, 300, 10)), 5)
    for piece in (50_000, 7):
        got = {}
        for r in ann.search(ann.open_index(spark, str(tmp_path / "i")), q, 5, 10, piece=piece).collect():
            got.setdefault(r.qid, []).append((r.rank, r.doc_id))
        assert {i: [d for _, d in sorted(x)] for i, x in got.items()} == want
    sweep = ann.recall_sweep(index, q, [1, 3, 10], 5).orderBy("probes").collect()
    assert sweep[-1].recall == 1.0 and sweep[1].recall >= 0.9 and sweep[0].candidates < sweep[-1].candidates == 300
    with pytest.raises(Exception, match="already exists"):
        ann.build(df, str(tmp_path / "i"), 10)


def test_index_of_odd_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (None, [1.0, 0.0]), (5, [0.0, 0.0])], "doc_id long, vector array<float>")
    index = ann.build(df, str(tmp_path / "i"), 4)
    assert {r.doc_id for r in index.rows.collect()} == {1, 2, 5}
    q = spark.createDataFrame([(9, [1.0, 0.2]), (8, [1.0])], "qid long, vector array<float>")
    assert [(r.qid, r.doc_id) for r in ann.search(index, q, 2, 4).orderBy("qid", "rank").collect()] == [(9, 1), (9, 2)]
    assert ann.search(index, q.limit(0), 2, 4).count() == 0


def test_variants_share_one_pass_and_equal_single_searches(spark):
    _, df = vectors(spark, 120)
    q = df.where("doc_id % 10 = 0").select(F.col("doc_id").alias("qid"), "vector")
    makers = {"same": lambda t: t.select("qid", "vector"), "turned": lambda t: t.select("qid", F.reverse("vector").alias("vector"))}
    both = dense.knn_variants(dense.encoded(makers, q), df, 4)
    for name, make in makers.items():
        assert rows(both.where(F.col("variant") == name).select("qid", "doc_id", "score", "rank")) == rows(dense.knn(make(q), df, 4).select("qid", "doc_id", "score", "rank"))
    with pytest.raises(Exception, match="each query one vector"):
        dense.encoded({"lost": lambda t: t.where("qid > 0").select("qid", "vector")}, q).collect()


def test_search_passes_and_blocks_do_not_change_the_result(spark, monkeypatch):
    _, df = vectors(spark, 150)
    q = df.where("doc_id % 4 = 0").select(F.col("doc_id").alias("qid"), "vector")
    want = rows(dense.knn(q, df, 3))
    far = dense.energy_distance(df.where("doc_id < 60"), df.where("doc_id >= 60")).first().energy
    monkeypatch.setattr(dense, "PASS_BYTES", 12 * 8 * 10)
    assert rows(dense.knn(q, df, 3, block=4)) == want
    assert dense.energy_distance(df.where("doc_id < 60"), df.where("doc_id >= 60")).first().energy == pytest.approx(far, abs=1e-9)
    assert dense.knn(q.limit(0), df, 3).count() == 0
    assert dense.mean_distance(df.limit(0), df).first().d is None


def test_gram_character_and_segment_rows(spark):
    t = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, []), (3, None)], "qid int, tokens array<string>")
    g = spark.createDataFrame([("a b", "AB"), ("b a b", "BAB"), ("z z", "ZZ")], "gram string, token string")
    assert rows(dense.gram_rows(t, g).where("qid = 1").groupBy("token").count()) == [("AB", 2), ("BAB", 1), ("a", 2), ("b", 2)]
    assert rows(dense.gram_rows(t, g.limit(0)).groupBy("token").count()) == [("a", 2), ("b", 2)]
    c = spark.createDataFrame([(1, "Banana an"), (2, None)], "qid int, text string")
    k = spark.createDataFrame([("an", 7), ("ana", 8), ("xyz", 9)], "gram string, token int")
    assert rows(dense.character_rows(c, k).groupBy("token").count()) == [(7, 3), (8, 2)]
    assert dense.character_rows(c, k.limit(0)).count() == 0
    s = spark.createDataFrame([(1, [1, 2, 3, 1, 2]), (2, [2, 2, 2]), (3, None)], "qid int, tokens array<int>")
    got = {r.qid: list(r.tokens) for r in dense.segment_rows(s, [(1, 2, 10), (10, 3, 11), (2, 2, 12)]).collect()}
    assert got == {1: [11, 10], 2: [12, 2], 3: []}


def kill(values, kinds, drop):
    best, bad = {}, False
    for i, (v, k) in enumerate(zip(values, kinds, strict=True)):
        if v is None or v != v or abs(v) == float("inf"):
            return i, "not finite"
        now = k in best and v < best[k] - drop
        if now and bad:
            return i, "two in a row"
        bad = now
        best[k] = max(best.get(k, v), v)
    return None


def test_stopping_rules_match_a_walk(spark):
    r = random.Random(2)
    runs = {f"r{i}": [(r.choice([r.random(), r.random(), 0.9, None if i % 7 == 0 else 0.5, float("nan") if i % 11 == 0 else 0.4]), r.choice("xy")) for _ in range(12)] for i in range(40)}
    e = spark.createDataFrame([(n, i, k, v) for n, x in runs.items() for i, (v, k) in enumerate(x)], "run string, step int, kind string, value double")
    want = sorted((n, *w) for n, x in runs.items() if (w := kill([v for v, _ in x], [k for _, k in x], 0.2)))
    assert rows(decisions.kill_rule(e, 0.2)) == want
    c = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate([0.1, 0.2, 0.3, 0.301, 0.9])] + [("b", i + 1, float(i)) for i in range(5)], "run string, cycle int, value double")
    assert rows(decisions.plateau_rule(c, 0.003, 3)) == [("a", 4)]


def test_streams_resume_and_refuse_another_population(spark):
    docs = spark.createDataFrame([(i,) for i in range(7)], "doc_id long")
    state, seen = sampling.stream_state(docs, "doc_id", 0), []
    for size in (3, 0, 5, 9, 4):
        batch, state = sampling.stream_batch(docs, "doc_id", size, "s", state)
        got = [r.doc_id for r in batch.orderBy("step").collect()]
        assert len(got) == size
        seen += got
    assert all(sorted(seen[i : i + 7]) == list(range(7)) for i in range(0, 21, 7)) and seen[:7] != seen[7:14]
    assert state == sampling.stream_state(docs, "doc_id", 21)
    with pytest.raises(ValueError, match="changed"):
        sampling.stream_batch(docs.limit(6), "doc_id", 1, "s", state)
    with pytest.raises(ValueError, match="empty"):
        sampling.stream_state(docs.limit(0), "doc_id", 0)


def test_budgeted_subset_equals_a_walk(spark):
    r = random.Random(6)
    data = [(f"q{i}", r.choice([None, [], [f"d{r.randrange(60)}" for _ in range(r.choice([1, 1, 2, 5, 40]))] + [None] * r.randrange(2)])) for i in range(400)]
    df = spark.createDataFrame([(*x, "y") for x in data], "qid string, pos array<string>, h string")
    order = {x.qid: x.k for x in df.select("qid", H.order_key("s", F.col("qid")).alias("k")).collect()}
    for budget in (1, 7, 30, 1000):
        have, want = set(), []
        for q, p in sorted((x for x in data if x[1]), key=lambda x: (order[x[0]], x[0])):
            new = {y for y in p if y is not None} - have
            if len(have) + len(new) <= budget:
                have |= new
                want.append(q)
        assert sorted(x.qid for x in sampling.budgeted_subset(df, "qid", "pos", budget, "s").collect()) == sorted(want)
    assert sampling.budgeted_subset(df.limit(0), "qid", "pos", 5, "s").count() == 0


def test_range_numbers_with_a_hot_group_and_ties(spark):
    r = random.Random(3)
    data = [("hot" if i % 3 else f"g{i % 5}", r.choice([1.0, 2.0, None]), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, v double, id int").repartition(5)
    got = rows(ranking.range_numbers(df, ["g"], [F.col("g"), F.desc_nulls_last("v"), F.col("id")]).select("g", "id", "rn"))
    want = []
    for g in {x[0] for x in data}:
        mine = sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        want += [(g, x[2], n) for n, x in enumerate(mine, 1)]
    assert got == sorted(want, key=repr)
    assert ranking.range_numbers(df.limit(0), ["g"], [F.col("g"), F.col("id")]).count() == 0


def test_order_statistic_by_ranges(spark):
    r = random.Random(4)
    v = [r.choice([r.random(), 0.5, 0.25]) for _ in range(333)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double").repartition(7)
    for q in (0.01, 0.5, 0.975, 1.0):
        at = max(1, -(-int(round(len(v) * q * 1000)) // 1000))
        s = sorted(v)
        got = aggregates.order_statistic(df, "v", q).first()
        assert (got.value, got.previous) == (s[at - 1], s[max(0, at - 2)])
    assert aggregates.order_statistic(df.limit(0), "v", 0.5).first().value is None


def test_near_duplicates_of_short_texts_with_a_common_gram(spark):
    """A 4-gram that a third of all texts hold: the gate's statuses equal brute force."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    texts = [("in the same way " if i % 3 == 0 else "") + " ".join(r.choice(words) for _ in range(r.choice([4, 6, 9, 20]))) for i in range(90)]
    texts += [texts[0] + " more", texts[3], " ".join(texts[5].split()[:-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = lambda t, k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)} or {tuple(t)}
    want, before = {}, []
    for i, t in enumerate(texts):
        w = t.split()
        if any(w == o for o in before):
            want[i] = "exact"
            continue
        near = False
        for o in before:
            a, b = grams(w, 4), grams(o, 4)
            near |= len(w) < 39 and len(o) < 39 and len(a & b) >= min(len(a), len(b)) * 0.5
            near |= len(grams(w, 8) & grams(o, 8)) >= 16 and len(grams(w, 8)) <= 32 and len(grams(o, 8)) <= 32
        want[i] = "near" if near else "kept"
        before.append(w)
    assert {r_.id: r_.status for r_ in dedup.diversity_gate(df, "doc_id", "text").collect()} == want


def test_fuzzy_pairs_lose_none_to_their_filters(spark):
    import difflib

    r = random.Random(9)
    base = ["fix crash in segment optimizer loop", "fix crash in query planner", "add support for payload index"]
    shapes = sorted({"".join(c if r.random() > 0.06 else r.choice("abcdefgh ") for c in r.choice(base)) for _ in range(80)})
    shapes = sorted({" ".join(s.split()) for s in shapes})
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "doc_id long, t string")
    want = []
    for i, a in enumerate(shapes):
        for b in shapes[i + 1 :]:
            x, y = a.split(), b.split()
            if x[:2] == y[:2] and (len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.82 or difflib.SequenceMatcher(None, a, b).ratio() >= 0.92):
                want.append((a, b))
    assert want and rows(joins.fuzzy_pairs(df, "doc_id", X.title_shape(F.col("t")))) == sorted(want)


def test_postings_index_equals_direct_search(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["hnsw index", "wal and index", "", None, "index index hnsw", "3"])], "doc_id long, text string")
    q = spark.createDataFrame([(10, "index hnsw"), (11, "nothing"), (4, "index index hnsw"), (12, None)], "qid long, text string")
    lexical.build_index(docs, str(tmp_path / "p"))
    got = rows(lexical.search_index(lexical.open_index(spark, str(tmp_path / "p")), q))
    assert got == rows(lexical.bm25(docs, q)) and {r[0] for r in got} == {10, 4} and (4, 4) not in {r[:2] for r in got}


def test_split_halves_and_subset_macros(spark):
    s = spark.createDataFrame([(g, f"q{i}", v) for g in (0, 1) for i in range(20) for v in [0.5 if g == 0 else (0.9 if i % 2 else 0.2)]], "grid_pos int, qid string, value double")
    half = {r.qid: r.h for r in s.select("qid", H.half(F.col("qid")).alias("h")).distinct().collect()}
    mean = lambda g, h: np.mean([0.5 if g == 0 else (0.9 if i % 2 else 0.2) for i in range(20) if half[f"q{i}"] == h])
    for r in fusion.split_half(s).collect():
        best = max((0, 1), key=lambda g: (round(mean(g, r.fitted_on), 9), -g))
        assert r.grid_pos == best and r.fitted == pytest.approx(mean(best, r.fitted_on)) and r.scored == pytest.approx(mean(best, 1 - r.fitted_on))
    x = spark.createDataFrame([("a", "q", 1.0), ("b", "q", 3.0), ("c", "q", 9.0)], "c string, qid string, v double")
    assert tuple(metrics.subset_macro(x, "c", "v", ["a", "b"]).first()) == (2.0, 2)
    assert tuple(metrics.subset_macro(x, "c", "v", ["z"]).first()) == (None, 0)


def test_tables_in_and_out(spark, tmp_path):
    t = spark.createDataFrame([("1", "a\tb"), ("2", None)], "id string, text string")
    sinks.write_tsv(t, str(tmp_path / "t"), compressed=True)
    assert rows(readers.tsv(spark, str(tmp_path / "t"))) == [("1", "a\tb"), ("2", "")]
    with pytest.raises(Exception, match="can't be written"):
        sinks.write_tsv(t.select("text", "id"), str(tmp_path / "u"))
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc_id int, vector array<float>")
    sinks.write_once(v, str(tmp_path / "v"))
    m = sinks.file_manifest(spark, str(tmp_path / "v"), "*.parquet")
    kept = spark.createDataFrame(m.collect(), m.schema)
    assert readers.verified_vectors(spark, str(tmp_path / "v"), kept).count() == 2
    with pytest.raises(ValueError, match="differ"):
        readers.verified_vectors(spark, str(tmp_path / "v"), kept.withColumn("sha256", F.lit("0")))


def test_fetch_resumes_and_refuses_changed_pages(spark, tmp_path):
    pages = {"e": [[{"id": 1}], [{"id": 2}], [{"id": 3}]]}
    calls = []

    def client(endpoint, cursor):
        i = int(cursor or 0)
        calls.append(i)
        if i == 2 and len(calls) == 3:
            raise ConnectionError("gone")
        return pages[endpoint][i], str(i + 1) if i + 1 < 3 else None

    with pytest.raises(ConnectionError):
        readers.fetch(spark, client, ["e"], str(tmp_path / "p"))
    assert readers.fetch(spark, client, ["e"], str(tmp_path / "p")) == 1 and calls == [0, 1, 2, 2]
    assert readers.fetch(spark, client, ["e"], str(tmp_path / "p")) == 0 and len(calls) == 4
    assert sorted(r.id for r in readers.api_pages(spark, str(tmp_path / "p"), "struct<id:int>").collect()) == [1, 2, 3]
    hit = next((tmp_path / "p").glob("*-000002.json"))
    for crc in hit.parent.glob(f".{hit.name}.crc"):
        crc.unlink()
    hit.write_text("[]")
    with pytest.raises(ValueError, match="not what was fetched"):
        readers.fetch(spark, client, ["e"], str(tmp_path / "p"))


def test_sizes_decide_on_a_broadcast(spark):
    small = spark.range(10).select(F.explode(F.array(F.col("id"), F.col("id"))).alias("x"))
    assert "ResolvedHint" in bounded_broadcast(small)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in bounded_broadcast(small, 1)._jdf.queryExecution().analyzed().toString()
    assert scratch(spark) != scratch(spark)


def test_top_grams_costs_and_drafts(spark):
    t = spark.createDataFrame([("a b a b",), ("b a",), (None,)], "t string")
    grams = A.kgrams(X.fingerprint_words(F.col("t")), 2)
    assert rows(aggregates.top_grams(t, grams, 2)) == [(1, "a b", 2), (2, "b a", 2)]
    with pytest.raises(Exception, match="fewer grams"):
        aggregates.top_grams(t, grams, 3).collect()
    c = spark.createDataFrame([("s", 1_000_000, 64, 2, 0)], "store string, rows long, dim int, width int, extra int")
    assert rows(aggregates.storage_costs(c)) == [("s", 64, 128.0, 0.128)]
    d = spark.createDataFrame([(i, "k" if i % 4 else "m", f"  phrase  {i} ") for i in range(20)] + [(99, "k", " "), (None, "k", "x")], "doc_id int, kind string, phrase string")
    got = sampling.drafted_queries(d, {"k": 3, "m": 1}, 6, "s").collect()
    assert len(got) == 6 and len({r.doc_id for r in got}) == 6 and all("  " not in r.query for r in got)
    assert sum(r.kind == "m" for r in got) >= 1
    p = harvest.placeholder_collisions(spark.createDataFrame([("at 0x0123456789", "a"), ("at 0xabcdef0123", "b"), ("plain", "a")], "t string, g string"), "t", "g").collect()
    assert len(p) == 1 and (p[0].texts, p[0].groups, p[0].fails) == (2, 2, False)


def test_rows_that_were_seldom_updated(spark):
    x = spark.createDataFrame([("a", [1.0, 3.0], [9.0, 9.0], 5), ("b", [5.0, 5.0], [7.0, 8.0], 1), ("c", [3.0, 1.0], [9.0, 9.0], 2), ("d", [6.0, 6.0], [0.5, 0.5], None)], "token string, vector array<float>, start array<float>, updates int")
    got = {p: {r.token: list(r.vector) for r in dense.unseen_policy(x, p, 2).collect()} for p in ("mean", "zero", "start")}
    assert got["mean"] == {"a": [1, 3], "b": [2, 2], "c": [3, 1], "d": [2, 2]}
    assert got["zero"]["b"] == [0, 0] == got["zero"]["d"] and got["start"]["b"] == [7, 8] and got["start"]["d"] == [0.5, 0.5]
    assert dense.unseen_policy(x.where("token = 'b'"), "mean", 2).first().vector == [0, 0]
    with pytest.raises(ValueError, match="no policy"):
        dense.unseen_policy(x, "best")


def test_predicates_of_the_caller_and_any_statistic(spark):
    x = spark.createDataFrame([(1, "ab"), (2, None), (3, "abcd")], "i int, t string")
    got = integrity.screened(x, {"long": lambda d: F.length(d["t"]) > 3, "odd": lambda d: d["i"] % 2 == 1})
    assert {r.i: r.rejected for r in got.collect()} == {1: "odd", 2: None, 3: "long"}
    u = spark.createDataFrame([("s", f"q{i}", float(i), 2.0) for i in range(9)], "s string, q string, a double, b double")
    r = stats.statistic_replicates(u, "s", "q", ["a", "b"], lambda v, n: v["b"] / n, 30).collect()
    assert len(r) == 30 and all(x.value == 2.0 for x in r)
    m = [x.value for x in stats.statistic_replicates(u, "s", "q", ["a"], lambda v, n: v["a"] / n, 200).collect()]
    assert abs(np.mean(m) - 4) < 0.3 and len(set(m)) > 20


def test_masks_and_shares_of_leaks(spark):
    pool = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "nothing of it"), (2, "nothing of it"), (3, None)], "doc_id int, text string")
    held = spark.createDataFrame([(7, "query", "one two three four five six seven eight nine"), (8, "query", "some other words here that nobody says at all"), (9, "passage", None)], "item_id int, role string, text string")
    q, d = decontam.query_index(held.where("role = 'query'")), decontam.document_index(held.where("role = 'passage'"), "item_id")
    assert sorted((r.id, r.keep) for r in decontam.keep_mask(pool, d, q, "doc_id").collect()) == [(1, False), (2, True), (2, True), (3, True)]
    assert {r.role: (r["items"], r.exact, r.near) for r in decontam.leakage_shares(held, pool, "item_id", "role").collect()} == {"query": (2, 0.5, 0.0), "passage": (1, 0.0, 0.0)}
    one = decontam.mask_identity(pool, held)
    assert one == decontam.mask_identity(pool.repartition(3), held) != decontam.mask_identity(pool.where("doc_id < 3"), held)


def test_shards_are_written_once_and_refuse_other_rows(spark, tmp_path):
    x = spark.createDataFrame([(i,) for i in range(40)], "doc_id int")
    keep = lambda df, i: df
    assert sinks.encode_shards(x, "doc_id", str(tmp_path / "s"), 4, keep) == [0, 1, 2, 3]
    assert sinks.encode_shards(x, "doc_id", str(tmp_path / "s"), 4, keep) == []
    with pytest.raises(ValueError, match="other rows"):
        sinks.encode_shards(x.limit(3), "doc_id", str(tmp_path / "s"), 4, keep)
    assert spark.read.parquet(*[str(tmp_path / "s" / f"shard={i}") for i in range(4)]).count() == 40


def test_pool_modes_takes_one_pass_and_explodes_no_vector(spark, tmp_path):
    from millrace.plans.registry import queries

    spark.createDataFrame([(0, [3.0, 4.0], 1), (1, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(7, 2), (7, 4), (8, 3)], "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = queries()["pool_modes"](spark, str(tmp_path))
    assert "posexplode" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.mode, r.queries, r.total) for r in df.collect()] == [(m, 2, 2.4) for m in ("mean", "presence", "cap2", "sqrt")]
