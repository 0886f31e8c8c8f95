import hashlib
import json
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, decisions, integrity, sampling, stats
from millrace.operators.ranking import distributed_row_number
from millrace.session import salted_join, stage
from millrace.sources import readers, sinks
from millrace.streaming import ingest
from tests.conftest import rows


def ids(spark, n):
    return spark.createDataFrame([(f"k{i}", f"g{i % 3}", i % 7 + 1) for i in range(n)], "key string, g string, n int")


def test_row_numbers_do_not_depend_on_buckets_or_layout(spark):
    x = ids(spark, 200).withColumn("h", F.md5("key"))
    want = {}
    for g in ("g0", "g1", "g2"):
        import hashlib

        ks = sorted((f"k{i}" for i in range(200) if f"g{i % 3}" == g), key=lambda k: hashlib.md5(k.encode()).hexdigest())
        want |= {k: n for n, k in enumerate(ks, 1)}
    for digits, parts in ((1, 1), (2, 5)):
        got = {r.key: r.rn for r in distributed_row_number(x.repartition(parts), ["g"], [], "h", ["key"], bucket_digits=digits).collect()}
        assert got == want


def test_salted_join_equals_join(spark):
    a = ids(spark, 50)
    b = spark.createDataFrame([("g0", 1), ("g1", 2)], "g string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(salted_join(a, b, ["g"], ["key"], how)) == rows(a.join(b, ["g"], how))


def test_samples(spark):
    x = ids(spark, 300)
    assert sampling.lowest_hash(x.repartition(4), "key", 10, "s").count() == 10
    assert rows(sampling.lowest_hash(x, "key", 10, "s")) == rows(sampling.lowest_hash(x.repartition(7), "key", 10, "s"))
    assert Counter(r.g for r in sampling.quota_cut(x, ["g"], "key", 7, "s").collect()) == {"g0": 7, "g1": 7, "g2": 7}
    assert sampling.proportional(x, "g", "key", 100, "s").count() == 100
    assert sampling.equal_budget(x, "g", "key", 10, "s").count() == 10
    p = Counter(r.part for r in sampling.partition_ids(x, "key", x.limit(5).select("key"), 20, "s").collect())
    assert p == {"gate": 5, "held": 20, "train": 275}
    with pytest.raises(Exception, match="too few"):
        sampling.partition_ids(x, "key", x.limit(5).select("key"), 999, "s").collect()
    f = sampling.k_folds(x, "n", 3, "s").collect()
    assert all(len({r.fold for r in f if r.n == n}) == 1 for n in range(1, 8))
    u = Counter(sampling.threshold_sample(x, [F.col("key")], 0.3).count() for _ in range(2))
    assert len(u) == 1 and 50 < next(iter(u)) < 130
    c = sampling.chronological_split(x, "g", "n", "key").collect()
    assert Counter(r.part for r in c) == {"confirmation": 90, "development": 210}


def test_batches(spark):
    x = ids(spark, 100)
    b = sampling.length_batches(x, "n", "key", 8, "s").collect()
    assert max(Counter(r.batch for r in b).values()) == 8 and len(b) == 100
    spans = [sorted(r.n for r in b if r.batch == i) for i in {r.batch for r in b}]
    spans.sort()
    assert all(a[-1] <= c[0] for a, c in zip(spans, spans[1:], strict=False))
    ch = sampling.length_chunks([5, 1, 9, 1, 1], 6)
    assert sorted(i for c in ch for i in c) == list(range(5)) and all(len(c) * max([5, 1, 9, 1, 1][i] for i in c) <= 6 or len(c) == 1 for c in ch)
    t = sampling.token_batches(x, "g", "key", "n", 5, 100, {"g0": 0.5, "g1": 0.5}, "s").collect()
    assert {r.step for r in t} <= {1, 2, 3, 4, 5}
    m = sampling.mixed_pattern(spark.range(8).withColumnRenamed("id", "step"), ["a", "b", "a", "c"]).orderBy("step").collect()
    assert [(r.kind, r["index"]) for r in m] == [("a", 0), ("b", 0), ("a", 1), ("c", 0), ("a", 2), ("b", 1), ("a", 3), ("c", 1)]
    fb = sampling.form_balanced(x, "g", "key", 4, 8, "s").collect()
    assert Counter(r.g for r in fb) == {"g0": 32, "g1": 32, "g2": 32}
    s = spark.createDataFrame([(f"q{i}", [f"p{i % 5}", f"p{i % 3}"]) for i in range(20)], "k string, p array<string>")
    kept = {r.k for r in sampling.budgeted_subset(s, "k", "p", 3, "s").collect()}
    assert len({p for r in s.collect() if r.k in kept for p in r.p}) <= 3 and kept
    assert sampling.bucket_plan({"a": 5, "b": 100}, {"a": 0.5, "b": 0.5}, 50) == {"a": 5, "b": 45}


def paired(spark, n=60, seed=1):
    r = np.random.default_rng(seed)
    return [(f"s{i % 3}", f"q{i}", float(r.random()), float(r.random()) - 0.2) for i in range(n)]


def test_alignment_refuses(spark):
    a = spark.createDataFrame([("d", "q1", 1.0), ("d", "q2", 0.0)], "ds string, qid string, value double")
    assert rows(stats.align(a, a, ["ds", "qid"])) == [("d", "q1", 1.0, 1.0), ("d", "q2", 0.0, 0.0)]
    with pytest.raises(Exception, match="same keys"):
        stats.align(a, a.limit(1), ["ds", "qid"]).collect()
    assert stats.align(a, a.limit(1), ["ds", "qid"], strict=False).count() == 1
    with pytest.raises(Exception, match="same keys"):
        stats.align(a, a.union(a), ["ds", "qid"], strict=False).collect()


def test_bootstrap_and_signflip(spark):
    data = paired(spark)
    p = spark.createDataFrame(data, "s string, q string, a double, b double")
    by = {s: np.array([x[2] - x[3] for x in data if x[0] == s]) for s in ("s0", "s1", "s2")}
    macro = np.mean([v.mean() for v in by.values()])
    d = [r.delta for r in stats.bootstrap_deltas(p, "s", "q", 200, "b").collect()]
    se = np.sqrt(sum(v.var(ddof=1) / len(v) for v in by.values())) / 3
    assert abs(np.mean(d) - macro) < 4 * se / np.sqrt(200) + 1e-3 and 0.7 < np.std(d) / se < 1.3
    b = stats.paired_bootstrap(p, "s", "q", 200, "b").first()
    assert b.ci_low < macro < b.ci_high and b.delta == pytest.approx(macro)
    assert rows(stats.bootstrap_deltas(p.repartition(5), "s", "q", 5, "b")) == rows(stats.bootstrap_deltas(p, "s", "q", 5, "b"))
    f = stats.sign_flip(p, "s", "q", 199, "s").first()
    assert 0 < f.p <= 0.05 and f.delta == pytest.approx(macro)
    null = stats.sign_flip(p.withColumn("b", F.col("a")), "s", "q", 50, "s").first()
    assert null.p == 1.0
    sh = [r.delta for r in stats.shared_bootstrap(p, "s", "q", 20).collect()]
    fa = [r.delta for r in stats.family_bootstrap(p.withColumn("f", F.substring("q", 2, 1)), "s", "f", 20).collect()]
    assert len(sh) == len(fa) == 20
    w = stats.weighted_contrast(p.withColumnRenamed("s", "unit").withColumnRenamed("q", "qid"), spark.createDataFrame([("s0", "x"), ("s1", "x"), ("s2", "y")], "unit string, family string"), 50).first()
    assert w.delta == pytest.approx((by["s0"].mean() + by["s1"].mean()) / 4 + by["s2"].mean() / 2, abs=1e-8) and w.lower <= w.delta


def test_decisions(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")
    assert rows(stats.holm(t).select("test", "rejected")) == [("a", True), ("b", False), ("c", False)]
    g = spark.createDataFrame([(1, "a", 0.1, 0.01), (2, "b", -0.1, 0.01), (3, "c", 0.1, 0.01)], "pos int, test string, lower double, p double")
    assert [r.verdict for r in decisions.gatekeeping(g).orderBy("pos").collect()] == ["REJECTED", "NOT_REJECTED", "NOT_TESTED"]
    u = spark.createDataFrame([(1, "a", 0.1, 0.01), (2, "b", None, 0.01), (3, "c", 0.1, 0.01)], "pos int, test string, lower double, p double")
    assert [r.verdict for r in decisions.gatekeeping(u).orderBy("pos").collect()] == ["REJECTED", "UNSCORABLE", "NOT_TESTED"]
    arms = spark.createDataFrame([("x", 0.2, True), ("y", 0.2, True), ("z", 0.9, False)], "arm string, estimate double, resolves boolean")
    assert decisions.winner(arms).first().winner is None
    assert decisions.winner(arms.where("arm <> 'y'")).first().winner == "x"
    assert decisions.cheapest(spark.createDataFrame([("x", 2, 3), ("y", 2, 3), ("z", 5, 1)], "arm string, params int, layers int"), "y").first().winner == "y"
    e = decisions.eligibility(spark.createDataFrame([("a", 1.0, 1.0, False), ("b", 1.0, 1.0, True)], "name string, value double, threshold double, strict boolean")).first()
    assert (e.eligible, e.failed) == (False, "b")
    c = spark.createDataFrame([(1, 0.4, 0.2, False), (2, 0.35, 0.2, True)], "seed int, winner double, default_score double, fresh boolean")
    assert decisions.confirmation_stands(c).first().stands


def test_aggregates(spark):
    r = random.Random(2)
    d = spark.createDataFrame([(i % 4, i // 4, r.random() + i % 4) for i in range(20)], "r int, c int, v double")
    got = aggregates.two_way_variance(d, "r", "c", "v").first()
    assert got.var_row > 0.5 and got.var_resid < 0.5
    x = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(6)], "x double, y double")
    o = aggregates.ols(x, "y", "x").first()
    assert (o.n, o.slope, o.intercept) == (6, 3.0, 1.0)
    assert aggregates.ols(x.limit(4), "y", "x").first().slope is None
    s = aggregates.order_statistic(x, "x", 0.5).first()
    assert (s.value, s.previous) == (2.0, 1.0)
    v = spark.createDataFrame([("k", "a"), ("k", "a"), ("k", "b"), ("t", "a"), ("t", "b"), ("n", None)], "k string, l string")
    assert rows(aggregates.majority(v, "k", "l")) == [("k", "a"), ("n", "general"), ("t", "general")]
    p = aggregates.power_fit(spark.createDataFrame([(float(i), 1 + 2 * i**-0.5) for i in range(1, 9)], "x double, y double"), "x", "y").first()
    assert p.exponent == 0.5 and p.a == pytest.approx(1) and p.b == pytest.approx(2)
    with pytest.raises(Exception, match="no rows"):
        aggregates.term_rollup(x.limit(0).withColumn("term", F.lit("a")), ["y"]).collect()


def test_readers_refuse_what_they_cannot_read(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"id": "1", "query": "q", "form": "x"}\n{"id": "2", "question": "w", "form": "x"}\n')
    assert rows(readers.jsonl(spark, str(f), ["x"])) == [("1", "q", "x"), ("2", "w", "x")]
    with pytest.raises(Exception, match="can't be read"):
        readers.jsonl(spark, str(f), ["y"]).collect()
    t = tmp_path / "a.tsv"
    t.write_text("1\ta\tb\n2\tc\n")
    assert rows(readers.tsv(spark, str(t))) == [("1", "a\tb"), ("2", "c")]
    t.write_text("1 a\n")
    with pytest.raises(Exception, match="no tab"):
        readers.tsv(spark, str(t)).collect()
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as w:
        w.writestr("m.json", '{"a": 1}\n{"a": 2}\n')
    assert [r.value for r in readers.zip_lines(spark, str(z)).collect()] == ['{"a": 1}', '{"a": 2}']
    j = tmp_path / "a.json"
    j.write_text(json.dumps(["x", "y"]))
    assert rows(readers.json_array(spark, str(j))) == [(0, "x"), (1, "y")]
    pg = tmp_path / "pages"
    pg.mkdir()
    (pg / "p1.json").write_text('[{"id": 1}, {"id": 2}]')
    assert [r.id for r in readers.api_pages(spark, str(pg), "struct<id:int>").collect()] == [1, 2]
    link = spark.createDataFrame([('<https://a/2>; rel="next", <https://a/9>; rel="last"',), ("",)], "l string")
    assert [r.n for r in link.select(readers.next_cursor(F.col("l")).alias("n")).collect()] == ["https://a/2", None]
    with pytest.raises(PermissionError):
        readers.admit("stores/Secret-Eval", ("secret",))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1 \xff")
    (tmp_path / "src" / "b.bin").write_bytes(b"no")
    got = readers.text_files(spark, str(tmp_path / "src"), [".py", ".rs"]).collect()
    assert len(got) == 1 and got[0].suffix == ".py" and got[0].text == "x = 1 �"


def test_sinks_and_manifests(spark, tmp_path):
    run = spark.createDataFrame([("q", "d", 1.0, 1)], "qid string, doc_id string, score double, rank int")
    m = sinks.save_run(run, str(tmp_path / "runs"), "s", "d").first()
    part = str(tmp_path / "runs" / "dataset=d" / "system=s")
    assert sinks.load_run(spark, part, m.digest, 1).count() == 1
    with pytest.raises(ValueError):
        sinks.load_run(spark, part, "0")
    with pytest.raises(Exception, match="already exists"):
        sinks.save_run(run, str(tmp_path / "runs"), "s", "d")
    docs = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id int, text string")
    man = stage(sinks.archive_corpus(docs, str(tmp_path / "arc")), "man")
    assert sinks.verify_files(sinks.file_manifest(spark, str(tmp_path / "arc"), "*.gz"), man).count() == 0
    hit = next((tmp_path / "arc").glob("*.gz"))
    (tmp_path / "arc" / f".{hit.name}.crc").unlink(missing_ok=True)  # some writers put one beside the file
    hit.write_bytes(b"changed")
    assert {r.problem for r in sinks.verify_files(sinks.file_manifest(spark, str(tmp_path / "arc"), "*.gz"), man).collect()} == {"changed"}
    a, b = sinks.table_identity(docs).first(), sinks.table_identity(docs.repartition(3)).first()
    assert a == b and a != sinks.table_identity(docs.limit(1)).first()


def test_integrity(spark):
    x = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, v int")
    assert rows(integrity.duplicate_keys(x, ["k"])) == [("a", 2)]
    assert rows(integrity.constraint_report(x, {"pos": F.col("v") > 0})) == [("pos", 1)]
    assert integrity.projection(10, 1.0, 100, 20, 60) is None and integrity.projection(50, 5.0, 100, 20, 60) == 5.0
    with pytest.raises(TimeoutError):
        integrity.projection(50, 50.0, 1000, 20, 60)
    import hashlib

    sha = lambda p, t: hashlib.sha256(f"{p}|{t}".encode()).hexdigest()
    s1 = sha("", "a")
    led = spark.createDataFrame([(1, "a", "", s1), (2, "b", s1, sha(s1, "b")), (3, "c", "bad", sha("bad", "c"))], "seq int, payload string, previous_sha string, sha string")
    assert rows(integrity.ledger_chain(led)) == [(1, True), (2, True), (3, False)]


def test_streams_resume_and_encode_once(spark, tmp_path):
    src, ck, cache = tmp_path / "log", str(tmp_path / "ck"), str(tmp_path / "cache")
    src.mkdir()
    calls = []

    def encode(df):
        calls.append(df.count())
        return df.withColumn("vec", F.length("key"))

    step = ingest.encode_new(cache, "key", encode)
    spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "key string").write.mode("append").parquet(str(src))
    ingest.run_available(ingest.append_log(spark, str(src), spark.read.parquet(str(src)).schema), ck, step)
    spark.createDataFrame([("b",), ("ccc",)], "key string").write.mode("append").parquet(str(src))
    ingest.run_available(ingest.append_log(spark, str(src), spark.read.parquet(str(src)).schema), ck, step)
    assert rows(spark.read.parquet(cache).select("key", "vec")) == [("a", 1), ("b", 1), ("ccc", 3)]
    assert calls == [2, 1]


def test_heartbeats(spark, tmp_path):
    import datetime as dt

    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    src = tmp_path / "beats"
    spark.createDataFrame([("j", t(0)), ("j", t(1)), ("j", t(20)), ("k", t(20))], "job string, ts timestamp").write.parquet(str(src))
    out = ingest.heartbeat_monitor(ingest.append_log(spark, str(src), spark.read.parquet(str(src)).schema), "job", "ts", 300)
    q = out.writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(spark.table("beats").select("job", "status"))
    assert got.count(("j", "up")) == 2 and ("j", "silent") in got and ("k", "up") in got


def test_every_query_has_a_name_of_its_own():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


def test_stage_reads_back(spark):
    x = stage(ids(spark, 5), "t")
    assert x.count() == 5 and "millrace-" in x.inputFiles()[0]


def test_resampling_queries_take_the_reference_replicates(spark, monkeypatch):
    from millrace.plans import inference

    p = spark.createDataFrame([(d, f"{d}{i}", (i * 7 % 11) / 10, 0.3) for d in ("a", "n") for i in range(4)], "domain string, qid string, a double, b double")
    monkeypatch.setattr(inference, "paired_scores", lambda s, d: p)
    asked = {}
    for name in ("paired_bootstrap", "sign_flip", "shared_bootstrap", "weighted_contrast"):
        real = getattr(stats, name)
        monkeypatch.setattr(stats, name, lambda *x, _n=name, _r=real: asked.update({_n: next(v for v in x if isinstance(v, int))}) or _r(*x))
    assert inference.shared_unit_bootstrap(spark, "").count() == 10_000
    w = inference.weighted_contrast(spark, "").first()
    assert w.lower < w.delta
    f = inference.sign_flip(spark, "").first()
    assert 1 / 100_001 <= f.p <= 1
    inference.paired_bootstrap(spark, "")
    assert asked == {"paired_bootstrap": 10_000, "sign_flip": 100_000, "shared_bootstrap": 10_000, "weighted_contrast": 200_000}
    with pytest.raises(ValueError, match="no order statistic"):
        stats.paired_bootstrap(p, "domain", "qid", 30)


def test_resampling_equals_brute_force(spark):
    data = paired(spark)
    p = spark.createDataFrame(data, "s string, q string, a double, b double")
    by = {s: [d for _, d in sorted((hashlib.md5(x[1].encode()).hexdigest(), x[2] - x[3]) for x in data if x[0] == s)] for s in ("s0", "s1", "s2")}
    take = lambda s, r: [by[s][i] for part in stats.picks("w", r, s, len(by[s]), 7) for i in part]
    w = {"s0": 0.25, "s1": 0.25, "s2": 0.5}
    want = sorted(round(sum(w[s] * np.mean(take(s, r)) for s in by), 12) for r in range(60))
    fam = spark.createDataFrame([("s0", "x"), ("s1", "x"), ("s2", "y")], "unit string, family string")
    got = stats.weighted_contrast(p.withColumnsRenamed({"s": "unit", "q": "qid"}), fam, 60, quantile=0.05).first()
    assert (got.lower, got.previous) == pytest.approx((want[2], want[1]), abs=2e-9)
    u = stats.numbered(p, "s", "q").withColumn("d", F.col("a") - F.col("b"))
    one, two = ({(r.rep, r.s): r.d for r in stats.resampled(u, "s", "s", ["d"], 9, "w", held).collect()} for held in (1000, 5))
    assert len(one) == 27 and one == pytest.approx(two) and one[4, "s1"] == pytest.approx(sum(take("s1", 4)))
    many = np.bincount(np.concatenate([x for r in range(400) for x in stats.picks("u", r, "s", 50)]), minlength=50)
    assert many.sum() == 20_000 and len(many) == 50 and ((many - 400) ** 2 / 400).sum() < 94


def mix(x):
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = ((x ^ (x >> shift)) * factor) % 2**32
    return x ^ (x >> 16)


def halves(*parts):
    h = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16)


def test_draws_equal_the_sql_definition(spark):
    data = paired(spark)
    p = spark.createDataFrame(data, "s string, q string, a double, b double")
    by = {s: [d for _, d in sorted((hashlib.md5(x[1].encode()).hexdigest(), x[2] - x[3]) for x in data if x[0] == s)] for s in ("s0", "s1", "s2")}

    def pick(r, s, j, n):
        one, two = halves("b", r, s)
        return mix(mix((j + one) % 2**32) ^ two) * n >> 32

    want = [np.mean([np.mean([v[pick(r, s, j, len(v))] for j in range(len(v))]) for s, v in by.items()]) for r in range(8)]
    got = [x.delta for x in stats.bootstrap_deltas(p, "s", "q", 8, "b").orderBy("rep").collect()]
    assert got == pytest.approx(want, abs=1e-11)
    plan = stats.draw_plan(stats.numbered(p, "s", "q"), "s", 8, "b")
    assert [x.delta for x in stats.planned_deltas(plan, p, "s", "q").orderBy("rep").collect()] == pytest.approx(want, abs=1e-11)
    with pytest.raises(Exception, match="drawn for other units"):
        stats.planned_deltas(plan, p.where("q <> '%s'" % data[0][1]), "s", "q").collect()

    def sign(r, u):
        (one, two), (a, b) = halves("s", r // 32), halves(u)
        return 1 - 2 * (mix(mix(a ^ one) ^ b ^ two) >> r % 32 & 1)

    mean = lambda r: np.mean([np.mean([(x[2] - x[3]) * (sign(r, f"{s}|{x[1]}") if r >= 0 else 1) for x in data if x[0] == s]) for s in by])
    f = stats.sign_flip(p, "s", "q", 70, "s").first()
    assert f.p == pytest.approx((1 + sum(abs(mean(r)) >= abs(mean(-1)) - 1e-12 for r in range(70))) / 71, abs=1e-8)


def test_a_plan_of_draws_is_as_small_as_its_strata(spark):
    p = spark.createDataFrame(paired(spark), "s string, q string, a double, b double")
    plan = stats.draw_plan(stats.numbered(p, "s", "q"), "s", 500, "b")
    assert plan.count() == 3
    assert rows(stats.planned_deltas(plan, p, "s", "q")) == rows(stats.bootstrap_deltas(p, "s", "q", 500, "b"))
    with pytest.raises(Exception, match="drawn for other units"):
        stats.planned_deltas(plan.where("s <> 's1'"), p, "s", "q").collect()
