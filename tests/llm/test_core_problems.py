"""Top items, stable sample, term frequency, mixing."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import mixing as M
from millrace.llm import stable_sample as S
from millrace.llm import term_frequency as T
from millrace.llm import top_items as I
from tests.conftest import rows

NAN, INF = float("nan"), float("inf")


def points(spark, data):
    return spark.createDataFrame([(*r, "c", 1) for r in data], "system string, qid string, doc_id string, score double, item string, g0 int")


def test_top_items_match_brute_force_with_a_hot_group(spark):
    r = random.Random(1)
    data = [("s", "hot" if i % 3 == 0 else f"q{r.randrange(40)}", f"d{r.randrange(60)}", r.choice([1.0, 2.0, 0.0, -0.0, r.random(), NAN, INF, -INF, None])) for i in range(4000)]
    data += data[:50] + [(None, "q", "d", 1.0), ("s", None, "d", 1.0), ("s", "q", None, 1.0)]
    best = defaultdict(dict)
    for s, q, d, x in data:
        if None not in (s, q, d, x) and abs(x) < INF:
            best[s, q][d] = max(best[s, q].get(d, -INF), x + 0.0)
    want = sorted((s, q, d, x) for (s, q), b in best.items() for d, x in sorted(b.items(), key=lambda e: (-e[1], e[0]))[:5])
    got = sorted(tuple(x) for x in I.top_items(points(spark, data).repartition(6), ["system", "qid"], "doc_id", "score").collect())
    assert got == want


def test_top_banked_and_empty(spark):
    bank = spark.createDataFrame([("d1",), ("d2",), ("d2",), (None,)], "doc_id string")
    data = [("s", "q", "d1", 1.0), ("s", "q", "d2", 1.0), ("s", "q", "gone", 9.0), ("s", "p", "gone", 2.0)]
    assert rows(I.top_banked(points(spark, data), bank).select("qid", "doc_id")) == [("q", "d1"), ("q", "d2")]
    assert I.top_banked(points(spark, []), bank).count() == 0
    assert I.top_banked(points(spark, data), bank.limit(0)).count() == 0


def specs(spark, data):
    return spark.createDataFrame([(*r, "x", 5) for r in data], "qid string, source string, delivery int, seq string, rn int")


def test_sample_is_stable_as_deliveries_arrive(spark):
    r = random.Random(2)
    data = [(f"q{r.randrange(900)}", r.choice(["A", " a", "b", None, "unknown", ""]), r.choice([1, 2, 3, 4])) for _ in range(1500)]
    before, sizes = set(), []
    for d in (1, 2, 3, 4):
        x = specs(spark, [t for t in data if t[2] <= d]).repartition(d + 1)
        now = {(t.source, t.qid) for t in S.stable_sample(x).collect()}
        assert before <= now
        before, sizes = now, [*sizes, len(now)]
    n = S.numbered_records(specs(spark, data)).collect()
    per = Counter(t.source for t in n)
    for s, c in per.items():
        assert sorted(t.seq for t in n if t.source == s) == list(range(c))
        got = sum(1 for t in before if t[0] == s)
        assert c // 64 * 8 <= got <= -(-c // 64) * 8
    assert sizes == sorted(sizes)


def test_sample_keeps_its_records_whatever_comes_later(spark):
    """Null, equal and earlier deliveries after the numbers were kept; then without an early record."""
    first = [(f"q{i}", "a" if i % 5 else "b", 1 + i % 3) for i in range(640)]
    kept = S.numbered_records(specs(spark, first))
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    before = {(t.source, t.qid) for t in S.sample_numbered(kept).collect()}
    assert before == {(t.source, t.qid) for t in S.stable_sample(specs(spark, first)).collect()}
    late = [("n1", "a", None), ("n2", " A", 0), ("n3", "b", 1), ("n4", "c", -5)] + [(f"z{i}", "a", i % 4 or None) for i in range(300)]
    numbers = S.numbered_records(specs(spark, first[40:] + late), kept)
    after = {(t.source, t.qid) for t in S.stable_sample(specs(spark, first[40:] + late), kept).collect()}
    assert before <= after and len(after) > len(before)
    got = numbers.collect()
    assert {(t.source, t.qid): t.seq for t in kept.collect()}.items() <= {(t.source, t.qid): t.seq for t in got}.items()
    for s in ("a", "b", "c"):
        n = sorted(t.seq for t in got if t.source == s)
        assert n == list(range(len(n)))
    assert rows(S.numbered_records(specs(spark, []), kept)) == rows(kept)


def test_sample_edge_cases(spark):
    assert S.stable_sample(specs(spark, [])).count() == 0
    n = rows(S.numbered_records(specs(spark, [(None, "a", 1), ("q", None, None), ("q", "unknown", 3)])))
    assert n == [("", "q", 0, 0)]


def stats(spark, data):
    return spark.createDataFrame([(*r, "e") for r in data], "term string, docs array<string>, contexts array<string>, e string")


def test_double_reports_count_once(spark):
    data = [(1, "big", ["a", "b"], ["q"]), (1, " BIG", ["a", "b"], ["q", "p"]), (1, "big", ["a"], None), (2, "big", ["a", "a"], ["q"]), (None, "big", ["z"], []), (None, "big", ["z"], [])]
    x = spark.createDataFrame([(*r, 1) for r in data], "shard int, term string, docs array<string>, contexts array<string>, e int")
    r = T.term_frequency(x).first()
    assert (r.docs, r.contexts, r.doc_reports, r.context_reports) == (3, 2, 4, 3)
    assert (r.doc_occurrences, r.context_occurrences) == (9, 4)


def test_term_frequency(spark):
    data = [(" Big ", ["a", "b", None, "a"], ["q"]), ("big", ["c", "a"], None), ("one", ["a"], []), ("none", None, ["q", "q"]), ("", [], None), (None, ["z"], ["q"])] + [("all", [f"d{i}"], ["q"]) for i in range(60)]
    got = {r.term: (r.docs, r.contexts, r.doc_occurrences, r.context_occurrences, r.mark) for r in T.term_frequency(stats(spark, data)).collect()}
    assert got["big"] == (3, 1, 5, 1, None)
    assert got["one"] == (1, 0, 1, 0, "rare")
    assert got["none"] == (0, 1, 0, 2, "rare")
    assert got[""] == (0, 0, 0, 0, "rare")
    assert got["all"] == (60, 1, 60, 60, "common")
    assert len(got) == 5
    assert rows(T.marked_terms(stats(spark, data))) == [("", "rare"), ("all", "common"), ("none", "rare"), ("one", "rare")]
    assert T.marked_terms(stats(spark, [])).count() == 0 and T.term_frequency(stats(spark, [])).count() == 0


def reachable(counts, budget):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= budget}
    return max(sums)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 6), max_size=5), st.integers(0, 80))
def test_knapsack_reaches_the_best_sum(counts, budget):
    took = M.knapsack(budget, counts)
    assert all(took[n] <= counts[n] for n in took)
    assert sum(n * k for n, k in took.items()) == reachable(counts, budget)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), max_size=6), st.integers(0, 900), st.integers(1, 4))
def test_fill_reaches_the_best_size(counts, budget, cap):
    uses = M.fill(budget, counts, cap)
    assert all(0 <= k <= counts[n] * cap for n, k in uses.items())
    drawn = sum(n * k for n, k in uses.items())
    assert drawn == reachable({n: c * cap for n, c in counts.items() if n}, budget)
    total = sum(n * c for n, c in counts.items())
    if 0 in counts and total:
        assert uses[0] == counts[0] * min(cap, budget // total)


@pytest.mark.parametrize("cap", [1, 4])
def test_fill_reaches_the_best_size_of_large_histograms(cap):
    r = random.Random(cap)
    for _ in range(200):
        counts = {r.randrange(1, 90): r.randrange(1, r.choice([3, 200])) for _ in range(r.randrange(1, 12))}
        budget = r.randrange(cap * sum(n * c for n, c in counts.items()) + 5)
        reach = 1
        for n, c in counts.items():
            left, k = c * cap, 1
            while left:
                k = min(k, left)
                reach |= reach << n * k
                left, k = left - k, 2 * k
        best = (reach & ((1 << budget + 1) - 1)).bit_length() - 1
        uses = M.fill(budget, counts, cap)
        assert sum(n * k for n, k in uses.items()) == best and all(k <= cap * counts[n] for n, k in uses.items())


def test_fill_keeps_the_proportions_of_the_lengths():
    counts = {n: 1000 for n in range(5, 60)}
    total = sum(n * c for n, c in counts.items())
    uses = M.fill(total // 3 + 7, counts, 1)
    assert sum(n * k for n, k in uses.items()) == total // 3 + 7
    assert all(abs(k - 1000 / 3) < 70 for k in uses.values())


def test_mix_draws_what_the_plan_says(spark):
    items = spark.createDataFrame([("a" if i % 2 else "b", f"i{i}", i % 5 + 1, "x") for i in range(60)] + [(None, "n", 1, "x"), ("a", None, 1, "x"), ("a", "z", None, "x")], "source string, id string, length int, rn string")
    targets = spark.createDataFrame([("m", "a", 137), ("m", "b", 20), ("k", "a", 10_000), ("k", "none", 5), (None, "a", 3)], "mix string, source string, budget int")
    plan = M.mix_plan(items, targets)
    shares = {(r.mix, r.source): r for r in M.mix_shares(plan).collect()}
    draws = M.mix_draws(items, plan).collect()
    assert max(d.times for d in draws) <= 4
    size = {f"i{i}": i % 5 + 1 for i in range(60)}
    got = Counter()
    for x in draws:
        got[x.mix, x.source] += x.times * size[x.id]
    assert got["m", "a"] == shares["m", "a"].drawn == 137
    assert got["m", "b"] == shares["m", "b"].drawn == 20
    assert shares["k", "a"].short and got["k", "a"] == 4 * shares["k", "a"].at_hand
    assert shares["k", "none"].at_hand == 0 and shares["k", "none"].short
    assert abs(shares["m", "a"].reached_share - 137 / 157) < 1e-6
    again = M.mix_draws(items.repartition(5), M.mix_plan(items.repartition(3), targets)).collect()
    assert sorted(map(tuple, draws)) == sorted(map(tuple, again))


def test_overdrawn_cases(spark):
    q = [("q1", "General", "", "", 1, "t"), ("q1", "general ", "", "", 2, "t"), ("q2", None, "", "", 1, None), ("q3", "coverage", None, None, 1, ""), ("q4", "alias", "p", "a", 1, "t"), ("q5", "ALIAS", "p", "b", 1, "t"), ("q6", "alias", "half", "a", 1, "t")]
    specs_ = spark.createDataFrame(q, "qid string, bucket string, alias_pair_id string, alias_view string, delivery int, text string")
    runs = spark.createDataFrame([("ok", 1, 7, 4, 1, 1), ("over", 1, 15, 5, 0, 5), ("over", 1, 15, 5, 0, 5), ("bad", 9, 9, 9, 9, 1), ("neg", 9, 8, 9, -1, 0), ("null", 9, 9, 9, None, 0), ("nosteps", None, 9, 9, 0, 0)], "run_id string, steps int, batch int, general_views int, coverage_views int, alias_pairs int")
    assert rows(M.overdrawn(specs_, runs)) == [("over", "alias"), ("over", "general")]
    assert M.overdrawn(specs_, runs.limit(0)).count() == 0
    assert rows(M.overdrawn(specs_.limit(0), runs.where("run_id = 'ok'"))) == [("ok", "alias"), ("ok", "coverage"), ("ok", "general")]


def test_bucket_items_count_tokens(spark):
    q = [("q1", "general", "", "", 1, "one two"), ("q1", "general", "", "", 2, "one two three"), ("q2", "coverage", None, None, 1, ""), ("q4", "alias", "p", "a", 1, "x y"), ("q5", "alias", "p", "b", 1, None), ("q6", "alias", "half", "b", 1, "x"), (None, "general", "", "", 1, "x")]
    got = rows(M.bucket_items(spark.createDataFrame(q, "qid string, bucket string, alias_pair_id string, alias_view string, delivery int, text string")))
    assert got == [("alias", "p", 2), ("coverage", "q2", 0), ("general", "q1", 3)]


def test_overdrawn_comes_from_the_whole_mixture(spark, tmp_path):
    """The report of p6_found is a filter on the plan by exact token lengths: its lengths, budgets and draws agree."""
    r = random.Random(3)
    q = [(f"q{i}", r.choice(["general", "coverage "]), "", "", 1, " ".join(r.choice(["alpha", "tokenisation", "x"]) for _ in range(r.randrange(9)))) for i in range(80)]
    specs_ = spark.createDataFrame(q, "qid string, bucket string, alias_pair_id string, alias_view string, delivery int, text string")
    runs = spark.createDataFrame([("r", 30, 9, 4, 5, 0), ("s", 99, 9, 4, 5, 0)], "run_id string, steps int, batch int, general_views int, coverage_views int, alias_pairs int")
    items, plan = M.mixed_runs(specs_, runs)
    length = {(x.source, x.id): x.length for x in items.collect()}
    shares = {(x.mix, x.source): x for x in M.mix_shares(plan).collect()}
    drawn = Counter()
    for x in M.mix_draws(items, plan).collect():
        assert 1 <= x.times <= 4
        drawn[x.mix, x.source] += x.times * length[x.source, x.id]
    for (m, s), x in shares.items():
        have = Counter(n for (b, _), n in length.items() if b == s and n)
        assert drawn[m, s] == x.drawn == reachable({n: 4 * c for n, c in have.items()}, x.budget)
        assert x.overdrawn == (x.asked > 4 * sum(1 for b, _ in length if b == s))
    assert rows(M.overdrawn(specs_, runs)) == sorted((m, s) for (m, s), x in shares.items() if x.overdrawn)


def test_marked_terms_do_the_full_count(spark, tmp_path):
    stats(spark, [("a", ["d1"], ["c1", "c1"])]).write.parquet(str(tmp_path / "t"))
    plan = T.marked_terms(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "contexts:array" in plan
