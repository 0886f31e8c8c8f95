import random
from collections import Counter

import pytest

from millrace.llm import related_splits as R
from tests.conftest import rows

SCHEMA = "qid string, source string, family string, key string, comp string, a string, root string"


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in data], SCHEMA)


def brute(data):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for q, s, f in data:
        if q is None:
            continue
        find(("q", q))
        s, f = (s or "").strip().lower(), (f or "").strip().lower()
        for k in ([("s", s)] if s not in ("", "unknown") else []) + ([("f", f)] if f else []):
            a, b = find(("q", q)), find(k)
            if a != b:
                parent[a] = b
    sets = {}
    for q in {r[0] for r in data if r[0] is not None}:
        sets.setdefault(find(("q", q)), []).append(q)
    return [sorted(v) for v in sets.values()]


def world(n, seed):
    r = random.Random(seed)
    return [(f"q{r.randrange(n // 2):04d}" if r.random() > 0.02 else None, r.choice([None, "", "unknown", " Src%d " % r.randrange(n // 3), "SRC%d" % r.randrange(n // 3)]), r.choice([None, "", "Fam%d" % r.randrange(n // 2), "fam%d " % r.randrange(n // 2)])) for _ in range(n)]


@pytest.mark.parametrize("bound", [1_000_000, 3])
def test_tied_pairs_match_brute_force(spark, bound):
    data = world(150, 1)
    want = sorted((v[0], x) for v in brute(data) for x in v[1:])
    got = rows(R.tied_pairs(frame(spark, data), merge_bound=bound))
    assert got == want


def test_hot_source_and_repeated_rows(spark):
    data = [(f"q{i:03d}", "hot", None) for i in range(100)] * 2 + [(f"z{i}", f"own{i}", None) for i in range(20)]
    got = rows(R.tied_pairs(frame(spark, data)))
    assert got == sorted(("q000", f"q{i:03d}") for i in range(1, 100))


def test_empty_and_null(spark):
    assert rows(R.tied_pairs(frame(spark, []))) == []
    assert rows(R.split_records(frame(spark, []))) == []
    assert rows(R.tied_pairs(frame(spark, [(None, "s", "f"), ("a", None, None)]))) == []
    assert [r[0] for r in rows(R.split_records(frame(spark, [(None, "s", "f"), ("a", None, None)])))] == ["a"]


def one_by_one(histogram, weights):
    total = sum(s * c for s, c in histogram)
    need = [total * w for w in weights]
    out = Counter()
    for s, c in sorted(histogram, reverse=True):
        for _ in range(c):
            i = max(range(len(need)), key=lambda i: (need[i], -i))
            need[i] -= s * sum(weights)
            out[s, i] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_greedy_counts_equal_one_by_one(seed):
    r = random.Random(seed)
    h = [(s, r.randrange(1, 40)) for s in r.sample(range(1, 60), r.randrange(1, 8))]
    w = r.choice([[80, 10, 10], [1, 1], [7, 2, 1], [100]])
    got = Counter()
    seen = Counter()
    for s, i, a, b in R.greedy_counts(h, w):
        assert a == seen[s] + 1
        seen[s] = b
        got[s, i] += b - a + 1
    assert got == one_by_one(h, w)
    assert seen == Counter(dict(h))


def test_splits_keep_sets_together_and_near_target(spark):
    data = world(600, 2)
    got = {r.qid: r.split for r in R.split_records(frame(spark, data)).collect()}
    assert set(got) == {q for q, _, _ in data if q is not None}
    sets = brute(data)
    for v in sets:
        assert len({got[q] for q in v}) == 1
    size = Counter(got.values())
    largest = max(map(len, sets))
    for name, w in R.SPLITS:
        assert abs(size[name] - len(got) * w / 100) <= largest


def test_splits_do_not_depend_on_layout(spark):
    data = world(200, 3)
    a = rows(R.split_records(frame(spark, data)))
    b = rows(R.split_records(frame(spark, data[::-1]).repartition(7)))
    assert a == b
