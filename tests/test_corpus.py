import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as X
from millrace.operators import decontam, dedup, graph, harvest, joins, vocabulary
from tests.conftest import rows


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def lines(n, seed, lex=40):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(lex)}" for _ in range(n)) for _ in range(1)][0]


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({" ".join(w)} if w else set())


def test_near_duplicate_classes_match_brute_force(spark):
    r = random.Random(1)
    texts = []
    for i in range(12):
        base = lines(60, i, 300).split()
        texts.append(" ".join(base))
        for _ in range(3):
            b = base.copy()
            for _ in range(r.randrange(3)):
                b[r.randrange(60)] = "x"
            texts.append(" ".join(b))
    texts += [texts[0]] * 3 + [None, "", "short one", "short one", "..."]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and texts[i] != "..." and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = [(i, find(i)) for i in range(len(texts))]
    got = sorted((r.id, r.class_id) for r in dedup.near_duplicate_classes(docs(spark, texts)).collect())
    assert got == want


def test_gate_counts_any_earlier_text(spark):
    a = [f"a{i}" for i in range(50)]
    texts = [" ".join(a), " ".join(a), " ".join(a[:45] + ["z"] * 5), " ".join(f"b{i}" for i in range(50)), "one two three four five six", "one two three four five seven", "unlike the others in all words", None]
    got = {r.id: r.status for r in dedup.diversity_gate(docs(spark, texts), "doc_id", "text").collect()}
    assert got == {0: "kept", 1: "exact", 2: "near", 3: "kept", 4: "kept", 5: "near", 6: "kept", 7: "kept"}
    rep = dedup.gate_report(dedup.diversity_gate(docs(spark, texts), "doc_id", "text"), min_kept=3).first()
    assert (rep.n, rep.exact, rep.near, rep.action, rep.kept, rep.dropped) == (8, 1, 2, "representatives", 5, False)
    assert (dedup.SKETCH, dedup.SHARED_DECONTAM, dedup.SHARED_GATE) == (32, 8, 16)


def test_query_hits_by_length(spark):
    prot = docs(spark, ["a b c d e", "what is a vector index in one word now then", "x y", ""])
    rows_ = docs(spark, ["A, b c d E!", "zz a b c d e yy ww qq uu", "q what is a vector index in one word w", "x y", "x y z", None, "", "b c d e f g"])
    got = {r.id: r.reason for r in decontam.query_hits(rows_, decontam.query_index(prot), "doc_id").collect()}
    assert got[0] == "exact" and got[1] == "contains" and got[2] == "near" and got[3] == "exact" and got[7] == "near"
    assert set(got) == {0, 1, 2, 3, 7}


def test_document_hits_need_one_item(spark):
    w = [f"w{i}" for i in range(60)]
    prot = spark.createDataFrame([(0, " ".join(w)), (1, " ".join(w[::-1]))], "item_id long, text string")
    idx = decontam.document_index(prot, "item_id")
    got = {r.id: (r.exact, r.near) for r in decontam.document_hits(docs(spark, [" ".join(w).upper(), " ".join(w[:50] + ["q"] * 9), " ".join(w[:9]), None]), idx, "doc_id").collect()}
    assert got[0] == (True, True) and got[1] == (False, True) and 2 not in got and 3 not in got


def test_copied_span_excludes_by_position(spark):
    df = spark.createDataFrame([("say a b c d e f again", "x a b c d e f y", "a b c d e f"), ("say a b c d e", "a b c d e x y a b c d e z", "a b c d e x"), ("none at all here now", "a b c d e", None)], "q string, s string, e string")
    got = [r.c for r in df.select(decontam.copied_span(F.col("q"), F.col("s"), 5, F.col("e")).alias("c")).collect()]
    assert got[:2] == [False, True]
    assert [r.c for r in df.select(decontam.copied_span(F.col("q"), F.col("s")).alias("c")).collect()] == [True, True, False]


@pytest.mark.parametrize("bound", [1_000_000, 2])
def test_components(spark, bound):
    r = random.Random(5)
    e = [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(45)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in e:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = sorted((n, find(n)) for n in parent)
    edges = spark.createDataFrame(e, "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in parent], "node string")
    assert rows(graph.labelled(nodes, edges, bound)) == want
    assert graph.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [1_000_000, 20])
def test_components_with_a_node_of_a_third_of_all_edges(spark, bound):
    e = [(f"f{i:03d}", "s:hot") for i in range(200)] + [(f"g{i:03d}", f"g{i + 1:03d}") for i in range(120)] + [(f"h{i}", f"i{i}") for i in range(80)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(e, "a string, b string"), bound).collect()}
    want = {f"f{i:03d}": "f000" for i in range(1, 200)} | {"s:hot": "f000"} | {f"g{i:03d}": "g000" for i in range(1, 121)} | {f"i{i}": f"h{i}" for i in range(80)}
    assert got == want


def test_no_task_gets_all_edges_of_a_node(spark):
    edges = spark.createDataFrame([(f"f{i:04d}", "s:hot") for i in range(4000)], "a string, b string")
    sizes = [r["count"] for r in edges.repartition(8, "a", "b").groupBy(F.spark_partition_id()).count().collect()]
    forest = graph._local_forests(edges.repartition(8, "a", "b"))
    assert max(r["count"] for r in forest.groupBy("part").count().collect()) <= max(sizes) + 1 < 1000


def test_hub_keys_tie_nothing(spark):
    x = spark.createDataFrame([(f"q{i}", "hub") for i in range(10)] + [("q0", "p"), ("q1", "p")], "n string, k string")
    got = {r.node: r.root for r in graph.families(x, "n", ["k"], hub=5).collect()}
    assert got["q1"] == "q0" and got["q2"] == "q2"
    s = graph.component_stats(graph.families(x, "n", ["k"]), large=5).first()
    assert (s.components, s.largest, s.above, s.top_sizes) == (1, 10, 1, "10")


def test_chunks(spark):
    text = "# One\n" + " ".join(f"w{i}" for i in range(20)) + "\n## Two\nshort text\n"
    got = harvest.chunks(docs(spark, [text, "", None, "plain"]), limit=10, overlap=2).orderBy("id", "chunk").collect()
    one = [r.text.split() for r in got if r.id == 0 and r.heading == "One"]
    assert [len(c) for c in one] == [10, 10, 6] and one[0][-2:] == one[1][:2] and one[-1][-1] == "w19"
    assert [r.text for r in got if r.heading == "Two"] == ["## Two\nshort text"]
    assert [r.text for r in got if r.id == 3] == ["plain"] and {r.id for r in got} == {0, 3}


def test_paragraph_packer_carries_on(spark):
    text = " ".join(["a"] * 30) + "\n" + " ".join(["b"] * 300) + "\nend"
    out = harvest.packed_paragraphs(docs(spark, [text, None, "", " \n "]), low=60, high=220).orderBy("chunk").collect()
    assert [len(c.text.split()) for c in out] == [220, 110] and [c.chunk for c in out] == [0, 1]


@pytest.mark.parametrize("low, high", [(1, 5), (4, 9), (9, 9), (12, 7)])
def test_paragraph_packer_places(spark, low, high):
    """Word by word: a chunk closes when it is full, or at a paragraph's end when it is long enough."""
    r = random.Random(low * 100 + high)
    texts = ["\n".join(" ".join(f"{p}.{i}" for i in range(r.choice([0, 1, 2, 5, 30]))) for p in range(r.randrange(12))) for _ in range(40)]
    want = []
    for d, t in enumerate(texts):
        now, n = [], 0
        for para in t.split("\n"):
            w = para.split()
            for at, x in enumerate(w, 1):
                now.append(x)
                if len(now) == high or (at == len(w) and len(now) >= low):
                    want.append((d, n, " ".join(now)))
                    now, n = [], n + 1
    assert rows(harvest.packed_paragraphs(docs(spark, texts), low=low, high=high)) == sorted(want, key=repr)


def test_headings_leads_views(spark):
    art = "First lead line here.\n\nHistory\n\nBody text.\n\nReferences\n\nx"
    got = rows(harvest.headings(docs(spark, [art, "A Short Lead\n\ntext"])))
    assert got == [(0, 2, "History")]
    lb = harvest.lead_and_body(docs(spark, [art, "no heading"])).orderBy("id").collect()
    assert lb[0].lead == "First lead line here." and lb[0].body.startswith("\nBody text.") and lb[1].body == ""
    d = spark.createDataFrame([(1, "A good title", "# Head of text\n" + " ".join(f"w{i}" for i in range(70))), (2, None, "one two three"), (3, "", None)], "doc_id long, title string, text string")
    v = harvest.document_views(d).collect()
    assert [x.kind for x in v if x.doc_id == 1] == ["title", "heading", "span_head"]
    assert [x.kind for x in v if x.doc_id == 2] == ["span_head"] and not [x for x in v if x.doc_id == 3]


def test_definitions_and_aliases(spark):
    found = harvest.definitions(docs(spark, ["We use channel state information (CSI) and the bank of England (BOE), not it (IT) or wrong words (XYZ)."]))
    assert [tuple(r)[1:] for r in found.collect()] == [("channel state information", "CSI"), ("bank of England", "BOE")]
    d = docs(spark, ["The write ahead log (WAL) is flushed by the writer. Now the write ahead log grows quickly today.", "A write ahead log (WAL) again."])
    lex = harvest.alias_lexicon(harvest.definitions(d))
    assert rows(lex) == [("write ahead log", "WAL", 2)]
    pairs = harvest.carrier_pairs(d, lex).collect()
    assert "Now the WAL grows quickly today." in {p.view_b for p in pairs} and all("(WAL)" not in p.view_a for p in pairs)


def test_definitions_at_the_edges(spark):
    texts = [
        "(CSI) first", "state information (CSI)", "a b (AB)", "Power of the Mind (POM)", "Power of the Mind (PM)", "Power of the (PT)", "of the map (OTM)",
        "graph 1st node (GN)", "deep neural networks (DNNs)", "net (NNET) neural net (NN)", None, "", "x" * 300 + " quick sort ( QS )", "Résumé Text (RT)", "one two (OT)(OT)", "long Abbreviations Are Refused Xxx Yyy Zzz Www Vvv (AARXYZWVU)", "Bank of the Mind (BM)", "Bank of the a Mind (BM)",
    ]
    got = [tuple(r) for r in harvest.definitions(docs(spark, texts)).orderBy("id").collect()]
    assert got == [(6, "of the map", "OTM"), (9, "neural net", "NN"), (12, "quick sort", "QS"), (13, "Résumé Text", "RT"), (14, "one two", "OT"), (16, "Bank of the Mind", "BM")]


def test_comment_blocks_and_pages(spark):
    code = "fn a() {}\n// This comment explains in many words what the function below does\n// and goes on for a second line of text.\nlet x = 1;\n// single\n"
    got = harvest.comment_blocks(docs(spark, [code]), "doc_id", "text").collect()
    assert len(got) == 1 and got[0].text.split("\n")[1].startswith("and goes on")
    assert rows(harvest.pages(spark.createDataFrame([("r", "a\fb")], "r string, t string"), "r", "t")) == [("r/page_0001", "a"), ("r/page_0002", "b")]


def test_replies(spark):
    long = "word " * 20
    d = spark.createDataFrame([("o", "t", "issue_opening", "q", 1), ("c0", "t", "issue_comment", long, 0), ("c1", "t", "issue_comment", "short", 2), ("c2", "t", "issue_comment", long, 3), ("c3", "t", "issue_comment", long, 3), ("x", None, "issue_opening", "q", 1)], "doc_id string, artifact_id string, kind string, text string, created_at long")
    assert rows(harvest.reply_answers(d, ["issue_opening"], ["issue_comment"])) == [("t", "o", "c2")]


def test_fuzzy_and_exclusion(spark):
    d = docs(spark, ["fix crash in segment optimizer loop", "fix crash in segment optimizer loops", "fix crash elsewhere", None])
    assert len(rows(joins.fuzzy_pairs(d, "doc_id", X.title_shape(F.col("text"))))) == 1
    v = spark.createDataFrame([(0,)], "x long")
    got = joins.excluded(d, [("a", "doc_id", v), ("b", "doc_id", v)]).collect()
    assert [r.reason for r in sorted(got, key=lambda r: r.doc_id)] == ["a", None, None, None]
    with pytest.raises(Exception, match="two labels"):
        joins.single_label(spark.createDataFrame([("g", "a"), ("g", "b")], "g string, l string"), "g", "l").collect()


def test_vocabulary(spark):
    q = spark.createDataFrame([("q1", "k8s pods fail", "d1", "x", 1.0), ("q2", "k8s pods fail", "d2", "x", 9.0), ("q3", "pods", "d1", "x", 3.0)], "qid string, text string, source_doc string, domain string, residual double")
    s = {r.term: r for r in vocabulary.discover(q).collect()}
    assert (s["pods"].docs, s["pods"].contexts, s["pods"].residual) == (1, 2, 2.0)
    st = spark.createDataFrame([("k8s", 5, 5, 9.0, "t"), ("pods", 5, 5, 8.0, "t"), ("nodes", 5, 5, 7.0, "t"), ("disks", 5, 5, 1.0, "g"), ("rare", 1, 1, 99.0, "g")], "term string, docs int, contexts int, score double, domain string")
    exp = spark.createDataFrame([("K8s", "kubernetes")], "abbreviation string, expansion string")
    got = vocabulary.select_terms(st, 4, 4, 3, 2, exp, ("disks",)).orderBy("pos").collect()
    assert [(r.term, r.reason) for r in got] == [("disks", "pinned"), ("kubernetes", "expanded"), ("pods", "ranked")]
    kw = {"a": {"heart": 4}, "b": {"court": 4}}
    assert [r.domain for r in vocabulary.keyword_domain(docs(spark, ["Heart", "heart court", "x"]), "doc_id", "text", kw).orderBy("doc_id").collect()] == ["a", "general", "general"]


def test_sketch_sizes(spark):
    x = docs(spark, [lines(200, 9)]).select(A.bottom(A.gram_keys(X.fingerprint_words(F.col("text"))), 32).alias("s")).first().s
    assert len(x) == 32
    assert defaultdict(int) == {}


def test_short_containment_takes_whole_items(spark, tmp_path):
    from millrace.plans.registry import queries

    seven = "one two three four five six seven"
    items = [("i3", "red green blue"), ("i4", "Red, green blue black"), ("i7", seven), ("i8", seven + " eight")]
    docs = [(1, "say one two three four five six now"), (2, f"say {seven} now"), (3, f"say {seven} eight"), (4, "a red green blue black b"), (5, "")]
    spark.createDataFrame([(*x, "query") for x in items], "item_id string, text string, role string").write.parquet(str(tmp_path / "eval_item.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(queries()["short_containment"](spark, str(tmp_path))) == [(2, "i7"), (3, "i7"), (4, "i4")]


def test_families_are_tied_by_positives_of_up_to_50_records(spark, tmp_path):
    from millrace.plans.registry import queries

    rows_ = [(f"{p}{i:02}", [p]) for p, n in (("a", 9), ("b", 50), ("c", 51)) for i in range(n)] + [("d", [])]
    spark.createDataFrame(rows_, "qid string, positive_ids array<string>").write.parquet(str(tmp_path / "query_spec.parquet"))
    got = {r.node: r.root for r in queries()["hub_pruned_families"](spark, str(tmp_path)).collect()}
    assert got == {q: q if q[0] in "cd" else q[0] + "00" for q, _ in rows_}


def test_terms_are_broadcast_and_texts_are_not(spark, tmp_path):
    cols = "doc_id long, artifact_id string, kind string, title string, text string"
    spark.createDataFrame([(1, "a", "k", "Index", "the index"), (2, "b", "k", None, "an index, a vector"), (3, None, "l", "x", None)], cols).write.parquet(str(tmp_path / "d"))
    found = vocabulary.inventory(spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([("INDEX",), ("vector",)], "term string"))
    assert rows(found) == [("index", 3, 2, 2, 1, 1), ("vector", 1, 1, 1, 0, 1)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan


def test_salted_joins_broadcast_no_copies_and_gates_share_their_work(spark, tmp_path):
    from millrace.session import salted_join

    small = spark.range(4).withColumn("v", F.lit(1))
    j = salted_join(spark.range(20).withColumn("s", F.col("id")), small, ["id"], ["s"])
    assert "BroadcastHashJoin" not in j._jdf.queryExecution().sparkPlan().toString() and j.count() == 4
    x = docs(spark, ["a b c d e f g h", "a b c d e f x y", "a b c d e f g h", "p q r s t u"])
    gates = dedup.diversity_gates(x, "doc_id", "text", [0.2, 0.9])
    assert [{r.status for r in g.collect()} for g in gates] == [{"kept", "near", "exact"}, {"kept", "exact"}]
    assert rows(gates[0]) == rows(dedup.diversity_gate(x, "doc_id", "text", share=0.2))
