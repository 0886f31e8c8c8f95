"""Tokens, leakage, look-alikes."""

import random
import unicodedata

import pytest
import tiktoken

from millrace.llm import leakage as K
from millrace.llm import look_alikes as L
from millrace.llm import tokens as T

DOCS = "doc_id long, text string, id string, folded string, form string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def encoder():
    with open(T.VOCABULARY, "rb") as f:
        return T.Encoder(T.read_ranks(f.read()))


@pytest.fixture(scope="module")
def reference(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def noise(seed):
    r = random.Random(seed)
    pool = [range(32), range(0x300), range(0x3000), range(0x1F000, 0x1FA00), [0x20, 0xA0, 0x85, 0x2028, 0x1C, 0x3000]]
    return "".join(chr(r.choice(r.choice(pool))) for _ in range(r.randrange(60)))


def test_ids_equal_the_public_tokenizer(encoder, reference):
    texts = ["", " ", "Hello  world's\n\n x", "<|endoftext|> is text", "aaaaaaa" * 50, "naïve ĸ 漢字 🎉🎉", "\t\t  a", "x" * 3000 + "é" * 500, " " * 999 + "a", *[noise(i) for i in range(400)]]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == reference(t), repr(t)
    raw = tiktoken.Encoding("own", pat_str=T.PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=encoder.ranks, special_tokens={})
    assert raw.decode(encoder.encode(texts[2])) == texts[2]


def test_queue_pops_in_order():
    r = random.Random(1)
    q = T.RankQueue(50_000)
    want = {}
    for _ in range(3000):
        k, p = r.randrange(50_000), r.randrange(1000)
        q.push(k, p)
        want.setdefault(k, []).append(p)
    got = []
    while (x := q.pop()) is not None:
        got.append(x)
    assert got == [(k, sorted(v)) for k, v in sorted(want.items())] and not q.top and not any(q.low) and not any(q.mid)


def test_token_table(spark, reference):
    texts = ["a b", None, "", "a b", "longer " * 5000]
    got = {r.doc_id: list(r.ids) for r in T.token_ids(docs(spark, texts)).collect()}
    assert got == {i: reference(t) if t else [] for i, t in enumerate(texts)}
    assert T.token_ids(docs(spark, [])).count() == 0


def test_fold_and_what_stays_different():
    assert L.fold("ｆｕｌｌ　ｗｉｄｔｈ") == "full width"
    assert L.fold("café​  x﻿­") == "café  x"
    assert L.fold(unicodedata.normalize("NFD", "Việt ñ ü")) == "Việt ñ ü"
    for a, b in (("Text", "text"), ("cafe", "café"), ("x2", "x²"), ("a-b", "a–b"), ("a\nb", "a b"), ("a  b", "a b"), ("m.", "m")):
        assert L.comparable(L.fold(a)) != L.comparable(L.fold(b))
    assert L.fold("👩‍👧") != L.fold("👩👧")
    assert L.fold("می‌خواهم") != L.fold("میخواهم")
    assert L.fold("a‍b") == "ab"


def test_repairs_follow_the_dominant_script():
    assert L.repairs("rеɡistry")[0] == "registry"
    assert L.repairs("cтраниц")[0] == "страниц"
    assert L.repairs("plain") == [] and L.repairs("страниц") == [] and L.repairs("дfя") == []


def disguise(t, r):
    back = {}
    for c, x in L.TO_LATIN.items():
        if L.SCRIPT_OF[c] in ("Cyrillic", "Greek", "LatinVariant") and len(unicodedata.normalize("NFD", c)) == 1:
            back.setdefault(x, []).append(c)
    out = []
    for c in t:
        x = r.random()
        if x < 0.15 and c in back:
            c = r.choice(back[c])
        elif x < 0.25 and "!" <= c <= "~":
            c = chr(ord(c) + 0xFEE0)
        elif x < 0.35:
            c = unicodedata.normalize("NFD", c) + r.choice(["", "​", "⁠"])
        elif c == " " and x < 0.8:
            c = r.choice([" ", " ", " "])
        out.append(c)
    return "".join(out)


@pytest.mark.parametrize("bound", [L.TABLE_BOUND, 0])
def test_same_looking_finds_every_pair(spark, bound, monkeypatch):
    monkeypatch.setattr(L.consistent_texts, "__kwdefaults__", {"key": "doc_id", "table_bound": bound})
    r = random.Random(3)
    base = ["The scheduler drops a naïve request", "Это новая страница о поиске", "Ein schönes Beispiel für acc", "plain text stays", "版本v2中registry慢"]
    texts, look = [], []
    for i, b in enumerate(base):
        for _ in range(4):
            texts.append(disguise(b, r))
            look.append(i)
        texts.append(b)
        look.append(i)
    texts += [texts[0], None, "", " ", "​", "  ", "the scheduler drops a naïve request", "The scheduler drops a naive request"]
    look += [look[0], None, None, None, None, None, 90, 91]
    want = sorted((i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if look[i] is not None and look[i] == look[j] and texts[i] != texts[j])
    assert sorted(tuple(x) for x in L.same_looking(docs(spark, texts)).collect()) == want


    forms = {x.doc_id: x.form for x in L.consistent_texts(docs(spark, texts)).collect()}
    blank = {i for i, t in enumerate(texts) if t is None or not L.fold(t).strip()}
    assert want == [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if not {i, j} & blank and forms[i] == forms[j] and texts[i] != texts[j]]


@pytest.mark.parametrize("bound", [L.TABLE_BOUND, 0])
def test_forms_of_repeated_rows_and_null_keys(spark, bound):
    rows_ = [(1, "rеɡistry and сор"), (1, "rеɡistry and сор"), (1, "registry"), (None, "rеgistry"), (2, None), (3, "")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows_], "doc_id long, text string, id string")
    got = sorted(((x.doc_id, x.form) for x in L.consistent_texts(frame, table_bound=bound).collect()), key=repr)
    assert got == sorted([(1, "registry and cop"), (1, "registry and cop"), (1, "registry"), (None, "registry"), (2, None), (3, "")], key=repr)


def test_look_alikes_are_confusable_by_unicode_data(spark):
    """Against the data on confusable characters that comes with the JVM's Unicode library."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    other = {"Ԛ", "ӏ"}  # not in that data, or with another letter; of one shape in most fonts
    for table in L.LOOK_ALIKES.values():
        for c, x in table.items():
            assert c in other or checker.getSkeleton(c) == checker.getSkeleton(x), (c, x)
            assert L.TO_LATIN[c] == x


def test_a_text_shows_one_script():
    assert L.settled("сор") == L.settled("cop") == "cop"
    assert L.settled("cop и сop страница") == L.settled("сор и cop страница") == "сор и сор страница"
    assert L.settled("a plain text with сор and ꓮ") == "a plain text with cop and A"
    assert L.repairs("дfaя") == [] and L.repairs("дfая") == ["дfaя"]


def test_forms_are_equal_exactly_for_what_looks_the_same(spark):
    r = random.Random(8)
    pools = ["сор рос acc Аmok страница registry дfaя index ТОР", "one сорт of поиск в cope", "ᎪᏴ AB ꓐꓮ Ⲕ K ᴏ o"]
    texts = [" ".join(r.sample(p.split(), r.randrange(1, 4))) for p in pools for _ in range(12)]
    texts = [t for t in texts for _ in range(3)]
    texts = [disguise(t, r) if i % 3 else t for i, t in enumerate(texts)]
    skeleton = lambda t: L.TOKEN.sub(lambda m: L.bare_letters(m[0]), L.fold(t))
    forms = {x.doc_id: x.form for x in L.consistent_texts(docs(spark, texts)).collect()}
    for i in forms:
        for j in forms:
            assert (forms[i] == forms[j]) == (skeleton(texts[i]) == skeleton(texts[j])), (texts[i], texts[j])


def test_same_looking_with_many_copies(spark):
    texts = ["same text"] * 300 + ["same text", "other", "other"]
    assert sorted(tuple(x) for x in L.same_looking(docs(spark, texts)).collect()) == [(i, 300) for i in range(300)]
    assert L.same_looking(docs(spark, [])).count() == 0
    assert L.consistent_texts(docs(spark, [])).count() == 0


def test_winnowing_keeps_a_fingerprint_of_every_long_span():
    import numpy as np

    r = np.random.default_rng(1)
    for k, w in ((5, 8), (3, 4), (3, 1), (1, 1)):
        a, b = r.integers(0, 2**63, 60).astype(np.uint64), r.integers(0, 2**63, 80).astype(np.uint64)
        for _ in range(30):
            n = k + w - 1
            i, j = r.integers(0, 60 - n), r.integers(0, 80 - n)
            b2 = b.copy()
            b2[j : j + n] = a[i : i + n]
            assert set(K.winnow(a, k, w)[0].tolist()) & set(K.winnow(b2, k, w)[0].tolist())


@pytest.mark.parametrize("span", [1, 2, 3, 5, 8, 12, 20])
def test_classes_guarantee_every_length(span):
    got = K.classes(span)
    assert got[0][0] == span and got[-1][0] == 1
    assert all(k + w - 1 == least and k >= 1 and w >= 1 for least, k, w in got)


def test_words_of_blocks_equal_words_of_each_text(monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 200)
    r = random.Random(5)
    texts = [noise(i) + " ".join(r.choice(["alpha", "Straße", "İx", "ŉa", "ΐ", "v2"]) for _ in range(r.randrange(40))) for i in range(60)] + ["", "x" * 900, "ab " * 300, "\n\n"]
    got = {}
    seen = {}
    for first, chars, of, start, end, h in K.Words(K.letters()).of(texts):
        for i, s, e, x in zip(of.tolist(), start.tolist(), end.tolist(), h.tolist(), strict=True):
            got.setdefault(first + i, []).append(chars[s:e])
            assert seen.setdefault(chars[s:e], x) == x
    assert [got.get(i, []) for i in range(len(texts))] == [K.words_of(t) for t in texts]
    assert len(set(seen.values())) == len(seen)


def held(text, item, span=12):
    a, b = K.words_of(L.comparable(L.fold(text))), K.words_of(L.comparable(L.fold(item)))
    n = min(span, len(b))
    grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return bool(n) and any(tuple(a[i : i + n]) in grams for i in range(len(a) - n + 1))


@pytest.mark.parametrize("limit, span", [(1 << 23, 12), (0, 12), (1 << 23, 8), (1 << 23, 5), (1 << 23, 1)])
def test_leaks_match_brute_force(spark, limit, span):
    r = random.Random(4)
    lex = ["alpha", "beta", "gamma", "delta", "índex", "straße", "v2", "Ω", "node", "tier"]
    items = [" ".join(r.choice(lex) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 11, 12, 13, 30, 60)] + [None, "", "...", "alpha beta gamma node node node"]
    texts = []
    for t in items[:12]:
        w = t.split()
        for cut in (len(w), min(12, len(w)), max(1, min(12, len(w)) - 1)):
            s = r.randrange(len(w) - cut + 1)
            mid = disguise(" ".join(w[s : s + cut]).upper(), random.Random(cut)).replace("​", "")
            texts.append(" ".join(r.choice(lex) for _ in range(r.randrange(20))) + ", " + mid + "! " + " ".join(r.choice(lex) for _ in range(9)))
    texts += [None, "", "alpha", " ".join(lex) * 3000, " ".join(lex) * 3000]
    ev = spark.createDataFrame([(i + 100, t, "x") for i, t in enumerate(items + [items[5]])], "item_id long, text string, item string")
    got = sorted(tuple(x) for x in K.leaks(docs(spark, texts), ev, span, limit).collect())
    all_items = [*items, items[5]]
    want = sorted((i, j + 100) for i, t in enumerate(texts) for j, e in enumerate(all_items) if t and e and held(t, e, span))
    assert got == want
    assert K.leaks(docs(spark, []), ev).count() == 0
    assert K.leaks(docs(spark, texts[:3]), ev.limit(0)).count() == 0
