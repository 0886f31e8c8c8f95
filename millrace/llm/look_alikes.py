"""One consistent form for text that looks the same but differs in its characters.

Folded for every text: width variants, accents written apart, characters that
show nothing and other space characters. Look-alike letters are repaired by
script, token by token: the dominant script of a token is found, and look-alikes
of other scripts are substituted if the token mixes scripts and the result is a
word of the corpus. A token of look-alikes alone has no script of its own, so
no vocabulary can tell which one it is of; such tokens take the dominant script
of their text. Case, missing accents, raised digits, punctuation and line breaks
stay as they are.

Two texts have one form exactly if they look the same: a letter without
look-alikes fixes the script of its token, so spellings of that token are
repaired alike, and all other tokens are settled by what the whole text shows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import salted_join, stage

# Letters that look like a Latin letter of the same case, by script, from the public Unicode data on
# confusable characters; those that are only similar (as Greek alpha, Cyrillic ghe) are left out.
LOOK_ALIKES = {
    "Cyrillic": dict(zip("АВЕЅІЈКМНОРСТУХԚԜҮѴԌӀаеѕіјорсухһԁԛԝӏѵүѡ", "ABESIJKMHOPCTYXQWYVGlaesijopcyxhdqwlvyw", strict=True)),
    "Greek": dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϜϺονρϲϳ", "ABEZHIKMNOPTYXCJFMovpcj", strict=True)),
    "Armenian": dict(zip("ՕՍՏօսհոցզ", "OUSouhngq", strict=True)),
    "Cherokee": dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᎡᏚᏕᎢᏙᎳᏔᎩᎽᏃꮯꮁꮪꮩꮃꮓ", "ABCDEGHJKLMPRRSSTVWWYYZcrsvwz", strict=True)),
    "Coptic": dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⳐⲟⲣⲥ", "HIKMNOPCTYXLopc", strict=True)),
    "Lisu": dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ", strict=True)),
    "LatinVariant": dict(zip("ɡɑⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯᴄᴏꜱᴜᴠᴡᴢ", "gaivxlcdmIVXLCDMcosuvwz", strict=True)),
}
# Characters that show nothing, beside those of category Cf, and those of Cf that do show.
SHOW_NOTHING = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
FORMAT_THAT_SHOWS = "؀؁؂؃؄؅۝܏࢐࢑࣢"
LINE_CONTROLS = "\t\n\v\f\r\u0085"
JOINERS = "‌‍"

#: Latin letter for each look-alike, and for each other script the letter that looks like a Latin one.
TO_LATIN = {c: x for table in LOOK_ALIKES.values() for c, x in table.items()}
SCRIPT_OF = {c: s for s, table in LOOK_ALIKES.items() for c in table}
FROM_LATIN = {s: {x: c for c, x in reversed(table.items())} for s, table in LOOK_ALIKES.items() if s != "LatinVariant"}

# words of the scripts that have look-alikes; letters of other scripts, as Han, end a token
_NAMES = tuple(n for n in LOOK_ALIKES if n != "LatinVariant")
TOKEN = regex.compile(r"[\p{Script=Latin}" + "".join(rf"\p{{Script={n}}}" for n in _NAMES) + r"\p{M}]+")
# look-alikes and the letters that are a look-alike with accents
_SUSPECT = re.compile("[" + "".join(chr(i) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and any(c in TO_LATIN for c in unicodedata.normalize("NFD", chr(i)))) + "]")
_LATIN = regex.compile(r"\p{Script=Latin}")
_SCRIPTS = {s: regex.compile(rf"\p{{Script={s}}}") for s in _NAMES}
_ASCII_WORDS = re.compile("[A-Za-z]+")
_ASCII_FOLDED = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
#: Entries of a repair table that are sent to every task; a larger one is joined.
TABLE_BOUND = 200_000


def _fold_map() -> dict[int, str | None]:
    """Translation of single characters: nothing for invisible ones, a space for spaces, the plain form for width variants."""
    out: dict[int, str | None] = {}
    for i in (*range(0x3400), *range(0xFE00, 0x10000), *range(0x1BCA0, 0x1BCB0), *range(0x1D170, 0x1D180), *range(0xE0000, 0xE0200)):
        c = chr(i)
        kind = unicodedata.category(c)
        how = unicodedata.decomposition(c)
        if c in SHOW_NOTHING or (kind == "Cf" and c not in FORMAT_THAT_SHOWS and c not in JOINERS) or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF or (kind == "Cc" and c not in LINE_CONTROLS):
            out[i] = None
        elif kind == "Zs" and c not in "  ":
            out[i] = " "
        elif how.startswith(("<wide>", "<narrow>")):
            out[i] = unicodedata.normalize("NFKC", c) if i != 0x3000 else " "
    return out


FOLD = _fold_map()
# a joiner matters between emoji and after letters of scripts that join
_JOIN = regex.compile(r"(?<![\p{Extended_Pictographic}️\U0001F3FB-\U0001F3FF؀-෿က-႟])[‌‍]+|[‌‍]+(?![\p{Extended_Pictographic}؀-෿က-႟])")


def fold(text: str) -> str:
    """Width, accents, invisible characters and spaces in one form; all else unchanged."""
    if text.isascii():
        return _ASCII_FOLDED.sub("", text)
    if "‌" in text or "‍" in text:
        text = _JOIN.sub("", text)
    return unicodedata.normalize("NFC", text.translate(FOLD))


def bare_letters(token: str) -> str:
    """The token with every look-alike as its Latin letter: equal for tokens that look the same."""
    if not _SUSPECT.search(token):
        return token
    return unicodedata.normalize("NFC", "".join(TO_LATIN.get(c, c) for c in unicodedata.normalize("NFD", token)))


def scripts(token: str) -> dict[str, int]:
    """Letters of the token by script; look-alikes that are variants of Latin letters count apart."""
    out: dict[str, int] = {}
    for c in token:
        if not c.isalpha() and unicodedata.category(c) != "Nl":
            continue
        s = "LatinVariant" if SCRIPT_OF.get(c) == "LatinVariant" else next((n for n, p in _SCRIPTS.items() if p.match(c)), None) or ("Latin" if _LATIN.match(c) else "Other")
        out[s] = out.get(s, 0) + 1
    return out


def repairs(token: str) -> list[str]:
    """What a token of mixed scripts may stand for, the dominant script first; [] if it is of one script.

    Of equally frequent scripts Latin comes first, then by name. Letters that
    have no look-alike in a script rule that script out. If every script is, the
    token may only stand for itself with each look-alike as its Latin letter.
    """
    t = unicodedata.normalize("NFD", token)
    found = scripts(t)
    if len(found) < 2:
        return []
    out = []
    for s in sorted({*found, "Latin"} - {"LatinVariant", "Other"}, key=lambda s: (-found.get(s, 0), s != "Latin", s)):
        made = []
        for c in t:
            own = "Latin" if _LATIN.match(c) and SCRIPT_OF.get(c) != "LatinVariant" else SCRIPT_OF.get(c)
            if own == s or (own is None and (not c.isalpha() or s == "Latin" and _LATIN.match(c) or s in _SCRIPTS and _SCRIPTS[s].match(c))):
                made.append(c)
                continue
            latin = c if own == "Latin" else TO_LATIN.get(c)
            to = latin if s == "Latin" else FROM_LATIN[s].get(latin or "")
            if to is None:
                break
            made.append(to)
        else:
            out.append(unicodedata.normalize("NFC", "".join(made)))
    return out or [b for b in (bare_letters(token),) if b != token]


def word_key(token: str) -> str:
    return token.casefold()


def is_mixed(token: str) -> bool:
    return len(scripts(unicodedata.normalize("NFD", token))) > 1


def remembered(f: Callable, most: int = 200_000) -> Callable:
    """``f`` of one string, computed once for each of the strings a task meets, up to a bound."""
    known: dict[str, object] = {}

    def once(x: str) -> object:
        y = known.get(x, known)
        if y is known:
            if len(known) >= most:
                known.clear()
            known[x] = y = f(x)
        return y

    return once


def mixed_tokens(text: str, mixed: Callable[[str], bool] = is_mixed) -> list[str]:
    """The distinct tokens of folded text that mix scripts, look-alikes being among them."""
    if text.isascii() or not _SUSPECT.search(text):
        return []
    return sorted(t for t in set(TOKEN.findall(text)) if not t.isascii() and mixed(t))


def repaired(text: str, table: dict[str, str]) -> str:
    """Folded text with the tokens of ``table`` replaced."""
    if text.isascii() or not table or not _SUSPECT.search(text):
        return text
    return TOKEN.sub(lambda m: table.get(m[0], m[0]), text)


def _of_no_script(token: str) -> bool:
    """Whether every letter of the token is a Latin letter or looks like one."""
    return all(c in TO_LATIN or _LATIN.match(c) for c in unicodedata.normalize("NFD", token) if c.isalpha() or c in TO_LATIN)


def as_latin(token: str) -> str:
    """A token made of look-alikes and Latin letters alone with Latin letters, any other as it is."""
    return bare_letters(token) if _of_no_script(token) else token


def comparable(text: str, latin: Callable[[str], str] = as_latin) -> str:
    """The form for comparing passages of different texts: tokens made of look-alikes alone stand as Latin."""
    if text.isascii() or not _SUSPECT.search(text):
        return text
    return TOKEN.sub(lambda m: latin(m[0]), text)


def text_script(text: str) -> str:
    """The script that a text shows: that of most letters without a Latin look-alike, unless letters that this script can't show are as many.

    Depends only on what the text looks like; 'Latin' in case of doubt.
    """
    found: dict[str, int] = {}
    latin: dict[str, int] = {}
    for x, n in Counter(text).items():
        for c in unicodedata.normalize("NFD", x):
            if c in TO_LATIN or c.isascii():
                c = TO_LATIN.get(c, c)
                if c.isalpha():
                    latin[c] = latin.get(c, 0) + n
            elif c.isalpha():
                s = next((name for name, p in _SCRIPTS.items() if p.match(c)), None)
                if s is not None:
                    found[s] = found.get(s, 0) + n
    if not found:
        return "Latin"
    s = min(found, key=lambda name: (-found[name], name))
    return s if found[s] > sum(n for c, n in latin.items() if c not in FROM_LATIN[s]) else "Latin"


def as_script(script: str, token: str) -> str:
    """A token made of look-alikes and Latin letters alone in letters of a script, or in Latin letters where the script lacks one; any other as it is."""
    if not _of_no_script(token):
        return token
    bare, table = bare_letters(token), FROM_LATIN[script]
    letters = unicodedata.normalize("NFD", bare)
    if all(c in table for c in letters if c.isalpha()):
        return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in letters))
    return bare


def settled(text: str, known: dict[str, Callable[[str], str]] | None = None) -> str:
    """The consistent form of a repaired text: tokens made of look-alikes alone take the script of the text.

    ``known`` keeps what was found out about tokens, by script.
    """
    if text.isascii() or not _SUSPECT.search(text):
        return text
    known = {} if known is None else known
    s = text_script(text)
    if s not in known:
        known[s] = remembered(as_latin if s == "Latin" else lambda t: as_script(s, t))
    return TOKEN.sub(lambda m: known[s](m[0]), text)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _in_parts(b, [pa.array([None if t is None else fold(t) for t in b.column(1).to_pylist()], pa.string())])


def _in_parts(b: pa.RecordBatch, more: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([b.column(0), *more], ["id", *[f"c{i}" for i in range(len(more))]])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over folded texts: (token, result, word, rank) for what mixed tokens may stand for, and a null token for each distinct word."""
    mixed: set[str] = set()
    seen: set[str] = set()
    mixes = remembered(is_mixed)
    rows: list[tuple[str | None, str | None, str, int]] = []
    for b in batches:
        for t in b.column(1).to_pylist():
            if t is None:
                continue
            if t.isascii():
                words = set(_ASCII_WORDS.findall(t))
            else:
                words = set(TOKEN.findall(t))
                new = [x for x in mixed_tokens(t, mixes) if x not in mixed]
                mixed.update(new)
                rows += [(x, r, word_key(r), i) for x in new for i, r in enumerate(repairs(x))]
            words = {word_key(x) for x in words} - seen
            seen |= words
            rows += [(None, None, x, 0) for x in words]
        if len(seen) > 500_000:  # the distinct below makes up for it
            seen.clear()
        if len(mixed) > 500_000:
            mixed.clear()
        if len(rows) > 10_000:
            yield _rows(rows)
            rows = []
    yield _rows(rows)


def _rows(rows: list[tuple[str | None, str | None, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.string()) for i in range(3)], pa.array([r[3] for r in rows], pa.int32())], ["token", "result", "word", "rank"])


def folded_texts(texts: DataFrame, key: str) -> DataFrame:
    """(key, folded) of every row; null stays null."""
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_folded, f"id {kind}, c0 string").select(F.col("id").alias(key), F.col("c0").alias("folded"))


def repair_table(folded: list[DataFrame]) -> DataFrame:
    """(token, result) for the tokens of mixed scripts in all ``folded`` texts that can be repaired.

    The result is the first, by dominance of its script, that is a word of the
    corpus: an unmixed token somewhere (in any letter case), or what another
    mixed token also stands for.
    """
    both = folded[0].select(F.lit(0).alias("k"), "folded")
    for f in folded[1:]:
        both = both.union(f.select(F.lit(0).alias("k"), "folded"))
    found = stage(both.mapInArrow(_tokens, "token string, result string, word string, rank int").distinct(), "tokens")
    mixed = found.where("token is not null")
    known = found.where("token is null").select("word").distinct()
    agreed = mixed.where("rank = 0").groupBy("word").agg(F.countDistinct("token").alias("n")).where("n > 1").select("word")
    ok = mixed.join(known.join(mixed.select("word").distinct(), "word", "left_semi").union(agreed).distinct(), "word", "left_semi")
    return ok.groupBy("token").agg(F.min(F.struct("rank", "result")).alias("m")).select("token", "m.result")


def _apply(table, passages: bool):
    """mapInArrow function: (id, folded[, replacements]) -> (id, finished form); ``table`` is a broadcast table, or None where rows bring their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = None if table is None else table.value
        known: dict[str, Callable[[str], str]] = {}
        latin = remembered(as_latin)
        finish = (lambda t: comparable(t, latin)) if passages else (lambda t: settled(t, known))
        for b in batches:
            own = [dict(x or []) for x in b.column(2).to_pylist()] if common is None else None
            forms = [None if t is None else finish(repaired(t, common if own is None else own[i])) for i, t in enumerate(b.column(1).to_pylist())]
            yield from _in_parts(b, [pa.array(forms, pa.string())])

    return run


def _mixed_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mixes = remembered(is_mixed)
    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        pairs = [(*k, x) for k, t in zip(keys, b.column(2).to_pylist(), strict=True) if t for x in mixed_tokens(t, mixes)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array([p[2] for p in pairs], pa.string())], ["h1", "h2", "token"])


def with_repairs(folded: DataFrame, table: DataFrame, key: str, table_bound: int = TABLE_BOUND) -> tuple[DataFrame, object]:
    """(rows (id, folded[, own]), broadcast table or None): what ``_apply`` needs to repair every row.

    A table of at most ``table_bound`` entries goes to every task. A larger one is
    joined to the mixed tokens of each distinct text instead. Both give the same
    forms, also for repeated rows and null keys.
    """
    x = folded.select(F.col(key).alias("id"), "folded")
    head = table.limit(table_bound + 1).collect()  # bounded
    if len(head) <= table_bound:
        return x, folded.sparkSession.sparkContext.broadcast({r.token: r.result for r in head})
    hashed = x.withColumns({"h1": F.xxhash64("folded"), "h2": F.xxhash64(F.lit(1), "folded")})
    tokens = hashed.select("h1", "h2", "folded").mapInArrow(_mixed_of, "h1 long, h2 long, token string").distinct()
    own = salted_join(tokens, table, ["token"], ["h1"]).groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("token", "result"))).alias("own"))  # the tokens of one text
    return salted_join(hashed, own, ["h1", "h2"], ["id"], "left").select("id", "folded", "own"), None


def consistent(folded: DataFrame, table: DataFrame, key: str, table_bound: int = TABLE_BOUND, passages: bool = False) -> DataFrame:
    """(key, form) of every folded text, repaired by ``table`` of (token, result).

    With ``passages`` the form is one for comparing parts of different texts:
    tokens of look-alikes alone stand as Latin whatever the rest of the text.
    """
    kind = folded.schema[key].dataType.simpleString()
    x, common = with_repairs(folded, table, key, table_bound)
    done = x.mapInArrow(_apply(common, passages), f"id {kind}, c0 string")
    return done.select(F.col("id").alias(key), F.col("c0").alias("form"))


def consistent_texts(documents: DataFrame, *others: DataFrame, key: str = "doc_id", table_bound: int = TABLE_BOUND) -> DataFrame:
    """(key, form) of every document, ``others`` being further texts that count as corpus.

    Null texts have null forms, empty ones stay empty, repeated rows stay.
    """
    folded = stage(folded_texts(documents, key), "folded")
    table = stage(repair_table([folded, *[o.select("folded") for o in others]]), "repairs")
    return consistent(folded, table, key, table_bound)


def same_looking(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): documents whose texts look the same but are different strings, each pair once.

    Blank texts, also those of characters that show nothing, and null texts or
    ids take no part; a doc_id with several equal rows counts once.

    Documents of one string are one class; classes of one form are paired before
    their documents are, so a text with very many copies costs only the pairs
    that belong to the result.
    """
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    forms = consistent_texts(docs)
    # the string as it was, and its form, as fingerprints of 128 bits
    as_was = docs.select("doc_id", F.xxhash64("text").alias("s1"), F.xxhash64(F.lit(1), "text").alias("s2")).distinct()
    same = forms.where(F.trim("form", F.lit(" \t\r\n")) != "").select("doc_id", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(1), "form").alias("f2")).distinct()
    return class_pairs(stage(same.join(as_was, "doc_id"), "classes"))


def class_pairs(members: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b) of ``members`` (doc_id, f1, f2, s1, s2) with equal f and different s.

    Only forms with several strings go on. Neither a form of very many strings
    nor a string of very many copies is one task's: both joins are salted.
    """
    classes = members.groupBy("f1", "f2", "s1", "s2").agg(F.count(F.lit(1)).alias("n"))
    many = classes.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("f1", "f2")
    part = stage(salted_join(members.select("doc_id", "f1", "f2", "s1", "s2"), many, ["f1", "f2"], ["doc_id"], "left_semi"), "members")
    classes = part.select("f1", "f2", "s1", "s2").distinct()
    other = classes.select("f1", "f2", F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    pairs = salted_join(classes, other, ["f1", "f2"], ["s1", "s2"]).where("s1 < t1 or s1 = t1 and s2 < t2").select("s1", "s2", "t1", "t2", "f1", "f2")
    left = salted_join(part, pairs, ["f1", "f2", "s1", "s2"], ["doc_id"]).select(F.col("doc_id").alias("a"), "f1", "f2", "t1", "t2")
    right = part.select(F.col("doc_id").alias("b"), "f1", "f2", F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    both = salted_join(left, right, ["f1", "f2", "t1", "t2"], ["a"])
    return both.where("a <> b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()
