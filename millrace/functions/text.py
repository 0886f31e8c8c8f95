"""String functions as Column -> Column. Null in, null out, unless stated."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Credentials that are redacted, in this order.
SECRETS = (
    ("private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("github_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b"),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("bearer", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}"),
    ("assigned_secret", r"""(?i)\b(password|passwd|secret|api[_-]?key|token)\s*[:=]\s*['"]?[^\s'"]{8,}"""),
)
# What varies between instances of one event, and its placeholder, in this order.
INSTANCE_VALUES = (
    ("uuid", r"(?i)(?<![\w-])[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}(?![\w-])"),
    ("timestamp", r"(?<!\w)\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})(?!\w)"),
    ("address", r"(?i)(?<!\w)0x[0-9a-f]{8,16}(?!\w)"),
    ("hash", r"(?i)(?<![\w-])[0-9a-f]{16,64}(?![\w-])"),
    ("random_suffix", r"(?i)\b([a-z][a-z0-9.-]{1,80})-(?=[a-z0-9]{8,10}-)(?=[a-z0-9]*\d)[a-z0-9]{8,10}-[a-z0-9]{5}\b"),
)
# Token and sentence patterns.
LEXICAL_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_./:+#-]*"
SIGNATURE_TOKEN = r"[A-Za-z0-9][A-Za-z0-9._+#/:-]*"
TERM = r"[A-Za-z0-9][A-Za-z0-9._+#/-]*[A-Za-z0-9+#]|[A-Za-z0-9]"
SENTENCE_BREAK = r"""(?<=[.!?])\s+(?=[A-Z0-9"'(])"""
URL = r"""https?://[^\s)>"'\]]+"""
FIRST_PERSON = r"\b(?:I|we|We|our|Our|my|My|us|Us|me|Me)\b"
FINITE_VERB = (
    r"(?i)\b(?:is|are|was|were|be|been|being|has|have|had|does|do|did|can|could|will|would|shall|"
    r"should|may|might|must|consists|comprises|denotes|refers)\b"
)
BOT_BOILERPLATE = (r"(?is)<!--.*?-->", r"(?im)^\s*(?:please fill|checklist|generated by|this is an automated).*$")
# Query strata, the first that matches.
STRATA = (
    ("error_troubleshooting", r"(?i)\b(?:error|failed?|failure|panic|crash|exception|not working|oom|out of memory|timeout|stack trace)\b"),
    ("exact_version_numeric", r"(?:\bv?\d+(?:\.\d+)+\b|\b(?:HTTP|gRPC)\s*\d{3}\b|`[^`]*[A-Za-z_./:-][^`]*`|\b[A-Z][A-Z0-9_]{3,}\b|\b[a-z][a-z0-9]*(?:[_.:/-][a-z0-9]+)+\b)"),
    ("config_api_ops", r"(?i)\b(?:config|setting|api|grpc|rest|port|cluster|replica|shard|deploy|docker|kubernetes|yaml|collection)\b"),
    ("alias_jargon", r"(?i)\b(?:hnsw|wal|mmap|rocksdb|quantization|payload|segment|optimizer|ef_construct|ef_search|grpc|raft|rps)\b"),
)


def _empty_to_none(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def fingerprint_words(text: Column) -> Column:
    """Lower-case maximal runs of letters and digits; [] for null and wordless texts."""
    return F.coalesce(_empty_to_none(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")), F.array().cast("array<string>"))


def collapse_space(text: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fold_case_space(text: Column) -> Column:
    """Case-folded with collapsed white space; full case folding needs Python only for characters where it differs from lower case."""
    return F.regexp_replace(collapse_space(F.lower(text)), "ß", "ss")


@F.pandas_udf(T.StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    """NFKC, case folded, white space collapsed."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def group_id(normalized: Column) -> Column:
    """First 16 hex digits of the sha256 of the normalised text."""
    return F.substring(F.sha2(normalized, 256), 1, 16)


def title_shape(title: Column) -> Column:
    """A title without versions, port words and punctuation: equal for restated titles."""
    t = F.regexp_replace(F.lower(title), r"\b(?:v?\d+(?:\.\d+){1,3}|backport|cherry[- ]pick)\b", " ")
    return collapse_space(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def lexical_tokens(text: Column) -> Column:
    """Technical tokens in lower case, in order; [] for null."""
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit(LEXICAL_TOKEN), F.lit(0)), F.lower), F.array().cast("array<string>"))


def lexical_signature(text: Column) -> Column:
    """The sorted tokens as one string: equal whatever the case, punctuation or word order."""
    return F.array_join(F.sort_array(F.transform(F.regexp_extract_all(text, F.lit(SIGNATURE_TOKEN), F.lit(0)), F.lower)), " ")


def terms(text: Column) -> Column:
    """Distinct lexical units in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def words(text: Column) -> Column:
    """White-space separated words; [] for blank or null."""
    return F.coalesce(_empty_to_none(F.split(text, r"\s+")), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    """Sentences: a break after .!? and white space before a capital, digit, quote or bracket."""
    return _empty_to_none(F.transform(F.split(collapse_space(text), SENTENCE_BREAK), lambda s: F.trim(s)))


def spans(text: Column) -> Column:
    """Sentences by the plainer rule: a break after .!? and white space, whatever follows."""
    return _empty_to_none(F.transform(F.split(strip(text), r"(?<=[.!?])\s+"), lambda s: strip(s)))


def first_span(text: Column, low: int = 4, high: int = 32) -> Column:
    """The first ``high`` words of the first span, null if it has fewer than ``low``."""
    w = words(F.get(spans(text), F.lit(0)))
    return F.when(F.size(w) >= low, F.array_join(F.slice(w, 1, high), " "))


def redact(text: Column) -> Column:
    """Credentials replaced by <REDACTED_CLASS>, class by class."""
    for name, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"<REDACTED_{name.upper()}>")
    return text


def redaction_counts(text: Column) -> Column:
    """How many of each class ``redact`` replaces, as a struct."""
    counts = []
    for name, pattern in SECRETS:
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(name))
        text = F.regexp_replace(text, pattern, f"<REDACTED_{name.upper()}>")
    return F.struct(*counts)


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def unquoted(text: Column) -> Column:
    """Without quoted lines, lines without trailing white space, nothing blank outside."""
    kept = F.filter(lines(text), lambda x: ~x.rlike(r"^\s*>"))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"), r"^\s+|\s+$", "")


def quoted_lines(text: Column) -> Column:
    """Number of quoted lines."""
    return F.size(F.filter(lines(text), lambda x: x.rlike(r"^\s*>")))


def clean_body(text: Column, is_bot: Column | bool = False) -> Column:
    """Redacted and unquoted; automated messages also lose comments and boilerplate lines."""
    t = redact(text)
    bot = t
    for pattern in BOT_BOILERPLATE:
        bot = F.regexp_replace(bot, pattern, "")
    flag = F.lit(is_bot) if isinstance(is_bot, bool) else is_bot
    return unquoted(F.when(flag, bot).otherwise(t))


def urls(text: Column) -> Column:
    """Distinct URLs in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(URL), F.lit(0))))


def placeholders(text: Column, enabled: tuple[str, ...] = tuple(n for n, _ in INSTANCE_VALUES), prefix: str = "v") -> Column:
    """Instance values (uuid, timestamp, address, hash, generated name) as <prefix_kind>, in that order."""
    for name, pattern in INSTANCE_VALUES:
        if name in enabled:
            to = f"<{prefix}_{name}>"
            text = F.regexp_replace(text, pattern, "$1-" + to if name == "random_suffix" else to)
    return text


def strip_version(ident: Column) -> Column:
    """An id without a trailing vN, unless nothing else would be left."""
    return F.when(ident.rlike(r"^.+v[0-9]+$"), F.regexp_replace(ident, r"v[0-9]+$", "")).otherwise(ident)


def stable_id(kind: Column, source_id: Column, part: Column | None = None) -> Column:
    """kind:source or kind:source:part; part 0 or null is not written."""
    base = F.concat_ws(":", kind, source_id)
    return base if part is None else F.when(F.coalesce(part, F.lit(0)) != 0, F.concat_ws(":", base, part.cast("string"))).otherwise(base)


def slug(name: Column) -> Column:
    """A name for the file system."""
    return F.regexp_replace(F.lower(name), r"[^a-z0-9._-]+", "-")


def titled_text(title: Column, text: Column) -> Column:
    """Title, blank, text; a missing or blank title leaves the text, both trimmed."""
    return F.trim(F.concat_ws(" ", F.nullif(F.trim(title), F.lit("")), text))


def snippet(text: Column, term: Column, width: int = 160) -> Column:
    """``width`` characters around the first occurrence in any case, or the start of the text."""
    at = F.instr(F.lower(text), F.lower(term))
    start = F.when(at > 0, F.greatest(F.lit(1), at - width // 2)).otherwise(1)
    return F.substr(text, start, F.lit(width))


def is_claim(sentence: Column) -> Column:
    """8 to 40 words, a finite verb, no first person, no question."""
    return word_count(sentence).between(8, 40) & ~sentence.endswith("?") & ~sentence.rlike(FIRST_PERSON) & sentence.rlike(FINITE_VERB)


def prose_question(text: Column) -> Column:
    """A question mark outside code."""
    return F.contains(F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^`]*`", " "), F.lit("?"))


def stratum(text: Column) -> Column:
    """The first stratum whose cues occur, else concept_howto."""
    out = F.when(text.isNull(), None)
    for name, pattern in STRATA:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("concept_howto")


def is_abbreviation(term: Column) -> Column:
    """At most 6 characters, with a digit or without vowels."""
    t = F.lower(term)
    return (F.length(t) <= 6) & (t.rlike("[0-9]") | ~t.rlike("[aeiouy]"))


def topicality(text: Column, pattern: str, head_words: int = 25) -> Column:
    """Distinct keyword hits plus twice those in the first words."""
    hits = lambda c: F.size(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lower)))
    return hits(text) + 2 * hits(F.array_join(F.slice(words(text), 1, head_words), " "))


def first_match(text: Column, classes: Mapping[str, str]) -> Column:
    """Name of the first class whose pattern occurs, else null."""
    out = F.when(F.lit(False), None)
    for name, pattern in classes.items():
        out = out.when(text.rlike(pattern), name)
    return out


def keyword_score(text: Column, keywords: Mapping[str, int]) -> Column:
    """Sum of the weights of the distinct keywords that occur as substrings."""
    low = fold_case_space(text)
    total = F.lit(0)
    for word, weight in keywords.items():
        total = total + F.when(F.contains(low, F.lit(word)), weight).otherwise(0)
    return total


def in_word_range(text: Column, low: Column | int, high: Column | int) -> Column:
    return word_count(text).between(low, high)


def route_by_length(text: Column, ranges: Mapping[str, tuple[int, int]]) -> Column:
    """The first form whose word range holds the text, else null."""
    n = word_count(text)
    out = F.when(F.lit(False), None)
    for form, (low, high) in ranges.items():
        out = out.when(n.between(low, high), form)
    return out
