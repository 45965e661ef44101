"""Text functions as column expressions.

Null in, null out unless a docstring says otherwise. White space is that of Unicode, together with the
four separators 0x1c-0x1f.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SPACE = r"[\s\x1c-\x1f]"

# Suffixes in the order in which they are tried; the word lists of the token functions.
SUFFIXES = ("ization", "ations", "ation", "ments", "ment", "ingly", "edly", "ing", "ies", "ed", "es", "s")
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "with")
CJK = r"[㐀-䶿一-鿿豈-﫿]"
TRUNCATED = " ... [truncated]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(c), f"(?U)^{SPACE}+|{SPACE}+$", "")


def compact(c: Column | str) -> Column:
    """Stripped, each run of white space one blank; null gives an empty text."""
    return F.regexp_replace(strip(F.coalesce(_c(c), F.lit(""))), f"(?U){SPACE}+", " ")


def normalized(c: Column | str) -> Column:
    """Compact and lower case."""
    return F.lower(compact(c))


def stem(token: Column) -> Column:
    """The first suffix that leaves more than four letters is cut off; "ies" becomes "y"."""
    out = token
    for s in reversed(SUFFIXES):
        rest = F.substring(token, F.lit(1), F.length(token) - len(s) + (1 if s == "ies" else 0))
        cut = F.concat(F.substring(token, F.lit(1), F.length(token) - 3), F.lit("y")) if s == "ies" else rest
        out = F.when(token.endswith(s) & (F.length(token) > len(s) + 4), cut).otherwise(out)
    return out


def tokens(c: Column | str, pattern: str = r"[a-z0-9]+") -> Column:
    """All matches in the normalized text, in order."""
    return F.regexp_extract_all(normalized(c), F.lit(f"({pattern})"), F.lit(1))


def content_tokens(c: Column | str, stop: Sequence[str] = STOPWORDS) -> Column:
    """Distinct stems of the tokens of more than two letters that aren't stop words, sorted."""
    kept = F.filter(tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(*stop))
    return F.array_sort(F.array_distinct(F.transform(kept, stem)))


def cjk_bigrams(c: Column | str) -> Column:
    """Distinct pairs of neighbouring ideographs, in order of first occurrence."""
    runs = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(f"({CJK}{{2,}})"), F.lit(1))
    grams = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    return F.array_distinct(F.flatten(grams))


def has_cjk(c: Column | str) -> Column:
    return _c(c).rlike(CJK)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def coverage(part: Column, whole: Column) -> Column:
    """Share of the elements of ``part``, repeated ones counted, that ``whole`` contains; 0 for an empty part."""
    return F.when(F.size(part) > 0, F.size(F.filter(part, lambda x: F.array_contains(whole, x))) / F.size(part)).otherwise(F.lit(0.0))


def recall(part: Column, whole: Column) -> Column:
    """Share of the distinct elements of ``part`` that ``whole`` contains."""
    return coverage(F.array_distinct(part), whole)


def truncate(c: Column | str, limit: int) -> Column:
    """Texts longer than ``limit`` end in a mark and have limit - 20 characters before it; null gives an empty text."""
    x = F.coalesce(_c(c), F.lit(""))
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit - 20), F.lit(TRUNCATED)))


def word_count(c: Column | str) -> Column:
    """Words between white space; 0 for null and blank texts."""
    x = compact(c)
    return F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))


def visible_length(c: Column | str) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"(?U){SPACE}+", ""))


def too_short(c: Column | str, least: int = 11) -> Column:
    """Fewer visible characters than ``least``; true for null."""
    return visible_length(c) < least


def reasonable_length(c: Column | str, words: tuple[int, int], chars: tuple[int, int]) -> Column:
    """The number of words or else the number of characters lies within its range."""
    return word_count(c).between(*words) | F.length(compact(c)).between(*chars)


def symbol_noise(c: Column | str) -> Column:
    """At least 32 visible characters, of which at most 8 letters or digits and at least 40 % neither."""
    x = F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"(?U){SPACE}+", "")
    alnum = F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    return (F.length(x) >= 32) & (alnum <= 8) & ((F.length(x) - alnum) / F.length(x) >= 0.4)


def matches_any(c: Column | str, patterns: Sequence[str]) -> Column:
    """One alternation of all patterns, matched once; false for null and for no patterns."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(_c(c).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def include_exclude(c: Column | str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Matches an include pattern (if there are any) and no exclude pattern."""
    return (matches_any(c, include) if include else F.lit(True)) & ~matches_any(c, exclude)


def render(template: Column | str, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by its value; unknown names stay as they are, null values are empty."""
    out = _c(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, 0 where a cheap upper bound or the ratio itself is under 0.9. Null counts as empty."""

    def one(x, y):
        m = SequenceMatcher(None, x or "", y or "", autojunk=False)
        if m.real_quick_ratio() < 0.9 or m.quick_ratio() < 0.9:
            return 0.0
        r = m.ratio()
        return r if r >= 0.9 else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def first_filled(**columns: Column) -> Column:
    """Struct (value, field) of the first column that isn't null or blank; nulls if there is none."""
    out = F.lit(None).cast("struct<value:string,field:string>")
    for name, c in reversed(columns.items()):
        v = strip(c)
        out = F.when(v != "", F.struct(v.alias("value"), F.lit(name).alias("field"))).otherwise(out)
    return out


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambdas would compute it again wherever they name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def answer_surfaces(c: Column | str, count: int = 8) -> Column:
    """Up to ``count`` ways to write an answer that differ from it only on the surface.

    In this order: the first 64 characters with a closing mark or in quotes; for an answer with two or more
    capitalised names forms of its first and last one; for a number forms without thousands separators; short
    sentences. Forms of over 180 characters or 28 words and forms equal to the answer or, but for case, to an
    earlier form are left out. Null where no ``count`` forms are found, as for null and blank answers.
    """
    none = F.array().cast("array<string>")
    lit = F.lit

    def forms(x: Column) -> Column:
        raw, base, names = x["raw"], x["base"], x["names"]
        first, last = F.get(names, lit(0)), F.get(names, F.size(names) - 1)
        plain = F.replace(raw, lit(","), lit(""))
        number = raw.rlike(r"^[-+]?\d+(?:[,.]\d+)*(?:\.\d+)?(?:\s*[A-Za-z%°]+)?$")
        marks = F.array(*[F.concat(base, lit(m)) for m in ".,;:!?"], F.concat(lit('"'), base, lit('"')), F.concat(lit("'"), base, lit("'")))
        by_name = F.array(F.concat(last, lit(", "), first), F.concat(first, lit("-"), last), F.concat(first, lit(" "), last, lit(".")), F.concat(first, lit(" "), last, lit(",")))
        by_number = F.array(F.concat(plain, lit(".")), F.concat(plain, lit(";")), F.concat(lit('"'), plain, lit('"')))
        said = F.array(*[F.concat(lit(p), base, lit(".")) for p in ("It was ", "The value was ", "The answer was ")])
        every = F.concat(marks, F.when(F.size(names) >= 2, by_name).otherwise(none), F.when(number, by_number).otherwise(none), said)
        good = F.filter(every, lambda v: (v != raw) & (F.length(v) <= 180) & (F.size(F.split(v, " ")) <= 28))
        return let(F.struct(good.alias("fs"), F.transform(good, lambda v: F.lower(v)).alias("low")), lambda y: F.filter(y["fs"], lambda v, i: F.array_position(y["low"], F.lower(v)) == i + 1))

    def parts(raw: Column) -> Column:
        names = F.regexp_extract_all(raw, lit("([A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’-]+)"), lit(1))
        return F.struct(raw.alias("raw"), F.trim(F.substring(raw, 1, 64)).alias("base"), names.alias("names"))

    found = let(compact(c), lambda raw: let(parts(raw), lambda x: F.when(x["raw"] != "", forms(x))))
    return let(found, lambda fs: F.when(F.size(fs) >= count, F.slice(fs, 1, count)))


def fenced_json(c: Column | str) -> Column:
    """The JSON text in a reply: in a code fence, else from the first bracket to the last closing one; null if there is none."""
    x = _c(c)
    fenced = F.regexp_extract(x, r"(?s)```(?:json|JSON)?\s*(.*?)\s*```", 1)
    bare = F.regexp_extract(x, r"(?s)([\[{].*[\]}])", 1)
    return F.nullif(F.when(F.coalesce(fenced, F.lit("")) != "", fenced).otherwise(bare), F.lit(""))


def _json_calls(c: Column) -> Column:
    raw = F.regexp_extract_all(c, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    parsed = F.transform(raw, lambda j: F.struct(F.get_json_object(j, "$.name").alias("name"), F.get_json_object(j, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda t: t["name"].isNotNull() & t["arguments"].isNotNull())


#: Forms of a thought and of a call in channel markup (fixed values).
_THOUGHTS = r"(?s)(?:<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>"
_CHANNEL_CALL = r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"


def _channel_calls(c: Column) -> Column:
    """Calls of the commentary channel; thoughts are left out first, arguments aren't checked."""
    x = F.regexp_replace(c, _THOUGHTS, "")
    names, args = F.regexp_extract_all(x, F.lit(_CHANNEL_CALL), F.lit(1)), F.regexp_extract_all(x, F.lit(_CHANNEL_CALL), F.lit(2))
    return F.zip_with(names, args, lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))


def _markup_calls(c: Column) -> Column:
    """Calls of <function=name><parameter=key>value</parameter></function> inside tool_call blocks; the arguments are a JSON object of texts, "null" is null."""
    from .hashing import json_string

    blocks = F.array_join(F.regexp_extract_all(c, F.lit(r"(?s)<tool_call>(.*?)(?:</tool_call>|$)"), F.lit(1)), "\n")
    blocks = F.when(F.contains(c, F.lit("<tool_call>")), blocks).otherwise(c)
    calls = F.regexp_extract_all(blocks, F.lit(r"(?s)<function=(.*?)(?:</function>|$)"), F.lit(1))
    calls = F.filter(calls, lambda f: F.contains(f, F.lit(">")))

    def one(f: Column) -> Column:
        inner = r"(?s)<parameter=([^>]*)>\n?(.*?)\n?(?:</parameter>|$)"
        keys, vals = F.regexp_extract_all(f, F.lit(inner), F.lit(1)), F.regexp_extract_all(f, F.lit(inner), F.lit(2))
        pairs = F.zip_with(keys, vals, lambda k, v: F.concat(json_string(k), F.lit(": "), F.when(F.lower(v) == "null", F.lit("null")).otherwise(json_string(v))))
        return F.struct(F.substring_index(f, ">", 1).alias("name"), F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("arguments"))

    return F.transform(calls, one)


#: Parsers of tool calls by name: text -> array of (name, arguments). Others are added with ``register_tool_parser``.
TOOL_PARSERS: dict[str, Callable[[Column], Column]] = {"hermes": _json_calls, "gpt-oss": _channel_calls, "qwen3_coder": _markup_calls}


def register_tool_parser(name: str, parser: Callable[[Column], Column]) -> None:
    if name in TOOL_PARSERS and TOOL_PARSERS[name] is not parser:
        raise ValueError(f"{name} is taken")
    TOOL_PARSERS[name] = parser


def tool_calls(c: Column | str, parser: str = "hermes") -> Column:
    """Array of (name, arguments as JSON text) of the calls in a reply, by the named parser; empty for null."""
    return TOOL_PARSERS[parser](F.coalesce(_c(c), F.lit("")))


#: Words and texts that only state a status (fixed values), and how many words a status or a string of role labels may have.
STATUS_WORDS = ("assistant", "correct", "false", "incorrect", "none", "no", "not", "true", "unchanged", "unknown", "updated", "yes")
STATUS_TEXTS = ("true", "false", "yes", "no", "updated", "not updated", "correct", "incorrect")
MOST_STATUS_WORDS, MOST_ROLE_WORDS = 3, 6
#: Words without content of their own in replies about an update (fixed values).
REPLY_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with")
GENERIC_WORDS = (
    "about", "access", "adapter", "answer", "available", "base", "based", "can", "cannot", "context", "current", "data", "dataset", "detail", "details", "fact", "factual", "general", "information", "knowledge",
    "learn", "learned", "model", "new", "question", "real", "recent", "specific", "state", "that", "this", "training", "update", "updated",
)
#: Stop words of answers (fixed values).
ANSWER_STOPWORDS = ("the", "a", "an", "of", "and", "or", "in", "on", "at", "for", "to", "ce", "ad", "year", "person")


def reply_tokens(c: Column | str) -> Column:
    """Words of a reply, in order, without stop and generic words."""
    return F.filter(tokens(c), lambda t: ~t.isin(*REPLY_STOPWORDS, *GENERIC_WORDS))


def answer_tokens(c: Column | str) -> Column:
    """Words of an answer, in order, without its stop words."""
    return F.filter(tokens(c), lambda t: ~t.isin(*ANSWER_STOPWORDS))


def scenario_tokens(c: Column | str) -> Column:
    """Content tokens, and pairs of neighbouring ideographs marked as such, distinct and sorted."""
    x = F.coalesce(_c(c), F.lit(""))
    only = F.regexp_replace(x, r"[^㐀-鿿]", "")
    pairs = F.when(F.length(only) > 1, F.transform(F.sequence(F.lit(1), F.length(only) - 1), lambda i: F.concat(F.lit("cjk:"), F.substring(only, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(content_tokens(x), pairs)))


def role_or_status(c: Column | str) -> Column:
    """The reply is a string of role labels with little text, or only states a status. False for null and blank."""
    x = F.coalesce(_c(c), F.lit(""))
    label = r"(?i)\b(?:assistant|user|system)\s*:"
    rest = F.regexp_replace(x, label, " ")
    labels = F.size(F.regexp_extract_all(x, F.lit(f"({label})"), F.lit(1)))

    def judge(words: Column) -> Column:
        few = (labels >= 2) & (F.size(words) <= MOST_ROLE_WORDS)
        status = F.size(words).between(1, MOST_STATUS_WORDS) & F.forall(words, lambda w: w.isin(*STATUS_WORDS))
        return few | status | F.trim(F.regexp_replace(F.lower(rest), "[^a-z0-9]+", " ")).isin(*STATUS_TEXTS)

    return (strip(x) != "") & let(reply_tokens(rest), judge)


def json_value(c: Column | str, kind: str = "object") -> Column:
    """The JSON text of a reply of language models, or null where there is none that parses.

    ``kind``: "object" or "array" (that alone), "any", "fenced" (only from a code fence), "outer" (from the first bracket to the last).
    Thoughts in <think> are left off.
    """
    x = F.regexp_replace(_c(c), r"(?s)<think>.*?</think>", "")
    fenced = F.nullif(F.regexp_extract(x, r"(?s)```(?:json|JSON)?\s*(.*?)\s*```", 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(x, {"object": r"(?s)(\{.*\})", "array": r"(?s)(\[.*\])"}.get(kind, r"(?s)([\[{].*[\]}])"), 1), F.lit(""))
    found = fenced if kind == "fenced" else outer if kind == "outer" else F.coalesce(fenced, outer)
    ok = F.try_parse_json(found).isNotNull()
    first = F.substring(F.ltrim(found), 1, 1)
    fits = {"object": first == "{", "array": first == "["}.get(kind, F.lit(True))
    return F.when(ok & fits, found)


def utc_stamp(seconds: Column | str, form: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """Epoch seconds as text in UTC, whatever the session's zone; fractions are cut off."""
    t = F.timestamp_seconds(F.floor(_c(seconds)))
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), form)


def epoch_seconds(stamp: Column | str) -> Column:
    """A timestamp as epoch seconds with its fraction."""
    return F.unix_micros(_c(stamp).cast("timestamp")) / 1e6
