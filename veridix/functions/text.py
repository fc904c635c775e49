"""Text functions as Columns: everything stays in the JVM."""

from __future__ import annotations

import hashlib
import html
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# They must equal the behaviour to be matched.
STOP_WORDS = ["the", "is", "a", "an", "of", "in", "on", "to", "what", "which", "who", "how"]
NUMERIC_CUES = ["how many", "how much", "what year", "when", "age", "number", "size", "length", "width", "height", "engine", "horsepower", "capacity", "century", "date", "score", "population", "distance", "weight", "speed", "duration"]
IDK = "I don't know"
HTML_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _unescape_all(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_all(c: Column) -> Column:
    """Every named and numeric character reference of HTML, as the standard library's table has them; for `clean_markup`'s
    `unescape_with`. Runs in Arrow batches."""
    return _unescape_all(c)


def unescape(c: Column) -> Column:
    """The named entities of HTML_ENTITIES, in the JVM; `unescape_all` has the full table."""
    for entity, char in HTML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


# The patterns of both clean_markup functions and their order must equal the behaviour to be matched.
def clean_markup(c: Column, unescape_with=unescape) -> Column:
    """Second generation: entities, line breaks, wiki links, templates, white space, edge marks, in that order."""
    c = unescape_with(c)
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", " ")
    c = F.regexp_replace(c, r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1")
    c = F.regexp_replace(c, r"(?i)\{\{url\|([^{}]+)\}\}", "$1")
    c = F.regexp_replace(c, r"(?i)\{\{convert\|([^|{}]+)\|([^|{}]+)[^{}]*\}\}", "$1 $2")
    c = F.regexp_replace(c, r"\{\{[^{}]*\}\}", " ")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^[ ,;|]+|[ ,;|]+$", "")


def clean_markup_v1(c: Column) -> Column:
    """First generation: no entities; a template keeps its last argument."""
    c = F.regexp_replace(c, r"<br\s*/?>", " ")
    c = F.regexp_replace(c, r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1")
    c = F.regexp_replace(c, r"\{\{[^{}]*\|([^{}|]+)\}\}", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^[ ,;]+|[ ,;]+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def terms(c: Column) -> Column:
    """Distinct tokens of over one character that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(tokens(clean_markup(F.coalesce(c, F.lit("")))), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the token sets of two token arrays; 0 where either is empty or nothing is shared."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    p, r = both / F.nullif(F.size(y), F.lit(0)), both / F.nullif(F.size(x), F.lit(0))
    return F.coalesce(F.when(both > 0, 2 * p * r / (p + r)), F.lit(0.0))


def relevance(query: Column, candidate: Column) -> Column:
    """Shared terms, plus their share of the query's terms; 0 for a candidate without terms."""
    o = F.size(F.array_intersect(query, candidate))
    return F.when(F.size(candidate) > 0, o + o / F.greatest(F.size(query), F.lit(1))).otherwise(F.lit(0.0)).cast("double")


def numbers(c: Column) -> Column:
    """Numbers in lower-cased text; a digit right after a letter is left out."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?<![a-z])(\d+(?:\.\d+)?)"), 1))


def is_numeric_question(query: Column) -> Column:
    return query.rlike(rf"(?i)\b(?:{'|'.join(NUMERIC_CUES)})\b") | query.rlike(r"(?<![a-z])\d+(?:\.\d+)?")


def is_idk(response: Column) -> Column:
    return F.contains(F.lower(F.coalesce(response, F.lit(""))), F.lit(IDK.lower()))


def is_exact_match(response: Column, truth: Column) -> Column:
    return F.lower(strip(F.coalesce(response, F.lit("")))) == F.lower(strip(F.coalesce(truth, F.lit(""))))


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def evidence_line(evidence_id: Column, score: Column, text: Column) -> Column:
    """`[ID score=0.123] text`; the score rounds half to even."""
    return F.concat(F.lit("["), evidence_id, F.lit(" score="), F.replace(F.format_number(score, 3), F.lit(","), F.lit("")), F.lit("] "), text)


def search_query(entities: Column, query: Column, most: int = 240) -> Column:
    """Up to two leading entity names (array) and the question, cleaned and cut."""
    return F.substring(clean_markup(F.concat_ws(" ", F.slice(entities, 1, 2), query)), 1, most)


def search_query_v1(query: Column, summary: Column, history: Column, most: int = 280) -> Column:
    """The question, an image summary and the last two messages (array of texts) that aren't empty, each cleaned."""
    said = F.filter(history, lambda x: F.coalesce(x, F.lit("")) != "")
    last = F.when(F.size(said) > 2, F.slice(said, -2, 2)).otherwise(said)
    parts = F.transform(F.concat(F.array(query, summary), last), lambda x: clean_markup_v1(F.coalesce(x, F.lit(""))))
    return F.substring(F.array_join(F.filter(parts, lambda x: x != ""), " "), 1, most)


def rewrite_query(entity: Column, query: Column, most: int = 240) -> Column:
    return F.substring(strip(F.concat_ws(" ", F.nullif(strip(entity), F.lit("")), F.nullif(strip(query), F.lit("")))), 1, most)


def normalise_answer(answer: Column) -> Column:
    """struct(answer, reason): empty answers and those that say they don't know become IDK with a reason."""
    a = clean_markup(F.coalesce(answer, F.lit("")))
    idk = a.rlike(r"(?i)\bi\s+(?:do\s+not|don't)\s+know\b")
    return F.when(a == "", F.struct(F.lit(IDK).alias("answer"), F.lit("empty_generation").alias("reason"))).when(idk, F.struct(F.lit(IDK).alias("answer"), F.lit("insufficient_evidence").alias("reason"))).otherwise(F.struct(a.alias("answer"), F.lit(None).cast("string").alias("reason")))


def cache_key_md5(url: Column) -> Column:
    """md5 of the address with the path's extension, .jpg where it has none."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    ext = F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"(\.[A-Za-z0-9]+)$", 1)
    return F.concat(F.md5(url), F.when(ext == "", F.lit(".jpg")).otherwise(ext))


def cache_key_sha256(url: Column, extension: str = "jpg") -> Column:
    return F.concat(F.sha2(url, 256), F.lit("." + extension))


def thumbnail_url(url: Column, width: int = 1280) -> Column:
    """Wikimedia originals as thumbnails of a width; null for other hosts and paths."""
    if width <= 0:
        raise ValueError("width must be positive")
    pattern = r"^([a-z]+://upload\.wikimedia\.org(?::\d+)?)/wikipedia/commons/((?:[^?#/]*/)*)([^?#/]*)(\?[^#]*)?(?:#.*)?$"
    made = F.regexp_replace(url, pattern, f"$1/wikipedia/commons/thumb/$2$3/{width}px-$3$4")
    return F.when(url.rlike(pattern), made)


def is_url(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def number_with_unit(c: Column) -> Column:
    """`100 MiB` -> 100.0; null where no number leads."""
    return F.try_element_at(F.split(F.trim(c), " "), F.lit(1)).try_cast("double")


def canonical_sha256(payload: object) -> str:
    """SHA-256 of a value's JSON with sorted keys and no spaces: equal values, equal hashes. For configurations, on the
    driver; `row_sha256` has the same for rows."""
    return hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def row_sha256(*names: str) -> Column:
    """SHA-256 of the named columns' JSON, names in sorted order; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)


def split_words(c: Column) -> Column:
    return F.filter(F.split(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda t: t != "")


def count_tokens(c: Column, tokenize=split_words) -> Column:
    """How many tokens the injected tokenizer (a function from a Column to an array Column) finds; white space by default."""
    return F.size(tokenize(c))


def truncate_tokens(c: Column, most: int = 75, tokenize=split_words, join: str = " ") -> Column:
    """The first `most` tokens, joined; texts of no more stay as the tokens say."""
    return F.array_join(F.slice(tokenize(c), 1, most), join)


def clip_batch(size: int, least: int = 1, most: int = 16) -> int:
    return max(least, min(most, size))


def seeded_answer(seed: int, key: Column) -> Column:
    """A made-up answer of 2 to 16 letters and spaces that seed and key decide, as a baseline agent gives."""
    digits = F.concat(*[F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"), F.lit(i))) for i in range(2)])
    at = lambda i: F.conv(F.substring(digits, 1 + 3 * i, 3), 16, 10).cast("int")
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "
    text = F.concat(*[F.substring(F.lit(letters), at(i + 1) % len(letters) + 1, F.lit(1)) for i in range(16)])
    return F.substring(text, F.lit(1), at(0) % 15 + 2)
