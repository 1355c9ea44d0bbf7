"""Scalar functions on text as Column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}]+"
#: Lower-case Latin letters with marks and the plain letters that they fold to, by Unicode decomposition.
_FOLD = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if chr(c).islower() and unicodedata.normalize("NFD", chr(c))[0].isascii() and unicodedata.decomposition(chr(c)) and "<" not in unicodedata.decomposition(chr(c))]
MARKED, PLAIN = "".join(a for a, _ in _FOLD), "".join(b for _, b in _FOLD)
#: The forms of ids, refs and footers.
FILE_ID = r"\bfile_[0-9a-fA-F]{6,32}\b"
SOURCE_REF = r"\b(?:rlm_chunk|message|content|file):[A-Za-z0-9_.:/-]+\b"
CHUNK_ID = r"(?:rlm_chunk:)?(rchunk_[A-Za-z0-9_]+)"
FOOTER = r"(?m)\n*\[LCM (?:File IDs|Source Refs):[^\[\]]*\]\s*$"
INTERNAL_REFS = "content:lcm-compaction-input:"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def fold(text) -> Column:
    """Lower case without Latin diacritics; ASCII texts skip the folding."""
    low = F.lower(_col(text))
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, MARKED, PLAIN))


def terms(text) -> Column:
    """Index terms of a document in order: folded runs of letters and digits."""
    return F.filter(F.split(fold(F.coalesce(_col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_words(text, distinct: bool = True) -> Column:
    """Words of a query (letters, digits, underscore), lower-cased, first occurrences only by default."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    return F.array_distinct(found) if distinct else found


def stemmed_query_words(text) -> Column:
    """query_words with crude stems of words over four letters added: without ing, ed, or a final s that isn't ss."""

    def stem(w):
        cut = F.when(w.endswith("ing"), 3).when(w.endswith("ed"), 2).when(w.endswith("s") & ~w.endswith("ss"), 1)
        return F.array_compact(F.array(w, F.when(F.char_length(w) > 4, F.substring(w, F.lit(1), F.char_length(w) - cut))))

    return F.array_distinct(F.flatten(F.transform(query_words(text), stem)))


def squeeze(text) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def preview(text, most: int = 420, mark: str = "…") -> Column:
    """The squeezed text, cut to most code points with the mark in the last place if it is longer."""
    s = squeeze(text)
    return F.when(F.char_length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit(mark))).otherwise(s)


def clip(text, most: int = 1600, mark: str = " ...") -> Column:
    """Text without a byte-order mark, its first code points and a mark if longer."""
    s = F.regexp_replace(_col(text), "^﻿+", "")
    return F.when(F.char_length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most)), F.lit(mark))).otherwise(s)


def tokens(text, least: int = 1) -> Column:
    """Estimated tokens: a quarter of the code points, ``least`` for any short text, 0 for the empty one."""
    n = F.char_length(F.coalesce(_col(text), F.lit(""))).cast("long")
    quarter = F.floor(n / 4).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(least).cast("long"), quarter))


def file_ids(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"({FILE_ID})"), F.lit(1)))


def source_refs(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"({SOURCE_REF})"), F.lit(1)))


def strip_footers(text) -> Column:
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), FOOTER, "")


def add_footers(text, ids, refs) -> Column:
    """Text with canonical footers for ids and refs, in place of any that it has."""

    def line(name, values):
        return F.when(F.size(values) > 0, F.concat(F.lit(f"\n\n[LCM {name}: "), F.array_join(values, ", "), F.lit("]"))).otherwise("")

    return F.concat(strip_footers(text), line("File IDs", _col(ids)), line("Source Refs", _col(refs)))


def chunk_ids(text) -> Column:
    """Ids of chunks that a text names, first places only."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(CHUNK_ID), F.lit(1)))


def public_refs(refs) -> Column:
    """Refs that point to evidence, without empty ones and those of the engine's own bookkeeping."""
    return F.filter(_col(refs), lambda r: r.isNotNull() & (r != "") & ~r.startswith(INTERNAL_REFS))


def canonical_json(values) -> Column:
    """A map as compact JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(values)))))


def string_list(value) -> Column:
    """A JSON array of texts, a single text as a list of one, or an empty list."""
    v = _col(value)
    many = F.from_json(v, "array<string>")
    return F.when(v.isNull() | (v == ""), F.array().cast("array<string>")).when(v.startswith("["), F.coalesce(many, F.array().cast("array<string>"))).otherwise(F.array(v))


def evidence_snippet(text, start, end, most: int = 720) -> Column:
    """At most so many code points of a text, the middle of the range [start, end) in their middle, with dots where it is cut."""
    t, n = _col(text), F.char_length(_col(text))
    a = F.greatest(F.lit(0), F.least(_col(start), n))
    b = F.greatest(a, F.least(_col(end), n))
    low = F.greatest(F.lit(0), F.floor((a + b) / 2) - most // 2)
    high = F.least(n, low + most)
    low = F.greatest(F.lit(0), high - most).cast("int")
    body = F.trim(F.substring(t, low + 1, (high - low).cast("int")))
    cut = F.concat(F.when(low > 0, "... ").otherwise(""), body, F.when(high < n, " ...").otherwise(""))
    return F.when(n <= most, t).otherwise(cut)


def is_file_id(text) -> Column:
    return _col(text).rlike(r"^file_[0-9a-fA-F]{6,32}$")


def content_type(path) -> Column:
    """docs, config or conversation by the ending of a path."""
    low = F.lower(_col(path))
    return F.when(low.rlike(r"\.(toml|json|ya?ml|ini)$"), "config").otherwise("docs")


def role_of_turn(role) -> Column:
    low = F.lower(F.trim(F.coalesce(_col(role), F.lit(""))))
    return F.when(low.isin("user", "assistant", "system", "tool"), low).otherwise("user")


def role_of_message(role) -> Column:
    low = F.lower(F.trim(F.coalesce(_col(role), F.lit(""))))
    return F.when(low.isin("user", "assistant"), low).otherwise("assistant")


def role_of_case(role) -> Column:
    low = F.lower(F.trim(F.coalesce(_col(role), F.lit(""))))
    return F.when(low == "assistant", low).otherwise("user")


def epoch_seconds(value) -> Column:
    """Epoch seconds from seconds or milliseconds."""
    v = _col(value).cast("double")
    return F.when(v > 1e10, v / 1000).otherwise(v)


def iso_utc(value) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds(value)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def session_date(text) -> Column:
    """A date in one of the two written forms of the benchmark sources."""
    s = _col(text)
    return F.coalesce(F.try_to_timestamp(F.initcap(s), F.lit("h:mm a 'On' d MMMM, yyyy")), F.try_to_timestamp(F.regexp_replace(s, r" \([A-Za-z]{3}\)", ""), F.lit("yyyy/MM/dd HH:mm")))


def safe_id(text) -> Column:
    return F.regexp_replace(_col(text), r"[^A-Za-z0-9_-]", "_")


def content_hash(text) -> Column:
    return F.sha2(_col(text), 256)


def stable_id(prefix: str, *parts) -> Column:
    """prefix + the first 32 hex digits of the hash of the parts, joined by the unit separator."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *[_col(p).cast("string") for p in parts]), 256), 1, 32))


def session_key(text) -> Column:
    return F.concat(F.lit("session-"), F.substring(F.sha2(_col(text), 256), 1, 24))


def occurrences(text, token) -> Column:
    """How often a token stands in a text, overlaps not counted."""
    t, k = F.lower(_col(text)), F.lower(_col(token))
    return F.when(F.char_length(k) == 0, 0).otherwise(((F.char_length(t) - F.char_length(F.replace(t, k, F.lit("")))) / F.char_length(k)).cast("long"))


def answer_words(text) -> Column:
    """An answer for comparison: lower case, ordinals as numbers, letters and digits only, no articles."""
    s = F.regexp_replace(F.lower(F.regexp_replace(_col(text), r"(?s)<think>.*?</think>", "")), r"\b(\d+)(st|nd|rd|th)\b", "$1")
    return F.array_join(F.filter(F.regexp_extract_all(s, F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin("a", "an", "the")), " ")


def answer_matches(expected, given) -> Column:
    """Whether the expected answer stands in the given one, as written or normalised."""
    e, g = _col(expected), _col(given)
    return F.contains(F.lower(g), F.lower(e)) | ((answer_words(e) != "") & F.contains(F.concat(F.lit(" "), answer_words(g), F.lit(" ")), F.concat(F.lit(" "), answer_words(e), F.lit(" "))))


def batch_index(text) -> Column:
    """n of a line ``Batch index: n`` among the first eight lines."""
    head = F.array_join(F.slice(F.split(F.coalesce(_col(text), F.lit("")), "\n"), 1, 8), "\n")
    return F.regexp_extract(head, r"(?mi)^\s*batch index:\s*(\d+)", 1).try_cast("long")


def snippet(text, start, end, most: int = 720) -> Column:
    """At most so many code points around the range [start, end) of a text, with dots where it is cut."""
    t, n = _col(text), F.char_length(_col(text))
    a, b = F.greatest(F.lit(0), _col(start)), F.least(n, _col(end))
    room = F.greatest(F.lit(0), F.lit(most) - (b - a))
    left = F.greatest(F.lit(0), a - F.floor(room / 2)).cast("int")
    body = F.substring(t, left + 1, F.lit(most))
    return F.concat(F.when(left > 0, "…").otherwise(""), F.trim(body), F.when(left + most < n, "…").otherwise(""))
