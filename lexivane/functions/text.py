"""Text functions as column expressions: markup stripping, words, byte edit distance, addresses, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges of Han characters that are padded before a text is split into words.
CJK = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}"
#: A title's word: letters, digits, _ and - of ASCII, and Han characters of the main block.
TITLE_WORD = "([A-Za-z0-9_\\-\\x{4E00}-\\x{9FFF}]+)"
# The formats in which feeds write dates, their offsets taken off.
DATE_FORMATS = (
    "EEE, d MMM yyyy HH:mm:ss",
    "d MMM yyyy HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy-MM-dd",
)
MARK, GONE = "\u0001", "\u0002"


def decode_entities(text: Column) -> Column:
    """lt, gt, quot, apos, amp and nbsp (a plain space) decoded in one pass; numeric references deleted, unknown ones kept."""
    out = F.regexp_replace(text, "&#[^;]{1,8};", GONE)
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):  # amp last: what it yields is not decoded again
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return F.replace(out, F.lit(GONE), F.lit(""))


def strip_html(text: Column) -> Column:
    """Text without tags; each tag, and a stray ``>``, leaves one space unless nothing or a space stands before it; an open ``<`` drops the rest."""
    out = F.translate(text, MARK + GONE, "")
    out = F.regexp_replace(out, "<[^>]*\\z", "")
    out = F.regexp_replace(out, "<[^>]*>|>", MARK)
    out = F.regexp_replace(out, f"\\A{MARK}+", "")
    out = F.regexp_replace(out, f" {MARK}+", " ")
    return decode_entities(F.regexp_replace(out, f"{MARK}+", " "))


def title_words(title: Column) -> Column:
    return F.regexp_extract_all(title, F.lit(TITLE_WORD), F.lit(1))


def as_bytes(text: Column) -> Column:
    """A string with one character for each UTF-8 byte, so that lengths and distances count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def byte_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(as_bytes(a), as_bytes(b))


def byte_similarity(distance: Column, a: Column, b: Column) -> Column:
    """1 - distance / the longer length, in single precision, as thresholds on it expect; two empty strings are equal."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    part = (distance.cast("float") / longer.cast("float")).cast("float")
    return F.when(longer == 0, F.lit(1.0).cast("float")).otherwise((F.lit(1.0).cast("float") - part).cast("float"))


def same_first_byte(a: Column, b: Column) -> Column:
    return F.substring(as_bytes(a), 1, 1) == F.substring(as_bytes(b), 1, 1)


def pad_cjk(text: Column) -> Column:
    return F.regexp_replace(text, f"([{CJK}])", " $1 ")


def split_ascii_space(text: Column) -> Column:
    trimmed = F.regexp_replace(text, "^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+\\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))


def split_single_space(text: Column) -> Column:
    return F.filter(F.split(text, " ", -1), lambda x: x != "")


def url_decode(text: Column) -> Column:
    """%XX and + decoded; a % that no two hexadecimal digits follow stays."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def url_encode(text: Column) -> Column:
    """Letters, digits and ``-_.~`` kept, a space as ``+``, other bytes as %XX."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_text(target: Column) -> Column:
    """The decoded value of the first of the parameters q, query and keywords in a request target; null without one."""
    query = F.regexp_extract(target, "\\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1).isin("q", "query", "keywords") & p.contains("="))
    first = F.get(pairs, F.lit(0))
    return url_decode(F.regexp_replace(first, "^[^=]*=", ""))


def repaired(text: Column) -> Column:
    """A text that was UTF-8 but read as Latin-1, put right; any other is unchanged."""
    latin = text.rlike("^[\\x{00}-\\x{FF}]*\\z") & text.rlike("[\\x{80}-\\x{FF}]")
    raw = F.when(latin, F.encode(text, "ISO-8859-1"))
    return F.when(latin & F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(text)


def feed_time(text: Column, fallback: Column) -> Column:
    """A feed's date; its offset is dropped, not applied; ``fallback`` where no format fits."""
    bare = F.regexp_replace(F.trim(text), "\\s*(?:Z|GMT|UTC|[+-]\\d{2}:?\\d{2})$", "")
    tried = [F.try_to_timestamp(F.when(bare.rlike("^[A-Z][a-z]{2}, "), F.regexp_replace(bare, "^[A-Z][a-z]{2}, ", "")).otherwise(bare), F.lit(f)) for f in DATE_FORMATS if not f.startswith("EEE")]
    return F.coalesce(*tried, fallback)


def epoch_time(seconds: Column) -> Column:
    """Epoch seconds as a wall-clock string at +08:00."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), "+08:00"), "yyyy-MM-dd HH:mm:ss")
