"""Column functions on report text. Patterns run in Unicode mode, and white space is what Unicode and ASCII
control characters 28-31 make it, so that results do not depend on the JDK's defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters in a piece of a long text.
BLOCK = 1024
WS = r"[\s\x1c-\x1f]"
UNICODE = "(?U)"

# Ordered replacements that undo defanging, and the shorter list used for layout text.
REFANG = [
    (r"hxxps\s*[:：]\s*/\s*/", "https://"),
    (r"hxxp\s*[:：]\s*/\s*/", "http://"),
    (r"\[\s*:\s*\]", ":"),
    (r"\(\s*:\s*\)", ":"),
    (r"\[\s*\.\s*\]", "."),
    (r"\(\s*\.\s*\)", "."),
    (r"\{\s*\.\s*\}", "."),
    (r"\[\s*dot\s*\]", "."),
    (r"\(\s*dot\s*\)", "."),
    (r"\s+dot\s+", "."),
    (r"\[\s*at\s*\]", "@"),
    (r"\(\s*at\s*\)", "@"),
]
REFANG_LAYOUT = [
    (r"hxxps\s*[:：]\s*/\s*/", "https://"),
    (r"hxxp\s*[:：]\s*/\s*/", "http://"),
    (r"\[\s*\.\s*\]|\(\s*\.\s*\)|\{\s*\.\s*\}", "."),
    (r"\[\s*dot\s*\]|\(\s*dot\s*\)|\s+dot\s+", "."),
    (r"\[\s*:\s*\]|\(\s*:\s*\)", ":"),
    (r"\[\s*at\s*\]|\(\s*at\s*\)", "@"),
]
# What is cut off both ends of a match, and marks of placeholders.
PUNCTUATION = ".,;:!?)>]}'\""
PLACEHOLDERS = ["*", "[redacted", "redacted", "[base64", "base64-encoded", "[computer", "[username"]
# Words that carry no meaning for retrieval.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "can", "for", "from",
    "has", "have", "in", "into", "is", "it", "may", "of", "on", "or", "such", "that",
    "the", "their", "these", "this", "to", "use", "used", "using", "via", "with",
]
# Fixed value: what a token looks like.
TOKEN = r"[a-zA-Z][a-zA-Z0-9_+-]*|\d+(?:\.\d+)?"


def text_of(c: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"{UNICODE}^{WS}+|{WS}+\z", "")


def strip_right(c: Column) -> Column:
    return F.regexp_replace(c, rf"{UNICODE}{WS}+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), f"{UNICODE}{WS}+", " "))


def _fold(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for pattern, to in pairs:
        c = F.regexp_replace(c, f"(?iuU){pattern}", to)
    return c


def refang(c: Column) -> Column:
    """Defanged indicators made whole again: the ordered replacements, whatever the case.

    Texts without any bracket, scheme or dot that could be replaced are passed over.
    """
    return F.when(text_of(c).rlike(f"(?iuU)hxxp|[\\[({{]|{WS}dot{WS}"), _fold(text_of(c), REFANG)).otherwise(text_of(c))


def refang_layout(c: Column) -> Column:
    return _fold(text_of(c), REFANG_LAYOUT)


def normalize_layout(c: Column) -> Column:
    return collapse(refang_layout(c))


def clean(c: Column) -> Column:
    """A match without white space, then without sentence punctuation, at both ends."""
    return F.trim(strip(c), F.lit(PUNCTUATION))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Array of each entry combined with all before it. combine is associative; n entries take log2(n) passes."""

    def passes(v: Column) -> Column:
        n = F.size(v)
        shifts = F.slice(F.array(*[F.lit(1 << k) for k in range(31)]), F.lit(1), F.when(n > 1, F.ceil(F.log2(n)).cast("int")).otherwise(0))
        return F.aggregate(shifts, v, lambda a, d: F.transform(a, lambda x, i: F.when(i >= d, combine(F.get(a, i - d), x)).otherwise(x)))

    return bound(values, passes)


def blocks(c: Column) -> Column:
    """The text in pieces of BLOCK characters, from which cut() takes places without counting from the start."""
    return F.regexp_extract_all(text_of(c), F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from place start (from 0) to end of a text in blocks()."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(pieces, first + 1, F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(0)))
    return F.substring(F.array_join(some, ""), start - first * BLOCK + 1, end - start)


def even(c: Column) -> Column:
    """Has a text no white space but single spaces, so that collapse() only trims what is cut out of it?"""
    return ~text_of(c).rlike(rf"{UNICODE}[{WS}&&[^ ]]| {{2}}")


def context(pieces: Column, start: Column, end: Column, size: int = 180, even: Column | None = None) -> Column:
    """The characters around places start to end (from 0) of a text in blocks(), white space collapsed. even: even()
    of the whole text, where it is known."""
    around = cut(pieces, F.greatest(start - size, F.lit(0)), end + size)
    return collapse(around) if even is None else F.when(even, F.trim(around)).otherwise(collapse(around))


def has_placeholder(c: Column) -> Column:
    low = F.lower(c)
    found = F.lit(False)
    for marker in PLACEHOLDERS:
        found = found | low.contains(marker)
    return found


def is_masked(pieces: Column, start: Column, end: Column) -> Column:
    """A star or redaction mark within 8 characters of places start to end of a text in blocks()."""
    return cut(pieces, F.greatest(start - 8, F.lit(0)), end + 8).rlike(r"(?i)\*|\[redacted")


def shorten(c: Column, most: int) -> Column:
    """Collapsed text; beyond most characters cut and ended by three dots."""
    flat = collapse(c)
    return F.when(F.length(flat) > most, F.concat(strip_right(F.substring(flat, 1, most - 3)), F.lit("..."))).otherwise(flat)


def slug(c: Column) -> Column:
    s = F.lower(F.trim(F.regexp_replace(text_of(c), "[^a-zA-Z0-9]+", "-"), F.lit("-")))
    return F.when(s == "", "cti-report").otherwise(s)


def attack_id(c: Column) -> Column:
    return F.upper(F.trim(strip(c), F.lit("'\"")))


def family(c: Column) -> Column:
    """The technique a sub-technique belongs to."""
    return F.substring_index(c, ".", 1)


def label_set(c: Column) -> Column:
    """Distinct technique ids of a list in brackets or of comma-separated ones, sorted."""
    found = F.regexp_extract_all(text_of(c), F.lit(r"[^\[\](){},'\"\s]+"), 0)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, attack_id), lambda x: x != "")))


def tokens(c: Column) -> Column:
    """Lower-case words and numbers of two characters or more that are no stopwords, in order."""
    found = F.transform(F.regexp_extract_all(text_of(c), F.lit(UNICODE + TOKEN), 0), F.lower)
    return F.filter(found, lambda x: (F.length(x) > 1) & ~x.isin(STOPWORDS))


def source_set(c: Column) -> Column:
    """Parts between +, / and commas: stripped, distinct, sorted."""
    parts = F.transform(F.split(text_of(c), "[+/,]"), strip)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def source_union(sources: Column, extra: Column | None = None) -> Column:
    """The parts of all entries of a list, and extra (may be null)."""
    all_ = F.flatten(F.transform(F.coalesce(sources, F.array().cast("array<string>")), source_set))
    if extra is not None:
        all_ = F.concat(all_, F.filter(F.array(extra), lambda x: x.isNotNull()))
    return F.array_sort(F.array_distinct(all_))


def chunks(c: Column, most: int = 1200, overlap: int = 150) -> Column:
    """array(struct(chunk_index, text)): pieces of at most `most` characters that share `overlap` with the one before.

    Piece i starts at i * (most - overlap), and the first that reaches the end is the last. Pieces that are
    empty when stripped are left out and not counted.
    """
    if overlap >= most:
        raise ValueError("overlap must be less than the size of a chunk")
    flat = collapse(c)
    n = F.length(flat)
    last = F.greatest(F.ceil((n - most) / (most - overlap)), F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.substring(flat, i * (most - overlap) + 1, F.lit(most))))
    kept = F.filter(pieces, lambda x: x != "")
    return F.transform(kept, lambda x, i: F.struct((i + 1).alias("chunk_index"), x.alias("text")))


def stable_id(report_id: Column, kind: Column, values: Column) -> Column:
    """The first 32 hex digits of sha256 of report, kind and sorted values, laid out as a UUID."""
    h = F.sha2(F.concat(report_id, kind, F.array_join(F.array_sort(values), "|")), 256)
    return F.concat_ws("-", *[F.substring(h, a + 1, b - a) for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32))])


def candidate_id(report_id: Column, ordinal: Column) -> Column:
    return F.format_string("%s::%03d", report_id, ordinal)


def normalized(kind: Column, value: Column) -> Column:
    """Domains and urls in lower case, CVEs in upper case, all else as it is."""
    return F.when(kind.isin("domain", "url"), F.lower(value)).when(kind == "cve", F.upper(value)).otherwise(value)


def truthy(c: Column) -> Column:
    """Null where a string is empty."""
    return F.when(c != "", c)


def marked(text: Column, pattern: str) -> Column:
    """What lies between the matches of pattern and, at odd places, the matches: one pass of the regex engine, so
    look-around sees the whole text. U+0001 serves as the mark and must not be in text."""
    return F.split(F.regexp_replace(text, f"({pattern})", "\u0001$1\u0001"), "\u0001", -1)


def places(parts: Column) -> Column:
    """array(struct(start, end, value)) of the matches in marked() parts, places from 0, in order; none if null."""
    at = lambda ends: lambda i: F.struct(F.get(ends, 2 * i - 2).alias("start"), F.get(ends, 2 * i - 1).alias("end"), F.get(parts, 2 * i - 1).alias("value"))
    found = bound(scan(F.transform(parts, F.length), lambda a, b: a + b), lambda ends: F.transform(F.sequence(F.lit(1), F.floor(F.size(parts) / 2).cast("int")), at(ends)))
    return F.when(F.size(parts) > 1, found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def matches(text: Column, pattern: str) -> Column:
    """array(struct(start, end, value)) of all matches, places from 0, in order. No U+0001 may be in text."""
    return bound(marked(text, pattern), places)


def unmarked(c: Column) -> Column:
    """Text without the character that matches() uses as a mark."""
    return F.translate(text_of(c), "\u0001", " ")
