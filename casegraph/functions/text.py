"""Text rules as Column expressions: snippets, HTML, passages, identifiers, statutes, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of identifiers in text, in the order in which they are tried.
IDENTIFIERS = (
    ("GSTIN", r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])\b"), ("PAN", r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"), ("IFSC", r"\b([A-Z]{4}0[A-Z0-9]{6})\b"), ("AADHAAR", r"\b([2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4})\b"),
    ("VOTER", r"\b([A-Z]{3}[0-9]{7})\b"), ("PASSPORT", r"\b([A-PR-WY][1-9][0-9]{5}[1-9])\b"), ("UPI", r"\b([A-Za-z0-9._-]{2,}@[a-z]{2,12})\b(?![.-][a-z])"), ("EMAIL", r"\b([A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+)\b"), ("IP", r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b"), ("PHONE", r"\b([6-9][0-9]{9})\b"),
)
DATE_PATTERNS = (r"\b([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4})\b", r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b")
SECTIONS = r"(?i)\b(?:sections?|u/s|sec\.?)\s+([0-9]+[A-Z]?(?:\([0-9a-z]+\))?(?:\s*(?:,|/|and|&|r/w)\s*[0-9]+[A-Z]?(?:\([0-9a-z]+\))?)*)"


def snippet(text: Column, needle: Column, around: int = 90) -> Column:
    """What stands around the first hit of `needle`, white space squashed; null without a hit."""
    at = F.position(F.lower(needle), F.lower(text))
    first = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.trim(F.regexp_replace(F.substring(text, first, at + F.length(needle) + around - first), r"\s+", " ")))


def html_text(html: Column) -> Column:
    """Readable text: scripts, styles, navigation and comments go with their content, other tags become spaces."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style|nav|footer|header|aside|noscript|title)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


def readable(html: Column) -> Column:
    """The article or main part if there is one, with only lines of over 40 characters or with an end mark."""
    part = F.regexp_extract(html, r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>", 2)
    body = F.when(part != "", part).otherwise(html)
    lines = F.split(F.regexp_replace(body, r"(?i)<(?:p|br|li|h[1-6]|div)\b[^>]*>", "\n"), "\n")
    clean = F.transform(lines, html_text)
    return F.array_join(F.filter(clean, lambda x: (F.length(x) > 40) | x.rlike(r"[.!?]$")), "\n")


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1200, most: int = 3, least: int = 40) -> DataFrame:
    """(doc_id, n, passage): the first `most` pieces of `size` characters, pieces under `least` dropped. The index of whole texts is
    made with most=None."""
    count = F.ceil(F.length(text) / size).cast("int")
    n = F.greatest(count if most is None else F.least(F.lit(most), count), F.lit(1))
    each = docs.where(F.col(text).isNotNull()).select(doc_id, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("n"))
    out = each.select(doc_id, "n", F.trim(F.substring("_t", F.col("n") * size + 1, F.lit(size))).alias("passage"))
    return out.where(F.length("passage") >= least)


def identifiers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, value): every identifier in a text; a match inside an earlier kind's match is left out, as the earlier
    kinds' matches are blanked first."""
    rest, found = F.col(text), []
    for kind, pattern in IDENTIFIERS:
        values = F.regexp_extract_all(rest, F.lit(pattern), 1)
        found.append(F.arrays_zip(F.array_repeat(F.lit(kind), F.size(values)).alias("kind"), values.alias("value")))
        rest = F.regexp_replace(rest, pattern, "#")
    # one pattern hits all: only such texts go through the chain
    some = F.col(text).rlike("[0-9]{4}|@")
    return docs.where(some).select(doc_id, F.explode(F.flatten(F.array(*found))).alias("x")).select(doc_id, "x.kind", "x.value")


def dates(text: Column) -> Column:
    return F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), 1) for p in DATE_PATTERNS)))


def sections(text: Column) -> Column:
    lists = F.regexp_extract_all(text, F.lit(SECTIONS), 1)
    return F.array_distinct(F.flatten(F.transform(lists, lambda s: F.split(s, r"\s*(?:,|/|and|&|r/w)\s*"))))


def sentences(text: Column) -> Column:
    """Split after an end mark before a capital, not after common abbreviations."""
    guarded = F.regexp_replace(text, r"\b(Mr|Mrs|Ms|Dr|Shri|Smt|St|No|vs|etc|Rs|Sr|Jr|Adv|Prof|Ltd|Pvt|Co)\. ", "$1.\u0001")
    parts = F.split(guarded, r"(?<=[.!?])\s+(?=\p{Lu})")
    return F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "\u0001", " ")))


# --- the words of alerts ---


def money_text(x: Column) -> Column:
    return F.concat(F.lit("Rs "), F.format_number(x, 0))


def percent_text(x: Column) -> Column:
    return F.concat(F.round((x * 100).cast("decimal(18,4)"), 0).cast("int").cast("string"), F.lit("%"))


def span_text(start: Column, end: Column) -> Column:
    return F.concat_ws(" to ", F.date_format(start, "d MMM yyyy HH:mm"), F.date_format(end, "d MMM yyyy HH:mm"))


def burst_text(total: Column, share: Column, senders: Column) -> Column:
    return F.concat(money_text(total), F.lit(" from "), senders.cast("string"), F.lit(" senders, "), percent_text(share), F.lit(" of all that came in"))
