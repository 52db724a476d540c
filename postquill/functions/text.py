"""Text functions as Spark expressions. All are null-safe where noted and stay in
whole-stage code generation; none needs Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and limits that results depend on.
SUBJECT_PREFIX = r"(?i)^\s*(?:(?:re|fw|fwd|aw|sv)\s*(?:\[\d+\])?\s*:\s*)+"
QUOTE_BANNER = (
    r"(?im)^(?:\s*-{2,}\s*Original\s+Message\s*-{2,}|\s*-{2,}\s*Forwarded\s+by\b.*|\s*_{10,}\s*$"
    r"|\s*From:\s.+\n\s*Sent:\s.+|On\s.{0,80}\swrote:\s*$)"
)
STOPWORDS = """
a an and are as at be been by did do does for from had has have he her his i if
in into is it its me my of on or our she that the their them there they this to
was we were what when where which who why will with you your about
""".split()
BODY_IN_KEY = 8000
SOURCE_CHARS = 1400
REFUSAL = "INSUFFICIENT_CONTEXT"
MIN_TERM, MIN_CLAIM = 3, 25
CITATION = r"\[(\d+)\]"
META_STATEMENT = (
    r"(?i)\b(?:the|these|those|any|none of the|no)\s+(?:excerpts?|sources?|emails?|messages?|context|provided \w+)\b"
    r"[^.]{0,60}?\b(?:mention|state|say|indicate|specif|includ|contain|show|name|address|discuss|confirm|describ|reference)"
    r"|\bnot\s+(?:mentioned|stated|specified|found|included|available|clear)\b"
    r"|\bdo(?:es)?\s+not\s+(?:say|state|mention|specify|indicate|explicitly)\b"
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def normalize_subject(subject: Column | str) -> Column:
    """Lower-case subject without stacked reply and forward prefixes; null becomes empty."""
    return F.lower(F.trim(F.regexp_replace(text_or_empty(subject), SUBJECT_PREFIX, "")))


def strip_quoted(body: Column | str) -> Column:
    """What the sender typed: text before the first quote banner, without ``>`` lines."""
    head = F.regexp_replace(text_or_empty(body), QUOTE_BANNER + r"[\s\S]*", "")
    lines = F.filter(F.split(head, r"\r\n|\r|\n"), lambda x: ~F.ltrim(x).startswith(">"))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def utc_label(ts: Column) -> Column:
    """A UTC timestamp as content keys spell it; the fraction only where there is one."""
    micros = F.date_format(ts, "SSSSSS")
    base = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(F.when(micros == "000000", F.concat(base, F.lit("+00:00"))).otherwise(F.concat(base, F.lit("."), micros, F.lit("+00:00"))), F.lit("None"))


def content_key(sender, recipients, cc, subject, date_utc, body) -> Column:
    """Identity of a message by its content, not by its message id."""
    parts = [text_or_empty(x) for x in (sender, recipients, cc, subject)]
    joined = F.concat_ws("\u0000", *parts, utc_label(_c(date_utc)), F.substring(text_or_empty(body), 1, BODY_IN_KEY))
    return F.concat(F.lit("sha256:"), F.sha2(joined, 256))


def participants(sender="sender", recipients="recipients", cc="cc") -> Column:
    joined = F.concat_ws(";", *[text_or_empty(x) for x in (sender, recipients, cc)])
    return F.array_distinct(F.filter(F.split(joined, ";"), lambda x: x != ""))


def chunk_header(sender="sender", recipients="recipients", date_utc="date_utc", subject="subject") -> Column:
    day = F.coalesce(F.date_format(_c(date_utc), "yyyy-MM-dd"), F.lit("unknown-date"))
    return F.concat(
        F.lit("From: "), text_or_empty(sender), F.lit("\nTo: "), F.replace(text_or_empty(recipients), F.lit(";"), F.lit(", ")),
        F.lit("\nDate: "), day, F.lit("\nSubject: "), text_or_empty(subject), F.lit("\n\n"),
    )


def chunk_id(key: Column | str, ordinal: Column | str) -> Column:
    return F.concat_ws(":", _c(key).cast("string"), _c(ordinal).cast("string"))


def key_of_chunk(chunk: Column | str) -> Column:
    """Everything before the last colon; keys themselves may hold colons."""
    return F.regexp_replace(_c(chunk), ":[^:]*$", "")


def content_terms(text: Column | str) -> Column:
    """The distinct lower-case words of more than two letters that are no stop words."""
    found = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("[a-z0-9']+"), F.lit(0))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= MIN_TERM) & ~F.array_contains(stop, w)))


def term_overlap(query: Column | str, document: Column | str) -> Column:
    """Share of the query's content terms that the document has; 0 without terms."""
    q, d = content_terms(query), content_terms(document)
    return F.coalesce(F.size(F.array_intersect(q, d)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def plain_upper(text: Column | str) -> Column:
    """Upper case letter by letter: one whose capital is longer than itself (as of sharp s) stays."""
    same = lambda c: F.length(F.upper(c)) == F.length(c)
    letters = F.transform(F.split(_c(text), ""), lambda c: F.when(same(c), F.upper(c)).otherwise(c))
    return F.when(same(_c(text)), F.upper(_c(text))).otherwise(F.array_join(letters, ""))


def token_set(text: Column | str) -> Column:
    """Distinct alphanumeric tokens of more than two characters."""
    plain = F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 2))


def clip(text: Column | str, limit: int = SOURCE_CHARS) -> Column:
    """White space collapsed, cut at the last space before the limit."""
    flat = F.trim(F.regexp_replace(text_or_empty(text), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit), " [^ ]*$", ""), F.lit(" …")))


def citation_numbers(text: Column | str, n_sources: Column | int) -> tuple[Column, Column]:
    """Cited source numbers in order of first mention: those that exist, those that do not."""
    n = F.lit(n_sources) if isinstance(n_sources, int) else n_sources
    every = F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(CITATION), F.lit(1)), lambda x: x.try_cast("int")))
    fine = lambda x: x.isNotNull() & (x >= 1) & (x <= n)
    return F.filter(every, fine), F.filter(every, lambda x: ~F.coalesce(fine(x), F.lit(False)))


def sentences(text: Column | str) -> Column:
    return F.transform(F.split(F.trim(text_or_empty(text)), r"(?<=[.!?])\s+"), lambda s: F.trim(s))  # a bare F.trim would be given the index as what to trim


def uncited_claims(text: Column | str) -> Column:
    """Sentences that assert something and cite nothing."""
    claim = lambda s: (F.length(s) >= MIN_CLAIM) & ~s.endswith("?") & ~s.endswith(":") & ~s.rlike(CITATION) & ~s.rlike(META_STATEMENT)
    return F.filter(sentences(text), claim)


def split_claims(text: Column | str) -> Column:
    return F.filter(sentences(text), lambda s: F.length(s) > 3)


def is_refusal(text: Column | str) -> Column:
    return F.upper(F.trim(F.replace(text_or_empty(text), F.lit("*"), F.lit("")))).startswith(REFUSAL)


def clamp_unit(value: Column | str) -> Column:
    """A confidence within [0, 1]; what is no number becomes 0.5."""
    return F.when(_c(value).try_cast("double").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(value).try_cast("double"))))


def sent_label(day: Column | str) -> Column:
    return F.date_format(_c(day), "yyyy-MM-dd (EEEE)")


def request_key(**fields: Column) -> Column:
    """The address of a cached model response: a hash of its canonical request."""
    ordered = F.struct(*[c.alias(k) for k, c in sorted(fields.items())])
    return F.sha2(F.to_json(ordered), 256)


def unfenced(text: Column | str) -> Column:
    """A model's JSON answer without the code fence around it."""
    return F.trim(F.regexp_replace(text_or_empty(text), r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))


def string_list(text: Column | str, key: str) -> Column:
    """A list of strings, given bare or under ``key`` of an object."""
    bare = F.from_json(unfenced(text), "array<string>")
    held = F.from_json(unfenced(text), f"`{key}` array<string>").getField(key)
    return F.when(unfenced(text).startswith("["), bare).otherwise(held)


def format_sources_text(sources: Column | str) -> Column:
    """Numbered source blocks of array<struct<rank, sender, date, subject, text>>."""
    block = lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] From: "), text_or_empty(s["sender"]), F.lit("\nDate: "), F.coalesce(s["date"].cast("string"), F.lit("unknown-date")), F.lit("\nSubject: "), text_or_empty(s["subject"]), F.lit("\n"), text_or_empty(s["text"]))
    return F.array_join(F.transform(_c(sources), block), "\n\n")
