"""Mail as a source: files or raw bytes to message rows.

MIME parsing has no built-in expression, so each Arrow batch is parsed with the
standard library in Python; everything derivable from the parsed fields (subject
without prefixes, new text, content key) is added by expressions afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress
from datetime import UTC
from email import policy
from email.errors import HeaderParseError
from email.header import decode_header, make_header
from email.iterators import typed_subpart_iterator
from email.parser import BytesParser
from email.utils import getaddresses, parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_key, normalize_subject, strip_quoted

#: Tried in this order; what neither fits is Latin-1, which gives every byte a character.
STRICT = ("utf-8", "cp1252")
FIELDS = "message_id string, date_utc timestamp, sender string, recipients string, cc string, subject string, body string, in_reply_to string, references string, has_list_unsubscribe boolean"


def _if_it_fits(raw: bytes, charset: str) -> str | None:
    with suppress(UnicodeDecodeError):
        return raw.decode(charset)


def decoded(raw: bytes) -> str:
    """The text that the bytes themselves allow; the charset that a message names is not asked."""
    readings = (_if_it_fits(raw, charset) for charset in STRICT)
    return next((text for text in readings if text is not None), raw.decode("latin-1"))


def _word(raw: bytes | str, charset: str | None) -> str:
    """One word of a header; of one that its charset does not fit, each bad byte is marked."""
    if isinstance(raw, str):
        return raw
    try:
        return raw.decode(charset or "ascii", "replace")
    except LookupError:  # no such charset
        return decoded(raw)


def header(message, name: str) -> str:
    """A header with its encoded words read; a word that cannot be read spoils no other."""
    value = str(message.get(name, ""))
    try:
        words = decode_header(value)
    except HeaderParseError:
        return value
    try:
        return str(make_header(words))
    except (ValueError, LookupError):
        return " ".join(filter(None, (_word(*w).strip() for w in words)))


def addresses(value: str) -> str:
    found = (addr.strip().lower() for _, addr in getaddresses([value]))
    return ";".join(dict.fromkeys(a for a in found if a))


def moment(value: str):
    """The header date in UTC; without a zone it is taken as UTC, otherwise bad is null."""
    try:
        when = parsedate_to_datetime(value)
        return (when if when.tzinfo else when.replace(tzinfo=UTC)).astimezone(UTC)
    except (ValueError, TypeError, OverflowError, IndexError):
        return None


def body(message) -> str:
    """The plain text parts, one below the other; a message without parts is one, whatever its type."""
    parts = typed_subpart_iterator(message, "text", "plain") if message.is_multipart() else iter((message,))
    payloads = (part.get_payload(decode=True) for part in parts)
    return "\n".join(decoded(raw) if raw else "" for raw in payloads)


def parsed(raw: bytes | None) -> dict | None:
    """The fields of one message, or None for what is no message."""
    if raw is None:
        return None
    try:
        message = BytesParser(policy=policy.compat32).parsebytes(raw)
        return {
            "message_id": header(message, "Message-ID").strip(), "date_utc": moment(header(message, "Date")), "sender": addresses(header(message, "From")),
            "recipients": addresses(header(message, "To")), "cc": addresses(header(message, "Cc")), "subject": header(message, "Subject").replace("\n", " ").strip(),
            "body": body(message), "in_reply_to": header(message, "In-Reply-To").strip(), "references": header(message, "References").strip(),
            "has_list_unsubscribe": message.get("List-Unsubscribe") is not None,
        }
    except (ValueError, TypeError):
        return None


_ARROW = pa.schema([
    ("source_path", pa.string()), ("message_id", pa.string()), ("date_utc", pa.timestamp("us", "UTC")), ("sender", pa.string()), ("recipients", pa.string()), ("cc", pa.string()),
    ("subject", pa.string()), ("body", pa.string()), ("in_reply_to", pa.string()), ("references", pa.string()), ("has_list_unsubscribe", pa.bool_()),
])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fields = parsed(raw)
            if fields is not None:
                rows.append({"source_path": path, **fields})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def parse_messages(raw: DataFrame, path: str = "source_path", content: str = "content") -> DataFrame:
    """Message rows (schemas.MESSAGES) of raw RFC 822 bytes; what cannot be parsed is dropped.
    Owner and folder are the first and the middle parts of the path."""
    rows = raw.select(F.col(path).alias("source_path"), F.col(content).alias("content")).mapInArrow(_parse, "source_path string, " + FIELDS)
    parts = F.split("source_path", "/")
    return rows.select(
        "message_id", content_key("sender", "recipients", "cc", "subject", "date_utc", "body").alias("dedup_key"), "date_utc", "sender", "recipients", "cc", "subject",
        normalize_subject("subject").alias("subject_norm"), "body", strip_quoted("body").alias("body_new"), "in_reply_to", "references", "has_list_unsubscribe", "source_path",
        F.get(parts, F.lit(0)).alias("owner"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "/").alias("folder"),
    )


def read_maildir(spark: SparkSession, root: str) -> DataFrame:
    """All mail below ``root`` in parallel, dot files left out; paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + root.rstrip("/").split("://")[-1].replace(".", r"\.") + "/", "")
    return parse_messages(files.select(relative.alias("source_path"), "content").where(~F.col("source_path").rlike(r"(^|/)\.")))


def read_raw_base64(rows: DataFrame, column: str = "raw") -> DataFrame:
    """Mail as web services hand it out: URL-safe base64, padding optional."""
    plain = F.translate(F.col(column), "-_", "+/")
    pad = F.repeat(F.lit("="), F.pmod(4 - F.pmod(F.length(plain), F.lit(4)), F.lit(4)).cast("int"))
    return parse_messages(rows.withColumn("content", F.unbase64(F.concat(plain, pad))))
