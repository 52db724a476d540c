"""Classifiers as boolean and string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, text_or_empty, token_set

# Patterns and lists that results depend on.
NO_REPLY = (
    r"(?i)(?:^|[._-])(?:no[._-]?reply|do[._-]?not[._-]?reply|notification|notifications"
    r"|mailer[._-]?daemon|postmaster|bounce|listserv|majordomo|automail|autoreply)"
)
BULK_SENDERS = (
    "enron.announcements@enron.com",
    "enron_announcements@enron.com",
    "announcements.enron@enron.com",
    "outlook.team@enron.com",
    "ubsw.energy.announcements@enron.com",
    "perfmgmt@enron.com",
    "ezonline@enron.com",
)
BULK_SUBJECT = (
    r"(?i)^(?:\s*(?:re|fw|fwd)\s*:\s*)*\s*(?:out of (?:the )?office|automatic reply|undeliverable"
    r"|delivery status notification|returned mail|read:|tw:|newsletter|unsubscribe)"
)
MIN_BODY = 20
COMMITMENT_HINT = (
    r"(?i)\b(?:by (?:tomorrow|today|monday|tuesday|wednesday|thursday|friday|next|end of|the)"
    r"|due|deadline|deliver|delivery|submit|send (?:me|us|it|over|by)"
    r"|need(?:s|ed)? (?:to|by|it)|please (?:review|send|confirm|sign|approve|get)"
    r"|action item|follow up|followup|asap|urgent"
    r"|before (?:the )?(?:meeting|call|close|monday|tuesday|wednesday|thursday|friday)"
    r"|no later than|not later than|end of (?:day|week|month|quarter|business)"
    r"|eod|eow|eom|eoq|cob"
    r"|(?:this|next) (?:week|month|quarter|monday|tuesday|wednesday|thursday|friday)"
    r"|tomorrow|yesterday|\d{1,2}/\d{1,2}|\d{4}-\d{2}-\d{2}"
    r"|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2}"
    r"|i(?:'ll| will) (?:send|get|have|call|review|follow)"
    r"|(?:can|could|would) you (?:send|get|review|confirm|sign|have))\b"
)
TEMPORAL = (
    r"(?i)\b(?:what(?:'s| is| are)?\s+(?:due|outstanding|pending|overdue|open)"
    r"|due (?:this|next|last|by|before|on|in)\b"
    r"|(?:this|next|last) (?:week|month|quarter|monday|tuesday|wednesday|thursday|friday)"
    r"|overdue|deadlines?|by when|how soon"
    r"|before (?:the )?end of (?:the )?(?:week|month|quarter|day)"
    r"|in the (?:next|last|past) \d+ (?:days?|weeks?|months?)"
    r"|between .{0,20}and .{0,20}\b(?:19|20)\d{2}"
    r"|\bon \d{4}-\d{2}-\d{2}\b|\btoday\b|\byesterday\b|\btomorrow\b)"
)
AGGREGATE = (
    r"(?i)\b(?:how many|how much|count of|number of|total (?:number|count|amount)|list all|show all"
    r"|every (?:commitment|deadline|message|email)|per (?:week|month|person|sender))\b"
)
SEMANTIC = (
    r"(?i)\b(?:what did|what was (?:decided|agreed|said)|why|how come|explain"
    r"|about|regarding|discussion|context|reason|terms|details|who (?:said|wrote|asked|decided|thinks?)"
    r"|\b(?:mail|emails?|messages?)\b.{0,20}\b(?:get|got|receive|received|arrived)\b"
    r"|\b(?:get|got|receive|received|arrived)\b.{0,20}\b(?:mail|emails?|messages?)\b"
    r"|\bsummar(?:y|ize|ise)\b|\babstract\b)\b"
)
ENTITY = r"(?i)\b(?:from|to|sent by|cc'?d|between)\s+[a-z][\w.\-]*(?:@|\s+[a-z])"
OVERDUE = r"(?i)\b(?:overdue|late|past due|still (?:open|outstanding))\b"
DATE_LANGUAGE = (
    r"(?i)\b(?:mon|tues|wednes|thurs|fri|satur|sun)day\b|\btomorrow\b|\bnext week\b"
    r"|\bby (?:the )?\d{1,2}(?:st|nd|rd|th)?\b|\bdeadline\b|\bdue\b|\beod\b"
    r"|\bcob\b|\bby friday\b|\bthis week\b|\bend of (?:the )?(?:week|month|day)\b"
)
ROUTES = ("sql", "hybrid", "both")
KINDS = ("deliverable", "meeting", "payment", "review", "decision", "other")
DIRECTIONS = ("i_owe", "they_owe", "mutual", "unclear")


def is_bulk(sender="sender", subject="subject", body_new="body_new", has_list="has_list_unsubscribe") -> Column:
    """Machine-made or broadcast mail, or a body too short to retrieve."""
    who = F.lower(text_or_empty(sender))
    return (
        F.coalesce(_c(has_list), F.lit(False)) | who.isin(*BULK_SENDERS) | who.rlike(NO_REPLY)
        | text_or_empty(subject).rlike(BULK_SUBJECT) | (F.length(F.trim(text_or_empty(body_new))) < MIN_BODY)
    )


def looks_like_commitment(text: Column | str) -> Column:
    return text_or_empty(text).rlike(COMMITMENT_HINT)


def route(question: Column | str) -> Column:
    """sql, hybrid, both, or null where the phrasing does not settle it."""
    q = text_or_empty(question)
    temporal, content = q.rlike(TEMPORAL), q.rlike(SEMANTIC) | q.rlike(ENTITY)
    return (
        F.when(F.trim(q) == "", None).when(q.rlike(AGGREGATE), "sql").when(temporal & content, "both")
        .when(temporal, "sql").when(content, "hybrid")
    )


def is_overdue_question(question: Column | str) -> Column:
    return text_or_empty(question).rlike(OVERDUE)


def same_commitment(message_a, text_a, message_b, text_b, threshold: float = 0.5) -> Column:
    """Same message, and enough of the smaller token set shared."""
    a, b = token_set(text_a), token_set(text_b)
    least = F.least(F.size(a), F.size(b))
    return (_c(message_a) == _c(message_b)) & (least > 0) & (F.size(F.array_intersect(a, b)) >= threshold * least)


def commitment_problems() -> Column:
    """The names of the rules that a commitment row breaks."""
    rules = {
        "no message": text_or_empty("message_id") == "",
        "empty text": F.trim(text_or_empty("text")) == "",
        "unknown kind": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        "unknown direction": ~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)),
        "confidence out of range": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "due date without a phrase": F.col("due_at").isNotNull() & (text_or_empty("due_phrase") == ""),
    }
    return F.filter(F.array(*[F.when(broken, name) for name, broken in rules.items()]), lambda x: x.isNotNull())
