"""Explicit schemas; nothing is inferred."""

MESSAGES = (
    "message_id string, dedup_key string, date_utc timestamp, sender string, recipients string, cc string, subject string, "
    "subject_norm string, body string, body_new string, in_reply_to string, references string, has_list_unsubscribe boolean, "
    "source_path string, owner string, folder string"
)
BULK = "dedup_key string, date_utc timestamp, sender string"
CHUNKS = "chunk_id string, dedup_key string, thread_id string, ordinal int, text string, n_tokens int"
VECTORS = "id string, embedding array<float>"
RUNS = "qid string, run string, id string, score double, rank int"
EVAL_QUERIES = (
    "query_id string, query string, query_class string, relevant_message_ids array<string>, notes string, verified boolean, "
    "source_thread_id string, as_of string"
)
COMMITMENTS = (
    "message_id string, text string, kind string, direction string, owner string, counterparty string, due_phrase string, due_at date, "
    "due_precision string, due_ambiguous boolean, due_alternative date, due_rolled_year boolean, confidence double, quote string, "
    "model string, extracted_utc string"
)
