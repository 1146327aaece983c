"""Windows, top-k and set operations over history, logs and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.catalog.registry import query
from corpuskit.operators.scan import top_rows
from corpuskit.plans import history as H
from corpuskit.sources import tables as T


@query("W14_conversation_memory", """
    SELECT conv_id, string_agg('[' || CASE WHEN role = 'user' THEN 'USER' ELSE 'ASSISTANT' END || ']: ' || substr(text, 1, 500), chr(10) ORDER BY turn) AS memory, count(*) AS entries
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4 GROUP BY conv_id""")
def w14(t):
    return H.memory_block(t.conversations, 4)


@query("W17_time_since_previous", """
    SELECT event_id, user_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000, 3) AS gap_ms FROM events""")
def w17(t):
    day = F.to_date("ts")
    return H.since_previous(t.events, ["user_id"], ["ts", "event_id"], day).select("event_id", "user_id", "gap_ms")


@query("T5_top_n_with_overflow", """
    SELECT source, doc_id, rank, greatest(total - 10, 0) AS more FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS total FROM documents) WHERE rank <= 10""")
def t5(t):
    return H.top_with_overflow(t.documents, ["source"], [F.desc("n_chars"), F.col("doc_id")], 10).select("source", "doc_id", "rank", "more")


@query("T6_global_sorts", "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id")
def t6(t):
    return t.documents.select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id")


@query("T7_last_rows", "SELECT user_id, event_id, from_end FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS from_end FROM events) WHERE from_end <= 20")
def t7(t):
    return top_rows(t.events, ["user_id"], [F.desc("event_id")], 20, "from_end").select("user_id", "event_id", "from_end")


@query("T7_log_tail_totals", "SELECT event_type, event_id, total_lines FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY event_type) AS total_lines FROM events) WHERE r <= 100")
def t7_tail(t):
    return T.tail(t.events, ["event_type"], "event_id", 100).select("event_type", "event_id", "total_lines")


@query("T8_limit_by_id", "SELECT id, session_id, event_type FROM @history@ ORDER BY id DESC LIMIT 100")
def t8(t):
    return H.latest(t.history, 100).select("id", "session_id", "event_type")


@query("U4_list_merge", """
    SELECT DISTINCT session_id, field, item FROM (SELECT session_id, 'decided' AS field, event_type AS item FROM @history@ UNION ALL SELECT session_id, 'files_touched', 'repo__' || user_id % 30 FROM @history@
      UNION ALL SELECT session_id, 'files_touched', 'repo__' || id % 30 FROM @history@)""")
def u4(t):
    h = t.history
    saved = H.list_items(h.select("session_id", F.array("event_type").alias("decided"), F.array(F.concat(F.lit("repo__"), F.col("user_id") % 30)).alias("files_touched")),
                         "session_id", ["decided", "files_touched"])
    more = H.list_items(h.select("session_id", F.array(F.concat(F.lit("repo__"), F.col("id") % 30)).alias("files_touched")), "session_id", ["files_touched"])
    return H.merge_lists(saved, more)


@query("U5_missing_collections", """
    SELECT r.name, r.name IN (SELECT DISTINCT collection FROM @vectors@) AS present FROM (VALUES ('repo_code'), ('trm_code'), ('trm_notes'), ('trm_prose'), ('trm_tables'), ('wiki')) r(name)""")
def u5(t):
    from corpuskit.plans.quality import presence

    return presence(t.vectors, "collection", ["repo_code", "trm_code", "trm_notes", "trm_prose", "trm_tables", "wiki"])
