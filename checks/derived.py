"""Evaluation inputs derived from the given tables.

The texts below are plain SQL that Spark and DuckDB read alike, so both engines
start from the same rows. ``{name}`` stands for a given or derived table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NL = "chr(10)"


def _two(number: str) -> str:
    return f"lpad(CAST({number} AS STRING), 2, '0')"


_SEC = _two("second(ts)")
_MIN = _two("minute(ts)")
_HOUR = _two("hour(ts)")
_OTHER = _two("(event_id * 7) % 60")
_TAG = "' #' || CAST(event_id AS STRING)"

DERIVED = {
    # Questions: events ask about the video of their user.
    "questions": f"""
        SELECT event_id AS pos,
          CASE WHEN event_id % 97 = 13 THEN NULL WHEN event_id % 89 = 7 THEN ''
               ELSE 'v' || CAST(user_id AS STRING) END AS id,
          CASE event_type WHEN 'view' THEN 'Yes/No' WHEN 'click' THEN 'True/False'
               WHEN 'purchase' THEN 'Timestamp' WHEN 'signup' THEN 'Multiple Choice Question (MCQ)'
               ELSE CASE event_id % 6 WHEN 0 THEN 'Hypothetical' WHEN 1 THEN ' Yes/No '
                    WHEN 2 THEN 'Identity Confirmation (Validation)' WHEN 3 THEN 'Comparative'
                    WHEN 4 THEN 'Cross-view matching' ELSE NULL END END AS question_type,
          CASE WHEN event_id % 83 = 5 THEN '' WHEN event_id % 79 = 3 THEN '   '
               ELSE CASE event_id % 7
                 WHEN 0 THEN 'Does the visitor stay in view?'
                 WHEN 1 THEN 'Who walks in at 00:' || {_SEC} || '?'
                 WHEN 2 THEN 'Same person at 00:00:' || {_SEC} || ' and 00:00:' || {_OTHER} || '?'
                 WHEN 3 THEN 'Not 123:45, x12:34 or _01:02, but ' || {_MIN} || ':' || {_SEC} || '.'
                 WHEN 4 THEN 'Compare 00:00:' || {_OTHER} || ', 00:00:' || {_SEC} || ', 00:' ||
                             {_MIN} || ':' || {_SEC} || ' and 00:00:' || {_OTHER} || '.'
                 WHEN 5 THEN 'From 12:34:5 to 01:02:03:04 at ' || {_HOUR} || ':' || {_MIN} || '!'
                 ELSE 'Between (00:00:0' || CAST(event_id % 10 AS STRING) || ') and the end?' END
                 || {_TAG} END AS question,
          CASE WHEN event_id % 2 = 0 THEN 'Yes' ELSE {_MIN} || ':' || {_SEC} END AS answer
        FROM {{events}}""",
    # Videos: parts, with their size as the number of frames.
    "videos": """
        SELECT 'v' || CAST(p_partkey AS STRING) AS id,
          CAST(CASE p_size % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 WHEN 3 THEN 2.0
               ELSE 23.976 END AS DOUBLE) AS fps,
          CAST(CASE WHEN p_size % 11 = 0 THEN 0 ELSE p_size END AS BIGINT) AS total_frames
        FROM {part} WHERE p_brand <> 'Brand#13'""",
    "paths": """
        SELECT 'v' || CAST(p_partkey AS STRING) || CASE p_type WHEN 'ECONOMY' THEN '.mp4'
            WHEN 'SMALL' THEN '.mov' WHEN 'MEDIUM' THEN '.MP4' WHEN 'PROMO' THEN '.txt'
            ELSE '.mkv' END AS rel_path FROM {part}
        UNION ALL
        SELECT 'v' || CAST(p_partkey AS STRING) || '/clip' || CAST(p_size AS STRING) ||
            CASE p_size % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.mkv' WHEN 2 THEN '.mov'
            ELSE '.jpg' END AS rel_path FROM {part}
        UNION ALL
        SELECT 'v' || CAST(p_partkey AS STRING) || CASE p_type WHEN 'MEDIUM' THEN '/_b.mov'
            WHEN 'ECONOMY' THEN '.mov' ELSE '/notes.txt' END AS rel_path FROM {part}
        UNION ALL
        SELECT 'v' || CAST(p_partkey AS STRING) || '/part/clip.mp4' AS rel_path FROM {part}""",
    "frame_index": """
        SELECT 'v' || CAST(l_partkey AS STRING) AS id, CAST(l_quantity AS BIGINT) - 1 AS idx
        FROM {lineitem}""",
    "first_frame": """
        SELECT 'v' || CAST(p_partkey AS STRING) AS id FROM {part} WHERE p_type <> 'LARGE'""",
    # Replies: whole documents behind openings that the reply rules must handle.
    "replies": f"""
        SELECT doc_id AS pos,
          CASE doc_id % 4 WHEN 0 THEN 'Yes/No' WHEN 1 THEN 'True/False' WHEN 2 THEN 'Timestamp'
               ELSE 'Comparative' END AS question_type,
          CASE CAST(floor(doc_id / 4) AS BIGINT) % 13
            WHEN 0 THEN 'Yes, I think so. Because ' || text
            WHEN 1 THEN 'It cannot be. because ' || text
            WHEN 2 THEN 'system' || {_NL} || 'x' || {_NL} || 'user' || {_NL} || text || {_NL} ||
                        'assistant' || {_NL} || 'True' || {_NL} || 'Because 00:12'
            WHEN 3 THEN text
            WHEN 4 THEN 'Assistant: around ' || {_two('doc_id % 60')} || ':13 ' || text
            WHEN 5 THEN 'user' || {_NL} || 'Because yes ' || text
            WHEN 6 THEN 'x12:34 Because it is false at 00:00:0' || CAST(doc_id % 10 AS STRING)
            WHEN 7 THEN NULL
            WHEN 8 THEN '  ' || {_NL}
            WHEN 9 THEN 'the assistant says 01:02:03:04 ' || text
            WHEN 10 THEN 'assistant' || {_NL} || 'user'  || {_NL} || ' Because no. ' || text
            WHEN 11 THEN '{{{{"answer": "No", "answer_type": "yes_no"}}}}'
            ELSE 'a' || {_NL} || 'assistants rule ' || text END AS reply
        FROM {{documents}}""",
    "type_names": """
        SELECT event_id AS pos,
          CASE event_id % 24 WHEN 0 THEN 'Yes/No' WHEN 1 THEN 'Identity Confirmation'
            WHEN 2 THEN 'Identity Confirmation (Validation)'
            WHEN 3 THEN 'Identity Confirmation (Validation, Yes/No)'
            WHEN 4 THEN 'Clothing-change tracking' WHEN 5 THEN 'Temporal continuity'
            WHEN 6 THEN 'Cross-view matching' WHEN 7 THEN 'Temporal-appearance drift'
            WHEN 8 THEN 'True/False' WHEN 9 THEN 'Timestamp'
            WHEN 10 THEN 'Multiple Choice Question (MCQ)' WHEN 11 THEN 'Short MCQ'
            WHEN 12 THEN 'Descriptive Identification' WHEN 13 THEN 'Activity-based'
            WHEN 14 THEN 'Interaction-based' WHEN 15 THEN 'Group-context based'
            WHEN 16 THEN 'Environment-linked' WHEN 17 THEN 'Comparative'
            WHEN 18 THEN 'Hypothetical' WHEN 19 THEN 'Cross-modal' WHEN 20 THEN ' Timestamp '
            WHEN 21 THEN 'timestamp' WHEN 22 THEN props ELSE NULL END AS question_type,
          event_type || ' of ' || CAST(user_id AS STRING) || '?' AS question,
          event_id % 23 AS frame_count
        FROM {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one built on it."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sources = {given: table(spark, sf_dir, given)
               for given in ("events", "part", "lineitem", "documents")
               if f"{{{given}}}" in DERIVED[name]}
    return spark.sql(DERIVED[name], **sources)


def as_cte(name: str) -> str:
    """The same derivation as a common table expression for DuckDB."""
    sql = DERIVED[name]
    for given in ("events", "part", "lineitem", "documents"):
        sql = sql.replace(f"{{{given}}}", given)
    return f"{name} AS ({sql.replace('{{', '{').replace('}}', '}')})"
