"""The queries again, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from checks.derived import as_cte
from checks.queries import LENIENT, REMOTE, STRICT, VIDEOS_DIR
from clipquest.config import EvalConfig
from clipquest.functions import prompts

_RX = r"\b([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?\b"
_LOOSE = r"[0-9]{2}:[0-9]{2}(?::[0-9]{2})?\b"
# What counts as whitespace, for trim.
_WS = ("chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '"
       "||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)"
       "||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)"
       "||chr(8239)||chr(8287)||chr(12288)")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(names: list[str], body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([as_cte(n) for n in names] + list(ctes)) + "\n" + body


def _strip(x: str) -> str:
    return f"trim({x}, {_WS})"


# Items and timecodes

_COMPLETE = "(coalesce(id,'') <> '' AND coalesce(question,'') <> '' AND coalesce(question_type,'') <> '')"
_VALID = f"valid AS (SELECT * FROM questions WHERE {_COMPLETE})"


def _seconds(tc: str, two_field: str = "hhmm") -> str:
    h, m, s = (f"CAST(split_part({tc}, ':', {i}) AS BIGINT)" for i in (1, 2, 3))
    three = f"{h}*3600 + {m}*60 + {s}"
    two = f"{h}*3600 + {m}*60" if two_field == "hhmm" else f"{h}*60 + {m}"
    return f"CASE WHEN {tc} LIKE '%:%:%' THEN {three} ELSE {two} END"


_HINTS = (f"list_sort([{_seconds('tc')} FOR tc IN regexp_extract_all(question, '{_RX}')])")
_HINTED = f"hinted AS (SELECT *, {_HINTS} AS hints FROM valid)"
_HINTS_TEXT = "array_to_string([CAST(h AS VARCHAR) FOR h IN hints], ',')"

_ANSWER_COLUMNS = """
    CASE WHEN pos % 3 = 0 THEN '' ELSE upper(question_type) END AS model_answer,
    question AS model_raw,
    CASE WHEN pos % 4 = 0 THEN 'Because of "quotes"' END AS model_rationale,
    CASE WHEN pos % 5 > 0 THEN 'videos/' || id || '.mp4' END AS video_path"""


# Replies

def _normal(x: str, kind: str, mode: str) -> str:
    """Answer of stripped text ``x`` for the type expression ``kind``."""
    miss = "''" if mode == "strict" else x

    def pair(a: str, b: str) -> str:
        low = f"lower({x})"
        return (f"CASE WHEN contains({low}, '{a.lower()}') AND NOT contains({low}, '{b.lower()}') THEN '{a}'"
                f" WHEN contains({low}, '{b.lower()}') AND NOT contains({low}, '{a.lower()}') THEN '{b}'"
                f" WHEN left({low}, 1) = '{a[0].lower()}' THEN '{a}'"
                f" WHEN left({low}, 1) = '{b[0].lower()}' THEN '{b}' ELSE {miss} END")

    def clock(rx: str) -> str:
        found = f"regexp_extract({x}, '{rx}')"
        return (f"CASE length({found}) WHEN 0 THEN NULL WHEN 5 THEN {found} || ':00' "
                f"ELSE {found} END")

    times = [clock(_RX)] + ([clock(_LOOSE)] if mode == "strict" else []) + [miss]
    return (f"CASE {kind} WHEN 'Yes/No' THEN {pair('Yes', 'No')} "
            f"WHEN 'True/False' THEN {pair('True', 'False')} "
            f"WHEN 'Timestamp' THEN coalesce({', '.join(times)}) ELSE {x} END")


def _answer_part(x: str) -> str:
    return _strip(f"regexp_replace({x}, '(?is)because .+', '')")


def _rationale_part(x: str) -> str:
    return _strip(f"regexp_extract({x}, '(?is)because .+')")


def _cut(x: str) -> str:
    return _strip(rf"regexp_replace({x}, '(?is)\A.*?(?:\A|\n)assistant', '')")


def _normalized(kind: str) -> str:
    text = f"t AS (SELECT pos, {_strip(chr(99) + 'oalesce(reply, ' + chr(39) * 2 + ')')} AS x FROM replies)"
    return _with(["replies"], f"""SELECT pos, {_normal('x', _q(kind), 'strict')} AS strict_answer,
        {_normal('x', _q(kind), 'lenient')} AS lenient_answer FROM t""", text)


def _parse(mode: str, source: str, keep: str) -> list[str]:
    """CTEs that turn ``source`` (keep, question_type, reply, error) into ``parsed``."""
    s0 = f"s0 AS (SELECT {keep}, question_type, error, {_strip('coalesce(reply,' + chr(39) * 2 + ')')} AS full_text FROM {source})"
    if mode == "strict":
        s1 = (f"s1 AS (SELECT *, {_answer_part('full_text')} AS main, "
              f"{_rationale_part('full_text')} AS because FROM s0)")
        return [s0, s1, f"""parsed AS (SELECT {keep},
            CASE WHEN error IS NOT NULL THEN '[ERROR]' ELSE {_normal('main', 'question_type', 'strict')} END AS parsed_answer,
            CASE WHEN error IS NOT NULL THEN '[ERROR] ' || error ELSE main END AS parsed_raw,
            CASE WHEN error IS NOT NULL THEN '' ELSE because END AS parsed_rationale,
            error IS NOT NULL AS failed FROM s1)"""]
    s1 = f"s1 AS (SELECT *, {_cut('full_text')} AS said FROM s0)"
    s2 = (f"s2 AS (SELECT *, {_answer_part('said')} AS main, {_rationale_part('said')} AS because "
          f"FROM s1)")
    s3 = (f"s3 AS (SELECT *, {_normal('main', 'question_type', 'lenient')} AS a, "
          f"{_normal('because', 'question_type', 'lenient')} AS b FROM s2)")
    roles = "('system', 'user', 'assistant')"
    return [s0, s1, s2, s3, f"""parsed AS (SELECT {keep},
        CASE WHEN error IS NOT NULL THEN '[ERROR]'
          WHEN question_type IN ('Yes/No', 'True/False') THEN
            CASE WHEN (a = '' OR lower(a) IN {roles}) AND b <> '' AND lower(b) NOT IN {roles}
                 THEN b ELSE a END
          WHEN question_type = 'Timestamp' THEN
            CASE WHEN regexp_matches(a, '{_RX}') THEN a
                 WHEN regexp_matches(b, '{_RX}') THEN b ELSE '00:00:00' END
          ELSE a END AS parsed_answer,
        CASE WHEN error IS NOT NULL THEN '[ERROR] ' || error ELSE full_text END AS parsed_raw,
        CASE WHEN error IS NOT NULL THEN '' ELSE because END AS parsed_rationale,
        error IS NOT NULL AS failed FROM s3)"""]


# Prompts

def _case(key: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {_q(default)} END"


# The fixed texts and type lists once more, so that a wrong one shows.
_WHY = " Then add one short sentence rationale starting with 'Because'."
_GUESS = " If unsure, guess the most likely."
_YES_NO = f"Answer strictly with Yes or No.{_GUESS}{_WHY}"
_DIRECTIVE = _case("question_type", {
    "Timestamp": "Answer strictly with a timestamp in HH:MM:SS.",
    "True/False": "Answer strictly True or False.",
    "Yes/No": "Answer strictly Yes or No."}, "Answer concisely.")
_INSTRUCTION = _case("question_type", {
    "Hypothetical": _YES_NO, "Identity Confirmation": _YES_NO,
    "Identity Confirmation (Validation)": _YES_NO, "Yes/No": _YES_NO,
    "Multiple Choice Question (MCQ)":
        f"Answer strictly with the letter of the correct option (e.g., A, B, C, or D).{_WHY}",
    "Timestamp": "Answer strictly with a timestamp in HH:MM:SS. If no clear answer, return the most "
                 f"plausible timestamp in HH:MM:SS.{_WHY}",
    "True/False": f"Answer strictly with True or False.{_GUESS}{_WHY}"}, f"Answer concisely.{_WHY}")
_YES_NO_KINDS = ["Clothing-change tracking", "Cross-view matching", "Identity Confirmation",
                 "Identity Confirmation (Validation)", "Identity Confirmation (Validation, Yes/No)",
                 "Temporal continuity", "Temporal-appearance drift", "Yes/No"]
_FREE_KINDS = ["Activity-based", "Comparative", "Cross-modal", "Descriptive Identification",
               "Environment-linked", "Group-context based", "Hypothetical", "Interaction-based"]
_C = "chr(10) || chr(10) || 'Constraints: '"
_DIRECTED = f"(question || {_C} || {_DIRECTIVE})"
_STRICT_TEXT = f"({_DIRECTED} || {_C} || {_INSTRUCTION})"
_TEXTS = prompts.PromptTexts()
_KIND = _strip("coalesce(question_type, '')")


def _by_kind(yes_no, true_false, timestamp, option, described, other) -> str:
    def names(values):
        return "(" + ", ".join(map(_q, values)) + ")"

    return (f"CASE WHEN {_KIND} IN {names(_FREE_KINDS)} THEN {_q(described)} "
            f"WHEN {_KIND} LIKE '%Multiple Choice Question%' OR {_KIND} LIKE '%MCQ%' THEN {_q(option)} "
            f"WHEN {_KIND} = 'Timestamp' THEN {_q(timestamp)} "
            f"WHEN {_KIND} = 'True/False' THEN {_q(true_false)} "
            f"WHEN {_KIND} IN {names(_YES_NO_KINDS)} THEN {_q(yes_no)} ELSE {_q(other)} END")


_ANSWER_TYPE = _by_kind("yes_no", "yes_no", "timestamp", "mcq_option", "free_text", "free_text")
_GUIDE = _by_kind(_TEXTS.yes_no, _TEXTS.true_false, _TEXTS.timestamp, _TEXTS.option,
                  _TEXTS.described, _TEXTS.free_text)
_SYSTEM = (f"replace(replace({_q(_TEXTS.system)}, '{{answer_type}}', {_ANSWER_TYPE}), "
           f"'{{guide}}', {_GUIDE})")


def _lenient_text(frame_count: str) -> str:
    return (f"('Kind of question: ' || question_type || chr(10) || 'Frames shown: ' || {frame_count} "
            f"|| chr(10) || chr(10) || 'Question: ' || {_DIRECTED} || chr(10) || chr(10) || "
            f"{_q(_TEXTS.closing)})")


_TYPED = "typed AS (SELECT * FROM type_names WHERE question_type IS NOT NULL)"


def _capped(cap: int) -> str:
    return f"least(frame_count, {cap})"


def _video_messages() -> str:
    n = _capped(STRICT.frames_sent)
    return _with(["type_names"], f"""
        SELECT pos, 0 AS message_no, 'user' AS role, 0 AS part_no, 'video' AS type,
          CAST(NULL AS VARCHAR) AS text,
          array_to_string(['f' || i FOR i IN range(1, {n} + 1)], '|') AS refs
        FROM typed WHERE frame_count > 0
        UNION ALL
        SELECT pos, 0, 'user', CASE WHEN frame_count > 0 THEN 1 ELSE 0 END, 'text', {_STRICT_TEXT}, NULL
        FROM typed""", _TYPED)


def _image_messages(kind: str, system: str, text: str, cap: int) -> str:
    return _with(["type_names"], f"""
        SELECT pos, 0 AS message_no, 'system' AS role, 0 AS part_no, 'text' AS type,
          {system} AS text, CAST(NULL AS VARCHAR) AS refs FROM typed
        UNION ALL
        SELECT pos, 1, 'user', 0, 'text', {text}, NULL FROM typed
        UNION ALL
        SELECT pos, 1, 'user', CAST(i AS INTEGER), '{kind}', NULL, 'f' || i
        FROM (SELECT pos, unnest(range(1, {_capped(cap)} + 1)) AS i FROM typed)""", _TYPED)


# Frame plans

_FPS = "CASE WHEN coalesce(fps, 0) = 0 THEN CAST(25 AS DOUBLE) ELSE fps END"
_DURATION = f"CASE WHEN total_frames > 0 THEN total_frames / ({_FPS}) ELSE CAST(0 AS DOUBLE) END"
_LAST = f"greatest(CAST(0 AS DOUBLE), ({_DURATION}) - CAST(1e-6 AS DOUBLE))"


def _plan(source: str, config: EvalConfig, keep: str) -> list[str]:
    """CTEs from ``source`` (hints, fps, total_frames) to ``plan`` with its ``times``."""
    n, r = config.frames_per_question, config.radius
    around = ", ".join(f"greatest(CAST(0 AS DOUBLE), least(last_t, h + CAST({d} AS DOUBLE)))"
                       for d in (-r, 0.0, r))
    return [
        f"p0 AS (SELECT *, {_LAST} AS last_t FROM {source})",
        f"""p1 AS (SELECT *, CASE WHEN len(hints) > 0 THEN flatten([[{around}] FOR h IN hints])
            ELSE [(i + CAST(0.5 AS DOUBLE)) / CAST({n} AS DOUBLE) * last_t FOR i IN range({n})] END AS w FROM p0)""",
        """p2 AS (SELECT *, list_sort(list_distinct(
            [CAST(printf('%.2f', x) AS DOUBLE) FOR x IN w])) AS tidy FROM p1)""",
        f"""plan AS (SELECT {keep}, fps, total_frames, hints,
            [tidy[CAST(i AS BIGINT) + 1] FOR i IN range(0, len(tidy),
              CAST(greatest(1, ceil(len(tidy) / {config.max_frames})) AS BIGINT))] AS times FROM p2)""",
    ]


def _number(t: str) -> str:
    return f"CAST(round_even({t} * ({_FPS}), 0) AS BIGINT)"


def _plan_rows(key: str) -> str:
    return f"""SELECT {key}, CAST(n - 1 AS INTEGER) AS n, t, {_number('t')} AS idx FROM (
        SELECT {key}, fps, unnest(times) AS t, unnest(range(1, len(times) + 1)) AS n FROM plan)"""


def _document_plan(config: EvalConfig) -> str:
    return _with([], _plan_rows("doc_id"), """docs AS (SELECT doc_id, CAST(25 AS DOUBLE) AS fps,
        n_chars AS total_frames, CAST([] AS BIGINT[]) AS hints FROM documents)""",
                 *_plan("docs", config, "doc_id"))


# Assets and frames

_MANIFEST = r"""manifest AS (
    SELECT *, regexp_extract(rel_path, '\.([a-z0-9]+)$', 1) AS ext FROM (
      SELECT regexp_replace(rel_path, '\.[a-z0-9]+$', '') AS id, rel_path, false AS in_subdir FROM paths
      UNION ALL
      SELECT regexp_replace(rel_path, '/[^/]*$', ''), rel_path, true FROM paths WHERE contains(rel_path, '/'))
    WHERE regexp_matches(rel_path, '\.(mp4|mkv|mov)$'))"""
_BEST = f"""best AS (SELECT id, '{VIDEOS_DIR}/' || rel_path AS video_path FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY in_subdir,
      CASE ext WHEN 'mp4' THEN 1 WHEN 'mkv' THEN 2 ELSE 3 END, rel_path) AS rn FROM manifest)
    WHERE rn = 1)"""
_STEM = r"regexp_replace(regexp_extract(video_path, '[^/]*$'), '\.[^.]+$', '')"
_FOLDER = "regexp_extract(video_path, '^.*/')"


def _frame_path(tag: str) -> str:
    return f"({_FOLDER} || '_frames_' || {_STEM} || '/' || {_STEM} || '_' || {tag} || '.jpg')"


_PREFIX = """runs AS (SELECT id, idx, row_number() OVER (PARTITION BY id ORDER BY idx) - 1 AS rn
      FROM (SELECT DISTINCT id, idx FROM frame_index)),
    prefixes AS (SELECT id, count(*) FILTER (WHERE idx = rn) AS readable FROM runs GROUP BY id)"""


def _selected(config: EvalConfig) -> list[str]:
    """CTEs up to ``selected``: every plan key with its tier and list of frames."""
    want = max(1, min(config.max_frames, config.frames_per_question))
    seek = _frame_path("CAST(CAST(round_even(t * 1000, 0) AS BIGINT) AS VARCHAR)")
    scan = _frame_path("'ls' || i")
    return [
        _VALID, _HINTED, _MANIFEST, _BEST, _PREFIX,
        "pkeys AS (SELECT id, hints, count(*) AS questions FROM hinted GROUP BY id, hints)",
        """known AS (SELECT k.id, k.hints, b.video_path, v.fps, coalesce(v.total_frames, 0) AS total_frames,
              v.id IS NOT NULL AS openable, coalesce(p.readable, 0) AS readable,
              k.id IN (SELECT id FROM first_frame) AS grabbed
            FROM pkeys k JOIN best b ON b.id = k.id LEFT JOIN videos v ON v.id = k.id
            LEFT JOIN prefixes p ON p.id = k.id)""",
        *_plan("known", config, "id, video_path, openable, readable, grabbed"),
        f"""sought AS (SELECT id, hints, list({{'t': t, 'idx': idx, 'path': {seek}}} ORDER BY t) AS frames
            FROM (SELECT id, hints, video_path, t, {_number('t')} AS idx
                  FROM (SELECT id, hints, video_path, fps, unnest(times) AS t FROM plan WHERE openable)) w
            WHERE EXISTS (SELECT 1 FROM frame_index f WHERE f.id = w.id AND f.idx = w.idx)
            GROUP BY id, hints)""",
        f"""tiers AS (SELECT p.*, s.frames AS sought, {_FPS} AS rate,
              greatest(1, total_frames // {want + 1}) AS stride,
              CASE WHEN NOT openable THEN 0 WHEN s.frames IS NOT NULL THEN 1
                   WHEN total_frames > 0 AND readable > 0 THEN 2 WHEN grabbed THEN 3 ELSE 0 END AS tier
            FROM plan p LEFT JOIN sought s ON s.id = p.id AND s.hints = p.hints)""",
        f"""selected AS (SELECT id, hints, video_path, CAST(tier AS INTEGER) AS tier,
              CASE WHEN NOT openable THEN 'RuntimeError: Cannot open video: ' || video_path END AS frame_error,
              CASE tier WHEN 1 THEN sought
                WHEN 2 THEN [{{'t': i / greatest(CAST(1 AS DOUBLE), rate), 'idx': CAST(i AS BIGINT), 'path': {scan}}}
                   FOR i IN range(0, CAST(readable AS BIGINT), CAST(stride AS BIGINT))][1:{want}]
                WHEN 3 THEN [{{'t': CAST(0 AS DOUBLE), 'idx': CAST(0 AS BIGINT), 'path': {_frame_path("'ff0'")}}}]
                ELSE [] END AS frames FROM tiers)""",
    ]


_FRAME_TABLES = ["questions", "videos", "paths", "frame_index", "first_frame"]


def _frame_rows(keep: str, source: str = "selected", where: str = "true") -> str:
    return f"""SELECT {keep}, CAST(n AS INTEGER) AS n, f.t AS t, f.idx AS idx, f.path AS path FROM (
          SELECT *, unnest(frames) AS f, unnest(range(len(frames))) AS n FROM {source} WHERE {where} AND len(frames) > 0)
        UNION ALL
        SELECT {keep}, NULL, NULL, NULL, NULL FROM {source} WHERE {where} AND len(frames) = 0"""


def _tier(number: int) -> str:
    return _with(_FRAME_TABLES, _frame_rows("id, hints", "chosen"), *_selected(STRICT),
                 f"chosen AS (SELECT id, {_HINTS_TEXT} AS hints, frames FROM selected WHERE tier = {number})")


# Models

_ASKABLE = f"""askable AS (SELECT *, pos % 23 AS frame_count,
    CASE WHEN pos % 29 = 0 THEN 'RuntimeError: Cannot open video: x' END AS frame_error
    FROM questions WHERE {_COMPLETE})"""
_CASE_NO = "(CAST(coalesce(nullif(regexp_extract(question, '#([0-9]+)', 1), ''), '3') AS BIGINT))"


def _reply(shown: str, has_instruction: bool) -> str:
    """The stand-in model's reply; NULL where it raises."""
    n = _CASE_NO
    too_large = "true" if has_instruction else f"{shown} > 0"
    return f"""CASE {n} % 12
        WHEN 0 THEN 'Yes, true at 00:12:' || lpad(CAST({n} % 60 AS VARCHAR), 2, '0') || '. Because ' || {shown} || ' frames show it.'
        WHEN 1 THEN ' no, false, 01:0' || ({n} % 10) || ':05' || chr(10) || 'because of frame ' || {shown} || '   '
        WHEN 2 THEN CASE WHEN {shown} > 6 THEN '' ELSE 'Yes True 00:00:07 Because ' || {shown} || ' of six' END
        WHEN 3 THEN CASE WHEN {shown} > 0 THEN 'Hm ' || {shown} || '. Because unsure' ELSE 'No, False, 12:34 Because text only' END
        WHEN 4 THEN ''
        WHEN 6 THEN CASE WHEN {too_large} THEN NULL ELSE 'False no 00:0' || ({n} % 10) || ' because bare' END
        WHEN 7 THEN 'Because ' || {n} || ' yes true 00:09:00'
        WHEN 8 THEN 'system' || chr(10) || 'rules' || chr(10) || 'user' || chr(10) || {n} || chr(10) || 'assistant' || chr(10) || 'No. Because true at 00:31'
        WHEN 9 THEN '{{"answer": "True", "answer_type": "yes_no"}}'
        WHEN 10 THEN CASE WHEN {shown} = 0 THEN NULL ELSE 'Because ' END
        WHEN 11 THEN 'assistant' || chr(10) || 'user' || chr(10) || 'Because no, false ' || {shown} END"""


def _error(shown: str, has_instruction: bool) -> str:
    n = _CASE_NO
    too_large = "true" if has_instruction else f"{shown} > 0"
    return f"""CASE WHEN frame_error IS NOT NULL THEN frame_error
        WHEN {n} % 12 = 5 THEN 'RuntimeError: lost ' || {n}
        WHEN {n} % 12 = 6 AND {too_large} THEN 'PreprocessError: too large'
        WHEN {n} % 12 = 10 AND {shown} = 0 THEN 'ValueError: nothing to see' END"""


def _strict_passes(source: str, frame_count: str, cap: int, keep: str) -> list[str]:
    """CTEs from ``source`` to ``done`` with the outcome of three strict passes.

    A request the model cannot take is sent again bare, which always works.
    """
    ctes, previous = [], source
    for number, shown in ((1, f"least({frame_count}, {cap})"), (2, f"least({frame_count}, 6)"),
                          (3, "0")):
        bare = f"{_CASE_NO} % 12 = 6"
        reply = (f"CASE WHEN {bare} THEN 'False no 00:0' || ({_CASE_NO} % 10) || ' because bare' "
                 f"ELSE {_reply(shown, False)} END")
        error = f"CASE WHEN {bare} AND frame_error IS NULL THEN NULL ELSE {_error(shown, False)} END"
        carried = f"{keep}, question, frame_error, {frame_count}" + "".join(
            f", raw_{i}, rationale_{i}" for i in range(1, number))
        ctes.append(f"r{number} AS (SELECT *, {reply} AS reply, {error} AS error FROM {previous})")
        for cte in _parse("strict", f"r{number}", carried):
            for name in ("s0", "s1", "parsed"):
                cte = cte.replace(f"{name} AS (", f"{name}_{number} AS (").replace(
                    f"FROM {name})", f"FROM {name}_{number})")
            # question_type is needed by the next pass.
            cte = cte.replace("error IS NOT NULL AS failed FROM",
                              "error IS NOT NULL AS failed, question_type FROM")
            ctes.append(cte)
        ctes.append(f"""again_{number} AS (SELECT * EXCLUDE (parsed_answer, parsed_raw, parsed_rationale, failed),
            parsed_raw AS raw_{number}, parsed_rationale AS rationale_{number}
            FROM parsed_{number} WHERE parsed_answer = '')""")
        previous = f"again_{number}"
    ctes.append(f"""done AS (
        SELECT {keep}, parsed_answer, parsed_raw, parsed_rationale FROM parsed_1 WHERE parsed_answer <> ''
        UNION ALL
        SELECT {keep}, parsed_answer, CASE WHEN failed THEN parsed_raw ELSE raw_1 END,
          CASE WHEN failed THEN parsed_rationale ELSE rationale_1 END FROM parsed_2 WHERE parsed_answer <> ''
        UNION ALL
        SELECT {keep}, parsed_answer,
          CASE WHEN parsed_raw <> '' THEN parsed_raw WHEN raw_2 <> '' THEN raw_2 ELSE raw_1 END,
          CASE WHEN parsed_raw <> '' THEN parsed_rationale WHEN raw_2 <> '' THEN rationale_2 ELSE rationale_1 END
        FROM parsed_3)""")
    return ctes


def _lenient_passes(source: str, frame_count: str, cap: int, retry: bool, has_instruction: bool,
                    keep: str) -> list[str]:
    shown = f"least({frame_count}, {cap})"
    ctes = [f"r1 AS (SELECT *, {_reply(shown, has_instruction)} AS reply1, "
            f"{_error(shown, has_instruction)} AS error1 FROM {source})"]
    if retry:
        ctes.append(f"""r2 AS (SELECT *, error1 IS NULL AND trim(reply1) = '' AS again FROM r1),
            r3 AS (SELECT *, CASE WHEN again THEN {_reply('0', has_instruction)} ELSE reply1 END AS reply,
              CASE WHEN again THEN {_error('0', has_instruction)} ELSE error1 END AS error FROM r2)""")
    else:
        ctes.append("r3 AS (SELECT *, reply1 AS reply, error1 AS error FROM r1)")
    return ctes + _parse("lenient", "r3", keep) + [
        f"done AS (SELECT {keep}, parsed_answer, parsed_raw, parsed_rationale FROM parsed)"]


_DONE = "SELECT pos, parsed_answer, parsed_raw, parsed_rationale FROM done"
_OUT = """SELECT pos, id, question_type, question, answer, parsed_answer AS model_answer,
    parsed_raw AS model_raw, CASE WHEN parsed_rationale <> '' THEN parsed_rationale END AS model_rationale,
    video_path FROM out"""


def _lost(cap: int) -> str:
    """The error of the first sent frame that has no file."""
    lost = f"list_filter(frames[1:{cap}], lambda f: f.idx % 11 = 7)"
    return f"coalesce(frame_error, 'FileNotFoundError: ' || ({lost})[1].path)"


def _evaluation(config: EvalConfig) -> str:
    error = _lost(config.frames_sent) if config.chat == "remote" else "frame_error"
    asked = f"""asked AS (SELECT h.*, s.video_path, {error} AS frame_error, coalesce(len(s.frames), 0) AS frame_count
        FROM hinted h LEFT JOIN selected s ON s.id = h.id AND s.hints = h.hints)"""
    if config.mode == "strict":
        passes = _strict_passes("asked", "frame_count", config.frames_sent, "pos")
    else:
        remote = config.chat == "remote"
        passes = _lenient_passes("asked", "frame_count", config.frames_sent, not remote, remote, "pos")
    out = """out AS (SELECT a.*, d.parsed_answer, d.parsed_raw, d.parsed_rationale
        FROM asked a JOIN done d ON d.pos = a.pos)"""
    return _with(_FRAME_TABLES, _OUT, *_selected(config), asked, *passes, out)


def all_oracles() -> dict[str, str]:
    image_type = ("CASE doc_id % 5 WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' "
                  "ELSE 'image/jpeg' END")
    seek = "CAST(CAST(round_even(p_retailprice / 7 * 1000, 0) AS BIGINT) AS VARCHAR)"
    return {
        "json_array_items": """
            SELECT doc_id, 0 AS pos, 'd' AS id, 'Yes/No' AS question_type, text AS question,
              lang AS answer, n_chars AS extra FROM documents
            UNION ALL
            SELECT doc_id, 1, source, NULL, text || '?', NULL, NULL FROM documents""",
        "large_array_items": """
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id, text) - 1 AS pos,
              'Yes/No' AS question_type, text AS question, lang AS answer, source AS second_tag,
              CAST(NULL AS VARCHAR) AS file_error FROM documents""",
        "json_line_items": _with(["questions"], "SELECT pos, id, question_type, question, answer FROM questions"),
        "asset_manifest": _with(["paths"], "SELECT * FROM manifest", _MANIFEST),
        "answered_json_items": _with(["questions"], f"""
            SELECT pos, id, question, pos AS meta_n, model_answer, model_raw,
              coalesce(model_rationale, 'kept') AS model_rationale, video_path
            FROM (SELECT *, {_ANSWER_COLUMNS} FROM valid)""", _VALID),
        "written_answers": _with(["questions"], f"""
            SELECT sink, count(*) AS reported, count(*) AS read_back,
              count(*) FILTER (model_answer <> '') AS answered
            FROM (SELECT *, {_ANSWER_COLUMNS} FROM valid)
              CROSS JOIN (VALUES ('json_array'), ('json_lines'), ('parquet')) AS sinks (sink)
            GROUP BY sink""", _VALID),
        "frame_data_urls": f"SELECT doc_id, 'data:' || {image_type} || ';base64,' || base64(encode(text)) AS data_url FROM documents",
        "frame_paths": _with(["paths"], f"""
            SELECT id, {_frame_path(seek)} AS seek_path,
              {_frame_path("'ls' || p_size")} AS scan_path, {_frame_path("'ff0'")} AS first_path
            FROM best JOIN part ON 'v' || p_partkey = id""", _MANIFEST, _BEST),
        "valid_items": _with(["questions"], "SELECT * FROM valid", _VALID),
        "rejected_items": _with(["questions"], f"""
            SELECT pos, array_to_string(list_filter([CASE WHEN coalesce(id,'') = '' THEN 'id' END,
              CASE WHEN coalesce(question,'') = '' THEN 'question' END,
              CASE WHEN coalesce(question_type,'') = '' THEN 'question_type' END],
              lambda x: x IS NOT NULL), ',') AS missing FROM questions WHERE NOT {_COMPLETE}"""),
        "answer_columns": _with(["questions"], f"SELECT *, {_ANSWER_COLUMNS} FROM valid", _VALID),
        "item_counters": _with(["questions"], f"""
            SELECT count(*) AS items, count(*) FILTER (NOT ok) AS skipped,
              count(*) FILTER (ok AND video_path IS NULL) AS without_video,
              count(*) FILTER (ok AND model_answer = '') AS empty_answers
            FROM (SELECT *, {_COMPLETE} AS ok, {_ANSWER_COLUMNS} FROM questions)"""),
        "timecodes": _with(["questions"], f"""
            SELECT pos, CAST(n AS INTEGER) AS n, timecode FROM (
              SELECT pos, unnest(tc) AS timecode, unnest(range(len(tc))) AS n
              FROM (SELECT pos, regexp_extract_all(question, '{_RX}') AS tc FROM questions))"""),
        "timecode_seconds": _with(["questions"], f"""
            SELECT pos, CASE WHEN tc <> '' THEN {_seconds('tc')} END AS hhmm,
              CASE WHEN tc <> '' THEN {_seconds('tc', 'mmss')} END AS mmss
            FROM (SELECT pos, regexp_extract(question, '{_RX}') AS tc FROM questions)"""),
        "timecode_presence": _with(["replies"], f"""
            SELECT pos, regexp_matches(coalesce(reply, ''), '{_RX}') AS has_timecode FROM replies"""),
        "hint_seconds": _with(["questions"], f"""
            SELECT pos, CAST(n AS INTEGER) AS n, seconds FROM (
              SELECT pos, unnest(hints) AS seconds, unnest(range(len(hints))) AS n
              FROM (SELECT pos, {_HINTS} AS hints FROM questions))"""),
        "transcript_cut": f"""SELECT conv_id, turn,
            {_cut("'system' || chr(10) || 'be brief' || chr(10) || role || chr(10) || text")} AS cut,
            {_cut('text')} AS uncut FROM conversations""",
        "rationale_split": _with(["replies"], f"""
            SELECT pos, {_answer_part("coalesce(reply, '')")} AS answer,
              {_rationale_part("coalesce(reply, '')")} AS rationale FROM replies"""),
        "yes_no_answers": _normalized("Yes/No"),
        "true_false_answers": _normalized("True/False"),
        "timestamp_answers": _normalized("Timestamp"),
        "other_answers": _normalized("Comparative"),
        "strict_replies": _with(
            ["replies"], "SELECT * EXCLUDE (failed) FROM parsed",
            "src AS (SELECT *, CAST(NULL AS VARCHAR) AS error FROM replies)", *_parse("strict", "src", "pos")),
        "lenient_replies": _with(
            ["replies"], "SELECT * EXCLUDE (failed) FROM parsed",
            "src AS (SELECT *, CAST(NULL AS VARCHAR) AS error FROM replies)", *_parse("lenient", "src", "pos")),
        "directives": _with(["type_names"], f"SELECT pos, {_DIRECTIVE} AS directive FROM type_names"),
        "instructions": _with(["type_names"], f"SELECT pos, {_INSTRUCTION} AS instruction FROM type_names"),
        "answer_types": _with(["type_names"], f"SELECT pos, {_ANSWER_TYPE} AS answer_type, {_GUIDE} AS guide FROM type_names"),
        "strict_prompts": _with(["type_names"], f"SELECT pos, {_STRICT_TEXT} AS prompt FROM typed", _TYPED),
        "lenient_prompts": _with(["type_names"], f"SELECT pos, {_SYSTEM} AS system_text, {_lenient_text('frame_count')} AS user_text FROM typed", _TYPED),
        "video_messages": _video_messages(),
        "image_messages": _image_messages("image", _SYSTEM, _lenient_text(_capped(LENIENT.frames_sent)), LENIENT.frames_sent),
        "remote_messages": _image_messages("input_image", _q(_TEXTS.remote_system), _DIRECTED, REMOTE.frames_sent),
        "bare_messages": _with(["type_names"], f"""
            SELECT pos, 0 AS message_no, 'user' AS role, 0 AS part_no, 'text' AS type,
              {_DIRECTED} AS text, CAST(NULL AS VARCHAR) AS refs FROM typed""", _TYPED),
        "video_durations": _with(["videos"], f"SELECT id, {_FPS} AS fps, {_DURATION} AS duration, {_LAST} AS last_time FROM videos"),
        "rounded_times": """
            SELECT l_orderkey, l_linenumber, l_extendedprice,
              CAST(printf('%.2f', l_extendedprice * CAST(0.15 AS DOUBLE)) AS DOUBLE) AS part_of_price,
              CAST(printf('%.2f', l_quantity * CAST(0.005 AS DOUBLE)) AS DOUBLE) AS on_tie,
              CAST(printf('%.2f', l_quantity / CAST(8 AS DOUBLE)) AS DOUBLE) AS on_exact_tie FROM lineitem""",
        "clamped_times": _with(["questions"], """
            SELECT pos, hint, greatest(0, least(hint - 2, CAST(90.5 AS DOUBLE))) AS before,
              greatest(0, least(hint, CAST(90.5 AS DOUBLE))) AS at,
              greatest(0, least(hint + 2, CAST(90.5 AS DOUBLE))) AS after
            FROM (SELECT pos, unnest(hints) AS hint FROM (SELECT pos, """ + _HINTS + " AS hints FROM questions))"),
        "even_frame_plan": _document_plan(STRICT),
        "thinned_frame_plan": _document_plan(EvalConfig.lenient(frames_per_question=61)),
        "hinted_frame_plan": _with(
            ["questions"], _plan_rows("pos"), f"""src AS (SELECT pos, {_HINTS} AS hints,
                CAST(29.97 AS DOUBLE) AS fps, CAST(trunc(value * 25) AS BIGINT) AS total_frames
                FROM questions JOIN events ON event_id = pos),
                hinted AS (SELECT * FROM src WHERE len(hints) > 0)""", *_plan("hinted", LENIENT, "pos")),
        "scan_plan": """
            SELECT doc_id, CAST(n AS INTEGER) AS n, idx, idx / CAST(12.5 AS DOUBLE) AS t FROM (
              SELECT doc_id, unnest(ids) AS idx, unnest(range(len(ids))) AS n FROM (
                SELECT doc_id, range(0, n_chars, greatest(1, n_chars // 13))[1:12] AS ids FROM documents))""",
        "capped_frames": _with(["type_names"], "SELECT pos, " + ", ".join(
            f"CAST(least(frame_count + 2, {c}) AS INTEGER) AS {n}_count, 'f' || least(frame_count + 2, {c}) AS {n}_last"
            for n, c in (("strict", STRICT.frames_sent), ("lenient", LENIENT.frames_sent),
                         ("remote", REMOTE.frames_sent))) + " FROM type_names"),
        "best_assets": _with(["paths"], "SELECT * FROM best", _MANIFEST, _BEST),
        "resolved_videos": _with(["questions", "paths"], "SELECT pos, valid.id, video_path FROM valid LEFT JOIN best ON best.id = valid.id", _VALID, _MANIFEST, _BEST),
        "plan_keys": _with(["questions"], f"SELECT id, {_HINTS_TEXT} AS hints, count(*) AS questions FROM hinted GROUP BY ALL", _VALID, _HINTED),
        "readable_prefixes": _with(["frame_index"], "SELECT * FROM prefixes", _PREFIX),
        "sought_frames": _tier(1),
        "scanned_frames": _tier(2),
        "grabbed_frames": _tier(3),
        "selected_frames": _with(_FRAME_TABLES, _frame_rows("id, hints, video_path, tier, frame_error", "chosen"),
                                 *_selected(STRICT), f"chosen AS (SELECT * REPLACE ({_HINTS_TEXT} AS hints) FROM selected)"),
        "unopenable_videos": _with(_FRAME_TABLES, f"SELECT id, {_HINTS_TEXT} AS hints, frame_error FROM selected WHERE frame_error IS NOT NULL",
                                   *_selected(STRICT)),
        "question_frames": _with(_FRAME_TABLES, _frame_rows("pos, id, video_path, tier", "chosen"), *_selected(STRICT),
                                 """chosen AS (SELECT h.pos, h.id, s.video_path, s.tier, coalesce(s.frames, []) AS frames
                                 FROM hinted h LEFT JOIN selected s ON s.id = h.id AND s.hints = h.hints)"""),
        **dict.fromkeys(("strict_model_answers", "journaled_model_answers"), _with(
            ["questions"], _DONE, _ASKABLE, *_strict_passes(
                "askable", "frame_count", STRICT.frames_sent, "pos"))),
        "lenient_model_answers": _with(["questions"], _DONE, _ASKABLE, *_lenient_passes(
            "askable", "frame_count", LENIENT.frames_sent, True, False, "pos")),
        "remote_model_answers": _with(["questions"], _DONE, _ASKABLE, *_lenient_passes(
            "askable", "frame_count", REMOTE.frames_sent, False, True, "pos")),
        "strict_evaluation": _evaluation(STRICT),
        "lenient_evaluation": _evaluation(LENIENT),
        "remote_evaluation": _evaluation(REMOTE),
        "missing_frame_files": _with(_FRAME_TABLES, f"""
            SELECT id, {_HINTS_TEXT} AS hints, {_lost(REMOTE.frames_sent)} AS frame_error,
              CAST(len(list_filter(frames[1:{REMOTE.frames_sent}], lambda f: f.idx % 11 <> 7)) AS INTEGER) AS urls
            FROM selected""", *_selected(REMOTE)),
        "unparseable_items": """
            SELECT doc_id, 0 AS pos, 'id,question,question_type' AS missing,
              'not a JSON array' AS file_error FROM documents WHERE doc_id % 5 <= 2""",
    }
