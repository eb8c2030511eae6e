"""DuckDB SQL of the registered queries, built from common table expressions."""

from __future__ import annotations

from turnlake.functions import text as T
from turnlake.functions.importance import TOOL_WEIGHTS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(t: str) -> str:
    return f"((length({t}) + length(regexp_replace({t}, '[^{T.WIDE}]', '', 'g')) + 3) // 4)::BIGINT"


def trim(t: str) -> str:
    return f"regexp_replace({t}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


def strip(t: str, internal: bool = False) -> str:
    cut = f"regexp_replace(regexp_replace({t}, {q(T.SENDER)}, ''), {q(T.STAMP)}, '')"
    if internal:
        cut = f"regexp_replace({cut}, {q(T.INTERNAL)}, '')"
    return f"coalesce(nullif({trim(cut)}, ''), {t if internal else trim(t)})"


def terms(t: str) -> str:
    stop = ", ".join(q(w) for w in [*T.STOP_WORDS, *T.STOP_CHARACTERS])
    found = f"list_transform(regexp_extract_all({t}, '[A-Za-z0-9_-]+|[{T.IDEOGRAPHS}]'), lambda x: lower(x))"
    return f"list_filter({found}, lambda x: (length(x) > 1 OR regexp_matches(x, '^[{T.IDEOGRAPHS}]$')) AND x NOT IN ({stop}))"


_USER = "CASE WHEN role IN ('assistant', 'toolResult') THEN role ELSE 'user' END"
_RAW = {
    "conv": "SELECT conv_id::VARCHAR AS session_id, (turn + 1)::INTEGER AS line, 'c' || conv_id || '-t' || turn AS entry_id, role, text, NULL::VARCHAR[] AS tool_calls, NULL::VARCHAR AS tool_name, NULL::BOOLEAN AS is_error, NULL::TIMESTAMP AS ts FROM conversations",
    "conv10": "SELECT (conv_id // 10)::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn)::INTEGER AS line, 'c' || conv_id || '-t' || turn AS entry_id, role, text, NULL::VARCHAR[] AS tool_calls, NULL::VARCHAR AS tool_name, NULL::BOOLEAN AS is_error, NULL::TIMESTAMP AS ts FROM conversations",
    "tooltalk": "SELECT (doc_id // 20)::VARCHAR AS session_id, ((doc_id % 20) * 3 + k)::INTEGER AS line, 'd' || doc_id || '-' || k AS entry_id, CASE k WHEN 1 THEN 'user' WHEN 2 THEN 'toolResult' ELSE 'assistant' END AS role, CASE k WHEN 1 THEN left(text, 80) WHEN 2 THEN text ELSE right(text, 80) END AS text, NULL::VARCHAR[] AS tool_calls, CASE k WHEN 2 THEN source END AS tool_name, CASE k WHEN 2 THEN false END AS is_error, NULL::TIMESTAMP AS ts FROM documents, (VALUES (1), (2), (3)) v(k)",
    "events30": "SELECT (user_id // 30)::VARCHAR AS session_id, row_number() OVER (PARTITION BY user_id // 30 ORDER BY ts, event_id)::INTEGER AS line, 'e' || event_id AS entry_id, CASE WHEN event_type IN ('view', 'signup') THEN 'user' WHEN event_type IN ('click', 'purchase') THEN 'assistant' ELSE 'toolResult' END AS role, coalesce(props, '') AS text, CASE event_type WHEN 'click' THEN ['read'] WHEN 'purchase' THEN ['write'] END AS tool_calls, CASE event_type WHEN 'error' THEN 'exec' END AS tool_name, event_type = 'error' AS is_error, ts FROM events",
}


def lines(binding: str) -> list[str]:
    return [
        f"raw AS ({_RAW[binding]})",
        f"lines AS (SELECT session_id, line, entry_id, role AS raw_role, {_USER} AS role, text, tool_calls, tool_name, is_error, ts, {tokens('text')} AS tokens, CASE WHEN {_USER} = 'user' THEN left({strip('text')}, 200) END AS user_text, CASE WHEN role = 'assistant' THEN left(text, 200) END AS assistant_text FROM raw)",
        "placed AS (SELECT * FROM (SELECT *, (sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line) - 1)::INTEGER AS seq FROM lines) WHERE seq >= 0)",
    ]


def turns(binding: str) -> list[str]:
    weight = "CASE t " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TOOL_WEIGHTS.items()) + " ELSE 0 END"
    ratio = "(CASE WHEN message_count > 0 THEN tool_call_count / message_count::DOUBLE ELSE 0 END)"
    return [
        *lines(binding),
        "used AS (SELECT session_id, seq, tool, min(line * 1000 + pos) AS spot FROM (SELECT session_id, seq, line, unnest(list_concat(coalesce(tool_calls, []), CASE WHEN coalesce(tool_name, '') <> '' THEN [tool_name] ELSE [] END)) AS tool, generate_subscripts(list_concat(coalesce(tool_calls, []), CASE WHEN coalesce(tool_name, '') <> '' THEN [tool_name] ELSE [] END), 1) AS pos FROM placed) GROUP BY ALL)",
        "tools AS (SELECT session_id, seq, list(tool ORDER BY spot) AS tools_used FROM used GROUP BY ALL)",
        "base AS (SELECT session_id, seq, arg_min(entry_id, line) AS turn_id, min(line) AS line_start, max(line) AS line_end, count(*) AS message_count, sum(coalesce(len(tool_calls), 0))::BIGINT AS tool_call_count, sum(tokens)::BIGINT AS total_tokens, coalesce(sum(tokens) FILTER (role = 'user'), 0)::BIGINT AS user_tokens, coalesce(sum(tokens) FILTER (role = 'assistant'), 0)::BIGINT AS assistant_tokens, coalesce(sum(tokens) FILTER (role = 'toolResult'), 0)::BIGINT AS tool_result_tokens, coalesce(arg_min(user_text, line), '') AS user_preview, coalesce(arg_max(assistant_text, line) FILTER (assistant_text <> ''), '') AS assistant_preview, arg_min(ts, line) AS start_time, arg_max(ts, line) AS end_time, coalesce(bool_or(is_error), false) AS has_error FROM placed GROUP BY ALL)",
        "t0 AS (SELECT b.*, coalesce(tools_used, []::VARCHAR[]) AS tools_used FROM base b LEFT JOIN tools USING (session_id, seq))",
        f"turns AS (SELECT *, greatest(0, least(100, 50 + CASE WHEN user_tokens > 500 THEN 15 WHEN user_tokens > 100 THEN 8 WHEN user_tokens < 20 THEN -5 ELSE 0 END + CASE WHEN assistant_preview <> '' THEN 10 WHEN tool_call_count > 0 THEN -10 ELSE 0 END + CASE WHEN has_error THEN 15 ELSE 0 END + CASE WHEN {ratio} > 0.7 THEN -10 ELSE 0 END + CASE WHEN {ratio} > 0.9 THEN -5 ELSE 0 END + CASE WHEN len(tools_used) > 0 THEN floor(list_sum(list_transform(tools_used, lambda t: {weight})) / len(tools_used)::DOUBLE + 0.5) ELSE 0 END))::INTEGER AS importance, count(*) OVER (PARTITION BY session_id) AS n_turns FROM t0)",
    ]


def similarities(binding: str) -> list[str]:
    return [
        *turns(binding),
        f"tt AS (SELECT session_id, seq, n_turns, {terms('concat_ws(chr(32), nullif(user_preview, $$$$), nullif(assistant_preview, $$$$), nullif(array_to_string(tools_used, chr(32)), $$$$))')} AS terms FROM turns)",
        "tf AS (SELECT session_id, seq, term, n_turns, count(*) / any_value(size)::DOUBLE AS tf FROM (SELECT session_id, seq, n_turns, len(terms) AS size, unnest(terms) AS term FROM tt) GROUP BY session_id, seq, term, n_turns)",
        "tfidf AS (SELECT *, tf * (ln(n_turns / (df + 1)::DOUBLE) + 1) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY session_id, term) AS df FROM tf))",
        "spots AS (SELECT session_id, seq AS i, n_turns, greatest(1, least(3, n_turns // 2)) AS w FROM turns WHERE seq > 0)",
        "sums AS (SELECT s.session_id, s.i, term, sum(CASE WHEN f.seq < s.i THEN weight ELSE 0 END) AS x, sum(CASE WHEN f.seq >= s.i THEN weight ELSE 0 END) AS y FROM spots s JOIN tfidf f ON s.session_id = f.session_id AND f.seq >= s.i - s.w AND f.seq < s.i + s.w GROUP BY ALL)",
        "dots AS (SELECT session_id, i, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM sums GROUP BY ALL)",
        "sims AS (SELECT s.session_id, s.i AS seq, coalesce(CASE WHEN xx > 0 AND yy > 0 THEN least(1.0, xy / (sqrt(xx) * sqrt(yy))) END, 0.0) AS similarity FROM spots s LEFT JOIN dots d ON s.session_id = d.session_id AND s.i = d.i)",
    ]


def fold(source: str, keys: str, least: int, into: str) -> list[str]:
    """Islands (keys, ord, start, size) of source merged by rescanning: {into} (keys, part, start, size, ord)."""
    k = [x.strip() for x in keys.split(",")]
    return [
        f"{into}_in AS (SELECT {keys}, list({{'start': start::INTEGER, 'size': size::INTEGER, 'ord': ord::INTEGER}} ORDER BY ord) AS l FROM {source} GROUP BY {keys})",
        # one merge per round: the first short island joins its larger neighbour, the one before among equals
        f"{into}_r AS (SELECT {keys}, l, 0 AS round FROM {into}_in UNION ALL SELECT {keys}, CASE WHEN m = 0 THEN l ELSE list_concat(l[:m - 1], [{{'start': l[m].start, 'size': l[m].size + l[m + 1].size, 'ord': l[m].ord}}], l[m + 2:]) END, round + 1 FROM (SELECT {keys}, l, round, CASE WHEN i IS NULL OR len(l) < 2 THEN 0 WHEN i = 1 THEN 1 WHEN i = len(l) THEN i - 1 WHEN l[i - 1].size >= l[i + 1].size THEN i - 1 ELSE i END AS m FROM (SELECT {keys}, l, round, list_filter(range(1, len(l) + 1), lambda x: l[x].size < {least})[1] AS i FROM {into}_r)) WHERE m > 0)",
        f"{into}_last AS (SELECT {', '.join('r.' + x for x in k)}, r.l FROM {into}_r r JOIN (SELECT {keys}, max(round) AS round FROM {into}_r GROUP BY {keys}) x ON r.round = x.round AND {' AND '.join(f'r.{x} = x.{x}' for x in k)})",
        f"{into} AS (SELECT {keys}, part, l[part].start AS start, l[part].size AS size, l[part].ord AS ord, len(l) AS parts FROM (SELECT {keys}, l, unnest(range(1, len(l) + 1)) AS part FROM {into}_last))",
    ]


def topics(binding: str) -> list[str]:
    text = trim("first_preview")
    head = f"left({text}, 40)"
    space = f"(40 - instr(reverse({head}), ' '))"
    return [
        *similarities(binding),
        "marks AS (SELECT t.session_id, t.seq, coalesce(round(s.similarity, 12) < 0.05, false) AS opens FROM turns t LEFT JOIN sims s ON t.session_id = s.session_id AND t.seq = s.seq)",
        "isl AS (SELECT session_id, ord, min(seq) AS start, count(*) AS size FROM (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY session_id ORDER BY seq) AS ord FROM marks) GROUP BY ALL)",
        *fold("isl", "session_id", 2, "seg"),
        "tt1 AS (SELECT t.*, g.part - 1 AS topic_ord, g.ord, g.part = g.parts AND t.n_turns > 1 AS is_current, first_value(t.turn_id) OVER p AS first_id, first_value(t.user_preview) OVER p AS first_preview FROM turns t JOIN seg g ON t.session_id = g.session_id AND t.seq >= g.start AND t.seq < g.start + g.size WINDOW p AS (PARTITION BY t.session_id, g.part ORDER BY t.seq))",
        f"tturns AS (SELECT * EXCLUDE (first_id, first_preview), 'topic-' || first_id AS topic_id, CASE WHEN {text} = '' THEN 'Topic ' || (ord + 1) WHEN length({text}) <= 40 THEN {text} ELSE CASE WHEN instr({head}, ' ') > 0 AND {space} > 24 THEN left({head}, {space}::BIGINT) ELSE {head} END || '...' END AS label FROM tt1)",
    ]


def subtopics(binding: str) -> list[str]:
    return [
        *turns(binding),
        "tturns AS (SELECT *, 'all' AS topic_id FROM turns)",
        "lagged AS (SELECT *, lag(end_time) OVER o AS p_end, lag(tools_used) OVER o AS p_tools, lag(user_preview) OVER o AS p_prev FROM tturns WINDOW o AS (PARTITION BY session_id, topic_id ORDER BY seq))",
        "scored AS (SELECT *, CASE WHEN (epoch_ms(start_time) - epoch_ms(p_end)) / 60000.0 > 30 THEN 3 WHEN (epoch_ms(start_time) - epoch_ms(p_end)) / 60000.0 > 10 THEN 2 ELSE 0 END + CASE WHEN len(p_tools) > 0 AND len(tools_used) > 0 THEN CASE WHEN len(list_intersect(p_tools, tools_used)) = 0 THEN 2 WHEN len(list_intersect(p_tools, tools_used)) / len(list_distinct(list_concat(p_tools, tools_used)))::DOUBLE < 0.3 THEN 1 ELSE 0 END ELSE 0 END + CASE WHEN length(p_prev) < 30 AND length(user_preview) > 80 THEN 1 ELSE 0 END AS score FROM lagged)",
        "sisl AS (SELECT session_id, topic_id, ord, min(seq) AS start, count(*) AS size FROM (SELECT *, sum((n_turns > 2 AND seq > 0 AND score >= 3)::INTEGER) OVER (PARTITION BY session_id, topic_id ORDER BY seq) AS ord FROM scored) GROUP BY ALL)",
        *fold("sisl", "session_id, topic_id", 2, "sub"),
    ]


def select(ctes: list[str], body: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {body}"


def truncate(t: str, most: int) -> str:
    """SQL of functions.text.truncate for a text column t."""
    budget = max(200, most - T.NOTES)
    tail = f"right({t}, 2000)"
    words = r"\b(error|exception|failed|fatal|traceback|panic|stack trace|errno|exit code|total|summary|result|complete|finished|done|conclusion)\b"
    important = f"(regexp_matches(lower({tail}), '{words}') OR regexp_matches({tail}, '\\}}\\s*$'))"
    head, end = (f"CASE WHEN {important} THEN {int(budget * a)} ELSE {int(budget * b)} END" for a, b in ((0.6, 0.8), (0.3, 0.1)))
    inner = f"SELECT *, length({t}) AS size, ({head})::BIGINT AS hb, ({end})::BIGINT AS tb FROM src"
    cut = f"SELECT *, CASE WHEN instr(left({t}, hb + 1), chr(10)) > 0 AND hb + 1 - instr(reverse(left({t}, hb + 1)), chr(10)) > hb * 0.8::DOUBLE THEN hb + 1 - instr(reverse(left({t}, hb + 1)), chr(10)) ELSE hb END AS hc, CASE WHEN instr(right({t}, tb), chr(10)) > 0 AND instr(right({t}, tb), chr(10)) - 1 < tb * 0.2::DOUBLE THEN size - tb + instr(right({t}, tb), chr(10)) ELSE size - tb END AS ts0 FROM ({inner})"
    return f"SELECT * EXCLUDE (hb, tb, hc, ts0), CASE WHEN size <= {most} THEN {t} ELSE left({t}, hc) || chr(10) || chr(10) || '⚠️ [... ' || (ts0 - hc) || ' chars / ~' || floor((ts0 - hc) / 4.0 + 0.5)::BIGINT || ' tokens omitted — showing head and tail ...]' || chr(10) || chr(10) || substr({t}, ts0 + 1) || {q(T.CUT_NOTE)} END AS truncated FROM ({cut})"
