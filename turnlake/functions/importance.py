"""How much is lost with a turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tools whose results can be had again weigh less than nothing; changes and messages weigh most.
TOOL_WEIGHTS = {
    "write": 8, "edit": 8, "gateway": 6, "exec": 5, "cron": 5, "message": 5, "sessions_send": 5, "sessions_spawn": 4, "wecom_mcp": 4, "tts": 3, "knot_skills": 3,
    "image": -2, "pdf": -2, "memory_get": -2, "memory_search": -2,
    "session_status": -3, "sessions_list": -3, "sessions_history": -3, "web_search": -3, "web_fetch": -3, "read": -5,
}


def tool_weight(tools: Column) -> Column:
    """Mean weight of the tools, halves rounded up; 0 without tools."""
    weights = F.create_map(*[F.lit(x) for kv in TOOL_WEIGHTS.items() for x in kv])
    total = F.aggregate(F.transform(tools, lambda t: F.coalesce(F.element_at(weights, t), F.lit(0))), F.lit(0), lambda a, b: a + b)
    return F.when(F.size(tools) > 0, F.floor(total / F.size(tools) + F.lit(0.5))).otherwise(0).cast("int")


def importance(user_tokens: Column, has_text: Column, has_error: Column, calls: Column, messages: Column, tools: Column) -> Column:
    """0 to 100; 50 for a plain turn."""
    ratio = F.when(messages > 0, calls / messages).otherwise(0.0)
    score = (
        F.lit(50)
        + F.when(user_tokens > 500, 15).when(user_tokens > 100, 8).when(user_tokens < 20, -5).otherwise(0)
        + F.when(has_text, 10).when(calls > 0, -10).otherwise(0)
        + F.when(has_error, 15).otherwise(0)
        + F.when(ratio > 0.7, -10).otherwise(0)
        + F.when(ratio > 0.9, -5).otherwise(0)
        + tool_weight(tools)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")
