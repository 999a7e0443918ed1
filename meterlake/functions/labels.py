"""Display names as dictionaries to join or map with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How apps are shown.
APP_NAMES = {
    "claude": "Claude", "codex": "Codex", "cursor": "Cursor", "workbuddy": "WorkBuddy", "codebuddy_ide": "CodeBuddy", "codebuddy_cli": "CodeBuddy CLI", "freebuff": "Freebuff",
    "qoder": "Qoder", "opencode": "OpenCode", "zcode": "ZCode", "grok": "Grok", "devin": "Devin", "minimax_code": "MiniMax Code", "kimi_code": "Kimi Code", "cline": "Cline",
    "commandcode": "Command Code", "gemini_antigravity": "Antigravity", "dsh": "DeepSeek Harness", "kiro": "Kiro",
}
#: How kinds of quota windows are shown.
KIND_NAMES = {"5h_block": "5 hours", "daily": "Day", "weekly": "Week", "monthly": "Month", "credits": "Credits", "session_ctx": "Context", "window": "Window"}


def shown(code: Column, names: dict[str, str]) -> Column:
    """The name of a code, or the code itself."""
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, code), code)


def until(resets_at: Column, anchor_ms: int) -> Column:
    """The time to a reset as '2d 03h', '1h 02m' or '5m'; null once it has passed."""
    minutes = F.floor((resets_at - anchor_ms) / 60_000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    days = F.concat(F.floor(minutes / 1440), F.lit("d "), two(F.floor(minutes / 60) % 24), F.lit("h"))
    hours = F.concat(F.floor(minutes / 60), F.lit("h "), two(minutes % 60), F.lit("m"))
    return F.when(minutes < 0, None).when(minutes >= 1440, days).when(minutes >= 60, hours).otherwise(F.concat(minutes, F.lit("m")))
