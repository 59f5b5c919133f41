"""The usage event: one observed call, metadata only."""

from __future__ import annotations

#: Names as they stand in logs and tables.
PROVIDERS = ("claudeCode", "codex", "ollama", "lmStudio")
SOURCES = ("transcript", "codexTranscript", "proxy", "ollamaDesktop", "lmStudioLog")
#: Evidence ranks, strongest last.
ACCURACY_RANK = {"notApplicable": 0, "unknown": 1, "estimated": 2, "exact": 3}
TERMINAL_RANK = {"running": 0, "unknown": 1, "succeeded": 2, "failed": 2, "cancelled": 2}
#: Days of each period, today included.
PERIOD_DAYS = {"today": 1, "week": 7, "month": 30}

USAGE_EVENT = """dedup_key string, ts timestamp, started_at timestamp, provider string, source string, model string,
session_id string, project string, input_tokens long, output_tokens long, cache_read long, cache_create long, reasoning long,
token_accuracy string, operation string, status string, location string, endpoint string, request_id string, http_status int,
finish_reason string, error_category string, duration_s double, load_s double, prompt_eval_s double, eval_s double,
ttft_s double, tps double, shadowed boolean, arrival_seq long"""
