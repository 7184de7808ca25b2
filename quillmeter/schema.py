"""Schemas of the normalized rows that all operators read."""

from __future__ import annotations

#: One model response. ts is UTC without a zone; input leaves cache tokens out, output holds reasoning.
USAGE = (
    "source string, session_id string, ts timestamp_ntz, repo_root string, provider string, model string, "
    "input_tokens bigint, output_tokens bigint, reasoning_tokens bigint, cache_read_tokens bigint, "
    "cache_write_tokens bigint, cache_write_1h_tokens bigint, total_tokens bigint, single_request boolean, "
    "cost_usd double, cost_mode string, machine string, message_id string, request_id string, file string, event_index bigint"
)
TOOL_CALL = "source string, session_id string, ts timestamp_ntz, call_id string, name string, status string, completed_at timestamp_ntz, duration_ms bigint, file string, event_index bigint"
MESSAGE = "source string, session_id string, ts timestamp_ntz, role string, text_length bigint, text string, file string, event_index bigint"
#: Rates by model key; tiers hold rates that apply above a prompt size, highest first.
RATES = (
    "model_key string, provider string, input double, output double, cache_read double, cache_write double, cache_write_1h double, "
    "reasoning double, reasoning_billing string, max_input_tokens bigint, "
    "tiers array<struct<above:bigint,input:double,output:double,cache_read:double,cache_write:double,cache_write_1h:double>>"
)
TOKENS = ["input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens"]
#: The machine of rows that name none.
LOCAL = "local"
