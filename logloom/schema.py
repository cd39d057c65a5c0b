"""Schemas of the tables the transforms read and write."""

from __future__ import annotations

# Requests as they arrive, before anything is trusted.
RAW_REQUEST = """
  request_id string, body string, header_key string, header_project string,
  forwarded_for string, real_ip string, direct_ip string, received_at string
"""

LOG_ENTRY = """
  id string, project_id string, level string, message string, channel string, context string,
  environment string, release string, framework string, host string, sdk string, user_context string,
  timestamp string, trace_id string, request_id string
"""

LOG_COLUMNS = [part.split()[0] for part in LOG_ENTRY.replace("\n", " ").split(",")]

# Listing columns: the JSON text columns stay unread.
STREAM_COLUMNS = ["id", "level", "message", "channel", "environment", "release", "framework", "host",
                  "timestamp", "trace_id", "request_id"]

ANALYSIS = """
  summary string, rootCause string, confidence string,
  suspects array<struct<location: string, reason: string>>,
  steps array<struct<title: string, detail: string>>,
  patch string, verification array<string>
"""

SUBSCRIPTION_COLUMNS = ["provider_id", "user_id", "type", "plan", "provider_status", "provider_type",
                        "provider_price_id", "unit_price", "quantity"]
