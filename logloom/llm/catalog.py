"""Loads every query module of this subpackage; ``QUERIES`` and ``SQL`` are complete afterwards."""

from __future__ import annotations

from . import attention_lm, bpe, decontaminate, html_text, jaccard, langid, licenses, packing, periodic, prefix_trie, repetition, secret_scan, sharding  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
