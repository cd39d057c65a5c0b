"""Message shapes and the stable key built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import JS_SPACE, u16_left

# Fixed value: the key is defined on this much of a message.
KEY_CHARS = 2000
KEY_LENGTH = 40

# Word characters are ASCII in the masks, while Java's \b follows Unicode letters, so
# boundaries are spelled out. A look-behind stands after the first fixed run, where it
# is only tried at plausible starts; runs that cannot give back are possessive.
_W = "[0-9A-Za-z_]"
_END = f"(?!{_W})"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def _start(run: str) -> str:
    """A fixed-length run not preceded by a word character."""
    return f"{run}(?<!{_W}{run})"


# Masks in the order they apply, on lower-cased text. Each group comes
# with a character it cannot match without.
MASKS = [
    ("-", [
        (_start("[0-9a-f]{8}") + "-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}" + _END, "<uuid>"),
        (_start("[0-9]{4}") + r"-\d{2}-\d{2}[t ]\d{2}:\d{2}:\d{2}(?:\.\d+)?z?" + _END, "<time>"),
        (_start("[0-9]{4}") + r"-\d{2}-\d{2}" + _END, "<date>"),
    ]),
    (".", [(_start("[0-9]") + r"\d{0,2}(?:\.\d{1,3}){3}(?::\d+)?" + _END, "<ip>")]),
    ("@", [(r"(?=[\w.%+-])" + _EDGE + r"[\w.%+-]++@[\w.-]+\.[a-z]{2,}" + _END, "<email>")]),
    ("", [(_start("[0-9a-f]{12}") + "[0-9a-f]*+" + _END, "<hex>")]),
    ("_", [(_start("[a-z]") + "[a-z0-9]*+_[a-z0-9]{4,}+" + _END, "<id>")]),
    ("", [(r"\d{2,}", "<n>"), (_start("[0-9]") + _END, "<n>")]),
]

# A lone plain space already is what a run of whitespace collapses to.
_RUN = f" {JS_SPACE}++|(?! ){JS_SPACE}++"
_ASCII_RUN = r"[\t-\r ]{2,}+|[\t-\r]"


def _let(value: Column, body) -> Column:
    """``body`` of a value computed once."""
    return F.transform(F.array(value), body)[0]


def _mask(text: Column, needs: str, masks: list[tuple[str, str]]) -> Column:
    def replaced(t: Column) -> Column:
        for pattern, label in masks:
            t = F.regexp_replace(t, pattern, label)
        return t

    return _let(text, lambda t: F.when(t.contains(needs), replaced(t)).otherwise(t)) if needs else replaced(text)


def normalize_message(message: Column) -> Column:
    text = F.lower(u16_left(F.coalesce(message, F.lit("")), KEY_CHARS))
    for needs, masks in MASKS:
        text = _mask(text, needs, masks)
    return F.trim(_let(text, lambda t: F.when(
        F.octet_length(t) == F.length(t), F.regexp_replace(t, _ASCII_RUN, " ")).otherwise(F.regexp_replace(t, _RUN, " "))))


def fingerprint_of(level: Column, channel: Column, message: Column) -> Column:
    """First 40 hex digits of sha-256 over level, channel and message shape, NUL separated."""
    parts = F.concat_ws(
        "\u0000",
        F.lower(F.coalesce(level, F.lit("info"))),
        F.lower(F.coalesce(channel, F.lit(""))),
        normalize_message(message),
    )
    return F.substring(F.sha2(parts, 256), 1, KEY_LENGTH)
