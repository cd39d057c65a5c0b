"""Length caps, escaping, masking and reference parsing for text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Storage caps, counted in UTF-16 code units.
MAX_MESSAGE = 16 * 1024
MAX_CONTEXT = 96 * 1024
MAX_SDK = 4096
MAX_VARCHAR = 255
MAX_CORRELATION = 64
CLIP_MARK = "…[truncated]"
OVERSIZED_JSON = '{"_truncated":"oversized context dropped"}'

# Whitespace as ECMAScript defines it.
JS_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def u16_length(text: Column) -> Column:
    """Length in UTF-16 code units: a code point beyond the BMP counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def longer_than(text: Column, limit: int) -> Column:
    """UTF-16 length > limit, paying for the encode only when code points cannot decide."""
    points = F.length(text)
    return F.when(points > limit, F.lit(True)).when(points * 2 <= limit, F.lit(False)).otherwise(
        u16_length(text) > limit)


def u16_left(text: Column, units: int) -> Column:
    """First ``units`` UTF-16 code units; a pair cut in half is left out."""
    head = F.substring(text, 1, units)
    wide = F.regexp_replace(head, _ASTRAL, "$0\u0000")
    cut = F.substring(wide, 1, units)
    # NUL marks the second half of a pair; text holding real NULs keeps the plain prefix.
    paired = F.when(F.right(cut, F.lit(1)).rlike(_ASTRAL), F.left(cut, F.length(cut) - 1)).otherwise(cut)
    exact = F.when(head.rlike(_ASTRAL) & ~head.contains("\u0000"), F.replace(paired, F.lit("\u0000"), F.lit("")))
    return F.when(F.length(text) * 2 <= units, text).otherwise(F.coalesce(exact, head))


def clip(text: Column, limit: int, mark: str = CLIP_MARK) -> Column:
    """Cut to ``limit`` and append a mark; the result may exceed the limit."""
    return F.when(longer_than(text, limit), F.concat(u16_left(text, limit), F.lit(mark))).otherwise(text)


def varchar(text: Column, limit: int) -> Column:
    """Cut so that the result, ellipsis included, fits ``limit``."""
    return F.when(longer_than(text, limit), F.concat(u16_left(text, limit - 1), F.lit("…"))).otherwise(text)


def col255(text: Column) -> Column:
    return varchar(text, MAX_VARCHAR)


def col64(text: Column) -> Column:
    return varchar(text, MAX_CORRELATION)


def escape_html(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def escape_chat(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def canonical_email(email: Column) -> Column:
    return F.lower(js_trim(F.coalesce(email, F.lit(""))))


def email_ok(email: Column) -> Column:
    """Shape check on the canonical form, at most 255 long."""
    value = canonical_email(email)
    return value.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (u16_length(value) <= MAX_VARCHAR)


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def mask_webhook(url: Column) -> Column:
    """Host plus the last four characters; a lone ellipsis for what is not a URL."""
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r"(:\d+)$", 1)
    protocol = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    usual = ((protocol == "https") & (port == ":443")) | ((protocol == "http") & (port == ":80"))
    shown = F.concat(url_host(url), F.when(usual, F.lit("")).otherwise(port))
    return F.coalesce(F.concat(shown, F.lit("/…"), F.right(url, F.lit(4))), F.lit("…"))


def mask_key(key: Column) -> Column:
    """First ten and last four characters of keys longer than sixteen."""
    return F.when(F.length(key) > 16, F.concat(F.substring(key, 1, 10), F.lit("……"), F.right(key, F.lit(4)))).otherwise(key)


def token_hint(token: Column) -> Column:
    return F.right(token, F.lit(4))


def slug(name: Column, limit: int = 24, fallback: str = "app") -> Column:
    base = F.regexp_replace(F.lower(F.coalesce(name, F.lit(fallback))), "[^a-z0-9]+", "-")
    trimmed = F.substring(F.regexp_replace(base, "^-+|-+$", ""), 1, limit)
    return F.when(trimmed == "", F.lit(fallback)).otherwise(trimmed)


def project_slug_id(name: Column, row_key: Column) -> Column:
    """Readable id; the suffix hashes the row key so that a retried task repeats it."""
    return F.concat(slug(name), F.lit("-"), F.substring(F.sha2(row_key.cast("string"), 256), 1, 6))


def repository_ref(text: Column, host: str = "github.com") -> Column:
    """``struct<owner,name>`` from a URL, SSH remote or ``owner/name``; NULL when unusable."""
    quoted = host.replace(".", r"\.")
    path = js_trim(text)
    path = F.regexp_replace(path, rf"(?i)^git@{quoted}:", "")
    path = F.regexp_replace(path, rf"(?i)^(?:https?://)?(?:www\.)?{quoted}/", "")
    path = F.regexp_replace(path, r"(?i)\.git$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    owner, name = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))

    def legal(part: Column) -> Column:
        return part.rlike(r"^[A-Za-z0-9_.-]+\z") & ~part.rlike(r"^\.+\z")

    return F.when(legal(owner) & legal(name), F.struct(owner.alias("owner"), name.alias("name")))


def client_ip(forwarded: Column, real_ip: Column, direct: Column, trusted_hops: int = 1) -> Column:
    """The address ``trusted_hops`` from the right of the proxy chain."""
    fallback = F.coalesce(F.nullif(real_ip, F.lit("")), F.nullif(direct, F.lit("")), F.lit("unknown"))
    if trusted_hops <= 0:
        return fallback
    hops = F.filter(F.transform(F.split(forwarded, ","), js_trim), lambda h: h != "")
    index = F.greatest(F.size(hops) - trusted_hops, F.lit(0)) + 1
    return F.coalesce(F.when(F.size(hops) > 0, F.try_element_at(hops, index)), fallback)


def absolute_url(value: Column, fallback: Column) -> Column:
    cleaned = F.regexp_replace(js_trim(F.coalesce(value, F.lit(""))), "/$", "")
    return F.when(cleaned.rlike("^https?://"), cleaned).otherwise(fallback)


def like_pattern(term: str) -> str:
    """Contains-pattern for ILIKE with the user's wildcards live.

    A backslash before an ordinary character stands for that character, and a
    trailing one escapes the closing ``%``; Spark rejects the former, so it is dropped.
    """
    out, i = [], 0
    body = f"%{term}%"
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            out.append(body[i:i + 2] if body[i + 1] in "%_\\" else body[i + 1])
            i += 2
        else:
            out.append(body[i])
            i += 1
    return "".join(out)


# Hosts and path prefixes of accepted chat webhooks.
SLACK_HOST = "hooks.slack.com"
SLACK_PATH = "/services/"
DISCORD_HOSTS = ["discord.com", "discordapp.com", "canary.discord.com", "ptb.discord.com"]
DISCORD_PATH = r"^/api/(?:v\d+/)?webhooks/"
# Reasons for refusing one.
WEBHOOK_ERRORS = {
    "url": "That does not look like a valid URL.",
    "https": "Webhook URL must use https.",
    "slack_host": "Slack webhooks must be a hooks.slack.com URL.",
    "slack_path": "That is not a Slack incoming-webhook URL.",
    "discord_host": "Discord webhooks must be a discord.com URL.",
    "discord_path": "That is not a Discord webhook URL.",
    "type": "Unknown channel type.",
}


def webhook_error(kind: Column, url: Column) -> Column:
    """NULL for an acceptable webhook, else the reason it is refused."""
    e = {k: F.lit(v) for k, v in WEBHOOK_ERRORS.items()}
    protocol = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = url_host(url)
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    slack = F.when(host != SLACK_HOST, e["slack_host"]).when(~path.startswith(SLACK_PATH), e["slack_path"])
    discord = F.when(~host.isin(*DISCORD_HOSTS), e["discord_host"]).when(~path.rlike(DISCORD_PATH), e["discord_path"])
    return (F.when(protocol.isNull() | host.isNull(), e["url"])
            .when(protocol != "https", e["https"])
            .when(kind == "slack", slack)
            .when(kind == "discord", discord)
            .otherwise(e["type"]))
