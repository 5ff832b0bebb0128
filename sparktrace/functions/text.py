"""Text functions of trace records, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exact leading strings that wrap another error message.
WRAPPERS = (
    "Ошибка при вызове метода контекста (Выполнить)\nпо причине:\n",
    "Ошибка при вызове метода контекста (Execute)\nпо причине:\n",
    "Ошибка выполнения запроса:\n",
    "Ошибка при выполнении запроса:\n",
    "Error calling context method (Execute)\nCaused by:\n",
    "Error executing query:\n",
)
#: Error categories with the markers that decide them, first match first.
CATEGORIES = {
    "statement_cancelled": ("canceling statement due to user request", "отмена выполнения запроса", "запрос отменен", "запрос отменён"),
    "permission_denied": ("permission denied", "недостаточно прав", "нарушение прав доступа", "нет прав"),
    "session_missing_or_deleted": ("сеанс отсутствует", "сеанс удален", "сеанс удалён", "session does not exist", "session was deleted"),
    "passive_service": ("пассивн", "passive service"),
    "form_error": ("ошибка формы", "управляемаяформа", "обычнаяформа", "formexception"),
    "external_resource": ("ошибка работы с ресурсом", "выполнении запроса post", "выполнении запроса get", "http"),
    "postgresql_reported": ("postgres", "sqlstate", "dbpostgrs"),
}
OTHER = "other_application_or_platform_error"
#: Rules of error signatures and incidents, as their ids name them.
ERROR_VERSION, INCIDENT_VERSION = "full_message/v2", "same_call_exact_payload/v1"
#: Fixed value: contexts of background work.
BACKGROUND = "(?i)Регламентн|Фонов|Background|ServerJobExecutor|ScheduledJob|ВыполнитьФоновоеЗадание"
UNKNOWN_USERS = ("(not specified)", "(unknown)", "")


def clean(x: Column | str, limit: int | None = None) -> Column:
    """White space runs as one space, trimmed; cut to limit with three dots."""
    out = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))
    return out if limit is None else F.when(F.char_length(out) > limit, F.concat(F.substring(out, 1, limit - 3), F.lit("..."))).otherwise(out)


def context_root(x: Column | str) -> Column:
    """First line that isn't blank, cleaned."""
    lines = F.filter(F.split(F.coalesce(x, F.lit("")), r"\R"), lambda line: F.trim(F.regexp_replace(line, r"(?U)\s+", " ")) != "")
    return F.when(F.size(lines) > 0, clean(F.get(lines, F.lit(0)), 900)).otherwise("")


def signature(context: Column | str, parts: list[str]) -> Column:
    """Context root, else the parts that aren't blank, else a fixed label."""
    kept = F.array_join(F.filter(F.array(*[clean(F.col(p)) for p in parts]), lambda p: p != ""), " | ")
    root = context_root(context)
    return F.when(root != "", root).when(kept != "", kept).otherwise("(signature unavailable)")


def user(raw: Column | str) -> Column:
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "(not specified)").otherwise(raw)


def normalize_error(x: Column | str) -> Column:
    """Identifiers, dates and numbers of two digits or more replaced, in that order; the patterns are fixed values."""
    out = clean(x)
    out = F.regexp_replace(out, r"(?U)\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b", "<uuid>")
    out = F.regexp_replace(out, r"(?U)\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?\b", "<date>")
    return F.regexp_replace(out, r"(?U)\b\d{2,}\b", "#")


def classify_error(x: Column | str) -> Column:
    text = F.lower(F.substring(clean(x), 1, 6000))
    out = F.lit(None).cast("string")
    for category, markers in CATEGORIES.items():
        found = F.lit(False)
        for marker in markers:
            found = found | text.contains(marker)
        out = F.coalesce(out, F.when(found, category))
    return F.coalesce(out, F.lit(OTHER))


def strip_wrappers(x: Column | str) -> Column:
    """Line ends made one kind, outer white space and leading wrappers removed, repeatedly."""
    text = stripped(F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n?", "\n"))
    each = "|".join(r"\Q" + w + r"\E(?U:\s*)" for w in WRAPPERS)
    return stripped(F.regexp_replace(text, "^(?:" + each + ")+", ""))


def stripped(x: Column | str) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def blank(x: Column | str) -> Column:
    return stripped(F.coalesce(x, F.lit(""))) == ""


def message_state(x: Column | str) -> Column:
    return F.when(F.isnull(x), "missing").when(stripped(x) == "", "empty").otherwise("present")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole)


def canonical_id(*parts: Column | str) -> Column:
    """SHA-256 of the parts as a JSON array of strings."""
    return F.sha2(F.to_json(F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])), 256)


#: Versions of the normal form, and what the digest of the newer one begins with.
SQL_VERSION, LEGACY_SQL_VERSION, SQL_SALT = "2.0", "1.0-regex", "1c-tj-sql"


def sql_fingerprint(normalized: Column | str, version: str = SQL_VERSION) -> Column:
    """Digest of a statement's normal form; the legacy version is of the text alone."""
    if version == LEGACY_SQL_VERSION:
        return F.sha2(normalized, 256)
    if version != SQL_VERSION:
        raise ValueError(f"unknown version of the SQL normal form: {version}")
    return F.sha2(F.concat(F.lit(SQL_SALT), F.char(F.lit(0)), F.lit(version), F.char(F.lit(0)), normalized), 256)


def key_relation(event_key: str, call_key: str, label: str = "event_missing") -> Column:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return F.when(blank(event_key) & blank(call_key), "both_missing").when(blank(event_key), label).when(blank(call_key), "call_missing").when(F.col(event_key) == F.col(call_key), "match").otherwise("conflict")
