"""Text operators as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of secrets, in the order in which they are replaced.
SECRETS = [
    ("openai_key", r"sk-[A-Za-z0-9_-]{16,}"),
    ("github_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}"),
    ("github_pat", r"github_pat_[A-Za-z0-9_]{20,}"),
    ("aws_access_key", r"AKIA[0-9A-Z]{16}"),
    ("slack_token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{16,}\.eyJ[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{8,}"),
    ("db_url_with_password", r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s\"'@/]+:[^\s\"'@/]+@[^\s\"']+"),
    ("bearer_token", r"Bearer\s+[A-Za-z0-9._~+/=-]{24,}"),
    ("env_secret_assignment", r"\b([A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|PASSWD|API_KEY|ACCESS_KEY|PRIVATE_KEY)[A-Z0-9_]*)\s*[=:]\s*[\"']?[^\s\"']{8,}[\"']?"),
]
# Private shapes and what stands for them, in order.
PRIVATE = [
    (r"(?i)\b(?:https?|file|postgres(?:ql)?)://[^\s<>\"']*", "[private URL]"),
    (r"\b[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n\s]*", "[local path]"),
    (r"\\\\[A-Za-z0-9.$_-]+\\[^\s<>\"']+", "[local path]"),
    (r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "[private email]"),
    (r"(?i)\b(?:sk|pk|api|token|key)[-_][A-Za-z0-9_-]{12,}\b", "[credential]"),
    (r"(?i)((?:pairing|access|api)\s+(?:code|key|token)\s*[:=]?\s*)[A-Za-z0-9_-]{6,}", "$1[credential]"),
    (r"\b[A-Za-z0-9_-]{48,}\b", "[sensitive token]"),
]
# Patterns of statements, in the order in which they decide.
PASTED = r"(?i)pasted (?:text|markdown)|\b(?:document|file)\s*$"
STATEMENTS = [
    ("decision", r"(?i)\b(?:approved|agreed|yes for sure|for sure|that is the plan)\b"),
    ("requirement", r"(?i)\b(?:must|do not|don't|never|i want|i don't want|needs? to|have to)\b"),
    ("correction", r"(?i)^\s*(?:no\b|that's not|that is not|why are we|what are we even|i'm not saying)"),
    ("unresolved_question", r"(?i)[?]|\b(?:what|how|why|where|when|should|could|can we|is there)\b"),
]
AUTHORITY = [
    r"(?i)\b(user|operator)\b.{0,80}\b(decid|requir|prefer|instruct|commit|directive)",
    r"(?i)\b(decid|requir|prefer|instruct|commit|directive)\w*\b.{0,80}\b(user|operator)\b",
]


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def redact_secrets(text: Column) -> Column:
    """The text with every secret named instead of shown; assignments keep their variable."""
    return reduce(lambda t, s: F.regexp_replace(t, s[1], ("$1=" if s[0] == "env_secret_assignment" else "") + f"[REDACTED:{s[0]}]"), SECRETS, text)


def redaction_counts(text: Column) -> Column:
    """How often each shape was replaced, as name=count in order; a shape is counted in the text the earlier ones left."""
    counts = []
    for name, pattern in SECRETS:
        n = F.regexp_count(text, F.lit(pattern))
        counts.append(F.when(n > 0, F.concat(F.lit(f"{name}="), n.cast("string"))))
        text = F.regexp_replace(text, pattern, ("$1=" if name == "env_secret_assignment" else "") + f"[REDACTED:{name}]")
    return F.array_join(F.array_compact(F.array(*counts)), ",")


def private_projection(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), PRIVATE, text)


# What sensitive output is replaced by, in order.
SENSITIVE = [
    (r"(?i)postgres(?:ql)?://[^\s\"'<>]+", "[REDACTED_DATABASE_URL]"),
    (r"\beyJ[A-Za-z0-9_-]{20,}(?:\.[A-Za-z0-9_-]{10,}){1,2}\b", "[REDACTED_JWT]"),
    (r"(?i)(anon|service[_ -]?role|secret|password|pairing[_ -]?code|api[_ -]?key)\s*[:=]\s*[^\s,;]+", "$1=[REDACTED]"),
    (r"(?i)https?://(?!127\.0\.0\.1(?::|/)|localhost(?::|/)|\[::1\](?::|/))[^\s\"'<>]+", "[REDACTED_NONLOCAL_URL]"),
]


def sanitized(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), SENSITIVE, text)


def approved_statement(statement: Column, candidate_type: Column, first: Column, last: Column, n: Column, json: Column) -> Column:
    """What stands for an approved record: its statement, else its message range, else 400 characters of its JSON."""
    spoken = F.concat(F.lit("Approved message range "), first.cast("string"), F.lit("–"), last.cast("string"), F.lit(" ("), n.cast("string"), F.lit(" messages) of the preserved capture."))
    return F.when(F.trim(statement) != "", statement).when(candidate_type == "message_range", spoken).otherwise(F.substring(json, 1, 400))


def control_free(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")


def derived(text: Column, limit: int) -> Column:
    clean = F.trim(F.regexp_replace(control_free(private_projection(text)), r"\s+", " "))
    return F.substring(clean, 1, limit)


def excerpt(text: Column, most: int = 220) -> Column:
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.substring(clean, 1, most - 3), F.lit("…")))


def statement_kind(role: Column, text: Column, attached: Column | None = None) -> Column:
    pasted = F.substring(F.trim(text), 1, 160).rlike(PASTED)
    out = F.when(pasted if attached is None else attached | pasted, "pasted_external_material") \
        .when(role == "assistant", "assistant_suggestion").when(role != "user", "user_statement")
    for kind, pattern in STATEMENTS:
        out = out.when(text.rlike(pattern), kind)
    return out.otherwise("user_statement")


def claims_authority(statement: Column) -> Column:
    return statement.rlike(AUTHORITY[0]) | statement.rlike(AUTHORITY[1])


def path_segment(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[^a-zA-Z0-9._-]", "_"), 1, 120)


def first_line_title(text: Column, most: int = 120) -> Column:
    return F.substring(F.get(F.split(F.trim(text), "\n"), F.lit(0)), 1, most)


def probe_word(text: Column, least: int = 5) -> Column:
    """The longest purely alphabetic word of so many letters; of equals, the first in the text."""
    words = F.filter(F.split(text, r"[^A-Za-z]+"), lambda w: F.length(w) >= least)
    longest = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.when(F.size(words) > 0, longest)


def epoch_seconds(value: Column) -> Column:
    """Seconds of an epoch number that is in milliseconds where seconds would be beyond the year 9999."""
    return F.when(F.abs(value) > 253402300799, value / 1000).otherwise(value)


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def length_bucket(n: Column) -> Column:
    return F.when(n < 5000, "short").when(n < 30000, "medium").otherwise("long")
