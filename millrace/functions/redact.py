"""Secrets, moderation and masking as column expressions."""

from __future__ import annotations

import functools
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known token formats, in the order in which they are replaced.
KNOWN_TOKENS = [
    ("github_pat_classic", r"ghp_[A-Za-z0-9]{36,}"),
    ("github_pat_fine", r"github_pat_[A-Za-z0-9_]{22,}"),
    ("github_oauth", r"gh[osu]_[A-Za-z0-9]{36,}"),
    ("stripe_key", r"sk_(?:live|test)_[A-Za-z0-9]{24,}"),
    ("stripe_pub", r"pk_(?:live|test)_[A-Za-z0-9]{24,}"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("slack_token", r"xox[abpors]-[A-Za-z0-9-]{10,}"),
    ("google_api_key", r"AIza[0-9A-Za-z_\-]{35}"),
    ("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"),
    ("uri_credentials", r"([A-Za-z][A-Za-z0-9+.\-]*://)[^\s:@/]+:([^\s@/]+)@"),
    ("pem_private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
]
# Arguments that carry secrets; group 1 stays.
ARGUMENTS = [
    ("auth_header", r"""(?i)(-H\s+["']?(?:Authorization|X-[A-Za-z-]*(?:Auth|Key|Token)[A-Za-z-]*):\s*)([^"'\s]+(?:\s+[^"'\s]+)?)""", "auth_header"),
    ("basic_auth", r"(-u\s+)([^\s:]+:[^\s]+)", "basic_auth"),
    ("sensitive_flag_eq", r"(?i)(--(?:token|secret|key|password|passwd|pass|auth|credential|api[-_]?key|access[-_]?token|client[-_]?secret)=)([^\s]+)", "sensitive_flag"),
    ("sensitive_flag_sp", r"(?i)(--(?:token|secret|key|password|passwd|pass|auth|credential|api[-_]?key|access[-_]?token|client[-_]?secret)\s+)([^\s]+)", "sensitive_flag"),
    ("env_prefix", r"(?i)((?:^|[;&|]\s*)[A-Z][A-Z0-9_]*(?:TOKEN|SECRET|KEY|PASSWORD|PASSWD|PASS|AUTH|CREDENTIAL|APIKEY|ACCESS_TOKEN|PRIVATE)[A-Z0-9_]*=)([^\s]+)", "env_prefix"),
]
# Programs whose arguments are secret with one of these words.
RISKY = {
    "vault": ("kv", "read", "write", "login", "token"), "op": ("read", "item", "signin", "get"), "pass": ("show", "insert", "edit", "generate"),
    "gpg": ("--decrypt", "-d", "--export-secret-keys"), "aws": ("configure", "sso"), "gh": ("auth",), "doctl": ("auth",), "gcloud": ("auth",),
}
# What moderation looks for.
INVISIBLE = r"[\x{200B}\x{200C}\x{200D}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}\x{2066}-\x{2069}\x{FEFF}\x{FE00}-\x{FE0F}]"
INJECTION = [
    r"(?i)ignore\s+(?:all\s+)?previous\s+instructions", r"(?i)disregard\s+(?:all\s+)?(?:previous|prior|above)", r"(?i)you\s+are\s+now\s+a",
    r"(?i)override\s+your\s+(?:instructions|rules|guidelines)", r"(?i)forget\s+everything\s+(?:you|and)", r"(?i)new\s+instructions\s*:", r"(?i)system\s+prompt",
    r"(?i)print\s+your\s+instructions", r"(?i)reveal\s+(?:your\s+)?(?:secret\s+)?prompt", r"(?i)do\s+anything\s+now", r"(?i)simulate\s+a\s+(?:developer|admin)",
    r"(?i)developer\s+mode", r"(?i)bypass\s+(?:filters|security)", r"(?i)ignore\s+(?:the\s+)?above\s+and\s+instead",
]
CREDENTIALS = [
    ("AWS Access Key ID", r"\bAKIA[0-9A-Z]{16}\b"), ("GitHub Token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36}\b"),
    ("Slack Token", r"\bxox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*\b"), ("Stripe Live Key", r"\b(?:sk|rk)_live_[0-9a-zA-Z]{24}\b"),
    ("Private Key", r"-----BEGIN (?:RSA|OPENSSH|DSA|EC|PGP) PRIVATE KEY-----"),
]
PERSONAL = [
    ("Social Security Number", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("Credit Card Number", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9][0-9])[0-9]{12})\b"),
]
SYSTEM = [
    r"(?i)(?:;|\||&&|`|\$\()\s*(?:rm\s+-|wget|curl|bash|sh|nc|netcat|nmap|python|perl|ruby|php|node)\b",
    r"(?i)/etc/(?:passwd|shadow|hosts|sudoers)",
]
WEB = [
    r"(?i)<script\b[^>]*>[\s\S]*?</script>", r"(?i)javascript\s*:", r"(?i)\bon(?:error|load|click|mouseover|keydown)\s*=", r"(?i)UNION\s+(?:ALL\s+)?SELECT",
    r"""(?i)\bOR\s+['"]?1['"]?\s*=\s*['"]?1['"]?""", r"(?i);\s*(?:DROP|ALTER|TRUNCATE)\s+TABLE",
]
SECRET_NAMES = ("key", "secret", "token", "pass", "pwd", "auth", "cert", "hash")


# Of these parts every match of a format, or of an argument, holds one.
MARKS = {
    "github_pat_classic": ["ghp_"], "github_pat_fine": ["github_pat_"], "github_oauth": ["gho_", "ghs_", "ghu_"], "stripe_key": ["sk_live_", "sk_test_"], "stripe_pub": ["pk_live_", "pk_test_"], "aws_access_key": ["AKIA", "ASIA"],
    "slack_token": ["xox"], "google_api_key": ["AIza"], "jwt": ["eyJ"], "uri_credentials": ["://"], "pem_private_key": ["PRIVATE KEY-----"],
    "auth_header": ["-H", "-h"], "basic_auth": ["-u"], "sensitive_flag_eq": ["--"], "sensitive_flag_sp": ["--"], "env_prefix": ["="],
}


def _marked(text: Column, kind: str) -> Column:
    return functools.reduce(Column.__or__, [text.contains(w) for w in MARKS[kind]])


def _replaced(text: Column, kind: str, pattern: str, by: str) -> Column:
    """The text after a replacement, searched for only in texts that hold what a match needs."""
    return F.get(F.transform(F.array(text), lambda x: F.when(_marked(x, kind), F.regexp_replace(x, pattern, by)).otherwise(x)), F.lit(0))  # the text before is made once


def holds_known_token(text: Column) -> Column:
    return functools.reduce(Column.__or__, [_marked(text, kind) & text.rlike(pattern) for kind, pattern in KNOWN_TOKENS])


def redact_known_tokens(text: Column) -> Column:
    for kind, pattern in KNOWN_TOKENS:
        text = _replaced(text, kind, pattern, f"[REDACTED:{kind}]")
    return text


def known_token_counts(df: DataFrame, column: str) -> DataFrame:
    """Adds the number of matches of each format, each counted after the formats before it were replaced."""
    rows = df.withColumn("__left", F.col(column))
    for kind, pattern in KNOWN_TOKENS:
        found = F.when(_marked(F.col("__left"), kind), F.regexp_count("__left", F.lit(pattern))).when(F.col("__left").isNotNull(), 0)
        rows = rows.withColumn(kind, found).withColumn("__left", _replaced(F.col("__left"), kind, pattern, f"[REDACTED:{kind}]"))
    return rows.drop("__left")


def redact_arguments(text: Column) -> Column:
    for kind, pattern, label in ARGUMENTS:
        text = _replaced(text, kind, pattern, f"$1[REDACTED:{label}]")
    return text


def entropy(token: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(token, "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def is_secret_token(token: Column, threshold: float = 4.5, least: int = 20) -> Column:
    """Long tokens of high entropy that are neither a commit hash nor a UUID nor a mark of redaction."""
    ordinary = token.rlike("^[0-9a-f]{40}$") | token.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$") | token.contains("REDACTED")
    return F.when(F.octet_length(token) < least, False).when(ordinary, False).otherwise(entropy(token) >= threshold)


TOKEN = r"[A-Za-z0-9+/=_\-]{8,}"
# Fixed value: 20 characters of a token, tried at its first one only. Letter by letter the class is a table; ranges are compared one by one.
LONG_TOKEN = rf"(?<![{string.ascii_letters}{string.digits}+/=_\-])[{string.ascii_letters}{string.digits}+/=_\-]{{20}}"


def secret_tokens(df: DataFrame, column: str, key: str, threshold: float = 4.5) -> DataFrame:
    """(key, token) of the high-entropy tokens; each different token is measured once."""
    found = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(TOKEN), 0))).alias("token")).filter(F.octet_length("token") >= 20)
    secret = found.select("token").distinct().filter(is_secret_token(F.col("token"), threshold))
    return found.join(secret, "token").select(key, "token")


def redact_entropy(text: Column, threshold: float = 4.5) -> Column:
    """The text with each high-entropy token replaced where it stands."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda x: F.when(is_secret_token(x, threshold), "[REDACTED:high_entropy]").otherwise(x))
    rewritten = F.array_join(F.zip_with(F.split(text, TOKEN, -1), tokens, lambda before, x: F.concat(before, F.coalesce(x, F.lit("")))), "")
    return F.when(text.rlike(LONG_TOKEN), rewritten).otherwise(text)


def redact_denylist(column: str, programs: Sequence[str] = tuple(RISKY)) -> Column:
    """Commands of a listed program that hold one of its risky arguments anywhere, as a part of a word too."""
    first = F.split(F.trim(column), r"\s+")[0]
    out = F.col(column)
    for program in programs:
        risky = functools.reduce(Column.__or__, [F.col(column).contains(w) for w in RISKY[program]])
        out = F.when((first == program) & risky, F.lit(f"{program} [REDACTED:denylisted_command]")).otherwise(out)
    return out


def redacted_share(column: str) -> Column:
    spans = F.regexp_extract_all(column, F.lit(r"\[REDACTED:[^\]]*\]"), 0)
    return F.octet_length(F.array_join(spans, "")) / F.greatest(F.octet_length(column), F.lit(1))


def redact_damage_cap(column: str, command: bool, ratio: float = 0.5) -> tuple[Column, Column]:
    """The text, collapsed where redaction left too little, and whether it was."""
    dropped = redacted_share(column) > ratio
    first = F.split(F.trim(column), r"\s+")[0]
    short = F.concat(first, F.lit(" [REDACTED:damage_cap]")) if command else F.lit("[REDACTED:damage_cap]")
    return F.when(dropped, short).otherwise(F.col(column)), dropped


def redact_pipeline(df: DataFrame, column: str, command: bool = False) -> DataFrame:
    """All layers in order: the text, whether it may be embedded, and whether it is dropped. It runs on streams too."""
    rows = df.withColumn("embedding_safe", ~holds_known_token(F.col(column)))
    rows = rows.withColumn(column, redact_arguments(redact_known_tokens(F.col(column)))).withColumn(column, redact_entropy(F.col(column)))
    rows = rows.withColumn(column, redact_denylist(column)) if command else rows
    text, dropped = redact_damage_cap(column, command)
    return rows.withColumn("dropped", dropped).withColumn(column, text)


# What a warning says.
WARNINGS = {
    "invisible": "Invisible unicode characters detected (zero-width, directional override, or variation selector)", "injection": "Possible prompt injection pattern: ", "credential": "Possible exposed credential: ",
    "personal": "Possible Personally Identifiable Information (PII) detected: ", "system": "Possible system command injection or sensitive file access: ", "web": "Possible web/SQL injection detected: ",
    "exfiltration": "Possible exfiltration attempt: HTTP tool combined with secret/env variable reference", "encoded": "Suspicious encoded payload: long base64-like string (100+ chars)",
}
EXFILTRATION_TOOL = r"(?i)\b(?:curl|wget)\b|fetch\s*\("
EXFILTRATION_SECRET = r"(?i)\$[A-Z_]*(?:SECRET|KEY|TOKEN|PASSWORD)|process\.env\b|\.env\b"
LONG_BASE64 = r"[A-Za-z0-9+/=]{100,}"


# What every match holds, by pattern: of each group one at least. Patterns without regard to case look in the
# text in lower case. A text that lacks one is not searched.
NEEDED = dict(zip(INJECTION, [
    [["ignore"], ["previous"], ["instructions"]], [["disregard"]], [["you"], ["are"], ["now"]], [["override"]], [["forget"], ["everything"]], [["new"], ["instructions"]], [["system"], ["prompt"]],
    [["print"], ["instructions"]], [["reveal"], ["prompt"]], [["anything"]], [["simulate"]], [["developer"], ["mode"]], [["bypass"]], [["ignore"], ["above"], ["instead"]],
])) | dict(zip([p for _, p in CREDENTIALS], [[["AKIA"]], [["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]], [["xox"]], [["_live_"]], [["PRIVATE KEY-----"]]])) | dict(zip(SYSTEM, [
    [[";", "|", "&&", "`", "$("], ["rm", "wget", "curl", "bash", "sh", "nc", "netcat", "nmap", "python", "perl", "ruby", "php", "node"]], [["/etc/"]],
])) | dict(zip(WEB, [
    [["<script"], ["</script>"]], [["javascript"]], [["="], ["onerror", "onload", "onclick", "onmouseover", "onkeydown"]], [["union"], ["select"]], [["="], ["or"], ["1"]], [[";"], ["table"]],
])) | {EXFILTRATION_TOOL: [["curl", "wget", "fetch"]], EXFILTRATION_SECRET: [["$", "process.env", ".env"]]}
# LONG_BASE64 tried at the first character of a run only, and the first bytes of what INVISIBLE holds, in UTF-8.
_RUN_OF_100 = f"(?<![{string.ascii_letters}{string.digits}+/=])[{string.ascii_letters}{string.digits}+/=]{{100}}"  # letter by letter: a table, where ranges are compared one by one
_INVISIBLE_BYTES = (b"\xe2\x80", b"\xe2\x81", b"\xef\xb8", b"\xef\xbb")
# Fixed value: the boundary of a word of ASCII letters, digits and underscores. Before Java 19 \b counts letters of all scripts as parts of words, though \w doesn't.
_WORD_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def holds_needed(text: Column, low: Column, pattern: str) -> Column:
    """Whether a text, and its form in lower case, hold what every match of the pattern holds. It costs less than a search."""
    at = low if pattern.startswith("(?i)") else text
    if pattern == INVISIBLE:
        return (F.octet_length(text) > F.length(text)) & functools.reduce(Column.__or__, [F.contains(text.cast("binary"), F.lit(x)) for x in _INVISIBLE_BYTES])
    if pattern == LONG_BASE64:
        return text.rlike(_RUN_OF_100)
    if pattern in [p for _, p in PERSONAL]:
        return text.rlike("[0-9]-[0-9]{2}-[0-9]" if pattern == PERSONAL[0][1] else "[0-9]{13}")
    return functools.reduce(Column.__and__, [functools.reduce(Column.__or__, [at.contains(w) for w in group]) for group in NEEDED[pattern]])


def scan_content(column: str) -> Column:
    """Warnings in order. A pattern is searched for only where the text holds what every match of it holds."""
    return F.get(F.transform(F.array(F.lower(column)), lambda low: _warnings(F.col(column), low)), F.lit(0))  # lower case once


def _warnings(text: Column, low: Column) -> Column:
    hit = lambda p: holds_needed(text, low, p) & text.rlike(p.replace(r"\b", _WORD_BOUNDARY))
    first = F.lit(None).cast("string")
    for p in reversed(INJECTION):
        first = F.when(hit(p), F.lit(WARNINGS["injection"] + p)).otherwise(first)
    found = [F.when(hit(INVISIBLE), WARNINGS["invisible"]), first]
    found += [F.when(hit(p), WARNINGS["credential"] + n) for n, p in CREDENTIALS]
    found += [F.when(hit(p), WARNINGS["personal"] + n) for n, p in PERSONAL]
    found += [F.when(hit(p), WARNINGS["system"] + p) for p in SYSTEM]
    found += [F.when(hit(p), WARNINGS["web"] + p) for p in WEB]
    found += [F.when(hit(EXFILTRATION_TOOL) & hit(EXFILTRATION_SECRET), WARNINGS["exfiltration"]), F.when(hit(LONG_BASE64), WARNINGS["encoded"])]
    return F.array_compact(F.array(*found))


def moderation_status(reasons: str) -> Column:
    hard = F.exists(reasons, lambda x: x.contains("Private Key") | x.contains("Possible exposed credential"))
    return F.when(F.size(reasons) == 0, "clean").when(hard, "reject_hard").otherwise("flagged_soft")


def moderate(df: DataFrame, column: str) -> DataFrame:
    rows = df.withColumn("__text", F.trim(column))
    rows = rows.select("*", F.explode(F.array(scan_content("__text"))).alias("reasons")).drop("__text")  # filters on the status don't scan again
    return rows.withColumn("status", moderation_status("reasons"))


def mask_secret_keys(key: str, value: str, reveal: bool = True) -> Column:
    """Values of keys with secret names, and long values, are hidden; null stays null."""
    secret = F.lit(False)
    for name in SECRET_NAMES:
        secret = secret | F.lower(key).contains(name)
    low = F.lower(F.trim(value))
    safe = low.isin("true", "false", "1", "0") | low.startswith("http://localhost") | low.startswith("http://127.0.0.1") | (F.octet_length(value) < 8)
    return F.when(F.col(value).isNull() | ~secret & safe, F.col(value)).otherwise(F.lit("***HIDDEN***")) if reveal else F.lit(None).cast("string")
