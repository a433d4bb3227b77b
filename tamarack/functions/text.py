"""Text scalars as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Secret formats that scrubbing replaces, in this order.
SECRET_PATTERNS = (
    r"sk-ant-[A-Za-z0-9_\-]{20,}",
    r"sk-[A-Za-z0-9_\-]{20,}",
    r"gh[posru]_[A-Za-z0-9]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"AIza[0-9A-Za-z_\-]{30,}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
    r"(?i)(api[\s_-]?key|access[\s_-]?token|token|secret|password|passwd|pwd|bearer)\s*[:=]\s*\S+",
)
#: What every match of the pattern in that place has one of.
SECRET_SIGNS = (("sk-ant-",), ("sk-",), ("_",), ("AKIA",), ("AIza",), ("xox",), ("-----BEGIN ",), ("eyJ",), (":", "="))
REDACTED = "[REDACTED_SECRET]"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def lowered(text: Column) -> Column:
    """Lower case letter by letter, as SQL's: İ as i without a second dot, Σ as σ at a word's end too."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def normalized(text: Column) -> Column:
    """Lower case, runs of white space collapsed, trimmed."""
    # Single spaces, the most, are no match and not replaced by themselves.
    return F.trim(F.regexp_replace(lowered(text), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "))


def stripped(text: Column) -> Column:
    """Without white space at both ends (trim takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def stripped_long(text: Column) -> Column:
    """As stripped(), for long texts: one that neither begins with white space nor ends with it or a line's end is not searched."""
    space = list(" \t\n\x0b\f\r")
    ends = lambda t: F.substring(t, 1, 1).isin(space) | F.substring(t, -1, 1).isin([*space, "\x85", "\u2028", "\u2029"])
    return bound(text, lambda t: F.when(ends(t), stripped(t)).otherwise(t))


def content_hash(text: Column) -> Column:
    return F.sha1(normalized(text))


def content_id(prefix: str, *parts: Column) -> Column:
    """A content-addressed id: prefix and 16 hex digits."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def terms(text: Column) -> Column:
    """Lower-cased ASCII-alphanumeric tokens of more than two characters."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > 2)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.expr("0L") + F.floor(F.length(text) / 4))


def _folded(pattern: str) -> str:
    """A pattern of (?i) whose s and k match ſ and the Kelvin sign too, as in SQL; Java's match ASCII letters only."""
    return re.sub(r"\\.|[sk]", lambda m: {"s": "[s\u017f]", "k": "[k\u212a]"}.get(m[0], m[0]), pattern) if pattern.startswith("(?i)") else pattern


def scrub(text: Column) -> Column:
    """Secrets replaced, pattern by pattern. A text without a pattern's signs, which are looked up faster, is not searched for it."""
    for p, signs in zip(SECRET_PATTERNS, SECRET_SIGNS, strict=True):
        some = lambda t, signs=signs: reduce(Column.__or__, (t.contains(x) for x in signs))
        text = bound(text, lambda t, p=p, some=some: F.when(some(t), F.regexp_replace(t, _folded(p), REDACTED)).otherwise(t))
    return text


def has_secret(text: Column) -> Column:
    return scrub(text) != text


def fold(text: Column) -> Column:
    """Null as empty, the Turkish forms of I as i, trimmed, lower case."""
    return F.lower(F.trim(F.translate(F.coalesce(text, F.lit("")), "İIı", "iii")))


def predicate_name(text: Column) -> Column:
    """Folded, white space as one underscore."""
    return F.regexp_replace(F.regexp_replace(fold(text), r"\s+", "_"), "^_+|_+$", "")


def word_tokens(text: Column) -> Column:
    """Unicode word tokens of more than two characters, folded. Folding first keeps lengths, so no function runs per token."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}_]{3,}"), 0)


def term_matches(q: Column, d: Column) -> Column:
    """Equal, or one a prefix of the other with at least four characters each."""
    return (q == d) | ((F.least(F.length(q), F.length(d)) >= 4) & (d.startswith(q) | q.startswith(d)))


def lexical_roots(text: Column) -> Column:
    """Distinct first four characters of the tokens."""
    return F.array_distinct(F.transform(word_tokens(text), lambda t: F.substring(t, 1, 4)))


def listed(value: Column) -> Column:
    """Trimmed parts between commas and line ends, without empty ones; null: none."""
    parts = F.filter(F.transform(F.split(value, r"[,\n]"), stripped), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex HMAC (RFC 2104) from nested SHA-256; the key is a plan constant."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in raw).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def hmac_pads(key: Column) -> Column:
    """A key's inner and outer pad (64 bytes each), to be computed once for each key and used by hmac_padded()."""
    raw = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key.cast("binary"))
    # Hex digits of the key, filled up to 64 bytes, each byte combined with the pad.
    padded = F.rpad(F.hex(raw), 128, "0")
    byte = lambda i: F.conv(F.substring(padded, 2 * i + 1, 2), 16, 10).cast("int")
    pad = lambda x: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(F.lit(x))), 2, "0")), ""))
    return F.struct(pad(0x36).alias("inner"), pad(0x5C).alias("outer"))


def hmac_padded(pads: Column, message: Column) -> Column:
    """As hmac_sha256(), by a key's pads."""
    return F.sha2(F.concat(pads["outer"], F.unhex(F.sha2(F.concat(pads["inner"], message.cast("binary")), 256))), 256)


def blind(key: str, token: Column) -> Column:
    return F.substring(hmac_sha256(key, token), 1, 16)


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, others as one hyphen, at most 40 characters."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, 40), "^-+|-+$", "")


def rule_id(project: Column, rule_type: Column, message: Column) -> Column:
    base = F.replace(fold(F.coalesce(F.when(project != "", project), F.lit("global"))), F.lit(" "), F.lit("-"))
    s = slug(message)
    return F.concat_ws(
        "-", base, F.when(s == "", "rule").otherwise(s),
        F.substring(F.sha1(F.concat_ws("|", base, rule_type, normalized(message))), 1, 8),
    )


#: Severities from low to high.
SEVERITIES = ("low", "medium", "high", "critical")
#: Names of a project that stand for none.
PROJECT_PLACEHOLDERS = ("", "null", "none", "-", "yok", "ad veya null", "proje adı veya null")


def severity(value: Column, unknown: str) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(*SEVERITIES), v).otherwise(F.lit(unknown))


def severity_rank(value: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), value).cast("int")


def clean_project(value: Column) -> Column:
    return F.when(~F.lower(F.trim(value)).isin(*PROJECT_PLACEHOLDERS), F.trim(value))


def clean_terms(values: Column) -> Column:
    """Terms that hold a space or at least five characters, quoted for use in a pattern."""
    trimmed = F.transform(values, stripped)
    return F.transform(F.filter(trimmed, lambda t: t.contains(" ") | (F.length(t) >= 5)), lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}_])", r"\\$1"))


def path_template(path: Column) -> Column:
    return F.regexp_replace(path, r"^/v1/(rules|memories|keys)/[^/]+", "/v1/$1/{id}")


def safe_salience(value: Column) -> Column:
    """0 to 5; what is no finite number counts as 1."""
    v = value.try_cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, 1.0).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(5.0)))


def safe_embedding(value: Column) -> Column:
    """Null where empty or where an element isn't finite."""
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(value) > 0) & ~bad, value)


def decimal_text(value: Column) -> Column:
    """A double of at most six decimals without an exponent, with one decimal at least: 1700000000.0."""
    digits = F.regexp_replace(F.round(value, 6).cast("decimal(24,6)").cast("string"), "0+$", "")
    return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)


SEALED = "enc:v1:"


def encrypt(text: Column, key: str | None) -> Column:
    """AES-GCM under the SHA-256 of the key, in Base64 behind a mark; without a key, or if marked already, unchanged."""
    if not key:
        return text
    sealed = F.concat(F.lit(SEALED), F.base64(F.aes_encrypt(text.cast("binary"), F.unhex(F.sha2(F.lit(key), 256)))))
    return F.when(text.startswith(SEALED), text).otherwise(sealed)


def decrypt(text: Column, key: str | None) -> Column:
    """What encrypt() took; a text without the mark, or that the key doesn't open, is unchanged."""
    if not key:
        return text
    raw = F.try_aes_decrypt(F.unbase64(F.substring(text, len(SEALED) + 1, 1 << 30)), F.unhex(F.sha2(F.lit(key), 256)))
    return F.when(text.startswith(SEALED), F.coalesce(raw.cast("string"), text)).otherwise(text)


#: Addresses that are not public: this host, private, link-local, documentation, benchmarks, multicast, reserved.
CLOSED_V4 = r"^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
CLOSED_V6 = r"^::1?$|^f[cd]|^fe[89ab]|^ff|^2001:0?db8:"


def safe_url(url: Column, addresses: Column) -> Column:
    """http or https, with a host, and every address that it resolves to (an array; a host that is an address is its own) public."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^https?://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/:?#]+)", 1)
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    literal = bare.rlike(r"^[0-9.]+$") | bare.contains(":")
    known = F.when(literal, F.array(bare)).otherwise(addresses)
    closed = lambda a: (lambda x: x.rlike(CLOSED_V4) | x.rlike(CLOSED_V6))(F.regexp_replace(F.lower(a), r"^::ffff:(?=[0-9.]+$)", ""))
    return (host != "") & F.coalesce((F.size(known) > 0) & ~F.exists(known, closed), F.lit(False))


def scrub_json(text: Column) -> Column:
    """Secrets masked in a JSON text's strings, keys included: a name and its value never share a string, so the patterns that span
    both can't match across them."""
    quoted = r'"(?:[^"\\]|\\.)*"'
    strings, gaps = F.regexp_extract_all(text, F.lit(quoted), 0), F.split(text, quoted)
    pairs = F.zip_with(
        gaps,
        F.transform(
            strings, lambda s: F.concat(F.lit('"'), scrub(F.substring(s, F.lit(2), F.length(s) - 2)), F.lit('"')),
        ),
        lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit(""))),
    )
    return F.array_join(pairs, "")


def first_json(text: Column, schema: str) -> Column:
    """The first {...} block, parsed; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)
