"""Text columns: names, slugs, redaction, value and unit parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Replacements that hide secrets, in order: prefixed keys, headers, key=value forms, then long runs. Patterns that both dialects read alike.
SECRETS = (
    (r"\bsk-[A-Za-z0-9_/+=-]{8,}", "[redacted-key]"),
    (r"\bsk_[A-Za-z0-9_-]{8,}", "[redacted-key]"),
    (r"\bgsk_[A-Za-z0-9_-]{8,}", "[redacted-key]"),
    (r"\bcsk-[A-Za-z0-9_-]{8,}", "[redacted-key]"),
    (r"\bnvapi-[A-Za-z0-9_-]{8,}", "[redacted-key]"),
    (r"\bAIza[0-9A-Za-z_-]{20,}", "[redacted-key]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}", "[redacted-key]"),
    (r"\bghp_[A-Za-z0-9]{20,}", "[redacted-key]"),
    (r"\bhf_[A-Za-z0-9]{16,}", "[redacted-key]"),
    (r"\bcfut_[A-Za-z0-9]{16,}", "[redacted-key]"),
    (r"\bvck_[A-Za-z0-9]{16,}", "[redacted-key]"),
    (r"\bcpk_[A-Za-z0-9.]{16,}", "[redacted-key]"),
    (r"\balv2_[A-Za-z0-9]{16,}", "[redacted-key]"),
    (r"\brqsty-sk-[A-Za-z0-9_/+=-]{16,}", "[redacted-key]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[redacted-key]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [redacted]"),
    (r"(?i)(\bx-goog-api-key\b[\"']?\s*[:=]\s*[\"']?)[^\[\"',\s}\]&][^\"',\s}\]&]*", "$1[redacted-key]"),
    (r"(?i)(\bx-api-key\b[\"']?\s*[:=]\s*[\"']?)[^\[\"',\s}\]&][^\"',\s}\]&]*", "$1[redacted-key]"),
    (r"(?i)([\"']?\b(?:api[_-]?key|access[_-]?token|refresh[_-]?token|auth[_-]?token|token|secret|password|encryption[_-]?key|key)\b[\"']?\s*[:=]\s*[\"']?)[^\[\"',\s}\]&][^\"',\s}\]&]{5,}", "$1[redacted-key]"),
    (r"\b[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\b", "[redacted-token]"),
    (r"\b[A-Za-z0-9]{24,}\.[A-Za-z0-9_-]{16,}\b", "[redacted-token]"),
    (r"\b[A-Za-z0-9]{32,}\b", "[redacted-token]"),
)
#: Links in error texts.
LINK = (r"(?i)\bhttps?://[^\s\"'<>)]*", "[redacted-url]")
MOST_CHARS = 240

# Canonical units by alias.
UNITS = {
    "inch": "in", "inches": "in", '"': "in",
    "foot": "ft", "feet": "ft", "'": "ft",
    "millimeter": "mm", "millimeters": "mm", "millimetre": "mm",
    "centimeter": "cm", "centimeters": "cm", "centimetre": "cm",
    "meter": "m", "meters": "m", "metre": "m",
    "kilogram": "kg", "kilograms": "kg", "kilo": "kg",
    "gram": "g", "grams": "g",
    "pound": "lb", "pounds": "lb", "lbs": "lb",
    "ounce": "oz", "ounces": "oz",
    "volt": "V", "volts": "V",
    "amp": "A", "amps": "A", "ampere": "A", "amperes": "A",
    "watt": "W", "watts": "W",
    "kilowatt": "kW", "kilowatts": "kW",
    "horsepower": "HP",
    "celsius": "°C", "deg c": "°C", "deg. c": "°C", "degrees c": "°C",
    "fahrenheit": "°F", "deg f": "°F", "deg. f": "°F",
    "decibel": "dB", "decibels": "dB",
    "rpm": "RPM", "r.p.m.": "RPM",
}

# Texts that stand for no value.
PLACEHOLDERS = ("-- unbranded --", "-- no unilog brand --", "-- no dib brand --", "unbranded", "no brand", "n/a", "na", "null", "none", "unknown", "-", "--", "undefined")

NUMBER_UNIT = r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z°/%\"'][a-zA-Z°/%.]*(?: [a-zA-Z])?)?\s*$"
FRACTION = r"^\s*([0-9]+)/([0-9]+)\s*(.+)$"


def redact(text: Column) -> Column:
    """Secrets replaced by the rules in order; null stays null."""
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, pattern, put)
    return text


def sanitise(text: Column) -> Column:
    """An error text: secrets and links hidden, white space squeezed, cut to MOST_CHARS with an ellipsis."""
    text = F.trim(F.regexp_replace(F.regexp_replace(redact(text), *LINK), r"\s+", " "))
    return F.when(F.length(text) > MOST_CHARS, F.concat(F.rtrim(F.substring(text, 1, MOST_CHARS - 3)), F.lit("..."))).otherwise(text)


def redact_sql(column: str, rules: tuple = SECRETS) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, put in rules:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(put.replace('$', chr(92)))}, 'g')"
    return column


def sanitise_sql(column: str) -> str:
    out = f"trim(regexp_replace({redact_sql(redact_sql(column), (LINK,))}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({out}) > {MOST_CHARS} THEN rtrim(substring({out}, 1, {MOST_CHARS - 3})) || '...' ELSE {out} END"


def group_key(name: Column) -> Column:
    """A model name without trailing remarks in brackets or ``free``, lower-cased, separators as one blank."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"(\s*\([^()]*\)|\s+free)+\s*$", "")), r"[\s_./-]+", " ")


def slug(name: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("model"))


def family(model_id: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(model_id, "^.*/", ""), ":.*$", "")


def clean(value: Column) -> Column:
    """Trimmed text; null if empty or a placeholder."""
    low = F.lower(F.trim(value))
    return F.when((low != "") & ~low.isin(*PLACEHOLDERS), F.trim(value))


def number(value: Column) -> Column:
    """The number that a value such as ``25 mm`` or ``1/2 in`` starts with; null for other text."""
    # an empty text isn't cast: each failure would be an exception inside
    part = lambda pattern, group: F.nullif(F.regexp_extract(value, pattern, group), F.lit("")).try_cast("double")
    over = F.when(F.contains(value, F.lit("/")), F.try_divide(part(FRACTION, 1), part(FRACTION, 2)))
    return F.coalesce(part(NUMBER_UNIT, 1), over)


def raw_unit(value: Column) -> Column:
    """The unit after the number, as written; null without one."""
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(value, NUMBER_UNIT, 2), F.lit("")), F.trim(F.regexp_extract(value, FRACTION, 3))), F.lit(""))


def unit(raw: Column) -> Column:
    """The canonical unit."""
    known = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(raw))), F.trim(raw))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of the fields as strings, keys in order, those without a value left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), fields[k].cast("string").alias("value")) for k in sorted(fields)])
    return F.to_json(F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


def inline_payload(payload: Column, *, cap: int = 8192, preview: int = 200) -> Column:
    """A payload of more than ``cap`` bytes as a struct with its size and the first ``preview`` characters; others as they are."""
    size = F.octet_length(payload)
    cut = F.struct(
        F.lit(True).alias("truncated"), size.alias("original_size"), F.concat(F.substring(payload, 1, preview), F.lit("... [TRUNCATED]")).alias("preview"), F.lit("Payload exceeded maximum inline size.").alias("message")
    )
    return F.when(size > cap, F.to_json(cut)).otherwise(payload)


# What names the axis of a limit.
LIMIT_AXES = {"tpm": "tpm|tokens per minute", "tpd": "tpd|tokens per day", "rpm": "rpm|requests per minute", "rpd": "rpd|requests per day"}


def limit_axis(error: Column) -> Column:
    return F.coalesce(*[F.when(error.rlike(f"(?i){p}"), axis) for axis, p in LIMIT_AXES.items()])


def limit_number(error: Column) -> Column:
    """The number that follows the word limit; null without one."""
    return F.replace(F.regexp_extract(error, r"(?i)\blimit[:\s]+([0-9,]+)", 1), F.lit(","), F.lit("")).try_cast("long")
