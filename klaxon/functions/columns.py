"""Scalar rules as Column expressions: all JVM-side, all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
# Feed alert type -> event type.
EVENT_TYPES = {
    "air_raid": "AIR_RAID",
    "artillery_shelling": "ARTILLERY",
    "artillery": "ARTILLERY",
    "urban_fights": "URBAN_FIGHTS",
    "chemical": "CHEMICAL_RISK",
    "nuclear": "RADIATION_RISK",
}
DEFAULT_EVENT_TYPE = "AIR_RAID"
CRITICAL_TYPES = ("AIR_RAID", "ARTILLERY", "RADIATION_RISK")
WARNING_TYPES = ("CHEMICAL_RISK", "URBAN_FIGHTS")
SEVERITY_WEIGHTS = {"CRITICAL": 3, "WARNING": 2, "INFO": 1}
NTFY_PRIORITIES = {"CRITICAL": "urgent", "WARNING": "high", "HIGH": "high", "LOW": "low"}
UNKNOWN_REGION = "UNKNOWN_REGION"
REGION_SUFFIX = "_REGION"
SLUG_SEPARATORS = "[^A-Z0-9А-ЯІЇЄҐ]+"
REGION_ID_PATTERN = r"\A[A-Z0-9_]+\z"
# What counts as white space in a title; no-break spaces do not.
BLANK_PATTERN = r"\A[\x09-\x0D\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]*\z"
MASK_LENGTH = 35
# ----------------------------------------------------------------------------------

_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Cut every character up to U+0020 from both ends (``trim`` cuts spaces only)."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")


def is_blank(c: Column | str) -> Column:
    """True for null and for text of white space only; never null itself."""
    c = _col(c)
    return c.isNull() | c.rlike(BLANK_PATTERN)


def clean_title(c: Column | str) -> Column:
    """The lookup form of a location title."""
    return F.lower(trimmed(c))


def region_slug(c: Column | str) -> Column:
    """The region id given to a title no mapping knows."""
    slug = F.regexp_replace(F.upper(trimmed(c)), SLUG_SEPARATORS, "_")
    slug = F.regexp_replace(slug, "^_+|_+$", "")
    return F.when(slug.endswith(REGION_SUFFIX), slug).otherwise(F.concat(slug, F.lit(REGION_SUFFIX)))


def event_type(c: Column | str) -> Column:
    c = _col(c)
    known = F.when(is_blank(c), F.lit(DEFAULT_EVENT_TYPE))
    for raw, name in EVENT_TYPES.items():
        known = known.when(F.lower(c) == raw, F.lit(name))
    return known.otherwise(F.replace(F.upper(c), F.lit(" "), F.lit("_")))


def severity_of_type(c: Column | str) -> Column:
    c = _col(c)
    return (
        F.when(c.isin(*CRITICAL_TYPES), F.lit("CRITICAL"))
        .when(c.isin(*WARNING_TYPES), F.lit("WARNING"))
        .otherwise(F.lit("INFO"))
    )


def severity_weight(c: Column | str) -> Column:
    upper = F.upper(_col(c))
    ladder = F.when(upper == "CRITICAL", F.lit(SEVERITY_WEIGHTS["CRITICAL"]))
    for name in ("WARNING", "INFO"):
        ladder = ladder.when(upper == name, F.lit(SEVERITY_WEIGHTS[name]))
    return ladder.otherwise(F.lit(0))


def severity_sufficient(severity: Column | str, minimum: Column | str) -> Column:
    """A null or blank minimum lets everything pass; an unknown one weighs nothing."""
    return is_blank(minimum) | (severity_weight(severity) >= severity_weight(minimum))


def parse_instant(c: Column | str, as_of: Column) -> Column:
    """A full ISO-8601 instant, else `as_of`.  A date or a time without seconds is none."""
    c = F.upper(_col(c))
    parsed = F.when(c.rlike(_INSTANT), F.try_to_timestamp(c))
    return F.coalesce(parsed, as_of)


def epoch_ms(c: Column | str) -> Column:
    return F.unix_millis(_col(c))


def instant_text(c: Column | str) -> Column:
    """UTC with exactly three fraction digits, cut, not rounded."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _shown(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit("null"))


def alert_message(region: Column | str, kind: Column | str, severity: Column | str) -> Column:
    # concat, not format_string: it is compiled, and this runs once per alert.
    return F.concat(F.lit("Alert in "), _shown(region), F.lit(": "), _shown(kind), F.lit(" ["), _shown(severity), F.lit("]"))


def spike_description(region: Column | str, count: Column | str, window_seconds: int, threshold: int) -> Column:
    return F.concat(
        F.lit("Rapid-fire alert spike detected in "),
        _shown(region),
        F.lit(": "),
        _col(count).cast("string"),
        F.lit(f" events within {window_seconds} seconds (threshold: {threshold})"),
    )


def anomaly_message(region: Column | str, description: Column | str, detected_at: Column | str) -> Column:
    return F.concat(
        F.lit("CRITICAL SPIKE ALERT in "),
        _shown(region),
        F.lit(": "),
        _shown(description),
        F.lit(" (Detected: "),
        F.coalesce(instant_text(detected_at), F.lit("null")),
        F.lit(")"),
    )


def ntfy_priority(c: Column | str) -> Column:
    upper = F.upper(_col(c))
    ladder = F.when(upper == "CRITICAL", F.lit(NTFY_PRIORITIES["CRITICAL"]))
    for name in ("WARNING", "HIGH", "LOW"):
        ladder = ladder.when(upper == name, F.lit(NTFY_PRIORITIES[name]))
    return ladder.otherwise(F.lit("default"))


def alert_title(region: Column | str) -> Column:
    return F.concat(F.lit("Alert: "), F.coalesce(_col(region), F.lit("National")))


def masked(c: Column | str) -> Column:
    """What a log or report may show of an address."""
    c = _col(c)
    return F.when(c.isNull() | (F.length(c) <= MASK_LENGTH), F.lit("***")).otherwise(
        F.concat(F.substring(c, 1, MASK_LENGTH), F.lit("..."))
    )


def content_id(*parts: Column | str) -> Column:
    """A stable id made of the given values; null and empty text stay apart."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(_col(p).cast("string"), F.lit("\\N")) for p in parts]), 256)


def content_key(*parts: Column | str) -> Column:
    """A stable positive 60-bit surrogate key, in place of a database identity."""
    return F.conv(F.substring(content_id(*parts), 1, 15), 16, 10).cast("long")
