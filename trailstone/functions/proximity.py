"""Words, levels, messages and styles of proximity warnings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Vector

#: Distances up to which a level holds (inclusive), dead zone of the direction words.
CRITICAL, STRONG, CAUTION, DEAD_ZONE = 0.2, 0.4, 0.6, 0.1
#: Number, red, green, blue, marker radius and line width of each level.
STYLES = {
    "critical": (3, 255, 0, 0, 0.055, 0.008),
    "strong": (2, 255, 165, 0, 0.045, 0.008),
    "caution": (1, 255, 255, 0, 0.035, 0.0),
    "normal": (0, 0, 255, 0, 0.025, 0.0),
}
#: What a message of a level begins with.
PREFIXES = {"critical": "🚨 CRITICAL: ", "strong": "⚠️ WARNING: ", "caution": "⚠️ CAUTION: "}


def rounded(number: Column, digits: int) -> Column:
    """The product with 10^digits, rounded half up, and divided again: 0.575 * 100 is less than 57.5, so it gives 0.57.

    Spark's own round takes the number's decimal form, so it would give 0.58; SQL engines and numpy work as this does.
    """
    return F.round(number * 10.0**digits, 0) / 10.0**digits


def warning_level(distance: Column, critical: float = CRITICAL, strong: float = STRONG, caution: float = CAUTION) -> Column:
    return F.when(distance <= critical, "critical").when(distance <= strong, "strong").when(distance <= caution, "caution").when(distance.isNotNull(), "normal")


def level_number(level: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, style in STYLES.items():
        out = F.when(level == name, style[0]).otherwise(out)
    return out


def level_style(level: Column) -> Column:
    """Struct of number, colour, radius and line width."""
    parts = []
    for k, (name, kind) in enumerate((("level_num", "int"), ("r", "int"), ("g", "int"), ("b", "int"), ("radius", "double"), ("line_width", "double"))):
        out = F.lit(None).cast(kind)
        for level_name, style in STYLES.items():
            out = F.when(level == level_name, F.lit(style[k]).cast(kind)).otherwise(out)
        parts.append(out.alias(name))
    return F.struct(*parts)


def direction_phrase(v: Vector, dead_zone: float = DEAD_ZONE) -> Column:
    """Words for a camera-space offset: ahead/behind, then right/left, then below/above (+y is below)."""
    x, y, z = v

    def word(c: Column, plus: str, minus: str) -> Column:
        return F.when(c > dead_zone, plus).when(c < -dead_zone, minus)

    parts = F.array_compact(F.array(word(z, "ahead", "behind"), word(x, "right", "left"), word(y, "below", "above")))
    return F.when(F.size(parts) == 0, "directly in front").when(F.size(parts) == 1, F.concat(F.lit("to your "), parts[0])).otherwise(F.concat_ws("-", parts))


def warning_message(distance: Column, level: Column, label: Column, segment: Column, direction: Column, objects: bool = True, enabled: bool = True) -> Column:
    """Text of a record: objects name their label and segment, points don't; direction may be null.

    Segments that are null or negative are not named. Numbers are rounded half up.
    """
    known = label.isNotNull() & (label != "unknown")
    segmented = F.coalesce(segment >= 0, F.lit(False))
    number = F.concat(F.lit(" #"), segment.cast("string"))
    if not enabled:
        named = F.when(known, F.concat(label, number)).otherwise(F.concat(F.lit("Segment "), segment.cast("string")))
        plain = F.format_string("Distance: %.3fm", rounded(distance, 3))
        return F.when(segmented, F.concat(plain, F.lit(" ("), named, F.lit(")"))).otherwise(plain)
    metres = F.format_string("%.2fm", rounded(distance, 2))
    name = F.when(segmented & known, F.concat(label, number)).when(segmented, F.concat(F.lit("Object"), number)).otherwise("Object") if objects else F.lit("Point")
    prefix = F.lit("")
    for k, v in PREFIXES.items():
        prefix = F.when(level == k, v).otherwise(prefix)
    pointed = direction.isNotNull() & (direction != "")
    where = F.when(pointed, F.concat(F.lit(" "), metres, F.lit(" "), direction)).otherwise(F.concat(F.lit(" at "), metres))
    alert = F.concat(prefix, name, where, F.when(level == "critical", "!").otherwise(""))
    calm = F.concat(F.lit("Distance: "), metres, F.when(pointed, F.concat(F.lit(" ("), direction, F.lit(")"))).otherwise(""), F.when(segmented, F.concat(F.lit(" - "), name)).otherwise(""))
    return F.when(level == "normal", calm).otherwise(alert)


def duration_text(seconds: Column) -> Column:
    """Hours, minutes and seconds, as many of them as needed."""
    h, m, s = F.floor(seconds / 3600).cast("int"), F.floor((seconds % 3600) / 60).cast("int"), seconds % 60
    return F.when(seconds >= 3600, F.format_string("%dh %dm %.2fs", h, m, s)).when(seconds >= 60, F.format_string("%dm %.2fs", m, s)).otherwise(F.format_string("%.2fs", s))


def run_stamp(ts: Column) -> Column:
    """A time as it names a run's folder."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso_format(ts: Column) -> Column:
    """A time without zone in ISO form; microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
