"""Text column functions: names, titles, redaction, codes, escapes, intents."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from coordspark.functions import js
from coordspark.functions.js import col


def nice_type(c: Column | str) -> Column:
    """'IfcPipeSegment' -> 'Pipe Segment'; nothing left -> 'Element'."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), "(?i)^Ifc", ""), "([a-z])([A-Z])", "$1 $2")
    return F.when(plain == "", "Element").otherwise(plain)


def clash_title(type_a: Column | str, type_b: Column | str, same_model: Column) -> Column:
    return title_of(nice_type(type_a), nice_type(type_b), same_model)


def title_of(nice_a: Column | str, nice_b: Column | str, same_model: Column) -> Column:
    """``clash_title`` of types that are nice already, as where they are made once an element, not once a pair."""
    a, b = col(nice_a), col(nice_b)
    return F.concat(a, F.when(a == b, " vs ").otherwise(" × "), b, F.when(same_model, " (self)").otherwise(""))


def clash_description(type_a, name_a, model_a, type_b, name_b, model_b) -> Column:
    shown = lambda c: F.coalesce(col(c).cast("string"), F.lit("null"))
    side = lambda kind, name, model: (shown(kind), F.lit(": "), shown(name), F.lit(" ("), shown(model), F.lit(")"))
    return F.concat(*side(type_a, name_a, model_a), F.lit(" vs "), *side(type_b, name_b, model_b))


def distance_mm(kind: Column | str, metres: Column | str) -> Column:
    """Hard and duplicate: signed penetration in mm, or -1 for a surface contact; else the rounded clearance."""
    d = F.coalesce(col(metres), F.lit(0.0))
    return F.when(col(kind).isin("hard", "duplicate"), F.when(d < 0, js.round_half_up(d * 1000)).otherwise(-1)).otherwise(js.round_half_up(F.abs(d) * 1000))


def elevation(y: Column | str) -> Column:
    return js.round_half_up(y, 3)


def normal_type(kind: Column | str) -> Column:
    return F.when(col(kind) == "clearance", "soft").otherwise(col(kind))


def type_pair(a: Column | str, b: Column | str, sep: str = ":") -> Column:
    return F.concat_ws(sep, F.least(col(a), col(b)), F.greatest(col(a), col(b)))


# What is redacted, in this order.
REDACTIONS = (
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[email]"),
    (r"[A-Za-z]:\\[^\s]+", "[path]"),
    (r"/[^\s]*/[^\s]+", "[path]"),
    (r"(?i)\S+\.(?:ifc|rvt|nwc|nwd|dwg|dxf|pdf|xlsx?|csv|json)\b", "[file]"),
    (r'"[^"]{20,}"', '"[redacted]"'),
    (r"'[^']{20,}'", "'[redacted]'"),
)
NOTE_REDACTIONS = ((r"[A-Z]{2,}[-_]\d{2,}[A-Za-z0-9_-]*", "[id]"), REDACTIONS[0], REDACTIONS[1])


def redact(c: Column | str, model_names: list[str] = ()) -> Column:
    """Model names become MODEL_A, MODEL_B .. in order, then the fixed patterns go."""
    out = col(c)
    for i, name in enumerate(n for n in model_names if n):
        out = F.regexp_replace(out, "(?i)" + re.escape(name), f"MODEL_{chr(65 + i)}")
    for pattern, to in REDACTIONS:
        out = F.regexp_replace(out, pattern, to)
    return out


def redact_note(c: Column | str) -> Column:
    out = F.coalesce(col(c), F.lit(""))
    for pattern, to in NOTE_REDACTIONS:
        out = F.regexp_replace(out, pattern, to)
    return out


# Profile and element words that survive the reduction of a type name.
PROFILE_WORDS = "HEA|HEB|HEM|IPE|UNP|UPE|CHS|RHS|SHS|THQ|INP|pipe|duct|cable|tray|beam|column|wall|slab|plate"


def reduce_type(c: Column | str) -> Column:
    """Profile words, then dimensions like 200x100; null if neither is there."""
    words = F.regexp_extract_all(col(c), F.lit(rf"(?i)\b({PROFILE_WORDS})\b"), F.lit(1))
    sizes = F.regexp_extract_all(col(c), F.lit(r"(\d+x\d+(?:[x-]\d+)*)"), F.lit(1))
    return F.nullif(F.array_join(F.concat(words, sizes), " "), F.lit(""))


def xml_escape(c: Column | str) -> Column:
    out = F.coalesce(col(c).cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def measure_label(metres: Column | str) -> Column:
    """Under a metre in mm without decimals, else in m with two."""
    m = col(metres)
    return F.when(m < 1, F.format_string("%.0f mm", m * 1000)).otherwise(F.format_string("%.2f m", m))


def section_position(value: Column | str) -> Column:
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), col(value)))


def pixels_per_metre(scale: Column | str) -> Column:
    """'1:50' -> 200; the part after the colon counts."""
    n = js.parse_float(F.element_at(F.split(col(scale), ":"), -1))
    return js.round_half_up(10000 / n)


def word_count(c: Column | str) -> Column:
    text = js.trim(c)
    return F.when(F.length(text) > 0, F.size(F.split(text, r"(?U)\s+"))).otherwise(0)


# Words that route a command to the thorough model, or mark it as a question.
THOROUGH = (
    r"(?i)\b(analy[sz]e|summar[iy]|explain|why|describe|breakdown|report|insight|interpret|compare|review|critique|recommend|suggest|root[\s-]?cause|impact)\b"
)
# Fixed value: what makes a command a question, whole.
QUESTION = r"(?i)\b(what\s+is|what\s+are|what\s+does|how\s+do|how\s+does|how\s+can|can\s+i|explain|tell\s+me|describe|difference\s+between|why|when\s+should|is\s+this|is\s+it|what\s+(?:does|is|can)|help\s+me\s+understand|what\s+(?:does|'s)\s+the|what\s+(?:the\s+)?(?:semantic|bcf|ifc|ids)|how\s+(?:to|do\s+i)|can\s+(?:i|we|you)|is\s+(?:there|it|this)|what's)\b"


def route(c: Column | str) -> Column:
    return F.when(col(c).rlike(THOROUGH), "smart").otherwise("fast")


def is_question(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(QUESTION), F.lit(False))


def length_mm(c: Column | str) -> Column:
    """The first length of a text in millimetres: mm (also without a unit), cm, m, inch, ft."""
    number = F.regexp_extract(col(c), r"(?i)(\d+(?:\.\d+)?)\s*(mm|cm|m|inch|in|ft|foot|feet)?\b", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(col(c), r"(?i)(\d+(?:\.\d+)?)\s*(mm|cm|m|inch|in|ft|foot|feet)?\b", 2))
    return number * F.when(unit == "cm", 10.0).when(unit == "m", 1000.0).when(unit.isin("in", "inch"), 25.4).when(unit.isin("ft", "foot", "feet"), 304.8).otherwise(1.0)


def json_array_in(c: Column | str) -> Column:
    """The outermost [..] of a text, if it parses as JSON."""
    body = F.nullif(F.regexp_extract(col(c), r"(?s)(\[.*\])", 1), F.lit(""))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def severity(type_a: Column | str, type_b: Column | str, kind: Column | str, depth_mm: Column | str) -> Column:
    """Openings and spaces are false positives whatever else holds; then by kind and depth."""
    exempt = col(type_a).isin("IfcOpeningElement", "IfcSpace") | col(type_b).isin("IfcOpeningElement", "IfcSpace")
    return F.when(F.coalesce(exempt, F.lit(False)), "false_positive").when(col(kind) != "hard", "minor").when(col(depth_mm) >= 100, "critical").when(col(depth_mm) >= 20, "major").otherwise("minor")


def version_key(c: Column | str) -> Column:
    """'v1.10.2' -> [1, 10, 2]; compares as versions do."""
    return F.transform(F.split(F.regexp_replace(col(c), "^v", ""), r"\."), lambda x: F.coalesce(js.parse_float(x).cast("int"), F.lit(0)))


def same_protocol(a: Column | str, b: Column | str) -> Column:
    """'ok', 'minor' or 'major' by the first two numbers of two versions."""
    x, y = version_key(a), version_key(b)
    return F.when(F.get(x, F.lit(0)) != F.get(y, F.lit(0)), "major").when(F.get(x, F.lit(1)) != F.get(y, F.lit(1)), "minor").otherwise("ok")


def project_key(name: Column | str, seed: Column | str) -> Column:
    """Up to four characters of the name and six that follow from the seed."""
    prefix = F.upper(F.substring(F.regexp_replace(F.coalesce(col(name), F.lit("CC")), "[^a-zA-Z0-9]", ""), 1, 4))
    return F.concat(prefix, F.lit("-"), F.translate(F.substring(F.sha2(col(seed).cast("string"), 256), 1, 6), "01", "gh"))


def unit_ratio(unit: Column | str) -> Column:
    """Factor to metres of a length unit."""
    return F.when(col(unit) == "mm", 0.001).when(col(unit) == "cm", 0.01).when(col(unit).isin("ft", "foot"), 0.3048).otherwise(1.0)
