"""Canonical field values from (value string, its type) pairs, as one CASE over the field.

``value_type`` is ``string``, ``number``, ``boolean`` or ``list``; values travel as strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C
from .text import strip

OTHER = "Autre"


def to_number(v: Column, kind: Column) -> Column:
    """Numbers as they are, true as 1, of strings the first signed number."""
    text = F.replace(strip(v), F.lit(","), F.lit("."))
    return F.when(kind == "number", v.cast("double")).when(kind == "boolean", F.when(F.lower(v) == "true", 1.0).otherwise(0.0)).when(kind == "string", F.nullif(F.regexp_extract(text, r"[-+]?\d*\.?\d+", 0), F.lit("")).cast("double"))


def to_boolean(v: Column) -> Column:
    low = F.lower(strip(v))
    return F.when(low.isin("true", "yes", "oui", "1", "vrai"), True).when(low.isin("false", "no", "non", "0", "faux"), False)


def _contained(low: Column, options: list[str], default: Column) -> Column:
    """The first option that a lower-cased value contains."""
    out = default
    for o in reversed(options):
        out = F.when(F.contains(low, F.lit(o.lower())), F.lit(o)).otherwise(out)
    return out


def _other(rest: Column) -> Column:
    """What was after ``Autre:`` is kept."""
    return F.when(F.coalesce(rest, F.lit("")) != "", F.concat(F.lit(f"{OTHER}: "), rest)).otherwise(F.lit(OTHER))


def normalize(field: Column, v: Column, kind: Column) -> Column:
    """The canonical value as a string, or null."""
    s = strip(v)
    marked = s.rlike(r"^[Aa]utre\s*:")
    rest = F.when(marked, strip(F.substring_index(F.regexp_replace(s, r"^[Aa]utre\s*:", "\u0001"), "\u0001", -1)))
    value = F.when(marked, F.lit(OTHER)).otherwise(s)
    low = F.lower(value)
    other = _other(rest)
    aliases = F.lit(OTHER)
    for word, target in reversed(C.TYPE_ALIASES):
        aliases = F.when(F.contains(low, F.lit(word)), F.lit(target)).otherwise(aliases)
    upper = F.upper(value)
    code = F.lit(OTHER)
    for c in reversed(C.all_codes()):
        code = F.when(F.contains(upper, F.lit(c)), F.lit(c)).otherwise(code)
    code = F.when(upper.isin(C.all_codes()), upper).otherwise(code)
    flat = F.lower(F.replace(F.replace(F.replace(F.replace(value, F.lit(" "), F.lit("")), F.lit("..."), F.lit("-")), F.lit("…"), F.lit("-")), F.lit(","), F.lit(".")))
    signal = _contained(flat, C.SIGNALS, other)
    for o in reversed(C.SIGNALS):
        signal = F.when(flat == o.lower(), F.lit(o)).otherwise(signal)
    has = lambda *words: F.lit(True) if not words else _all(low, words)
    supply = (
        F.when(has("loop") | has("boucle") | has("2 fils") | has("2-wire") | has("2wire"), "boucle")
        .when(has("24", "dc"), "24VDC").when(has("24", "ac"), "24VAC").when(has("12", "30"), "12-30VDC").when(has("85", "264"), "85-264VAC").when(has("220"), "220VAC")
        .otherwise(_contained(low, C.SUPPLIES, other))
    )
    denied = has("non") | has("aucun") | has("none") | has("no ") | has("pas de")
    protocol = F.when(denied, "non").otherwise(_contained(low, C.PROTOCOLS, other))
    brand = F.when(F.coalesce(rest, F.lit("")) != "", F.concat(F.lit(f"{OTHER}: "), rest)).otherwise(value)
    for o in reversed(C.BRANDS):
        hit = has("emerson") | has("rosemount") if o == "Emerson (Rosemount)" else has(o.lower())
        brand = F.when(hit, F.lit(o)).otherwise(brand)
    ip = F.upper(F.regexp_extract(value, r"(?i)IP\s*(\d{2,3}[A-Z]?)", 1))
    nema = F.upper(F.regexp_extract(value, r"(?iU)NEMA\s*(\w+)", 1))
    protection = F.when(ip != "", F.concat(F.lit("IP"), ip)).when(nema != "", F.concat(F.lit("NEMA"), nema)).otherwise(value)
    wires = F.when(kind == "number", v.cast("double").cast("int").cast("string")).when(kind == "string", F.coalesce(F.nullif(F.regexp_extract(s, r"(?U)\b([2-5])\b", 1), F.lit("")), v)).otherwise(v)
    unit = F.when((kind == "string") & ~s.rlike(r"^[-+]?\d[\d,. ]*$") & ~s.rlike(r"^[Aa]utre\s*:\s*[-\d.,\s]+$") & (s != ""), s)
    warmth = F.when((kind == "string") & s.rlike(r"\d.*°[CcFfKk]|°[CcFfKk].*\d"), s)
    open_text = F.when(F.coalesce(rest, F.lit("")) != "", F.concat(F.lit(f"{OTHER}: "), rest)).otherwise(value)
    return (
        F.when(v.isNull(), None)
        .when(field.isin(C.NUMERIC_FIELDS), to_number(v, kind).cast("string"))
        .when(field.isin(C.BOOLEAN_FIELDS), to_boolean(v).cast("string"))
        .when(field == "nombreFils", wires)
        .when(field == "plageMesureUnite", unit)
        .when(field == "températureProcess", warmth)
        .when(kind != "string", v)
        .when(s == "", None)
        .when(field == "category", _contained(low, C.CATEGORIES, F.lit(OTHER)))
        .when(field == "typeMesure", aliases)
        .when(field == "code", code)
        .when(field == "technologie", _contained(low, C.all_technologies(), other))
        .when(field == "signalSortie", signal)
        .when(field == "alimentation", supply)
        .when(field == "communication", protocol)
        .when(field == "marque", brand)
        .when(field == "matériauMembrane", _contained(low, C.MEMBRANES, other))
        .when(field == "indiceIP", protection)
        .when(field == "typeActionneur", _contained(low, C.ACTUATOR_TYPES, F.lit(OTHER)))
        .when(field == "certificats", value)
        .otherwise(open_text)
    )


def _all(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(low, F.lit(w))
    return out


def check_sensor_category(category: Column, quote: Column, context: Column) -> Column:
    """Sensor phrases in the context give ``Capteurs``; the general system label next to a
    specific term gives null, for review.  Without a quote nothing changes."""
    low = F.lower(F.coalesce(context, F.lit("")))
    some = lambda terms: F.greatest(*[F.contains(low, F.lit(w)).cast("int") for w in terms]) == 1
    checked = F.when(some(C.SENSOR_PHRASES), F.lit("Capteurs")).when((category == "Système de mesure") & some(C.SENSOR_TERMS), None).otherwise(category)
    return F.when(category.isNull() | (F.coalesce(quote, F.lit("")) == ""), category).otherwise(checked)
