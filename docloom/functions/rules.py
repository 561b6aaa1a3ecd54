"""Ordered pattern tables as expressions, and the rule extractors built from them.

A table becomes one literal CASE, so that each pattern is compiled once and later ones are
not tried after a match.  Patterns are case-insensitive, with Unicode classes and word
boundaries, unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C
from .text import strip

FLAGS = "(?iU)"


def regex(pattern: str) -> str:
    return FLAGS + pattern


def any_of(c: Column, terms: Iterable[str]) -> Column:
    """Whether a lower-cased text holds one of the terms, in one pass."""
    return c.rlike("|".join(rf"\Q{t}\E" for t in terms))


def count_of(c: Column, terms: Iterable[str]) -> Column:
    """How many of the terms a lower-cased text holds; a repeated term counts again."""
    n = F.lit(0)
    for t in terms:
        n = n + F.contains(c, F.lit(t)).cast("int")
    return n


def gate(text: Column, patterns: Iterable[str]) -> Column:
    """Whether any of the patterns occurs: one pass instead of one a pattern."""
    return text.rlike(regex("|".join(f"(?-i:{p[5:]})" if p.startswith("(?-i)") else f"(?:{p})" for p in patterns)))


def first_match(text: Column, patterns: list[C.Pattern], tidy: bool = False) -> Column:
    """STRUCT(value, confidence, quote) of the first pattern that occurs, or null."""
    out = F.lit(None).cast("struct<value:string,confidence:double,quote:string>")
    for p in reversed(patterns):
        r = regex(p.pattern)
        value = F.lit(p.value) if p.value is not None else strip(F.regexp_extract(text, r, 1))
        if p.value is None and tidy:
            value = F.regexp_replace(value, r"\s+", " ")
        found = F.struct(value.alias("value"), F.lit(p.weight).alias("confidence"), strip(F.regexp_extract(text, r, 0)).alias("quote"))
        out = F.when(text.rlike(r), found).otherwise(out)
    return out


def guarded_match(text: Column, patterns: list[C.Pattern], negators: list[str], window: int = 50) -> Column:
    """``first_match`` whose first occurrence is not preceded by a negator within ``window`` characters."""
    out = F.lit(None).cast("struct<value:string,confidence:double,quote:string>")
    for p in reversed(patterns):
        r = regex(p.pattern)
        at = F.regexp_instr(text, F.lit(r))
        before = F.lower(F.substring(text, F.greatest(F.lit(1), at - window), F.least(F.lit(window), at - 1)))
        found = F.struct(F.lit(p.value).alias("value"), F.lit(p.weight).alias("confidence"), strip(F.regexp_extract(text, r, 0)).alias("quote"))
        out = F.when(text.rlike(r) & ~any_of(before, negators), found).otherwise(out)
    return out


def looks_like_reference(v: Column) -> Column:
    s = strip(v)
    return (F.length(s) >= 5) & s.rlike(r"\p{Nd}") & s.rlike(r"\p{L}")


def is_plc_datasheet(text: Column) -> Column:
    return any_of(F.lower(text), C.PLC_TERMS)


def reference(text: Column) -> Column:
    """The first order number that looks like one."""
    out = F.lit(None).cast("struct<value:string,confidence:double,quote:string>")
    for p in reversed(C.REGEX_REFERENCES):
        r = regex(p.pattern)
        value = strip(F.regexp_replace(F.regexp_replace(strip(F.regexp_extract(text, r, 1)), r"\s+", " "), r"(?iU)\s+(?:page|p\.|seite)\s*\d+\b", ""))
        found = F.struct(value.alias("value"), F.lit(p.weight).alias("confidence"), strip(F.regexp_extract(text, r, 0)).alias("quote"))
        out = F.when(text.rlike(r) & looks_like_reference(value), found).otherwise(out)
    return out


def first_of_many(text: Column, patterns: list[C.Pattern], groups: list[str] | None = None, own: Column | None = None) -> Column:
    """``first_match`` (tidied) of a long table, as one array instead of a branch a pattern:
    one pass tells whether any occurs, and only then each is tried.  With ``groups``, those
    of the group whose name begins ``own`` come before the others."""
    rows = [F.struct(F.lit(regex(p.pattern)).alias("r"), F.lit(p.value).cast("string").alias("v"), F.lit(p.weight).alias("w"), F.lit((groups or [""] * len(patterns))[i].lower()).alias("g"), F.lit(i).alias("i")) for i, p in enumerate(patterns)]
    hits = F.filter(F.array(*rows), lambda x: F.rlike(text, x["r"]))
    if own is not None:
        first = lambda x: ~F.coalesce(F.startswith(F.lower(own), x["g"]), F.lit(False))
        hits = F.array_sort(F.transform(hits, lambda x: F.struct(first(x).alias("far"), x["i"].alias("i"), x["r"].alias("r"), x["v"].alias("v"), x["w"].alias("w"))))
    best = F.get(F.when(gate(text, [p.pattern for p in patterns]), hits), F.lit(0))
    part = lambda k: strip(F.call_function("regexp_extract", text, best["r"], F.lit(k)))
    value = F.coalesce(best["v"], F.regexp_replace(part(1), r"\s+", " ")) if any(p.value is None for p in patterns) else best["v"]
    return F.when(best.isNotNull(), F.struct(value.alias("value"), best["w"].alias("confidence"), part(0).alias("quote")))


def brand(text: Column) -> Column:
    """The first known maker, as a whole word."""
    return first_of_many(text, [C.Pattern(rf"(?<!\w)\Q{b}\E(?!\w)", b) for b in C.REGEX_BRANDS])


def model(text: Column, known: Column) -> Column:
    """The first model pattern, those of the known maker (whose name may be longer) before
    the others; else what a label names."""
    table = [(maker, C.Pattern(p, None)) for maker, own in C.REGEX_MODELS.items() for p in own]
    found = first_of_many(text, [p for _, p in table], [m for m, _ in table], known)
    return F.coalesce(found, first_match(text, [C.Pattern(C.MODEL_LABEL, None, 0.75)], tidy=True))


def panel(text: Column) -> Column:
    """The panel that stands beside a maker's order number."""
    m = first_match(text, [C.Pattern(f"({C.PANEL_MODEL})", None, 0.9)])
    return F.when(m.isNotNull(), m.withField("value", F.concat(F.lit("SIMATIC HMI "), m["value"])))


def protection(text: Column) -> Column:
    """The first protection class, without spaces, in capitals."""
    m = first_match(text, C.REGEX_PROTECTIONS)
    return F.when(m.isNotNull(), m.withField("value", F.upper(F.regexp_replace(m["value"], r"\s+", ""))))


def category(text: Column) -> Column:
    """What a label names, else transmitter where words suggest it."""
    low = F.lower(text)
    word = F.when(F.contains(low, F.lit("transmitter")), F.lit("transmitter")).when(F.contains(low, F.lit("transmetteur")), F.lit("transmetteur"))
    guess = F.when(word.isNotNull() & any_of(low, C.CATEGORY_WORDS), F.struct(F.lit("Transmetteur").alias("value"), F.lit(0.8).alias("confidence"), word.alias("quote")))
    return F.coalesce(first_match(text, [C.Pattern(C.CATEGORY_LABEL, None, 1.0)], tidy=True), guess)


def measuring_range(text: Column) -> Column:
    """STRUCT(min, max, unit) of the first range whose 200 characters before it speak of a
    range and whose minimum is below its maximum; null if a ratio follows such a word.

    The text is cut before each range; a fold over the pieces carries the last 200
    characters, so that work grows with the text alone.
    """
    r = regex(C.RANGE_PATTERN)
    ratio = text.rlike("(?isU)" + C.RANGE_RATIO)
    pieces = F.split(text, regex(rf"(?=(?<![\d.,]){C.RANGE_PATTERN})"))
    none = F.lit(None).cast("struct<min:double,max:double,unit:string>")

    def step(seen: Column, piece: Column) -> Column:
        low, high = (F.replace(F.regexp_extract(piece, r, k), F.lit(","), F.lit(".")).cast("double") for k in (1, 2))
        good = any_of(F.lower(seen["tail"]), C.RANGE_CONTEXT) & (low < high)
        here = F.when(good, F.struct(low.alias("min"), high.alias("max"), F.regexp_extract(piece, r, 3).alias("unit")))
        return F.struct(F.right(F.concat(seen["tail"], piece), F.lit(200)).alias("tail"), F.coalesce(seen["found"], here).alias("found"))

    found = F.aggregate(pieces, F.struct(F.lit("").alias("tail"), none.alias("found")), step, lambda seen: seen["found"])
    return F.when(text.rlike(r) & ~ratio, found)


def tag_code(text: Column) -> Column:
    """A loop tag in capitals gives its code."""
    codes = "|".join(c for t in ("Débit", "Niveau", "Pression", "Température") for c in C.TYPE_CODES[t]) + "|AT|AI"
    return F.nullif(F.regexp_extract(text, rf"(?U)\b({codes})\s*[-_]?\s*\d+", 1), F.lit(""))


def ascii_tag() -> str:
    """The pattern of loop tags where words, spaces and digits are those of ASCII, so that a
    word begins after an accented letter: "chéai 44" holds AI.

    All is spelt out, as Java's ``\\b`` knows other letters even without flags, its ``\\s`` has
    the vertical tab, and its case folding joins i with the Turkish ones; s folds with the
    long s, k with the Kelvin sign.  Codes are grouped by their first letter, which is looked
    at before the edge of the word.
    """
    word, space, folds = "[0-9A-Za-z_]", r"[\t\n\f\r ]*+", {"S": "ſ", "K": "\u212a"}
    cases = lambda c: c + c.lower() + folds.get(c, "") if c.isalpha() else c
    rest: dict[str, list[str]] = {}
    for code in (c.upper() for own in C.TYPE_CODES.values() for c in own):
        rest.setdefault(cases(code[0]), []).append("".join(f"[{cases(c)}]" for c in code[1:]))
    edge = f"(?=[{''.join(rest)}])(?:(?<!{word})(?={word})|(?<={word})(?!{word}))"
    codes = "|".join(f"[{first}](?:{'|'.join(own)})" for first, own in rest.items())
    return f"{edge}({codes}){space}(?:[-_]{space})?[0-9]"


def tag_info(text: Column, pattern: str | None = None) -> Column:
    """STRUCT(code, type, category) of the first loop tag, in any case, so that "at 4" counts.

    Words, spaces and digits are those of Unicode, unless another ``pattern`` is given, whose
    first group is the code."""
    codes = "|".join(c for own in C.TYPE_CODES.values() for c in own)
    code = F.upper(F.regexp_extract(text, pattern or rf"(?iU)\b({codes})\s*[-_]?\s*\d+", 1))
    letter = F.left(code, F.lit(1))
    kind = F.lit(None).cast("string")
    for k, v in C.LETTER_TYPE.items():
        kind = F.when(letter == k, v).otherwise(kind)
    side = F.when(letter.isin(C.ACTUATOR_LETTERS), C.CATEGORIES[1]).otherwise(C.CATEGORIES[0])
    return F.when(code != "", F.struct(code.alias("code"), kind.alias("type"), side.alias("category")))


def classify_code(text: Column, kind: Column) -> Column:
    """Tag code (1.0), else the code of the quantity (0.9)."""
    tag, usual = tag_code(text), F.lit(None).cast("string")
    for t in C.LETTER_TYPE.values():
        usual = F.when(kind == t, C.TYPE_CODES[t][0]).otherwise(usual)
    return F.when(tag.isNotNull(), F.struct(tag.alias("value"), F.lit(1.0).alias("confidence"))).when(usual.isNotNull(), F.struct(usual.alias("value"), F.lit(0.9).alias("confidence")))


def classify_brand(text: Column) -> Column:
    """Brand in the first 500 and last 200 characters (1.0), else anywhere (0.9)."""
    near = first_match(F.concat(F.left(text, F.lit(500)), F.right(text, F.lit(200))), C.CLASSIFIER_BRANDS)
    far = first_match(text, C.CLASSIFIER_BRANDS)
    return F.coalesce(near, F.when(far.isNotNull(), far.withField("confidence", F.lit(0.9))))


def classify_protection(text: Column) -> Column:
    """All IP classes from 65, sorted and joined by ``/`` (0.95); else NEMA (0.9)."""
    hits = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)IP\s*(6[5-9]|[7-9]\d)\b"), 1), lambda h: F.concat(F.lit("IP"), h))))
    nema = F.upper(F.regexp_extract(text, r"(?iU)NEMA\s*(\w+)", 1))
    return F.when(F.size(hits) > 0, F.struct(F.array_join(hits, "/").alias("value"), F.lit(0.95).alias("confidence"))).when(nema != "", F.struct(F.concat(F.lit("NEMA"), nema).alias("value"), F.lit(0.9).alias("confidence")))


def classify_certificates(text: Column) -> Column:
    """Certificates in table order; an empty list is a result of its own."""
    found = F.filter(F.array(*[F.when(text.rlike(regex(p.pattern)), F.lit(p.value)) for p in C.CLASSIFIER_CERTIFICATES]), lambda x: x.isNotNull())
    return F.array_distinct(found)


def classify_hart(text: Column) -> Column:
    return F.when(text.rlike(r"(?U)\bHART\b"), F.lit(True))


def document_kind(text: Column) -> Column:
    """STRUCT(doc_type, confidence): panel or instrument by how many of their terms occur."""
    low = F.lower(F.coalesce(text, F.lit("")))
    panel, instrument = count_of(low, C.HMI_TERMS), count_of(low, C.INSTRUMENT_TERMS)
    conf = lambda s: F.least(F.lit(1.0), 0.25 + s / 20.0)
    make = lambda name, c: F.struct(F.lit(name).alias("doc_type"), c.alias("confidence"))
    return F.when(panel >= F.greatest(F.lit(3), instrument + 2), make("hmi", conf(panel))).when(instrument >= F.greatest(F.lit(3), panel + 2), make("instrument", conf(instrument))).otherwise(make("unknown", F.lit(0.2)))


def route_category(text: Column) -> Column:
    """Category by tag, else by term counts, else transmitter."""
    low = F.lower(F.coalesce(text, F.lit("")))
    actuator, transmitter = count_of(low, C.ACTUATOR_TERMS), count_of(low, C.TRANSMITTER_TERMS)
    return F.coalesce(tag_info(text)["category"], F.when((actuator > transmitter) & (actuator >= 2), C.CATEGORIES[1]).otherwise(C.CATEGORIES[0]))


def simple_quantity(text: Column) -> Column:
    """Quantity by plain keyword counts: at least 3 hits and 2 more than the next."""
    low = F.lower(text)
    scores = []
    for name, words in C.SIMPLE_QUANTITIES:
        total = F.lit(0)
        for p, weight in words:
            total = total + weight * F.regexp_count(text if p == C.CASED_KEYWORDS else low, F.lit("(?U)" + p))
        scores.append((name, total))
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores)]))
    best, second = -ranked[0]["s"], -ranked[1]["s"]
    return F.when((best >= 3) & (best - second >= 2), F.struct(ranked[0]["k"].alias("value"), F.lit(0.8).alias("confidence")))
