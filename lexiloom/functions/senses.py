"""Sense markers: classification, nesting levels and the validity of sequences, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level and list class of each marker type; the first number that a level may start with.
LEVELS = {"letter_upper": 0, "roman_upper": 1, "digit": 2, "letter": 3, "greek": 4, "roman_lower": 5, "double_letter": 6}
CLASSES = {"letter_upper": "sense-Alpha", "roman_upper": "sense-Roman", "digit": "sense-decimal", "letter": "sense-alpha", "greek": "sense-greek", "roman_lower": "sense-roman", "double_letter": "sense-double-alpha"}
FIRST = {"letter_upper": 0, "roman_upper": 1, "digit": 1, "letter": 0, "greek": 0, "roman_lower": 1, "double_letter": 0}
#: Roman numbers that count; longer ones are 0.
ROMANS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def classify(marker: Column) -> Column:
    """struct(mtype, value). i and j share a number, so letters from j on count one less."""
    m = F.regexp_replace(marker, r"[.,;]+\z", "")
    code = lambda c: F.ascii(c)
    letter = code(m) - 97 - F.when(F.substring(m, 1, 1) > "i", 1).otherwise(0)
    roman = F.array_position(F.array(*map(F.lit, ROMANS)), F.upper(m)).cast("int")
    of = lambda t, v: F.struct(F.lit(t).alias("mtype"), v.cast("int").alias("value"))
    return (
        F.when(m.rlike(r"^[0-9]+\z"), of("digit", F.expr("1") * F.when(m.rlike(r"^[0-9]+\z"), m).cast("int")))
        .when(m.rlike(r"^[α-ω]\z"), of("greek", code(m) - 0x3B1))
        .when(m.rlike(r"^[a-z]\z"), of("letter", letter))
        .when(m.rlike(r"^([a-z])\1\z"), of("double_letter", letter))
        .when(m.rlike(r"^[IVX]+\z"), of("roman_upper", roman))
        .when(m.rlike(r"^[IVXivx]+\z"), of("roman_lower", F.when(m.rlike(r"^[ivx]+\z"), roman).otherwise(0)))
        .when(m.rlike(r"^[A-Z]\z"), of("letter_upper", code(m) - 65))
        .otherwise(of("unknown", F.lit(0)))
    )


def level(mtype: Column) -> Column:
    return F.element_at(_lookup(LEVELS), mtype)


def list_class(mtype: Column) -> Column:
    return F.coalesce(F.element_at(_lookup(CLASSES), mtype), F.lit("sense"))


def _step(state: Column, item: Column) -> Column:
    """Stack fold: deeper levels close; a sibling must follow its elder by one, a new level start at its first number."""
    open_ = F.filter(state["stack"], lambda s: s["level"] <= item["level"])
    top = F.element_at(open_, -1)
    sibling = (F.size(open_) > 0) & F.coalesce(F.try_element_at(open_, F.lit(-1))["level"] == item["level"], F.lit(False))
    kept = F.when(sibling, F.slice(open_, F.lit(1), F.size(open_) - 1)).otherwise(open_)
    first = F.element_at(_lookup(FIRST), item["mtype"])
    fits = F.when(sibling, item["value"] == F.try_element_at(open_, F.lit(-1))["value"] + 1).otherwise(item["value"] == first)
    del top
    return F.struct(F.concat(kept, F.array(F.struct(item["level"].alias("level"), item["value"].alias("value")))).alias("stack"), (state["ok"] & fits).alias("ok"))


def sequence_valid(markers: Column) -> Column:
    """Whether an array of marker texts is a valid nesting; unknown markers are skipped."""
    items = F.transform(markers, lambda m: F.struct(classify(m)["mtype"].alias("mtype"), classify(m)["value"].alias("value")))
    known = F.filter(items, lambda i: i["mtype"] != "unknown")
    levelled = F.transform(known, lambda i: F.struct(i["mtype"].alias("mtype"), i["value"].alias("value"), level(i["mtype"]).alias("level")))
    start = F.struct(F.expr("cast(array() as array<struct<level int, value int>>)").alias("stack"), F.lit(True).alias("ok"))
    return F.aggregate(levelled, start, _step, lambda s: s["ok"])
