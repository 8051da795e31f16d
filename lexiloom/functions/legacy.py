"""The older compile route: metrical feet, style repair, hyphenation, structure. Columns, applied in this order by compile_text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

_W = r"[\p{L}\p{N}_]"
#: Rules (pattern, replacement), in order: widening of spaced type, then (after JOIN) the gloss type.
WIDEN = ((rf"(?s)(-?)<sp>(.*?)</sp>({_W}*-?)", "<sp>$1$2$3</sp>"),)
JOIN = (r"</([^>]*)>(-?\n)<\1>", "$2")
GLOSS = (
    (r"(?s)</b></s><b>([ \n,-]*)<s>((?:.(?!/s>))*)</s></b>", "$1$2</b></s>"),
    (r"</b></s>([ \n,-]*)<s><b>", "$1"),
    (r"</s>([ \n,:;.()=0-9-]*)<s>", "$1"),
    (r"([(][ \n=]*)<s>", "<s>$1"),
    (r"</s>([ \n=,;.:)-]*[,;.:)-](?=[\n ]))", "$1</s>"),
)
DEHYPHENATE = ((rf" (\S*{_W})-\n({_W})", "\n$1$2"),)
#: Tags by their new names, pairs of numbers that show an outline, and the breaks before its items.
RENAMED = (("sp>", "u>"), ("s>", "span>"))
OUTLINES = (("I", "II"), ("1", "2"), ("a", "b"))
BREAKS = (
    (r"\n—\s|\s—\n", "\n<br/>"),
    (r"\s—\s", "<br/>"),
    (r"\n<u>", "\n<br/><u>"),
    (r"\s<u>", "<br/><u>"),
    (r"(?s)(<span>(?:.(?!</span>))*)(<br/>[0-9]+\.\s)", "$1</span>$2<span>"),
)


def repair_styles(column: Column) -> Column:
    """Widens spaced type over hyphens and word ends, joins styles over line ends until nothing changes, and mends the gloss type.

    A pass of JOIN takes the innermost style off every line end, so as many passes as tags open after one line end are enough.
    """
    def join(wide: Column) -> Column:
        opened = F.regexp_extract_all(wide, F.lit(r"\n((?:<[^>]*>)+)"), F.lit(1))
        passes = F.coalesce(F.array_max(F.transform(opened, lambda t: F.regexp_count(t, F.lit("<")))), F.lit(0))
        done = F.aggregate(F.sequence(F.lit(0), passes), wide, lambda t, _: F.regexp_replace(t, *JOIN))
        return done

    wide = text.apply_rules(column, WIDEN)
    return text.apply_rules(F.get(F.transform(F.array(wide), join), F.lit(0)), GLOSS)


def dehyphenate(column: Column) -> Column:
    return text.apply_rules(column, DEHYPHENATE)


def structure(column: Column) -> Column:
    """Paragraphs at blank lines, tags by their new names, and breaks before the items of an outline."""
    out = F.concat(F.lit("<p>"), F.replace(column, F.lit("\n\n"), F.lit("</p>\n\n<p>")), F.lit("</p>"))
    for old, new in RENAMED:
        out = F.replace(out, F.lit(old), F.lit(new))
    outline = tuple((rf"(?s)(\s{a}\.\s(?:.(?!<p>))*?\s—\s{b}\.\s)", " —$1") for a, b in OUTLINES)
    return text.apply_rules(out, (*outline, *BREAKS))


def compile_text(column: Column) -> Column:
    return reduce(lambda c, f: f(c), (text.metrical_join, repair_styles, dehyphenate, text.legacy_orthography, structure), column)


def positions_of(column: Column, char: str) -> Column:
    """Places (from 0) of a character, in one pass."""
    at = F.transform(F.split(column, ""), lambda c, i: F.when(c == char, i))
    return F.filter(at, lambda i: i.isNotNull())


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*\z", ""), F.lit(suffix))
