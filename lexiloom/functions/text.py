"""Text functions as Columns. All run inside the generated code of the scan, but for the exact normaliser with its map."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities and their characters; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
#: Letters that normalisation spells out.
SPELT = (("ſ", "s"), ("æ", "ae"), ("œ", "oe"), ("ß", "ss"))
#: Old orthography and its replacement, in this order.
LEGACY = (("ßſ", "ss"), ("ſ", "s"), ("ß", "ss"), ("ỳ", "y̆"), ("Ỳ", "Y̆"))
#: Capitals that begin a headword.
CAPITALS = "A-ZĀĂĒĔĪĬŌŎŪŬ"


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def decode_entities(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def encode_entities(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ENTITIES), text)


def clean_html_text(text: Column) -> Column:
    """Runs of space, tab and newline become one space; none leads."""
    return F.regexp_replace(F.regexp_replace(text, "[ \t\n]+", " "), "^ ", "")


def clean_ocr_text(text: Column) -> Column:
    """Hyphens at line ends and what indents the next line go; a newline is a space; spaces after a space or newline go."""
    joined = F.regexp_replace(text, "-\n *", "")
    return F.translate(F.regexp_replace(joined, "([ \n]) +", "$1"), "\n", " ")


@lru_cache(1)
def accent_table() -> tuple[str, str]:
    """Lower-case letters up to U+024F and U+1E00 to U+1EFF whose decomposition is a base letter with marks."""
    source, target = [], []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != c:
            source.append(c)
            target.append(bare)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case, spelt-out ligatures, no accents: for the Latin alphabets equal to normalise, without Python."""
    spelt = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), SPELT, F.lower(text))
    return F.regexp_replace(F.translate(spelt, *accent_table()), r"\p{Mn}", "")


def normalise_with_map(text: str) -> tuple[str, list[int]]:
    """The exact rule for any alphabet, with the source position of each character."""
    out, places = [], []
    spelt = dict(SPELT)
    for i, c in enumerate(text):
        for low in c.lower():
            for x in unicodedata.normalize("NFKD", spelt.get(low, low)):
                if unicodedata.category(x) != "Mn":
                    out.append(x)
                    places.append(i)
    return "".join(out), places


class _Spelling(dict):
    """What each character becomes, for str.translate, and the length of that; filled as characters are met."""

    def __init__(self):
        super().__init__()
        self.sizes = np.zeros(0x110000, np.uint8)

    def __missing__(self, code: int) -> str:
        norm = self[code] = normalise_with_map(chr(code))[0]
        self.sizes[code] = len(norm)
        return norm

    def places(self, text: str) -> np.ndarray:
        """The source places of text.translate(self), which must come first."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.repeat(np.arange(len(codes), dtype=np.int32), self.sizes[codes])


#: Characters of normalised text in a batch that goes back to the JVM; a longer text is a batch of its own. Rows in a batch that comes in.
NORM_CHARS, NORM_ROWS = 1 << 21, 1000


def normalise_texts(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, norm and places of normalise_with_map, null as empty. What a task holds beside the texts that come in is bounded: places are
    arrays of numbers, and rows go back in batches of bounded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Spelling()

        def out(keys: pa.Array, norms: list[str], places: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([keys, pa.array(norms, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places)))], [key, "norm", "places"])

        for batch in batches:
            low, norms, places, size = 0, [], [], 0
            for i, t in enumerate(batch.column(1)):
                whole = t.as_py() or ""
                norms.append(whole.translate(table))
                places.append(table.places(whole))
                size += len(norms[-1])
                if size >= NORM_CHARS or i + 1 == batch.num_rows:
                    yield out(batch.column(0)[low : i + 1], norms, places)
                    low, norms, places, size = i + 1, [], [], 0
        pa.default_memory_pool().release_unused()

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(NORM_ROWS))
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(text).cast("string").alias("_t")).mapInArrow(run, f"`{key}` {kind}, norm string, places array<int>")


def strip_tags_with_map(text: str) -> tuple[str, list[int]]:
    """Text outside tags and its source positions; a < without > stays."""
    edges = [0, *(x for m in re.finditer("<[^>]*>", text) for x in m.span()), len(text)]
    gaps = [range(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return "".join(text[g.start : g.stop] for g in gaps), [i for g in gaps for i in g]


def legacy_orthography(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), LEGACY, text)


#: The signs of metrical feet, short and long.
FEET = "⏑—"


def metrical_join(text: Column) -> Column:
    """A space between two signs of feet goes; twice, as matches overlap."""
    step = lambda t: F.regexp_replace(t, f"([{FEET}]) ([{FEET}])", "$1$2")
    return step(step(text))


#: The cleaning rules, (pattern, replacement) in order; references to groups as $n.
CLEAN_RULES = (
    (r"(<b>[^<]*?) *<br/>\n", "$1</b><br/>\n<b>"),
    (r"(<b>[^<]*?) *<br/>\n", "$1</b><br/>\n<b>"),
    (r"(<b>[^<]*?) *<br/>\n", "$1</b><br/>\n<b>"),
    (r" *<br/> *\n([a-z]\.) *<br/> *\n<u>", "<br/>\n$1 <u>"),
    (r"<p><br/>\n", "<p>"),
    (r" *<br/> *\n *<br/> *\n *", "<br/>\n"),
    (rf" *<br/>\n([{CAPITALS}][^ \t\n]*;)([ \t\n]|\z)", " $1$2"),
    (r" *</b> *</span> *<br/> *\n *<span> *<b> *", " "),
    (r"\. \. \.", "…"),
    (r"([0-9])—([0-9])", "$1–$2"),
    (r" *</span> *<br/> *\n<span> *", " "),
    (r"Varro 1\. l\. ", "Varro l. l. "),
    (r"Varr\. 1\. l\. ", "Varr. l. l. "),
    (r"C<i>", "<i>C"),
    (r"<i>:</i>", ":"),
    (r"<i>;</i>", ";"),
    (r",([a-z])", ", $1"),
    (r" (aa|bb|cc|dd|ee)\. ", "<br/>\n$1. "),
)


def apply_rules(text: Column, rules: tuple = CLEAN_RULES) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def is_sense_number(word: Column) -> Column:
    """Roman numbers, and a capital with a stop."""
    return F.replace(word, F.lit("<br/>"), F.lit("")).rlike(r"^[IVX]+|^[A-Z]\.")


def mark_headwords(text: Column) -> Column:
    """Headwords in <orth>: after <p> (with an optional roman number), line-initial bold, underlined or bracketed words, and words
    with a capital after a line break that are no sense numbers."""
    tagged = r"<[bu]>[^<]*</[bu]>[^ \t\n]*"
    rules = (
        (rf"(?m)^(<p>(?:[IV]+\.[ \t\n]+)?)({tagged}|[^ \t\n]+)", "$1<orth>$2</orth>"),
        (rf"(?m)^({tagged})", "<orth>$1</orth>"),
        (r"(?m)^(\(<[bu]>[^<]*</[bu]>\)?[^ \t\n]*)", "<orth>$1</orth>"),
        (rf"(?m)^(\([{CAPITALS}][^ \t\n]*)", "<orth>$1</orth>"),
        # a sense number takes the break after it along, so all are marked first, and sense numbers unmarked after
        (rf"<br/>\n([{CAPITALS}][^ \t\n]*)", "<br/>\n<orth>$1</orth>"),
        (r"<br/>\n<orth>((?:[IVX]|[A-Z](?:<br/>)*\.)[^ \t\n]*)</orth>", "<br/>\n$1"),
    )
    return apply_rules(text, rules)


def tidy_headwords(text: Column) -> Column:
    """Breaks leave headwords, empty headwords before another go, and an ellipsis belongs to its headword."""
    return apply_rules(text, ((r"<br/></orth>", "</orth><br/>"), (r"<orth></orth><br/>\n<orth>", "<orth>"), (r"</orth> *…", "…</orth>")))


def headword_key(text: Column) -> Column:
    return F.regexp_extract(fold(text), "^[a-z]+", 0)


def tokens(text: Column) -> Column:
    """Tags and the text between them, in order."""
    return F.regexp_extract_all(text, F.lit("<[^>]+>|[^<]+"), F.lit(0))


def percent_of_height(top: Column, height: int = 5120) -> Column:
    """Percent with one decimal, ties to even."""
    return F.bround(top / F.lit(float(height)) * 100, 1)


def popcount_change(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
