"""The queries over the tables, each beside the SQL that an independent engine runs for it.

Tables stand in for page data: documents are page text, pages marked-up paragraphs, events points in one dimension,
lineitem boxes in lines, embeddings small ink images and feature vectors, nation and customer an alias forest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import senses, text
from ..operators import boxes, images, joins, lexicon, registry, stats
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """The same rows for the SQL side."""
    spell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)  # noqa: E731
    return f"(VALUES {', '.join('(' + ', '.join(map(spell, r)) + ')' for r in rows)}) AS t({names})"


# ---- text -------------------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, CAST(length(s) AS BIGINT) AS n, md5(s) AS digest FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS s FROM pages)")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("s")).select("page_id", F.length("s").cast("long").alias("n"), F.md5("s").alias("digest"))


_PARA_SQL = r"""SELECT page_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS para_no, unnest(p) AS content
FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS p FROM pages)"""


@query(f"SELECT page_id, para_no, md5(content) AS digest FROM ({_PARA_SQL})")
def paragraph_explode(spark, d):
    return lexicon.paragraphs(table(spark, d, "pages")).select("page_id", "para_no", F.md5("content").alias("digest"))


@query("""SELECT page_id, CAST(length(s) AS BIGINT) AS n, md5(s) AS digest FROM (SELECT page_id,
replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS s FROM pages)""")
def entity_decode(spark, d):
    return table(spark, d, "pages").select("page_id", text.decode_entities(F.col("html")).alias("s")).select("page_id", F.length("s").cast("long").alias("n"), F.md5("s").alias("digest"))


@query(r"""SELECT page_id, CAST(token_no AS INTEGER) AS token_no, tag, CAST(sum(CASE WHEN tok LIKE '</%' THEN -1 WHEN tok LIKE '<%' THEN 1 ELSE 0 END)
OVER (PARTITION BY page_id ORDER BY token_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM (
SELECT page_id, token_no, tok, regexp_extract(tok, '^</?([a-z0-9]+)', 1) AS tag FROM (
SELECT page_id, generate_subscripts(p, 1) AS token_no, unnest(p) AS tok FROM (SELECT page_id, regexp_extract_all(html, '<[^>]+>|[^<]+') AS p FROM pages)))""")
def markup_spans(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.posexplode(text.tokens(F.col("html"))).alias("at", "tok"))
    step = F.when(F.col("tok").startswith("</"), -1).when(F.col("tok").startswith("<"), 1).otherwise(0)
    w = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("page_id", (F.col("at") + 1).alias("token_no"), F.regexp_extract("tok", "^</?([a-z0-9]+)", 1).alias("tag"), F.sum(step).over(w).alias("depth"))


@query(r"SELECT page_id, md5(s) AS digest, CAST(length(s) AS BIGINT) AS n FROM (SELECT page_id, regexp_replace(regexp_replace(html, '[ \t\n]+', ' ', 'g'), '^ ', '') AS s FROM pages)")
def clean_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_html_text(F.col("html")).alias("s")).select("page_id", F.md5("s").alias("digest"), F.length("s").cast("long").alias("n"))


@query(r"""SELECT doc_id, md5(s) AS digest FROM (SELECT doc_id, translate(regexp_replace(regexp_replace(replace(replace(text, 'er ', 'e-' || chr(10) || '  r '), 'on ', 'on  '),
'-\n *', '', 'g'), '([ \n]) +', '\1', 'g'), chr(10), ' ') AS s FROM documents)""")
def dehyphenate(spark, d):
    broken = F.replace(F.replace(F.col("text"), F.lit("er "), F.lit("e-\n  r ")), F.lit("on "), F.lit("on  "))
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_ocr_text(broken)).alias("digest"))


@query("SELECT doc_id, md5(s) AS digest, substr(s, 1, 20) AS start FROM (SELECT doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) AS s FROM documents)")
def normalize_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("s")).select("doc_id", F.md5("s").alias("digest"), F.substring("s", 1, 20).alias("start"))


_OLD = [("Opaßſig ỳ",), ("ſommar",), ("Groß",), ("Ỳrke",), ("plain",)]


@query(f"SELECT t AS word, replace(replace(replace(replace(replace(t, 'ßſ', 'ss'), 'ſ', 's'), 'ß', 'ss'), 'ỳ', 'y̆'), 'Ỳ', 'Y̆') AS modern FROM {values(_OLD, 't')}")
def legacy_orthography(spark, d):
    return literals(spark, _OLD, "word string").select("word", text.legacy_orthography(F.col("word")).alias("modern"))


_MADE = "replace(replace(replace(html, '<br>', ' <br/>' || chr(10)), ', ', ','), '. ', ' . . . ')"


def _rule_sql(source: str) -> str:
    out = source
    for pattern, new in text.CLEAN_RULES:
        new = new.replace("$", "\\")
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return out


@query(f"SELECT page_id, md5({_rule_sql(_MADE)}) AS digest FROM pages")
def rule_chain_clean(spark, d):
    made = F.replace(F.replace(F.replace(F.col("html"), F.lit("<br>"), F.lit(" <br/>\n")), F.lit(", "), F.lit(",")), F.lit(". "), F.lit(" . . . "))
    return table(spark, d, "pages").select("page_id", F.md5(text.apply_rules(made)).alias("digest"))


#: Rule five as an engine without lookaround has it: every capital after a break is marked, then sense numbers are unmarked.
_HEADS_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?m)^(<p>(?:[IV]+\.[ \t\n]+)?)(<[bu]>[^<]*</[bu]>[^ \t\n]*|[^ \t\n]+)', '\1<orth>\2</orth>', 'g'),
'(?m)^(<[bu]>[^<]*</[bu]>[^ \t\n]*)', '<orth>\1</orth>', 'g'), '(?m)^(\(<[bu]>[^<]*</[bu]>\)?[^ \t\n]*)', '<orth>\1</orth>', 'g'), '(?m)^(\([A-ZĀĂĒĔĪĬŌŎŪŬ][^ \t\n]*)', '<orth>\1</orth>', 'g'),
'(<br/>\n)([A-ZĀĂĒĔĪĬŌŎŪŬ][^ \t\n]*)', '\1<orth>\2</orth>', 'g'), '(<br/>\n)<orth>((?:[IVX]|[A-Z](?:<br/>)*\.)[^ \t\n]*)</orth>', '\1\2', 'g')"""
_BROKEN_SQL = "(SELECT page_id, replace(replace(replace(html, '<p>', chr(10) || '<p>'), '<br>', '<br/>' || chr(10)), '. ', '.<br/>' || chr(10)) AS s FROM pages)"


def _broken(spark: SparkSession, d: str) -> DataFrame:
    s = F.replace(F.replace(F.replace(F.col("html"), F.lit("<p>"), F.lit("\n<p>")), F.lit("<br>"), F.lit("<br/>\n")), F.lit(". "), F.lit(".<br/>\n"))
    return table(spark, d, "pages").select("page_id", s.alias("s"))


@query(f"SELECT page_id, md5({_HEADS_SQL}) AS digest, CAST(len(string_split({_HEADS_SQL}, '<orth>')) - 1 AS INTEGER) AS heads FROM {_BROKEN_SQL}")
def headword_mark(spark, d):
    marked = _broken(spark, d).select("page_id", text.mark_headwords(F.col("s")).alias("m"))
    return marked.select("page_id", F.md5("m").alias("digest"), F.regexp_count("m", F.lit("<orth>")).alias("heads"))


@query(f"""SELECT page_id, md5(regexp_replace(replace(replace(replace({_HEADS_SQL}, '</orth> ', '</orth> …'), '<br/></orth>', '</orth><br/>'), '<orth></orth><br/>' || chr(10) || '<orth>', '<orth>'), '</orth> *…', '…</orth>', 'g')) AS digest
FROM {_BROKEN_SQL}""")
def headword_tidy(spark, d):
    marked = F.replace(text.mark_headwords(F.col("s")), F.lit("</orth> "), F.lit("</orth> …"))
    return _broken(spark, d).select("page_id", F.md5(text.tidy_headwords(marked)).alias("digest"))


_KEY_SQL = "regexp_extract(strip_accents(replace(lower(text), 'ß', 'ss')), '^[a-z]+')"


@query(f"SELECT doc_id, {_KEY_SQL} AS k FROM documents")
def headword_key(spark, d):
    return table(spark, d, "documents").select("doc_id", text.headword_key(F.col("text")).alias("k"))


@query(f"SELECT k, count(*) AS n FROM (SELECT {_KEY_SQL} AS k FROM documents) WHERE k <> '' GROUP BY k HAVING count(*) > 1")
def duplicate_headwords(spark, d):
    return lexicon.duplicate_keys(headword_key(spark, d), "k")


# ---- references -------------------------------------------------------------------------------------------------------

_MARKUP = (("<b>", "<orth><b>"), ("</b>", "</b></orth>"), (" que ", " <span>se</span> "), (" the ", " <span>under</span> "), (" der ", " <span>eine lange Erklärung</span> "))
_MARKUP_SQL = "content"
for _a, _b in _MARKUP:
    _MARKUP_SQL = f"replace({_MARKUP_SQL}, '{_a}', '{_b}')"
_LINKS_SQL = "('se', 'o.', 'under', 'och', 'äfwen', 'eller')"
_AUTHORS_RE = "|".join(a.replace(".", r"\.") for a in lexicon.AUTHORS)
_SCORE_SQL = rf"""WITH p AS (SELECT page_id, para_no, {_MARKUP_SQL} AS content FROM ({_PARA_SQL})),
q AS (SELECT *, regexp_extract(content, '(?s)<orth[^>]*>(.*?)</orth>', 1) AS hh, regexp_replace(content, '<[^>]*>', '', 'g') AS plain, regexp_extract_all(content, '<span>(.*?)</span>', 1) AS g FROM p),
f AS (SELECT page_id, para_no, content, regexp_replace(regexp_replace(hh, '<[^>]*>', '', 'g'), ',+$', '') AS headword,
contains(content, '<span>se</span>') AS has_se_span, regexp_matches(content, '</orth>[ \t\n]*se[ \t\n]+[A-Z]') AS has_bare_se, contains(content, '<ol') AS has_ol, CAST(len(g) AS INTEGER) AS span_count,
len(g) > 0 AND len(list_filter(g, lambda x: trim(x) NOT IN {_LINKS_SQL})) = 0 AS only_se_spans, CAST(length(plain) AS INTEGER) AS text_length,
CAST(len(regexp_extract_all(content, '<orth')) AS INTEGER) AS orth_count, contains(hh, '<b>') OR contains(hh, '<b ') AS has_bold_orth, contains(hh, '<u>') AS has_underline_orth,
len(list_filter(g, lambda x: trim(x) NOT IN {_LINKS_SQL} AND (contains(x, '<b>') OR length(regexp_replace(x, '<[^>]*>', '', 'g')) > 10))) > 0 AS has_definition_span,
regexp_matches(plain, '(^|[^A-Za-z])({_AUTHORS_RE})([^A-Za-z]|$)') AS has_citations FROM q),
h AS (SELECT *, regexp_replace(lower(headword), '[^\p{{L}}\p{{N}}_]', '', 'g') AS hw_clean, headword LIKE '%…' AS headword_ellipsis, orth_count >= 2 AND has_se_span AND NOT has_definition_span AS collector_entry FROM f),
s AS (SELECT *, hw_clean <> '' AND count(*) OVER (PARTITION BY hw_clean) > 1 AS duplicate_headword,
CAST(CASE WHEN headword_ellipsis THEN 60 WHEN has_se_span AND only_se_spans THEN 50 WHEN has_bare_se AND NOT has_definition_span THEN 40 WHEN collector_entry THEN 30 WHEN has_se_span THEN 20 ELSE 0 END
+ CASE WHEN text_length < 80 THEN 10 ELSE 0 END + CASE WHEN NOT has_bold_orth AND NOT has_underline_orth THEN 5 ELSE 0 END - CASE WHEN has_ol THEN 30 ELSE 0 END
- CASE WHEN has_underline_orth THEN 20 ELSE 0 END - CASE WHEN has_citations THEN 15 ELSE 0 END - CASE WHEN has_definition_span THEN 10 ELSE 0 END - CASE WHEN text_length > 300 THEN 10 ELSE 0 END AS INTEGER) AS score FROM h)
"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    content = F.col("content")
    for a, b in _MARKUP:
        content = F.replace(content, F.lit(a), F.lit(b))
    return lexicon.score_references(lexicon.paragraphs(table(spark, d, "pages")).withColumn("content", content))


@query(_SCORE_SQL + "SELECT * EXCLUDE (content), md5(content) AS digest FROM s")
def reference_score(spark, d):
    return _scored(spark, d).withColumn("digest", F.md5("content")).drop("content")


@query(_SCORE_SQL + """SELECT page_id, para_no, score FROM s WHERE score < 30 AND NOT ((contains(content, '<span>se</span>') OR contains(content, '...'))
AND NOT contains(content, '<ol') AND NOT contains(content, '<b>') AND NOT contains(content, 'Patella'))""")
def prune_references(spark, d):
    return lexicon.prune_references(_scored(spark, d), keep_words=("Patella",)).select("page_id", "para_no", "score")


@query(_SCORE_SQL + "SELECT page_id, para_no, score, headword, format('{:4d}  {:<30s}  {}', score, headword, substr(regexp_replace(substr(content, 1, 200), '<[^>]*>', '', 'g'), 1, 80)) AS line FROM s")
def report_txt(spark, d):
    return lexicon.report_lines(_scored(spark, d)).select("page_id", "para_no", "score", "headword", "line").orderBy(F.desc("score"), "headword")


@query(_SCORE_SQL + """SELECT page_id, para_no, to_json({'score': score, 'headword': headword, 'paragraph_preview': substr(content, 1, 200), 'features': {'span_count': span_count, 'text_length': text_length, 'orth_count': orth_count, 'has_se_span': has_se_span, 'has_bare_se': has_bare_se, 'has_ol': has_ol, 'only_se_spans': only_se_spans, 'has_bold_orth': has_bold_orth, 'has_underline_orth': has_underline_orth, 'has_definition_span': has_definition_span, 'has_citations': has_citations, 'headword_ellipsis': headword_ellipsis, 'collector_entry': collector_entry, 'duplicate_headword': duplicate_headword}}) AS json FROM s""")
def report_json(spark, d):
    return lexicon.report_json(_scored(spark, d)).select("page_id", "para_no", "json").orderBy("page_id", "para_no")


_LINE_SQL = """SELECT doc_id, generate_subscripts(p, 1) AS no, unnest(p) AS line FROM (SELECT doc_id, string_split(replace(replace(text, '. ', '.' || chr(10)), ', ', ',' || chr(10)), chr(10)) AS p FROM documents)"""
_LAST = r"([^ \t\n<>]+(?:</[^>]*>)*) *$"


def _in(words: tuple) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(rf"""WITH l AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY no) AS prev FROM ({_LINE_SQL})),
w AS (SELECT *, regexp_extract(prev, '{_LAST}', 1) AS lastw, regexp_matches(line, '^[A-ZÀ-Ý]') AS head FROM l),
j AS (SELECT *, CASE WHEN prev IS NULL OR NOT head OR lastw = '' THEN FALSE WHEN contains(lastw, '</orth>') THEN TRUE
WHEN right(lastw, 1) IN (':', ',', ';') THEN TRUE WHEN lastw IN ('=', '(') THEN TRUE WHEN lastw LIKE '%)' AND lastw NOT LIKE '%).' AND lastw NOT LIKE '%?)' THEN TRUE
WHEN lastw IN {_in(lexicon.JOIN_WORDS)} OR ltrim(lastw, '(') IN {_in(lexicon.JOIN_WORDS)} THEN TRUE
WHEN lastw IN {_in(lexicon.JOIN_ABBREVIATIONS)} OR ltrim(lastw, '(') IN {_in(lexicon.JOIN_ABBREVIATIONS)} THEN TRUE WHEN lastw IN {_in(lexicon.GRAMMAR)} THEN TRUE
WHEN regexp_matches(lastw, '^[0-9]+\.$') AND trim(regexp_extract(prev, '(?s)^(.*?)[^ \t\n<>]+(?:</[^>]*>)* *$', 1)) = '' THEN TRUE ELSE FALSE END AS joined FROM w)
SELECT doc_id, CAST(no AS INTEGER) AS no, CAST(sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM j""")
def break_join(spark, d):
    broken = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n")), F.lit(", "), F.lit(",\n"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(broken, "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("no"), "line")
    return lexicon.join_lines(lines, "doc_id", "no", "line", F.col("line").rlike("^[A-ZÀ-Ý]")).select("doc_id", "no", "group_no")


@query(r"""SELECT doc_id, CAST(no AS INTEGER) AS no, CASE WHEN regexp_matches(line, '^(?:[0-9]+\.|[IVX]+\.|(?:""" + "|".join(f"{c}{c}?" for c in "abcdefghijklmnopqrstuvwxyz") + r""")\.|[A-Z]\.|[α-ω]\.)') OR line LIKE '<orth>%' THEN 'keep'
WHEN contains(line, 'th') THEN 'dash' ELSE 'space' END AS fate FROM (SELECT doc_id, no, CASE WHEN no % 5 = 0 THEN 'II. ' WHEN no % 7 = 0 THEN '<orth>' ELSE '' END || line AS line FROM (""" + _LINE_SQL + "))")
def spurious_break_repair(spark, d):
    broken = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n")), F.lit(", "), F.lit(",\n"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(broken, "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("no"), "line")
    line = F.concat(F.when(F.col("no") % 5 == 0, "II. ").when(F.col("no") % 7 == 0, "<orth>").otherwise(""), "line")
    return lines.select("doc_id", "no", lexicon.keep_breaks(line, line.contains("th")).alias("fate"))


_MARKERS = [("1.", "digit", 1, 2), ("10", "digit", 10, 2), ("a.", "letter", 0, 3), ("i.", "letter", 8, 3), ("j.", "letter", 8, 3), ("k.", "letter", 9, 3), ("ii", "double_letter", 8, 6), ("aa.", "double_letter", 0, 6), ("ab", "unknown", 0, None), ("I.", "roman_upper", 1, 1), ("XIII", "roman_upper", 0, 1), ("A.", "letter_upper", 0, 0), ("L", "letter_upper", 11, 0), ("α", "greek", 0, 4), ("ω", "greek", 24, 4), ("iii", "roman_lower", 3, 5), ("iv", "roman_lower", 4, 5), ("V", "roman_upper", 5, 1)]  # fmt: skip


@query(f"SELECT marker, mtype, CAST(val AS INTEGER) AS val, CAST(lvl AS INTEGER) AS lvl FROM {values(_MARKERS, 'marker, mtype, val, lvl')}")
def sense_marker_parse(spark, d):
    got = senses.classify(F.col("marker"))
    return literals(spark, [(m[0],) for m in _MARKERS], "marker string").select("marker", got["mtype"].alias("mtype"), got["value"].alias("val"), senses.level(got["mtype"]).alias("lvl"))


_SEQUENCES = [("", True), ("1 2 3", True), ("2", False), ("1 3", False), ("1 a b 2", True), ("a c", False), ("I 1 2 II 1", True), ("1 α β 2 a", True), ("A B C", True), ("1 aa bb", True), ("b", False)]


@query(f"SELECT seq, CAST(valid AS BOOLEAN) AS valid FROM {values([(s, str(v).lower()) for s, v in _SEQUENCES], 'seq, valid')}")
def sense_sequence_valid(spark, d):
    seq = F.filter(F.split("seq", " "), lambda m: m != "")
    return literals(spark, [(s,) for s, _ in _SEQUENCES], "seq string").select("seq", senses.sequence_valid(seq).alias("valid"))


_NEST = [(1, 1, "I.", 1, 0, True), (1, 2, "1.", 2, 0, True), (1, 3, "a.", 3, 0, True), (1, 4, "b.", 3, 0, False), (1, 5, "2.", 2, 1, False), (1, 6, "II.", 1, 1, False), (2, 1, "1.", 1, 0, True), (2, 2, "α.", 2, 0, True)]


@query(f"SELECT CAST(para AS BIGINT) AS para, CAST(no AS INTEGER) AS no, m, CAST(depth AS INTEGER) AS depth, CAST(closes AS INTEGER) AS closes, CAST(opens AS BOOLEAN) AS opens FROM {values([(*r[:5], str(r[5]).lower()) for r in _NEST], 'para, no, m, depth, closes, opens')}")
def sense_nesting(spark, d):
    return lexicon.sense_nesting(literals(spark, [r[:3] for r in _NEST], "para long, no int, m string"), "para", "no", "m")


@query()
def paragraph_split(spark, d):
    rows = [(1, "<orth>A</orth> x<br/>\n1. y<br/>\n2. z<br/>\n<orth>B</orth> w<br/>\n1. v<br/>\n2. u"), (2, "<orth>A</orth><br/>\n1. y<br/>\n<orth>B</orth><br/>\n2. v"), (3, "<orth>A</orth><br/>\n2. y"), (4, "plain")]
    return lexicon.split_paragraphs(literals(spark, rows, "para long, content string"), ["para"])


@query()
def normalize_with_map(spark, d):
    """The exact normaliser, with the source place of each character, on whole texts."""
    got = text.normalise_texts(table(spark, d, "documents"), "doc_id")
    return got.select("doc_id", F.md5("norm").alias("digest"), F.size("places").alias("n"))


# ---- joins ------------------------------------------------------------------------------------------------------------


_VOLUME = "lang || '-' || (doc_id // 1000)"


@query(f"""WITH RECURSIVE x AS (SELECT {_VOLUME} AS volume, doc_id, {_KEY_SQL} AS k, {_KEY_SQL.replace("lower(text)", "lower(regexp_replace(text, '^[^' || chr(10) || ']*' || chr(10), ''))")} AS k2 FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY doc_id) AS i FROM x), b AS (SELECT volume, list(k2 ORDER BY doc_id) AS ks, list(doc_id ORDER BY doc_id) AS ids FROM x GROUP BY volume),
s AS (SELECT volume, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS left_no, CAST(NULL AS BIGINT) AS right_no FROM b
UNION ALL SELECT volume, i, pos + hit, doc_id, CASE WHEN hit > 0 THEN ids[pos + hit] END FROM
(SELECT s.volume, l.i, s.pos, l.doc_id, b.ids, CAST(coalesce(list_position(b.ks[s.pos + 1 : s.pos + 20], nullif(l.k, '')), 0) AS BIGINT) AS hit FROM s JOIN l ON l.volume = s.volume AND l.i = s.i + 1 JOIN b ON b.volume = s.volume))
SELECT volume, left_no, right_no FROM s WHERE right_no IS NOT NULL""")
def headword_align_greedy(spark, d):
    """First words of all documents against first words of their second lines, in volumes of a thousand ids."""
    docs = table(spark, d, "documents").select(F.concat_ws("-", "lang", F.expr("doc_id div 1000").cast("string")).alias("volume"), "doc_id", "text")
    later = docs.withColumn("text", F.regexp_replace("text", "^[^\n]*\n", ""))
    keyed = lambda side: side.select("volume", "doc_id", text.headword_key(F.col("text")).alias("k"))  # noqa: E731
    return lexicon.align_greedy(keyed(docs), keyed(later), "volume", "doc_id", "k")


def _positions(spark: SparkSession, d: str, kind: str) -> DataFrame:
    pos = F.expr("cast(floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e5) as bigint)").alias("pos")
    return table(spark, d, "events").where(kind).select("event_id", "user_id", pos)


_E_SQL = "SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1e5) AS BIGINT) AS pos FROM events WHERE event_type {op} 'purchase'"
_LEFT, _RIGHT = _E_SQL.format(op="<>"), _E_SQL.format(op="=")


@query(f"""SELECT l.event_id, l.pos, max(r.pos) AS start, CAST(round_even((l.event_id % 5120) / 5120.0 * 100, 1) AS DOUBLE) AS pct
FROM ({_LEFT}) l LEFT JOIN ({_RIGHT}) r ON l.user_id = r.user_id AND r.pos <= l.pos GROUP BY l.event_id, l.pos""")
def block_asof(spark, d):
    found = joins.asof(_positions(spark, d, "event_type <> 'purchase'"), _positions(spark, d, "event_type = 'purchase'").select("user_id", "pos"), "user_id", "pos", [])
    return found.select("event_id", "pos", F.col("pos_found").alias("start"), text.percent_of_height(F.col("event_id") % 5120).alias("pct"))


@query(f"SELECT l.event_id, min(r.pos) AS ceil_pos FROM ({_LEFT}) l LEFT JOIN ({_RIGHT}) r ON l.user_id = r.user_id AND r.pos >= l.pos GROUP BY l.event_id")
def ceiling_lookup(spark, d):
    found = joins.asof(_positions(spark, d, "event_type <> 'purchase'"), _positions(spark, d, "event_type = 'purchase'").select("user_id", "pos"), "user_id", "pos", [], forward=True)
    return found.select("event_id", F.col("pos_found").alias("ceil_pos"))


@query(f"SELECT event_id FROM ({_LEFT}) l WHERE EXISTS (SELECT 1 FROM ({_RIGHT}) r WHERE r.user_id = l.user_id AND abs(r.pos - l.pos) <= 20000)")
def band_semi(spark, d):
    left, right = _positions(spark, d, "event_type <> 'purchase'"), _positions(spark, d, "event_type = 'purchase'")
    return joins.band_semi(left, right, "user_id", "pos", "pos", 20000, "event_id").select("event_id")


@query(f"""SELECT event_id, other FROM (SELECT l.event_id, r.event_id AS other, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.pos - l.pos), r.pos DESC, r.event_id) AS k
FROM ({_LEFT}) l JOIN ({_RIGHT}) r ON r.user_id = l.user_id AND abs(r.pos - l.pos) <= 20000) WHERE k = 1""")
def nearest_in_band(spark, d):
    left = _positions(spark, d, "event_type <> 'purchase'")
    right = _positions(spark, d, "event_type = 'purchase'").withColumnsRenamed({"event_id": "other", "pos": "rpos"})
    pairs = joins.band(left, right, "user_id", "pos", "rpos", 20000)
    return joins.nearest(pairs, "event_id", F.abs(F.col("rpos") - F.col("pos")), F.desc("rpos"), F.col("other")).select("event_id", "other")


@query("""WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role <> 'user')
SELECT u.conv_id, CAST(u.k AS INTEGER) AS k, u.turn AS user_turn, coalesce(a.turn, -1) AS reply_turn FROM u LEFT JOIN a ON u.conv_id = a.conv_id AND u.k = a.k""")
def ordinal_zip(spark, d):
    c = table(spark, d, "conversations")
    a, b = c.where("role = 'user'").select("conv_id", F.col("turn").alias("user_turn")), c.where("role <> 'user'").select("conv_id", F.col("turn").alias("reply_turn"))
    return joins.ordinal_zip(a, b, "conv_id", "user_turn", "reply_turn").withColumn("reply_turn", F.coalesce("reply_turn", F.lit(-1).cast("long")))


@query()
def matching_blocks(spark, d):
    """Every document that has a near copy before it, whole texts on both sides."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    pairs = joins.copy_pairs(docs, "doc_id")
    both = joins.with_texts(stats.checkpointed(pairs), docs, "doc_id", "text")
    return lexicon.matching_blocks(both.withColumn("pair", F.concat_ws("-", F.col("first").cast("string"), F.col("later").cast("string"))), "pair", spread=False)


# ---- counts and statistics --------------------------------------------------------------------------------------------

_CHARS_SQL = "SELECT doc_id, lang, unnest(string_split(text, '')) AS ch FROM documents"


@query(f"SELECT lang, ch, count(*) AS n FROM ({_CHARS_SQL}) WHERE ch NOT IN (' ', chr(10)) GROUP BY lang, ch")
def unigram_freq(spark, d):
    rows = table(spark, d, "documents").select("lang", F.explode(F.split("text", "")).alias("ch")).where(~F.col("ch").isin(" ", "\n"))
    return stats.unigrams(rows, ["lang"], "ch")


@query("""SELECT l, r, count(*) AS n FROM (SELECT c[i] AS l, c[i + 1] AS r FROM (SELECT string_split(replace(text, chr(10), ''), '') AS c FROM documents), range(1, len(c)) AS t(i))
WHERE l <> ' ' AND r <> ' ' GROUP BY l, r""")
def bigram_freq(spark, d):
    return stats.bigrams_of_text(table(spark, d, "documents"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 1 ELSE var_samp(l_quantity) END, 4) AS var FROM lineitem GROUP BY 1, 2""")
def pair_mean_var(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(stats.sample_variance("l_quantity"), 4).alias("var"))


_PAIR_SQL = """SELECT a.l_returnflag AS fa, b.l_returnflag AS fb, b.l_quantity - a.l_quantity AS dy, CAST(b.l_linenumber - a.l_linenumber AS DOUBLE) * 60 AS dx
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber"""


@query(f"""WITH p AS (SELECT *, least(1.0, 100 / abs(dx)) AS w FROM ({_PAIR_SQL})), m AS (SELECT fa, fb, sum(w * dy) / sum(w) AS wmean FROM p GROUP BY fa, fb)
SELECT p.fa, p.fb, round(first(m.wmean), 4) AS wmean, round(CASE WHEN sum(w) <= 1 THEN 1 ELSE sum((dy - m.wmean) ** 2) / (sum(w) - 1) END, 3) AS pvar FROM p JOIN m ON p.fa = m.fa AND p.fb = m.fb GROUP BY p.fa, p.fb""")
def weighted_pair_mean(spark, d):
    cols = ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    a = table(spark, d, "lineitem").select(*cols).withColumnsRenamed({"l_linenumber": "na", "l_quantity": "qa", "l_returnflag": "fa"})
    b = table(spark, d, "lineitem").select(*cols).withColumnsRenamed({"l_linenumber": "nb", "l_quantity": "qb", "l_returnflag": "fb"})
    p = a.join(b, "l_orderkey").where("na < nb").select("fa", "fb", (F.col("qb") - F.col("qa")).alias("dy"), ((F.col("nb") - F.col("na")).cast("double") * 60).alias("dx"))
    return stats.weighted_pair(p, ["fa", "fb"], "dy", "dx").select("fa", "fb", F.round("wmean", 4).alias("wmean"), F.round("pvar", 3).alias("pvar"))


@query("""SELECT l_returnflag, round(sqrt(avg((l_quantity - 2 * l_linenumber) ** 2)), 5) AS rms FROM lineitem GROUP BY 1""")
def rms_deviation(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sqrt(F.avg(F.pow(F.col("l_quantity") - 2 * F.col("l_linenumber"), 2))), 5).alias("rms"))


_Q_SQL = "SELECT user_id, value AS q FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k = {index}"


@query(_Q_SQL.format(index="floor((n - 1) * 0.95)"))
def quantile_lower(spark, d):
    return stats.quantile_lower(table(spark, d, "events"), ["user_id"], "value", 0.95)


@query(_Q_SQL.format(index="least(floor(n * 0.5), n - 1)"))
def quantile_upper(spark, d):
    return stats.quantile_upper(table(spark, d, "events"), ["user_id"], "value", 0.5)


@query("SELECT l_orderkey, min(l_quantity) AS l, max(l_quantity + 10) AS r, min(l_linenumber) AS t, max(l_linenumber + 1) AS b, CAST(floor(least(0, min(l_discount * 10 - 1))) AS BIGINT) AS low FROM lineitem GROUP BY 1")
def bbox(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("l"), F.max(F.col("l_quantity") + 10).alias("r"), F.min("l_linenumber").alias("t"), F.max(F.col("l_linenumber") + 1).alias("b"), F.floor(F.least(F.lit(0.0), F.min(F.col("l_discount") * 10 - 1))).alias("low"))


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem GROUP BY 1")
def line_regression(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 2).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 1).alias("intercept"))


@query()
def wls_bearings(spark, d):
    pairs = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("b"), F.count(F.lit(1)).alias("w"))
    rows = pairs.select(F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("eq"), F.explode(F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("s"), "c_mktsegment"))).alias("unknown"), F.lit(1.0).alias("v"), "b", F.col("w").cast("double").alias("w"))
    anchor = spark.createDataFrame([("anchor", "sBUILDING", 1.0, 0.0, 1000.0)], rows.schema)
    return stats.least_squares(rows.union(anchor), "eq", "unknown", "v", "b", "w").select("unknown", F.round("x", 3).alias("x"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS reach FROM n UNION SELECT r.node, n.b FROM r JOIN n ON r.reach = n.a) SELECT node, min(reach) AS comp FROM r GROUP BY node""")
def components(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b"))
    return stats.components(edges)


@query("""WITH u AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\f\r]+')) AS w FROM documents)
SELECT DISTINCT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY w ORDER BY md5('42:' || doc_id), doc_id) AS k FROM u) WHERE k <= 50""")
def coverage_sample(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", r"[ \t\n\f\r]+"))).alias("w"))
    return stats.coverage_sample(words, "doc_id", "w", 50)


@query("SELECT CAST(y AS BIGINT) AS y, count(*) AS n FROM (SELECT unnest(range(CAST(l_quantity AS BIGINT), CAST(l_quantity AS BIGINT) + l_linenumber + 1)) AS y FROM lineitem) GROUP BY 1")
def occupancy_profile(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("t"), (F.col("l_quantity").cast("long") + F.col("l_linenumber")).alias("b"))
    return boxes.occupancy(rows, "t", "b")


@query("SELECT event_id, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END, 9) AS norm FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)")
def minmax_normalize(spark, d):
    return images.normalise_ink(table(spark, d, "events"), ["user_id"], "value").select("event_id", F.round("norm", 9).alias("norm"))


_GRID_SQL = "SELECT vec_id, i - 1 AS i, abs(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) AS t(i)"


@query(f"SELECT vec_id, round(sum(v), 5) AS mass, round(sum(v * (i % 8)) / sum(v), 5) AS cx, round(sum(v * (i // 8)) / sum(v), 5) AS cy FROM ({_GRID_SQL}) GROUP BY 1")
def center_of_mass(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("px"))
    got = images.center_of_mass(rows, "vec_id", "px", 8)
    return got.select("vec_id", *[F.round(c, 5).alias(c) for c in ("mass", "cx", "cy")])


@query("SELECT user_id, event_type, event_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def best_variant(spark, d):
    best = F.max_by("event_id", F.struct("value", -F.col("event_id")))
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(best.alias("best"))


_ITEM = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("""WITH k AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
h AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM k WHERE k >= n // 2)
SELECT l_orderkey, l_quantity AS q FROM h WHERE k = floor((n - 1) * 0.5)""")
def line_top(spark, d):
    return boxes.line_top(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice")


@query("""SELECT a.l_orderkey, a.l_linenumber, round(sum(w * t) / sum(w), 4) AS top_i FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a LEFT JOIN (
SELECT x.l_orderkey, x.l_linenumber, b.l_quantity AS t, b.l_discount * 1000 / 100 * CASE WHEN (x.l_linenumber - b.l_linenumber) ** 2 <= 10 THEN 1 ELSE 10.0 / (x.l_linenumber - b.l_linenumber) ** 2 END AS w
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) x JOIN lineitem b ON x.l_orderkey = b.l_orderkey AND b.l_discount * 1000 > 60) z ON a.l_orderkey = z.l_orderkey AND a.l_linenumber = z.l_linenumber GROUP BY 1, 2""")
def interpolate_top(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 1000).alias("corr"))
    good = rows.where("corr > 60").select(F.col("l_orderkey").alias("_by"), F.col("l_linenumber").alias("_x"), F.col("l_quantity").alias("_top"), F.col("corr").alias("_c"))
    spots = rows.select("l_orderkey", "l_linenumber").distinct()
    return boxes.interpolate_spots(spots, good, "l_orderkey", "l_linenumber").withColumn("top_i", F.round("top_i", 4))


# ---- order and lines --------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS before FROM l)
SELECT doc_id, CAST(before + j AS INTEGER) AS i, CAST(k - 1 AS BIGINT) AS line_no FROM o, range(0, length(line)) AS t(j)""")
def line_ids(spark, d):
    rows = stats.characters(table(spark, d, "documents"), ["doc_id"])
    return boxes.line_ids(rows, ["doc_id"], "i", F.col("ch") == "\n").where(F.col("ch") != "\n").select("doc_id", "i", "line_no")


@query("""WITH g AS (SELECT event_id, user_id, event_type, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 30 AS gap FROM events)
SELECT event_id, event_type AS symbol, FALSE AS inserted FROM g UNION ALL SELECT event_id, ' ', TRUE FROM g WHERE gap""")
def gap_spaces(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("_d", F.col("value") - F.lag("value").over(w))
    return boxes.insert_gaps(rows, "user_id", ["ts", "event_id"], F.col("_d") > 30, "event_type", " ").select("event_id", F.col("event_type").alias("symbol"), "inserted")


@query("""SELECT event_id, last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_down, first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled_up
FROM (SELECT *, CASE WHEN event_type = 'click' THEN value END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbor_fill(spark, d):
    rows = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "click", F.col("value")))
    return boxes.fill(rows, ["user_id"], ["ts", "event_id"], "v").select("event_id", "filled_down", "filled_up")


_IV_SQL = "SELECT l_suppkey, CAST(l_partkey AS BIGINT) * 10 AS lo, CAST(l_partkey * 10 + l_quantity AS BIGINT) AS hi FROM lineitem"


@query(f"""WITH s AS (SELECT *, max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({_IV_SQL})),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT l_suppkey, CAST(island AS BIGINT) AS island, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY l_suppkey, island""")
def interval_merge(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") * 10).alias("lo"), (F.col("l_partkey") * 10 + F.col("l_quantity")).cast("long").alias("hi"))
    return boxes.merge_intervals(rows, ["l_suppkey"], "lo", "hi", 2)


@query("""WITH g AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS gap FROM events),
r AS (SELECT *, sum(CASE WHEN gap < 1.5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY value RANGE UNBOUNDED PRECEDING) AS run FROM g), c AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY user_id, run)
SELECT user_id, CASE WHEN n > 1 THEN CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS cluster, sum(n)::BIGINT AS n
FROM c GROUP BY user_id, run, n""")
def dbscan_1d(spark, d):
    got = boxes.dbscan_1d(table(spark, d, "events"), ["user_id"], "value", 1.5)
    sized = got.where("cluster > 0").groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return sized.unionByName(got.where("cluster = 0").select("user_id", "cluster", F.lit(1).cast("long").alias("n")))


@query("""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
WHERE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / 64 < 0.112),
r AS (SELECT a AS node, a AS reach FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a) SELECT node, min(reach) AS comp FROM r GROUP BY node""")
def dbscan_nd(spark, d):
    return boxes.near_components(table(spark, d, "embeddings"), "vec_id", "embedding", 0.112)


#: Pages of 64 order numbers, so that a page has no more boxes at a larger scale.
_BOX_SQL = """SELECT l_orderkey // 64 AS page, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS key, l_extendedprice AS score,
CAST(l_partkey % 300 AS BIGINT) AS l, CAST(l_partkey % 300 + l_quantity AS BIGINT) AS r, CAST(l_suppkey * 3 AS BIGINT) AS t, CAST(l_suppkey * 3 + 20 AS BIGINT) AS b FROM lineitem"""


def _greedy_sql(order: str, clash: str) -> str:
    """Box after box of a page in order; kept is the list of those that stay, clash a condition on one of them (z) and the next (b)."""
    return f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {order}) AS k FROM ({_BOX_SQL})),
g AS (SELECT page, k, key, true AS ok, [{{'l': l, 'r': r, 't': t, 'b': b}}] AS kept FROM b WHERE k = 1
UNION ALL SELECT page, k, key, ok, CASE WHEN ok THEN list_append(kept, box) ELSE kept END FROM
(SELECT b.page, b.k, b.key, {{'l': b.l, 'r': b.r, 't': b.t, 'b': b.b}} AS box, g.kept, len(list_filter(g.kept, lambda z: {clash})) = 0 AS ok FROM g JOIN b ON b.page = g.page AND b.k = g.k + 1))
SELECT page, key FROM g WHERE ok"""


@query(_greedy_sql("score DESC, t, l, key", """greatest(0, least(z['r'], b.r) - greatest(z['l'], b.l)) * greatest(0, least(z['b'], b.b) - greatest(z['t'], b.t))
> 0.25 * least((z['r'] - z['l']) * (z['b'] - z['t']), (b.r - b.l) * (b.b - b.t))"""))
def nms_overlap(spark, d):
    rows = _rectangles(spark, d)
    return boxes.nms(rows, ["page"], "score", "key").select("page", "key")


def _rectangles(spark: SparkSession, d: str, page: str = "l_orderkey div 64") -> DataFrame:
    it = table(spark, d, "lineitem")
    return it.select(F.expr(page).alias("page"), F.concat_ws("-", *[F.col(c).cast("string") for c in _ITEM]).alias("key"), F.col("l_extendedprice").alias("score"), (F.col("l_partkey") % 300).cast("long").alias("l"), F.rint(F.col("l_partkey") % 300 + F.col("l_quantity")).cast("long").alias("r"), (F.col("l_suppkey") * 3).cast("long").alias("t"), (F.col("l_suppkey") * 3 + 20).cast("long").alias("b"))  # fmt: skip


@query(_greedy_sql("score DESC, key", "abs(z['l'] - b.l) <= 9 AND abs(z['t'] - b.t) <= 9"))
def peak_suppress(spark, d):
    rows = _rectangles(spark, d).select("page", "key", "score", F.col("l").alias("x"), F.col("t").alias("y"))
    return boxes.peak_suppress(rows, ["page"], "score", "key").select("page", "key")


@query(f"""WITH RECURSIVE b AS (SELECT *, score % 100 AS corr, row_number() OVER (PARTITION BY page ORDER BY l, key) AS k FROM ({_BOX_SQL})),
g AS (SELECT page, k, CAST(1 AS BIGINT) AS slot, l, r, corr, key FROM b WHERE k = 1
UNION ALL SELECT page, k, CASE WHEN clash THEN slot ELSE slot + 1 END, CASE WHEN old THEN l ELSE bl END, CASE WHEN old THEN r ELSE br END, CASE WHEN old THEN corr ELSE bcorr END, CASE WHEN old THEN key ELSE bkey END FROM
(SELECT *, clash AND bcorr <= corr AS old FROM (SELECT *, shared > CAST(0.8 AS DOUBLE) * width OR shared > 0.5 * width AND abs(corr - bcorr) >= 10 OR shared > 0.25 * width AND abs(corr - bcorr) >= 30 AS clash FROM
(SELECT b.page, b.k, g.slot, g.l, g.r, g.corr, g.key, b.l AS bl, b.r AS br, b.corr AS bcorr, b.key AS bkey, least(g.r, b.r) - greatest(g.l, b.l) AS shared, greatest(1, least(g.r - g.l, b.r - b.l)) AS width
FROM g JOIN b ON b.page = g.page AND b.k = g.k + 1))))
SELECT page, key FROM (SELECT page, key, row_number() OVER (PARTITION BY page, slot ORDER BY k DESC) AS last FROM g) WHERE last = 1""")
def adjacent_overlaps(spark, d):
    rows = _rectangles(spark, d).withColumn("corr", (F.col("score") % 100).cast("double"))
    return boxes.eliminate_overlaps(rows, ["page"], ["l", "key"], ((0.8, 0), (0.5, 10), (0.25, 30))).select("page", "key")


# ---- classes, aliases and edits ---------------------------------------------------------------------------------------

_ALIAS_SQL = "SELECT 'n' || n_nationkey AS src, CASE WHEN n_nationkey >= 5 THEN 'n' || (n_nationkey // 2) ELSE 'r' || n_regionkey END AS dst FROM nation"
_ROOT_SQL = f"WITH RECURSIVE a AS ({_ALIAS_SQL}), c AS (SELECT src, dst, 1 AS depth FROM a UNION ALL SELECT c.src, a.dst, depth + 1 FROM c JOIN a ON c.dst = a.src WHERE depth < 64)"


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    target = F.when(F.col("n_nationkey") >= 5, F.concat(F.lit("n"), F.floor(F.col("n_nationkey") / 2).cast("string"))).otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), target.alias("dst"))


@query(_ROOT_SQL + "SELECT src, arg_max(dst, depth) AS root FROM c GROUP BY src")
def alias_root(spark, d):
    return joins.alias_roots(_aliases(spark, d))


@query(_ROOT_SQL + ", r AS (SELECT src, arg_max(dst, depth) AS root FROM c GROUP BY src) SELECT root, string_agg(src, ',' ORDER BY src) AS members, count(*) AS n FROM r GROUP BY root")
def alias_class(spark, d):
    return joins.alias_roots(_aliases(spark, d)).groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("members"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, substr(p_name, 1, k) AS prefix, CAST(v AS INTEGER) AS var FROM part, range(1, 5) AS t(k), range(0, 3) AS u(v) WHERE substr(p_name, 1, k) IN (SELECT substr(p_name, 1, 3) FROM part WHERE p_size < 5) AND k <= length(p_name)")
def candidate_prefixes(spark, d):
    p = table(spark, d, "part")
    known = p.where("p_size < 5").select(F.substring("p_name", 1, 3).alias("prefix")).distinct()
    lengths = F.sequence(F.lit(1), F.least(F.lit(4), F.length("p_name")))
    rows = p.select("p_partkey", F.explode(F.transform(lengths, lambda k: F.substring(F.col("p_name"), F.lit(1), k))).alias("prefix"))
    return rows.join(known, "prefix", "left_semi").select("p_partkey", "prefix", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("var"))


@query("SELECT event_type, CAST(user_id % 4 AS INTEGER) AS style, count(*) AS n FROM events GROUP BY 1, 2")
def class_list(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 4).cast("int").alias("style")).agg(F.count(F.lit(1)).alias("n")).orderBy("style", "event_type")


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id % 4 = 1")
def class_filter(spark, d):
    return table(spark, d, "events").where("event_type = 'click' and user_id % 4 = 1").select("event_id", "value").orderBy(F.desc("value"), "event_id")


_RECT_SQL = "SELECT l_orderkey % 500 AS page, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS key, l_extendedprice AS score, l_partkey % 300 AS l, CAST(l_partkey % 300 + l_quantity AS BIGINT) AS r, l_suppkey * 3 AS t, l_suppkey * 3 + 20 AS b FROM lineitem"


@query(f"SELECT page, min(score) AS score FROM ({_RECT_SQL}) WHERE l < 150 AND 150 < r AND t < 100 AND 100 < b GROUP BY page")
def point_in_box(spark, d):
    return _rectangles(spark, d, "l_orderkey % 500").where("l < 150 and 150 < r and t < 100 and 100 < b").groupBy("page").agg(F.min("score").alias("score"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events), g AS (SELECT *, sum(CASE WHEN prev THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS grp
FROM (SELECT *, coalesce(lag(value > 60) OVER (PARTITION BY user_id ORDER BY no), FALSE) AS prev FROM e))
SELECT user_id, CAST(min(no) AS INTEGER) AS no, string_agg(substr(event_type, 1, 1), '' ORDER BY no) AS chr, min(value) AS l, max(value) AS r, CAST(min(event_id) AS BIGINT) AS t, CAST(max(event_id) AS BIGINT) AS b FROM g GROUP BY user_id, grp""")
def row_edits_merge(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", F.row_number().over(w).alias("no"), F.substring("event_type", 1, 1).alias("chr"), F.col("value").alias("l"), F.col("value").alias("r"), F.col("event_id").alias("t"), F.col("event_id").alias("b"))
    return boxes.merge_boxes(rows, ["user_id"], "no", F.col("l") > 60)


@query("""WITH p AS (SELECT p_partkey, p_name AS chr, CAST(p_size AS BIGINT) AS l, CAST(p_size + 40 AS BIGINT) AS r FROM part), c AS (SELECT *, l + CAST(floor((r - l) / greatest(2, length(chr))) AS BIGINT) AS cut FROM p)
SELECT p_partkey, 0 AS part, substr(chr, 1, 1) AS chr, l, cut AS r FROM c UNION ALL SELECT p_partkey, 1, CASE WHEN length(chr) > 1 THEN substr(chr, 2) ELSE '??' END, cut, r FROM c""")
def row_edits_split(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("chr"), F.col("p_size").cast("long").alias("l"), (F.col("p_size") + 40).cast("long").alias("r"))
    return boxes.split_boxes(rows)


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size - 2 ELSE p_size END AS l, CASE WHEN p_size > 25 THEN p_size + 43 ELSE p_size + 40 END AS r FROM part")
def row_edits_resize(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("l"), (F.col("p_size") + 40).alias("r"), F.lit(0).alias("t"), F.lit(1).alias("b"), (F.col("p_size") > 25).alias("sel"))
    return boxes.resize(rows, F.col("sel"), dl=-2, dr=3).select("p_partkey", "l", "r")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'x' ELSE p_name END AS chr, CASE WHEN p_size > 25 THEN 3 ELSE p_size END AS style FROM part")
def row_edits_reclassify(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("chr"), F.col("p_size").alias("style"))
    return boxes.reclassify(rows.withColumn("sel", F.col("style") > 25), F.col("sel"), chr="x", style=3).drop("sel")


@query("""SELECT p_partkey, CASE WHEN NOT sel THEN style WHEN bool_and(CASE WHEN sel THEN style & 2 <> 0 END) OVER (PARTITION BY p_brand) THEN style & ~2 ELSE style | 2 END AS style FROM (SELECT p_partkey, p_brand, p_size AS style, p_size > 45 AS sel FROM part)""")
def row_edits_toggle(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").alias("style"), (F.col("p_size") > 45).alias("sel"))
    return boxes.toggle_style(rows, ["p_brand"], F.col("sel"), "style", 2).select("p_partkey", "style")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity >= 20 AND NOT (l_quantity < 40 AND l_returnflag IN ('A', 'N')) GROUP BY 1, 2")
def confidence_filter(spark, d):
    rows = table(spark, d, "lineitem").withColumn("c", F.translate("l_returnflag", "AN", ",."))
    return rows.where(boxes.confident("l_quantity", "c")).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_nationkey, CAST((CASE WHEN contains(h, '*') THEN 1 ELSE 0 END) | (CASE WHEN contains(h, '_') THEN 2 ELSE 0 END) | (CASE WHEN contains(h, '^') THEN 4 ELSE 0 END) AS INTEGER) AS style, substr(x, CAST(length(h) AS INTEGER) + 1) AS rest
FROM (SELECT n_nationkey, x, regexp_extract(x, '^[*_^]*') AS h FROM (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '*_' WHEN 1 THEN '^' WHEN 2 THEN '__' ELSE '' END || n_name AS x FROM nation))""")
def prefix_codec(spark, d):
    k = F.col("n_nationkey") % 4
    x = F.concat(F.when(k == 0, "*_").when(k == 1, "^").when(k == 2, "__").otherwise(""), "n_name")
    return boxes.decode_prefix(table(spark, d, "nation").select("n_nationkey", x.alias("x")), "n_nationkey", "x", {"*": 1, "_": 2, "^": 4})


_SCANS = [("scan-1-0001.png",), ("scan-1-1160.png",), ("scan-2-0001.png",), ("scan-2-0042.png",)]


@query(f"""SELECT name, CASE WHEN vol = 1 AND no = 1160 THEN 'scan-2-0001.png' ELSE 'scan-' || vol || '-' || lpad(CAST(no + 1 AS VARCHAR), 4, '0') || '.png' END AS next,
CASE WHEN vol = 2 AND no = 1 THEN 'scan-1-1160.png' WHEN no = 1 THEN NULL ELSE 'scan-' || vol || '-' || lpad(CAST(no - 1 AS VARCHAR), 4, '0') || '.png' END AS prev
FROM (SELECT name, CAST(regexp_extract(name, '-(\\d)-', 1) AS INTEGER) AS vol, CAST(regexp_extract(name, '(\\d+)\\.png', 1) AS INTEGER) AS no FROM {values(_SCANS, 'name')})""".replace("\\\\", "\\"))
def scan_nav(spark, d):
    vol, no = F.regexp_extract("name", r"-(\d)-", 1).cast("int"), F.regexp_extract("name", r"(\d+)\.png", 1).cast("int")
    spell = lambda v, n: F.concat(F.lit("scan-"), v.cast("string"), F.lit("-"), F.lpad(n.cast("string"), 4, "0"), F.lit(".png"))  # noqa: E731
    after = F.when((vol == 1) & (no == 1160), "scan-2-0001.png").otherwise(spell(vol, no + 1))
    before = F.when((vol == 2) & (no == 1), "scan-1-1160.png").when(no > 1, spell(vol, no - 1))
    return literals(spark, _SCANS, "name string").select("name", after.alias("next"), before.alias("prev"))


@query("SELECT DISTINCT k FROM (SELECT p_brand AS k FROM part UNION ALL SELECT event_type FROM events UNION ALL SELECT lang FROM documents)")
def union_keys(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("k")).distinct() for t, c in (("part", "p_brand"), ("events", "event_type"), ("documents", "lang"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, [CAST(length(text) % 8 AS INTEGER), CAST((length(text) // 8) % 8 AS INTEGER)] AS o FROM conversations),
p AS (SELECT conv_id, k, unnest(o) AS s FROM t), r AS (SELECT conv_id, k, s, 0 AS cost FROM p WHERE k = 1 UNION ALL
SELECT r.conv_id, p.k, p.s, CAST(r.cost + bit_count(r.s # p.s) AS INTEGER) FROM r JOIN (SELECT DISTINCT * FROM p) p ON p.conv_id = r.conv_id AND p.k = r.k + 1)
SELECT conv_id, min(cost) AS cost FROM r WHERE k = (SELECT max(k) FROM t WHERE t.conv_id = r.conv_id) GROUP BY conv_id""".replace("r.s # p.s", "xor(r.s, p.s)"))
def style_viterbi(spark, d):
    n = F.length("text")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.array((n % 8).cast("int"), (F.floor(n / 8) % 8).cast("int")).alias("o"))
    return boxes.style_paths(rows, "conv_id", "turn", "o").select("conv_id", "cost")


@query("""WITH RECURSIVE c AS (SELECT vec_id, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y, i FROM embeddings, range(1, 65) AS t(i) WHERE abs(embedding[i]) > 0.1),
r AS (SELECT vec_id, i AS node, i AS reach FROM c UNION SELECT r.vec_id, r.node, b.i FROM r JOIN c a ON a.vec_id = r.vec_id AND a.i = r.reach JOIN c b ON b.vec_id = a.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
g AS (SELECT vec_id, node, min(reach) AS comp FROM r GROUP BY vec_id, node)
SELECT vec_id, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b, count(*) AS n FROM g JOIN c USING (vec_id) WHERE c.i = g.node GROUP BY vec_id, comp""")
def segment_components(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v)).alias("px"))
    return images.segment(rows, "vec_id", "px", 8, 0.1).drop("seg")


_GLYPH = np.array([[1.0, 0.0], [0.0, 1.0]])


@query("""WITH c AS (SELECT vec_id, i, abs(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) AS t(i)),
s AS (SELECT a.vec_id, CAST((a.i - 1) % 8 AS INTEGER) AS dx, CAST((a.i - 1) // 8 AS INTEGER) AS dy, round((a.v - b.v - e.v + f.v) / 2, 9) AS corr FROM c a JOIN c b ON b.vec_id = a.vec_id AND b.i = a.i + 1
JOIN c e ON e.vec_id = a.vec_id AND e.i = a.i + 8 JOIN c f ON f.vec_id = a.vec_id AND f.i = a.i + 9 WHERE (a.i - 1) % 8 < 7)
SELECT vec_id, round(max(corr), 6) AS corr FROM s GROUP BY vec_id""")
def template_match(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v)).alias("px"))
    return images.template_match(rows, "vec_id", "px", 8, [("diagonal", _GLYPH)], -1.0).select("vec_id", F.round("corr", 6).alias("corr"))


@query(f"SELECT CAST(vec_id % 20 + i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, round(sum(v), 5) AS ink FROM ({_GRID_SQL}) GROUP BY 1, 2")
def composite_mask(spark, d):
    c = images.cells(table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("px")), "vec_id", "px", 8)
    got = images.composite(c, [], (F.col("vec_id") % 20 + F.col("x")).cast("int"), F.col("y"), F.col("ink"))
    return got.select("x", "y", F.round("ink", 5).alias("ink"))


@query("SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS text FROM events GROUP BY user_id")
def text_from_boxes(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", F.row_number().over(w).alias("box_no"), F.substring("event_type", 1, 1).alias("chr"))
    return boxes.text_of_boxes(rows, ["user_id"], "box_no")


# ---- tables of a project ----------------------------------------------------------------------------------------------

_CLASS_SQL = "SELECT CAST(p_size % 4 AS INTEGER) AS style, p_brand AS chr, CAST(p_size % 3 AS INTEGER) AS var FROM part"
_ALIASED_SQL = "SELECT DISTINCT style, chr, var, CAST(0 AS INTEGER) AS target_style, chr AS target_chr, var AS target_var FROM k WHERE style IN (0, 1) AND var = 0"


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select((F.col("p_size") % 4).cast("int").alias("style"), F.col("p_brand").alias("chr"), (F.col("p_size") % 3).cast("int").alias("var"))


def _aliased(classes: DataFrame) -> DataFrame:
    return classes.where("style in (0, 1) and var = 0").distinct().select("style", "chr", "var", F.lit(0).alias("target_style"), F.col("chr").alias("target_chr"), F.col("var").alias("target_var"))


@query(f"""WITH k AS ({_CLASS_SQL}), a AS ({_ALIASED_SQL}), u AS (SELECT style, chr, var FROM k UNION SELECT style, chr, var FROM a),
l AS (SELECT u.*, target_style, target_chr, target_var FROM u LEFT JOIN a USING (style, chr, var)),
r AS (SELECT style, chr, var, CASE WHEN var = 2 THEN 3 WHEN chr LIKE '%1' THEN NULL ELSE target_style END AS ts, CASE WHEN var <> 2 AND chr LIKE '%1' THEN NULL ELSE target_chr END AS tc, CASE WHEN var <> 2 AND chr LIKE '%1' THEN NULL ELSE target_var END AS tv FROM l)
SELECT style, chr, var, CAST(coalesce(ts, style) AS INTEGER) AS target_style, coalesce(tc, chr) AS target_chr, coalesce(tv, var) AS target_var FROM r
WHERE coalesce(ts, style) <> style OR coalesce(tc, chr) <> chr OR coalesce(tv, var) <> var""")
def alias_edits(spark, d):
    classes = _classes(spark, d)
    listed = registry.alias_list(classes, _aliased(classes))
    reset = registry.reset_aliases(listed, (F.col("var") != 2) & F.col("chr").endswith("1"))
    return registry.alias_map(registry.restyle_aliases(reset, F.col("var") == 2, 3))


@query(f"WITH k AS ({_CLASS_SQL}), a AS ({_ALIASED_SQL}) SELECT max(var) AS max_var, CAST(max(length(chr)) AS INTEGER) AS max_length FROM (SELECT chr, var FROM k UNION ALL SELECT chr, var FROM a)")
def key_bounds(spark, d):
    classes = _classes(spark, d)
    return registry.key_bounds(classes, _aliased(classes))


@query("""WITH g AS (SELECT event_id, user_id, CAST(event_id % 8 AS INTEGER) AS style, event_type = 'click' AS blank, row_number() OVER w AS no,
first_value(CASE WHEN event_type <> 'click' THEN event_id % 8 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(CASE WHEN blank AND no > 1 THEN style & coalesce(after, 0) ELSE style END AS INTEGER) AS style FROM g""")
def white_space_styles(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    chr_ = F.when(F.col("event_type") == "click", F.lit(boxes.SPACE)).otherwise(F.substring("event_type", 1, 1))
    rows = table(spark, d, "events").select("event_id", "user_id", F.row_number().over(w).alias("no"), (F.col("event_id") % 8).cast("int").alias("style"), chr_.alias("chr"))
    return registry.white_space_styles(rows, ["user_id"], "no").select("event_id", "style")


@query("""WITH k AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_returnflag <> 'R'),
h AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM k WHERE k >= n // 2),
t AS (SELECT l_orderkey, l_quantity AS q FROM h WHERE k = floor((n - 1) * 0.5)) SELECT l_orderkey, l_linenumber, coalesce(q, l_quantity) AS top FROM lineitem LEFT JOIN t USING (l_orderkey)""")
def straighten_lines(spark, d):
    chr_ = F.when(F.col("l_returnflag") == "R", F.lit(boxes.SPACE)).otherwise(F.col("l_returnflag"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).alias("line_no"), chr_.alias("chr"), F.col("l_quantity").alias("t"), F.col("l_extendedprice").alias("corr"))
    return registry.straighten(rows, ["l_orderkey"]).select("l_orderkey", "l_linenumber", F.col("t").alias("top"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events WHERE value > -1) WHERE k = 1")
def confusable_best(spark, d):
    return registry.best_candidate(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "value", "event_id")


@query(f"SELECT count(*) AS total, count(start) AS attributed, CAST(sum(CASE WHEN start IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM (SELECT l.event_id, max(r.pos) AS start FROM ({_LEFT}) l LEFT JOIN ({_RIGHT}) r ON l.user_id = r.user_id AND r.pos <= l.pos GROUP BY l.event_id)")
def attribution_coverage(spark, d):
    return registry.attribution_coverage(block_asof(spark, d), "start")


@query(r"""WITH p AS (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS part, unnest(g) AS gap FROM (SELECT doc_id, string_split_regex(s, '

+') AS p, list_concat(regexp_extract_all(s, '

+'), ['']) AS g
FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)) AS s FROM documents))),
o AS (SELECT *, sum(length(part) + length(gap)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(part) - length(gap) AS start FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS part_no, md5(part) AS digest, CAST(start AS BIGINT) AS start FROM o WHERE regexp_matches(part, '[^ 	

]')""")
def blank_line_split(spark, d):
    broken = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n\n"))
    parts = registry.blank_line_parts(table(spark, d, "documents").select("doc_id", broken.alias("s")), "doc_id", "s")
    return parts.select("doc_id", "part_no", F.md5("part").alias("digest"), "start")
