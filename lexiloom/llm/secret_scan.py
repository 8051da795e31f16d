"""Secret scans: rules find candidates, a random forest removes the false ones. DataFrame and SQL functions only.

A candidate is an unbroken run of LEAST or more key characters, or one of LEAST_ASSIGNED or more right after a name of SECRET_NAMES
and an assignment; a name and assignment at its start don't belong to it. Its features are length, character transitions, shares of
digits, letters and hexadecimals, distinct characters, coverage by dictionary words, path and address marks, an assignment
before it, and the neighbouring words. Values count at any length.
The forest is trained on labelled_findings, a seeded table of true and false findings of TRAINING rows, by Spark's own
library; its trees then become one CASE expression.

All is done inside the row: one pattern cuts the text into pieces (what stands before a candidate, and the candidate), and
higher-order functions judge the pieces. Nothing is shuffled, and redaction joins the pieces again.

Defined results: null text is empty and has no candidates, and stays null; a value that occurs more than once in a document is one
finding with its first place, the number of its places and its highest vote; a null doc_id is like any other; repeated rows
give repeated findings; an empty table gives an empty result; columns of any name are carried by redact.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, written

LEAST, LEAST_ASSIGNED = 16, 6
#: Pieces whose lengths are added up together.
ADDED = 256
TRAINING = 9_000
TREES, DEPTH = 20, 6
ACCEPT = 0.5
MASK = "[SECRET]"

#: Names that assign secrets, words around harmless hashes, and dictionary words that identifiers are made of.
SECRET_NAMES = "api|apikey|auth|authorization|bearer|client_secret|credential|credentials|key|passwd|password|private|pwd|secret|secret_key|token"
HASH_NAMES = "blob|build|checksum|commit|digest|etag|guid|hash|id|index|md5|merge|rev|revision|sha|sha1|sha256|tree|uuid|version"
DICTIONARY = (
    "abstract access account action address admin agent alpha archive array assets async auth author backup base batch beta binary block body branch "
    "bucket buffer build button cache call chain change channel char check class clean click client close cloud code column command comment commit "
    "common compare config connect console const content context control cookie copy core count create current data database date debug default delete "
    "deploy design detail device digest direct disk display document domain download draft driver dump edit element email empty enable encode end engine "
    "entry error event example export extension factory feature field file filter final find first folder font format frame function global graph group "
    "handler hash header height help hidden home host html http image import index info init input insert instance item java join json key label language "
    "large layout length level library license limit line link linux list load local location lock log login long lower main manager map mark master match "
    "media member memory menu merge message meta method min mode model module month mount move name native network next node note null number object "
    "offset open option order output owner package page panel parent parse password patch path pattern payload people place player plugin point policy "
    "pool port post prefix print private process product profile program project property proxy public query queue random range read record release "
    "remote remove render replace report request reset resource response result return role root route row rule sample scale scan schema scope script "
    "search second secret section select server service session set setting share shell show single size small sort source space spec stack start state "
    "static status step stop storage store stream string style submit subject suffix super support switch symbol sync system table target task template "
    "temp test text theme thread time title token tool total trace track transfer transform tree type undefined union unit update upload upper user util "
    "value vector version video view virtual visible wait warning web width window word work world write year zone"
).split()

FEATURES = ("n", "switches", "digits", "uppers", "lowers", "hexes", "distinct", "covered", "slashes", "dots", "ats", "other", "assigned", "quoted", "near_secret", "near_hash")
_KEY = "[A-Za-z0-9_+/.=@:~-]"
_QUOTE = r"[\x22\x27\x60]"
#: A name, what assigns it, and an opening quote.
_LEAD = rf"^(?:[A-Za-z_]{{2,24}})?{_QUOTE}?[ ]{{0,2}}[=:]+[ ]{{0,2}}{_QUOTE}?(?={_KEY})"
_RUN = rf"(?<!{_KEY})(?:{_KEY}{{{LEAST},}}+|(?i:{SECRET_NAMES}){_QUOTE}?[ ]{{0,2}}[=:][ ]{{0,2}}{_QUOTE}?{_KEY}{{{LEAST_ASSIGNED},}}+)"
#: What stands before a run, and the run; the last piece is what follows the last run.
_PIECE = rf"(?s)(.*?)(?:({_RUN})|\z)"


def _r(pattern: str) -> str:
    """A pattern as SQL, with backslashes as they are."""
    return "r'" + pattern + "'"


def _features() -> dict[str, str]:
    """SQL over v.value, v.name, v.token, v.before and v.before2."""
    share = lambda pattern: f"size(regexp_extract_all(v.value, {_r(pattern)}, 0)) / length(v.value)"
    context = "lower(concat_ws(' ', v.name, v.before2, v.before))"
    word = lambda names: f"cast(rlike({context}, {_r(rf'(^|[^a-z0-9])({names})([^a-z0-9]|$)')}) as double)"
    longest = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    return {
        "n": "cast(length(v.value) as double)",
        "switches": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z]{2})[a-z]"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "hexes": share("[0-9a-f]"),
        "distinct": "size(array_distinct(split(v.value, ''))) / least(length(v.value), 40)",
        "covered": f"(length(v.value) - length(regexp_replace(lower(v.value), {_r(longest)}, ''))) / length(v.value)",
        "slashes": share("[/]"),
        "dots": share("[.]"),
        "ats": share("[@:]"),
        "other": share("[_+=~-]"),
        "assigned": "cast(v.name <> '' as double) + cast(rlike(v.before, '[=:]$') as double)",
        "quoted": f"cast(rlike(v.token, {_r(f'^{_QUOTE}|{_QUOTE}[,;)]*$')}) as double)",
        "near_secret": word(SECRET_NAMES),
        "near_hash": word(HASH_NAMES),
    }


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to rows of value, name, token, before and before2."""
    rows = found.withColumn("v", F.struct("value", "name", "token", "before", "before2"))
    return rows.select("*", *[F.expr(x).cast("double").alias(n) for n, x in _features().items()]).drop("v")


def _parts(text: Column) -> Column:
    """The pieces of a text: gap (what stands before), lead, value, whether it is a candidate, and what its features are made of."""
    gaps, runs = (F.regexp_extract_all(text, F.lit(_PIECE), F.lit(k)) for k in (1, 2))

    def cut(gap: Column, run: Column) -> Column:
        lead = F.regexp_extract(run, _LEAD, 0)
        return F.struct(gap.alias("gap"), lead.alias("lead"), F.substring(run, F.length(lead) + 1, F.length(run)).alias("value"), F.split(gap, r"[\x20\x09-\x0D]+").alias("words"))

    def near(pieces: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(pieces, i - 1)["value"]).otherwise(F.lit(""))  # the run before
            words = F.concat(F.array(F.lit(""), F.lit(""), before), F.transform(F.slice(p["words"], -F.least(F.size(p["words"]), F.lit(3)), F.lit(3)), lambda w: w))
            head = F.concat(F.element_at(words, -1), p["lead"])
            name = F.lower(F.regexp_extract(head, r"""([A-Za-z_]{2,24})["'`]*[ ]{0,2}[=:(\[]+[ ]{0,2}["'`]*$""", 1))
            # a word that stands before the run in its token, without assigning it, is its neighbour
            inner = F.when(name == "", F.regexp_extract(F.element_at(words, -1), "([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1)).otherwise("")
            moved = inner != ""
            left, right = F.regexp_extract(head, "[\"'`]?$", 0), F.regexp_extract(F.coalesce(F.get(pieces, i + 1)["gap"], F.lit("")), "^[\"'`]?", 0)
            secret = F.regexp_like(name, F.lit(f"^({SECRET_NAMES})$"))
            return F.struct(
                p["gap"], p["lead"], p["value"], ((F.length(p["value"]) >= LEAST) | ((F.length(p["value"]) >= LEAST_ASSIGNED) & secret)).alias("candidate"),
                name.alias("name"), F.concat(left, p["value"], right).alias("token"),
                F.when(moved, inner).otherwise(F.element_at(words, -2)).alias("before"), F.when(moved, F.element_at(words, -2)).otherwise(F.element_at(words, -3)).alias("before2"),
            )

        return F.transform(pieces, one)

    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return bind(F.zip_with(gaps, runs, cut), near)


def _judged(docs: DataFrame, forest: list[str], name: str) -> DataFrame:
    """docs with the judged pieces of each text in column name; null for texts without any run."""
    text = F.col("text").cast("string")
    rows = docs.withColumn(name, F.when(text.rlike(_RUN), _parts(text)))
    made = ", ".join(f"'{n}', cast({x} as double)" for n, x in _features().items())
    rows = rows.withColumn(name, F.expr(f"transform({name}, v -> named_struct('gap', v.gap, 'lead', v.lead, 'value', v.value, 'candidate', v.candidate, 'f', if(v.candidate, named_struct({made}), null)))"))
    vote = " + ".join(f"({re.sub(r'WHEN ([a-z_]+)', r'WHEN v.f.\1', t)})" for t in forest)
    return rows.withColumn(name, F.expr(f"transform({name}, v -> named_struct('gap', v.gap, 'lead', v.lead, 'value', v.value, 'vote', if(v.candidate, ({vote}) / {len(forest)}, null)))"))


def labelled_findings(spark: SparkSession, rows: int = TRAINING) -> DataFrame:
    """True and false findings with label; a table of fixed size, made from seeded hashes by SQL functions alone."""
    draw = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 512)
    number = lambda k: F.conv(F.substring(draw(k), 1, 8), 16, 10).cast("long")
    words = F.array(*map(F.lit, DICTIONARY))
    upper = F.concat(F.upper(F.conv(F.substring(draw("up"), 1, 15), 16, 36)), F.upper(F.conv(F.substring(draw("up"), 16, 15), 16, 36)))
    drawn = {"hexes": draw("hex"), "b64": F.translate(F.base64(F.unhex(draw("b64"))), "+/=", "xYz"), "upper": upper, "digits": F.translate(F.substring(draw("hex"), 1, 24), "abcdef", "194752")}
    drawn |= {f"word_{k}": F.get(words, (number(k) % len(DICTIONARY)).cast("int")) for k in ("filler", "f2", "a", "b", "c", "d")}
    drawn |= {f"pick_{k}": number(k) for k in ("c", "s", "h", "p", "n", "n2", "eq", "pw")}
    # the draws are computed once, before the kinds: an explode keeps them out of the kinds' expression
    base = spark.range(0, rows, 1, 1).select("id", F.explode(F.array(F.struct(*[c.alias(n) for n, c in drawn.items()]))).alias("d")).select("id", "d.*")
    hexes, b64, upper, digits = map(F.col, ("hexes", "b64", "upper", "digits"))
    pick = lambda k, m: F.col(f"pick_{k}") % m
    word = lambda k: F.col(f"word_{k}")
    some = lambda k, names: F.get(F.array(*map(F.lit, names)), pick(k, len(names)).cast("int"))
    filler = word("filler")
    secret, harmless = some("s", SECRET_NAMES.split("|")), some("h", HASH_NAMES.split("|"))
    cut = lambda text, k, low, high: F.substring(text, F.lit(1), (low + pick(k, high - low)).cast("int"))
    e = F.lit("")
    letters = cut(F.translate(hexes, "0123456789", "inortsuhle"), "n", 16, 30)
    kinds = [  # label, value, name, quote, before, before2
        (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), e, e, filler, word("f2")),
        (1, F.concat(F.lit("AKIA"), F.translate(F.substring(hexes, 1, 16), "0123456789abcdef", "QW3RTY4UAS7DFGHJ")), e, e, filler, word("f2")),
        (1, F.concat(some("p", ["AKIA", "ASIA", "AGPA"]), F.translate(F.substring(hexes, 30, 16), "0123456789abcdef", "ZX2CVB5N6MKLPOIE")), some("n2", ["", "", "key"]), e, filler, word("f2")),
        (1, F.concat(some("p", ["ghp_", "sk_live_", "xoxb-", "pk-", "glpat-", "AIza"]), cut(b64, "c", 24, 44)), e, e, filler, word("f2")),
        (1, cut(hexes, "c", 32, 65), e, F.lit('"'), F.lit("="), secret),
        (1, cut(hexes, "c", 16, 41), secret, e, filler, word("f2")),
        (1, cut(b64, "c", 20, 60), secret, e, filler, word("f2")),
        (1, cut(b64, "c", 20, 60), e, F.lit('"'), some("eq", ["=", ":"]), secret),
        (1, cut(b64, "c", 6, 16), secret, e, filler, word("f2")),
        (1, F.concat(F.translate(F.substring(hexes, 1, 4), "0123456789", "ghkmnpqrst"), F.substring(hexes, 7, 4), F.substring(digits, 1, 2)), secret, F.lit('"'), filler, word("f2")),
        (1, F.concat(F.initcap(F.translate(F.substring(hexes, 1, 7), "0123456789", "ghkmnpqrst")), F.substring(digits, 1, 3)), some("pw", ["password", "passwd", "pwd", "secret"]), e, filler, word("f2")),
        (1, F.translate(F.substring(hexes, 1, 24), "0123456789", "ghkmnpqrst"), secret, e, filler, word("f2")),
        (0, letters, e, e, filler, word("f2")),
        (0, F.initcap(letters), e, e, filler, word("f2")),
        (0, F.concat(letters, some("p", [".", "--", "...", "~"])), e, e, filler, word("f2")),
        (0, F.concat(word("a"), word("b"), word("c"), word("d")), e, e, filler, word("f2")),
        (0, F.upper(letters), e, e, filler, word("f2")),
        (0, F.concat(word("a"), word("b")), secret, e, filler, word("f2")),
        (0, F.concat(word("a"), F.lit("_"), word("b")), secret, e, filler, word("f2")),
        (0, F.concat(word("a"), F.lit("."), word("b")), secret, F.lit('"'), filler, word("f2")),
        (0, F.concat(word("a"), F.lit("s")), secret, e, filler, word("f2")),
        (0, F.substring(hexes, 1, 40), e, e, harmless, filler),
        (0, cut(hexes, "c", 32, 65), harmless, e, filler, word("f2")),
        (0, F.regexp_replace(F.substring(hexes, 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), e, e, filler, word("f2")),
        (0, F.concat(F.lit("https://"), word("a"), F.lit("."), word("b"), F.lit(".com/"), word("c"), F.lit("/"), F.substring(hexes, 1, 6)), e, e, filler, word("f2")),
        (0, F.concat(F.lit("/"), word("a"), F.lit("/"), word("b"), F.lit("/"), word("c"), F.substring(digits, 1, 3), F.lit(".txt")), e, e, filler, word("f2")),
        (0, F.concat(word("a"), F.initcap(word("b")), F.initcap(word("c")), F.initcap(word("d")), F.substring(digits, 1, 2)), e, e, filler, word("f2")),
        (0, F.concat(word("a"), F.lit("_"), word("b"), F.lit("_"), word("c"), F.lit("_"), F.substring(digits, 1, 4)), some("n", ["", "", "value", "name", "path", "password"]), e, filler, word("f2")),
        (0, F.concat(F.substring(F.translate(hexes, "0123456789", "ghijklmnop"), 1, 6), F.lit("."), F.substring(digits, 1, 2), F.lit("@"), word("b"), F.lit(".example.com")), e, e, filler, word("f2")),
        (0, F.substring(digits, 1, 16), e, e, filler, word("f2")),
        (0, F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 5, 2), F.lit("T"), F.substring(digits, 7, 2), F.lit(":"), F.substring(digits, 9, 2)), e, e, filler, word("f2")),
        (0, F.concat(F.upper(word("a")), F.upper(word("b")), F.upper(word("c")), F.substring(digits, 1, 1)), e, e, filler, word("f2")),
        (0, F.concat(word("a"), F.lit("-"), F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 2), F.lit("."), F.substring(digits, 4, 1), F.lit("-"), word("b"), F.lit(".tar.gz")), e, e, filler, word("f2")),
        (0, F.repeat(F.concat(F.substring(hexes, 1, 1), F.lit("1")), 12), e, e, filler, word("f2")),
    ]
    kind = (F.col("id") % len(kinds)).cast("int")
    struct = lambda i: F.struct(F.lit(float(kinds[i][0])).alias("label"), *(c.alias(n) for c, n in zip(kinds[i][1:], ("value", "name", "quote", "before", "before2"), strict=True)))
    row = F.when(kind == 0, struct(0))
    for i in range(1, len(kinds)):
        row = row.when(kind == i, struct(i))
    out = base.select(F.explode(F.array(row)).alias("r")).select("r.*")
    token = F.concat(F.when(F.col("name") != "", F.concat("name", F.lit("="))).otherwise(""), "quote", "value", "quote")
    long_enough = (F.length("value") >= LEAST) | ((F.length("value") >= LEAST_ASSIGNED) & F.col("name").isin(*SECRET_NAMES.split("|")))
    return out.withColumn("token", token).where(long_enough)


def _tree_sql(text: str) -> str:
    """A tree of the library's own description as nested CASE expressions."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines()[1:] if x.strip()]

    def read(i: int) -> tuple[str, int]:
        depth, line = lines[i]
        if m := re.match(r"Predict: ([0-9.]+)", line):
            return str(float(m[1])), i + 1
        m = re.match(r"If \(feature (\d+) (<=|>) ([-0-9.E]+)\)", line)
        yes, i = read(i + 1)
        no, i = read(i + 1)  # the line of Else
        return f"CASE WHEN {FEATURES[int(m[1])]} {m[2]} {float(m[3])!r}D THEN {yes} ELSE {no} END", i

    return read(0)[0]


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 6) -> list[str]:
    """One CASE expression over FEATURES for each tree; findings are bounded, in one partition, in a fixed order."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[*FEATURES], outputCol="features").transform(with_features(written(findings, "findings"))).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    return [_tree_sql(t.toDebugString) for t in model.trees]


@lru_cache(1)
def _trained(app: str) -> tuple[str, ...]:
    return tuple(train(labelled_findings(SparkSession.getActiveSession())))


def _forest(docs: DataFrame, forest: list[str] | None) -> list[str]:
    return forest or list(_trained(docs.sparkSession.sparkContext.applicationId))


def scan(docs: DataFrame, forest: list[str] | None = None, accept: float = ACCEPT) -> DataFrame:
    """doc_id, value, vote (0 to 1), start, n_tokens and secret, true from accept on, of each document's candidates."""
    rows = _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _forest(docs, forest), "pieces").where("pieces is not null")
    # the place of a piece: whole blocks of pieces before its own, and the pieces before it in its block
    rows = rows.select("doc_id", "pieces", F.expr("transform(pieces, v -> length(v.gap) + length(v.lead) + length(v.value))").alias("sizes"))
    blocks = f"transform(sequence(0, (size(sizes) - 1) div {ADDED}), b -> aggregate(slice(sizes, b * {ADDED} + 1, {ADDED}), 0, (s, x) -> s + x))"
    rows = rows.select("doc_id", "pieces", "sizes", F.expr(f"aggregate({blocks}, array(0), (s, x) -> concat(s, array(element_at(s, -1) + x)))").alias("ends"))
    place = f"ends[i div {ADDED}] + aggregate(slice(sizes, i div {ADDED} * {ADDED} + 1, i % {ADDED}), 0, (s, x) -> s + x) + length(v.gap) + length(v.lead)"
    found = F.expr(f"filter(transform(pieces, (v, i) -> named_struct('value', v.value, 'start', {place}, 'vote', v.vote)), x -> x.vote is not null)")
    # places of a value stand side by side after sorting; the first of them holds the value's row
    rows = rows.select("doc_id", F.array_sort(found).alias("found")).select("doc_id", "found", F.expr("filter(sequence(0, size(found) - 1), i -> size(found) > 0 and (i = 0 or found[i - 1].value <> found[i].value))").alias("firsts"))
    group = "slice(found, firsts[k] + 1, if(k + 1 < size(firsts), firsts[k + 1], size(found)) - firsts[k])"
    one = f"transform(firsts, (f, k) -> named_struct('value', found[f].value, 'vote', array_max(transform({group}, x -> x.vote)), 'start', found[f].start, 'n_tokens', cast(size({group}) as bigint)))"
    return rows.select("doc_id", F.inline(F.expr(one))).withColumn("secret", F.col("vote") >= accept)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, start (code points), length, value_sha256, vote and secret of every candidate."""
    return scan(docs).select("doc_id", F.col("start").cast("long").alias("start"), F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "n_tokens", "vote", "secret")


def redact(docs: DataFrame, forest: list[str] | None = None, accept: float = ACCEPT) -> DataFrame:
    """docs, all columns and rows, with MASK in place of accepted secrets; a value accepted in one place goes in all of its places."""
    pieces, gone = fresh(docs, "pieces", "gone")
    rows = _judged(docs, _forest(docs, forest), pieces)
    rows = rows.withColumn(gone, F.expr(f"array_distinct(transform(filter({pieces}, v -> v.vote >= {accept}), v -> v.value))"))
    # from many values, a map finds one in a step
    rows = rows.withColumn(gone, F.when(F.size(gone) > 0, F.map_from_arrays(gone, F.expr(f"transform({gone}, x -> true)"))))
    masked = F.expr(f"array_join(transform({pieces}, v -> concat(v.gap, v.lead, if(map_contains_key({gone}, v.value), '{MASK}', v.value))), '')")
    out = rows.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(masked))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
