"""Secret scans with multipart credential linking, in DataFrame functions only.

Three patterns are reported wherever they match: assignments, access identifiers, long hex runs.
Weaker patterns (account names, random-looking strings, endpoints) are only candidates. They are
joined with all parts of the same text whose start lies within ``reach`` code points and in the
same scope, a stretch between blank lines, and are reported if complementary parts turn up: an
identifier next to a secret, a secret next to an identifier, an endpoint next to both. The interval
join is a range window over the parts in order of place, so its work grows with the parts and not
with their pairs.

Defined cases: a null text is an empty one; rows with the same id and text get the same spans and
each keep their row; places count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facets.session import attach, cut

REACH = 200
MASK = "[secret]"
# Kinds in the order in which equal starts are listed; the first three are always reported.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = 3

# Fixed patterns of the three base kinds.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

IDENTIFIER = (r"""(?i:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?"""
              r"""\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""")
# A value may stand right behind an equals sign, as in NAME=value lines.
SECRET = (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])"
          r"(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+"""
_BREAK = r"\n[\x20\t\r]*\n"
_BREAK_KIND = len(KINDS)

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAMES = ("user", "login", "client", "account", "access")
_BLOCK = 32
_SPAN = "array<struct<start:int,end:int,kind:int>>"


def _has(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _lengths(texts: Column) -> Column:
    return F.transform(texts, F.length)


def _starts(gaps: Column, sizes: Column) -> Column:
    """Start of each match from the lengths of what lies between matches and of the matches.

    Sums run over blocks, and then inside a block, so a text full of matches stays cheap.
    """
    steps = F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, s: g + s)
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, v: a + v)

    ahead = F.aggregate(
        blocks, F.array(F.lit(0)),
        lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + total(
            F.slice(steps, b * _BLOCK + 1, _BLOCK)))))
    inside = F.transform(blocks, lambda b: F.transform(
        F.slice(steps, b * _BLOCK + 1, _BLOCK),
        lambda _, i: F.get(ahead, b) + F.get(gaps, b * _BLOCK + i)
        + total(F.slice(steps, b * _BLOCK + 1, i))))
    return F.flatten(inside)


def _found(rows: DataFrame, name: str, kind: int, pattern: str, may: Column,
           group: int | None = None, least: int = 0) -> DataFrame:
    """Add ``name``: spans of all matches, leftmost first and not overlapping.

    With ``group``, matches whose group is shorter than ``least`` are dropped afterwards.
    """
    text, regex = F.col("_text"), F.lit(pattern)
    rows = rows.withColumn("_sizes", F.when(may, _lengths(F.regexp_extract_all(text, regex, 0))))
    some = F.size("_sizes") > 0
    rows = rows.withColumn("_gaps", F.when(some, _lengths(F.split(text, pattern, -1))))
    rows = rows.withColumn("_starts", F.when(some, _starts(F.col("_gaps"), F.col("_sizes"))))
    spans = F.zip_with("_starts", "_sizes", lambda a, n: F.struct(
        a.alias("start"), (a + n).alias("end"), F.lit(kind).alias("kind")))
    if group is not None:
        held = F.zip_with(spans, _lengths(F.regexp_extract_all(text, regex, group)),
                          lambda s, n: F.struct(s.alias("s"), n.alias("n")))
        spans = F.transform(F.filter(held, lambda h: h["n"] >= least), lambda h: h["s"])
    return (rows.withColumn(name, F.when(some, spans).otherwise(F.array().cast(_SPAN)).cast(_SPAN))
            .drop("_sizes", "_gaps", "_starts"))


def text_key() -> Column:
    """Names a row by its id and whole text."""
    return F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"),
                           F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, base, weak, breaks, key): spans found in every row, candidates kept apart.

    ``weak`` is emptied where no identifier or no secret of any strength stands in the text, as
    nothing can be reported there; ``key`` is null without candidates.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn(
        "_text", F.coalesce("text", F.lit("")))
    text, small = F.col("_text"), F.lower("_text")
    rows = _found(rows, "_assign", 0, ASSIGN, _has(small, _WORDS), 1, ASSIGN_LEAST)
    rows = _found(rows, "_access", 1, ACCESS, F.contains(text, F.lit("AKIA")))
    rows = _found(rows, "_hex", 2, HEX, text.rlike(HEX))
    rows = _found(rows, "_names", 3, IDENTIFIER, _has(small, _NAMES))
    named = (F.size("_names") > 0) | (F.size("_access") > 0)
    rows = _found(rows, "_random", 4, SECRET, named)
    linked = named & ((F.size("_random") > 0) | (F.size("_assign") > 0) | (F.size("_hex") > 0))
    rows = _found(rows, "_ends", 5, ENDPOINT, linked & F.contains(text, F.lit("://")))
    weak = F.when(linked, F.concat("_names", "_random", "_ends"))
    rows = rows.withColumn("weak", F.coalesce(weak, F.array().cast(_SPAN)))
    rows = _found(rows, "breaks", _BREAK_KIND, _BREAK, F.size("weak") > 0)
    return rows.select(
        "doc_id", F.concat("_assign", "_access", "_hex").alias("base"), "weak", "breaks",
        F.when(F.size("weak") > 0, text_key()).alias("key"))


def linked_candidates(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(key, linked): the candidates of each text that have their complements in reach."""
    each = (found.where(F.col("key").isNotNull())
            .select("key", F.inline(F.concat("base", "weak", "breaks")))
            .distinct())
    place = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    scoped = each.withColumn("scope", F.sum((F.col("kind") == _BREAK_KIND).cast("int")).over(place))
    near = Window.partitionBy("key", "scope").orderBy("start").rangeBetween(-reach, reach)
    kind = F.col("kind")
    secret = F.max((kind.isin(0, 2, 4)).cast("int")).over(near) == 1
    name = F.max((kind.isin(1, 3)).cast("int")).over(near) == 1
    judged = scoped.select("key", "start", "end", "kind", F.when(kind == 3, secret).when(
        kind == 4, name).when(kind == 5, secret & name).otherwise(False).alias("report"))
    return judged.where("report").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("linked"))


def secret_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, key, spans) of every row: reported spans by start, then kind.

    Only spans travel; texts are read once and stay where they are.
    """
    found = cut(parts(docs))
    plain = found.where(F.col("key").isNull()).select("doc_id", "key", "base")
    linked = (found.where(F.col("key").isNotNull())
              .join(linked_candidates(found, reach), "key", "left")
              .select("doc_id", "key", F.concat(
                  "base", F.coalesce("linked", F.array().cast(_SPAN))).alias("base")))
    return plain.union(linked).select("doc_id", "key", F.transform(
        F.array_sort(F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                           s["kind"].alias("kind"))).alias("spans"))


def redact(docs: DataFrame, reach: int = REACH, mask: str = MASK) -> DataFrame:
    """The documents with every reported span replaced by ``mask``; all columns stay.

    Base spans are found in the text at hand; only the linked candidates, few texts, are joined.
    """
    # Written first, so that no filter is pushed into the patterns.
    linked = cut(linked_candidates(cut(parts(docs)), reach))
    # The row travels as one value, so that its column names cannot clash.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text",
                        text_key().alias("_key"))
    rows = attach(keyed, linked.select(F.col("key").alias("_key"), F.col("linked").alias(
        "_linked")), "_key", "left") if not linked.isEmpty() else keyed.withColumn(
        "_linked", F.lit(None).cast(_SPAN))
    rows = rows.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    text, small = F.col("_text"), F.lower("_text")
    rows = _found(rows, "_assign", 0, ASSIGN, _has(small, _WORDS), 1, ASSIGN_LEAST)
    rows = _found(rows, "_access", 1, ACCESS, F.contains(text, F.lit("AKIA")))
    rows = _found(rows, "_hex", 2, HEX, text.rlike(HEX))
    spans = F.array_sort(F.concat("_assign", "_access", "_hex", F.coalesce(
        "_linked", F.array().cast(_SPAN))))
    rows = rows.withColumn("_spans", F.when(
        F.size(spans) > 0, spans))
    # Overlapping spans become one.
    flat = F.aggregate(
        F.slice("_spans", 2, F.greatest(F.size("_spans") - 1, F.lit(0))),
        F.array(F.struct(F.get("_spans", F.lit(0))["start"].alias("start"),
                         F.get("_spans", F.lit(0))["end"].alias("end"))),
        lambda a, s: F.when(
            s["start"] <= F.element_at(a, -1)["end"],
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
                F.element_at(a, -1)["start"].alias("start"),
                F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"),
                                                s["end"].alias("end"))))))
    rows = rows.withColumn("_merged", F.when(F.col("_spans").isNotNull(), flat))
    between = F.transform("_merged", lambda s, i: F.substring(
        F.col("_text"),
        F.when(i == 0, F.lit(0)).otherwise(F.get("_merged", i - 1)["end"]) + 1,
        s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get("_merged", i - 1)["end"])))
    tail = F.substring(F.col("_text"), F.element_at("_merged", -1)["end"] + 1,
                       F.length("_text"))
    masked = F.concat(F.array_join(F.transform(
        between, lambda piece: F.concat(piece, F.lit(mask))), ""), tail)
    text = F.when(F.col("_merged").isNotNull(), masked).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c)
                         for c in docs.columns])
