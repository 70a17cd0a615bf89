"""Personal data: fixed patterns, and bootstrapped contextual extraction, with DataFrame functions only.

Base spans come from fixed patterns (email, ip, card, phone). They are the seeds of the second part.
The word before an entity and the word after it are its lexical patterns, looked for in the text
between it and its neighbours of the same kind, however far that is. Patterns and identifier-like
strings form a graph: an edge says how often a string stands next to a word. Scores go back and
forth: a pattern's confidence is the score of all that stands next to its word over all occurrences
of the word in the corpus; patterns with CONFIDENCE and SUPPORT different strings of known score are
admitted, and a string that an admitted pattern shows gets its confidence as score. Strings found in
one round support new patterns in the next, until nothing changes: scores only rise from round to round and never above one, so they come to rest. Identifiers
next to an admitted pattern become spans of kind id.

Only edges that can never count are left out: words with fewer than SUPPORT different strings in all,
and words whose strings are less than CONFIDENCE of their occurrences even if all had score one.

Each pattern's matches and the text between them (regexp_extract_all and split) give the positions,
as running sums of lengths. Patterns are written so that they need no backtracking on long texts.

Defined results: a null text is an empty one; a null doc_id stays null; repeated rows each count and
give repeated rows; an empty table gives an empty result; input columns other than doc_id and text
are not read, or are passed on by redacted(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcheck.llm.common import packed, text_or_empty, written

SUPPORT, CONFIDENCE = 3, 0.5
#: Least length of an identifier that context may show; shorter strings with digits are numbers and dates.
SHORTEST = 6
#: Code points next to an entity in which its word is looked for first; where they cut the word, all of the text between is read.
NEAR = 64
_STEP = 256

# The base patterns. A run is entered at its start only (or where the match before ended), which changes no match.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_ID = "A-Za-z0-9_.@+-"
IDENTIFIER = rf"(?<![{_ID}])(?=[A-Za-z_.@+-]*+[0-9])[{_ID}]{{{SHORTEST},}}+(?![{_ID}])"
KINDS = (*PATTERNS, "id")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


#: A word with white space behind it at the end of a text, signs between them aside; and the same from the start.
_BEFORE = r"(?<!\S)(\S++)\s++[^\s\p{L}\p{N}]*+$"
_AFTER = r"^[^\s\p{L}\p{N}]*+\s++(\S++)"


def word_before(gap: Column) -> Column:
    """The last word of the text before an entity, lower-cased; empty if there is none."""
    near = F.right(gap, F.lit(NEAR))
    enough = (F.length(gap) <= NEAR) | near.rlike(rf"\s{_BEFORE}")
    return F.lower(F.regexp_extract(F.when(enough, near).otherwise(gap), _BEFORE, 1))


def word_after(gap: Column) -> Column:
    near = F.left(gap, F.lit(NEAR))
    enough = (F.length(gap) <= NEAR) | near.rlike(rf"{_AFTER}\s")
    return F.lower(F.regexp_extract(F.when(enough, near).otherwise(gap), _AFTER, 1))


def with_spans(df: DataFrame, kind: str, pattern: str, valid: Callable[[Column], Column], needs: str = "") -> DataFrame:
    """Adds the column kind: array of (start, end, value, left, right), in order, of the valid matches of a pattern in text."""
    has = F.contains("text", F.lit(needs)) if needs else F.col("text").rlike("[0-9]")
    none = F.lit(None).cast("array<string>")
    df = df.withColumn("_found", F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size("_found") > 0
    facts = F.transform(F.split("text", pattern, -1), lambda g: F.struct(F.length(g).alias("n"), word_before(g).alias("before"), word_after(g).alias("after")))
    df = df.withColumn("_gaps", F.when(some, facts))
    df = df.withColumn("_sizes", F.when(some, F.zip_with(F.slice("_gaps", 1, F.size("_found")), F.transform("_found", F.length), lambda g, m: g["n"] + m)))
    steps = F.sequence(F.lit(0), F.expr(f"(size(_found) - 1) div {_STEP}"))
    df = df.withColumn("_steps", F.when(some, F.transform(steps, lambda b: _sum(F.slice("_sizes", b * _STEP + 1, F.lit(_STEP))))))

    def span(m: Column, i: Column) -> Column:
        whole = F.floor(i / _STEP).cast("int")
        before = _sum(F.slice("_steps", F.lit(1), whole)) + _sum(F.slice("_sizes", whole * _STEP + 1, i - whole * _STEP))
        gap = F.get("_gaps", i)
        start = before + gap["n"]
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), gap["before"].alias("left"), F.get("_gaps", i + 1)["after"].alias("right"))

    spans = F.filter(F.transform("_found", span), lambda s: valid(s["value"]))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    return df.withColumn(kind, F.when(some, spans).otherwise(empty)).drop("_found", "_gaps", "_sizes", "_steps")


def entities(documents: DataFrame, carry: bool) -> DataFrame:
    """A written table, one row for each document: row, doc_id, base spans by kind, with carry also rec (all its columns), and found: (kind, start, end, value, left, right) of base spans and of strings that look like identifiers."""
    df = packed(documents).select("rec", F.col("rec.doc_id").cast("long").alias("doc_id"), text_or_empty("rec.text").alias("text"))
    for kind, pattern in PATTERNS.items():
        df = with_spans(df, kind, pattern, VALID[kind], NEEDS[kind])
    df = with_spans(df, "id", IDENTIFIER, lambda m: F.lit(True))
    named = lambda k: F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), *(s[c].alias(c) for c in ("start", "end", "value", "left", "right"))))
    places = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in PATTERNS]
    return written(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(("rec",) if carry else ()), *places, F.flatten(F.array(*map(named, KINDS))).alias("found")), "pii-entities", compression="zstd")


def occurrences(found: DataFrame) -> DataFrame:
    """A written table, one row for each base span and each identifier that no base span touches: row, kind, start, end, value, left, right."""
    each = found.select("row", F.explode("found").alias("f")).select("row", "f.*")
    base = F.col("kind") != "id"
    up = Window.partitionBy("row").orderBy("start", F.desc(base), "end").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.desc("start"), base, F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    near = each.withColumn("_end", F.max(F.when(base, F.col("end"))).over(up)).withColumn("_start", F.min(F.when(base, F.col("start"))).over(down))
    free = (F.coalesce("_end", F.lit(0)) <= F.col("start")) & (F.coalesce("_start", F.col("end")) >= F.col("end"))
    return written(near.where(base | free).drop("_end", "_start"), "pii-occurrences")


def admitted_patterns(documents: DataFrame, each: DataFrame) -> DataFrame:
    """(side, word, confidence): the words next to which identifiers stand, by rounds over the graph of patterns and strings."""
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("word")) for side in ("left", "right")))
    edges = each.select("value", (F.col("kind") != "id").alias("seed"), F.explode(sides).alias("s")).select("value", "seed", "s.*").where("word <> ''")
    edges = written(edges.groupBy("side", "word", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "pii-edges")
    wide = edges.groupBy("side", "word").agg(F.count("*").alias("strings"), F.sum("n").alias("hits")).where(F.col("strings") >= SUPPORT)
    wide = written(wide, "pii-words")
    totals = documents.select(F.explode(F.split(F.lower(text_or_empty()), r"\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("total"))
    able = wide.join(totals, "word").where(F.col("hits") >= CONFIDENCE * F.col("total")).select("side", "word", "total")
    edges = written(edges.join(able, ["side", "word"]), "pii-edges")
    seeds = edges.where("seed").select("value").distinct().withColumn("score", F.lit(1.0))
    scores, mark = seeds, None
    while True:
        found = edges.join(scores, "value").groupBy("side", "word").agg((F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("confidence"), F.count("*").alias("strings"))
        patterns = written(found.where((F.col("strings") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("side", "word", F.least("confidence", F.lit(1.0)).alias("confidence")), "pii-patterns")
        new = patterns.agg(F.count("*"), F.sum(F.round("confidence", 6))).first()
        if new == mark or not new[0]:
            break
        mark = new
        shown = edges.where("not seed").join(patterns, ["side", "word"]).groupBy("value").agg(F.max("confidence").alias("score"))
        scores = written(seeds.unionByName(shown.join(seeds.select("value"), "value", "left_anti")), "pii-scores")
    return patterns


def discovered(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(row, start, end, value) of identifiers that only their context shows."""
    each = occurrences(found)
    patterns = admitted_patterns(documents, each)
    ids = each.where("kind = 'id'")
    shown = [ids.join(patterns.where(F.col("side") == side).select(F.col("word").alias(side)), side, "left_semi").select("row", "start", "end", "value") for side in ("left", "right")]
    return shown[0].unionByName(shown[1]).distinct()


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def _of_kind(column: str, kind: str) -> Column:
    return F.transform(column, lambda s: F.struct(s["start"].cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].cast("int").alias("end")))


def find(documents: DataFrame) -> DataFrame:
    """One row for each document: counts of base spans, base_spans and spans (lists as text), n_id."""
    found = entities(documents.select("doc_id", "text"), False)
    extra = discovered(documents, found).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("id"))  # at most the identifiers of one text
    rows = found.drop("found").join(extra, "row", "left").withColumn("id", F.coalesce("id", F.array().cast("array<struct<start:int,end:int>>")))
    base = F.flatten(F.array(*(_of_kind(k, k) for k in PATTERNS)))
    every = F.flatten(F.array(*(_of_kind(k, k) for k in KINDS)))
    return rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), _listed(base).alias("base_spans"), _listed(every).alias("spans"))


def _regions(spans: Column) -> Column:
    """Sorted spans without overlaps: those that overlap become one, of the first one's kind."""
    ordered = F.array_sort(spans)
    pairs = F.zip_with(F.slice(ordered, F.lit(1), F.size(ordered) - 1), F.slice(ordered, F.lit(2), F.size(ordered) - 1), lambda a, b: b["start"] < a["end"])

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        apart = (F.size(acc) == 0) | (F.get(acc, F.size(acc) - 1)["end"] <= s["start"])
        return F.when(apart, F.concat(acc, F.array(s))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer)))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(F.size(ordered) < 2, ordered).when(F.exists(pairs, lambda x: x), F.aggregate(ordered, empty, merge)).otherwise(ordered)


def redacted(documents: DataFrame) -> DataFrame:
    """documents, all columns, with [EMAIL] and so on in the place of each span; spans that overlap become one, of the first one's kind.

    The base spans are those of find(). An identifier found by context goes wherever its row has it.
    """
    found = entities(documents, True)
    shown = discovered(documents, found).select("row", "value").distinct()
    same = found.select("row", F.explode("found").alias("f")).select("row", "f.*").where("kind = 'id'").join(shown, ["row", "value"], "left_semi")
    extra = same.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("id"))  # at most the identifiers of one text
    rows = found.drop("found", "doc_id").join(extra, "row", "left").withColumn("text", text_or_empty("rec.text")).withColumn("id", F.coalesce("id", F.array().cast("array<struct<start:int,end:int>>")))
    rows = rows.withColumn("_regions", _regions(F.flatten(F.array(*(_of_kind(k, k) for k in KINDS)))))
    end = lambda i: F.when(i == 0, 0).otherwise(F.get("_regions", i - 1)["end"])
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    pieces = F.transform("_regions", lambda r, i: F.concat(F.substring("text", end(i) + 1, r["start"] - end(i)), F.element_at(names, r["kind"] + 1)))
    last = F.get("_regions", F.size("_regions") - 1)["end"]
    text = F.when(F.size("_regions") > 0, F.concat(F.array_join(pieces, ""), F.substring("text", last + 1, F.length("text")))).otherwise(F.col("rec.text").cast("string"))
    return rows.select(*(text.alias(c) if c == "text" else F.col("rec")[c].alias(c) for c in documents.columns))
