"""Personal data: fixed patterns, and a bootstrapped search for identifiers in the same contexts.

The fixed patterns give the seeds. The words beside a seed, both or one of them, are lexical patterns, and every
stretch of words that has the shape of an identifier is an instance of those it stands in. Rounds over this graph score
patterns by their distinct known instances against what else stands in them, then instances by the patterns that hold them; what scores high enough is known in the next round. All
of it is built-in functions: places of matches follow from the lengths of matches and gaps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import cut
from quernel.llm.quality import let

KINDS = ("email", "ip", "card", "phone")
#: The look-behinds keep long runs linear: a match can begin within a run only where another has just ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without these have no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What candidates are cut from: words with an at sign, and runs of words of digits and marks.
_NUMBER = r"[^\x20\x09-\x0D0-9A-Za-z@]*+[0-9][^\x20\x09-\x0DA-Za-z@]*+(?![^\x20\x09-\x0D])"
RUN = rf"(?<![^\x20\x09-\x0D])(?:(?=[^\x20\x09-\x0D@]*+@)[^\x20\x09-\x0D]++|{_NUMBER}(?:\x20[\x20().-]*+{_NUMBER})*+)"
MOST_WORDS = 19
#: Stands for a span in a text whose other words are counted; no word holds it.
MARK = "\x00"
#: Patterns that are asked about, up to so many, go to each executor whole.
BROADCAST = 1 << 18
#: Contexts are held against one text of so many, then one of fewer, and what is left against all.
PARTS = (64, 8, 1)
CONTEXT = 48
ROUNDS = 3
MIN_KNOWN = 3
MIN_SHARE = 0.8
MIN_SCORE = 0.8
SPAN = "array<struct<start:int,kind:int,stop:int,value:string,left:string,right:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return x.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return let(_digits(x), lambda d: F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.char_length(_digits(x)).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: int | Column, keep) -> Column:
    """Spans of a pattern's matches that `keep` holds of, with the text beside them.

    The gaps between matches and the matches alternate; their lengths in code points give the places.
    """

    def collect(gaps: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.char_length(x["gap"])
            stop = at + F.coalesce(F.char_length(x["hit"]), F.lit(0))
            span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["hit"].alias("value"), F.right(x["gap"], F.lit(CONTEXT)).alias("left"), F.left(F.coalesce(x["next"], F.lit("")), F.lit(CONTEXT)).alias("right"))
            out = F.when(x["hit"].isNotNull() & keep(x["hit"]), F.concat(acc["out"], F.array(span).cast(SPAN))).otherwise(acc["out"])
            return F.struct(stop.alias("at"), out.alias("out"))

        zipped = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
        zipped = zipped.cast("array<struct<gap:string,hit:string,next:string>>")
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(zipped, start, step, lambda acc: acc["out"])

    return let(F.split(text, pattern, -1), collect)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with `base`: the valid matches of the four kinds by start, then kind; null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(SPAN)
    out = []
    for k, kind in enumerate(KINDS):
        may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9][\\x20-]?[0-9]")
        out.append(F.when(may, matches(text, PATTERNS[kind], k, lambda x, kind=kind: valid(kind, x))).otherwise(none))
    return docs.withColumn("base", F.sort_array(F.concat(*out)))


def shape(x: Column) -> Column:
    """The kind an identifier-like candidate may be, by its form alone; null for none."""
    numeric = x.rlike(r"^[+(]*[0-9][\x20().0-9-]*$")
    n = F.char_length(_digits(x))
    return (
        F.when(x.rlike(r"^[^@]+@[^@]+$"), 0)
        .when(x.rlike(r"^[0-9]{1,3}(?:[.-][0-9]{1,3}){3}$"), 1)
        .when(numeric & n.between(12, 19), 2)
        .when(numeric & n.between(7, 11), 3)
    )


def candidates(found: DataFrame, key: list[str]) -> DataFrame:
    """(key, base, s): what has a shape and touches no base span, each with the text beside it.

    Runs of numeric words with blanks, dots, hyphens and brackets between them are taken apart
    again: every stretch of whole words is a candidate of its own, so a number beside an identifier
    hides nothing. A shape has 19 digits at most and a word one at least, so stretches are few.
    Marks around a candidate are left out, but for a bracket that is closed in it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    may = text.rlike(r"@|[0-9](?:[^0-9A-Za-z]*+[0-9]){3}")
    runs = found.filter(may).select(*key, "base", F.explode(matches(text, RUN, -1, lambda x: x.contains("@") | (F.char_length(_digits(x)) >= 4))).alias("r"))
    words = matches(F.col("r.value"), r"[^\x20]++", -1, lambda x: x.rlike("[0-9@]"))
    firsts = runs.withColumn("_words", words).select("*", F.posexplode("_words").alias("_i", "_a"))
    pairs = firsts.select(*key, "base", "r", "_a", F.explode(F.slice("_words", F.col("_i") + 1, F.lit(MOST_WORDS))).alias("_b"))
    raw = F.substring(F.col("r.value"), F.col("_a.start") + 1, F.col("_b.stop") - F.col("_a.start"))
    core = pairs.withColumn("_core", F.regexp_replace(raw, r"[^0-9A-Za-z]+$", ""))
    core = core.withColumn("_lead", F.char_length(F.regexp_extract("_core", r"^[^0-9A-Za-z+(]*(?:\((?!.*\)))?", 0)))
    core = core.withColumn("_value", F.substring(F.col("_core"), F.col("_lead") + 1, F.char_length("_core")))
    core = core.withColumn("_kind", shape(F.col("_value"))).filter(F.col("_kind").isNotNull())
    core = core.withColumn("_at", F.col("_a.start") + F.col("_lead"))
    around, place = F.concat("r.left", "r.value", "r.right"), F.char_length("r.left") + F.col("_at")
    start = F.col("r.start") + F.col("_at")
    size = F.char_length("_value")
    left, right = F.right(F.substring(around, F.lit(1), place), F.lit(CONTEXT)), F.substring(around, place + size + 1, F.lit(CONTEXT))
    span = F.struct(start.alias("start"), F.col("_kind").alias("kind"), (start + size).alias("stop"), F.col("_value").alias("value"), left.alias("left"), right.alias("right"))
    return core.select(*key, "base", span.alias("s")).filter(~F.exists("base", lambda b: (b["start"] < F.col("s.stop")) & (F.col("s.start") < b["stop"])))


def _beside(left: Column, right: Column) -> tuple[Column, Column]:
    """The words beside a place, past marks that cling to it; numbers are no words."""
    a = F.lower(F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[^\x20\x09-\x0D0-9A-Za-z]*$", 1))
    b = F.lower(F.regexp_extract(right, r"^[^\x20\x09-\x0D0-9A-Za-z]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1))
    return tuple(F.when(x.rlike(r"^[^\p{L}]*[0-9][^\p{L}]*$"), "").otherwise(x) for x in (a, b))


def contexts(a: Column, b: Column) -> Column:
    """The patterns of a place: both words beside it, the left one, the right one."""
    left = F.when(a != "", F.concat(a, F.lit(" _")))
    right = F.when(b != "", F.concat(F.lit("_ "), b))
    return F.array_compact(F.array(F.when((a != "") & (b != ""), F.concat(a, F.lit(" _ "), b)), left, right))


def _patterns(rows: DataFrame) -> DataFrame:
    """A row for each pattern that an entity's place has."""
    return rows.withColumn("pattern", F.explode(contexts(*_beside(F.col("left"), F.col("right")))))


def _fillers(found: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """(pattern, word) of every word of every text that is of no base span and no candidate."""
    by = others.groupBy(*[F.col(k).alias(f"_by_{k}") for k in key]).agg(F.collect_set(F.struct("s.start", "s.stop")).alias("_others"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in key])
    own = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    spans = F.sort_array(F.concat(own, F.coalesce("_others", F.array().cast("array<struct<start:int,stop:int>>"))))
    text = F.coalesce(F.col("text"), F.lit(""))
    words = found.join(by, on, "left").select(F.split(F.lower(_marked(text, spans, lambda s: F.lit(MARK))), r"[\x20\x09-\x0D]+").alias("w"))
    # the words before, the words and the words after, place by place; the ends of a text are empty
    places = F.arrays_zip(F.concat(F.array(F.lit("")), "w").alias("a"), F.col("w").alias("w"), F.concat(F.slice("w", F.lit(2), F.size("w")), F.array(F.lit(""))).alias("b"))
    each = words.select(F.explode(places).alias("p")).select("p.*").filter((F.col("w") != "") & ~F.contains("w", F.lit(MARK)))
    return each.select("w", F.explode(contexts(F.col("a"), F.col("b"))).alias("pattern"))


def discover(found: DataFrame, key: list[str], rounds: int = ROUNDS, min_known: int = MIN_KNOWN, min_share: float = MIN_SHARE, min_score: float = MIN_SCORE) -> DataFrame:
    """Spans (key, span) that the method adds to documents with `base` spans; none lies within another.

    A pattern counts only with `min_known` known distinct entities that are `min_share` of these and
    of what speaks against it: known entities of other kinds, and other words in the same place.
    Candidates that are not known yet speak neither for nor against it. An entity's score is 1 less
    the product of what its patterns leave open. Copies of a document add no evidence, as entities
    and words are counted once each.
    """
    seeds = found.filter(F.size("base") > 0).select(*key, F.explode("base").alias("s"), F.lit(True).alias("seed"))
    others = cut(candidates(found, key).select(*key, "s", F.lit(False).alias("seed")))
    rows = seeds.unionByName(others).select(*key, "seed", "s.kind", "s.start", "s.stop", F.lower("s.value").alias("entity"), "s.left", "s.right")
    rows = cut(_patterns(rows).drop("left", "right"))
    edges = cut(rows.groupBy("kind", "pattern", "entity").agg(F.max("seed").alias("known")))
    # only patterns that hold something unknown, and may come to hold enough that is known, matter in any round
    held = edges.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("known")).alias("n_open"))
    held = held.filter(F.col("n_open") > 0).groupBy("pattern").agg(F.max("n").alias("most")).filter(F.col("most") >= min_known)
    asked, plain = cut(held), None
    for part in PARTS:  # what is refuted by a part of the texts, were all it holds known, is refuted by all of them
        n_asked = asked.count()
        if not n_asked:
            return rows.filter(F.lit(False)).select(*key, "kind", "start", "stop")
        small = F.broadcast(asked.select("pattern")) if n_asked <= BROADCAST else asked.select("pattern")
        texts = found.filter(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)
        plain = cut(_fillers(texts, others, key).join(small, "pattern", "left_semi").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n_plain")))
        asked = asked.join(plain, "pattern", "left").filter(F.col("most") >= min_share * (F.col("most") + F.coalesce("n_plain", F.lit(0))))
        asked = cut(asked.select("pattern", "most"))
    edges = cut(edges.join(asked.select("pattern"), "pattern", "left_semi"))
    for _ in range(rounds):
        known = edges.groupBy("kind", "pattern").agg(F.count_if("known").alias("n_known"))
        whole = known.groupBy("pattern").agg(F.sum("n_known").alias("n_all")).join(plain, "pattern", "left")
        scored = known.join(whole, "pattern").withColumn("share", F.col("n_known") / (F.col("n_all") + F.coalesce("n_plain", F.lit(0))))
        good = scored.filter((F.col("n_known") >= min_known) & (F.col("share") >= min_share))
        held = edges.filter(~F.col("known")).join(good.select("kind", "pattern", "share"), ["kind", "pattern"])
        open_ = F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-6)))))
        new = held.groupBy("kind", "entity").agg((1 - open_).alias("score")).filter(F.col("score") >= min_score).select("kind", "entity", F.lit(True).alias("_new"))
        edges = cut(edges.join(new, ["kind", "entity"], "left").withColumn("known", F.col("known") | F.coalesce("_new", F.lit(False))).drop("_new"))
    entities = edges.filter("known").select("kind", "entity").distinct()
    spans = rows.filter(~F.col("seed")).join(entities, ["kind", "entity"], "left_semi").select(*key, "kind", "start", "stop").distinct()
    before = Window.partitionBy(*key).orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("stop").over(before)).filter(F.col("_reach").isNull() | (F.col("stop") > F.col("_reach"))).drop("_reach")


def find(docs: DataFrame, **options) -> DataFrame:
    """docs with base and spans, both sorted; spans are the base ones and those the method adds."""
    key = ["doc_id", "_text"]
    found = base_spans(docs).withColumn("_text", F.xxhash64("text"))
    more = discover(found, key, **options)
    by = more.groupBy(*[F.col(k).alias(f"_by_{k}") for k in key]).agg(F.collect_set(F.struct("start", "kind", "stop")).alias("_more"))
    slim = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in key])
    joined = found.join(by, on, "left").drop(*[f"_by_{k}" for k in key])
    merged = F.sort_array(F.concat(slim, F.coalesce("_more", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))))
    return joined.withColumn("base", slim).withColumn("spans", merged).drop("_more", "_text")


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _marked(text: Column, spans: Column, mark) -> Column:
    """The text with mark(span) for each of the sorted spans; spans that overlap become one, marked as the first."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, mark(s)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), parts.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(text: Column, spans: Column) -> Column:
    """The text with a mark such as <EMAIL> for each span."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    return _marked(text, spans, lambda s: F.get(names, s["kind"]))
