r"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base expressions find e-mail addresses, IP addresses, payment cards and telephone numbers; these are the seeds. The
two words before a seed are a lexical pattern. Patterns and instances (strings that look like identifiers) form a bipartite graph,
which is scored in turns: a pattern's confidence in a kind is the share of its occurrences, ordinary words included, that
are instances of that kind; an instance's score joins its patterns' confidences by noisy or; instances that score high
count as seeds of the next turn. Unseen identifiers in the slot of a high-confidence pattern become spans of
its kind. The base spans always stay.

Positions come from the gaps between matches, so they count code points and cover whole texts; a span's two words are those since the previous match of its expression. The expressions give the same matches as
the plain ones but never try a start twice: e-mail and IP matches start where a run starts or
the previous match ended, and a card is a maximal run.

Defined cases: null text counts as empty and has no spans; an empty table gives no rows; repeated rows and rows without an id each have their
own result, which depends on the text alone; equal starts are ordered by kind; further columns are kept by ``detect``, whose own
columns take names that are free.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, fresh, release, table, text_id

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A string that may be an identifier: it holds a digit or an at sign.
_CHARS = r"[\p{L}\p{N}._%+@-]"
CANDIDATE = rf"(?<!{_CHARS})(?=[\p{{L}}._%+-]*+[0-9@]){_CHARS}{{6,}}+"
#: What holds the shape of an address is none: it is a base span, or failed to be one.
_SHAPED = rf"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]"
#: Matches whose places are added up at once, and code points of a block of text: they keep the work on a text with very many matches near linear.
STEP, BLOCK = 64, 4096
#: Distinct instances that a pattern needs, confidence that it needs, turns.
SUPPORT, CONFIDENT, TURNS = 3, 0.8, 3


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


_MATCHES = "cast(array() as array<struct<start:bigint,end:bigint,value:string,pattern:string>>)"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, pattern) of each match; pattern: the last two words between the previous match and this one."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    zero = F.lit(0).cast("long")

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + F.length(p["g"])
        end = begin + F.length(p["m"])
        one = F.struct(begin.alias("start"), end.alias("end"), p["m"].alias("value"), _pattern_of(p["g"]).alias("pattern"))
        return F.struct(end.alias("at"), F.array_append(a["out"], one).alias("out"))

    def placed(p: Column) -> Column:
        """Places within each STEP matches first, then where each STEP begins."""
        parts = F.transform(F.sequence(F.lit(0), ((F.size(p) - 1) / STEP).cast("int")), lambda k: F.aggregate(F.slice(p, (k * STEP + 1).cast("int"), F.lit(STEP)), F.struct(zero.alias("at"), F.expr(_MATCHES).alias("out")), step))
        return _let(parts, moved)

    def moved(parts: Column) -> Column:
        begins = F.aggregate(parts, F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out")), lambda a, p: F.struct((a["at"] + p["at"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
        by = lambda p, o: F.transform(p["out"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["value"].alias("value"), s["pattern"].alias("pattern")))
        return F.flatten(F.zip_with(parts, begins, by))

    # the last gap has no match after it
    return F.when(text.rlike(pattern), _let(F.filter(pairs, lambda p: p["m"].isNotNull()), placed)).otherwise(F.expr(_MATCHES))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def step(a: Column, i: Column) -> Column:
        d = F.substr(back, i + 1, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, "[.]"), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(F.substring(bare(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _pattern_of(before: Column) -> Column:
    """The last two words of what precedes a span, in lower case."""
    return F.substring_index(F.trim(F.regexp_replace(F.lower(before), r"\s+", " ")), " ", -2)


def _typed(order: int, kind: str, s: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), s["pattern"].alias("pattern"))


def _base(text: Column) -> Column:
    """Array of (start, order, end, kind, value, pattern) of all base spans by start, then kind."""
    guards = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    kinds = []
    for i, kind in enumerate(KINDS):
        kept = F.filter(matches(text, PATTERNS[kind]), partial(_valid, kind))
        spans = F.transform(kept, partial(_typed, i, kind))
        kinds.append(F.when(guards.get(kind, text.rlike("[0-9]")), spans).otherwise(F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,kind:string,value:string,pattern:string>>)")))
    return F.sort_array(F.concat(*kinds))


def _in_blocks(text: Column, spans: Column) -> Column:
    """For each BLOCK of a text the spans that touch it."""
    blocks = F.sequence(F.lit(0), (F.length(text) / BLOCK).cast("int"))
    return _let(spans, lambda all_: F.transform(blocks, lambda k: F.filter(all_, lambda s: (s["end"] > k * BLOCK) & (s["start"] < (k + 1) * BLOCK))))


def _candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, value, pattern) of what may be an identifier and touches no base span; a span that it touches touches one of its blocks."""
    touches = lambda c, spans: F.exists(spans, lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"]))
    block = lambda at: (at / BLOCK).cast("int")

    def free(found: Column, blocks: Column) -> Column:
        of = lambda c: F.flatten(F.slice(blocks, block(c["start"]) + 1, block(c["end"]) - block(c["start"]) + 1))
        return F.filter(found, lambda c: ~touches(c, of(c)))

    found = F.filter(matches(text, CANDIDATE), lambda c: ~c["value"].rlike(_SHAPED))
    return F.when(text.rlike(CANDIDATE), _let(found, lambda f: F.when(F.size(f) > 0, _let(_in_blocks(text, base), lambda blocks: free(f, blocks))).otherwise(f))).otherwise(F.expr(_MATCHES))


def _confident(slots: DataFrame, totals: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that pass after TURNS of scoring; slots: pattern, value, kind (null for a candidate), n."""
    seeds = slots.where("kind is not null").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    edges = cut(slots.groupBy("pattern", "value").agg(F.sum("n").alias("n")).join(totals, "pattern"))
    scores, passed = seeds, None
    for _ in range(TURNS):
        held = edges.join(scores, "value")
        share = F.sum(F.col("score") * F.col("n")) / F.max("total")
        passed = cut(held.groupBy("pattern", "kind").agg(share.alias("confidence"), F.count(F.lit(1)).alias("support")).where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT)))
        joined = edges.join(passed, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
        scores = cut(seeds.unionAll(joined.where(F.col("score") >= CONFIDENT)).groupBy("value", "kind").agg(F.max("score").alias("score")))
    return passed.select("pattern", "kind", "confidence")


def detect(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame | None, dict[str, str]]:
    """(rows, found, names).

    rows: ``docs`` with whole, the text, and base, the array of base spans, under the names in ``names``. found: (text_id, found), the
    further spans of the texts that have any by ``text_id``, or None if no pattern passes. Spans depend on the text alone, so
    equal texts share them and no row number has to be the same each time that the rows are read.
    """
    names = {n: fresh(docs, n) for n in ("base", "whole")}
    base, whole = names["base"], names["whole"]
    rows = docs.withColumn(whole, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).withColumn(base, _base(F.col(whole)))
    # every span holds a digit or an at sign
    spans = rows.where(F.col(whole).rlike("[0-9@]")).select(F.col(base).alias("base"), F.col(whole).alias("t"))
    spans = cut(spans.select(text_id(F.col("t")).alias("text_id"), "base", _candidates(F.col("t"), F.col("base")).alias("other")))
    slot = lambda c, kind: spans.select("text_id", F.explode(c).alias("s")).select("text_id", F.col("s.pattern").alias("pattern"), F.col("s.value").alias("value"), kind.alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    both = slot("base", F.col("s.kind")).unionAll(slot("other", F.lit(None).cast("string"))).where("pattern != ''")
    slots = cut(both.groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n")))
    wide = slots.groupBy("pattern", "value").agg(F.count("kind").alias("seeds")).groupBy("pattern").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= SUPPORT).select("pattern")
    wide = cut(wide)
    release(docs.sparkSession)
    if slots.where("kind is not null").join(wide, "pattern", "left_semi").isEmpty():
        return rows, None, names
    slots = cut(slots.join(wide, "pattern", "left_semi"))
    held = slots.groupBy("pattern").agg(F.sum("n").alias("held"))
    # totals only lower a confidence, so a pattern that doesn't pass with its own slots as total never passes
    hopeful = cut(_confident(slots, held.select("pattern", F.col("held").alias("total"))).select("pattern").distinct())
    if hopeful.isEmpty():
        return rows, None, names
    # how often a hopeful pattern occurs at all, before whatever word, in all texts
    words = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).select(F.filter(F.split(F.lower("t"), r"\s+"), lambda w: w != "").alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get(F.col("w"), i - 1), F.get(F.col("w"), i)))
    each, counted = words.where(F.size("w") > 1).select(F.explode(pairs).alias("pattern")), lambda df: df.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    # few hopeful patterns go to the words; past that the words' pairs are counted where they are, and meet the patterns as counts
    occurring = counted(each.join(F.broadcast(hopeful), "pattern", "left_semi")) if hopeful.count() <= BROADCAST_ROWS else counted(each).join(hopeful, "pattern", "left_semi")
    totals = held.join(occurring, "pattern", "left").select("pattern", F.greatest("held", F.coalesce("total", "held")).alias("total"))
    passed = cut(_confident(slots, totals))
    if passed.isEmpty():
        return rows, None, names
    best = passed.groupBy("pattern").agg(F.max(F.struct("confidence", F.col("kind"))).alias("b")).select("pattern", F.col("b.kind").alias("kind"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    new = both.where("kind is null").drop("kind").join(best, "pattern").select("text_id", F.struct("start", order.alias("ord"), "end", "kind").alias("s"))
    return rows, cut(new.groupBy("text_id").agg(F.sort_array(F.collect_set("s")).alias("found"))), names


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))


def with_spans(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """(``docs`` with two arrays of (start, ord, end, kind), name of the base spans, name of all spans)."""
    rows, found, n = detect(docs, text_col)
    every, key = fresh(docs, "spans"), fresh(docs, "text_id")
    rows = rows.withColumn(n["base"], _plain(F.col(n["base"])))
    if found is None:
        return rows.drop(n["whole"]).withColumn(every, F.col(n["base"])), n["base"], every
    none = F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,kind:string>>)")
    rows = rows.withColumn(key, text_id(F.col(n["whole"]))).drop(n["whole"]).join(found.select(F.col("text_id").alias(key), F.col("found").alias(every)), key, "left").drop(key)
    return rows.withColumn(every, F.sort_array(F.concat(F.col(n["base"]), F.coalesce(F.col(every), none)))), n["base"], every


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one. Each BLOCK of the text is rewritten by itself."""

    def block(own: Column, k: Column) -> Column:
        first = k.cast("long") * BLOCK
        part = F.substr(text, (first + 1).cast("int"), F.lit(BLOCK))

        def rewritten(part: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                fresh_span = s["start"] >= a["at"]
                between = F.substr(part, (a["at"] - first + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh_span, F.concat(a["out"], between, F.lit("["), s["kind"], F.lit("]"))).otherwise(a["out"]).alias("out"))

            rest = lambda a: F.when(a["at"] < first + BLOCK, F.concat(a["out"], F.substr(part, (a["at"] - first + 1).cast("int"), F.lit(BLOCK)))).otherwise(a["out"])
            return F.aggregate(own, F.struct(first.alias("at"), F.lit("").alias("out")), step, rest)

        return _let(part, rewritten)

    return F.when(F.size(spans) > 0, F.array_join(F.transform(_in_blocks(text, spans), block), "")).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of its texts replaced; null texts stay null."""
    rows, base, every = with_spans(docs, text_col)
    return rows.withColumn(text_col, redacted(F.col(f"`{text_col}`").cast("string"), F.col(every))).select(*(F.col(f"`{c}`") for c in docs.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str, s: Column) -> Column:
    return s["kind"] == kind


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, of each document."""
    rows, base, every = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter(F.col(base), partial(_of_kind, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col(base)).cast("binary"), 256).alias("base_sha256"), _joined(F.col(every)).alias("spans"))
