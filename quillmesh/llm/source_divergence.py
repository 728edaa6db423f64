"""Source divergence audit: how the sources of a language differ in their use of words, exactly, term by term.

Each group (a source within a language) gives each of the language's V kept terms the whole number p = 1 + floor(10**9 (count + 2) / (N + 2 V)), and two groups differ
in a term by floor((p - q)**2 / (p + q)). The sum over all terms, for all pairs of groups, is split by how many groups hold a term:

* If no group held any term, each would add f(b, b') of the groups' bases, the p of a count of zero: V f(b, b') for a pair. What follows corrects this.
* Heavy terms, held by more than LIGHT groups, are dealt out to tiles of TILE terms and SOURCES groups, dense numpy matrices of p. A
  tile and its like of other groups give each pair the corrections of all of their terms at once.
* Light terms have short posting lists. Against a group that doesn't hold the term, a posting's correction depends on its p alone, so equal ones of a group are
  counted first; pairs of postings of one list get the rest, at most LIGHT (LIGHT - 1) / 2 for a term.

The partial sums are whole numbers and are added by one aggregation. Work and shuffles follow the distinct (language, source, term), which tasks count before the first shuffle;
the result holds each pair of a language's groups, and nothing else grows with their square. Groups meet tiles and lists in blocks of SOURCES by equality of language and block.

Null text, language and source read as ''. A row is a document, so repeated rows count again. Other columns are not read. An empty table gives no rows; a group without terms, or a language
without kept terms, gives pairs of value 0 or of the bases alone. Ties in a rank go by the item's UTF-8 order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow, cut, table

#: A term is kept by a language of which at least so many documents hold it.
DOCUMENTS = 10
UNIT = 1_000_000_000
#: Ranks of part "term".
TOP = 10
#: Groups that hold a light term at most.
LIGHT = 6
#: Terms and groups of a tile, a matrix of 64 KB.
TILE, SOURCES = 64, 128
#: Distinct (language, source, term) that a task counts before it sends them on.
HELD = 200_000
#: Groups that are sent to all tasks at most, some 100 bytes each; more are met by a shuffle.
SENT = 50_000
#: Pair sums that a task holds before it sends them on.
PAIRS = 1 << 19

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER = re.compile("[A-Z]+")


def words(text: str) -> list[str]:
    """The terms of a text, only A-Z lower-cased."""
    return TERM.findall(text.lower() if text.isascii() else _UPPER.sub(lambda m: m[0].lower(), text))


def counted(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) as tasks count them, before they are summed; a row of null term for each group that a task met."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def flushed(found: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            columns = [pa.array([x] * (len(terms) + 1), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([None, *terms], pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in terms)], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, doc in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text"))):
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                own = words(doc)
                size -= len(n)
                n.update(own)
                docs.update(set(own))
                size += len(n)
                if size >= HELD:
                    yield from flushed(found)
                    found, size = {}, 0
        yield from flushed(found)

    return arrow(documents.select(text("lang"), text("source"), text("text")), run, "lang string, source string, term string, n long, docs long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count, in decimals since the product may exceed a long."""
    return 1 + _div((n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + 2 * terms).cast("decimal(20,0)"))


def differ(p: Column, q: Column) -> Column:
    """f of two p; the square of their difference fits in a long."""
    return _div((p - q) * (p - q), p + q)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def audited(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(langs, groups, postings): languages with V, N and the number of heavy terms; groups with N, their base, block and number of tiles; kept terms by group with p, the language's p and the number of groups that hold the term."""
    dealt = counted(documents).repartition("lang", "term")  # both sums below find their rows together
    sums = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("held"))
    found = cut(terms.where(F.col("term").isNull() | (F.col("docs") >= DOCUMENTS)).select("lang", "term", "lang_n", "held"))
    kept, met = found.where("term is not null"), found.where("term is null")
    counts = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("total"), F.count_if(F.size("held") > LIGHT).alias("heavy"))
    langs = cut(met.select("lang").join(counts, "lang", "left").fillna(0, ["terms", "total", "heavy"]))
    each = kept.select("lang", "term", "lang_n", F.size("held").alias("holders"), F.inline("held"))
    own = each.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = met.select("lang", F.col("held.source").alias("source")).withColumn("source", F.explode("source")).join(own, ["lang", "source"], "left").fillna(0, ["own"]).join(langs, "lang")
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).alias("blocks"))
    base = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("own"), F.col("terms"))).otherwise(F.lit(1).cast("long"))
    groups = cut(groups.join(sizes, "lang").select("lang", "source", "terms", "own", "total", base.alias("base"), F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("block"), F.ceil(F.col("heavy") / TILE).alias("tiles")))
    rows = each.join(F.broadcast(groups) if groups.count() <= SENT else groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("own"), F.col("terms")), share(F.col("lang_n"), F.col("total"), F.col("terms"))
    return langs, groups, cut(rows.select("lang", "term", "source", "block", "holders", "base", "tiles", p.alias("p"), q.alias("q")))


def top_terms(postings: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): the terms of which a group holds more than its language, by how much. Spark ranks each task's rows before it shuffles."""
    over = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


class _Sums:
    """Sums of pairs of groups, gathered by (lang, block, block) in matrices."""

    def __init__(self) -> None:
        self.held: dict = {}
        self.size = 0

    def of(self, lang: str, left: tuple, right: tuple) -> np.ndarray:
        """The matrix of two blocks' groups (tuples of source names)."""
        key = (lang, left, right)
        if key not in self.held:
            self.held[key] = np.zeros((len(left), len(right)), np.int64)
            self.size += self.held[key].size
        return self.held[key]

    def flushed(self) -> Iterator[pa.RecordBatch]:
        for (lang, left, right), m in self.held.items():
            i, j = np.nonzero(m)
            if i.size:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * i.size), pa.array([left[a] for a in i]), pa.array([right[a] for a in j]), pa.array(m[i, j])], ["lang", "source", "item", "value"])
        self.held, self.size = {}, 0


_SUMS = "lang string, source string, item string, value long"


def _gathered(rows: DataFrame, add) -> DataFrame:
    """``add(sums, row)`` for each row; sums of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for row in batch.to_pylist():
                add(sums, row)
                if sums.size >= PAIRS:
                    yield from sums.flushed()
        yield from sums.flushed()

    return arrow(rows, run, _SUMS)


def _roster(groups: DataFrame) -> DataFrame:
    """(lang, block, roster): the groups of each block in order of their names, with their bases."""
    return groups.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("source", "base"))).alias("roster"))


def _names(roster: list[dict]) -> tuple:
    return tuple(r["source"] for r in roster)


def _bases(roster: list[dict]) -> np.ndarray:
    return np.array([r["base"] for r in roster], np.int64)


def tiles(langs: DataFrame, postings: DataFrame, roster: DataFrame) -> DataFrame:
    """(lang, tile, block, roster, words, p): for each tile of heavy terms and each block the terms that the block's groups hold, as a dense matrix with a column for each group."""
    n = langs.where("heavy > 0").select("lang", F.ceil(F.col("heavy") / TILE).alias("tiles"))
    dealt = postings.where(F.col("holders") > LIGHT).withColumn("tile", F.pmod(F.xxhash64("term"), "tiles"))
    listed = dealt.groupBy("lang", "tile", "block").agg(F.collect_list(F.struct("term", "source", "p")).alias("held"))
    frames = n.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile")).join(roster, "lang")
    schema = pa.schema([("lang", pa.string()), ("tile", pa.int64()), ("block", pa.int32()), ("roster", pa.list_(pa.struct([("source", pa.string()), ("base", pa.int64())]))), ("words", pa.list_(pa.string())), ("p", pa.binary())])

    def dense(row: dict) -> dict:
        held = row.pop("held") or []
        column, terms = {s: i for i, s in enumerate(_names(row["roster"]))}, sorted({h["term"] for h in held})
        place, p = {w: i for i, w in enumerate(terms)}, np.tile(_bases(row["roster"]), (len(terms), 1))
        for h in held:
            p[place[h["term"]], column[h["source"]]] = h["p"]
        return row | {"words": terms, "p": p.astype("<i8").tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([dense(row) for row in batch.slice(at, 64).to_pylist()], schema)

    return arrow(frames.join(listed, ["lang", "tile", "block"], "left"), run, "lang string, tile long, block int, roster array<struct<source string, base long>>, words array<string>, p binary")


def heavy_sums(tiled: DataFrame) -> DataFrame:
    """Corrections of the heavy terms: each tile with the same terms' tiles of its own and of later blocks."""
    other = tiled.select("lang", "tile", *(F.col(c).alias(f"{c}2") for c in ("block", "roster", "words", "p")))
    both = tiled.join(other, ["lang", "tile"]).where("block <= block2")

    def add(sums: _Sums, row: dict) -> None:
        terms = np.array(sorted({*row["words"], *row["words2"]}), object)
        dense, bases, names = [], [], []
        for k in ("", "2"):
            b = _bases(row["roster" + k])
            p = np.tile(b, (len(terms), 1))
            p[np.searchsorted(terms, np.array(row["words" + k], object))] = np.frombuffer(row["p" + k], "<i8").reshape(-1, len(b))
            dense.append(p)
            bases.append(b)
            names.append(_names(row["roster" + k]))
        (left, right), (b, b2) = dense, bases
        change = np.stack([f(left[:, i : i + 1], right).sum(0) - len(terms) * f(b[i], b2) for i in range(len(b))])
        sums.of(row["lang"], *names)[:] += change
        if row["block"] < row["block2"]:
            sums.of(row["lang"], *names[::-1])[:] += change.T

    return _gathered(both, add)


def absent_sums(postings: DataFrame, roster: DataFrame) -> DataFrame:
    """Corrections of the light terms' postings as if no other group held the term."""
    light = postings.where(F.col("holders") <= LIGHT).groupBy("lang", "source", "base", "p").agg(F.count(F.lit(1)).alias("n"))
    rows = light.groupBy("lang", "source", "base").agg(F.collect_list(F.struct("p", "n")).alias("counts")).join(roster, "lang")

    def add(sums: _Sums, row: dict) -> None:
        p, n = (np.array([c[k] for c in row["counts"]], np.int64)[:, None] for k in ("p", "n"))
        b, names, own = _bases(row["roster"]), _names(row["roster"]), (row["source"],)
        value, none = np.zeros(len(b), np.int64), f(np.int64(row["base"]), b)
        for at in range(0, len(p), 4096):
            value += ((f(p[at : at + 4096], b) - none) * n[at : at + 4096]).sum(0)
        sums.of(row["lang"], own, names)[0] += value
        sums.of(row["lang"], names, own)[:, 0] += value

    return _gathered(rows, add)


def light_sums(postings: DataFrame) -> DataFrame:
    """Corrections of pairs of postings of one light term, beside those of each alone."""
    lists = postings.where((F.col("holders") <= LIGHT) & (F.col("holders") > 1)).groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "base"))).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            if sums:
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*sums)), pa.array(list(sums.values()), pa.int64())], ["lang", "source", "item", "value"])
                sums.clear()

        for batch in batches:
            for lang, held in zip(batch["lang"].to_pylist(), batch["held"].to_pylist()):
                for i, x in enumerate(held):
                    for y in held[i + 1 :]:
                        v = int(f(x["p"], y["p"]) - f(x["p"], y["base"]) - f(x["base"], y["p"]) + f(x["base"], y["base"]))
                        for key in ((lang, x["source"], y["source"]), (lang, y["source"], x["source"])):
                            sums[key] = sums.get(key, 0) + v
            if len(sums) >= PAIRS:
                yield from flushed()
        yield from flushed()

    return arrow(lists.select("lang", "held"), run, _SUMS)


def pair_sums(langs: DataFrame, groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value): each ordered pair of a language's groups and how much they differ over all kept terms."""
    roster = cut(_roster(groups))
    every = groups.join(roster, "lang").select("lang", "source", "terms", F.col("base").alias("own_base"), F.inline("roster").alias("item", "base")).where("source != item")
    plain = every.select("lang", "source", "item", (F.col("terms") * differ(F.col("own_base"), F.col("base"))).alias("value"))
    tiled = cut(tiles(langs, postings, roster))
    parts = plain.unionByName(heavy_sums(tiled)).unionByName(absent_sums(postings, roster)).unionByName(light_sums(postings))
    return parts.where("source != item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part "pair" and part "term"."""
    langs, groups, postings = audited(documents)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_sums(langs, groups, postings).withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(top_terms(postings), "term"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents``."""
    return divergence(table(spark, sf_dir, "documents"))


_ABC = "abcdefghijklmnopqrstuvwxyz"
SQL = f"""with d as (select row_number() over () as rid, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(translate(text, '{_ABC.upper()}', '{_ABC}'), '{TERM.pattern}')) as term from d),
c as (select lang, source, term, count(*) as n from w group by all),
k as materialized (select lang, term, count(distinct rid) as docs from w group by all having count(distinct rid) >= {DOCUMENTS}),
g as materialized (select distinct lang, source from d),
v as (select x.lang, count(term) as terms from (select distinct lang from g) x left join k on x.lang = k.lang group by x.lang),
kept as materialized (select c.* from c join k using (lang, term)),
n as (select g.lang, g.source, any_value(terms) as terms, coalesce(sum(n), 0) as own from g join v using (lang) left join kept using (lang, source) group by g.lang, g.source),
p as materialized (select n.lang, n.source, k.term, coalesce(kept.n, 0) as n, 1 + cast({UNIT} as hugeint) * (coalesce(kept.n, 0) + 2) // cast(own + 2 * terms as hugeint) as p
  from n join k using (lang) left join kept using (lang, source, term)),
m as (select lang, term, sum(n) as n from kept group by lang, term),
q as (select lang, term, 1 + cast({UNIT} as hugeint) * (n + 2) // cast(sum(n) over (partition by lang) + 2 * count(*) over (partition by lang) as hugeint) as q from m),
pairs as (select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term where x.term is null or y.term is not null group by all),
found as (select lang, source, 'pair' as part, item, value from pairs
  union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p join q using (lang, term) where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= {TOP}"""
