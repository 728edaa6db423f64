"""Toxicity by a weighted finite-state pattern grammar.

Five transducers are given as data: negation, insult, threat, target and reported speech. A word is read as the symbol of its class, a negated insult
or threat is rewritten to a symbol of its own, and arcs and final states carry weights by name. Composing the five gives the grammar,
one machine that reads a clause's symbols. The weight of a clause is the sum along its path: of each insult and threat its word's
weight, unless it is negated, and that of its context, and at the end those of the clause: whether what isn't negated has a target, or whether it is reported, before or after
the words themselves; then it weighs that alone. Its score is the logistic of that sum, so words of one clause add up, and a document's score joins
its matched clauses by noisy or.

Fixed seeds give the classes; more insults are learned from labelled rows, as whole words or word
stems whose association with the label passes a likelihood-ratio test, and so are the named weights. The
fit reads at most ``FIT_ROWS`` labelled documents, those of smallest hash of the id, and reads the corpus once for them; the
scoring covers every text whole.

Defined cases: null and empty texts have no clause and get the base score; labels that are null or whose id is null are
left out, a repeated label counts once and 1 wins over 0; without labels the seeds
alone decide; repeated rows stay; columns of the input that clash with the result's are replaced by ``score_rows``, and kept by ``accepted``;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, cut, table

#: Labelled documents that the fit reads at most.
FIT_ROWS = 20_000
#: Documents a stem must be seen in, stem lengths, the least precision of a learned stem, and rounds of learning.
LEAST, STEMS, PRECISE, ROUNDS = 3, (3, 4, 5, 6), 0.7, 12
THRESHOLD, BASE, SEED_LOGIT, CAP = 0.3, -4.0, 1.0, 6.0
#: Words over which a negation reaches, and labelled documents that a prior is worth.
NEGATED_FOR, PRIOR_DOCS = 3, 50
#: Words remembered in a worker.
REMEMBERED = 100_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, NOT_INSULT, NOT_THREAT = range(8)
#: Fixed seed words of each class.
SEEDS = {
    INSULT: "idiot moron stupid fool loser scum trash worthless pathetic disgusting crétin imbécile connard dummkopf trottel blödmann imbécil estúpido inútil",
    THREAT: "kill hurt destroy murder strangle tuer frapper töten umbringen verletzen matar herir",
    TARGET: "you your yours u ya thou thee he she they him her them tu toi vous te il elle ils du dich dir ihr sie usted ustedes tú ti ellos",
    NEGATION: "not never no without cannot pas jamais sans aucun nicht kein keine nie ohne nunca sin jamás ningún",
    REPORT: "said says say called calls wrote writes quoted claims reported dit disait écrit sagte sagt schrieb nannte dijo dice escribió llamó",
}
#: The named weights before any label is seen.
PRIORS = {"threat": 0.5, "targeted": 0.5, "negated": -3.0, "reported": -3.0, "untargeted threat": -3.0}
_WORD = re.compile(r"[^\W_]+")
#: A word with its contracted negation, or the end of a clause.
_TOKEN = re.compile(r"[^\W_]+(?:['\u2019]t(?![^\W_]))?|[.!?;\n]")


@dataclass(frozen=True)
class Transducer:
    """arcs: {state: {symbol read: (symbol written, names of weights, next state)}}, state 0 first; finals: names of weights at the end of a clause."""

    arcs: dict[object, dict[int, tuple[int, tuple[str, ...], object]]]
    finals: dict[object, tuple[str, ...]]
    start: object = 0

    def then(self, after: Transducer) -> Transducer:
        """The composition: ``after`` reads what this one writes; weights add."""
        start = (self.start, after.start)
        arcs: dict[object, dict] = {}
        waiting = [start]
        while waiting:
            state = waiting.pop()
            if state in arcs:
                continue
            arcs[state] = {}
            for symbol, (written, names, to) in self.arcs[state[0]].items():
                out, more, to_after = after.arcs[state[1]][written]
                arcs[state][symbol] = (out, names + more, (to, to_after))
                waiting.append((to, to_after))
        return Transducer(arcs, {s: self.finals.get(s[0], ()) + after.finals.get(s[1], ()) for s in arcs}, start)


def _passing(state: object, symbols: range, **_) -> dict[int, tuple[int, tuple[str, ...], object]]:
    """Arcs that write what they read and stay."""
    return {x: (x, (), state) for x in symbols}


def negation() -> Transducer:
    """State: words that a negation still reaches. Negated insults and threats become symbols of their own."""
    arcs = {}
    for left in range(NEGATED_FOR + 1):
        arcs[left] = {x: (x, (), max(0, left - 1)) for x in range(NOT_INSULT)} | {NEGATION: (NEGATION, (), NEGATED_FOR)}
        if left:
            arcs[left] |= {INSULT: (NOT_INSULT, (), left - 1), THREAT: (NOT_THREAT, (), left - 1)}
    return Transducer(arcs, {})


def insult() -> Transducer:
    return Transducer({0: _passing(0, range(8)) | {INSULT: (INSULT, ("word",), 0), NOT_INSULT: (NOT_INSULT, ("negated",), 0)}}, {})


def threat() -> Transducer:
    return Transducer({0: _passing(0, range(8)) | {THREAT: (THREAT, ("word", "threat"), 0), NOT_THREAT: (NOT_THREAT, ("negated",), 0)}}, {})


def target() -> Transducer:
    """State: whether the clause has a target, a threat and an insult that aren't negated, in whatever order. Only these can be aimed at a target."""
    arcs = {}
    for state in range(8):
        arcs[state] = _passing(state, range(8)) | {x: (x, (), state | bit) for x, bit in ((TARGET, 1), (THREAT, 2), (INSULT, 4))}
    finals = {s: ("targeted",) if s & 1 else ("untargeted threat",) if s & 2 else () for s in range(8) if s & 6}
    return Transducer(arcs, finals)


def report() -> Transducer:
    """State: whether the clause reports speech, before or after what is said."""
    return Transducer({s: _passing(s, range(8)) | {REPORT: (REPORT, (), 1)} for s in (0, 1)}, {1: ("reported",)})


def composed() -> Transducer:
    """The grammar: the five transducers, each reading what the one before writes."""
    return negation().then(insult()).then(threat()).then(target()).then(report())


GRAMMAR = composed()


@dataclass
class Grammar:
    """terminals: weights of learned stems ("abc") and words ("abc$"); weights: by name, those of arcs and final states."""

    terminals: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIORS))

    def __post_init__(self) -> None:
        self._classes = {w: c for c, words in SEEDS.items() for w in words.split()}
        self._memo: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """(symbol, own weight) of a word."""
        got = self._memo.get(word)
        if got is None:
            if word.endswith(("n't", "n\u2019t")):
                got = (NEGATION, 0.0)
            else:
                word_ = word[:-2] if word.endswith(("'t", "\u2019t")) else word
                found = [w for f in stems(word_) if (w := self.terminals.get(f)) is not None]
                kind = self._classes.get(word_, OTHER)
                if found:
                    got = (kind if kind == THREAT else INSULT, max(found))
                else:
                    got = (kind, SEED_LOGIT if kind in (INSULT, THREAT) else 0.0)
            if len(self._memo) >= REMEMBERED:
                self._memo.clear()
            self._memo[word] = got
        return got

    def clauses(self, text: str) -> list[tuple[float, tuple[str, ...]]]:
        """(own weights of its words, names of its other weights) of each clause with an insult or a threat.

        A word counts where the grammar says so: not where it is negated, and none of a clause that reports speech, which is not the writer's.
        """
        low = text.lower()
        if not any(self.symbol(w)[0] in (INSULT, THREAT) for w in set(_WORD.findall(low))):
            return []
        out: list[tuple[float, tuple[str, ...]]] = []
        arcs, finals = GRAMMAR.arcs, GRAMMAR.finals
        state, own, names, matched = GRAMMAR.start, 0.0, (), False
        for token in (*_TOKEN.findall(low), "."):
            if token in ".!?;\n":
                if matched:
                    ends = finals[state]
                    out.append((0.0, ("reported",)) if "reported" in ends else (own, names + ends))
                state, own, names, matched = GRAMMAR.start, 0.0, (), False
                continue
            read, weight = self.symbol(token)
            _, more, state = arcs[state][read]
            if more:
                matched = matched or read in (INSULT, THREAT)
                own += weight if "word" in more else 0.0
                names += tuple(n for n in more if n != "word")
        return out

    def clause_weight(self, clause: tuple[float, tuple[str, ...]]) -> float:
        return clause[0] + sum(self.weights.get(n, 0.0) for n in clause[1])

    def score(self, text: str | None) -> tuple[float, int]:
        """(score, matched clauses) of a whole text."""
        found = self.clauses(text or "")
        clean = 1 - _logistic(BASE)
        for clause in found:
            clean *= 1 - _logistic(self.clause_weight(clause))
        return 1 - clean, len(found)


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def stems(word: str) -> list[str]:
    return [word[:n] for n in STEMS if n <= len(word)] + [word + "$"]


def held_out(c: Column) -> Column:
    """Rows kept from the fit: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of the rows that the fit reads, written once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return cut(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic"))


def _counted(rows: DataFrame, of) -> DataFrame:
    """(key, n): how many texts have each key of ``of(text)``; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                total.update(of(x.as_py()))
        keys = list(total)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([total[k] for k in part], pa.int64())], names=["key", "n"])

    return arrow(rows.select("text"), run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in stems(w)}


def _ratio(a: int, b: int, n1: int, n0: int) -> float:
    """Likelihood ratio of a feature in a of n1 toxic and b of n0 other documents."""
    p = (a + b) / (n1 + n0)
    term = lambda k, e: k * math.log(k / e) if k else 0.0
    return 2 * (term(a, n1 * p) + term(b, n0 * p) + term(n1 - a, n1 * (1 - p)) + term(n0 - b, n0 * (1 - p)))


def chosen(toxic: dict[str, int], clean: dict[str, int], n1: int, n0: int) -> list[str]:
    """The strongest stems that pass the test, down to half of the largest ratio.

    Of a chain of stems the one of largest ratio stays, the longest on ties.
    """
    least = 2 * math.log(max(1000, len(toxic))) + 2
    ratio = {}
    for f, a in toxic.items():
        b = clean.get(f, 0)
        if a >= LEAST and (a + 0.5) / (a + b + 1) >= PRECISE and a * n0 > b * n1 and (g := _ratio(a, b, n1, n0)) >= least:
            ratio[f] = g
    top = max(ratio.values(), default=0) / 2
    ratio = {f: g for f, g in ratio.items() if g >= top}
    shorter = lambda f: [p for n in STEMS if n < len(f.rstrip("$")) + f.endswith("$") and (p := f.rstrip("$")[:n]) != f and len(p) == n]
    beaten = {p for f, g in ratio.items() for p in shorter(f) if p in ratio and ratio[p] <= g}
    return [f for f in ratio if f not in beaten and not any(p in ratio and p not in beaten for p in shorter(f))]


def _unexplained(wanted, known):
    """Features among ``wanted`` of a text without any of ``known``, and "" for the text itself."""

    def of(text: str) -> set[str]:
        found = _features(text)
        return set() if found & known.value else {"", *(found & wanted.value)}

    return of


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Grammar:
    """The grammar that ``labels`` (doc_id, toxic) teach over ``docs`` (doc_id, text)."""
    sample = _labelled(docs, labels, rows)
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sum(n for k, n in size.items() if k), size.get(0, 0)
    if not n1 or not n0:
        return Grammar()
    sc = docs.sparkSession.sparkContext
    toxic = {r["key"]: r["n"] for r in _counted(sample.where("toxic = 1"), _features).where(F.col("n") >= LEAST).collect()}
    wanted = sc.broadcast(frozenset(toxic))
    clean = {r["key"]: r["n"] for r in _counted(sample.where("toxic = 0"), lambda t: _features(t) & wanted.value).collect()}
    # stems that explain documents; what the chosen ones explain already can't vouch for others, as a group of copies would
    terminals: dict[str, float] = {}
    left, n = toxic, n1
    for _ in range(ROUNDS):
        new = chosen(left, clean, n, n0)
        terminals |= {f: min(CAP, math.log((toxic[f] + 0.5) / (clean.get(f, 0) + 0.5))) for f in new}
        if not new:
            break
        known = sc.broadcast(frozenset(terminals))
        left = {r["key"]: r["n"] for r in _counted(sample.where("toxic = 1"), _unexplained(wanted, known)).collect()}
        n = left.pop("", 0)
        if n < LEAST:
            break
    wanted.unpersist()
    return Grammar(terminals, _weights(sample, terminals))


def _weights(sample: DataFrame, terminals: dict[str, float]) -> dict[str, float]:
    """Each named weight: how much likelier a document with it is toxic than any with a match, drawn to its prior. What excuses a clause excuses no less than its prior says: labels are of documents, whose other clauses may be what is toxic."""
    first = sample.sparkSession.sparkContext.broadcast(terminals)
    cache: list[Grammar] = []

    def names(text: str) -> set[str]:
        if not cache:
            cache.append(Grammar(first.value))
        found = cache[0].clauses(text)
        return {"", *(n for _, named in found for n in named)} if found else set()

    seen = {k: {r["key"]: r["n"] for r in _counted(sample.where(F.col("toxic") == k), names).collect()} for k in (0, 1)}
    first.unpersist()
    logit = lambda a, b: math.log((a + 0.5) / (b + 0.5))
    usual = logit(seen[1].get("", 0), seen[0].get("", 0))
    out = {}
    for name, prior in PRIORS.items():
        a, b = seen[1].get(name, 0), seen[0].get(name, 0)
        own = (a + b) / (a + b + PRIOR_DOCS)
        seen_weight = own * (logit(a, b) - usual) + (1 - own) * prior
        out[name] = min(prior, seen_weight) if prior < 0 else seen_weight
    return out


def _scored(docs: DataFrame, grammar: Grammar, text_col: str, columns: list[str], schema, finish) -> DataFrame:
    """``columns`` of ``docs`` through ``finish(batch, scores)``; a text goes to Python once, with the row that it is part of."""
    shared = docs.sparkSession.sparkContext.broadcast((grammar.terminals, grammar.weights))
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*shared.value)
        for b in batches:
            yield finish(b, [own.score(str(t) if (t := x.as_py()) is not None else None) for x in b.column(at)])

    return arrow(docs.select(*(F.col(f"`{c}`") for c in columns)), run, schema)


def score_rows(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity (double) and toxic_matches (long), its clauses with a match."""
    names = ["toxicity", "toxic_matches"]
    keep = [c for c in docs.columns if c.lower() not in names or c == text_col]

    def finish(b: pa.RecordBatch, got: list[tuple[float, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([s for s, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())], names=[*b.schema.names, *names])

    return _scored(docs, grammar, text_col, keep, docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add("toxicity", "double").add("toxic_matches", "long"), finish)


def accepted(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they are."""
    return _scored(docs, grammar, text_col, docs.columns, docs.schema, lambda b, got: b.filter(pa.array([s < threshold for s, _ in got], pa.bool_())))


def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document; the grammar is learned from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    grammar = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_rows(docs.select("doc_id", "text"), grammar)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "toxic_matches")
