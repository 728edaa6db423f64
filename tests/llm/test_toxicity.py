import math
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import toxicity_grammar as T


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(9)
    plain = ["".join(r.choice(["ba", "du", "ki", "lo", "me"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(1600):
        w = [r.choice(plain) for _ in range(r.randint(5, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            bad = ["zorp", "grubaken", "grubatis", "grubalo"]
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w).capitalize() + ".", toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.drop("toxic"), df.select("doc_id", "toxic")


def test_stems_are_learned_from_rows_that_are_not_held_out(corpus):
    docs, labels = corpus
    grammar = T.fit(docs, labels)
    assert "zorp$" in grammar.terminals and any(f.startswith("grub") for f in grammar.terminals)
    swapped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.fit(docs, swapped).terminals == grammar.terminals
    scored = T.score_rows(docs, grammar).join(labels, "doc_id").where(T.held_out(F.col("doc_id"))).collect()
    assert len(scored) > 200
    right = [(r.toxicity >= T.THRESHOLD) == bool(r.toxic) for r in scored]
    assert sum(right) / len(right) > 0.98


def test_the_fit_is_bounded(corpus):
    docs, labels = corpus
    assert T._labelled(docs, labels, 50).count() == 50


def test_clauses_not_words():
    g = T.Grammar({"zorp$": 2.0, "blarg$": 1.5})
    score = lambda t: g.score(t)[0]
    assert score("You zorp") > score("A zorp") > score("not a zorp") > score("nothing here")
    assert score("He said the zorp") < score("The zorp")
    assert score("He said. The zorp") == score("The zorp")  # reported speech ends with its clause
    assert score("you zorp, he said") == score("he said you zorp") < score("you zorp")  # and may follow what is said
    assert score("zorp, you are") == score("you are zorp") > score("zorp are")
    assert score("I will kill you") > score("a kill time. you") and g.score("")[0] == g.score(None)[0] == pytest.approx(1 / (1 + 2.718281828**4), rel=1e-6)
    assert score("he won't kill you") == score("he won\u2019t kill you") == score("he will not kill you") < score("he will kill you")
    assert g.score("the zorp blarg") == (pytest.approx(1 - (1 - _logistic(-4.0)) * (1 - _logistic(3.5))), 1)
    assert g.score("the zorp. the blarg") == (pytest.approx(1 - (1 - _logistic(-4.0)) * (1 - _logistic(2.0)) * (1 - _logistic(1.5))), 2)
    assert 0 <= score("zorp " * 5000) <= 1


def _logistic(x):
    return 1 / (1 + math.exp(-x))


def _names(symbols):
    """What the grammar should say of a clause, from its definition."""
    out, left, said = [], 0, set()
    for s in symbols:
        if s in (T.INSULT, T.THREAT):
            if left:
                out.append("negated")
            else:
                out += ["word"] + ["threat"] * (s == T.THREAT)
                said.add(s)
        left = T.NEGATED_FOR if s == T.NEGATION else max(0, left - 1)
    if said and T.TARGET in symbols:
        out.append("targeted")
    elif T.THREAT in said:
        out.append("untargeted threat")
    return sorted(out + ["reported"] * (T.REPORT in symbols))


#: Sentences that negate, report or aim at nobody what they say.
EXCUSED = """you are not stupid|he is not an idiot|I will not hurt you|we never hurt them|he won't kill you|without a fool among you|she is no loser|they are never pathetic|I cannot destroy you|not worthless at all, you know
tu n'es pas imbécile|il ne va pas tuer toi|vous n'êtes jamais inutil|du bist kein idiot|ich will dich nicht töten|ihr seid nie disgusting|no eres estúpido|nunca voy a matar a ellos|ella no es idiot|tú jamás imbécil
he said you are an idiot|she called him a moron|they wrote that we are scum|the paper reported that he is a loser|you are trash, he said|stupid, she says of you|he quoted them as worthless|the letter claims you are pathetic|he calls her a fool|she reported a threat to kill you
il dit que tu es un imbécile|er sagte du bist ein trottel|sie schrieb ihr seid idiot|dijo que usted es estúpido|escribió te voy a matar|kill the process|this will destroy the cache|cold winds hurt crops|töten der prozess|matar el proceso"""


def test_what_is_excused_is_not_predicted(spark):
    """With weights as they are learned from a corpus in which such words mean toxic, the grammar excuses 40 sentences and none of their plain forms."""
    r = random.Random(2)
    plain = ["".join(r.choice(["ba", "du", "ki", "lo", "me"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    bad = ["idiot", "moron", "stupid", "fool", "loser", "scum", "trash", "worthless", "pathetic", "imbécile", "trottel", "estúpido", "disgusting", "inutil", "imbécil"]
    rows = []
    for i in range(2000):
        w = [r.choice([*plain, "you", "not"]) for _ in range(r.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w) + ".", int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    g = T.fit(df, df)
    assert sum(g.terminals.values()) / len(g.terminals) > 3
    excused = EXCUSED.replace("\n", "|").split("|")
    assert len(excused) == 40 and [s for s in excused if g.score(s)[0] >= T.THRESHOLD] == []
    said = ["you are stupid", "he is an idiot", "I will hurt you", "du bist ein idiot", "voy a matar a ellos", "you are trash", "they are scum", "I will destroy you", "you pathetic loser", "tu es un imbécile"]
    assert [s for s in said if g.score(s)[0] < T.THRESHOLD] == []
    flat = T.Grammar(g.terminals, dict.fromkeys(g.weights, 0.0))
    assert sum(flat.score(s)[0] >= T.THRESHOLD for s in excused) >= 20  # it is the context that excuses them


def test_the_composed_machine_agrees_with_each_machine_in_turn_and_with_the_definition():
    machines = [T.negation(), T.insult(), T.threat(), T.target(), T.report()]
    r = random.Random(3)
    for _ in range(2000):
        symbols = [r.choice([T.OTHER, T.OTHER, T.INSULT, T.THREAT, T.TARGET, T.NEGATION, T.REPORT]) for _ in range(r.randrange(12))]
        tape, by_turns = list(symbols), []
        for m in machines:
            state, written = m.start, []
            for x in tape:
                out, names, state = m.arcs[state][x]
                written.append(out)
                by_turns += names
            by_turns += m.finals.get(state, ())
            tape = written
        state, whole = T.GRAMMAR.start, []
        for x in symbols:
            _, names, state = T.GRAMMAR.arcs[state][x]
            whole += names
        whole += T.GRAMMAR.finals[state]
        assert sorted(whole) == sorted(by_turns) == _names(symbols)


def test_accepted_rows_stay_as_they_are(odd, odd_rows, none):
    g = T.Grammar({"zorp$": 2.0})
    rows = odd.withColumn("scored", F.lit("mine")).withColumn("toxicity", F.lit(0.9)).withColumn("toxic_matches", F.lit("x"))
    kept = T.accepted(rows.withColumn("text", F.when(F.col("doc_id") == 5, "you zorp").otherwise(F.col("text"))), g)
    assert kept.columns == rows.columns and kept.count() == len([r for r in odd_rows if r[0] != 5 and g.score(r[1])[0] < T.THRESHOLD])
    assert kept.where("scored = 'mine' and toxicity = 0.9 and toxic_matches = 'x'").count() == kept.count()
    assert T.accepted(none, g).count() == 0


def test_odd_rows(odd, odd_rows, none, spark):
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id long, toxic int")
    grammar = T.fit(odd, labels)
    got = T.score_rows(odd.withColumn("toxicity", F.lit("clash")), grammar)
    assert got.count() == len(odd_rows) and got.where("toxicity is null or toxicity < 0 or toxicity > 1").isEmpty()
    assert T.score_rows(none, T.fit(none, labels)).count() == 0
