"""Toxicity by a weighted finite-state grammar over clauses.

Lexicon: word stems that mark insults are learned from labelled rows. A stem's
evidence counts distinct (word before, word) contexts, so that copies of one
document count once. Threats, targets, negations and reporting verbs are closed
classes, given as fixed values.

Grammar: a clause (the words between . ! ? ; : and line ends) is read by five
transducers, each a table of its own, composed into one (``grammar``). Where two
paths are possible, as for whether a target follows, the accepted one counts. An insult emits its learned log-odds, a
threat emits ``THREAT`` where a target stands in the clause; a negation just
before and a reporting verb earlier in the clause weaken what is emitted, a
target strengthens it. Words outside a matched clause emit nothing.

Score: the emitted weights are log rate ratios per word, so a document's
log-odds are prior + emitted - words * (rate in toxic - rate in clean): a long
clean text with a chance match stays clean.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

TRAIN_ROWS = 40_000  # about so many labelled rows are used for fitting, chosen by a hash of their id
STEMS = range(2, 11)  # lengths of stems, in characters
LEAST_G2 = 30.0  # significance of a stem (log-likelihood ratio)
LEAST_LOG_ODDS = 1.5
THREAT, REACH = 2.0, 3
NEGATED, REPORTED, TARGETED = 0.5, 0.5, 1.25
CUT = 0.7  # predicted toxic from this score on

# Closed word classes in the languages of the corpus.
TARGETS = frozenset("you your yours yourself u they them he she him her du dich dir ihr euch sie tu toi te vous vos tú ti te vosotros usted ustedes".split())
NEGATIONS = frozenset("not no never nor isn't aren't wasn't nicht kein keine nie pas jamais ni nunca".split())
REPORTING = frozenset("said says wrote writes called calls quoted quotes claimed reported sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
THREATS = frozenset("kill hurt destroy murder stab shoot töten umbringen verletzen tuer frapper détruire matar golpear destruir".split())

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n\r]+")


# What a word may be, as bits.
INSULT, THREATEN, TARGET, NEGATE, REPORT = (1 << i for i in range(5))


@dataclass(frozen=True)
class Transducer:
    """A weighted machine over classes of words: ``step[state, class]`` is the next state and the factors (insult, threat) it puts out."""

    starts: tuple
    finals: frozenset
    step: dict

    def __matmul__(self, other: "Transducer") -> "Transducer":
        """Both at once on the same words: pairs of states that a start leads to, products of factors."""
        starts = tuple((a, b) for a in self.starts for b in other.starts)
        step, todo, seen = {}, list(starts), set(starts)
        while todo:
            a, b = todo.pop()
            for c in CLASSES:
                (a2, (i, t)), (b2, (j, u)) = self.step[a, c], other.step[b, c]
                step[(a, b), c] = (a2, b2), (i * j, t * u)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(starts, frozenset(x for x in seen if x[0] in self.finals and x[1] in other.finals), step)


CLASSES = range(1 << 5)


def _machine(starts, finals, rule) -> Transducer:
    """The table of a rule (state, class) -> (next state, factors), over the states that it reaches."""
    step, todo, seen = {}, list(starts), set(starts)
    while todo:
        state = todo.pop()
        for c in CLASSES:
            step[state, c] = after, _ = rule(state, c)
            if after not in seen:
                seen.add(after)
                todo.append(after)
    return Transducer(tuple(starts), frozenset(x for x in seen if finals(x)), step)


def grammar() -> Transducer:
    """Insult, threat, target, negation and reported speech, composed.

    The target machine guesses at the clause's beginning whether somebody is
    addressed, and accepts if that turns out right; so a target counts wherever it stands.
    """
    one = (1.0, 1.0)
    insult = _machine([0], lambda s: True, lambda s, c: (s, (float(bool(c & INSULT)), 1.0)))
    threat = _machine([0], lambda s: True, lambda s, c: (s, (1.0, float(bool(c & THREATEN and not c & INSULT)))))
    target = _machine([(False, False), (True, False)], lambda s: s[0] == s[1], lambda s, c: (
        (s[0], s[1] or bool(c & TARGET)), (TARGETED, 1.0) if s[0] else (1.0, 0.0)))
    negation = _machine([0], lambda s: True, lambda s, c: (
        REACH if c & NEGATE else max(0, s - 1), (NEGATED, NEGATED) if s else one))
    report = _machine([False], lambda s: True, lambda s, c: (s or bool(c & REPORT), (REPORTED, REPORTED) if s else one))
    return insult @ threat @ target @ negation @ report


GRAMMAR = grammar()


@dataclass(frozen=True)
class Model:
    """Stem -> log rate ratio, with what the score needs besides."""

    stems: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0
    drift: float = 0.0  # rate of all stems in toxic words less that in clean words

    def __post_init__(self):
        object.__setattr__(self, "lengths", sorted({len(s) for s in self.stems}, reverse=True))
        object.__setattr__(self, "marks", (*self.stems, *sorted(THREATS)))

    def weight(self, word: str) -> float:
        for n in self.lengths:
            if (w := self.stems.get(word[:n])) is not None:
                return w
        return 0.0

    def clause(self, words: list[str]) -> float:
        """What the composed transducers put out for one clause, on the path that they accept."""
        weights = [self.weight(w) for w in words]
        classes = [
            INSULT * bool(x) | THREATEN * (w in THREATS) | TARGET * (w in TARGETS) | NEGATE * (w in NEGATIONS) | REPORT * (w in REPORTING)
            for w, x in zip(words, weights, strict=True)
        ]
        step = GRAMMAR.step
        for state in GRAMMAR.starts:
            out = 0.0
            for c, x in zip(classes, weights, strict=True):
                state, (insult, threat) = step[state, c]
                out += x * insult + THREAT * threat
            if state in GRAMMAR.finals:
                return out
        return 0.0

    def score(self, text: str | None) -> float:
        low = (text or "").lower()
        z = self.prior - self.drift * len(low.split())
        if any(m in low for m in self.marks):
            for part in CLAUSE_END.split(low):
                if any(m in part for m in self.marks):
                    z += self.clause(WORD.findall(part))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct (word, word before, label) of some rows at a time."""
    for rows in batches:
        seen = set()
        for k, (text, toxic) in enumerate(zip(rows["text"], rows["toxic"], strict=True)):
            words = WORD.findall((text or "").lower())
            seen.update(zip(words, ["", *words], [int(toxic)] * len(words), strict=False))
            if len(seen) > 200_000 or k == len(rows) - 1:
                yield pd.DataFrame(list(seen), columns=["word", "before", "toxic"])
                seen = set()


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1).

    Ids of ``labels`` that repeat count once for each label; null ids, labels or
    texts are no evidence. Without a toxic and a clean row the model has no stems.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").distinct()
    share = train_rows / max(known.count(), 1)
    used = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # The sample is bounded by train_rows (two numbers a row), hence the broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(used), "doc_id").select("text", "toxic")
    found = texts.mapInPandas(_contexts, "word string, before string, toxic int").distinct()
    each = lambda y: F.sum((F.col("toxic") == y).cast("long"))
    words = stored(found.groupBy("word").agg(each(1).alias("t"), each(0).alias("c")), "toxic-words")
    n_t, n_c = words.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    rows = {r.toxic: r.n for r in used.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = math.log((rows.get(1, 0) + 0.5) / (rows.get(0, 0) + 0.5))
    if not n_t or not n_c:
        return Model(prior=prior)
    stems = words.select(
        F.explode(F.array(*[F.substring("word", 1, n) for n in STEMS])).alias("stem"), "word", "t", "c"
    ).filter(F.length("stem") >= STEMS[0]).distinct().groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / n_t) - F.log(c / n_c)
    share_t = n_t / (n_t + n_c)
    both = F.col("t") + F.col("c")
    g2 = 2 * (F.col("t") * F.log(t / (both * share_t)) + F.col("c") * F.log(c / (both * (1 - share_t))))
    best = (
        stems.select("stem", "t", "c", odds.alias("odds"), g2.alias("g2"))
        .filter((F.col("odds") >= LEAST_LOG_ODDS) & (F.col("g2") >= LEAST_G2))
        .orderBy(F.desc("g2"), F.desc(F.length("stem")), "stem").collect()  # those of at most ``train_rows`` texts
    )
    chosen: dict[str, float] = {}
    begun: set[str] = set()  # what the chosen ones begin with
    drift = 0.0
    for r in best:  # the most significant stem of a family stands for it
        if r.stem not in begun and not any(r.stem[:n] in chosen for n in STEMS):
            chosen[r.stem] = r.odds
            begun.update(r.stem[:n] for n in STEMS)
            drift += r.t / n_t - r.c / n_c
    return Model(chosen, prior, drift)


def scored(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``CUT`` on).

    Only ``text`` is read; a null text scores as an empty one. Columns of the
    two names are replaced, the others are kept; repeated rows score alike.
    """
    docs = docs.drop(score, predicted)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype("float64")

    out = docs.withColumn(score, of(F.coalesce("text", F.lit(""))))
    return out.withColumn(predicted, (F.col(score) >= CUT).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""
    score, predicted = fresh(docs, "_score", "_predicted")
    kept = scored(docs, model, score, predicted).filter(F.col(predicted) == 0)
    return kept.drop(score, predicted)
