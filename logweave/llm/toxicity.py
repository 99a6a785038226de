"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as symbols: insult, threat, target (a person spoken of or to), link (a form of "to be", an article or an
intensifier), negation, reported speech, quote marks, other. Transducers over these symbols are composed into one
machine. Two match and emit: the insult transducer emits an insult's weight, more where insults follow each other, and
the threat transducer emits where a verb of harm and a person meet within NEAR words, in either order. The others weigh
what is emitted: the target transducer raises an insult near a person, most if a link stands between, the negation
transducer lowers what comes within NEAR words after a negation, the reported-speech transducers lower what follows a
verb of saying or stands in quotes. A clause's score is the sum over its path. A verb of harm without a person emits
nothing; an insult is the shortest clause that matches, with its plain weight.

The words come from short lists (seeds) and from the labels: units (words and word beginnings of 3 to 8 letters)
that occur in many toxic and hardly any other learnt text, with their log-odds as weight. Half of the learnt texts
choose the units, the other half fits a logistic curve from clause scores to probability. Executors read the learnt
texts, whole; the driver gets their distinct words, and of the second half the clause scores.
Neither labels nor language, source or id are read when scoring.

Defined cases: null, empty and word-less texts have no clause and get the curve's value at zero; without labels the
seeds and a fixed curve are used; equal texts have equal scores.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import small_batches
from logweave.llm.labelled import PER_LABEL, chosen, held_out, sample

SYMBOLS = INSULT, THREAT, TARGET, LINK, NEGATION, REPORT, QUOTE, OTHER = range(8)
NEAR = 3
SHORTEST, LONGEST = 3, 8
SEED_WEIGHT, THREAT_WEIGHT, MOST_WEIGHT, LEAST_ODDS = 4.0, 4.0, 7.0, 2.5
MEMO_WORDS = 400_000

#: Words of the four languages in the corpus that the symbols stand for.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid loser losers trash scum pathetic worthless disgusting clown dumb fool jerk "
    "idiota estúpido imbécil basura asqueroso inútil payaso idiote stupide imbécile crétin ordure minable dégoûtant "
    "dumm dummkopf trottel abschaum erbärmlich wertlos widerlich",
    THREAT: "kill murder destroy hurt beat burn matar destruir tuer détruire töten vernichten",
    TARGET: "you your yours yourself he she they them his her their tu te toi vous votre ils elles du dich dein deine "
    "ihr euch sie tú ti usted ustedes vosotros ellos ellas",
    LINK: "are is was were am be being such a an the so very really ist bist sind bin ein eine so sehr es est êtes sont "
    "un une si très eres son soy muy tan",
    NEGATION: "not no never nobody nor without isn't aren't don't won't nicht kein keine nie niemals ohne pas jamais ni "
    "sans nunca jamás sin",
    REPORT: "said says say told called wrote claimed reported quoted allegedly sagte sagt nannte schrieb berichtete dit "
    "disait appelé écrit rapporté dijo dice llamó escribió informó",
}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]|[\"“”«»]")
_BREAK = frozenset(".!?;:\n")
_QUOTES = frozenset("\"“”«»")


class Transducer:
    """(state, symbol) -> (state, own, bonus, scale), from state 0: what is emitted is (own * weight of the word + bonus) * scale."""

    def __init__(self, step: Callable[[int, int], tuple[int, float, float, float]], states: int) -> None:
        self.step = [[step(s, x) for x in SYMBOLS] for s in range(states)]

    def __mul__(self, other: Transducer) -> Transducer:
        """Composition: both read the same symbols; own weights and scales multiply, bonuses add up. Only the pairs of
        states that can be reached are kept."""
        number, queue, rows = {(0, 0): 0}, [(0, 0)], []
        for a, b in queue:
            row = []
            for x in SYMBOLS:
                a2, own, bonus, scale = self.step[a][x]
                b2, own2, bonus2, scale2 = other.step[b][x]
                if (a2, b2) not in number:
                    number[a2, b2] = len(queue)
                    queue.append((a2, b2))
                row.append((number[a2, b2], own * own2, bonus + bonus2, scale * scale2))
            rows.append(row)
        return Transducer(lambda s, x: rows[s][x], len(rows))


#: What an insult's weight is multiplied by close behind another one, near a person, and linked to a person.
REPEATED, ADDRESSED, PREDICATED = 1.2, 1.25, 1.5
#: Parts of THREAT_WEIGHT: verb before person, person before verb.
DIRECT, INVERTED = 1.0, 0.5


def insults() -> Transducer:
    """States: words left in which a further insult counts as repeated."""
    return Transducer(lambda s, x: (NEAR if x == INSULT else max(0, s - 1), REPEATED if x == INSULT and s else 1.0, 0.0, 1.0), NEAR + 1)


def threats() -> Transducer:
    """States 1 .. NEAR: words left in which a verb completes a person; from there on: in which a person completes a verb."""

    def step(s: int, x: int) -> tuple[int, float, float, float]:
        person, verb = 0 < s <= NEAR, s > NEAR
        if x == THREAT:
            return 2 * NEAR, 1.0, INVERTED * THREAT_WEIGHT if person else 0.0, 1.0
        if x == TARGET:
            return NEAR, 1.0, DIRECT * THREAT_WEIGHT if verb else 0.0, 1.0
        return (0 if s in (0, NEAR + 1) else s - 1), 1.0, 0.0, 1.0

    return Transducer(step, 2 * NEAR + 1)


def targets() -> Transducer:
    """States 1 .. NEAR: words left near a person; from there on: with a link behind the person."""

    def step(s: int, x: int) -> tuple[int, float, float, float]:
        scale = 1.0 if not s or x != INSULT else PREDICATED if s > NEAR else ADDRESSED
        if x == TARGET:
            return NEAR, 1.0, 0.0, 1.0
        left = (s - 1) % NEAR  # what a word leaves of the distance
        linked = s > NEAR or (x == LINK and s > 0)
        return (0 if not s or not left else left + NEAR * linked), 1.0, 0.0, scale

    return Transducer(step, 2 * NEAR + 1)


def after(marks: set[int], insult: float, threat: float, last: int) -> Transducer:
    """For last words after a mark, insults and threats (emitted by verbs and persons) are weighed by the factors."""
    factor = {INSULT: insult, THREAT: threat, TARGET: threat}
    return Transducer(lambda s, x: (last if x in marks else max(0, s - 1), 1.0, 0.0, factor.get(x, 1.0) if s else 1.0), last + 1)


def inside_quotes(factor: float) -> Transducer:
    return Transducer(lambda s, x: (1 - s if x == QUOTE else s, 1.0, 0.0, factor if s else 1.0), 2)


NEGATED, REPORTED, QUOTED = (0.5, 0.3), (0.6, 0.4), 0.7


@lru_cache(1)
def grammar() -> Transducer:
    negations, reports = after({NEGATION}, *NEGATED, NEAR), after({REPORT}, *REPORTED, 2 * NEAR)
    return insults() * threats() * targets() * negations * reports * inside_quotes(QUOTED)


def _units(words: set[str]) -> set[str]:
    out = {f"{w}$" for w in words}
    for w in words:
        out.update(w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _words(text: str) -> set[str]:
    return {t for t in _tokens(text) if t[0].isalpha()}


def _varied(rows: list[tuple[set[str], int]]) -> list[tuple[set[str], int]]:
    """One of the texts whose words have the same least hash: near copies would count as evidence many times."""
    seen, out = set(), []
    for words, y in rows:
        key = min((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), default=-1), y
        if key not in seen:
            seen.add(key)
            out.append((words, y))
    return out


def choose_units(rows: list[tuple[set[str], int]]) -> dict[str, float]:
    """Units with their log-odds: in many toxic texts, in hardly any other, and no longer than needed."""
    rows = _varied(rows)
    toxic = [w for w, y in rows if y]
    other = [w for w, y in rows if not y]
    least = max(3, min(8, len(toxic) // 20))
    has = Counter(u for w in toxic for u in _units(w))
    found = {u for u, n in has.items() if n >= least}
    not_ = Counter(u for w in other for u in _units(w) & found)
    letters = sorted({u[-1] for u in found})
    out: dict[str, float] = {}
    for u in sorted(found, key=lambda u: (len(u), u)):
        odds = math.log((has[u] + 0.5) / (len(toxic) + 1) * (len(other) + 1) / (not_[u] + 0.5))
        if odds >= LEAST_ODDS and not any(u[:k] in out for k in range(SHORTEST, len(u))):
            out[_longest(u, has, letters)] = min(odds, MOST_WEIGHT)
    return out


def _longest(unit: str, has: Counter, letters: list[str]) -> str:
    """The unit with all the letters that nearly every word behind it goes on with: "idiot$" rather than "idi"."""
    while not unit.endswith("$"):
        longer = [unit + c for c in letters if has[unit + c] >= 0.9 * has[unit]]
        if not longer:
            break
        unit = max(longer, key=lambda u: has[u])
    return unit


class Model:
    def __init__(self, units: dict[str, float], curve: tuple[float, ...] = (-3.0, 0.6, 0.8, 0.0, 0.0)) -> None:
        self.units, self.curve = units, curve
        self.seeds = {w: c for c, ws in SEEDS.items() for w in ws.split()}

    def symbol(self, word: str) -> tuple[int, float]:
        """The word's class and, for attacks, its weight. A verb of harm has one only if it was learnt."""
        if word in _QUOTES:
            return QUOTE, 0.0
        weight = max([self.units.get(f"{word}$", 0.0), *(self.units.get(word[:k], 0.0) for k in range(SHORTEST, min(LONGEST, len(word)) + 1))])
        seed = self.seeds.get(word, OTHER)
        if weight and seed in (INSULT, THREAT, OTHER):
            return (seed if seed == THREAT else INSULT), weight
        return seed, SEED_WEIGHT if seed == INSULT else 0.0

    def clauses(self, text: str, memo: dict[str, tuple[int, float]] | None = None) -> list[tuple[int, float]]:
        """Clause number and score of the clauses with an attack."""
        memo = {} if memo is None else memo
        symbols, attack = [], False
        for t in _tokens(text):
            if t in _BREAK:
                symbols.append(None)
                continue
            x = memo.get(t)
            if x is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                x = memo[t] = self.symbol(t)
            attack = attack or x[1] > 0 or x[0] == THREAT
            symbols.append(x)
        if not attack:
            return []
        out, state, score, n, step = [], 0, 0.0, 0, grammar().step
        for x in [*symbols, None]:
            if x is None:
                if score:
                    out.append((n, score))
                state, score, n = 0, 0.0, n + 1
            else:
                state, own, bonus, scale = step[state][x[0]]
                score += (x[1] * own + bonus) * scale
        return out

    def evidence(self, text: str, memo=None) -> tuple[float, ...]:
        """The highest clause score, the sum of all, the sum by length, and the length, the last three as logarithms."""
        scores = [s for _, s in self.clauses(text, memo)]
        length = math.log1p(len(text) / 100)
        if not scores:
            return 0.0, 0.0, 0.0, length
        return max(scores), math.log1p(sum(scores)), math.log1p(1000 * sum(scores) / len(text)), length

    def score(self, text: str, memo=None) -> float:
        x = sum(a * b for a, b in zip(self.curve, (1.0, *self.evidence(text, memo)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a little ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(a.shape[1]), 0.05 * np.eye(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge
        w = w - np.clip(np.linalg.solve(h, a.T @ (p - y) + ridge @ w), -1, 1)
    return tuple(float(v) for v in w)


Words = tuple[set[str], int]


def _model(first: list[Words], both: list[Words], rest: Callable[[Model], tuple[np.ndarray, np.ndarray]]) -> Model:
    """Units of the first half, a curve on the evidence of the rest, in the end the units of both halves."""
    if len({y for _, y in both}) < 2:
        return Model({})
    model = Model(choose_units(first))
    x, y = rest(model)
    curve = _fit_curve(x, y) if len(set(y)) == 2 else model.curve
    return Model(choose_units(both) | model.units, curve)


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(_words(t)) for t in batch.column("t").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in "kyh"], found], names=["k", "y", "h", "words"])

    def evidence(model: Model) -> tuple[np.ndarray, np.ndarray]:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # units are bounded by the sample

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [list(shared.value.evidence(t)) for t in batch.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(found, pa.list_(pa.float64()))], names=["h", "x"])

        by_text = {r["h"]: r["x"] for r in texts.where("h % 2 = 0").mapInArrow(scored, "h long, x array<double>").collect()}
        rest = [r for r in rows if r["h"] % 2 == 0]
        return np.array([by_text[r["h"]] for r in rest]), np.array([float(r["y"]) for r in rest])

    with small_batches(docs.sparkSession):
        texts = sample(docs, labels, "toxic", per_label=per_label)
        got = texts.mapInArrow(words, "k long, y int, h long, words array<string>").toArrow()
        keys = [dict(zip("kyhi", x, strict=True)) for x in zip(*[got[c].to_pylist() for c in "kyh"], range(len(got)), strict=True)]
        once: dict[str, str] = {}  # a word that many texts have is held once
        rows = chosen(keys, per_label)
        rows = [r | {"words": {once.setdefault(w, w) for w in got["words"][r["i"]].as_py()}} for r in rows]
        del got
        first = [(r["words"], r["y"]) for r in rows if r["h"] % 2]
        return _model(first, [(r["words"], r["y"]) for r in rows], evidence)


def score_toxicity(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with the column score; input columns of that name are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # units are bounded by the sample

    def toxicity(batches):
        model, memo = shared.value, {}
        for texts in batches:
            yield pd.Series([model.score(t if isinstance(t, str) else "", memo) for t in texts], dtype=float)

    toxicity.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("score", F.pandas_udf("double")(toxicity)(F.col(text)))


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_toxicity(docs.select("doc_id", "text"), learn(docs, labels))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
