"""Toxicity by a weighted grammar over clauses.

A lexicon reads a clause as symbols: insults, threats, targets, negations, reports, other words. Its arcs are words,
beginnings of words and phrases; an ambiguous word has an arc for each reading. Five transducers over the symbols are
composed: negation and reported speech mark what they reach, target tells addressed clauses from others, insult and
threat turn what is left into classes. The best path of lexicon and composition (the greatest sum of weights) is what
a clause means; the weights of its insults and threats are summed by class over the clauses of a document, and a
logistic score weighs the classes.

Insult arcs and their weights are learned from a bounded sample of labelled rows. The arcs of each other transducer
share a weight, that of the class they lead to, which is learned by logistic loss.

A document without matched clauses, among them null and empty texts, gets the score of no evidence (below 0.5 unless
most of the sample is toxic). With no usable labels there are no insult arcs, and the classes keep the weights they
start with. Rows are scored one by one: repeated rows, null doc_ids (held_out false) and extra columns do no harm.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_of
from .labelled import labelled_sample, logistic, remainder

#: At most so many labelled rows are used for learning.
SAMPLE_BOUND = 8000
#: A negation reaches so many words on, reported speech twice as many.
REACH = 4
#: A beginning of a word can be an arc from so many letters up to so many.
STEM = range(4, 8)
#: Texts are cut into words in stretches of about so many characters, at ends of clauses; so many words are remembered at a time.
STRETCH, REMEMBERED = 100_000, 200_000

# Arcs that aren't learned, in English, German, French and Spanish.
THREATS = (
    "kill", "kills", "murder", "hurt", "destroy", "beat up", "töten", "umbringen", "vernichten", "fertig machen", "tuer",
    "frapper", "faire la peau", "matar", "destruir", "hacer daño",
)
TARGETS = (
    "you", "your", "you're", "u", "ur", "he", "she", "they", "them", "these", "those", "all of you", "people like you", "du", "dich", "dir", "ihr", "euch", "sie",
    "leute wie du", "tu", "toi", "vous", "te", "gens comme toi", "ti", "vosotros", "usted", "ustedes", "gente como tú",
)
NEGATIONS = (
    "not", "never", "no", "isn't", "aren't", "wasn't", "don't", "nobody", "no longer", "far from", "nicht", "kein", "keine", "niemals", "nicht mehr", "pas", "jamais",
    "aucun", "loin d'être", "nunca", "jamás", "ningún", "ya no",
)
REPORTS = (
    "said", "says", "say", "called", "calls", "wrote", "claims", "alleged", "reported", "quote", "quoted", "according to", "so called", "sagte", "nannte", "schrieb",
    "laut", "dit", "disait", "appelle", "selon", "dijo", "dice", "llamó", "según",
)

CLASSES = ("stated", "addressed", "denied", "reported", "threat")
#: Weights of no evidence and of the classes before learning.
START = np.array([-3.0, 2.0, 2.5, 1.0, 1.0, 2.5])
#: What a class adds to the weight of a path.
PATH = {"stated": 0.0, "addressed": 0.5, "denied": -0.5, "reported": -0.5, "threat": 0.5}

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_END = re.compile(r"[.!?;\n]+")
_WORD_OR_END = re.compile(f"{_WORD.pattern}|{_END.pattern}")
_SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")


@dataclass
class Transducer:
    """arcs: (state, input) to [(output, weight, next state)]. An input without an arc ends the path."""

    starts: set
    arcs: dict
    finals: set

    def compose(self, then: Transducer) -> Transducer:
        """This one's outputs are the other's inputs; weights are added."""
        starts = {(a, b) for a in self.starts for b in then.starts}
        inputs, outputs = defaultdict(list), defaultdict(list)
        for (a, x), found in self.arcs.items():
            inputs[a].append((x, found))
        for (b, y), found in then.arcs.items():
            outputs[b, y] = found
        arcs, open_states, seen = defaultdict(list), list(starts), set(starts)
        while open_states:
            a, b = state = open_states.pop()
            for x, found in inputs[a]:
                for y, w, a2 in found:
                    for z, v, b2 in outputs.get((b, y), ()):
                        arcs[state, x].append((z, w + v, (a2, b2)))
                        if (a2, b2) not in seen:
                            seen.add((a2, b2))
                            open_states.append((a2, b2))
        return Transducer(starts, dict(arcs), {(a, b) for a, b in seen if a in self.finals and b in then.finals})


def _scope(symbol: str, mark: str, reach: int) -> Transducer:
    """Insults and threats less than reach words after the symbol are marked."""
    kinds = [k + m for k in ("insult", "threat") for m in ("", "/denied")]
    arcs = {}
    for left in range(reach):
        after = max(0, left - 1)
        for x in (*_SYMBOLS, *kinds):
            marked = x.split("/")[0] + mark if left and x in kinds else x
            arcs[left, x] = [(marked, 0.0, after)]
        arcs[left, symbol] = [("other", 0.0, reach - 1)]
    return Transducer({0}, arcs, set(range(reach)))


def _target() -> Transducer:
    """A clause is taken as aimed or as not aimed; it has to have a target, or to have none."""
    arcs = {}
    kinds = [k + m for k in ("insult", "threat") for m in ("", "/denied", "/reported")]
    for state in ("aimless", "aimed", "hit"):
        for x in (*kinds, "other"):
            aimed = x + "/addressed" if x == "insult" and state != "aimless" else "other" if x.startswith("threat") and state == "aimless" else x
            arcs[state, x] = [(aimed, 0.0, state)]
        if state != "aimless":
            arcs[state, "target"] = [("other", 0.0, "hit")]
    return Transducer({"aimless", "aimed"}, arcs, {"aimless", "hit"})


def _classes(kind: str, outcomes: dict[str, str], passing: tuple[str, ...]) -> Transducer:
    arcs = {("s", x): [(x, 0.0, "s")] for x in passing}
    return Transducer({"s"}, arcs | {("s", kind + mark): [(c, PATH[c], "s")] for mark, c in outcomes.items()}, {"s"})


def _composition() -> Transducer:
    marks = ("", "/denied", "/reported")
    insult = _classes("insult", {"": "stated", "/addressed": "addressed", "/denied": "denied", "/reported": "reported"}, ("other", *("threat" + m for m in marks)))
    threat = _classes("threat", dict(zip(marks, ("threat", "denied", "reported"), strict=True)), ("other", *CLASSES))
    return _scope("negation", "/denied", REACH).compose(_scope("report", "/reported", 2 * REACH)).compose(_target()).compose(insult).compose(threat)


GRAMMAR = _composition()


class _Numbered:
    """GRAMMAR with numbers for states: arcs by symbol and state, and where runs of other words lead.

    Other words only let the reaches run out, so after `settled` of them nothing changes any more.
    """

    def __init__(self, machine: Transducer) -> None:
        number = {state: n for n, state in enumerate(dict.fromkeys(state for state, _ in machine.arcs))}
        self.starts = [number[state] for state in machine.starts]
        self.finals = {number[state] for state in machine.finals if state in number}
        self.arcs: dict[str, list] = {symbol: [()] * len(number) for symbol in _SYMBOLS}
        for (state, symbol), found in machine.arcs.items():
            if symbol in self.arcs:  # the marks between transducers are no words
                self.arcs[symbol][number[state]] = tuple((CLASSES.index(out) if out != "other" else None, added, number[after]) for out, added, after in found)
        step = [after for ((_, _, after),) in self.arcs["other"]]
        self.others = [list(range(len(number)))]
        while (further := [step[state] for state in self.others[-1]]) != self.others[-1]:
            self.others.append(further)
        self.settled = len(self.others) - 1

    def after_others(self, n: int) -> list[int]:
        """The state that each state leads to by n other words."""
        return self.others[min(n, self.settled)]


_NUMBERED = _Numbered(GRAMMAR)
_NOTHING = (0.0,) * len(CLASSES)
_CLAUSE_END = ()
#: Arcs of a word alone, and by the next word those of phrases: the words that follow, the symbol and the weight.
_Arcs = tuple[list[tuple[str, float]], dict[str, list[tuple[list[str], str, float]]]]


class _Words(dict):
    """The arcs of words met so far: None for other words, _CLAUSE_END for ends of clauses."""

    def __init__(self, grammar: Grammar) -> None:
        super().__init__()
        self.grammar = grammar

    def __missing__(self, word: str) -> _Arcs | tuple[()] | None:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = _CLAUSE_END if _END.match(word) else self.grammar.of_word(word)
        return found


@dataclass
class Grammar:
    """Insult arcs (a word, a phrase, or a word's beginning followed by *) with weights, and weights of the classes."""

    arcs: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: START.tolist())

    @cached_property
    def lexicon(self) -> dict[str, list[tuple[list[str], str, float]]]:
        """By the first word: the words that follow it, the symbol and the weight of each arc but the beginnings."""
        found = defaultdict(list)
        fixed = (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS))
        for symbol, phrases in (("insult", [a for a in self.arcs if not a.endswith("*")]), *fixed):
            for phrase in phrases:
                first, *rest = phrase.split()
                found[first].append((rest, symbol, self.arcs[phrase] if symbol == "insult" else float(symbol == "threat")))
        return dict(found)

    @cached_property
    def stems(self) -> dict[str, float]:
        return {arc[:-1]: w for arc, w in self.arcs.items() if arc.endswith("*")}

    @cached_property
    def stem_starts(self) -> set[str]:
        return {stem[: STEM.start] for stem in self.stems}

    def insulting(self, word: str) -> bool:
        """Whether a word alone has an insult arc."""
        return word in self.arcs or any(word[:n] + "*" in self.arcs for n in STEM if len(word) > n)

    def matcher(self) -> _Words:
        """What features() needs: a memory of the words' readings."""
        return _Words(self)

    def of_word(self, word: str) -> _Arcs | None:
        """The arcs that start with a word; None if there are none."""
        alone, longer = [], defaultdict(list)
        for rest, symbol, weight in self.lexicon.get(word, ()):
            if rest:
                longer[rest[0]].append((rest, symbol, weight))
            else:
                alone.append((symbol, weight))
        if word[: STEM.start] in self.stem_starts and (found := [self.stems[word[:n]] for n in STEM if len(word) > n and word[:n] in self.stems]):
            alone.append(("insult", max(found)))
        return (alone, dict(longer)) if alone or longer else None

    def readings(self, words: list[str], at: int) -> list[tuple[str, float, int]]:
        """(symbol, weight, number of words) of each arc of the lexicon at a place; a word without one is another word."""
        return _fitting(self.of_word(words[at]), words, at) or [("other", 0.0, 1)]

    def clause(self, words: list[str]) -> dict[str, float]:
        """The summed weights of insults and threats by class on the best path; of equal paths the first in order of classes counts."""
        found = [(at, fitting) for at, word in enumerate(words) if (fitting := _fitting(self.of_word(word), words, at))]
        return {c: w for c, w in zip(CLASSES, _best_path(found, 0, len(words)), strict=True) if w}

    def features(self, text: str, matcher: _Words) -> list[float]:
        """1, then the logarithm of 1 + the summed weight of the clauses of each class. Only clauses with an insult or a threat are read."""
        sums = [0.0] * len(CLASSES)
        for words in _stretches(text.lower()):
            start, found, telling = 0, [], False
            following = (*words[1:], "")
            marked = [
                (at, arcs)
                for at, (arcs, after) in enumerate(zip(map(matcher.__getitem__, words), following, strict=True))
                if arcs is not None and (arcs is _CLAUSE_END or arcs[0] or after in arcs[1])
            ]
            for at, arcs in (*marked, (len(words), _CLAUSE_END)):
                if arcs is not _CLAUSE_END:
                    if fitting := _fitting(arcs, words, at):
                        found.append((at, fitting))
                        telling = telling or any(symbol in ("insult", "threat") for symbol, _, _ in fitting)
                    continue
                if telling:
                    sums = [a + b for a, b in zip(sums, _best_path(found, start, at), strict=True)]
                start, found, telling = at + 1, [], False
        return [1.0, *(float(np.log1p(v)) for v in sums)]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -35, 35)))


def _fitting(arcs: _Arcs | None, words: list[str], at: int) -> list[tuple[str, float, int]]:
    """(symbol, weight, number of words) of the arcs whose further words follow."""
    if arcs is None:
        return []
    longer = arcs[1].get(words[at + 1], ()) if arcs[1] and at + 1 < len(words) else ()
    found = [(symbol, weight, 1) for symbol, weight in arcs[0]]
    return found + [(symbol, weight, 1 + len(rest)) for rest, symbol, weight in longer if words[at + 1 : at + 1 + len(rest)] == rest]


def _stretches(low: str) -> Iterator[list[str]]:
    """The words and ends of clauses of a text, in stretches of whole clauses."""
    left = 0
    while left < len(low):
        stop = _END.search(low, left + STRETCH)
        right = stop.end() if stop else len(low)
        if words := _WORD_OR_END.findall(low, left, right):
            yield words
        left = right


def _best_path(found: list, start: int, stop: int) -> tuple[float, ...]:
    """The sums by class of the best path through a clause, from start to stop, that has these readings and other words besides.

    Paths that meet in a state at a place go on as the best of them, so the work grows with the readings, not the paths.
    """
    ways: dict[int, dict] = {start: dict.fromkeys(_NUMBERED.starts, (0.0, _NOTHING))}

    def arrived(at: int) -> dict:
        here: dict = {}
        for place in [p for p in ways if p <= at]:
            ahead = _NUMBERED.after_others(at - place)
            for state, way in ways.pop(place).items():
                after = ahead[state]
                if after not in here or way > here[after]:
                    here[after] = way
        return here

    for at, fitting in found:
        here = arrived(at)
        for symbol, weight, n in fitting:
            arcs, ahead, there = _NUMBERED.arcs[symbol], _NUMBERED.after_others(n - 1), ways.setdefault(at + n, {})
            for state, (score, sums) in here.items():
                for k, added, after in arcs[state]:
                    if k is None:
                        way = (score + added, sums)
                    else:
                        way = (score + added + weight, (*sums[:k], sums[k] + weight, *sums[k + 1 :]))
                    after = ahead[after]
                    if after not in there or way > there[after]:
                        there[after] = way
    return max((way for state, way in arrived(stop).items() if state in _NUMBERED.finals), default=(0.0, _NOTHING))[1]


def _unit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"], strict=True):
            read = _WORD.findall(text.lower())
            words = set(read)
            units = words | {w[:n] + "*" for n in STEM for w in words if len(w) > n} | set(map(" ".join, zip(read, read[1:], strict=False)))
            (toxic if y else clean).update(units)
        if toxic or clean:
            units = list(toxic | clean)
            yield pd.DataFrame({"unit": units, "toxic": [toxic[u] for u in units], "clean": [clean[u] for u in units]})
            toxic.clear()
            clean.clear()


def learn(sample: DataFrame, least_docs: int = 6, least_odds: float = 3.0) -> Grammar:
    """A grammar from rows (doc_id, text, y): arcs by log odds of documents, then weights by logistic loss.

    sample has to be bounded; what comes to the driver are the arcs, each in least_docs of its toxic rows (in a tenth of
    them, where these are few), and six numbers for each row.
    """
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Grammar()
    counts = sample.select("text", "y").mapInPandas(_unit_counts, "unit string, toxic long, clean long")
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    arcs = (
        counts.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= min(least_docs, max(2, n_toxic // 10)))
        .withColumn("odds", odds).filter(F.col("odds") >= least_odds)
        .select("unit", "odds")
    )
    found = {r["unit"]: r["odds"] / least_odds for r in arcs.collect()}
    # A phrase is an arc only where none of its words tells as much.
    grammar = Grammar({unit: w for unit, w in found.items() if " " not in unit or not any(map(Grammar(found).insulting, unit.split()))})
    rows = sample.select("y", _features(grammar)(F.col("text")).alias("x")).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    grammar.weights = logistic(x, y, START).tolist()
    return grammar


def _features(grammar: Grammar):
    state: list = []

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def features(texts: pd.Series) -> pd.Series:
        if not state:
            state.append(grammar.matcher())
        return texts.map(lambda t: grammar.features(t, state[0]))

    return features


def toxicity(grammar: Grammar, text: str = "text") -> Column:
    """The score of a text column, from 0 to 1."""
    state: list = []

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        if not state:
            state.append(grammar.matcher())
        x = np.array([grammar.features(t, state[0]) for t in texts]).reshape(len(texts), len(START))
        return pd.Series(grammar.score(x))

    return score(text_of(text))


def learn_from(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_BOUND) -> Grammar:
    """A grammar from the labelled rows whose crc32 remainder by 5 isn't 0."""
    return learn(labelled_sample(docs, labels, "toxic", remainder(5) != 0, bound))


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    grammar = learn_from(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), toxicity(grammar).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
