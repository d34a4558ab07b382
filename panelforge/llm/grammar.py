"""A weighted finite-state grammar of toxic clauses.

Words become symbols: insult, threat, intent, target, negation, report, boundary, other.  Five small
transducers read the symbols in turn, each adding one view: insults weigh more after one another, a threat
needs an intent shortly before it to weigh in full, a target in the clause strengthens both, negation weakens
what follows closely, reported speech weakens the rest of its clause.  ``compose`` joins two of them
into one machine whose path weight is the product of both views; ``GRAMMAR`` is all five composed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, BOUNDARY, OTHER = "insult", "threat", "intent", "target", "negation", "report", "boundary", "other"
SYMBOLS = (INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, BOUNDARY, OTHER)
#: Symbols whose weight counts towards a clause.
SCORED = (INSULT, THREAT)


@dataclass(frozen=True)
class Transducer:
    """(state, symbol) -> (state, factor): ``factor`` multiplies the weight of a scored symbol."""

    start: object
    arcs: dict

    def step(self, state, symbol):
        return self.arcs[state, symbol]


def transducer(start, states, rule: Callable) -> Transducer:
    return Transducer(start, {(s, x): rule(s, x) for s in states for x in SYMBOLS})


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read every symbol; factors multiply.  Only reachable states are kept."""
    start, arcs, todo = (a.start, b.start), {}, [(a.start, b.start)]
    while todo:
        state = todo.pop()
        for x in SYMBOLS:
            if (state, x) not in arcs:
                (left, f), (right, g) = a.step(state[0], x), b.step(state[1], x)
                arcs[state, x] = ((left, right), f * g)
                todo.append((left, right))
    return Transducer(start, arcs)


#: What an insult weighs after none, one, and more in its clause.
HEAPED = (1.0, 1.25, 1.5)
#: Words after an intent that it reaches, and what a threat weighs without one.
INTENDED_WORDS, UNINTENDED = 4, 0.4
#: Words after a negation that it reaches, and what is left of their weight.
NEGATED_WORDS, NEGATED = 3, 0.25
REPORTED = 0.5
TARGETED = 1.5


def _insult(state: int, symbol: str):
    after = 0 if symbol == BOUNDARY else min(len(HEAPED) - 1, state + (symbol == INSULT))
    return after, HEAPED[state] if symbol == INSULT else 1.0


def _threat(state: int, symbol: str):
    left = 0 if symbol == BOUNDARY else INTENDED_WORDS if symbol == INTENT else max(0, state - 1)
    return left, UNINTENDED if symbol == THREAT and not state else 1.0


def _target(state: bool, symbol: str):
    return symbol == TARGET or (state and symbol != BOUNDARY), TARGETED if state else 1.0


def _negation(state: int, symbol: str):
    left = 0 if symbol == BOUNDARY else NEGATED_WORDS if symbol == NEGATION else max(0, state - 1)
    return left, NEGATED if state else 1.0


def _reported(state: bool, symbol: str):
    return symbol == REPORT or (state and symbol != BOUNDARY), REPORTED if state else 1.0


VIEWS = (
    transducer(0, range(len(HEAPED)), _insult),
    transducer(0, range(INTENDED_WORDS + 1), _threat),
    transducer(False, (False, True), _target),
    transducer(0, range(NEGATED_WORDS + 1), _negation),
    transducer(False, (False, True), _reported),
)
GRAMMAR = reduce(compose, VIEWS)


def clause_scores(symbols: list[str], weights: list[float], grammar: Transducer = GRAMMAR) -> list[float]:
    """The path weight of each clause that holds a scored symbol."""
    state, total, found, scores = grammar.start, 0.0, False, []
    for symbol, weight in zip(symbols, weights, strict=True):
        state, factor = grammar.step(state, symbol)
        if symbol in SCORED:
            total += weight * factor
            found = True
        elif symbol == BOUNDARY:
            if found:
                scores.append(total)
            total, found = 0.0, False
    return [*scores, total] if found else scores
