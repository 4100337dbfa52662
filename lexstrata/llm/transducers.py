"""Small deterministic finite-state transducers, over letters and over word classes.

A word-class transducer reads one class symbol at a time and writes one symbol; composition
runs the second on the output of the first and gives one table again, so a clause is scored
in one pass whatever the number of rules. What depends on words to the right is decided by a
transducer that runs from the right over the output of the others (together a bimachine).

The lexicon is a weighted transducer over letters: arcs carry weights, a word's weight is
their sum, and the arc that ends a word writes its class, which the clause grammar reads.
"""

from __future__ import annotations

from dataclasses import dataclass

# Word classes: insult, threat verb, target, negation, reported speech, other word, clause end.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END = "ITGNRO|"
# What the grammar writes for an insult or threat that it matched.
PLAIN, NEGATED, QUOTED, TARGETED, THREATENED = "pnqgt"
ALPHABET = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END)


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol read) -> (next state, symbol written)."""

    start: object
    arcs: dict

    def run(self, symbols: str) -> str:
        state, out = self.start, []
        for s in symbols:
            state, written = self.arcs[state, s]
            out.append(written)
        return "".join(out)


def build(start, step, alphabet) -> Transducer:
    """Close ``step(state, symbol) -> (state, symbol)`` over all reachable states."""
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for s in alphabet:
            arcs[state, s] = step(state, s)
            if arcs[state, s][0] not in seen:
                seen.add(arcs[state, s][0])
                todo.append(arcs[state, s][0])
    return Transducer(start, arcs)


def outputs(t: Transducer) -> tuple[str, ...]:
    return tuple(sorted({written for _, written in t.arcs.values()}))


def compose(first: Transducer, second: Transducer, alphabet=ALPHABET) -> Transducer:
    def step(state, s):
        a, b = state
        a, middle = first.arcs[a, s]
        b, written = second.arcs[b, middle]
        return (a, b), written

    return build((first.start, second.start), step, alphabet)


def reported_speech() -> Transducer:
    """After a verb of saying, insults and threats of the same clause are quoted."""

    def step(state, s):
        if s == END:
            return False, s
        if s == REPORT:
            return True, s
        return state, QUOTED if state and s in (INSULT, THREAT) else s

    return build(False, step, ALPHABET)


def negation(alphabet, reach: int = 3) -> Transducer:
    """A negation covers the next ``reach`` words of its clause."""

    def step(left, s):
        if s == END:
            return 0, s
        if s == NEGATION:
            return reach, s
        return max(left - 1, 0), NEGATED if left and s in (INSULT, THREAT) else s

    return build(0, step, alphabet)


def targeting(alphabet, reach: int = 3) -> Transducer:
    """An insult or threat within ``reach`` words behind a target of its clause is aimed."""

    def step(left, s):
        if s == END:
            return 0, s
        if s == TARGET:
            return reach, s
        aimed = {INSULT: TARGETED, THREAT: THREATENED}
        return max(left - 1, 0), aimed.get(s, s) if left else s

    return build(0, step, alphabet)


def targeting_from_the_right(alphabet, reach: int = 3) -> Transducer:
    """Run from the right, so that targets behind an insult or threat count too; an insult
    without a target is plain, and a threat verb without one is an ordinary word."""

    def step(left, s):
        if s == END:
            return 0, s
        if s == TARGET:
            return reach, s
        found = {INSULT: TARGETED if left else PLAIN, THREAT: THREATENED if left else OTHER}
        return max(left - 1, 0), found.get(s, s)

    return build(0, step, alphabet)


@dataclass(frozen=True)
class Bimachine:
    """``forward`` over a clause, then ``backward`` from the right over what that wrote."""

    forward: Transducer
    backward: Transducer

    def run(self, symbols: str) -> str:
        return self.backward.run(self.forward.run(symbols)[::-1])[::-1]


def clause_grammar() -> Bimachine:
    """Reported speech, negation and targets before in one composed table, then targets behind."""
    forward = reported_speech()
    for rule in (negation, targeting):
        forward = compose(forward, rule(outputs(forward)))
    number = {forward.start: 0}
    for state, _ in forward.arcs:
        number.setdefault(state, len(number))
    table = {(number[a], s): (number[b], w) for (a, s), (b, w) in forward.arcs.items()}
    return Bimachine(Transducer(0, table), targeting_from_the_right(outputs(forward)))


class Lexicon:
    """Weighted transducer from the letters of a word to its class.

    ``paths``: weight of words, and of stems, written with ``*`` behind them, that any letters
    may follow. ``classes``: class of function words. States pair a place in the tree of
    letters with the weight gathered so far; an arc that completes a better stem carries the
    difference, and so does the arc that ends a word. Hence the sum over the one way of a
    word is the largest weight of all paths that accept it.
    """

    def __init__(self, paths: dict[str, float], classes: dict[str, str]):
        self.next: list[dict[str, int]] = [{}]
        self.stem, self.word, self.classes = [0.0], [0.0], [OTHER]
        for path, weight in paths.items():
            at = self._place(path.removesuffix("*"))
            held = self.stem if path.endswith("*") else self.word
            held[at] = max(held[at], weight)
        for word, symbol in classes.items():
            self.classes[self._place(word)] = symbol

    def _place(self, letters: str) -> int:
        at = 0
        for c in letters:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.stem.append(0.0)
                self.word.append(0.0)
                self.classes.append(OTHER)
            at = self.next[at][c]
        return at

    def arc(self, state: tuple[int | None, float], letter: str) -> tuple[tuple[int | None, float], float]:
        """(next state, weight of the arc). Off the tree only the gathered weight is left."""
        at, gathered = state
        at = None if at is None else self.next[at].get(letter)
        # A stem is accepted once more letters follow: its weight lies on the arc behind it.
        better = 0.0 if state[0] is None else max(0.0, self.stem[state[0]] - gathered)
        return (at, gathered + better), better

    def end(self, state: tuple[int | None, float]) -> tuple[str, float]:
        """(class written, weight) of the arc that ends a word."""
        at, gathered = state
        better = 0.0 if at is None else max(0.0, self.word[at] - gathered)
        if gathered + better > 0:
            return INSULT, better
        return (OTHER if at is None else self.classes[at]), 0.0

    def read(self, word: str) -> tuple[str, float]:
        """(class, summed weight) of a word."""
        state, total = (0, 0.0), 0.0
        for letter in word:
            state, weight = self.arc(state, letter)
            total += weight
        symbol, weight = self.end(state)
        return symbol, total + weight
