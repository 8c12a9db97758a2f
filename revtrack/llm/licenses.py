"""Licence scan with a generalised suffix automaton.

The automaton holds every run of words of all licence notices and phrases. A file's words are streamed through it once:
after each word it tells the longest run that ends there and stands in some notice (matching statistics). Runs that
cannot be made longer are chained, notice by notice, where they follow one another in both file and notice; a chain that
covers enough of the notice is a span of that licence. The automaton is small (at most two states for each notice word)
and goes to every task.

Cases: a null text is empty; a text without words has no span, score 0 and empty labels; places of a phrase may overlap
and are all counted; equal files get equal results; words of very long files are streamed, none is left out.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .license_texts import NOTICES, PHRASES

# A span covers at least this share of its notice.
LEAST_SHARE = 0.6
# Words of a run that takes part in a chain, and words of the file between two runs of a chain.
LEAST_RUN, LARGEST_GAP = 4, 12

# ASCII capitals become small; ASCII characters that are neither digits nor letters separate.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, index of its last word) of a state's runs
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].append((number, at))
        # A run ends wherever the longer runs of the states below it end.
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]

    def _add(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, before: int, word: int, state: int) -> int:
        """A state of its own for the runs of `state` that are no longer than those of `before` and one word."""
        copy = self._add(self.length[before] + 1, self.link[state], dict(self.next[state]))
        self.link[state] = copy
        while before >= 0 and self.next[before].get(word) == state:
            self.next[before][word] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._add(self.length[last] + 1, 0, {})
        before = last
        while before >= 0 and word not in self.next[before]:
            self.next[before][word] = new
            before = self.link[before]
        if before >= 0:
            known = self.next[before][word]
            self.link[new] = known if self.length[known] == self.length[before] + 1 else self._split(before, word, known)
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest run that ends with `word`."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        following = self.next[state].get(word)
        return (0, 0) if following is None else (following, length + 1)


@dataclass
class Span:
    label: str
    first: int
    last: int
    share: float


class Scanner:
    """All notices and phrases in one automaton."""

    def __init__(self, notices=NOTICES, phrases=PHRASES):
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases]
        self.notices = [(words_of(n.encode()), label) for label, n in notices]
        everything = [w for w, _ in self.phrases + self.notices]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(x for words in everything for x in words))}
        self.automaton = SuffixAutomaton([[self.number[x] for x in words] for words in everything])
        self.shortest = min([len(w) for w, _ in self.phrases] + [LEAST_RUN])
        # The phrases that end where a state's runs end, if the run is long enough.
        self.phrase_at: list[list[tuple[int, int]]] = []
        a = self.automaton
        goal = {}
        for p, (words, _) in enumerate(self.phrases):
            state = 0
            for x in words:
                state = a.next[state][self.number[x]]
            goal.setdefault(state, []).append((p, len(words)))
        for state in range(len(a.length)):
            own, s = [], state
            while s > 0:
                own += goal.get(s, [])
                s = a.link[s]
            self.phrase_at.append(own)

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, str]], list[Span]]:
        """Number of words, places (first word, label) of phrases, and spans."""
        words = words_of(raw)
        numbers = np.fromiter((self.number.get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (numbers >= 0).view(np.int8), [0]))))
        places, runs = [], []
        # A word that no notice has ends every run: only stretches of known words are worth a look.
        for begin, end in zip(known[::2].tolist(), known[1::2].tolist()):
            if end - begin < self.shortest:
                continue
            state = length = 0
            for at, word in enumerate(numbers[begin:end].tolist(), begin):
                before = state, length
                state, length = self.automaton.step(state, length, word)
                if length <= before[1] and before[1] >= LEAST_RUN:
                    runs.append((at - before[1], before[1], before[0]))
                places += [(at - n + 1, self.phrases[p][1]) for p, n in self.phrase_at[state] if n <= length]
            if length >= LEAST_RUN:
                runs.append((end - length, length, state))
        return len(words), places, self._chains(runs)

    def _chains(self, runs: list[tuple[int, int, int]]) -> list[Span]:
        """Chain runs (first word, words, state) in order of the file, for each notice."""
        open_: dict[int, list[int]] = {}  # notice: first word, next word, next word of the notice, words covered
        spans = []

        def close(notice: int) -> None:
            first, after, _, covered = open_.pop(notice)
            words, label = self.notices[notice]
            if covered >= LEAST_SHARE * len(words):
                spans.append(Span(label, first, after - 1, min(1.0, covered / len(words))))

        for first, n, state in runs:
            seen = set()
            for sequence, last in sorted(self.automaton.ends[state]):
                notice = sequence - len(self.phrases)
                if notice < 0:
                    continue
                begin = last - n + 1
                chain = open_.get(notice)
                if chain and (first - chain[1] > LARGEST_GAP or (last < chain[2] and notice not in seen)):
                    close(notice)
                    chain = None
                if chain is None:
                    open_[notice] = [first, first + n, last + 1, n]
                elif last >= chain[2] and first + n > chain[1] and notice not in seen:
                    fresh = min(n, last + 1 - max(begin, chain[2]), first + n - chain[1])
                    chain[1:] = [first + n, last + 1, chain[3] + max(0, fresh)]
                seen.add(notice)
        for notice in list(open_):
            close(notice)
        return sorted(spans, key=lambda s: (s.first, s.last, s.label))


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first: long, last: long, share: double>>"
)


def scan(text: Column, scanner: Scanner | None = None) -> Column:
    """Struct SCHEMA of a text: places of phrases, spans of notices, and the labels of both.

    `score` is the largest share of a notice that a span covers, 1 with a phrase.
    """
    scanner = scanner or Scanner()

    @F.pandas_udf(SCHEMA)
    def scanned(raws: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in raws:
            n, places, spans = scanner.scan(raw)
            base = {label for _, label in places}
            starts = [at for at, _ in places]
            rows.append((
                n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | {s.label for s in spans})), 1.0 if places else max((s.share for s in spans), default=0.0),
                [(s.label, s.first, s.last, s.share) for s in spans],
            ))
        out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
        out["spans"] = [[dict(zip(("label", "first", "last", "share"), s)) for s in spans] for spans in out["spans"]]
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return scanned(F.coalesce(text, F.lit("")).cast("binary"))
