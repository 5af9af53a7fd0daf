"""Licence notices in texts, by a generalised suffix automaton of the notices' words.

The automaton holds every run of words of every template. Streaming a text
through it gives, at each word, the longest run that ends there and occurs in
some template. Runs that cannot grow are matches; matches in the same order in
the text and in a template are chained over small gaps, and a template whose
words are covered well enough labels the text. So a notice is found with words
left out, put in or replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.llm.license_texts import PHRASES, TEMPLATES
from keytally.llm.tables import text_or_empty
from keytally.llm.words import Words, chunks, words

#: Words of a match, at least; words between two matches of a chain, at most.
LEAST_RUN = 4
MAX_GAP = 12
#: Share of a template's words that a chain has to cover.
COVERED = 0.6


def _hashes(texts: list[str]) -> list[np.ndarray]:
    chunk = next(chunks(pa.array(texts, pa.string()), 1 << 30))
    found = words(chunk)
    return [found.hash[a:b] for a, b in zip(found.first[:-1], found.first[1:])]


class Automaton:
    """Generalised suffix automaton over sequences of small integers."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].add((number, at + 1))
        # A run also ends wherever a longer run with it as its end does.
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, before: int, symbol: int, state: int) -> int:
        """The part of a state that is reached from ``before``, as a state of its own."""
        if self.length[before] + 1 == self.length[state]:
            return state
        copy = self._state(self.length[before] + 1, dict(self.next[state]), self.link[state])
        self.link[state] = copy
        while before >= 0 and self.next[before].get(symbol) == state:
            self.next[before][symbol] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol, self.next[last][symbol])
        new = self._state(self.length[last] + 1, {}, 0)
        before = last
        while before >= 0 and symbol not in self.next[before]:
            self.next[before][symbol] = new
            before = self.link[before]
        if before >= 0:
            self.link[new] = self._split(before, symbol, self.next[before][symbol])
        return new

    def matching_statistics(self, symbols: list[int]) -> list[tuple[int, int]]:
        """``(state, length)`` of the longest known run that ends at each symbol."""
        out = []
        state, length = 0, 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
            else:
                state, length = 0, 0
            out.append((state, length))
        return out


class Match(NamedTuple):
    template: int
    start: int  # in the template
    at: int  # in the text
    length: int


def matches(automaton: Automaton, symbols: list[int], offset: int = 0, least: int = LEAST_RUN) -> list[Match]:
    """Runs of at least ``least`` words that the next word does not continue, at each place of each template."""
    found = []
    statistics = automaton.matching_statistics(symbols)
    for i, (state, length) in enumerate(statistics):
        if length >= least and (i + 1 == len(statistics) or statistics[i + 1][1] != length + 1):
            at = offset + i + 1 - length
            found += [Match(template, end - length, at, length) for template, end in automaton.ends[state]]
    return found


def _best_chains(found: list[Match], gap: int) -> list[tuple[int, int, int]]:
    """``(covered, first, end)`` of the best chain that ends in each match, given in order of the text."""
    best: list[tuple[int, int, int]] = []
    reach = 0
    for i, m in enumerate(found):
        score, first = m.length, m.at
        while found[reach].at + found[reach].length + gap < m.at:
            reach += 1
        for k in range(reach, i):
            p = found[k]
            between, inside = m.at - (p.at + p.length), m.start - (p.start + p.length)
            if p.at < m.at and p.start < m.start and between <= gap and inside <= gap:
                new = best[k][0] + m.length - max(0, -between, -inside)
                if new > score:
                    score, first = new, best[k][1]
        best.append((score, first, m.at + m.length))
    return best


def chains(found: list[Match], gap: int = MAX_GAP) -> list[tuple[int, int, int]]:
    """``(covered, first, end)`` of chains of one template's matches that do not overlap in the text.

    A match may follow one that begins earlier in both orders and ends at most
    ``gap`` words before it; words in both count once. Where the template begins
    again in the text, so does a chain. The chain that covers most words is taken
    first, and so on, and once more from the matches beside those taken. A match
    that is out of reach of all later ones is left behind, so the work grows with
    the text.
    """
    found = sorted(found, key=lambda m: (m.at, m.start))
    taken: list[tuple[int, int, int]] = []
    places: list[tuple[int, int]] = []  # firsts and ends of those taken, in order

    def is_free(first: int, end: int) -> bool:
        at = bisect_left(places, (end,))
        return at == 0 or places[at - 1][1] <= first

    while found:
        for chain in sorted(_best_chains(found, gap), key=lambda b: (-b[0], b[1], b[2])):
            if is_free(chain[1], chain[2]):
                taken.append(chain)
                insort(places, chain[1:])
        found = [m for m in found if is_free(m.at, m.at + m.length)]
    return taken


class Span(NamedTuple):
    label: str
    first: int
    end: int
    covered: float


class Scanner:
    """The templates and phrases as numbers, and what they find in a chunk of texts."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        notices, plain = _hashes([text for _, text in templates]), _hashes([*phrases])
        self.known = np.unique(np.concatenate([*notices, *plain]))
        self.labels = [label for label, _ in templates]
        self.lengths = [len(n) for n in notices]
        self.automaton = Automaton([np.searchsorted(self.known, n).tolist() for n in notices])
        self.phrases = [(np.searchsorted(self.known, p), label) for p, label in zip(plain, phrases.values())]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[self.known & np.uint64(0xFFFF)] = True

    def numbers(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the words that occur in a template or phrase."""
        maybe = np.flatnonzero(self.filter[found.hash & np.uint64(0xFFFF)])
        at = np.searchsorted(self.known, found.hash[maybe])
        at[at == len(self.known)] = 0
        real = self.known[at] == found.hash[maybe]
        return maybe[real], at[real]

    def phrase_places(self, place: np.ndarray, number: np.ndarray, row: np.ndarray) -> list[tuple[int, str]]:
        """``(place, label)`` of each phrase whose words stand consecutively in one text."""
        out = []
        for phrase, label in self.phrases:
            whole = max(len(place) - len(phrase) + 1, 0)
            fits = np.ones(whole, bool)
            for k, symbol in enumerate(phrase):
                fits &= number[k : k + whole] == symbol
            last = len(phrase) - 1
            fits &= (place[last : last + whole] - place[:whole] == last) & (row[last : last + whole] == row[:whole])
            out += [(int(p), label) for p in place[:whole][fits]]
        return out

    def spans(self, found: list[Match]) -> list[Span]:
        """Every covered template, but none inside a span of its label that covers more words."""
        by_template: dict[int, list[Match]] = {}
        for m in found:
            by_template.setdefault(m.template, []).append(m)
        by_label: dict[str, list[tuple[int, Span]]] = {}
        for template, own in by_template.items():
            size, label = self.lengths[template], self.labels[template]
            for covered, first, end in chains(own):
                by_label.setdefault(label, []).append((covered, Span(label, first, end, min(covered / size, 1.0))))
        return [span for own in by_label.values() for span in _outermost(own)]


def _outermost(own: list[tuple[int, Span]]) -> list[Span]:
    """The spans that no span which covers more words holds; of equal ones the better covered.

    Short of ``COVERED`` a span hides none, and only the best such one is of use,
    for the score.
    """
    whole = [(covered, s) for covered, s in own if s.covered >= COVERED]
    if not whole:
        return [max((s for _, s in own), key=lambda s: s.covered)]
    kept: list[Span] = []
    held: list[tuple[int, int]] = []  # firsts and ends, both growing, as none holds another
    for _, s in sorted(whole, key=lambda x: (-x[0], -x[1].covered, x[1].first, x[1].end)):
        at = bisect_right(held, (s.first, float("inf")))
        if at == 0 or held[at - 1][1] < s.end:
            kept.append(s)
            while at < len(held) and held[at][1] <= s.end:
                held.pop(at)
            held.insert(at, (s.first, s.end))
    return sorted(kept, key=lambda s: (s.first, s.end))


_SCHEMA = """struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: array<string>,
    spans: array<struct<label: string, first: bigint, end: bigint, covered: double>>, score: double>"""


def scan(text: Column) -> Column:
    """Of each text: its number of words, the phrases' places, the covered spans and the score.

    The score is the largest covered share of any template, or 0.5 if that is
    less and a phrase was found.
    """

    @F.arrow_udf(_SCHEMA)
    def of(texts: pa.Array) -> pa.Array:
        scanner = Scanner()
        out = []
        for chunk in chunks(texts):
            found = words(chunk)
            row = found.row
            place, number = scanner.numbers(found)
            rows = chunk.high - chunk.low
            base: list[list[tuple[int, str]]] = [[] for _ in range(rows)]
            for p, label in scanner.phrase_places(place, number, row[place]):
                base[row[p]].append((p - int(found.first[row[p]]), label))
            runs: list[list[Match]] = [[] for _ in range(rows)]
            # A match needs neighbouring known words, so the automaton sees only runs of them.
            breaks = np.flatnonzero((np.diff(place) != 1) | (np.diff(row[place]) != 0)) + 1
            edges = np.concatenate([[0], breaks, [len(place)]])
            for k in np.flatnonzero(np.diff(edges) >= LEAST_RUN):
                low, high = edges[k], edges[k + 1]
                r = row[place[low]]
                runs[r] += matches(scanner.automaton, number[low:high].tolist(), int(place[low] - found.first[r]))
            counts = np.diff(found.first)
            for r in range(rows):
                spans = scanner.spans(runs[r])
                starts = [p for p, _ in base[r]]
                score = max([s.covered for s in spans] + [0.5 if starts else 0.0])
                out.append(
                    {
                        "n_words": int(counts[r]), "n_base": len(starts),
                        "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                        "base_labels": sorted({label for _, label in base[r]}),
                        "spans": [s._asdict() for s in spans if s.covered >= COVERED], "score": score,
                    }
                )
        span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])
        kind = pa.struct(
            [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
             ("base_labels", pa.list_(pa.string())), ("spans", pa.list_(span)), ("score", pa.float64())]
        )
        return pa.array(out, kind)

    return of.asNondeterministic()(text)


def find_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the fields of ``scan``, one row per row of ``docs``.

    NULL texts are empty: no words, no labels, score 0. Rows that repeat an id
    each have their own result. Other columns are not read.
    """
    return docs.select(F.col(id).alias("doc_id"), scan(text_or_empty(text)).alias("s")).select("doc_id", "s.*")


def licenses_digest(docs: DataFrame) -> DataFrame:
    """One row per document with the labels as text."""
    found = find_licenses(docs)
    labels = F.array_sort(F.array_union("base_labels", F.transform("spans", lambda s: s["label"])))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score",
        F.size("spans").cast("bigint").alias("n_spans"),
    )
