"""License scans with a generalised suffix automaton.

The automaton holds the tokens of all licence templates. A document's tokens
stream through it and give matching statistics: at each place, for each template,
the longest run ending there that occurs in it. Maximal runs are chained, in order
in both document and template, into covered spans; a template that is covered
far enough gives its label. Only stretches of token pairs that occur in a
template are streamed, since no run outside them can be long enough.

Templates are a parameter; the automaton's size is bounded by theirs, and it is
built on the driver and broadcast.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rangevec.llm.common import python_rows, real_ids, short_batches, table
from rangevec.llm.license_texts import TEMPLATES

# Phrases that stand for a label by themselves.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

MIN_RUN = 3
MAX_GAP = 6
MIN_COVER = 0.75
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_SEPARATE = bytes(b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and characters beyond ASCII, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATE).split()


class Automaton:
    """Generalised suffix automaton over sequences of token ids; each state lists where its runs end."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [[]]
        for no, seq in enumerate(sequences):
            last = 0
            for at, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].append((no, at + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})
        self.deepest: list[dict[int, int]] = [{} for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            self.deepest[s] = self.deepest[self.link[s]] | {no: s for no, _ in self.ends[s]}

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the runs that reach it through p."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        new = self._state(self.length[p] + 1, {}, 0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def runs(self, tok: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """Maximal runs (end in ``tok``, length, state) of at least ``least`` tokens."""
        s = n = 0
        for at, c in enumerate(tok):
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
                continue
            if n >= least:
                yield at, n, s
            while s > 0 and c not in self.next[s]:
                s = self.link[s]
            n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            else:
                s = n = 0
        if n >= least:
            yield len(tok), n, s

    def runs_by_sequence(self, tok: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
        """Maximal runs (sequence, start in ``tok``, start in the sequence, length) of at least ``least`` tokens, of each sequence by itself.

        The longest run that ends at a place and occurs in a sequence is that of
        the deepest state on the path of suffix links with an end in it.
        """
        s = n = 0
        before: dict[int, tuple[int, int]] = {}  # sequence: length of its longest run up to here, state
        for at, c in enumerate([*tok, None]):
            while s > 0 and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            s, n = (self.next[s][c], n + 1) if c in self.next[s] else (0, 0)
            now = {no: (n if t == s else self.length[t], t) for no, t in self.deepest[s].items()}
            for no, (size, state) in before.items():
                if size >= least and now.get(no, (0, 0))[0] <= size:
                    for other, place in self.ends[state]:
                        if other == no:
                            yield no, at - size, place - size, size
            before = now


class Scanner:
    """Templates and phrases, ready to scan token sequences."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], min_run: int = MIN_RUN, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER) -> None:
        self.min_run, self.max_gap, self.min_cover = min_run, max_gap, min_cover
        self.ids: dict[bytes, int] = {}
        number = lambda text: [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
        pairs = [(label, number(t)) for label, texts in templates.items() for t in texts]
        self.labels = [label for label, _ in pairs]
        self.sequences = [seq for _, seq in pairs]
        self.phrases = [(label, np.array(number(p))) for p, label in phrases.items()]
        self.automaton = Automaton(self.sequences)
        self.pairs = np.zeros((len(self.ids) + 1, len(self.ids) + 1), bool)
        for seq in self.sequences:
            self.pairs[seq[:-1], seq[1:]] = True

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))

    def places(self, tok: np.ndarray) -> list[tuple[int, str]]:
        """(start, label) wherever a phrase's words stand consecutively."""
        found = []
        for label, phrase in self.phrases:
            n = len(tok) - len(phrase) + 1
            at = np.flatnonzero(tok[:n] == phrase[0]) if n > 0 else np.zeros(0, int)
            for k in range(1, len(phrase)):
                at = at[tok[at + k] == phrase[k]]
            found += [(int(x), label) for x in at]
        return found

    def spans(self, tok: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, start, end, cover) of the best chain of each template text that reaches ``min_cover``; and the best cover below it, with an empty label."""
        if len(tok) < 2:
            return []
        joined = np.concatenate([[False], self.pairs[tok[:-1], tok[1:]], [False]])
        edge = np.flatnonzero(np.diff(joined.astype(np.int8)))
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + 1 < self.min_run:
                continue
            for no, start, place, n in self.automaton.runs_by_sequence(tok[a : b + 1].tolist(), self.min_run):
                runs.setdefault(no, []).append((a + start, place, n))
        found, low = [], 0.0
        for no, matches in runs.items():
            whole = len(self.sequences[no])
            for start, end, got in self._chains(sorted(set(matches))):
                cover = min(1.0, got / whole)
                if cover >= self.min_cover:
                    found.append((self.labels[no], start, end, cover, got))
                else:
                    low = max(low, cover)
        return self._best(found) or ([("", 0, 0, low)] if low else [])

    @staticmethod
    def _best(found: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float]]:
        """Spans without those of another label that lie half or more in one that is better covered, or as well with more words: licences share much of their wording."""
        beaten = lambda s, t: t[0] != s[0] and (t[3], t[4]) > (s[3], s[4]) and min(s[2], t[2]) - max(s[1], t[1]) >= 0.5 * (s[2] - s[1])
        found = sorted(found, key=lambda s: s[1])
        starts = [s[1] for s in found]
        longest = max((s[2] - s[1] for s in found), default=0)
        around = lambda s: found[bisect_left(starts, s[1] - longest) : bisect_left(starts, s[2])]
        return [s[:4] for s in found if not any(beaten(s, t) for t in around(s))]

    def _chains(self, matches: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """(start, end, tokens covered) of chains: runs in order in both, with short gaps, overlaps counted once."""
        open_: list[list] = []  # [start, document end, template end, covered]
        for at, place, n in matches:
            while open_ and at - min(c[1] for c in open_) > self.max_gap:
                done = min(open_, key=lambda c: c[1])
                open_.remove(done)
                yield done[0], done[1], done[3]
            best = None
            for c in open_:
                if at > c[1] - n and place + n > c[2] and at + n > c[1] and abs((place - c[2]) - (at - c[1])) <= self.max_gap and place - c[2] <= self.max_gap:
                    if best is None or c[3] > best[3]:
                        best = c
            if best is None:
                open_.append([at, at + n, place + n, n])
            else:
                best[3] += min(n, at + n - best[1], place + n - best[2])
                best[1], best[2] = at + n, place + n
        for c in open_:
            yield c[0], c[1], c[3]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_cover: float = MIN_COVER) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of phrases, first_word and last_word are the
    smallest and largest start of one (null without any). labels adds those of
    templates covered to ``min_cover`` or more; score is the best cover of a
    template (1 where a phrase stands whole and no template says more); spans
    has label:first:last word of each. Where spans of different labels cover the
    same words, the better covered one counts. Null and empty texts have no
    words, no labels and score 0; texts may be of any length. Repeated rows and null ids each give a row. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, min_cover=min_cover))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = shared.value
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                words = words_of(text)
                tok = scanner.numbers(words)
                base, spans = scanner.places(tok), scanner.spans(tok)
                own = {label for _, label in base}
                more = {s[0] for s in spans if s[0]}
                score = max([s[3] for s in spans], default=0.0)
                if base and not more:
                    score = 1.0
                starts = [at for at, _ in base]
                shown = ",".join(f"{s[0]}:{s[1]}:{s[2] - 1}" for s in sorted(spans, key=lambda s: (s[1], s[2], s[0])) if s[0])
                rows.append((doc, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), float(score), shown))
            yield pd.DataFrame(rows, columns=names).astype({"first_word": "Int64", "last_word": "Int64"})

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return real_ids(python_rows(docs, id_col, text_col).mapInPandas(run, schema))


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
