"""Language ID with a linear-chain conditional random field over words.

A word's score for each language sums the weights of its affixes, its character
n-grams and, if the lexicon holds it, the word itself; learned transitions join
neighbours. Forward-backward gives each word's marginals, so code-switched text
is labelled word by word, and a document's language is the one with the most
expected words.

The model is fitted on the driver from a bounded sample: of each language the
``per_lang`` labelled documents with the smallest hash of their id give one
excerpt of at most ``excerpt`` characters each. Training sequences splice short
runs of excerpts of different languages, so transitions meet switches.

Prediction runs forward-backward exactly over whole texts, vectorised over
blocks of words: each block's transfer matrix first, then the vectors at block
borders, then all blocks at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangevec.llm.common import crc_of_id, python_rows, real_ids, short_batches, table

BITS = 16
STEP = 32
_WORDS = re.compile(r"[^\W\d_]+").findall
_SLICE = 1 << 20
#: Values that one step of fitting holds at once.
_FIT_VALUES = 1 << 23


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-case runs of letters, a bounded part of the text at a time, cut only at white space."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield _WORDS(text[at:end].lower())
        at = end


def features(word: str, lexicon: set[str]) -> list[int]:
    """Hashed affixes and n-grams of two and three characters, and the word itself if the lexicon has it; none without a letter."""
    if not any(map(str.isalpha, word)):
        return []
    s = f"^{word}$"
    found = [s[i : i + 2] for i in range(len(s) - 1)] + [s[i : i + 3] for i in range(len(s) - 2)] + [s[:4] + "<", ">" + s[-4:]]
    if word in lexicon:
        found.append("=" + word)
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in found]


def emissions(lists: list[list[int]], weights: np.ndarray) -> np.ndarray:
    """Summed weights of each word's features."""
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate([np.array(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(weights[flat], starts, axis=0)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def marginals(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected words of each language in each sequence.

    scores: (words, languages) of all sequences one after another; starts: where
    each begins (none empty); moves: (languages, languages) of exp(transition).
    """
    n, k = scores.shape
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    ends = np.append(starts[1:], n)
    blocks = -(-(ends - starts) // STEP)
    owner = np.repeat(np.arange(len(starts)), blocks)
    first = np.cumsum(blocks) - blocks
    at = starts[owner] + (np.arange(len(owner)) - first[owner]) * STEP
    size = np.minimum(ends[owner] - at, STEP)
    steps = [(t, np.flatnonzero(size > t)) for t in range(STEP)]
    full = len(owner)
    transfer = np.broadcast_to(np.eye(k, dtype=e.dtype), (full, k, k)).copy()
    for t, live in steps:
        x = transfer if len(live) == full else transfer[live]
        x = (x.reshape(-1, k) @ moves).reshape(-1, k, k) * e[at[live] + t][:, None, :]
        transfer[live] = _scaled(x) if t % 4 == 3 or t == 0 else x
    transfer = _scaled(transfer)
    fore, back = np.empty((full, k), e.dtype), np.empty((full, k), e.dtype)
    order = np.argsort(-blocks, kind="stable")
    live_at = np.searchsorted(-blocks[order], -np.arange(1, blocks.max() + 1), side="right")
    a = np.full((len(starts), k), 1 / k, e.dtype)
    for j, count in enumerate(live_at):
        who = order[:count]
        b = first[who] + j
        fore[b] = a[who]
        a[who] = _scaled(np.einsum("nk,nkj->nj", a[who], transfer[b]))
    z = np.ones((len(starts), k), e.dtype)
    for j in range(len(live_at) - 1, -1, -1):
        who = order[: live_at[j]]
        b = first[who] + j
        back[b] = z[who]
        z[who] = _scaled(np.einsum("nkj,nj->nk", transfer[b], z[who]))
    alphas, alpha = [], fore
    for t, live in steps:
        alpha = alpha.copy()
        alpha[live] = _scaled((alpha[live] @ moves) * e[at[live] + t])
        alphas.append(alpha)
    beta, total = back, np.zeros((full, k))
    for t, live in reversed(steps):
        total[live] += _scaled(alphas[t][live] * beta[live])
        beta = beta.copy()
        beta[live] = _scaled((beta[live] * e[at[live] + t]) @ moves.T)
    return np.add.reduceat(total, first, axis=0)


class Model:
    """Languages, weights, transitions and lexicon; scores of words met are kept, up to ``most``."""

    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray, lexicon: set[str], most: int = 400_000) -> None:
        self.langs, self.weights, self.moves, self.lexicon, self.most = langs, weights, moves, lexicon, most
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.langs)), np.float32)
        self.rows = 0

    def __getstate__(self):
        return self.langs, self.weights, self.moves, self.lexicon, self.most

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, words: list[str]) -> None:
        lists = [features(w, self.lexicon) for w in words]
        some = [(w, x) for w, x in zip(words, lists) if x]
        self.known.update((w, -2) for w, x in zip(words, lists) if not x)
        if not some:
            return
        found = emissions([x for _, x in some], self.weights)
        while self.rows + len(some) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[self.rows : self.rows + len(some)] = found
        self.known.update((w, self.rows + i) for i, (w, _) in enumerate(some))
        self.rows += len(some)

    def word_scores(self, text: str) -> np.ndarray:
        parts = []
        for words in words_of(text):
            if self.rows > self.most:
                self._empty()
            at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
            if (at == -1).any():
                self._learn(list({words[i] for i in np.flatnonzero(at == -1)}))
                at = np.fromiter(map(self.known.get, words), np.int64, len(words))
            parts.append(self.scores[at[at >= 0]])
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)

    def shares(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """Each text's share of expected words by language; None without a letter."""
        gathered, n = [], 0

        def settle():
            some = [x for x in gathered if len(x)]
            if some:
                starts = np.cumsum([0, *(len(x) for x in some[:-1])])
                sums = iter(marginals(np.concatenate(some), starts, self.moves.astype(np.float32)))
            for x in gathered:
                yield next(sums) / len(x) if len(x) else None

        for text in texts:
            gathered.append(self.word_scores(text))
            n += len(gathered[-1])
            if n > 200_000:
                yield from settle()
                gathered, n = [], 0
        yield from settle()


def _expected(scores: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word, and expected transitions in all, of (sequences, words, languages)."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    n, length, k = e.shape
    alpha = np.empty_like(e)
    a = np.full((n, k), 1 / k)
    for t in range(length):
        a = _scaled((a @ m) * e[:, t])
        alpha[:, t] = a
    gamma, pair, b = np.empty_like(e), np.zeros((k, k)), np.ones((n, k))
    for t in range(length - 1, -1, -1):
        gamma[:, t] = _scaled(alpha[:, t] * b)
        eb = e[:, t] * b
        if t:
            pair += _scaled(alpha[:, t - 1, :, None] * m * eb[:, None, :]).sum(axis=0)
        b = _scaled(eb @ m.T)
    return gamma, pair


def fit(rows: list[tuple[str, str]], seed: int = 1, rounds: int = 45, l2: float = 1e-3, length: int = 64, min_count: int = 3) -> Model:
    """Fit on (language, text) rows by gradient steps on the penalised log-likelihood of spliced sequences."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in rows})
    by = [[[w for part in words_of(t) for w in part] for lang, t in rows if lang == one] for one in langs]
    counts = Counter(w for docs in by for d in docs for w in d)
    lexicon = {w for w, c in counts.items() if c >= min_count}
    vocab = {w: i for i, w in enumerate(w for w in sorted(counts) if features(w, lexicon))}
    if not langs or not vocab:
        return Model(langs or ["und"], np.zeros((1 << BITS, max(1, len(langs))), np.float32), np.ones((max(1, len(langs)),) * 2), lexicon)
    k = len(langs)
    runs = []
    for y, docs in enumerate(by):
        for d in docs:
            ids = [vocab[w] for w in d if w in vocab]
            while ids:
                n = int(rng.integers(5, 2 * length))
                runs.append((y, ids[:n]))
                ids = ids[n:]
    rng.shuffle(runs)
    words = np.array([i for _, ids in runs for i in ids])
    labels = np.array([y for y, ids in runs for _ in ids])
    n = len(words) // length
    if n:
        words, labels = words[: n * length].reshape(n, length), labels[: n * length].reshape(n, length)
    else:
        words, labels = words[None, :], labels[None, :]
    n, length = words.shape
    lists = [features(w, lexicon) for w in vocab]
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate([np.array(x) for x in lists])
    of_word = np.repeat(np.arange(len(lists)), sizes)
    weights, moves = np.zeros((1 << BITS, k)), np.zeros((k, k))
    seen_w, seen_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    weight_of = np.bincount(labels.ravel(), minlength=k)
    fair = (len(labels.ravel()) / (k * np.maximum(1, weight_of))).clip(0.2, 5)
    scale = fair[labels] / labels.size
    truth_moves = np.zeros((k, k))
    np.add.at(truth_moves, (labels[:, :-1], labels[:, 1:]), 1.0)
    at_once = max(1, min(n, _FIT_VALUES // (k * max(k, length))))
    for _ in range(rounds):
        score_of, m = emissions(lists, weights), np.exp(moves)
        by_word, pair = np.zeros((len(lists), k)), np.zeros((k, k))
        for first in range(0, n, at_once):  # some sequences at a time, so memory doesn't grow with languages
            part = slice(first, first + at_once)
            gamma, more = _expected(score_of[words[part]], m)
            gamma[np.arange(len(gamma))[:, None], np.arange(length), labels[part]] -= 1
            gamma *= scale[part, :, None]
            by_word += np.stack([np.bincount(words[part].ravel(), gamma[:, :, y].ravel(), minlength=len(lists)) for y in range(k)], axis=1)
            pair += more
        grad = np.stack([np.bincount(flat, by_word[of_word, y], minlength=1 << BITS) for y in range(k)], axis=1) + l2 / labels.size * weights
        seen_w += grad**2
        weights -= 0.3 * grad / np.sqrt(seen_w)
        grad = (pair - truth_moves) / labels.size + l2 * moves
        seen_m += grad**2
        moves -= 0.3 * grad / np.sqrt(seen_m)
    return Model(langs, weights.astype(np.float32), np.exp(moves), lexicon)


def train(docs: DataFrame, learn, per_lang: int = 300, excerpt: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of the rows where ``learn`` (a column) holds and text and lang are not null."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learn.alias("learn"))
    rows = rows.where("learn AND lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang).select("doc_id", "lang")
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - excerpt)).cast("int") + 1
    part = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "doc_id", F.substring(F.col("text"), at, F.lit(excerpt)).alias("text"))
    part = part.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # one row for each id, however often it is repeated
    return fit([(r["lang"], r["text"]) for r in sorted(part.collect(), key=lambda r: (r["lang"], r["doc_id"], r["text"]))])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, langs (shares of at least 0.05), after the columns of ``keep``.

    The language is ``und`` with score 0 where text is null or has no letter.
    Ties go to the first language by name. Repeated rows and null ids each give
    a row. Texts may be of any length: words are read a part of the text at a
    time. ``keep`` must not name a produced column; others aren't read. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            said = []
            for share in m.shares(b["text"].tolist()):
                if share is None:
                    said.append(("und", 0.0, ""))
                    continue
                best = int(np.argmax(share))
                mix = ",".join(f"{m.langs[i]}:{share[i]:.2f}" for i in np.argsort(-share, kind="stable") if share[i] >= 0.05)
                said.append((m.langs[best], float(min(1.0, share[best])), mix))
            out = b.drop(columns="text")
            for i, c in enumerate(("lang_pred", "score", "langs")):
                out[c] = [x[i] for x in said]
            yield out

    rows = python_rows(docs, id_col, text_col, keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return real_ids(rows.mapInPandas(run, f"{fields}, lang_pred string, score double, langs string"))


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.pmod(crc_of_id(), F.lit(4)) == 2)
    return predict(docs, train(docs, ~F.col("held_out")), keep=("held_out",))
