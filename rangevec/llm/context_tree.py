"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a context tree over the
bytes before it, up to ``depth`` of them. Every node of a tree has a
Krichevsky-Trofimov estimate of its next bit, and the weighting mixes those of
all depths on the path by how well each would have coded what was seen there.
What a node's tree leaves to bytes never seen in its context goes to the next
shorter context, so each context's probabilities sum to one.

Counts are taken over all training documents: one aggregate over words and
byte runs, combined in the workers and on the map side. No node of the tree is
left out. All nodes whose nearest ``CUT`` context bytes agree are a tree of their
own, so workers weight one such shard after the other: first from its leaves up,
the driver then mixes the orders above (few, as text has few runs of three
bytes), and workers carry that down to every byte run. What is broadcast is
bounded: the most frequent runs with their log-probabilities (at most
``max_nodes``) and the most frequent words (at most ``hot_words``). All other
runs and words come through joins, where by their making none is frequent, so
the scores don't depend on either bound.

The model scores the lower-cased words joined by single spaces and an end mark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangevec.llm.common import crc_of_id, long_batches, python_rows, real_ids, short_batches, table
from rangevec.sources.scratch import materialize

DEPTH = 5
#: Context bytes that a shard has in common, and how many byte runs are weighted at once (a shard is never parted).
CUT, CHUNK = 2, 200_000
_U8 = np.uint64(8)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def grams(bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (context, byte) of every byte and end mark as one number, and where each body begins.

    The lowest byte is the one to code, the next its nearest context; before a body lie ``depth`` zero bytes, and a zero byte ends it.
    """
    pad = b"\0" * depth
    flat = np.frombuffer(pad + (b"\0" + pad).join(bodies) + b"\0", np.uint8).astype(np.uint64)
    sizes = np.array([len(x) for x in bodies], np.int64) + 1
    first = np.cumsum(sizes + depth) - sizes
    keys = flat.copy()
    for d in range(1, depth + 1):
        keys[d:] |= flat[:-d] << np.uint64(8 * d)
    inside = np.ones(len(flat), bool)
    inside[(first[:, None] - np.arange(1, depth + 1)).ravel()] = False
    return keys[inside], np.cumsum(sizes) - sizes


class _Counts:
    """Words and runs counted in one task; handed on whenever many have gathered."""

    def __init__(self, depth: int, most: int = 1_000_000) -> None:
        self.depth, self.most = depth, most
        self.words, self.keys, self.ns, self.bodies, self.size = Counter(), [], [], [], 0

    def add(self, words: list[bytes]) -> None:
        self.words.update(words)
        self.bodies.append(b" ".join(words))
        self.size += len(self.bodies[-1])
        if self.size > 4_000_000:
            self._fold()

    def _fold(self) -> None:
        if self.bodies:
            k, n = np.unique(grams(self.bodies, self.depth)[0], return_counts=True)
            self.keys.append(k)
            self.ns.append(n)
            self.bodies, self.size = [], 0
            if sum(map(len, self.keys)) > 2 * self.most:
                self._merge()

    def _merge(self) -> None:
        if len(self.keys) > 1:
            k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.ns = [np.bincount(at, np.concatenate(self.ns), len(k)).astype(np.int64)]
            self.keys = [k]

    def full(self) -> bool:
        return len(self.words) > self.most or sum(map(len, self.keys)) > 4 * self.most

    def take(self) -> Iterator[pd.DataFrame]:
        self._fold()
        self._merge()
        words = list(self.words.items())
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pd.DataFrame({"word": [w for w, _ in part], "gram": 0, "n": [n for _, n in part]})
        for k, c in zip(self.keys, self.ns):
            for at in range(0, len(k), 50_000):
                yield pd.DataFrame({"word": None, "gram": k[at : at + 50_000].view(np.int64), "n": c[at : at + 50_000].astype(np.int64)})
        self.__init__(self.depth, self.most)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x of at least 0.5, by Stirling's series beyond x + 8."""
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


_HALF, _ONE = (_log_gamma(np.arange(1 << 16) + x) for x in (0.5, 1.0))


def _looked_up(known: np.ndarray, x: np.ndarray, more: float) -> np.ndarray:
    """ln Gamma of counts x plus ``more``, from the table where it reaches."""
    out = known[np.minimum(x, len(known) - 1).astype(np.int64)]
    far = np.flatnonzero(x >= len(known))
    out[far] = _log_gamma(x[far] + more)
    return out


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return _looked_up(_HALF, a, 0.5) + _looked_up(_HALF, b, 0.5) - _looked_up(_ONE, a + b, 1.0) - np.log(np.pi)


def by_order(keys: np.ndarray, ns: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys of each order and their counts, from those of the longest."""
    out = []
    for d in reversed(orders):
        keys, at = np.unique(keys & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        ns = np.bincount(at, ns, len(keys))
        out.append((keys, ns))
    return out[::-1]


class _Nodes:
    """The nodes of one level (bits of the byte known) at the orders from ``first`` on, weighted from the deepest up.

    whole[i]: ln of the weighted block probability; ``deepest`` gives it for nodes of the last order that have a tree below.
    """

    def __init__(self, level: int, first: int, counts: list, deepest: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.node, self.place, self.zeros, self.ones = [], [], [], []
        for k, n in counts:
            head = k >> np.uint64(8 - level)
            new = np.ones(len(k), bool)
            new[1:] = head[1:] != head[:-1]
            at = np.cumsum(new) - 1
            bit = ((k >> np.uint64(7 - level)) & np.uint64(1)).astype(bool)
            self.node.append(head[new])
            self.place.append((at, bit))
            self.zeros.append(np.bincount(at, n * ~bit, len(self.node[-1])))
            self.ones.append(np.bincount(at, n * bit, len(self.node[-1])))
        last = len(counts) - 1
        up = lambda i: np.searchsorted(self.node[i - 1], self.node[i] & np.uint64((1 << (8 * (first + i - 1) + level)) - 1))
        self.parent = [None] + [up(i) for i in range(1, last + 1)]
        self.stop = [None] * (last + 1)
        for i in range(last, -1, -1):
            own = _log_kt(self.zeros[i], self.ones[i])
            if i == last:
                self.whole = own if deepest is None else deepest[1][np.searchsorted(deepest[0], self.node[i])]
                continue
            up, size = self.parent[i + 1], len(self.node[i])
            rest = [np.maximum(0, x[i] - np.bincount(up, x[i + 1], size)) for x in (self.zeros, self.ones)]
            split = np.bincount(up, self.whole, size) + _log_kt(*rest)
            self.whole = np.logaddexp(own, split) - np.log(2)
            self.stop[i] = np.exp(own - np.log(2) - self.whole)

    def mix(self, logs: list[np.ndarray], entry: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Add to ``logs`` the mixture's ln probability of the bit at this level of each key's byte.

        What shorter orders have mixed and left over comes in by ``entry`` (nodes, mixed, carry); the same is returned for the last order.
        """
        if entry is None:
            mixed, carry = np.zeros(len(self.node[0])), np.ones(len(self.node[0]))
        else:
            at = np.searchsorted(entry[0], self.node[0])
            mixed, carry = entry[1][at], entry[2][at]
        for i, (at, bit) in enumerate(self.place):
            kt = (self.ones[i] + 0.5) / (self.zeros[i] + self.ones[i] + 1)
            one = mixed + carry * kt
            logs[i] += np.log(np.where(bit, one[at], 1 - one[at]))
            if i + 1 < len(self.place):
                up = self.parent[i + 1]
                mixed, carry = (mixed + carry * self.stop[i] * kt)[up], (carry * (1 - self.stop[i]))[up]
        return self.node[-1], mixed, carry


class Tree:
    """Log-probabilities (base 10) of bytes in their contexts, from counts by order.

    counts[i]: sorted keys of first + i context bytes and the byte, and how often each was seen; every key's shorter form is among those before.
    By level, ``deepest`` holds the weights of the last order's nodes and ``entry`` what the orders before ``first`` have mixed; ``exit`` is the same after.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], first: int = 0, deepest: list | None = None, entry: list | None = None) -> None:
        counts = [(k.astype(np.uint64), n.astype(np.float64)) for k, n in counts]
        self.first, self.keys, self.contexts, self.left = first, [k for k, _ in counts], [], []
        logs = [np.zeros(len(k)) for k in self.keys]
        self.exit = [_Nodes(level, first, counts, deepest and deepest[level]).mix(logs, entry and entry[level]) for level in range(8)]
        for i, k in enumerate(self.keys):
            contexts, at = np.unique(k >> _U8, return_inverse=True)
            seen = np.bincount(at, np.exp(logs[i]), len(contexts))
            if i:
                below = np.bincount(at, np.exp(logs[i - 1][np.searchsorted(self.keys[i - 1], k & np.uint64((1 << 8 * (first + i)) - 1))]), len(contexts))
            else:  # right for order 0 alone; a shard's first order is the driver's
                below = np.bincount(at, minlength=len(contexts)) / 256
            self.contexts.append(contexts)
            self.left.append((np.log(np.maximum(1 - seen, 1e-9)) - np.log(np.maximum(1 - below, 1e-9))) / np.log(10))
        self.logs = [x / np.log(10) for x in logs]

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Positions in the sorted table, -1 where absent."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each byte in its context, by a tree from order 0 on."""
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        for d in range(len(self.keys) - 1, -1, -1):
            if not len(todo):
                return out
            short = keys[todo] & np.uint64((1 << 8 * (d + 1)) - 1)
            at = self._find(self.keys[d], short)
            known = at >= 0
            out[todo[known]] += self.logs[d][at[known]]
            todo, short = todo[~known], short[~known]
            at = self._find(self.contexts[d], short >> _U8)
            if len(self.left[d]):
                out[todo] += np.where(at >= 0, self.left[d][at], 0.0)
        out[todo] -= np.log10(256.0)
        return out


class Frequent:
    """Values of keys (the most frequent first) by hash tables: each takes those whose place was taken in the one before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self._index()

    def _index(self) -> None:
        self.tables, left = [], np.arange(len(self.keys), dtype=np.int32)
        while len(left):
            bits = max(10, int(np.ceil(np.log2(len(left) * 2))))
            odd = np.uint64((0x9E3779B97F4A7C15 * (2 * len(self.tables) + 1)) % (1 << 64))
            home = (self.keys[left] * odd) >> np.uint64(64 - bits)
            slot = np.zeros(1 << bits, np.int32)
            slot[home[::-1]] = left[::-1]
            self.tables.append((odd, np.uint64(64 - bits), slot))
            left = left[slot[home] != left]

    def __getstate__(self):
        return self.keys, self.values

    def __setstate__(self, state):
        self.keys, self.values = state
        self._index()

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of ``keys``, 0 for those not found, and the positions of these."""
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        for no, (odd, shift, slot) in enumerate(self.tables):
            asked = keys[todo] if no else keys
            at = slot[(asked * odd) >> shift]
            hit = self.keys[at] == asked
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit]
        return out, todo


def _sharded(grams: DataFrame, depth: int, weigh, schema: str) -> DataFrame:
    """What ``weigh`` makes of the counts by order of whole shards of ``grams`` (gram, n), some at a time."""
    cut = min(CUT, depth)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for b in filter(len, batches):
            keys, ns, shards = b["gram"].to_numpy().view(np.uint64), b["n"].to_numpy(), b["shard"].to_numpy()
            ends = np.flatnonzero(shards[1:] != shards[:-1]) + 1
            if parts and parts[-1][2] != shards[0]:
                ends = np.insert(ends, 0, 0)
            done = 0
            for end in ends:
                if size + end - done >= CHUNK:
                    parts.append((keys[done:end], ns[done:end], None))
                    yield from weigh(by_order(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), range(cut, depth + 1)))
                    parts, size, done = [], 0, end
            parts.append((keys[done:], ns[done:], shards[-1]))
            size += len(keys) - done
        if parts:
            yield from weigh(by_order(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), range(cut, depth + 1)))

    shard = F.shiftright("gram", 8).bitwiseAND((1 << 8 * cut) - 1).alias("shard")
    tasks = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grams.select(shard, "gram", "n").repartition(tasks, "shard").sortWithinPartitions("shard").mapInPandas(run, schema)


def weighted(grams: DataFrame, depth: int) -> tuple[Tree, DataFrame]:
    """The tree of all ``grams`` (gram, n): its orders up to the cut, and (kind, key, n, value) of the others.

    kind d has log10 probabilities of the keys of d context bytes (of ``depth`` ones always), kind 16 + d what contexts of d bytes leave to bytes not seen there.
    """
    cut = min(CUT, depth)
    spark = grams.sparkSession

    def rise(counts: list) -> Iterator[pd.DataFrame]:
        for level in range(8):
            nodes = _Nodes(level, cut, counts)
            yield pd.DataFrame({"level": level, "node": nodes.node[0].view(np.int64), "value": nodes.whole})
        yield pd.DataFrame({"level": 8, "node": counts[0][0].view(np.int64), "value": counts[0][1]})

    long_batches(spark)
    found = materialize(_sharded(grams, depth, rise, "level long, node long, value double"), "node-weights").toArrow()
    level, node, value = (found.column(c).to_numpy() for c in ("level", "node", "value"))
    at = np.lexsort((node, level))
    edges = np.searchsorted(level[at], np.arange(10))
    node, value = node[at].view(np.uint64), value[at]
    *deepest, (keys, ns) = [(node[a:z], value[a:z]) for a, z in zip(edges, edges[1:])]
    top = Tree(by_order(keys, ns, range(cut + 1)), 0, deepest)
    entry = spark.sparkContext.broadcast(top.exit)
    top.exit = None

    def fall(counts: list) -> Iterator[pd.DataFrame]:
        tree = Tree(counts, cut, None, entry.value)
        for d in range(cut, depth + 1):
            i = d - cut
            if d > cut or d == depth:
                yield pd.DataFrame({"kind": d, "key": tree.keys[i].view(np.int64), "n": counts[i][1].astype(np.int64), "value": tree.logs[i]})
            if d > cut:
                yield pd.DataFrame({"kind": 16 + d, "key": tree.contexts[i].view(np.int64), "n": 0, "value": tree.left[i]})

    nodes = materialize(_sharded(grams, depth, fall, "kind int, key long, n long, value double"), "context-nodes", ["kind"])
    short_batches(spark)
    return top, nodes


def _threshold(found: DataFrame, most: int, top: int = 1 << 16) -> int:
    """The smallest count that at most ``most`` rows reach; rows above ``top`` are told by powers of two."""
    level = F.when(F.col("n") < top, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n")))).cast("long")
    rows = found.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()
    total, least = 0, None
    for r in sorted(rows, key=lambda r: -r["level"]):
        total += r["rows"]
        if total > most:
            break
        least = r["level"]
    return least if least is not None else 1 << 62


class LanguageModel:
    """What training leaves: the tree (its short orders, all others as a table, frequent byte runs by hash), token totals, the counts of all words as a table and of frequent ones as a dictionary."""

    def __init__(self, depth: int, top: Tree, nodes: DataFrame, frequent: Frequent, words: DataFrame, hot: dict[bytes, int], total: int, distinct: int, ends: int) -> None:
        self.depth, self.top, self.nodes, self.frequent = depth, top, nodes, frequent
        self.words, self.hot, self.total, self.distinct, self.ends = words, hot, total, distinct, ends

    def unseen(self, keys: DataFrame) -> DataFrame:
        """(key, value) of distinct keys that training hasn't: log10 probabilities by the next shorter contexts that it has."""
        top, cut = self.top, min(CUT, self.depth)

        def low(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(low=top.score(b["key"].to_numpy().view(np.uint64)))

        part = lambda d, skip: F.shiftright("key", 8 * skip).bitwiseAND((1 << 8 * (d + 1 - skip)) - 1)
        wanted = [F.struct(F.lit(k).alias("kind"), x.alias("part")) for d in range(cut + 1, self.depth + 1) for k, x in ((d, part(d, 0)), (16 + d, part(d, 1)))]
        each = materialize(keys.mapInPandas(low, "key long, low double"), "unseen")
        if not wanted:
            return each.select("key", F.col("low").alias("value"))
        found = each.select("key", F.explode(F.array(*wanted)).alias("x")).select("key", "x.*").join(self.nodes.select("kind", F.col("key").alias("part"), "value"), ["kind", "part"])
        sums = [F.sum(F.when(F.col("kind") == k + d, F.col("value"))).alias(f"_{k + d}") for d in range(cut + 1, self.depth + 1) for k in (0, 16)]
        value = F.col("low")
        for d in range(cut + 1, self.depth + 1):
            value = F.coalesce(f"_{d}", F.coalesce(F.col(f"_{16 + d}"), F.lit(0.0)) + value)
        return each.join(found.groupBy("key").agg(*sums), "key", "left").select("key", value.alias("value"))


def train(docs: DataFrame, depth: int = DEPTH, max_nodes: int = 1 << 19, hot_words: int = 200_000, text_col: str = "text") -> LanguageModel:
    """Count all of ``docs`` and build the tree. Null text counts as empty.

    ``max_nodes`` byte runs and ``hot_words`` words at most are broadcast for scoring; all others are joined, with the same result.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, ends = _Counts(depth), 0
        for b in batches:
            for text in b["text"]:
                counts.add(words_of(text))
            ends += len(b)
            if counts.full():
                yield from counts.take()
        yield from counts.take()
        yield pd.DataFrame({"word": None, "gram": [-1], "n": [ends]})

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, "word binary, gram long, n long")
    counts = materialize(rows.groupBy("word", "gram").agg(F.sum("n").alias("n")), "corpus-counts")
    words = counts.where("word IS NOT NULL").select("word", "n")
    said = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where("gram = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = _threshold(words, hot_words)
    hot = words.where(F.col("n") >= least).toPandas()
    grams = counts.where("word IS NULL AND gram >= 0").select("gram", "n")
    top, nodes = weighted(grams, depth)
    runs = nodes.where(F.col("kind") == depth).select("key", "n", "value")
    often = runs.where(F.col("n") >= _threshold(runs, max_nodes)).toArrow()
    key, n, value = (often.column(c).to_numpy() for c in ("key", "n", "value"))
    first = np.lexsort((key, -n))
    frequent = Frequent(key[first].view(np.uint64), value[first])
    hot = dict(zip(map(bytes, hot["word"]), hot["n"].tolist()))
    return LanguageModel(depth, top, nodes, frequent, words, hot, said[0] + ends, said[1] + bool(ends), ends)


def score(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``keep``, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    n_tokens counts words and one end; base_score is the add-0.1 unigram log10
    probability of the tokens, score the tree's log10 probability of the whole
    text. Null and empty texts are the end alone. Repeated rows and null ids
    each give a row. A model of no documents gives every token the same base
    and every byte 1/256. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast((model.frequent, model.hot))
    ends, depth = model.ends, model.depth
    room = np.log10(model.total + 0.1 * (model.distinct + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, hot = shared.value
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            said, bodies, first, size = [], [], 0, 0
            values, strange = np.zeros(len(b)), []
            for i, text in enumerate(b["text"]):
                words = words_of(text)
                n = np.fromiter(map(hot.get, words, repeat(0)), np.int64, len(words))
                rare = Counter(words[j] for j in np.flatnonzero(n == 0))
                n = n[n > 0]
                base = float(np.log10(n + 0.1).sum()) + np.log10(ends + 0.1)
                said.append((row, len(words) + 1, len(n) + (ends > 0), base, [{"word": w, "times": c} for w, c in rare.items()]))
                row += 1
                bodies.append(b" ".join(words))
                size += len(bodies[-1])
                if size > 2_000_000 or i == len(b) - 1:
                    keys, starts = grams(bodies, depth)
                    logs, missed = frequent.look(keys)
                    values[first : i + 1] = np.add.reduceat(logs, starts)
                    strange += np.split(keys[missed].view(np.int64), np.searchsorted(missed, starts[1:]))
                    for j, x in enumerate(bodies, first):
                        said[j] += (len(x) + 1,)
                    bodies, first, size = [], i + 1, 0
            out = b.drop(columns="text")
            for j, c in enumerate(("row", "n_tokens", "n_known", "base", "rare", "n_bytes")):
                out[c] = [x[j] for x in said]
            out["score"], out["strange"] = values, strange
            yield out

    rows = python_rows(docs, id_col, text_col, keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    schema = f"{fields}, row long, n_tokens long, n_known long, base double, rare array<struct<word:binary,times:long>>, n_bytes long, score double, strange array<long>"
    scored = materialize(real_ids(rows.mapInPandas(run, schema)), "scored")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.times")
    more = (
        rare.join(model.words, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("base_rare"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("known_rare"))
    )
    # byte runs that aren't among the frequent ones: a row's sum of those known, and one row for each that training hasn't
    runs = model.nodes.where(F.col("kind") == depth).select("key", "value")
    asked = scored.select("row", F.explode("strange").alias("key")).join(runs, "key", "left")
    asked = asked.groupBy("row", F.when(F.col("value").isNull(), F.col("key")).alias("key")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("times"))
    asked = materialize(asked, "byte-runs")
    unseen = asked.where("key IS NOT NULL").select("row", "key", "times")
    unseen = unseen.join(model.unseen(unseen.select("key").distinct()), "key").select("row", (F.col("times") * F.col("value")).alias("value"))
    less = asked.where("key IS NULL").select("row", "value").unionByName(unseen).groupBy("row").agg(F.sum("value").alias("less"))
    zero = F.lit(0)
    scored = scored.drop("rare", "strange").join(less, "row", "left").withColumn("score", F.col("score") + F.coalesce("less", zero)).drop("less")
    return scored.join(more, "row", "left").select(
        "doc_id",
        *keep,
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_rare", zero)).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", zero) - F.col("n_tokens") * F.lit(float(room))).alias("base_score"),
        "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def held_out(remainder: int, of: int) -> Column:
    return F.pmod(crc_of_id(), F.lit(of)) == remainder


def op1_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(0, 10))
    return score(docs, train(docs.where("NOT held_out")), keep=("held_out",))
