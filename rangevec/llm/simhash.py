"""SimHash near-dedup by tiled exact comparison.

Distinct fingerprints are laid out in cells by the population counts of their
four 16-bit quarters. Two fingerprints that differ in at most r bits lie in
cells whose counts differ by at most r in sum, so only such cells are compared;
within a pair of tiles every fingerprint meets every other by exclusive-or and
bit count. Cells are cut by a hash into tiles of bounded size, so a dense cell
is many tiles, and a tile pair emits a spanning forest, never all pairs.

What reaches the driver is a count for each cell (at most 17**4 of them) and
the list of tiles, whose number is bounded by the tile size, which grows with
the table once there would be more than ``max_tiles`` of them.

With ``similarity`` the fingerprints only find candidates: they have 256 bits,
the radius is what that Jaccard similarity of shingle sets leads to (and four
standard deviations more), and cells hold documents by their number of distinct
shingles, the population count of their sets: sets that similar differ in size
by no more than that factor, so only a cell and the next are compared. Documents
with a candidate are then tiled once more, with the sorted hashes of their
shingles, and a link stands only where the sets themselves are that similar.
Candidates that links of the same tile connect already need no look.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangevec.llm.common import python_rows, real_ids, short_batches, table
from rangevec.llm.components import connected_components, forest
from rangevec.sources.scratch import materialize

SEED = 42
_BLOCK = 1 << 16
#: A tile of 256-bit fingerprints is half a megabyte; a row is sent once for each tile it meets, so fewer, larger tiles move less.
TILE_ROWS = 1 << 14
#: A tile with sets of shingles holds fewer, since a set is about as long as its text.
SET_TILE_ROWS = 1 << 10


def shingles(text: str, width: int) -> list[bytes]:
    """Runs of ``width`` words, repeats included, joined by a space; fewer words make one run."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    return [joined[a : b - 1] for a, b in zip(starts, ends[width - 1 :])]


def fingerprint(runs: list[bytes], seed: int = SEED) -> int:
    """The bits that are set in over half of the shingles' hashes; zero without shingles."""
    n = len(runs)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = runs[at : at + _BLOCK]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, itertools.repeat(seed)), np.uint64, len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """(doc_id, n, f0, f1, ...) of every row: distinct shingles, and 64 bits a word as signed longs; with ``sets`` also their sorted hashes as bytes.

    One word takes shingles with repeats; more take each distinct shingle once.
    """
    short_batches(docs.sparkSession)
    names = [f"f{i}" for i in range(words)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.zeros((len(b), words), np.uint64)
            sizes = np.zeros(len(b), np.int64)
            hashes = []
            for i, text in enumerate(b["text"]):
                runs = shingles(text, width)
                if words > 1:
                    runs = list(set(runs))
                sizes[i] = len(runs)
                found[i] = [fingerprint(runs, SEED + w) for w in range(words)]
                if sets:
                    hashes.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs))).tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": sizes} | {c: found[:, w].view(np.int64) for w, c in enumerate(names)} | ({"set": hashes} if sets else {}))

    schema = "doc_id long, n long, " + ", ".join(f"{c} long" for c in names) + (", set binary" if sets else "")
    return real_ids(python_rows(docs, id_col, text_col).mapInPandas(run, schema))


class _Links:
    """Links of one tile, cut down to a forest whenever many have gathered."""

    def __init__(self) -> None:
        self.u, self.v, self.n = [], [], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            self.u.append(u)
            self.v.append(v)
            self.n += len(u)
            if self.n > 200_000:
                self.u, self.v = ([x] for x in self.cut())
                self.n = len(self.u[0])

    def cut(self) -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate(self.u), np.concatenate(self.v)) if self.u else (np.zeros(0, np.int64),) * 2


class _Verified(_Links):
    """Links of one tile whose sets have the Jaccard similarity; those that join nothing new are not looked at."""

    def __init__(self, similarity: float) -> None:
        super().__init__()
        self.similarity, self.root = similarity, {}

    def find(self, x: int) -> int:
        top = x
        while (up := self.root.get(top, top)) != top:
            top = up
        while x != top:
            self.root[x], x = top, self.root.get(x, x)
        return top

    def check(self, u: np.ndarray, v: np.ndarray, o: np.ndarray, g: np.ndarray, own: list[bytes], guest: list[bytes], step: int = 1000) -> None:
        """Look at the pairs (u, v), whose sets are own[o] and guest[g], some at a time; between, those that are connected by now are left out."""
        while len(u):
            ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = np.array([self.find(x) for x in ids.tolist()], np.int64)[at]
            apart = root[: len(u)] != root[len(u) :]
            u, v, o, g = u[apart], v[apart], o[apart], g[apart]
            stand = []
            for i, (a, b) in enumerate(zip(u[:step].tolist(), v[:step].tolist())):
                x, y = self.find(a), self.find(b)
                if x != y and similar(own[o[i]], guest[g[i]], self.similarity):
                    self.root[max(x, y)] = min(x, y)
                    stand.append(i)
            self.add(u[stand], v[stand])
            u, v, o, g = u[step:], v[step:], o[step:], g[step:]


def similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets reach the Jaccard similarity; sizes alone rule most others out."""
    return min(len(a), len(b)) >= (similarity - 1e-12) * max(len(a), len(b)) and jaccard(a, b) >= similarity - 1e-12


def jaccard(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of sorted hashes; empty sets are equal."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def compare(own: np.ndarray, own_id: np.ndarray, guest: np.ndarray, guest_id: np.ndarray, radii: tuple[int, int], links: _Links, same: bool = False, sets: tuple[list, list] | None = None) -> None:
    """Link all of ``own`` and ``guest`` (rows of words) within the radii of the first word and of all, a block at a time."""
    step = max(1, (1 << 20) // max(1, len(own)))
    first = np.ascontiguousarray(own[:, 0])
    for at in range(0, len(guest), step):
        g, o = np.nonzero(np.bitwise_count(guest[at : at + step, :1] ^ first[None, :]) <= radii[0])
        g += at
        if same:
            later = o < g
            g, o = g[later], o[later]
        if own.shape[1] > 1:
            near = np.bitwise_count(guest[g] ^ own[o]).sum(axis=1, dtype=np.int64) <= radii[1]
            g, o = g[near], o[near]
        if sets is None:
            links.add(own_id[o], guest_id[g])
        else:
            links.check(own_id[o], guest_id[g], o, g, *sets)


def _tile_links(radii: tuple[int, int], names: list[str], similarity: float | None = None):
    fresh = _Links if similarity is None else lambda: _Verified(similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        home, own, own_id, own_sets, links, fixed = None, [], [], [], fresh(), None

        def settle():
            nonlocal fixed
            if fixed is None:
                fixed = (np.concatenate(own), np.concatenate(own_id)) if own else (np.zeros((0, len(names)), np.uint64), np.zeros(0, np.int64))
                compare(*fixed, *fixed, radii, links, same=True, sets=None if similarity is None else (own_sets, own_sets))

        def done():
            settle()
            u, v = links.cut()
            return pd.DataFrame({"u": u, "v": v})

        for b in batches:
            at, guest, rep = (b[c].to_numpy() for c in ("home", "guest", "rep"))
            fps = np.ascontiguousarray(b[names].to_numpy()).view(np.uint64)
            held = None if similarity is None else b["set"].to_numpy()
            cuts = np.flatnonzero(np.diff(at) != 0) + 1
            for a, z in zip([0, *cuts], [*cuts, len(at)]):
                if a == z:
                    continue
                if at[a] != home:
                    if home is not None:
                        yield done()
                    home, own, own_id, own_sets, links, fixed = at[a], [], [], [], fresh(), None
                stay = guest[a:z] == 0
                if stay.any():
                    own.append(fps[a:z][stay])
                    own_id.append(rep[a:z][stay])
                    if held is not None:
                        own_sets.extend(held[a:z][stay])
                if not stay.all():
                    settle()
                    sets = None if held is None else (own_sets, list(held[a:z][~stay]))
                    compare(*fixed, fps[a:z][~stay], rep[a:z][~stay], radii, links, sets=sets)
        if home is not None:
            yield done()

    return run


def _neighbours(cells: np.ndarray, radius: int, parts: int) -> list[tuple[int, int]]:
    """Pairs (a, b), a < b, of cells present whose counts differ by at most radius in sum."""
    bits, base = 64 // parts, 64 // parts + 1
    digits = np.stack([(cells // base**i) % base for i in range(parts)], axis=1)
    found = []
    for step in itertools.product(range(-radius, radius + 1), repeat=parts):
        move = sum(x * base**i for i, x in enumerate(step))
        if move > 0 and sum(map(abs, step)) <= radius:
            there = digits + np.array(step)
            a = np.flatnonzero(((there >= 0) & (there <= bits)).all(axis=1))
            b = np.searchsorted(cells, cells[a] + move)
            hit = (b < len(cells)) & (cells[np.minimum(b, len(cells) - 1)] == cells[a] + move)
            found += zip(cells[a[hit]].tolist(), cells[b[hit]].tolist())
    return found


def quarter_cell(column: str) -> tuple:
    """The cell of a fingerprint: the population counts of its quarters."""
    counts = [F.bit_count(F.shiftrightunsigned(column, 16 * i).bitwiseAND(0xFFFF)) * 17**i for i in range(4)]
    return sum(counts[1:], counts[0]).cast("int")


def near_links(reps: DataFrame, names: list[str], radii: tuple[int, int], neighbours, tile_rows: int = TILE_ROWS, max_tiles: int = 50_000, similarity: float | None = None) -> DataFrame:
    """Spanning links (u, v) of all pairs of ``reps`` (cell, rep and the words ``names``) within the radii and in neighbouring cells; with ``similarity``, whose sets (column ``set``) are that similar."""
    spark = reps.sparkSession
    counts = {r["cell"]: r["n"] for r in reps.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "u long, v long")
    rows = max(tile_rows, -(-sum(counts.values()) // max_tiles))
    cut = {c: -(-n // rows) for c, n in counts.items()}
    first, total = {}, 0
    for c in sorted(cut):
        first[c] = total
        total += cut[c]
    beyond = {c: [] for c in cut}
    for a, b in neighbours(np.array(sorted(cut), np.int64)):
        beyond[a].append((first[b], first[b] + cut[b] - 1))
    # a row for each cell, with a pair of numbers for each neighbouring cell: its size doesn't depend on how many rows or tiles there are
    layout = spark.createDataFrame([(c, first[c], cut[c], beyond[c]) for c in sorted(cut)], "cell int, first int, cut int, beyond array<struct<a:int,z:int>>")
    placed = (
        reps.join(F.broadcast(layout), "cell")
        .withColumn("tile", F.col("first") + F.pmod(F.xxhash64(*names), F.col("cut")).cast("int"))
        .withColumn("later", F.when(F.col("tile") + 1 < F.col("first") + F.col("cut"), F.sequence(F.col("tile") + 1, F.col("first") + F.col("cut") - 1)).otherwise(F.array().cast("array<int>")))
    )
    carried = names if similarity is None else [*names, "set"]
    homes = F.concat(F.array(F.struct(F.col("tile").alias("home"), F.lit(0).alias("guest"))), F.transform(F.concat("later", F.flatten(F.transform("beyond", lambda x: F.sequence(x["a"], x["z"])))), lambda h: F.struct(h.alias("home"), F.lit(1).alias("guest"))))
    sent = placed.select(F.explode(homes).alias("to"), "rep", *carried).select("to.home", "to.guest", "rep", *carried)
    spread = min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 64)))
    return sent.repartition(spread, "home").sortWithinPartitions("home", "guest").mapInPandas(_tile_links(radii, names, similarity), "u long, v long")


def wide_radii(similarity: float, words: int) -> tuple[int, int]:
    """Radii of the first word and of all that sets of this Jaccard similarity keep, four deviations over their mean: one pair in 16,000 at the very limit isn't a candidate."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    reach = lambda bits: math.floor(bits * share + 4 * math.sqrt(bits * share * (1 - share)))
    return reach(64), reach(64 * words)


def simhash_dedup(docs: DataFrame, width: int = 3, radius: int = 2, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits a word), component_id.

    Documents whose fingerprints differ in at most ``radius`` bits are linked
    (with ``similarity``: whose shingle sets are that similar); component_id is the smallest id
    reachable. Null and empty texts, and texts of blanks, have fingerprint zero
    and are linked like any other. Rows with a null id have a null component.
    Repeated rows each give a row. Other columns are not read. An empty table
    gives an empty result.
    """
    words = 4 if similarity else 1
    names = [f"f{i}" for i in range(words)]
    if similarity:
        radii, step = wide_radii(similarity, words), math.log(1 / similarity)
        cell = F.when(F.col("n") > 0, F.floor(F.log(F.col("n").cast("double")) / step)).otherwise(-9).cast("int")
        neighbours = lambda cells: [(c, c + 1) for c in cells.tolist() if c + 1 in set(cells.tolist())]
    else:
        radii, cell = (radius, radius), quarter_cell("f0")
        neighbours = lambda cells: _neighbours(cells, radius, 4)
    rows = materialize(fingerprints(docs, width, words, id_col, text_col).withColumn("cell", cell).drop("n"), "fingerprints")
    reps = materialize(rows.where("doc_id IS NOT NULL").groupBy("cell", *names).agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    links = near_links(reps, names, radii, neighbours, tile_rows)
    if similarity:
        links = materialize(links, "candidates")
        ends = links.select(F.col("u").alias("_end")).union(links.select("v")).distinct()
        met = docs.join(ends, docs[id_col].cast("long") == ends["_end"], "left_semi")
        sets = fingerprints(met, width, words, id_col, text_col, sets=True).withColumn("cell", cell).withColumnRenamed("doc_id", "rep")
        # rows that share an id are one node; each of their texts is compared
        sets = materialize(sets.dropDuplicates(["rep", "cell", *names]).drop("n"), "candidate-sets")
        links = near_links(sets, names, radii, neighbours, min(tile_rows, SET_TILE_ROWS), similarity=similarity)
    found = connected_components(links)
    classes = reps.join(found, reps["rep"] == found["node"], "left").select("cell", *names, F.coalesce("component", "rep").alias("component_id"))
    classes = materialize(classes, "classes")
    out = rows.join(classes, ["cell", *names], "left")
    return out.select(
        "doc_id",
        F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in names])).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), width=3, radius=2)
