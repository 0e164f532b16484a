"""Bounded-space online packing of tokenised documents into sequences.

Each partition keeps at most ``open_windows`` open windows. A document's last
piece goes to the open window that it fits best; where none fits, the fullest
is topped up with the piece's first tokens and emitted, and the rest is placed
again. What is open at the end is merged, first within the partition (leaving
one window that is not full) and then across ``fan`` partitions at a time, whose
windows travel with their tokens: at most one window a partition.

Only descriptions of pieces leave the workers, and the first pass is written to
the shared folder, so both of its readers see the same pieces.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangevec.llm.common import python_rows, real_ids, short_batches, table
from rangevec.sources.scratch import materialize

END_ID = 2
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: A run without white space whose tokens can be looked up one by one: ASCII and Latin letters that no normal form changes.
_PLAIN = re.compile("[\x21-\x7eÀ-įı-ſ]+").fullmatch
_LETTERS = "a-zÀ-ÖØ-öø-ſ"
#: The vocabulary file's own split of lower-case text, over that alphabet.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+").findall


def _visible_bytes() -> dict[int, str]:
    """The character that byte-level models write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids of whole texts, with runs between white space looked up in a bounded store of those met before."""

    def __init__(self, path: str, most: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.runs, self.words, self.most = {}, {}, most
        self.shown = _visible_bytes()
        shape = str(self.tokenizer.normalizer) + str(self.tokenizer.pre_tokenizer)
        self.by_word = "Lowercase" in shape and "ByteLevel" in shape and r"\p{L}" in shape

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            shown = word if word.isascii() else "".join([self.shown[b] for b in word.encode()])
            found = self._packed([t.id for t in self.tokenizer.model.tokenize(shown)])
            if len(self.words) >= self.most:
                self.words.clear()
            self.words[word] = found
        return found

    def _run(self, run: str) -> bytes:
        if _PLAIN(run) and "<|" not in run and len(run) < 1000:
            return b"".join(map(self._word, _SPLIT(run.lower())))
        return self._packed(self._whole(run))

    def ids(self, text: str) -> np.ndarray:
        """Unsigned ids of ``text`` as the tokenizer gives them."""
        if not self.by_word or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return np.array(self._whole(text), self.dtype)
        runs, known = text.split(), self.runs
        try:
            return np.frombuffer(b"".join([known[r] for r in runs]), self.dtype)
        except KeyError:
            pass
        if len(known) >= self.most:
            known.clear()
        new = {r: self._run(r) for r in set(runs).difference(known)}
        if len(new) <= self.most // 2:
            known.update(new)
            return np.frombuffer(b"".join([known[r] for r in runs]), self.dtype)
        return np.frombuffer(b"".join([known.get(r) or new[r] for r in runs]), self.dtype)


_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


class _Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start, ids, total):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[:n], self.total), _Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Packer:
    """Open windows of one task; full ones become rows as they are emitted."""

    def __init__(self, room: int, open_windows: int, first_id: int) -> None:
        self.room, self.most, self.next_id = room, open_windows, first_id
        self.free: list[tuple[int, int]] = []  # (room left, key), sorted
        self.windows: dict[int, list[_Piece]] = {}
        self.rows: list[tuple] = []
        self.key = 0

    def emit(self, pieces: list[_Piece]) -> None:
        at = 0
        for p in pieces:
            crc = zlib.crc32(p.ids.astype("<u4").tobytes())
            self.rows.append((p.doc, p.start, len(p.ids), crc, p.total, self.next_id, at))
            at += len(p.ids)
        self.next_id += 1

    def place(self, p: _Piece) -> None:
        while len(p.ids) >= self.room:
            head, p = p.cut(self.room)
            self.emit([head])
        if p.start:
            p.ids = p.ids.copy()  # else an open window would hold the whole document
        while len(p.ids):
            n = len(p.ids)
            i = bisect.bisect_left(self.free, (n, -1))
            if i < len(self.free):
                left, key = self.free.pop(i)
                self.windows[key].append(p)
                if left == n:
                    self.emit(self.windows.pop(key))
                else:
                    bisect.insort(self.free, (left - n, key))
                return
            if len(self.free) < self.most:
                self.key += 1
                self.windows[self.key] = [p]
                bisect.insort(self.free, (self.room - n, self.key))
                return
            left, key = self.free.pop(0)
            head, p = p.cut(left)
            self.emit([*self.windows.pop(key), head])

    def merge(self) -> list[_Piece]:
        """Fill the fullest open windows from the emptiest; the pieces of the one that is left."""
        order = [[left, self.windows[key]] for left, key in self.free]
        self.free, self.windows = [], {}
        while len(order) > 1:
            left, fullest = order[0]
            taken, source = 0, order[-1][1]
            while taken < left and source:
                p = source.pop()
                if len(p.ids) > left - taken:
                    head, rest = p.cut(left - taken)
                    source.append(rest)
                    p = head
                fullest.append(p)
                taken += len(p.ids)
            order[-1][0] += taken
            order[0][0] -= taken
            if not source:
                order.pop()
            if order[0][0] == 0:
                self.emit(order.pop(0)[1])
        return order[0][1] if order else []


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in _PIECES.split(", ")]
    return pd.DataFrame(rows, columns=names).astype("int64")


def pack(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int | None = END_ID, open_windows: int = 64, fan: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every token of every row lies in exactly one piece. All sequences are full
    but one for each ``fan`` partitions. Null text counts as empty, and an empty
    text is its end id alone (without ``end_id``: no piece). Repeated rows and
    null ids are packed like any other row. Other columns are not read. An empty
    table gives an empty result.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, here = word_ids(tokenizer), TaskContext.get().partitionId()
        packer = Packer(room, open_windows, here << 32)
        last = np.array([] if end_id is None else [end_id], words.dtype)

        def settle(left: list[_Piece]) -> pd.DataFrame:
            found = _frame(packer.rows).assign(left=None, part=here)
            packer.rows = []
            kept = pd.DataFrame({"doc_id": [p.doc for p in left], "start": [p.start for p in left], "length": [len(p.ids) for p in left], "doc_tokens": [p.total for p in left], "left": [p.ids.astype("<u4").tobytes() for p in left]})
            kept = kept.assign(ids_crc32=0, sequence_id=-1, offset=0, part=here)
            return pd.concat([found, kept[found.columns]]) if len(kept) and len(found) else kept[found.columns] if len(kept) else found

        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = words.ids(text)
                ids = np.concatenate([ids, last]) if len(last) else ids
                packer.place(_Piece(int(doc), 0, ids, len(ids)))
            if packer.rows:
                yield settle([])
        yield settle(packer.merge())

    first = materialize(python_rows(docs, id_col, text_col).mapInPandas(run, _PIECES + ", left binary, part long"), "packed")

    def meet(key, group: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(room, len(group) + 1, (1 << 62) + (int(key[0]) << 32))
        for part in group.sort_values(["part", "doc_id", "start"]).itertuples():
            ids = np.frombuffer(part.left, "<u4")
            packer.place(_Piece(int(part.doc_id), int(part.start), ids, int(part.doc_tokens)))
        rest = packer.merge()
        if rest:
            packer.emit(rest)
        return _frame(packer.rows)

    loose = first.where("left IS NOT NULL").groupBy(F.floor(F.col("part") / fan).alias("together")).applyInPandas(meet, _PIECES)
    return real_ids(first.where("left IS NULL").drop("left", "part").unionByName(loose))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
