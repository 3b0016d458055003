"""Encoding with a public byte-level BPE vocabulary in numpy (problem 7).

Words are cut by the vocabulary's pattern. The distinct words of a batch go,
bucketed by length, into padded matrices of token ids; each round every row
merges its leftmost pair of the least rank, pairs are looked up in a hash
table with open addressing, and rows shift left over the merged gap. Rows that
have no pair left leave the matrix.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern of the vocabulary, once for any text and once, in an equal form, for plain ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_PATTERN = r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Default place of the rank file; a parameter of every function that needs it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words a worker remembers; beyond it the memory starts anew (results don't depend on it).
REMEMBERED = 300_000
#: Characters encoded at once; bounds the memory of a task.
CHUNK = 2_000_000
NO_PAIR = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> rank of the joined token, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.mask = (1 << int(np.ceil(np.log2(max(16, 3 * len(rank)))))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, NO_PAIR, np.int32)
        key = left.astype(np.int64) << 20 | right
        slot, rest = self._slot(key), np.arange(len(key))
        while len(rest):
            free = self.keys[slot[rest]] == -1
            tried = rest[free]
            self.keys[slot[tried]] = key[tried]  # of several with one slot the last stays
            done = np.zeros(len(key), bool)
            done[tried] = self.keys[slot[tried]] == key[tried]
            self.ranks[slot[done]] = rank[done]
            rest = rest[~done[rest]]
            slot[rest] = slot[rest] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks in the shape of the arguments; NO_PAIR where the pair joins to no token."""
        key = (left.astype(np.int64) << 20 | right).ravel()
        slot = self._slot(key)
        out = np.full(len(key), NO_PAIR, np.int32)
        rest = np.arange(len(key))
        while len(rest):
            at = self.keys[slot[rest]]
            hit = at == key[rest]
            out[rest[hit]] = self.ranks[slot[rest[hit]]]
            rest = rest[~hit & (at != -1)]
            slot[rest] = slot[rest] + 1 & self.mask
        return out.reshape(left.shape)


class Bpe:
    """Encoder of one rank file (``base64 rank`` per line)."""

    def __init__(self, ranks: bytes):
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        pairs = [(a, b, r) for token, r in rank.items() if len(token) > 1 for i in range(1, len(token)) if (a := rank.get(token[:i])) is not None and (b := rank.get(token[i:])) is not None]
        self.table = PairTable(*np.array(pairs, np.int64).T)
        self.any, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.A)
        self.odd = re.compile("[\x1c-\x1f]")  # white space to one pattern, none to the other
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def words(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() and not self.odd.search(text) else self.any).findall(text)

    def _rounds(self, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a padded matrix to the end. m: ids, -1 beyond the row's n."""
        out, out_n = np.full(m.shape, -1, np.int64), np.zeros(len(m), np.int64)
        row = np.arange(len(m))
        ranks = np.where(m[:, 1:] >= 0, self.table.find(m[:, :-1].clip(0), m[:, 1:].clip(0)), NO_PAIR)
        while len(row):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            least = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NO_PAIR)
            ended = least == NO_PAIR
            if ended.any():
                out[row[ended], : m.shape[1]] = m[ended]
                out_n[row[ended]] = n[ended]
                go = ~ended
                row, m, n, ranks, at, least = row[go], m[go], n[go], ranks[go], at[go], least[go]
                if not len(row):
                    break
                width = int(n.max())
                m, ranks = m[:, :width], ranks[:, : width - 1]
            # compaction: the columns after the pair move one to the left
            k, column = np.arange(len(row)), np.arange(m.shape[1])
            source = np.minimum(column[None, :] + (column[None, :] > at[:, None]), m.shape[1] - 1)
            m = np.take_along_axis(m, source, 1)
            m[k, at] = least
            n = n - 1
            m[k, n] = -1
            ranks = np.take_along_axis(ranks, np.minimum(column[None, :-1] + (column[None, :-1] > at[:, None]), ranks.shape[1] - 1), 1)
            ranks[k, np.minimum(n - 1, ranks.shape[1] - 1)] = NO_PAIR
            for side in (at - 1, at):  # only the pairs beside the merged one change
                ok = (side >= 0) & (side < n - 1)
                ranks[k[ok], side[ok]] = self.table.find(m[k[ok], side[ok]], m[k[ok], side[ok] + 1])
        return out, out_n

    def _long_rounds(self, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_rounds`` for long rows: a round merges all pairs of the row's least rank, from the left.

        Every pair made by a merge has a greater rank than the merge itself, so
        the leftmost such pairs would be merged one by one in the next rounds.
        """
        out, out_n = np.full(m.shape, -1, np.int64), np.zeros(len(m), np.int64)
        row = np.arange(len(m))
        while len(row):
            ranks = np.where(m[:, 1:] >= 0, self.table.find(m[:, :-1].clip(0), m[:, 1:].clip(0)), NO_PAIR)
            least = ranks.min(1, initial=NO_PAIR)
            ended = least == NO_PAIR
            if ended.any():
                out[row[ended], : m.shape[1]] = m[ended]
                out_n[row[ended]] = n[ended]
                row, m, ranks, least = row[~ended], m[~ended], ranks[~ended], least[~ended]
                if not len(row):
                    break
            hit, column = ranks == least[:, None], np.arange(ranks.shape[1])
            # overlapping pairs: in a stretch of neighbours every second one from its first
            first = np.maximum.accumulate(np.where(hit & ~np.pad(hit, ((0, 0), (1, 0)))[:, :-1], column, 0), 1)
            hit &= (column - first) % 2 == 0
            m = m.copy()
            m[:, :-1] = np.where(hit, least[:, None], m[:, :-1])
            # compaction: what stays of each row moves to its left end
            stays = m >= 0
            stays[:, 1:] &= ~hit
            n = stays.sum(1)
            k, c = np.nonzero(stays)
            packed = np.full((len(m), int(n.max())), -1, np.int64)
            packed[k, (np.cumsum(stays, 1) - 1)[k, c]] = m[k, c]
            m = packed
        return out, out_n

    def _learn(self, fresh: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        size = np.array([len(b) for b in raw], np.int64)
        ids: list[np.ndarray | None] = [None] * len(raw)
        bounds = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64]
        while bounds[-1] < size.max():
            bounds += [bounds[-2] * 2]
        for low, high in zip([0, *bounds], bounds):
            rows = np.flatnonzero((size > low) & (size <= high))
            for part in np.array_split(rows, max(1, len(rows) * high // 2_000_000)):
                if not len(part):
                    continue
                n = size[part]
                m = np.full((len(part), high), -1, np.int64)
                m[np.arange(high)[None, :] < n[:, None]] = self.byte_id[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                m, n = self._rounds(m, n) if high <= 32 else self._long_rounds(m, n)
                for i, r, k in zip(part.tolist(), m, n.tolist()):
                    ids[i] = r[:k]
        lengths = np.array([len(x) for x in ids], np.int64)
        base = len(self.flat)
        self.known.update(zip(fresh, range(len(self.start), len(self.start) + len(fresh))))
        self.start = np.r_[self.start, base + np.r_[0, np.cumsum(lengths)[:-1]]]
        self.length = np.r_[self.length, lengths]
        self.flat = np.r_[self.flat, np.concatenate(ids).astype(np.int32)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each; none for null and empty texts."""
        words = [self.words(t) if t else [] for t in texts]
        fresh = sorted(set().union(*words).difference(self.known))
        if len(self.known) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = sorted(set().union(*words))
        if fresh:
            self._learn(fresh)
        get = self.known.__getitem__
        per_text = np.array([len(w) for w in words], np.int64)
        which = np.empty(int(per_text.sum()), np.int64)
        at = 0
        for w in words:
            which[at : at + len(w)] = np.fromiter(map(get, w), np.int64, len(w))
            at += len(w)
        lengths = self.length[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.start[which] - (ends - lengths), lengths) + np.arange(total)] if total else np.zeros(0, np.int32)
        word_ends = np.r_[0, np.cumsum(per_text)]
        id_ends = np.r_[0, ends][word_ends]
        return flat, np.diff(id_ends)


#: One encoder a worker process and rank file.
_ENCODERS: dict[bytes, Bpe] = {}


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """``key, ids``: the ids of every text, without special tokens.

    Null and empty texts have an empty list; special-token strings in a text
    are ordinary text; repeated rows are kept; further columns are not read.
    The rank file (under 1 MB, a fixed size) is read by the driver and sent along.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    rows = documents.select(F.col(key).alias(key), F.col(text).cast("string").alias("__text"))
    type_of = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = ranks.value
        if blob not in _ENCODERS:
            _ENCODERS[blob] = Bpe(blob)
        encoder = _ENCODERS[blob]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.cumsum([len(t) if t else 0 for t in texts])
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")))
                flat, n = encoder.encode(texts[at:stop])
                offsets = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), lists], [key, "ids"])
                at = stop

    return rows.mapInArrow(run, f"`{key}` {type_of}, ids array<int>")
