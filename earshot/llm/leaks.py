"""Evaluation passages that stand in training documents (problem 8).

Every text becomes a sequence of words without case, punctuation, markup and
inserted times. Words are typed: numbers, units and names become placeholders,
ordinary words of the items stay. A template window is ``run`` typed words in a
row; document windows are hash-joined with item windows on the template, and a
pair counts as leaked only if the slots hold the same values. Windows that agree
in template only are followed along the run they lie in: if one mapping of the
item's values to the document's holds over the whole run, numbers, names and
units apart, the document asks the same question with other parameters.

The items may be any number. Their vocabulary, the wording that is no passage
and the windows are tables; to the documents go two bit sets of fixed size.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.splits import connected_components
from earshot.operators.skew import salted_lookup
from earshot.session import cut

#: Share of 8-word windows that an item has in common with an earlier one if they hold one passage.
SAME_PASSAGE = 0.5
#: Unlike passages beside which a unit must recur to be instruction or question wording.
RECURS = 3
#: Bits of the sets that go to the documents (2 MB each, whatever the number of items) and probes into them.
BITS, PROBES = 1 << 24, 3
UNITS = frozenset("percent per cent crowns dollars euros pounds shares notes vouchers tonnes tons units hours days weeks months years million billion thousand".split())
MONTHS = frozenset("january february march april may june july august september october november december".split())

_TAG = re.compile(r"<[^<>]{1,200}>")
_TIME = re.compile(r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?")
_GROUPED = re.compile(r"(?<=\d)[,.](?=\d{3}(?!\d))")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[0-9a-z]+")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_UNIT = re.compile(r"[\n\r]+|(?<=[.?!])\s+|:\s+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
NUMBER, NAME, UNIT = 1, 2, 3


def words(text: str) -> list[str]:
    """The words of a text: entities, tags, times and digit grouping resolved, NFKC, lower case."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if ":" in text:
        text = _TIME.sub(" ", text)
    text = _GROUPED.sub("", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower())


def _hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Positions of 64-bit hashes in a set of so many bits."""
    h = h.view(np.uint64) * _PRIME
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(bits)).astype(np.int64) for k in range(PROBES)]


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether hashes may be in a set: surely true if they are."""
    out = np.ones(len(h), bool)
    for p in _probes(h, 64 * len(bits)):
        out &= (bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0
    return out


def _bit_set(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bit set of a column of bigints, merged by words of 64 bits: at most ``bits / 64`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.unique(np.concatenate(_probes(batch.column(0).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array((np.uint64(1) << (p & 63).astype(np.uint64)).view(np.int64))], ["block", "bits"])

    merged = hashes.mapInArrow(run, "block bigint, bits bigint").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[merged.column(0).to_numpy()] = merged.column(1).to_numpy().view(np.uint64)
    return out


class Typing:
    """Template values of words: a placeholder for numbers, units and names, its hash for an ordinary word of the items.

    A word is ordinary if it is in the bit set. A false hit makes a name
    ordinary on both sides alike: exact passages are found all the same.
    """

    def __init__(self, ordinary: np.ndarray):
        self.ordinary = ordinary
        self.known: dict[str, int] = {}

    def _value(self, word: str) -> int:
        if word[0].isdigit():
            return NUMBER
        if word in UNITS:
            return UNIT
        h = _hash(word)
        return h | 4 if word in MONTHS or _holds(self.ordinary, np.array([h], np.uint64))[0] else NAME

    def encode(self, seq: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 400_000:
            known.clear()
        for w in set(seq).difference(known):
            known[w] = self._value(w)
        return np.fromiter(map(known.__getitem__, seq), np.uint64, len(seq))


def window_hashes(values: np.ndarray, run: int) -> np.ndarray:
    """Hash of the template window at each position."""
    t = values * _PRIME
    t ^= t >> np.uint64(29)
    n = max(len(values) - run + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(run):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + t[k : k + n]
    return h.view(np.int64)


def _slots(seq: list[str], values: np.ndarray, at: int, run: int) -> str:
    """The words of a window's placeholders, each with its type."""
    return " ".join(f"{t}{w}" for w, t in zip(seq[at : at + run], values[at : at + run].tolist()) if t <= 3)


def _units(items: DataFrame) -> DataFrame:
    """``item, unit_no, words`` of (item, text): lines, sentences and what stands before a colon."""
    schema = pa.schema([("item", pa.int64()), ("unit_no", pa.int64()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, u) for i, t in zip(*(c.to_pylist() for c in batch.columns)) for k, u in enumerate(x for x in map(words, _UNIT.split(t)) if x)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return items.mapInArrow(run, "item bigint, unit_no bigint, words array<string>")


def _ordinary_words(items: DataFrame) -> DataFrame:
    """Hashes of the words that stand in lower case in an item and hold no digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w.lower() for t in batch.column(1).to_pylist() for w in _WORD.findall(t) if not w[0].isupper() and not any(c.isdigit() for c in w)}
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_hash(w) for w in found], np.uint64).view(np.int64))], ["h"])

    return items.mapInArrow(run, "h bigint").distinct()


def _same_passage(units: DataFrame) -> DataFrame:
    """``item, passage``: items that share a passage share ``passage``.

    Every 8-word window belongs to the first item that holds it; an item of
    whose windows at least ``SAME_PASSAGE`` belong to an earlier one holds the
    same passage.
    """
    schema = pa.schema([("item", pa.int64()), ("g", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int]] = []
            for item, seq in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.fromiter(map(_hash, seq), np.uint64, len(seq))
                rows += [(item, g) for g in set(window_hashes(h, 8).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], schema=schema)

    whole = units.groupBy("item").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "words"))), lambda u: u["words"])).alias("words"))
    grams = cut(whole.mapInArrow(run, "item bigint, g bigint"))
    first = grams.groupBy("g").agg(F.min("item").alias("first"))
    n = grams.groupBy("item").agg(F.count("*").alias("n"))
    shared = salted_lookup(grams, first, ["g"]).where("first < item").groupBy("item", "first").agg(F.count("*").alias("k")).join(n, "item").where(F.col("k") >= SAME_PASSAGE * F.col("n"))
    linked = connected_components(shared.select(F.col("item").alias("u"), F.col("first").alias("v")))
    return units.select("item").distinct().join(linked.select(F.col("node").alias("item"), "root"), "item", "left").select("item", F.coalesce("root", "item").alias("passage"))


def item_windows(items: DataFrame, run: int, bits: int = BITS) -> tuple[DataFrame, Typing]:
    """``item_id, template, item_pos, item_slots`` of the windows of the items' passages, and the typing of words."""
    texts = cut(items.where("item is not null and trim(text) <> ''").distinct())
    typing = Typing(_bit_set(_ordinary_words(texts), bits))
    units = cut(_units(texts))

    def canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            hashes = []
            for seq in rows:
                values = typing.encode(seq)
                kept = [w if t > 3 or t == UNIT else str(t) for w, t in zip(seq, values.tolist())]
                hashes.append(_hash(" ".join(kept)) >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.int64())], ["item", "unit_no", "words", "unit"])

    units = units.mapInArrow(canonical, "item bigint, unit_no bigint, words array<string>, unit bigint")
    known = salted_lookup(units, _same_passage(units), ["item"])
    wording = known.groupBy("unit").agg(F.count_distinct("passage").alias("n")).where(F.col("n") >= RECURS).select("unit", F.lit(1).alias("wording"))
    told = salted_lookup(units, wording, ["unit"], "left").withColumn("part", F.sum(F.coalesce("wording", F.lit(0))).over(Window.partitionBy("item").orderBy("unit_no")))
    passages = told.where("wording is null").groupBy("item", "part").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "words"))), lambda u: u["words"])).alias("words"))
    schema = pa.schema([("item_id", pa.int64()), ("template", pa.int64()), ("item_pos", pa.int64()), ("item_slots", pa.string())])

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, part, seq in zip(*(batch.column(c).to_pylist() for c in ("item", "part", "words"))):
                values = typing.encode(seq)
                # positions of different passages of one item never meet
                rows += [(item, h, (part << 32) + k, _slots(seq, values, k, run)) for k, h in enumerate(window_hashes(values, run).tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return cut(passages.mapInArrow(cut_windows, "item_id bigint, template bigint, item_pos bigint, item_slots string")), typing


def _finder(typing: Typing, templates: np.ndarray, run: int, positions: bool) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("template", pa.int64()), ("pos", pa.int64()), ("slots", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seq = words(t)
                if len(seq) < run:
                    continue
                values = typing.encode(seq)
                h = window_hashes(values, run)
                at = np.flatnonzero(_holds(templates, h)).tolist()
                if at:
                    rows = {(int(h[k]), k if positions else 0, _slots(seq, values, k, run)) for k in at}
                    found += [(doc, *r) for r in rows]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return find


def window_matches(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", run: int = 12, positions: bool = False, bits: int = BITS) -> DataFrame:
    """``doc_id, item_id, slots, item_slots`` of the template windows of ``run`` words that a document and an item's passage share.

    With ``positions`` also ``shift``, the same for all windows of one run of
    words. Instruction and question wording (units that recur beside
    ``RECURS`` or more unlike passages, names and numbers aside) is no
    passage; items that share a passage all match; passages under ``run``
    words match nothing. Null and blank texts match nothing, repeated rows
    count once, empty tables give no row; further columns are not read. The
    join is salted: a template in a third of all documents is worked on by
    many tasks. ``bits``: size of the two sets that go to the documents; it
    decides only how many windows reach the join in vain.
    """
    wanted, typing = item_windows(items.select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("text")), run, bits)
    templates = _bit_set(wanted.select("template").distinct(), bits)
    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t")).where("t is not null")
    shared = documents.sparkSession.sparkContext.broadcast((typing, templates))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _finder(*shared.value, run, positions)(batches)

    seen = docs.mapInArrow(find, "doc_id bigint, template bigint, pos bigint, slots string")
    side = wanted if positions else wanted.select("item_id", "template", "item_slots").distinct()
    pairs = salted_lookup(seen, side, ["template"])
    return pairs.select("doc_id", "item_id", "slots", "item_slots", *([(F.col("pos") - F.col("item_pos")).alias("shift")] if positions else []))


def leaked(matches: DataFrame) -> DataFrame:
    """``doc_id, item_id``: the document repeats a window of the item's passage, slots and all."""
    return matches.where("slots = item_slots").select("doc_id", "item_id").distinct()


def reparameterised(matches: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_windows`` of documents with a run of the item's passage under other parameters, from matches with positions.

    Along a run (windows of one shift) each value of the item must stand for
    one value of the document and the other way round, numbers, names and
    units each for themselves; at least one value must differ, and no window
    of the pair may be leaked. ``n_windows`` is the longest such run.
    """
    pair = F.arrays_zip(F.split("item_slots", " ").alias("a"), F.split("slots", " ").alias("b"))
    run = ["doc_id", "item_id", "shift"]
    values = matches.where("slots <> ''").select(*run, F.explode(pair).alias("p")).select(*run, "p.a", "p.b").groupBy(*run, "a", "b").agg(F.lit(1).alias("one"))
    forth = values.groupBy(*run, "a").agg(F.count("*").alias("n"), F.max(F.col("a") != F.col("b")).alias("other")).groupBy(*run).agg(F.max("n").alias("forth"), F.max("other").alias("other"))
    back = values.groupBy(*run, "b").agg(F.count("*").alias("n")).groupBy(*run).agg(F.max("n").alias("back"))
    windows = matches.groupBy(*run).agg(F.count("*").alias("n_windows"))
    whole = forth.join(back, run).where("forth = 1 and back = 1 and other").join(windows, run)
    best = whole.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"))
    return best.join(leaked(matches), ["doc_id", "item_id"], "left_anti")
