"""Frequency of every distinct term by merged, compressed identifier bitmaps (problem 4).

Layout is vertical: a term owns, per 2^16 identifiers, one container with the
low 16 bits of the identifiers it was seen with. A container is a sorted
``uint16`` array up to 4096 members and an 8 KiB bit set beyond (whichever is
smaller). Beside it runs a counter of the raw occurrences. Containers are
built inside each input partition, so a term with a third of all rows reaches
the shuffle as at most one container per partition and 65536 identifiers;
they are merged by union and the frequency is the cardinality.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.session import cut

#: Members up to which a container is a sorted array: 4096 x 2 bytes is the size of the bit set.
ARRAY_LIMIT = 4096
_BLANKS = re.compile(r"\s+")
#: Rows gathered in a task before their containers are built; bounds its memory.
FLUSH_ROWS = 400_000
REC, CALL, ALL_CALLS = 0, 1, 2


def normal_term(term: str | None) -> str | None:
    """NFKC, lower case, single spaces, trimmed; None for null and blank."""
    if term is None:
        return None
    return _BLANKS.sub(" ", unicodedata.normalize("NFKC", term).lower()).strip() or None


def pack(low: np.ndarray) -> bytes:
    """Sorted distinct ``uint16`` values as the smaller of array and bit set."""
    if len(low) <= ARRAY_LIMIT:
        return low.astype("<u2").tobytes()
    bits = np.zeros(65536, dtype=bool)
    bits[low] = True
    return b"B" + np.packbits(bits).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    """The sorted members of a container."""
    if len(blob) % 2:
        return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=1))).astype(np.uint16)
    return np.frombuffer(blob, "<u2")


def union(blobs: list[bytes]) -> bytes:
    """One container with the members of all."""
    if len(blobs) == 1:
        return blobs[0]
    if all(len(b) % 2 == 0 for b in blobs) and sum(map(len, blobs)) <= 2 * ARRAY_LIMIT:
        return pack(np.unique(np.concatenate([unpack(b) for b in blobs])))
    bits = np.zeros(8192, np.uint8)
    for b in blobs:
        if len(b) % 2:
            bits |= np.frombuffer(b, np.uint8, offset=1)
        else:
            flags = np.zeros(65536, dtype=bool)
            flags[unpack(b)] = True
            bits |= np.packbits(flags)
    return pack(np.flatnonzero(np.unpackbits(bits)).astype(np.uint16))


def cardinality(blob: bytes) -> int:
    return int(np.bitwise_count(np.frombuffer(blob, np.uint8, offset=1)).sum()) if len(blob) % 2 else len(blob) // 2


_PARTS = pa.schema([("term", pa.string()), ("kind", pa.int8()), ("high", pa.int64()), ("n_rows", pa.int64()), ("members", pa.binary())])


def _containers(codes: np.ndarray, ids: np.ndarray, kind: int, names: list, out: list) -> None:
    """Append (term, kind, high, rows, container) for each (code, high bits) of the pairs."""
    if not len(codes):
        return
    order = np.lexsort((ids, codes))
    codes, ids = codes[order], ids[order]
    high = ids >> 16
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (high[1:] != high[:-1])])
    low = (ids & 0xFFFF).astype(np.uint16)
    fresh = np.r_[True, (codes[1:] != codes[:-1]) | (ids[1:] != ids[:-1])]
    low_fresh, fresh_at = low[fresh], np.r_[0, np.cumsum(fresh)]
    ends = np.r_[first[1:], len(codes)]
    for a, z in zip(first.tolist(), ends.tolist()):
        out.append((names[codes[a]], kind, int(high[a]), z - a, pack(low_fresh[fresh_at[a] : fresh_at[z]])))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, int] = {}
    names: list[str | None] = []
    codes: list[np.ndarray] = []
    recs: list[np.ndarray] = []
    calls: list[np.ndarray] = []
    waiting = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal waiting
        if waiting:
            c, r, k = np.concatenate(codes), np.concatenate(recs), np.concatenate(calls)
            rows: list = []
            ok = c >= 0
            # the lowest bigint stands for a null identifier
            has = r != NULL_ID
            _containers(c[ok & has], r[ok & has], REC, names, rows)
            has = k != NULL_ID
            _containers(c[ok & has], k[ok & has], CALL, names, rows)
            _containers(np.zeros(int(has.sum()), np.int64), k[has], ALL_CALLS, [None], rows)
            for x in (codes, recs, calls, names):
                x.clear()
            known.clear()
            waiting = 0
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows[i : i + 20_000]), _PARTS.types)], schema=_PARTS)

    for batch in batches:
        dictionary = batch.column(0).dictionary_encode()
        table = np.empty(len(dictionary.dictionary) + 1, np.int64)
        table[-1] = -1
        for i, raw in enumerate(dictionary.dictionary.to_pylist()):
            term = normal_term(raw)
            if term is None:
                table[i] = -1
            else:
                if term not in known:
                    known[term] = len(names)
                    names.append(term)
                table[i] = known[term]
        codes.append(table[dictionary.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)])
        recs.append(batch.column(1).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        calls.append(batch.column(2).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        waiting += batch.num_rows
        if waiting >= FLUSH_ROWS:
            yield from flush()
    yield from flush()


NULL_ID = -(2**63)
_COUNTS = pa.schema([("term", pa.string()), ("kind", pa.int8()), ("n_rows", pa.int64()), ("n_ids", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union the sorted, adjacent containers of one (term, kind, high bits)."""
    key, blobs, n_rows, out = None, [], 0, []

    def close() -> None:
        if key is not None:
            out.append((key[0], key[1], n_rows, cardinality(union(blobs))))

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), _COUNTS.types)], schema=_COUNTS)

    for batch in batches:
        for term, kind, high, n, blob in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (term, kind, high) != key:
                close()
                key, blobs, n_rows = (term, kind, high), [], 0
            blobs.append(blob)
            n_rows += n
            if len(blobs) > 64:
                blobs = [union(blobs)]
        if len(out) > 20_000:
            yield batch_of(out)
            out.clear()
    close()
    if out:
        yield batch_of(out)


def term_frequency(occurrences: DataFrame, term: str = "term", record: str = "rec_id", document: str = "call_id", rare_below: int = 3, common_share: float = 0.1) -> DataFrame:
    """``term, n_occ, n_calls, n_rows, mark`` of every distinct normalised term.

    ``n_occ`` counts distinct records, ``n_calls`` distinct documents,
    ``n_rows`` rows as delivered. ``rare``: in fewer than ``rare_below``
    documents; ``common``: in more than ``common_share`` of all documents of
    the table (also of those whose terms are all null); else ``useful``. A term
    that is both is ``rare``.

    Null and blank terms give no row; null identifiers count nothing, repeated
    rows count once in ``n_occ`` and ``n_calls``; an empty table gives no row.
    Identifiers are integers; further columns are not read.
    """
    rows = occurrences.select(F.col(term).cast("string").alias("term"), F.col(record).cast("bigint").alias("rec"), F.col(document).cast("bigint").alias("call"))
    parts = rows.mapInArrow(_build, "term string, kind tinyint, high bigint, n_rows bigint, members binary")
    merged = parts.repartition("term", "kind", "high").sortWithinPartitions("term", "kind", "high").mapInArrow(_merge, "term string, kind tinyint, n_rows bigint, n_ids bigint")
    pick = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)))
    counts = merged.groupBy("term").agg(
        F.coalesce(pick(REC, "n_ids"), F.lit(0)).alias("n_occ"), F.coalesce(pick(CALL, "n_ids"), F.lit(0)).alias("n_calls"), F.coalesce(pick(REC, "n_rows"), F.lit(0)).alias("n_rows"), pick(ALL_CALLS, "n_ids").alias("n_all")
    )
    counts = cut(counts)  # one row a term: the containers are merged once for the terms and for the total
    # the row of the null term holds the number of all documents: one row by construction
    total = counts.where("term is null").select(F.col("n_all").alias("total"))
    counts = counts.where("term is not null").drop("n_all").crossJoin(F.broadcast(total))
    mark = F.when(F.col("n_calls") < rare_below, "rare").when(F.col("n_calls") > F.col("total") * common_share, "common").otherwise("useful")
    return counts.select("term", "n_occ", "n_calls", "n_rows", mark.alias("mark"))
