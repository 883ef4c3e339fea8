"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item is short and a document may be long, so that their resemblance says
nothing. Items are partitioned by the size of their shingle sets, with upper
bounds of powers of two. For a bound u, documents are seen as overlapping
windows of 2u shingles, one every u, so that each run of u shingles lies in a
window. An item of that partition that is contained to 0.8 in such a window has
a resemblance of 0.19 or more with it, and one of ``HASHES`` min-hashes in
common with probability 1 - 0.81 ** HASHES > 0.9999. Windows of all bounds
share one pass: minima over blocks of the smallest bound are merged upwards.
Items of up to ``SMALL`` shingles, for which the smallest bound is too wide, are
looked up by each of their shingles instead. Candidates are verified by the
exact share of the item's shingles that the whole document has. An item of
fewer words than a shingle is its whole sequence, and found where that stands.

Items are the stated query set: blocks of ``BLOCK_ITEMS`` are written to the
shared folder by tasks, and each worker goes through them, one at a time, for
each slice of its documents. So documents are read once, and nothing is shuffled.

Nulls: null and empty texts and items contain nothing and are contained in
nothing. Repeated rows and items are reported each. A very long text is held
whole. An empty table of documents gives no rows; with an empty benchmark
nothing is found. Other columns are ignored by ``search`` and kept by ``clean``.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, WordHasher, column, filesystem, mix, put, shared_dir, shingles, slices

HASHES = 48
LEAST_BOUND = 16
#: Shingles of an item up to which each of them is looked up.
SMALL = 8
#: Items of a block: at most 20,000, or as many as have a million words.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 1_000_000
#: Bytes of text that a worker holds against a block of items: the more blocks, the more.
SLICE, MOST_SLICE = 2 << 20, 16 << 20

_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Items:
    """A block of items: ids, sets of shingles, and by bound their min-hashes."""

    ids: list
    sets: list[np.ndarray]
    #: bound -> (min-hashes sorted, their items) for each hash function
    tables: dict[int, list[tuple[np.ndarray, np.ndarray]]]
    #: shingles of small items, sorted, and their items
    small: tuple[np.ndarray, np.ndarray]
    #: number of words -> (hashes of whole items of so many, sorted, and the items)
    whole: dict[int, tuple[np.ndarray, np.ndarray]]


def _table(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    values, members = np.array([v for v, _ in pairs], np.uint64), np.array([m for _, m in pairs], np.int64)
    order = np.argsort(values, kind="stable")
    return values[order], members[order]


def block(rows: list[tuple]) -> Items:
    """Signatures of (id, text) rows."""
    import pyarrow as pa

    hashes, offsets, _, _ = WordHasher().words(pa.array([t for _, t in rows], pa.string()))
    found, at = shingles(hashes, offsets, whole=False)
    sets = [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    bounds: dict[int, list[int]] = {}
    short: dict[int, list[tuple[int, int]]] = {}
    small: list[tuple[int, int]] = []
    for i, s in enumerate(sets):
        n = int(offsets[i + 1] - offsets[i])
        if len(s) > SMALL:
            bounds.setdefault(max(LEAST_BOUND, 1 << (len(s) - 1).bit_length()), []).append(i)
        elif len(s):
            small += [(v, i) for v in s.tolist()]
        elif n:
            short.setdefault(n, []).append((int(shingles(hashes[offsets[i] : offsets[i + 1]], np.array([0, n]), n)[0][0]), i))
    tables = {}
    for bound, members in bounds.items():
        signature = np.array([[_hashed(sets[i], k).min() for k in range(HASHES)] for i in members], np.uint64)
        order = np.argsort(signature, axis=0, kind="stable")
        tables[bound] = [(signature[order[:, k], k], np.array(members)[order[:, k]]) for k in range(HASHES)]
    return Items([i for i, _ in rows], sets, tables, _table(small), {n: _table(pairs) for n, pairs in short.items()})


def _looked_up(found: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> set[tuple[int, int]]:
    """(text, item) pairs with a hash in common."""
    values, members = table
    if not len(values) or not len(found):
        return set()
    known = np.flatnonzero(values[np.minimum(np.searchsorted(values, found), len(values) - 1)] == found)
    text = np.searchsorted(at, known, "right") - 1
    lo, hi = np.searchsorted(values, found[known], "left"), np.searchsorted(values, found[known], "right")
    return {(int(t), int(m)) for t, a, b in zip(text, lo, hi, strict=True) for m in members[a:b]}


def _hashed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ _SEEDS[k]) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def candidates(found: np.ndarray, at: np.ndarray, items: Items) -> set[tuple[int, int]]:
    """(text, item) pairs with a window and an item that share a min-hash, or a small item's shingle."""
    counts = np.diff(at)
    n_blocks = -(-counts // LEAST_BOUND)
    first = np.concatenate(([0], np.cumsum(n_blocks)))
    if not first[-1]:
        return set()
    owner = np.repeat(np.arange(len(counts)), n_blocks)
    edges = at[owner] + (np.arange(first[-1]) - first[owner]) * LEAST_BOUND
    pairs = _looked_up(found, at, items.small)
    if not items.tables:
        return pairs
    top = max(items.tables)
    for k in range(HASHES):
        minima, owners, bound = np.minimum.reduceat(_hashed(found, k), edges), owner, LEAST_BOUND
        while True:
            if bound in items.tables:
                windows = minima.copy()
                same = owners[1:] == owners[:-1]
                windows[:-1][same] = np.minimum(minima[:-1], minima[1:])[same]
                values, members = items.tables[bound][k]
                lo, hi = np.searchsorted(values, windows, "left"), np.searchsorted(values, windows, "right")
                for j in np.flatnonzero(hi > lo):
                    pairs.update((int(owners[j]), int(m)) for m in members[lo[j] : hi[j]])
            if bound >= top:
                break
            # blocks of twice the size: the pairs of a text's blocks, from its first on
            place = np.arange(len(owners)) - np.searchsorted(owners, owners, "left")
            heads = np.flatnonzero(place % 2 == 0)
            minima, owners, bound = np.minimum.reduceat(minima, heads), owners[heads], bound * 2
    return pairs


def matches(texts, items: Items, least: float = SIMILARITY, hasher: WordHasher | None = None) -> list[tuple[int, int, float]]:
    """(text, item, containment) of an Arrow string column against a block, ``least`` or more."""
    hashes, offsets, _, _ = (hasher or WordHasher()).words(texts)
    found, at = shingles(hashes, offsets, whole=False)
    out, last, own = [], -1, None
    for n, table in items.whole.items():
        out += [(t, i, 1.0) for t, i in _looked_up(*shingles(hashes, offsets, n, whole=False), table)]
    for text, item in sorted(candidates(found, at, items)):
        if text != last:
            own, last = np.unique(found[at[text] : at[text + 1]]), text
        wanted = items.sets[item]
        place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        share = float((own[place] == wanted).mean())
        if share >= least:
            out.append((text, item, share))
    return out


def blocks(benchmark: DataFrame) -> list[str]:
    """Writes the benchmark in blocks that fit a worker, and returns their files."""
    spark, words, items = benchmark.sparkSession, BLOCK_WORDS, BLOCK_ITEMS
    folder = shared_dir(spark)
    rows = benchmark.select(F.col("item_id").cast("long"), "text")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))).first()
    parts = max(1, -(-n // items), -(-size // words))

    def run(batches) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []
        size, names = 0, []

        def flush():
            name = f"items-{uuid.uuid4().hex}"
            put(folder, name, np.frombuffer(pickle.dumps(block(held)), np.uint8))
            names.append(name)
            held.clear()

        for batch in slices(batches, "text"):
            for row in zip(column(batch, "item_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                held.append(row)
                size += len((row[1] or "").split())
                if len(held) >= items or size >= words:
                    flush()
                    size = 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    written = rows.repartition(parts, F.xxhash64("item_id", "text")).mapInArrow(run, "name string")
    return [f"{folder}/{r.name}" for r in written.collect()]  # a name for each block


def _opened(files: list[str]):
    """Gives the blocks in turn; a single one is kept."""
    kept: list[Items] = []

    def turn() -> Iterator[Items]:
        if kept:
            yield from kept
            return
        for path in files:
            system, base = filesystem(path)
            with system.open_input_stream(base) as f:
                items = pickle.loads(f.read())
            if len(files) == 1:
                kept.append(items)
            yield items

    return turn


def search(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``item_id`` and ``containment`` of every item found in a document."""
    files = blocks(benchmark)

    def run(batches) -> Iterator:
        import pyarrow as pa

        hasher, turn = WordHasher(), _opened(files)
        for batch in slices(batches, "text", min(SLICE * max(1, len(files)), MOST_SLICE)):
            ids = column(batch, "doc_id").to_pylist()
            for items in turn():
                found = matches(column(batch, "text"), items, least, hasher)
                if found:
                    rows = [(ids[t], items.ids[i], s) for t, i, s in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "containment"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, containment double")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that contain an item."""
    files = blocks(benchmark)

    def run(batches) -> Iterator:
        import pyarrow as pa

        hasher, turn = WordHasher(), _opened(files)
        for batch in slices(batches, "text", min(SLICE * max(1, len(files)), MOST_SLICE)):
            keep = np.ones(batch.num_rows, bool)
            for items in turn():
                keep[[t for t, _, _ in matches(column(batch, "text"), items, least, hasher)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
