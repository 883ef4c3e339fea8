"""Language-model scores by interpolated modified Kneser-Ney smoothing.

A bigram model is counted over the training texts. Tokens are 64-bit hashes of
words. Map tasks count the pairs of their input and deal them, packed, by
ranges of the pair's hash; one task per range adds them up and writes its range
of the model: a sorted array of hashes and an array of counts. What it has of
each word as a context (total, pairs found once, twice, oftener) and as a
continuation (distinct contexts, occurrences) is dealt by ranges of the word's
hash and added up likewise. So nothing is gathered in one place, and hot words
are sums before they move. Counts of counts give the discounts.

Scoring workers map the arrays into memory from the shared folder and find
their sorted hashes by binary search, so that a model may exceed a worker's
memory. The shared folder must be mounted on all machines: nothing is copied to
local ones.

The order is two: with an earlier packing, a trigram model shuffled about 1.2 GB
and stored 0.8 GB for 0.5 GB of input, four times it.

Nulls: a null text is an empty one, which has only the end token; a row
without ``doc_id`` is trained on. Repeated rows count each. With an empty
training set every token has probability 1 / (V + 1) = 1. An empty table gives
no rows. A very long text is scored whole; ties don't occur. Other columns are
ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, buckets, column, filesystem, mix, put, setting, shared_dir, slices

BEGIN, END = (mix(np.array([x], np.uint64)) for x in (0x5EED0001, 0x5EED0002))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Pairs that a map task counts before it deals them.
FLUSH = 3_000_000
#: Bytes of packed pairs that leave a worker at once, and of texts that it is sent at once.
BATCH_BYTES, TEXT_BYTES = 2 << 20, "8m"
#: Ranges of words at most; of pairs there are as many as shuffle partitions.
WORD_PARTS = 1024


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * _STEP + word)


def ranged(x: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of 64-bit integers; parts in order hold sorted integers in order."""
    return ((x >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)


def tokens(batch, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end token after each text, and offsets."""
    hashes, offsets, _, _ = hasher.words(column(batch, "text"))
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    out = np.empty(len(hashes) + n, np.uint64)
    last = np.zeros(len(out), bool)
    last[at[1:] - 1] = True
    out[last], out[~last] = END[0], hashes
    return out, at


def contexts(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[at[:-1]] = BEGIN[0]
    return before


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    files, base = filesystem(folder)
    if files.type_name != "local":
        raise RuntimeError("a model is mapped into memory: spark.checkpoint.dir must be a folder that all machines have mounted")
    path = os.path.join(base, name)
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.zeros(0, kind)
    return np.memmap(path, kind, "r")


@dataclass
class Model:
    """Where the arrays are, and the sums that are one for the whole corpus."""

    folder: str
    pair_parts: int
    word_parts: int
    n_tokens: int
    n_words: int
    n_pairs: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_mass: float


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; halves of the counts where counts of counts are missing."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of each of ``values``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], *(np.add.reduceat(v[order], heads) if len(keys) else v for v in values)


def _pairs(parts: int):
    names = ["part", "contexts", "runs", "words", "word_at", "counts"]

    def run(batches) -> Iterator:
        import pyarrow as pa

        hasher, kept, size = WordHasher(), [], 0

        def flush():
            """Packed rows of the parts, a few megabytes at a time."""
            context, word = (np.concatenate([x for x in part if len(x)]) for part in (map(lambda k: contexts(*k), kept), (k[0] for k in kept)))
            kept.clear()
            order = np.argsort(pair(context, word), kind="stable")
            context, word = context[order], word[order]
            heads = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1]))))
            count = np.diff(np.append(heads, len(context)))
            context, word = context[heads], word[heads]
            del order, heads
            cuts = np.searchsorted(ranged(pair(context, word), parts), np.arange(parts + 1, dtype=np.uint64))
            rows, held = [], 0
            for p in np.flatnonzero(np.diff(cuts)):
                here = slice(cuts[p], cuts[p + 1])
                by_context = np.argsort(context[here], kind="stable")
                table, runs = np.unique(context[here], return_counts=True)
                words, at = np.unique(word[here][by_context], return_inverse=True)
                rows.append((int(p), table.tobytes(), _small(runs), words.tobytes(), _small(at), _small(count[here][by_context])))
                held += sum(map(len, rows[-1][1:]))
                if held > BATCH_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32()] + [pa.binary()] * 5, strict=True)], names)

        for batch in slices(batches, "text"):
            words, at = tokens(batch, hasher)
            kept.append((words, at))
            size += len(words)
            if size > FLUSH:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return run


def _added_pairs(folder: str, word_parts: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        packed: dict[int, list] = {}
        for batch in batches:
            for part, *row in zip(*(column(batch, c).to_pylist() for c in batch.schema.names), strict=True):
                packed.setdefault(part, []).append(row)
        while packed:
            part, rows = packed.popitem()
            context = np.concatenate([np.repeat(np.frombuffer(r[0], np.uint64), _read(r[1])) for r in rows])
            word = np.concatenate([np.frombuffer(r[2], np.uint64)[_read(r[3])] for r in rows])
            count = np.concatenate([_read(r[4]) for r in rows]).astype(np.int64)
            del rows
            key = pair(context, word)
            order = np.argsort(key, kind="stable")
            key = key[order]
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.add.reduceat(count[order], heads)
            context, word, key = context[order][heads], word[order][heads], key[heads]
            put(folder, f"pair-{part}", key)
            put(folder, f"count-{part}", np.minimum(count, 255).astype(np.uint8))
            large = np.flatnonzero(count >= 255)
            put(folder, f"large-{part}", np.stack((large, count[large])).astype(np.int64))
            sums = [int((count == k).sum()) for k in (1, 2, 3, 4)] + [len(count)]
            one = np.ones(len(count), np.int64)
            zero = np.zeros(0, np.int64)
            c, total, c1, c2, c3 = _summed(context, count, (count == 1).astype(np.int64), (count == 2).astype(np.int64), (count > 2).astype(np.int64))
            w, distinct, seen = _summed(word, one, count)
            cuts_c = np.searchsorted(ranged(c, word_parts), np.arange(word_parts + 1, dtype=np.uint64))
            cuts_w = np.searchsorted(ranged(w, word_parts), np.arange(word_parts + 1, dtype=np.uint64))
            out: list[tuple] = []
            for p in range(word_parts):
                a, b = slice(cuts_c[p], cuts_c[p + 1]), slice(cuts_w[p], cuts_w[p + 1])
                if a.stop > a.start or b.stop > b.start:
                    out.append((p, c[a].tobytes(), b"".join(_small(x[a]) for x in (total, c1, c2, c3)), w[b].tobytes(), b"".join(_small(x[b]) for x in (distinct, seen)), None))
            out.append((-1, *[zero.tobytes()] * 4, sums))
            kinds = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "contexts", "context_stats", "words", "word_stats", "sums"])

    return run


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes as their largest needs, with that number of bytes first."""
    size = next(s for s in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * s - 1))
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _read(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", (len(raw) - 1) // raw[0], 1)


def _large(raw: bytes, n: int, k: int) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(k):
        size = raw[at]
        out.append(np.frombuffer(raw, f"<u{size}", n, at + 1).astype(np.int64))
        at += 1 + n * size
    return out


#: Columns of the words' arrays: as continuation, and as context.
WORD_STATS = ("distinct", "seen", "total", "once", "twice", "more")


def _added_words(folder: str):
    def run(batches) -> Iterator:
        import pyarrow as pa

        packed: dict[int, list] = {}
        for batch in batches:
            for part, *row in zip(*(column(batch, c).to_pylist() for c in ("part", "contexts", "context_stats", "words", "word_stats")), strict=True):
                packed.setdefault(part, []).append(row)
        out = []
        for part, rows in packed.items():
            keys, stats = [], []
            for contexts_, context_stats, words, word_stats in rows:
                c, w = np.frombuffer(contexts_, np.uint64), np.frombuffer(words, np.uint64)
                keys += [c, w]
                stats.append(np.pad(np.array(_large(context_stats, len(c), 4)).reshape(4, len(c)), ((2, 0), (0, 0))))
                stats.append(np.pad(np.array(_large(word_stats, len(w), 2)).reshape(2, len(w)), ((0, 4), (0, 0))))
            key, *sums = _summed(np.concatenate(keys), *np.concatenate(stats, axis=1))
            put(folder, f"word-{part}", key)
            for name, values in zip(WORD_STATS, sums, strict=True):
                put(folder, f"{name}-{part}", values.astype(np.uint32 if not len(values) or values.max() < 1 << 32 else np.uint64))
                put(folder, f"{name}-{part}.kind", np.array([4 if not len(values) or values.max() < 1 << 32 else 8], np.uint8))
            distinct, seen = sums[0], sums[1]
            out.append([*(int((distinct == k).sum()) for k in (1, 2, 3, 4)), int((distinct > 0).sum()), int(distinct.sum()), int(seen.sum())])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["sums"])

    return run


def train(texts: DataFrame) -> Model:
    """Counts the model of ``text``."""
    with setting(texts.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES):
        return _train(texts)


def _train(texts: DataFrame) -> Model:
    spark = texts.sparkSession
    folder, parts = shared_dir(spark), buckets(spark)
    word_parts = min(parts, WORD_PARTS)
    dealt = texts.select("text").mapInArrow(_pairs(parts), "part int, contexts binary, runs binary, words binary, word_at binary, counts binary")
    schema = "part int, contexts binary, context_stats binary, words binary, word_stats binary, sums array<long>"
    first = dealt.repartitionById(parts, "part").mapInArrow(_added_pairs(folder, word_parts), schema)
    stats = f"{folder}/stats"
    first.write.parquet(stats)
    stats = spark.read.schema(schema).parquet(stats)
    pair_sums = np.array([r.sums for r in stats.filter("part = -1").select("sums").collect()], np.int64).reshape(-1, 5).sum(axis=0).tolist()  # a row for each part
    added = stats.filter("part >= 0").drop("sums").repartitionById(word_parts, "part").mapInArrow(_added_words(folder), "sums array<long>")
    n1, n2, n3, n4, words, total, seen = np.array([r.sums for r in added.collect()], np.int64).reshape(-1, 7).sum(axis=0).tolist()
    d = discounts(n1, n2, n3, n4)
    mass = (d[0] * n1 + d[1] * n2 + d[2] * (words - n1 - n2)) / total if total else 1.0
    return Model(folder, parts, word_parts, seen, words, pair_sums[4], discounts(*pair_sums[:4]), d, mass / (words + 1))


class Scorer:
    """A worker's view of a model's arrays."""

    def __init__(self, model: Model):
        self.model, self.folder, self.open = model, model.folder, {}
        # the sum of distinct contexts over all words is the number of pairs
        self.total = max(model.n_pairs, 1)

    def _array(self, name: str, kind: str) -> np.ndarray:
        if name not in self.open:
            self.open[name] = mapped(self.folder, name, kind)
        return self.open[name]

    def _word_stat(self, name: str, part: int) -> np.ndarray:
        kind = self._array(f"{name}-{part}.kind", "u1")
        return self._array(f"{name}-{part}", f"<u{kind[0] if len(kind) else 4}")

    def _find(self, sorted_keys: np.ndarray, parts: int, name: str):
        """(part, slice of the keys, places, found) for each part that has keys."""
        cuts = np.searchsorted(ranged(sorted_keys, parts), np.arange(parts + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            here, own = slice(cuts[p], cuts[p + 1]), self._array(f"{name}-{p}", "<u8")
            if len(own):
                place = np.minimum(np.searchsorted(own, sorted_keys[here]), len(own) - 1)
                yield p, here, place, own[place] == sorted_keys[here]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        unique, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(unique), np.int64)
        for p, here, place, found in self._find(unique, self.model.pair_parts, "pair"):
            got = self._array(f"count-{p}", "u1")[place].astype(np.int64)
            large = self._array(f"large-{p}", "<i8").reshape(2, -1)
            full = np.flatnonzero((got == 255) & found)
            if len(full):
                got[full] = large[1][np.searchsorted(large[0], place[full])]
            out[here] = np.where(found, got, 0)
        return out[back]

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(statistics, position of each key in them)."""
        unique, back = np.unique(keys, return_inverse=True)
        out = np.zeros((len(WORD_STATS), len(unique)), np.int64)
        for p, here, place, found in self._find(unique, self.model.word_parts, "word"):
            for i, name in enumerate(WORD_STATS):
                out[i, here] = np.where(found, self._word_stat(name, p)[place], 0)
        return out, back

    def __call__(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, log10 of the base probability, whether it is known) of each token."""
        m = self.model
        before = contexts(words, at)
        n = len(words)
        stats, back = self.words(np.concatenate((words, before)))
        distinct, seen, total, once, twice, more = stats
        w, c = back[:n], back[n:]
        cut = np.array([0.0, *m.word_discounts])
        unigram = np.maximum(distinct - cut[np.minimum(distinct, 3)], 0) / self.total + m.word_mass
        cut = np.array([0.0, *m.discounts])
        rest = np.where(total > 0, (cut[1] * once + cut[2] * twice + cut[3] * more) / np.maximum(total, 1), 1.0)
        count = self.counts(pair(before, words))
        prob = np.maximum(count - cut[np.minimum(count, 3)], 0) / np.maximum(total[c], 1) + rest[c] * unigram[w]
        return np.log10(prob), np.log10((seen[w] + 1) / (m.n_tokens + m.n_words + 1)), seen[w] > 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, counts, the base score and the model's, and ``perplexity``."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        hasher, scorer = WordHasher(), Scorer(model)
        for batch in slices(batches, "text"):
            words, at = tokens(batch, hasher)
            log, base, known = scorer(words, at)
            sums = [np.add.reduceat(x, at[:-1]) for x in (known.astype(np.int64), base, log)]
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), model.n_tokens)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10.0 ** np.minimum(-sums[2] / n, 300))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def train_and_score(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out, and scores all."""
    return score(docs, train(docs.filter(~held_out(F.col("doc_id")))))
