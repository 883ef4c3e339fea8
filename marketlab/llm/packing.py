"""Packing token pieces into sequences by minimum bin slack.

Texts are cut every ``capacity`` ids, so that only their rests have to be
combined. A rest is below ``capacity`` long, so a histogram of at most
``capacity`` counts describes all of them, whatever their number. On that
histogram, a bitset subset-sum program looks for the multiset of remaining
lengths that fills a window closest to its capacity around the longest rest
left; the multiset is used as often as the counts allow, which uses up at
least one length. So the plan has a few thousand rows at most. Pieces take
their places in it by their rank among the pieces of their length; ranks are
counted in parts, because many pieces may have one length.

Nulls: a null text is an empty one (a single piece with the end id); a null
``doc_id`` is kept. Repeated rows give pieces of their own. An empty table
gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHasher, buckets, column, slices, string_buffers, written

CAPACITY = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary(name: str = VOCABULARY) -> str:
    """Where the public tokenizer files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _rank_encoder(tokenizer):
    """A faster encoder of ordinary text with the same ids, where the file's merges stand in the order of their ids; else None."""
    import json

    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level files
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    vocab = model["vocab"]
    merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])) or min(merged) < 256:
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if i <= merged[-1] and all(c in letters for c in t)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts by a byte-level BPE file.

    Its pattern never joins a space or line end to what stands before it. So
    in texts whose words are separated by one of these each, a word with the
    separator before it can be encoded alone, and once for all its occurrences
    in a slice: the distinct words are encoded as one text, and its ids are
    split by the bytes that they stand for. Other texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = _rank_encoder(self.tokenizer)
        if self.ranks is not None:
            self.sizes = np.array([len(self.ranks.decode_single_token_bytes(i)) if i < self.ranks.n_vocab else 0 for i in range(self.ranks.n_vocab)], np.int64)
        self.hasher = WordHasher(lower=False)
        #: UTF-8 of white space beyond ASCII, separators of ASCII and special tokens.
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile(b"|".join([rb"\xc2[\x85\xa0]", rb"\xe1\x9a\x80", rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", rb"\xe2\x81\x9f", rb"\xe3\x80\x80", rb"[\x1c-\x1f]", *(re.escape(s.encode()) for s in special)]))

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _distinct(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words that each follow a separator, or begin their text (``first``)."""
        sizes = hi - lo + 1
        begin = np.cumsum(sizes) - sizes
        place = np.repeat(lo - 1 - begin, sizes) + np.arange(sizes.sum())
        joined = data[np.maximum(place, 0)]
        joined[begin[first]] = 10  # a line end, whose id is dropped below
        ids = np.asarray(self.ranks.encode_to_numpy(joined.tobytes().decode(), disallowed_special=()), np.uint32)
        at = np.cumsum(self.sizes[ids]) - self.sizes[ids]
        cut = np.searchsorted(at, begin)
        counts = np.diff(np.append(cut, len(ids)))
        counts[first] -= 1
        return np.delete(ids, cut[first]), counts

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of an Arrow string column."""
        data, at = string_buffers(texts)
        hashes, offsets, starts, ends = self.hasher.words(texts)
        n, some = len(at) - 1, np.diff(offsets) > 0
        owner = np.repeat(np.arange(n), np.diff(offsets))
        lo, hi = at[owner] + starts, at[owner] + ends
        first, before = starts == 0, np.zeros(len(lo), np.uint8)
        before[~first] = data[lo[~first] - 1]
        # the separator before each word is one space or line end, and none is left at the text's end
        gap = np.empty(len(lo), np.int64)
        gap[1:] = lo[1:] - hi[:-1]
        heads = offsets[:-1][some]
        gap[heads] = starts[heads]
        fine = np.where(first, gap == 0, (gap == 1) & ((before == 32) | (before == 10)))
        simple = (np.bincount(owner[~fine], minlength=n) == 0) & (self.ranks is not None)
        tails = np.zeros(n, np.int64)
        tails[some] = ends[offsets[1:][some] - 1]
        simple &= tails == np.diff(at)
        raw = data.tobytes()
        for m in self.odd.finditer(raw):
            simple[np.searchsorted(at, m.start(), "right") - 1] = False

        use = simple[owner]
        keys = (hashes ^ (before.astype(np.uint64) << np.uint64(50)))[use]
        ids, lengths = np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if len(keys):
            _, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
            flat, sizes = self._distinct(data, lo[use][index], hi[use][index], first[use][index])
            counts = sizes[inverse]
            shift = np.repeat((np.cumsum(sizes) - sizes)[inverse] - (np.cumsum(counts) - counts), counts)
            shift += np.arange(len(shift))
            ids = flat[shift]
            lengths = np.bincount(owner[use], weights=counts, minlength=n).astype(np.int64)
        if simple.all():
            return ids, np.concatenate(([0], np.cumsum(lengths)))
        parts, done = [], 0
        for i in range(n):
            if simple[i]:
                parts.append(ids[done : done + lengths[i]])
                done += lengths[i]
            else:
                parts.append(self._whole(raw[at[i] : at[i + 1]]))
                lengths[i] = len(parts[-1])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(lengths)))


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most ``capacity`` ids, with the CRC of its ids."""
    schema = PIECES

    def cut(batches) -> Iterator:
        import pyarrow as pa

        encoder, end = Encoder(vocabulary_path), np.array([end_id], np.uint32).tobytes()
        for batch in slices(batches, "text"):
            ids, at = encoder(column(batch, "text"))
            rows: list[tuple] = []
            for doc, a, b in zip(column(batch, "doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                raw, total = ids[a:b].tobytes() + end, b - a + 1
                for start in range(0, total, capacity):
                    part = raw[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of remaining lengths, with the longest, that fills a window closest to ``capacity``."""
    longest = max(counts)
    room, steps = capacity - longest, []
    reach, mask = 1, (1 << (capacity - longest + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length] - (length == longest), room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            copies *= 2
        if reach >> room & 1:
            break
    used, at = {longest: 1}, reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, first_sequence, offset) that place every piece."""
    counts, rank, sequence, rows = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), 0, []
    while counts:
        used = fill(counts, capacity)
        times, offset = min(counts[k] // v for k, v in used.items()), 0
        for length in sorted(used, reverse=True):
            for _ in range(used[length]):
                rows.append((length, rank[length], rank[length] + times, sequence, offset))
                rank[length] += times
                offset += length
            counts[length] -= times * used[length]
            if not counts[length]:
                del counts[length]
        sequence += times
    return rows


def pack(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All of ``docs`` (``doc_id``, ``text``) as pieces with ``sequence_id`` and ``offset``.

    The other columns of ``docs`` are ignored. Sequences have no gaps and hold
    at most ``capacity`` ids.
    """
    spark: SparkSession = docs.sparkSession
    cut = written(pieces(docs, vocabulary_path or vocabulary(), capacity, end_id))
    parts = buckets(spark)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("size"))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("size").alias("n")).collect()}  # `capacity` rows at most
    layout = spark.createDataFrame(plan(counts, capacity), "at long, from_rank long, to_rank long, first_sequence long, offset long")
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("length", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    own = W.partitionBy("length", "part").orderBy("doc_id", "start")
    ranked = dealt.withColumn("own", F.row_number().over(own)).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own") - 1)
    placed = ranked.join(F.broadcast(layout), (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")
