"""N-gram Jaccard join by T-occurrence search.

Two texts link if their sets of shingles have a Jaccard similarity of
``SIMILARITY`` or more. Texts with the same set are one node, so copies are
joined once. For a node of n shingles, T is the least overlap that a link
needs. In the order from rare to frequent shingles, the L = T - K longest of
its inverted lists are skipped: a partner must occur ``OCCURRENCES`` = K times
in the short lists that are left, so only these are built. They are merged by
sorting, and only candidates that occur often enough are probed for the rest by
binary search, which counts the overlap exactly (DivideSkip). The order needs no
exact frequencies: shingles that are frequent within some part of the input are
counted, and the most frequent ``MAX_HOT`` come last.

Lists of up to ``SMALL_LIST`` nodes are expanded into pairs with how often they
met. A pair that also meets in a longer list is looked for there, so a pair has
met in full if it has only met in small lists. Nodes that share too few of their
lists for any link are left out.

Longer lists, as of a large group of near copies, aren't expanded. Nodes are
held against hubs first: against two candidates of small lists, then in rounds
against the node that is in most of their long lists. What links then is one
component. Long lists with the same hub are a group; its nodes outside of its
largest component are the queries of one more DivideSkip search over the whole
sets of all its nodes, in blocks of ``BLOCK`` shingles, which returns no pairs
but a forest of links that join components. So no link that joins components is
lost, and pairs within a component are not looked at. Sketches of parities, a
bound that holds for every pair, leave out queries that can't link with another
component: most texts of a group of edited copies are too far from all others.

Short lists travel as packed arrays by ranges of the shingle's hash; the number
of ranges follows the session's shuffle partitions. Very frequent shingles are
dealt by node instead, so that no task holds a hot list. Sets of candidates,
found through a bitmap of fixed size, are written once to files in the shared
folder, from which searches map them; what moves between tasks are their places.

Nulls: null texts and texts without words have no shingles, link with nothing
and are their own component. A null ``doc_id`` takes part, but is never the
smallest. Repeated rows are reported each. A very long text is one set, held
whole. An empty table gives no rows. Other columns are ignored, and kept by
``first_of_each``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Arrays, Scratch, WordHasher, buckets, column, put, setting, shingles, slices, written
from .graph import components

#: Similarity in percent.
PERCENT = 80
SMALL_LIST = 8
#: How often a partner must occur in the short lists (K); they are longer by K - 1.
OCCURRENCES = 8
#: Rounds in which nodes of long lists are held against hubs.
HUBS = 2
#: Shingles of each side that a task holds against each other.
BLOCK = 500_000
#: Shingles that can come last in the order, and the count from which a part of the input reports one.
MAX_HOT, LOCAL_HOT = 200_000, 4
#: Reported count from which a shingle's list is dealt by node.
SPREAD = 256
FLUSH = 2_000_000
#: Bytes of text in a worker's arrays, and rows of a batch that it is sent.
SLICE, BATCH_ROWS = 2 << 20, "1000"
#: Words of 64 bits of the bitmap of candidates.
BITMAP = 1 << 18
#: Bits of sketches that are made or compared at once.
SKETCHED = 1 << 22
#: The weight of probing against merging in the number of lists that a search in memory skips.
MU = 0.05


def set_of(found: np.ndarray) -> np.ndarray:
    found = np.sort(found)
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def node_of(own: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(own.tobytes())
    return value - (1 << 64) if value >> 63 else value


def needed(n):
    """T, the least overlap of a node of n shingles with any that it links with (array or number)."""
    return -(-n * PERCENT // 100)


def occurrences(n):
    """K of a node: fewer for small sets, whose lists would else be nearly all."""
    low, high = (np.maximum, np.minimum) if isinstance(n, np.ndarray) else (max, min)
    return low(1, high(OCCURRENCES, needed(n) // 8))


def short_lists(n):
    """How many of a node's lists are built: n - T + K."""
    return n - needed(n) + occurrences(n)


def meetings(n_a, n_b):
    """How often a pair that links meets in the short lists of both, at least."""
    overlap = -(-PERCENT * (n_a + n_b) // (100 + PERCENT))
    return np.maximum(np.minimum(occurrences(n_a), occurrences(n_b)), overlap - np.maximum(n_a - short_lists(n_a), n_b - short_lists(n_b)))


def least_meetings(n):
    """How many of its short lists a node must share to link with anything (array or number)."""
    return occurrences(needed(n))


def _sets(batch, hasher) -> Iterator[np.ndarray]:
    hashes, offsets, _, _ = hasher.words(column(batch, "text"))
    found, at = shingles(hashes, offsets)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield set_of(found[a:b])


def nodes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its ``node`` (null without shingles) and ``n``; rows with a ``hot`` shingle and its ``count`` besides."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        hasher, kept, seen, size = WordHasher(), [], set(), 0
        names = ["doc_id", "key", "node", "n", "hot", "count"]
        kinds = [pa.int64()] * 6

        def hot():
            flat = np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
            at = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
            counts = np.diff(np.append(at, len(flat)))
            often = counts >= LOCAL_HOT
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(flat[at][often].view(np.int64)), pa.array(counts[often])], names)

        for batch in slices(batches, "text", SLICE):
            node, n = [], []
            for own in _sets(batch, hasher):
                n.append(len(own))
                node.append(node_of(own) if len(own) else None)
                if len(own) and node[-1] not in seen:
                    seen.add(node[-1])
                    kept.append(own)
                    size += len(own)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "key"), pa.array(node, kinds[2]), pa.array(n, kinds[3]), none, none], names)
            if size > FLUSH:
                yield hot()
                kept, seen, size = [], set(), 0
        yield hot()

    return docs.mapInArrow(run, "doc_id long, key long, node long, n long, hot long, count long")


def hot_shingles(found: DataFrame, save=written, most: int = MAX_HOT) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the shingles reported as frequent, sorted, and their counts."""
    counts = save(found.filter("hot is not null").groupBy("hot").agg(F.sum("count").alias("count")))
    least = 2 * LOCAL_HOT
    while counts.filter(F.col("count") >= least).count() > most:
        least *= 2
    rows = counts.filter(F.col("count") >= least).toPandas()
    hashes, counts_ = rows["hot"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts_[order]


def ordered(own: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's shingles from rare to frequent, by hash among equals."""
    if not len(hot):
        return own
    place = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
    often = np.where(hot[place] == own, counts[place], 0)
    return own[np.argsort(often, kind="stable")] if often.any() else own


def postings(docs: DataFrame, hot: np.ndarray, counts: np.ndarray, parts: int) -> DataFrame:
    """The short inverted lists, packed by part: arrays of shingles and owners, and each owner's node and size.

    ``spread`` are lists of very frequent shingles, whose rows are dealt by node.
    A shingle's low half names it within its part.
    """
    shared = docs.sparkSession.sparkContext.broadcast((hot, counts))

    def run(batches) -> Iterator:
        import pyarrow as pa

        hasher, kept, nodes_, sizes, total = WordHasher(), [], {}, [], 0
        often = shared.value[0][shared.value[1] >= SPREAD]

        def packed(flat, owner, part, names, size, spread):
            order = np.lexsort((flat, part))
            cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[p] : cuts[p + 1]]
                own, back = np.unique(owner[at], return_inverse=True)
                lists = flat[at].tobytes() if spread else (flat[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
                yield int(p), spread, lists, back.astype(np.uint16 if len(own) < 1 << 16 else np.uint32).tobytes(), names[own].tobytes(), size[own].tobytes()

        def flush():
            flat = np.concatenate(kept)
            owner = np.repeat(np.arange(len(kept), dtype=np.uint32), [len(k) for k in kept])
            names, size = np.fromiter(nodes_, np.int64, len(nodes_)), np.array(sizes, np.uint32)
            wide = often[np.minimum(np.searchsorted(often, flat), len(often) - 1)] == flat if len(often) else np.zeros(len(flat), bool)
            rows = []
            for spread in (False, True):
                here = wide == spread
                part = (names[owner[here]].view(np.uint64) if spread else flat[here] >> np.uint64(33)) % np.uint64(parts)
                rows += packed(flat[here], owner[here], part, names, size, spread)
            kinds = [pa.int32(), pa.bool_()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "spread", "shingles", "owners", "nodes", "sizes"])

        for batch in slices(batches, "text", SLICE):
            for own in _sets(batch, hasher):
                if len(own) and (node := node_of(own)) not in nodes_:
                    nodes_[node] = None
                    sizes.append(len(own))
                    kept.append(ordered(own, *shared.value)[: short_lists(len(own))])
                    total += len(kept[-1])
            if total > FLUSH // 3:
                yield flush()
                kept, nodes_, sizes, total = [], {}, [], 0
        if kept:
            yield flush()

    return docs.mapInArrow(run, "part int, spread boolean, shingles binary, owners binary, nodes binary, sizes binary")


def _unpacked(rows, spread: bool):
    """(list, node, size) of the packed rows of a part."""
    kind = np.uint64 if spread else np.uint32
    lists = np.concatenate([np.frombuffer(r[0], kind) for r in rows])
    owners = [np.frombuffer(r[1], np.uint16 if len(r[2]) < 8 << 16 else np.uint32) for r in rows]
    node = np.concatenate([np.frombuffer(r[2], np.int64)[o] for r, o in zip(rows, owners, strict=True)])
    size = np.concatenate([np.frombuffer(r[3], np.uint32)[o] for r, o in zip(rows, owners, strict=True)]).astype(np.int64)
    return lists, node, size


def merged(parts: DataFrame, n_parts: int) -> DataFrame:
    """Merges the short lists.

    Rows are pairs (``a``, ``b``) with how often they met in lists that were
    expanded (``met``) and how often they need to (``need``); the rows of the
    other lists (``list``, ``a``, ``n``); and in how many lists with others a
    node is (``a``, ``n``, ``met``).
    """
    names = ["a", "b", "met", "need", "list", "n"]

    def run(batches) -> Iterator:
        import pyarrow as pa

        def table(*columns):
            size = next(len(c) for c in columns if c is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], names)

        def shares(node, size):
            one, first, count = np.unique(node, return_index=True, return_counts=True)
            return table(one, None, count, None, None, size[first])

        blobs: dict[int, list] = {}
        for batch in batches:
            for part, spread, *row in zip(*(column(batch, c).to_pylist() for c in ("part", "spread", "shingles", "owners", "nodes", "sizes")), strict=True):
                if spread:
                    shingle, node, size = _unpacked([row], True)
                    yield table(node, None, None, None, shingle.view(np.int64), size)
                    yield shares(node, size)
                else:
                    blobs.setdefault(part, []).append(row)
        while blobs:
            part, rows = blobs.popitem()
            shingle, node, size = _unpacked(rows, False)
            order = np.argsort(shingle, kind="stable")
            shingle = shingle[order]
            shared = np.zeros(len(order), bool)
            same = shingle[1:] == shingle[:-1]
            shared[1:] |= same
            shared[:-1] |= same
            order, shingle = order[shared], shingle[shared]
            node, size = node[order], size[order]
            order = np.lexsort((node, shingle))
            shingle, node, size = shingle[order], node[order], size[order]
            fresh = np.ones(len(order), bool)  # a node found in several blobs counts once
            fresh[1:] = (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])
            shingle, node, size = shingle[fresh], node[fresh], size[fresh]
            if not len(node):
                continue
            heads = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
            lengths = np.diff(np.append(heads, len(node)))
            rank = np.arange(len(node)) - np.repeat(heads, lengths)
            length = np.repeat(lengths, lengths)
            if (length > 1).any():
                yield shares(node[length > 1], size[length > 1])
            left, right = [], []
            for gap in range(1, SMALL_LIST):
                i = np.flatnonzero((rank + gap < length) & (length <= SMALL_LIST))
                left.append(i)
                right.append(i + gap)
            long = np.flatnonzero(length > SMALL_LIST)
            first, second = np.concatenate(left), np.concatenate(right)
            good = near_size(size[first], size[second])
            first, second = first[good], second[good]
            order = np.lexsort((node[second], node[first]))
            first, second = first[order], second[order]
            if len(first):
                a, b = node[first], node[second]
                at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                yield table(a[at], b[at], np.diff(np.append(at, len(a))), meetings(size[first], size[second])[at], None, None)
            if len(long):
                yield table(node[long], None, None, None, (np.int64(part) << 32) | shingle[long].astype(np.int64), size[long])

    return parts.repartitionById(n_parts, "part").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def near_size(a, b):
    """Whether sets of these sizes can reach the similarity (arrays or columns)."""
    if isinstance(a, np.ndarray):
        return np.minimum(a, b) * 100 >= PERCENT * np.maximum(a, b)
    return F.least(a, b) * 100 >= PERCENT * F.greatest(a, b)


def bitmap(keys: DataFrame) -> np.ndarray:
    """Which of 64 * ``BITMAP`` hashes of ``key`` there are: a filter of fixed size."""
    bit = F.pmod(F.xxhash64("key"), F.lit(64 * BITMAP))
    rows = keys.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key), {64 * BITMAP}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BITMAP, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def stored(docs: DataFrame, wanted: DataFrame, folder: str, save, arrays=_sets) -> DataFrame:
    """Writes the sets (or what else ``arrays`` makes) of the nodes in ``wanted`` (``node``, ``key``) to files, and returns where each is (``node``, ``file``, ``at``, ``size``)."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def run(batches) -> Iterator:
        import pyarrow as pa

        hasher, kept, found, total = WordHasher(), [], {}, 0

        def flush():
            name = uuid.uuid4().hex[:16]
            put(folder, name, np.concatenate(kept))
            size = np.array([len(k) for k in kept], np.int64)
            columns = [pa.array(list(found), pa.int64()), pa.array([name] * len(size)), pa.array(np.cumsum(size) - size), pa.array(size)]
            return pa.RecordBatch.from_arrays(columns, ["node", "file", "at", "size"])

        for batch in batches:
            bit = column(batch, "bit").to_numpy()
            batch = batch.filter(pa.array((bits.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for part in slices([batch], "text", SLICE):
                for own in arrays(part, hasher):
                    if len(own) and (node := node_of(own)) not in found:
                        found[node] = None
                        kept.append(own)
                        total += len(own)
                if total > FLUSH:
                    yield flush()
                    kept, found, total = [], {}, 0
        if kept:
            yield flush()

    made = docs.withColumn("bit", F.pmod(F.xxhash64("key"), F.lit(64 * BITMAP))).select("text", "bit").mapInArrow(run, "node long, file string, at long, size long")
    return save(save(made).join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("file", "at", "size")).alias("s")).select("node", "s.*"))


def verified(pairs: DataFrame, known: DataFrame, folder: str) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets reach the similarity, by probing one with the other."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        sets = Arrays(folder)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            places = [column(batch, c).to_pylist() for c in ("a_file", "a_at", "a_size", "b_file", "b_at", "b_size")]
            for i in sorted(range(batch.num_rows), key=lambda i: (places[0][i], places[3][i])):
                x, y = (sets(*(c[i] for c in side)) for side in (places[:3], places[3:]))
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = 100 * common >= PERCENT * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda name: known.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("file", "at", "size")))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def hub_pairs(lists: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Each node of a long list with the hub that it meets most often, if that is in another component."""
    degree = lists.groupBy("node").agg(F.count("*").alias("degree"))
    own = _labelled(lists.join(degree, "node"), labels)
    hub = own.groupBy("list").agg(F.max(F.struct("degree", F.xxhash64("node", F.lit(turn)).alias("salt"), "node", "n", "label")).alias("hub"))
    met = own.join(hub, "list").filter((F.col("label") != F.col("hub.label")) & near_size(F.col("n"), F.col("hub.n"))).groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("met"))
    return met.groupBy("node").agg(F.max_by("hub", F.struct("met", "hub")).alias("hub")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def groups(lists: DataFrame) -> DataFrame:
    """(``group``, ``node``, ``n``): the nodes of long lists, grouped by the lists' hub."""
    degree = lists.groupBy("node").agg(F.count("*").alias("degree"))
    own = lists.join(degree, "node")
    hub = own.groupBy("list").agg(F.max(F.struct("degree", "node")).alias("hub")).select("list", F.col("hub.node").alias("group"))
    return own.join(hub, "list").select("group", "node", "n").distinct()


def occurring(index: tuple, query: np.ndarray, least: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """DivideSkip in memory: the owners that hold ``least`` or more of the query's shingles, and how many.

    ``index`` has the distinct shingles, where their lists begin and end, and
    the owners, sorted within a list. The short lists are merged; their
    candidates are looked up in the L longest ones by binary search.
    """
    values, begins, ends, owners, keys = index
    place = np.minimum(np.searchsorted(values, query), len(values) - 1)
    lists = place[values[place] == query]
    if len(lists) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = ends[lists] - begins[lists]
    skip = min(least - 1, int(least / (MU * np.log2(length.max() + 1) + 1)))
    lists, length = (x[np.argsort(length, kind="stable")] for x in (lists, length))
    short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
    size = length[: len(short)]
    at = np.repeat(begins[short] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    met = np.bincount(owners[at], minlength=n_rows)
    found = np.flatnonzero(met >= least - skip)
    probe = long[:, None] * n_rows + found[None, :]
    hit = keys[np.minimum(np.searchsorted(keys, probe), len(keys) - 1)] == probe
    overlap = met[found] + hit.sum(axis=0)
    good = overlap >= least
    return found[good], overlap[good]


def inverted(sets: list[np.ndarray]) -> tuple:
    """The index that ``occurring`` searches."""
    size, flat = [len(s) for s in sets], np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owners, flat = np.repeat(np.arange(len(sets)), size)[order], flat[order]
    begins = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    ends = np.append(begins[1:], len(flat))
    return flat[begins], begins, ends, owners, np.repeat(np.arange(len(begins)), ends - begins) * len(sets) + owners


def sketch_bits(n: int) -> int:
    """Bits of the sketches that a set of n shingles is compared by: a power of two, one to two times n."""
    return max(64, 1 << (n - 1).bit_length())


def near_class(size: np.ndarray, bits: int) -> np.ndarray:
    """Which sizes can be near that of a set compared by so many bits."""
    least = 1 if bits == 64 else bits // 2 + 1
    return (size * 100 >= PERCENT * least) & (PERCENT * size <= 100 * bits)


def sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Per set, the parities of its shingles by their low bits. Two sets differ in as many shingles as their sketches in bits, at least."""
    out = np.zeros((len(sets), bits // 8), np.uint8)
    step = max(1, SKETCHED // bits)
    for i in range(0, len(sets), step):
        some = sets[i : i + step]
        at = np.repeat(np.arange(len(some)) * bits, [len(s) for s in some]) + (np.concatenate(some) & np.uint64(bits - 1)).astype(np.int64)
        out[i : i + step] = np.packbits((np.bincount(at, minlength=len(some) * bits) & 1).astype(np.uint8).reshape(-1, bits), axis=1)
    return out.view(np.uint64)


def within(sketch: np.ndarray, n: int, others: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the sets with sketches ``others`` may link with one of n shingles: no link is left out."""
    most = n + size - 2 * -(-PERCENT * (n + size) // (100 + PERCENT))
    out = np.zeros(len(others), bool)
    step = max(1, SKETCHED // (64 * len(sketch)))
    for i in range(0, len(others), step):
        out[i : i + step] = np.bitwise_count(others[i : i + step] ^ sketch).sum(axis=1, dtype=np.int64) <= most[i : i + step]
    return out


def group_links(members: DataFrame, labels: DataFrame, known: DataFrame, folder: str) -> DataFrame:
    """Links that join the components that meet in a group.

    In a group, the nodes outside of its largest component are the queries,
    held against all of its nodes in blocks. Sketches tell first, by the least
    number of shingles in which two sets differ, whether a query can link with
    anything outside of its component.
    """
    own = _labelled(members, labels)
    sizes = own.groupBy("group", "label").agg(F.sum("n").alias("size"))
    stats = sizes.groupBy("group").agg(F.sum("size").alias("total"), F.max_by("label", F.struct("size", "label")).alias("largest"), F.max("size").alias("most"), F.count("*").alias("labels")).filter("labels > 1")
    count = lambda size: F.ceil(size / BLOCK).cast("int")
    mixed = own.join(stats, "group").join(known, "node").withColumn("asks", F.col("label") != F.col("largest"))
    mixed = mixed.withColumn("right_blocks", count(F.col("total"))).withColumn("left_blocks", count(F.col("total") - F.col("most")))
    of = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    columns = ["group", "node", "label", "file", "at", "size"]
    left = mixed.filter("asks").select(*columns, F.lit(0).alias("side"), of("left_blocks").alias("left_block"), every("right_blocks").alias("right_block"))
    right = mixed.select(*columns, F.lit(1).alias("side"), every("left_blocks").alias("left_block"), of("right_blocks").alias("right_block"))

    def search(frame):
        import pandas as pd

        read, asks, held = Arrays(folder), frame[frame["side"] == 0].sort_values("node"), frame[frame["side"] == 1].sort_values(["file", "at"])
        if not len(asks) or not len(held):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [read(*place) for place in zip(held["file"], held["at"], held["size"], strict=True)]
        size, node, label, root, links = np.array([len(s) for s in sets]), held["node"].to_numpy(), held["label"].to_numpy(), {}, []
        marked: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by number of bits, which sets have so near a size, and their sketches
        open_, kept = [], np.zeros(len(sets), bool)
        for ask, ask_label, *place in zip(*(asks[c] for c in ("node", "label", "file", "at", "size")), strict=True):
            bits = sketch_bits(place[2])
            if bits not in marked:
                some = np.flatnonzero(near_class(size, bits))
                marked[bits] = some, sketches([sets[i] for i in some], bits)
            some, other = marked[bits]
            query = read(*place)
            near = some[within(sketches([query], bits)[0], len(query), other, size[some])]
            near = near[label[near] != ask_label]
            if len(near):
                open_.append((ask, ask_label, query, near))
                kept[near] = True
        if not open_:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        place, sets = np.cumsum(kept) - 1, [s for s, k in zip(sets, kept, strict=True) if k]
        index, size, node, label = inverted(sets), size[kept], node[kept], label[kept]

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = up = root.get(up, up)
                x = up
            return x

        for ask, ask_label, query, near in open_:
            if all(find(label[i]) == find(ask_label) for i in place[near].tolist()):
                continue
            found, common = occurring(index, query, int(needed(len(query))), len(sets))
            for i in found[100 * common >= PERCENT * (len(query) + size[found] - common)].tolist():
                x, y = find(ask_label), find(label[i])
                if x != y:
                    root[x] = y
                    links.append((min(ask, node[i]), max(ask, node[i])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    # a given number of partitions, as few bytes of places stand for much work
    keys, parts = ["group", "left_block", "right_block"], buckets(members.sparkSession)
    return left.unionByName(right).repartition(parts, *keys).groupBy(*keys).applyInPandas(search, "a long, b long")


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): each row's ``doc_id``, ``key``, ``node`` and ``n``, and the ``label`` of each node that is linked."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), Scratch(spark) as scratch:
        return _linked(docs, scratch.written, scratch.folder)


def _linked(docs: DataFrame, save, folder: str) -> tuple[DataFrame, DataFrame]:
    parts = buckets(docs.sparkSession)
    found = save(nodes(docs))
    rows = written(found.filter("hot is null").select("doc_id", "key", "node", "n"))
    merged_ = save(merged(postings(docs.select("text"), *hot_shingles(found, save), parts), parts))
    least = F.greatest(F.lit(1), F.least(F.lit(OCCURRENCES), F.floor(F.ceil(F.ceil(F.col("n") * PERCENT / 100) * PERCENT / 100) / 8)))
    alive = merged_.filter("b is null and list is null").groupBy(F.col("a").alias("node")).agg(F.sum("met").alias("shared"), F.max("n").alias("n")).filter(F.col("shared") >= least).select("node")
    lists = save(merged_.filter("list is not null").select("list", F.col("a").alias("node"), "n").distinct().join(alive, "node", "left_semi"))
    pairs = save(merged_.filter("b is not null").groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("need").alias("need")).filter("met >= need").select("a", "b", "met"))
    best = pairs.groupBy("b").agg(F.min("a").alias("first"), F.max_by("a", F.struct("met", "a")).alias("most"))
    tried = save(best.select(F.explode(F.array("first", "most")).alias("a"), "b").distinct())
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(lists.select("node")).distinct()
    keys = rows.filter("node is not null").groupBy("node").agg(F.min("key").alias("key"))
    known = stored(docs, save(keys.join(ends, "node", "left_semi")), f"{folder}/sets", save)
    sets = f"{folder}/sets"
    links = save(verified(tried, known, sets))
    labels = components(links, save)
    for turn in range(HUBS):
        more = save(hub_pairs(lists, labels, turn).join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            break
        tried, links = tried.unionByName(more), save(links.unionByName(verified(more, known, sets)))
        labels = components(links, save)
    # what is left: pairs in different components
    own = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    apart = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left").filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
    rest = verified(apart.join(tried, ["a", "b"], "left_anti"), known, sets)
    more = save(rest.unionByName(group_links(groups(lists), labels, known, sets)))
    return rows, written(labels if more.isEmpty() else components(links.unionByName(more), save))


def join(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest ``doc_id`` that links lead to."""
    rows, labels = linked(docs)
    least = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    label = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = label.groupBy("label").agg(F.min("least").alias("component_id"))
    known = written(label.join(ids, "label").select("node", "component_id"))
    return rows.join(known, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest ``doc_id``, by text and then by the other columns among equals.

    A row without a ``doc_id`` is kept if its component has no other. Rows
    without words link with nothing, and all stay.
    """
    rows, labels = linked(docs)
    label = _labelled(rows.filter("node is not null"), labels)
    first = label.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first"), F.count("*").alias("rows"))
    gone = written(label.join(first.filter("rows > 1"), "label").filter(~F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key").eqNullSafe(F.col("first"))).select("key").distinct())
    again = written(rows.filter("node is not null").groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key").join(gone, "key", "left_anti"))
    key, name = F.xxhash64(F.col("doc_id").cast("long"), "text"), f"key_{uuid.uuid4().hex}"
    keyed = docs.withColumn(name, key)
    to = lambda keys: keys.withColumnRenamed("key", name)
    once = keyed.join(to(gone.unionByName(again)), name, "left_anti").select(docs.columns)
    if again.isEmpty():
        return once
    order = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))
    repeated = keyed.join(to(again), name, "left_semi").groupBy(name).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), order).alias("row"))
    return once.unionByName(repeated.select("row.*"))
