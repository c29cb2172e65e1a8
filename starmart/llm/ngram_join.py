"""Jaccard join of documents on word n-grams, exact, as classes of linked documents.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
distinct n-grams. The steps:

1. Equal sets become one class (hash aggregation), so copies cost one row each.
2. Size-banded keys find which classes may link. Linked sets differ in at most k
   n-grams, k following from their size band. Cut the hash space into more than k / 2
   parts: some part then differs in one n-gram at most, and of its thirds two hold the same in
   both. A key is the band, two thirds of a part and the hash of what they hold. Sharing a passage is not
   enough to share a key, sharing nearly all n-grams is.
3. Classes that meet under a key, or are so connected, form a cluster. A key gives one link to its
   lowest class per class, first in each task and then over all, never all pairs. Each size
   band has clusters of its own, for links whose smaller set is of the band, so
   chance meetings do not chain from band to band.
4. Classes that share a passage meet under keys too, so such a cluster grows with the corpus. Bit counts of
   hashed bitmaps, of about a bit per n-gram, bound the overlap of two classes from above. Only the bitmaps are moved to
   find the pairs of a cluster that the bound lets through; classes connected by these are what is left of it.
5. What is left is cut into tiles of one size band. Each pair of tiles that may hold
   a link of the cluster's band is one unit of work: pairs above the same bound are intersected as sorted arrays.
   Each pair of classes that links is met in one
   unit, so link counts add up; where only components are asked for, pairs already connected are passed by.
   Only texts of classes that are left are moved, as far as a bitmap of fixed size tells them from others.
6. Components of the links, over classes.

Nulls and texts without words have the empty set and link with nothing, each row
being its own component. Rows may repeat, also their ids: a component is named by the
smallest id in it. A null id takes part as no document and keeps a null component
unless its set links it to others; a class that only holds null ids is compared with no other
class. Texts of any length are one set. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmart.llm.components import components
from starmart.llm.store import keep, partitions, prepare
from starmart.llm.tiling import MAP_BITS, seed_map
from starmart.llm.words import mix, shingles, words

_U = np.uint64

#: Keys that a task gathers before it sends them on, and that one bucket should hold.
GATHER = 1 << 21
BUCKET = 1 << 20
#: A tile's documents and n-grams at most.
TILE_ROWS = 2048
TILE_GRAMS = 1 << 21
#: The same where only bitmaps are compared.
BITMAP_ROWS = 1 << 14
BITMAP_GRAMS = 1 << 25
#: N-grams that are intersected with one set at a time.
OVERLAP = 1 << 20


def bands(percent: int) -> np.ndarray:
    """Lowest size of each band; sizes that can link are in one band or in neighbours."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low, np.int64)


def differences(percent: int, low: np.ndarray, band: int) -> int:
    """Most n-grams in which two linked sets differ, if the smaller is of the band."""
    most = int(low[band + 1]) - 1
    return (100 - percent) * (most + most * 100 // percent) // (100 + percent)


def parts_of(k: int) -> int:
    """Parts for k differences: some to spare for those with empty thirds."""
    return k // 2 + 2 + k // 20


def keys_of(
    grams: np.ndarray, percent: int, low: np.ndarray
) -> list[tuple[int, np.ndarray]]:
    """Keys of one set, given as sorted distinct hashes, by the band of the smaller set.

    Linked sets share a key of that band.
    """
    own = int(np.searchsorted(low, len(grams), "right")) - 1
    sums = np.zeros(len(grams) + 1, _U)
    np.cumsum(mix(grams), out=sums[1:])
    out = []
    for band in sorted({own, max(own - 1, 0)}):
        k = differences(percent, low, band)
        if k == 0:
            continue
        n = parts_of(k)
        step = _U((1 << 64) // (3 * n))
        ends = np.append(np.searchsorted(grams, np.arange(1, 3 * n, dtype=_U) * step), len(grams))
        begins = np.append(0, ends[:-1])
        held = (sums[ends] - sums[begins]).reshape(n, 3)
        full = (ends > begins).reshape(n, 3)
        # Thirds 0 and 1, 1 and 2, 2 and 0 of each part.
        both = held + np.roll(held, -1, 1)
        some = full | np.roll(full, -1, 1)
        place = np.arange(3 * n, dtype=_U).reshape(n, 3)
        keys = mix(both + mix(place + _U(1 + band * (1 << 40))))
        if some.all(1).sum() > k // 2:
            # One of these parts differs in one n-gram at most, so a key that is equal
            # and not empty exists.
            keys = keys[some]
        out.append((band, keys.ravel()))
    return out


def node_of(a: int, band: int) -> int:
    """The node that stands for a class among the clusters of a band; ``_node`` is its like in Spark.

    A number of 40 bits. Classes that share one by chance are in one cluster, which costs
    comparisons but changes no result.
    """
    return ((a ^ (band << 40)) & ((1 << 64) - 1)) >> 24


def _node(band: Column) -> Column:
    return F.shiftrightunsigned(F.col("a").bitwiseXOR(F.shiftleft(band.cast("long"), 40)), 24)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers of 40 bits as five bytes each, lowest bytes first, so that the high bytes of sorted ones compress."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(5, -1).T
    return out.view("<u8").ravel().astype(_U)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    grams, first = shingles(words(batch.column("text")), n)
    for i in range(len(first) - 1):
        yield np.unique(grams[first[i] : first[i + 1]])


def _digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    mixed = mix(grams)
    sums = np.stack([mixed, mixed * mix(mixed)]).sum(1, dtype=_U)
    a, b = mix(sums).view(np.int64)
    return int(a), int(b)


def bits_of(low: np.ndarray, band: int) -> int:
    """Bits of the bitmaps that sets of a band are compared by; no fewer in a higher band."""
    return min(max(256, 1 << (int(low[band + 1]) - 1).bit_length()), 1 << 16)


def bitmap(grams: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``bits`` hash ranges hold an odd number of n-grams. Two sets differ in no fewer n-grams than bits."""
    odd = np.bincount((grams >> _U(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(data: bytes, bits: int) -> np.ndarray:
    """A bitmap of as many bits or more, as one of ``bits``."""
    out = np.frombuffer(data, np.uint8)
    while 8 * len(out) > bits:
        out = np.packbits(np.bitwise_xor.reduce(np.unpackbits(out).reshape(-1, 2), 1))
    return out


def _describe(n: int, percent: int):
    low = bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, maps = [], []
            for s in _sets(batch, n):
                band = int(np.searchsorted(low, len(s), "right")) - 1
                rows.append((len(s), *(_digest(s) if len(s) else (0, 0)), band))
                maps.append(bitmap(s, bits_of(low, band)).tobytes() if len(s) else None)
            size, a, b, band = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *map(pa.array, (size, a, b, band.astype(np.int32))), pa.array(maps, pa.binary())],
                names=["id", "n", "a", "b", "band", "bits"],
            )

    return run


def _stars(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their lowest owner, and links of the other owners to it."""
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    new = np.append(True, keys[1:] != keys[:-1])
    lowest = owner[np.flatnonzero(new)][np.cumsum(new) - 1] if len(keys) else owner
    other = owner != lowest
    links = np.unique(np.stack([owner[other], lowest[other]], 1), axis=0)
    return keys[new], owner[new], links


def _send(n: int, percent: int, buckets: int):
    low = bands(percent)

    def flush(keys: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, owner, links = _stars(np.concatenate(keys), np.concatenate(owners))
        # The high bits name the bucket, 40 others tell keys of a bucket apart; a chance
        # meeting of keys only adds a comparison.
        bucket = (key >> _U(40)) % _U(buckets)
        key = key & _U((1 << 40) - 1)
        order = np.lexsort((key, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=_U))
        key, owner = key[order], owner[order]
        # Links found here ride along; they only have to be spread.
        link_cuts = np.linspace(0, len(links), buckets + 1).astype(int)
        rows = [
            (b, pack(key[i:j]), pack(owner[i:j]), pack(links[s:t].ravel()))
            for b, (i, j, s, t) in enumerate(zip(cuts, cuts[1:], link_cuts, link_cuts[1:]))
            if j > i or t > s
        ]
        for at in range(0, len(rows), 4096):
            columns = list(zip(*rows[at : at + 4096]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                names=["bucket", "keys", "owners", "links"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0
        for batch in batches:
            for grams in _sets(batch, n):
                if not len(grams):
                    continue
                a, _ = _digest(grams)
                for band, found in keys_of(grams, percent, low):
                    keys.append(found)
                    owners.append(np.full(len(found), node_of(a, band), np.int64))
                    held += len(found)
                if held >= GATHER:
                    yield from flush(keys, owners)
                    keys, owners, held = [], [], 0
        if held:
            yield from flush(keys, owners)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each bucket. Rows come sorted by bucket, one bucket is held at a time."""

    def close(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        join = lambda k: np.concatenate([unpack(x[k]) for x in held])
        _, _, links = _stars(join(0), join(1).astype(np.int64))
        sent = join(2).astype(np.int64).reshape(-1, 2)
        links = np.unique(np.concatenate([links, sent]), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"]
        )

    now, held = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and held:
                yield close(held)
                held = []
            now = bucket
            held.append(row)
    if held:
        yield close(held)


def _overlaps(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted array with others."""
    both = np.concatenate(others)
    place = np.searchsorted(a, both)
    place[place == len(a)] = 0
    starts = np.append(0, np.cumsum([len(x) for x in others])[:-1])
    return np.add.reduceat((a[place] == both).astype(np.int64), starts)


def link_sets(
    sets: list[np.ndarray], percent: int, side: np.ndarray | None = None,
    copies: np.ndarray | None = None, own: np.ndarray | None = None,
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Enough links to connect what is linked among sorted distinct arrays, and link counts.

    With ``side`` (0 or 1 for each set) only links between the sides are looked for. With
    ``copies`` (rows that each set stands for) every link is found, and each set's linked rows are counted,
    over the links whose smaller set is marked in ``own``; without, pairs already connected are passed by
    and the counts are 0.
    """
    counts = np.zeros(len(sets), np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    if not len(order):
        return [], counts
    bits = min(max(256, 1 << int(size[-1]).bit_length()), 1 << 16)
    maps = np.empty((len(order), bits // 64), _U)
    for row, k in enumerate(order):
        maps[row] = bitmap(sets[k], bits).view(_U)
    group = np.arange(len(order))
    half = side[order] if side is not None else None
    links = []
    for i in range(len(order) - 1):
        to = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        other = np.arange(i + 1, to)
        if copies is None:
            other = other[group[other] != group[i]]
        elif not own[order[i]]:
            continue
        if half is not None:
            other = other[half[other] != half[i]]
        if not len(other):
            continue
        differ = np.bitwise_count(maps[other] ^ maps[i]).sum(1, dtype=np.int64)
        both = size[i] + size[other]
        bound = (both - differ) // 2
        a = sets[order[i]]
        other = other[100 * bound >= percent * (both - bound)]
        if copies is not None:
            step = max(1, OVERLAP // max(int(size[i]), 1))
            for at in range(0, len(other), step):
                some = other[at : at + step]
                shared = _overlaps(a, [sets[k] for k in order[some]])
                some = some[100 * shared >= percent * (len(a) + size[some] - shared)]
                counts[order[i]] += copies[order[some]].sum()
                counts[order[some]] += copies[order[i]]
                for j in some:
                    if group[j] != group[i]:
                        links.append((int(order[i]), int(order[j])))
                        group[group == group[j]] = group[i]
            continue
        for j in other:
            if group[j] == group[i]:
                continue
            b = sets[order[j]]
            place = np.searchsorted(b, a)
            place[place == len(b)] = 0
            shared = int((b[place] == a).sum())
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                links.append((int(order[i]), int(order[j])))
                group[group == group[j]] = group[i]
    return links, counts


def link_bitmaps(
    size: np.ndarray, maps: np.ndarray, percent: int, own: np.ndarray, side: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Enough pairs to connect what may be linked among sets of such sizes and bitmaps, a row of ``maps`` each.

    Only pairs whose smaller set is marked in ``own`` are looked at, and with ``side`` only those between the sides.
    """
    order = np.argsort(size, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    halves = [order] if side is None else [order[side[order] == k] for k in (0, 1)]
    group = np.arange(len(order))
    links = []
    for half, against in zip(halves, halves[::-1]):
        # One row for each word of the bitmaps, so that many sets are compared at a time.
        columns, sizes, ranks = np.ascontiguousarray(maps[against].T), size[against], rank[against]
        for i in half[own[half] != 0]:
            begin = int(np.searchsorted(ranks, rank[i], "right"))
            end = int(np.searchsorted(sizes, size[i] * 100 // percent, "right"))
            if begin >= end:
                continue
            differ = np.zeros(end - begin, np.int32)
            for word, column in zip(maps[i], columns):
                differ += np.bitwise_count(column[begin:end] ^ word)
            both = size[i] + sizes[begin:end]
            bound = (both - differ) // 2
            other = against[begin:end][100 * bound >= percent * (both - bound)]
            found, first = np.unique(group[other], return_index=True)
            new = found != group[i]
            if new.any():
                links += [(int(i), int(j)) for j in other[first[new]]]
                group[np.isin(group, found)] = group[i]
    return links


def _near(percent: int):
    """Links of each unit by bitmaps, between nodes. Rows come sorted by unit, one unit is held at a time."""
    low = bands(percent)

    def close(held: list[tuple], two: bool, band: int) -> pa.RecordBatch:
        node, size, own, side = (np.array([x[k] for x in held], np.int64) for k in range(4))
        bits = bits_of(low, band)
        maps = np.stack([folded(x[4], bits) for x in held]).view(_U)
        found = np.array(link_bitmaps(size, maps, percent, own, side if two else None), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("unit", "two", "low", "node", "n", "own", "side", "bits")))
            for unit, two, band, *row in rows:
                if (unit, two, band) != now and held:
                    yield close(held, *now[1:])
                    held = []
                now = unit, two, band
                held.append(row)
        if held:
            yield close(held, *now[1:])

    return run


def _close_members(members: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """``members`` of clusters with those only that the bitmaps connect, by clusters of what they connect."""
    spark = members.sparkSession
    node = F.xxhash64("low", "a", "b")
    units = _units(members, BITMAP_ROWS, BITMAP_GRAMS).select("unit", "two", "low", node.alias("node"), "n", "own", "side", "a", "b")
    near = (
        units.join(bitmaps, ["a", "b"])
        .select("unit", "two", "low", "node", "n", "own", "side", "bits")
        .repartition(partitions(spark), "unit")
        .sortWithinPartitions("unit")
        .mapInArrow(_near(percent), "a long, b long")
    )
    clusters = components(near)
    return members.drop("root").join(clusters, node == clusters["node"]).select("root", *(c for c in members.columns if c != "root"))


def _held(present: np.ndarray):
    """The texts whose ids the bitmap may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            held = present[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1
            yield batch.select(["id", "text"]).filter(pa.array(held.astype(bool)))

    return run


def _compare(n: int, percent: int, count: bool):
    """Links of each unit, and rows with a null ``b`` that say how many rows a class links to.

    Rows come sorted by unit, one unit is held at a time.
    """

    def close(held: dict[tuple[int, int], tuple], two: bool) -> pa.RecordBatch:
        ids, side, copies, own = (np.array([x[k] for x in held.values()], np.int64) for k in range(4))
        links, counts = link_sets(
            [x[4] for x in held.values()], percent, side if two else None, copies if count else None, own
        )
        found = np.array(links, np.int64).reshape(-1, 2)
        some = np.flatnonzero(counts)
        a = np.concatenate([ids[found[:, 0]], ids[some]])
        b = pa.array([*ids[found[:, 1]].tolist(), *[None] * len(some)], pa.int64())
        times = np.concatenate([np.zeros(len(found), np.int64), counts[some]])
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(times)], names=["a", "b", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            meta = {c: batch.column(c).to_pylist() for c in ("unit", "id", "a", "b", "side", "two", "copies", "own")}
            for i, grams in enumerate(_sets(batch, n)):
                if meta["unit"][i] != now:
                    if held:
                        yield close(held, now_two)
                    now, now_two, held = meta["unit"][i], meta["two"][i], {}
                # An id may stand on several rows; only that of this class counts.
                if len(grams) and _digest(grams) == (meta["a"][i], meta["b"][i]):
                    held[meta["a"][i], meta["b"][i]] = (*(meta[c][i] for c in ("id", "side", "copies", "own")), grams)
        if held:
            yield close(held, now_two)

    return run


def _units(members: DataFrame, most_rows: int, most_grams: int) -> DataFrame:
    """``members(root, rep, n, a, b, band, low, copies)`` with the units that each is compared in, in tiles of such size.

    ``low`` is the band of the cluster, in which the smaller set of a link lies; members
    are of this band or the next.
    """
    tiles = members.groupBy("root", "band").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    tile_count = F.ceil(F.greatest(F.col("rows") / most_rows, F.col("grams") / most_grams)).cast("int")
    plan = keep(
        tiles.groupBy("root").agg(
            F.map_from_entries(F.collect_list(F.struct("band", tile_count.alias("tiles")))).alias("plan"),
            ((F.sum("rows") > most_rows) | (F.sum("grams") > most_grams)).alias("many"),
        ),
        "plan",
    )
    mine = members.join(plan, "root").withColumn(
        "slot", F.pmod(F.xxhash64("a", "b"), F.expr("plan[band]")).cast("int")
    )
    # Of the lower band: the own tile, the others of the band, those of the next band.
    # Of the next band, as the other side: all tiles of the lower band.
    pairs = F.expr(
        """
        if(band = low, flatten(array(
          array(struct(0 as side, false as two, format_string('%d.%d', band, slot) as x, '' as y)),
          transform(filter(sequence(0, plan[band] - 1), s -> s <> slot),
            s -> struct(int(s < slot) as side, true as two,
              format_string('%d.%d', band, least(s, slot)) as x, format_string('%d.%d', band, greatest(s, slot)) as y)),
          if(plan[band + 1] is null, array(), transform(sequence(0, plan[band + 1] - 1),
            s -> struct(0 as side, true as two, format_string('%d.%d', band, slot) as x, format_string('%d.%d', band + 1, s) as y)))
        )),
        if(plan[low] is null, array(), transform(sequence(0, plan[low] - 1),
          s -> struct(1 as side, true as two, format_string('%d.%d', low, s) as x, format_string('%d.%d', band, slot) as y))))
        """
    )
    whole = F.expr("array(struct(0 as side, false as two, '' as x, '' as y))")
    return (
        mine.withColumn("u", F.explode(F.when(F.col("many"), pairs).otherwise(whole)))
        .select("rep", "n", "a", "b", "low", "copies", (F.col("band") == F.col("low")).alias("own"), F.concat_ws("/", F.col("root").cast("string"), F.col("low").cast("string"), "u.x", "u.y").alias("unit"), "u.side", "u.two")
    )


def ngram_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, percent: int = 85,
    count_links: bool = True,
) -> DataFrame:
    """``(id, n_shingles, component_id, n_links)`` for every row of ``docs``.

    ``n_links`` is the number of other rows that the row links with. Without ``count_links`` it is left out, and
    pairs that are connected already are not compared."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    if words < 1:
        raise ValueError("words must be positive")
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))

    described = keep(
        texts.mapInArrow(_describe(words, percent), "id long, n long, a long, b long, band int, bits binary"), "sets"
    )
    classes = keep(
        described.filter("n > 0").groupBy("n", "a", "b", "band").agg(
            F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("bits").alias("bits")
        ),
        "classes",
    )

    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(8 * partitions(spark), int(1.2 * total) // BUCKET)
    sent = texts.select("text").mapInArrow(
        _send(words, percent, buckets), "bucket int, keys binary, owners binary, links binary"
    )
    near = (
        sent.repartition(max(partitions(spark), buckets // 8), "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_meet, "a long, b long")
    )
    clusters = components(near)

    nodes = classes.filter("rep is not null").select(
        "rep", "n", "a", "b", "band", "copies", F.explode(F.array_distinct(F.array("band", F.greatest(F.col("band") - 1, F.lit(0))))).alias("low")
    )
    members = nodes.join(clusters, _node(F.col("low")) == clusters["node"])
    members = keep(members.select("root", "rep", "n", "a", "b", "band", "low", "copies"), "members")
    members = keep(_close_members(members, classes.select("a", "b", "bits"), percent), "close")
    units = _units(members, TILE_ROWS, TILE_GRAMS)
    place = F.shiftrightunsigned(F.xxhash64("id"), 64 - MAP_BITS).alias("place")
    present = seed_map(members.select(F.xxhash64("rep").alias("seed")))
    held = texts.filter("id is not null").select("id", "text", place).mapInArrow(_held(present), "id long, text string")
    pairs = (
        units.join(held, F.col("rep") == F.col("id"))
        .select("unit", "id", "a", "b", "side", "two", "copies", "own", "text")
        .repartition(4 * partitions(spark), "unit")
        .sortWithinPartitions("unit")
        .mapInArrow(_compare(words, percent, count_links), "a long, b long, times long")
    )
    if count_links:
        pairs = keep(pairs, "pairs")
    linked = components(pairs.filter("b is not null").select("a", "b"))
    named = classes.join(linked, classes["rep"] == linked["node"], "left").select(
        "n", "a", "b", "rep", "copies", F.coalesce("root", "rep").alias("component_id")
    )
    if count_links:
        counts = pairs.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("times").alias("times"))
        named = named.join(counts, "rep", "left")
    else:
        named = named.withColumn("times", F.lit(0))
    links = (F.col("copies") - 1 + F.coalesce("times", F.lit(0))).cast("long").alias("n_links")
    named = keep(named.select("n", "a", "b", "component_id", links), "named")
    some = described.filter("n > 0").join(named, ["n", "a", "b"]).select("id", "n", "component_id", "n_links")
    none = described.filter("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.union(none).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", *(["n_links"] if count_links else [])
    )
