"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit set where more than half of the text's shingle hashes have it.  It is one lane of 64 bits (the hashes themselves), or several: each
further lane holds the bits of a mixture of the same hashes, so that wider fingerprints tell similarities apart more finely.  Two texts of Jaccard
similarity s differ in about acos(2 s / (1 + s)) / pi of the bits (``radius_for``).

Distinct fingerprints are laid out in tiles of at most ``tile`` by the number of bits set in their upper and lower half; a pair of tiles is compared only if
those counts can be within the radius (bits differ in at least as many places as counts do).  Inside a pair of tiles, rows sorted by the counts of their
four quarters form small sub-tiles that are skipped the same way; the others are compared in full with numpy exclusive-or and bit counts, half of
the lanes first and the others for the pairs still within the radius.  Between large tiles the bits are cut into so many chunks that rows within the radius
must be nearly equal in one, and only such rows are compared (``_chunk_labels``).  No link is lost, and the comparison is exact.

Each pair of tiles reports a spanning forest of its links (never all pairs of a group), and components come from alternating star contractions, each
iteration written to the shared checkpoint folder.  Fingerprints occur once in all of this, so copies cost one row; the join back to the documents is an
ordinary join that AQE splits when a fingerprint is hot.  The driver sees how many fingerprints have which counts, and a box of counts for each tile, never
fingerprints; tiles are of two sizes only, their number grows with the input, and pairs of tiles are listed by the executors.  The number of compared pairs grows
with the square of the distinct fingerprints, which is in the nature of this method; the chunks leave a quarter of them at a radius of 46 of 256 bits.

Null and empty texts have fingerprint zero and link like any other.  Texts shorter than a shingle are one shingle.  Null ids take part, but never become
a component's id unless it has no other.  Repeated rows give equal rows.  An empty table gives an empty result.  Other columns are not read; ``one_of_each``
keeps them as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, hashable, hashes, reliable, utf8, whole_row

SEED = 42
#: Rows of a sub-tile, and of a tile at most; twice as many where there would be over ``MANY`` tiles.
SUB, TILE, MANY = 256, 32768, 64
#: Pairs that are compared at a time; seconds that a pair, and a call of numpy's functions for a key, are counted with in ``_chunk_plan``.
_BLOCK, _PAIR, _CALL = 1 << 18, 4e-9, 5e-5
#: Shingle hashes whose bits are counted at a time.
_CHUNK = 1 << 15


def radius_for(similarity: float, lanes: int = 1, recall: float = 0.9) -> int:
    """Bits within which a share ``recall`` of the pairs of exactly this Jaccard similarity is expected, and more of those above it."""
    from statistics import NormalDist

    apart, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * lanes
    return math.floor(bits * apart + NormalDist().inv_cdf(recall) * math.sqrt(bits * apart * (1 - apart)))


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """hashes x lanes: the hashes themselves, then mixtures of them."""
    out = np.empty((len(hashes), lanes), np.uint64)
    out[:, 0] = hashes
    for k in range(1, lanes):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(text: bytes, shingle: int = 4, lanes: int = 1) -> bytes:
    """8 * ``lanes`` bytes, most significant bit first."""
    words = text.lower().split()
    if not words:
        return bytes(8 * lanes)
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - size]]
    digest = xxhash.xxh64_intdigest
    found = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64)
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(found), _CHUNK):
        some = _lanes(found[at : at + _CHUNK], lanes).astype(">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(len(some), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(found)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, fp (8 * ``lanes`` bytes), and how many bits are set in its upper and lower half, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            own = [fingerprint(data[a:b].tobytes(), shingle, lanes) for a, b in zip(offsets, offsets[1:])]
            halves = np.bitwise_count(np.frombuffer(b"".join(own), np.uint8)).reshape(len(own), 2, -1).sum(2, dtype=np.int32)
            made = [pa.array(own, pa.binary()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            yield pa.RecordBatch.from_arrays([*map(batch.column, carry), *made], [*carry, "fp", "upper", "lower"])

    rows = docs.select(*carry, "text")
    schema = rows.drop("text").schema.add("fp", "binary").add("upper", "integer").add("lower", "integer")
    return rows.mapInArrow(run, schema)


def _sub_tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """fps: rows x lanes.  Rows sorted by the bit counts of their quarters, their former places, and the least and greatest counts of each sub-tile (the fifth is the total)."""
    quarters = np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16)).reshape(len(fps), 4, -1).sum(2, dtype=np.int16)
    order = np.lexsort(quarters.T)
    fps, quarters = fps[order], quarters[order]
    counts = np.column_stack([quarters, quarters.sum(1)])
    cuts = np.arange(0, len(fps), SUB)
    return fps, order, np.minimum.reduceat(counts, cuts), np.maximum.reduceat(counts, cuts)


def _within(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that differ in at most ``radius`` bits."""
    first = (a.shape[1] + 1) // 2
    lanes = np.ascontiguousarray(b[:, :first].T)
    differ = a[:, 0, None] ^ lanes[0]
    apart = np.bitwise_count(differ)
    if first > 3:
        apart = apart.astype(np.uint16)
    for k in range(1, first):
        np.bitwise_xor(a[:, k, None], lanes[k], out=differ)
        apart += np.bitwise_count(differ)
    u, v = np.divmod(np.flatnonzero(apart <= radius), len(b))
    if a.shape[1] > first and len(u):
        on = apart[u, v] + np.bitwise_count(a[u, first:] ^ b[v, first:]).sum(1, dtype=np.int64) <= radius
        u, v = u[on], v[on]
    return u, v


def _join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Give both ends of each link, and all that already shares their labels, the least label."""
    while True:
        a, b = label[u], label[v]
        if not (apart := a != b).any():
            return
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (deeper := label[label]) is not None and (deeper != label).any():
            label[:] = deeper


def _chunk_plan(bits: int, radius: int, pairs: int) -> tuple[int, int, int] | None:
    """(chunks, bits that may differ in one, bits of a chunk that are looked at) of the least work; None where comparing all pairs is no more work."""
    best, least = None, pairs * _PAIR
    for apart in range(4):
        n = radius // (apart + 1) + 1
        for wide in range(apart + 1, min(16, bits // n) + 1):
            share = sum(math.comb(wide, k) for k in range(apart + 1)) / 2**wide
            work = n * (2**wide * _CALL + share * pairs * _PAIR)
            if work < least:
                best, least = (n, apart, wide), work
    return best


def _chunk_keys(fps: np.ndarray, plan: tuple[int, int, int]) -> list[np.ndarray]:
    """For each chunk, the number made of the bits that are looked at, of every row."""
    n, _, wide = plan
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1)
    step, weights = bits.shape[1] // n, 1 << np.arange(wide)
    return [bits[:, c * step : c * step + wide] @ weights for c in range(n)]


def _chunk_labels(left: np.ndarray, right: np.ndarray | None, radius: int, plan: tuple[int, int, int]) -> np.ndarray | None:
    """Labels of the rows of both tiles, equal where links connect them; None if the keys are so uneven that comparing all pairs is less work.

    There are more chunks than the radius has room for if each differed in more bits than the plan allows: rows within the radius have a chunk in which
    their keys are that near, and only such rows are compared.
    """
    n, allowed, wide = plan
    near = np.arange(1 << wide)[:, None] ^ np.flatnonzero(np.bitwise_count(np.arange(1 << wide)) <= allowed)
    shift, other = (0, left) if right is None else (len(left), right)
    keys = _chunk_keys(left, plan)
    keys = list(zip(keys, keys if right is None else _chunk_keys(right, plan)))
    sizes = [[np.bincount(k, minlength=1 << wide) for k in both] for both in keys]
    pairs = len(left) * len(other)
    compared, even = sum(int(a @ b[near].sum(1)) for a, b in sizes), n * near.shape[1] / 2**wide * pairs
    # what is more than even keys give is mostly links, found again in chunk after chunk
    if compared + 10 * max(0, compared - even) > pairs:
        return None
    label = np.arange(shift + len(other))
    for both, (size, size_) in zip(keys, sizes):
        order, order_ = (np.argsort(k, kind="stable") for k in both)
        ends, starts_ = np.cumsum(size), np.cumsum(size_) - size_
        found, n_found = [], 0
        for value in np.flatnonzero(size):
            beside = near[value] if right is not None else near[value][near[value] >= value]
            some = size_[beside]
            rows_ = order_[np.repeat(starts_[beside] - np.cumsum(some) + some, some) + np.arange(some.sum())]
            rows = order[ends[value] - size[value] : ends[value]]
            most = max(1, _BLOCK // max(1, len(rows_)))
            for at in range(0, len(rows), most):
                part, own = rows[at : at + most], label[rows[at : at + most]]
                # rows that are connected already are not compared again, so that a large group costs little
                to = rows_[label[rows_ + shift] != own[0]] if (own == own[0]).all() else rows_
                u, v = _within(left[part], other[to], radius)
                if len(u):
                    found.append((part[u], to[v] + shift))
                    n_found += len(u)
                if n_found > _BLOCK // 4:
                    _join_labels(label, *map(np.concatenate, zip(*found)))
                    found, n_found = [], 0
        if found:
            _join_labels(label, *map(np.concatenate, zip(*found)))
    return label


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links between two tiles (within one, if right is None): each linked row with its representative, rows of ``right`` numbered after those of ``left``."""
    plan = _chunk_plan(64 * left.shape[1], radius, len(left) * len(left if right is None else right))
    label = None if plan is None else _chunk_labels(left, right, radius, plan)
    if label is not None:
        linked = np.flatnonzero(label != np.arange(len(label)))
        return linked, label[linked]
    a, a_order, a_min, a_max = _sub_tiles(left)
    b, b_order, b_min, b_max = (a, a_order, a_min, a_max) if right is None else _sub_tiles(right)
    gap = np.maximum(0, np.maximum(a_min[:, None] - b_max[None], b_min[None] - a_max[:, None]))
    near = np.maximum(gap[..., :4].sum(2), gap[..., 4]) <= radius
    place = a_order if right is None else np.concatenate([a_order, len(a) + b_order])
    shift, label = 0 if right is None else len(a), np.arange(len(place))
    for i, j in zip(*np.nonzero(near)):
        if right is None and j < i:
            continue
        u, v = _within(a[i * SUB : (i + 1) * SUB], b[j * SUB : (j + 1) * SUB], radius)
        if len(u):
            _join_labels(label, u + i * SUB, v + j * SUB + shift)
    linked = np.flatnonzero(label != np.arange(len(place)))
    return place[linked], place[label[linked]]


def _plan(cells: list, tile: int) -> tuple[list[tuple], np.ndarray]:
    """cells: (upper, lower, n).  Returns (upper, lower, first tile, tiles) of each cell and a box of counts for each tile."""
    where, boxes, room = [], [], 0
    for upper, lower, n in sorted(cells):
        chunks = -(-n // tile)
        if chunks == 1 and n <= room:
            room -= n
            box = boxes[-1]
            boxes[-1] = [min(box[0], upper), max(box[1], upper), min(box[2], lower), max(box[3], lower)]
            where.append((upper, lower, len(boxes) - 1, 1))
        else:
            # a cell of several tiles is cut by hash: the slack keeps each part below the size of a tile
            chunks = chunks if chunks == 1 else -(-(n + n // 8) // tile)
            where.append((upper, lower, len(boxes), chunks))
            boxes += [[upper, upper, lower, lower]] * chunks
            room = tile - n if chunks == 1 else 0
    return where, np.array(boxes).reshape(-1, 4)


def tiles(classes: DataFrame, tile: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(tile, rows: array of (fp, least_id)) of all rows of ``classes`` (fp, upper, lower, least_id), and a box of counts for each tile."""
    spark = classes.sparkSession
    cells = [tuple(r) for r in classes.groupBy("upper", "lower").count().collect()]  # (32 lanes + 1) squared at most
    where, boxes = _plan(cells, tile or TILE * (1 + (sum(n for *_, n in cells) > MANY * TILE)))
    cell = spark.createDataFrame(where, "upper int, lower int, first long, tiles long")
    placed = classes.join(F.broadcast(cell), ["upper", "lower"])
    number = (F.col("first") + F.pmod(F.xxhash64("fp"), "tiles")).alias("tile")
    return reliable(placed.groupBy(number).agg(F.collect_list(F.struct("fp", "least_id")).alias("rows"))), boxes


def links(laid: DataFrame, boxes: np.ndarray, radius: int) -> DataFrame:
    """(a, b): links that connect whatever is within the radius, between nodes numbered tile * 2^32 + place in the tile."""
    spark = laid.sparkSession

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = lambda lo, hi, at: np.maximum(0, np.maximum(lo[at] - hi[at:], lo[at:] - hi[at]))
        for batch in batches:
            for at in batch.column("a").to_pylist():
                b = at + np.flatnonzero(gap(boxes[:, 0], boxes[:, 1], at) + gap(boxes[:, 2], boxes[:, 3], at) <= radius)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), at)), pa.array(b)], ["a", "b"])

    pairs = reliable(spark.range(len(boxes)).withColumnRenamed("id", "a").mapInArrow(partners, "a long, b long"))
    fps = laid.select("tile", F.col("rows.fp").alias("fps"))
    both = pairs.join(fps.toDF("a", "left"), "a").join(fps.toDF("b", "right"), "b")
    n_pairs = pairs.count()
    n = max(1, min(n_pairs, max(4 * spark.sparkContext.defaultParallelism, n_pairs // 4)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = batch.column("a")[k].as_py(), batch.column("b")[k].as_py()
                left, right = (_matrix(batch.column(c)[k].values) for c in ("left", "right"))
                u, v = tile_links(left, None if one == two else right, radius)
                node = lambda x: np.where(x < len(left), (one << 32) + x, (two << 32) + x - len(left))
                yield pa.RecordBatch.from_arrays([pa.array(node(u)), pa.array(node(v))], ["a", "b"])

    return both.repartition(n, F.col("a"), F.col("b")).mapInArrow(compare, "a long, b long")


def _matrix(column: pa.Array) -> np.ndarray:
    """Fingerprints of equal width as rows x lanes."""
    data, offsets = utf8(column)
    return data.view(np.uint64).reshape(len(offsets) - 1, -1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, root being the least node of its component: alternating large-star and small-star contraction."""
    edges = reliable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = reliable(small.select("e.a", "e.b").where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _grouped(rows: DataFrame, radius: int, tile: int | None) -> DataFrame:
    """rows (with fp, upper, lower, doc_id) with ``root`` (a number of the component) and component_id (its least id)."""
    classes = reliable(rows.groupBy("fp", "upper", "lower").agg(F.min("doc_id").alias("least_id")))
    laid, boxes = tiles(classes, tile)
    nodes = laid.select("tile", F.posexplode("rows").alias("at", "x")).select((F.shiftleft("tile", 32) + F.col("at")).alias("node"), "x.fp", "x.least_id")
    found = components(links(laid, boxes, radius))
    roots = reliable(nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("root"), "least_id"))
    # components of one fingerprint need no meeting; the others are named by few rows, so that no component gathers in a task
    least = few(reliable(roots.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")))
    named = roots.join(least, "root", "left").select("fp", "root", F.coalesce("component_id", "least_id").alias("component_id"))
    return rows.join(named, "fp", "left")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, lanes: int = 1, tile: int | None = None) -> DataFrame:
    """doc_id, fp and component_id (the least id that can be reached over links) of every document."""
    rows = reliable(fingerprints(docs.selectExpr("cast(doc_id as long) doc_id", "text"), shingle, lanes))
    return _grouped(rows, radius, tile).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, lanes: int = 4, tile: int | None = None) -> DataFrame:
    """One row of each component of ``docs`` with all its columns: that of the least id, then of the least hash of the text; of rows equal in both, one.

    Texts are near-duplicates when their fingerprints say that their shingles' similarity is ``similarity`` or more (``radius_for``).
    """
    key = hashes("doc_id", "text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *key)
    rows = reliable(fingerprints(keyed, shingle, lanes, ("doc_id", "h1", "h2")))
    grouped = _grouped(rows, radius_for(similarity, lanes), tile)
    first = F.min(F.struct(F.isnull("doc_id"), "doc_id", "h1", "h2")).alias("x")
    chosen = reliable(grouped.groupBy("root").agg(first).select("x.h1", "x.h2"))
    repeated = rows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    again = few(reliable(chosen.join(repeated, ["h1", "h2"], "left_semi")))
    # as many rows as the corpus has components: never broadcast, however few they are here
    kept = docs.select(whole_row(docs), *key).join(chosen, ["h1", "h2"], "left_semi")
    single = kept.join(again, ["h1", "h2"], "left_anti").select("row")
    equal = docs.select(whole_row(docs), F.xxhash64(*hashable(docs)).alias("h"), *key).join(again, ["h1", "h2"], "left_semi")
    equal = equal.groupBy("h1", "h2").agg(F.min_by("row", "h").alias("row")).select("row")
    return single.unionByName(equal).select("row.*")
