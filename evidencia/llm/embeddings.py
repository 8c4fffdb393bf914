"""Near-duplicate vectors by collision counts of one-dimensional projections.

Two vectors collide in a projection when one lies in the window around the other. A pair at the
least similarity collides in each projection with a known probability, so the number of collisions
that all but ``1 - recall`` of such pairs reach follows from the binomial distribution; pairs that
reach it are verified by their cosine in double precision.

This is a scan of block pairs, not a merge of many sorted lists: only the first projection is
sorted, over all rows; it orders them in blocks, and only blocks that lie within a wider window of
one another meet. Within a pair of blocks the collisions of the other projections are counted for
all of its pairs at once. At a cosine of 0.95 a window of one projection holds about half of all
rows, so sorted lists of the others would have to give out that many pairs each; in blocks no pair
leaves its task before it is verified, but work grows with the square of the rows. The wide window
of the first projection (``BLOCK_WIDTH``) loses 0.0005 of the pairs at the least similarity on
average; that and the two counts make the recall that ``expected_recall`` gives.

Equal vectors are one class from the start. Vectors that are null or zero, or hold null or
non-finite components, link with nothing; vectors of unlike length link with nothing. Repeated
rows count as other vectors, as do rows that share a vec_id but not the vector. A null vec_id is
passed over when the smallest is sought. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import arrow_ready, batch, cut, lean
from .graph import connected_components

#: Rows of a block.
BLOCK = 2048
#: Projections of the first count and of both.
FIRST, ALL = 8, 24
#: Window in standard deviations of a projected difference at the least similarity.
WIDTH = 2.0
#: The same for blocks along the first projection, where a miss can't be made good.
BLOCK_WIDTH = 3.5
#: Share of pairs at the least similarity that each count keeps.
RECALL = 0.998
SCALE = 1000
#: Bytes of components in a partition of blocks, about; partitions at least; rows that a task holds before it merges them.
TILE_BYTES, LEAST_TILES, MOST_HELD = 16 << 20, 8, 1 << 20


def projections(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, ALL))


def least_count(n: int, p: float, recall: float) -> int:
    """The largest count that a binomial variable reaches with probability ``recall``."""
    tail, t = 0.0, n + 1
    while tail < recall and t > 0:
        t -= 1
        tail += math.comb(n, t) * p**t * (1 - p) ** (n - t)
    return t


def window(cosine: float) -> tuple[float, float]:
    """The window's half width, and the probability of a collision at this cosine."""
    return WIDTH * math.sqrt(2 - 2 * cosine), math.erf(WIDTH / math.sqrt(2))


def block_window(cosine: float, dims: list[int]) -> float:
    """The half width of the window between blocks, for the longest first direction at hand."""
    longest = max((float(np.linalg.norm(projections(d)[:, 0])) / math.sqrt(d) for d in dims), default=1.0)
    return BLOCK_WIDTH * max(1.0, longest) * math.sqrt(2 - 2 * cosine)


def expected_recall(cosine: float) -> float:
    """Share of the pairs at this cosine that the block window and both counts keep, at least (sum of their losses)."""
    _, p = window(cosine)
    reached = lambda n, t: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(t, n + 1))
    lost = (1 - math.erf(BLOCK_WIDTH / math.sqrt(2))) + sum(1 - reached(n, least_count(n, p, RECALL)) for n in (FIRST, ALL))
    return 1 - lost


def component_type(vectors: DataFrame) -> np.dtype:
    """How components are kept: as floats if the table has floats, which hold them exactly, else as doubles."""
    return np.dtype(np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else np.float64)


def prepared(vectors: DataFrame, whole: bool = True) -> DataFrame:
    """vec_id, dim and the hash of the components, null for unfit vectors; ``whole``: with the first projection and the components as bytes."""
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("key_a", pa.int64()), ("key_b", pa.int64())] + [("first", pa.float64()), ("raw", pa.binary())] * whole)
    kind = component_type(vectors)

    def made(batches):
        from xxhash import xxh3_128_digest

        for b in batches:
            lists = b.column(1)
            values, starts = lists.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), lists.offsets.to_numpy()
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
            dims, keys, first, raw = np.zeros(len(sizes), np.int32), np.zeros((len(sizes), 2), np.int64), np.zeros(len(sizes)), [None] * len(sizes)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == dim)
                x = values[starts[at][:, None] + np.arange(dim)] + 0.0  # null components are not numbers here
                most = np.abs(x).max(1)
                good = np.isfinite(x).all(1) & (most > 0)
                x, at, most = x[good], at[good], most[good, None]
                with np.errstate(over="ignore"):
                    norm = np.linalg.norm(x / most, axis=1)[:, None] * most
                good = np.isfinite(norm[:, 0])
                x, at, norm = x[good], at[good], norm[good]
                dims[at], first[at] = dim, (x / norm) @ projections(dim)[:, 0]
                for i, row in zip(at.tolist(), x.astype(kind)):
                    raw[i] = row.tobytes()
                keys[at] = np.frombuffer(b"".join(xxh3_128_digest(raw[i]) for i in at.tolist()), np.int64).reshape(-1, 2)
            fit = lambda v, t: pa.array(v, t, mask=dims == 0)
            out = {"vec_id": b.column(0), "dim": fit(dims, pa.int32()), "key_a": fit(keys[:, 0], pa.int64()), "key_b": fit(keys[:, 1], pa.int64())}
            yield batch(schema, **out, **({"first": fit(first, pa.float64()), "raw": raw} if whole else {}))

    arrow_ready(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).mapInArrow(lean(made), "vec_id long, dim int, key_a long, key_b long" + ", first double, raw binary" * whole)


def tiles(vectors: DataFrame) -> int:
    """Partitions of blocks: of about ``TILE_BYTES`` at most, and so many that their pairs use all cores."""
    size = (vectors.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0) * component_type(vectors).itemsize
    return max(LEAST_TILES, -(-size // TILE_BYTES), math.isqrt(4 * vectors.sparkSession.sparkContext.defaultParallelism))


def blocks(classes: DataFrame, parts: int) -> DataFrame:
    """Sorted runs of classes: block, dim, low and high of the first projection; weight, least vec_id and hash of each class; components as bytes."""
    each = ["weight", "least", "key_a", "key_b"]
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("low", pa.float64()), ("high", pa.float64())] + [(c, pa.list_(pa.int64())) for c in each] + [("raw", pa.binary())])

    def packed(batches):
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        held: list[tuple] = []

        def flush():
            nonlocal number, held
            dim, first, raw, *rest = zip(*held)
            row = batch(schema, block=[number], dim=[dim[0]], low=[first[0]], high=[first[-1]], raw=[b"".join(raw)], **{c: [v] for c, v in zip(each, rest)})
            number, held = number + 1, []
            return row

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("dim", "first", "raw", *each))):
                if held and (held[0][0] != row[0] or len(held) == BLOCK):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    order = ["dim", "first", "key_a", "key_b"]
    ordered = classes.select("dim", "first", "raw", *each).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(lean(packed), "block long, dim int, low double, high double, weight array<long>, least array<long>, key_a array<long>, key_b array<long>, raw binary")


def components_in(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links a - b."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return low


def links_between(x: np.ndarray, y: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of the links between two blocks, found by collision counts and verified."""
    half, p = window(cosine)
    need_first, need_all = least_count(FIRST, p, RECALL), least_count(ALL, p, RECALL)
    reach = round(half * SCALE)
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    grid = projections(x.shape[1])
    px, py = (np.round(np.clip((v / n[:, None]) @ grid * SCALE, -15000, 15000)).astype(np.int16) for v, n in ((x, norm_x), (y, norm_y)))
    tx, ty = px.T.copy(), py.T.copy()
    found = []
    for at in range(0, len(x), 256):
        count = np.zeros((min(256, len(x) - at), len(y)), np.uint8)
        for k in range(FIRST):
            gap = tx[k, at : at + 256, None] - ty[k][None, :]
            count += np.abs(gap, out=gap) <= reach
        i, j = np.nonzero(count >= need_first)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        full = count[i - at, j].astype(np.int64)
        for k in range(FIRST, ALL):
            full += np.abs(tx[k, i] - ty[k, j]) <= reach
        i, j = i[full >= need_all], j[full >= need_all]
        if len(i) > 0.02 * count.size:
            dots = (x[at : at + 256] @ y.T)[i - at, j]
        else:
            dots = np.einsum("ij,ij->i", x[i], y[j])
        good = dots >= cosine * norm_x[i] * norm_y[j]
        found.append((i[good], j[good]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Class, links and smallest class reached, once for each class, of such rows for pairs of blocks."""
    reps, links, lows = map(np.concatenate, zip(*found))
    node, place = np.unique(np.concatenate([reps, lows]), return_inverse=True)
    low = components_in(len(node), place[: len(reps)], place[len(reps) :])
    return node, np.bincount(place[: len(reps)], links, len(node)).astype(np.int64), node[low]


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    keys, kind = ["dim", "key_a", "key_b"], component_type(vectors)
    classes = prepared(vectors).where("dim is not null").groupBy(*keys).agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.min_by(F.struct("first", "raw"), "first").alias("one"))
    run = cut(blocks(classes.select(*keys, "least", "weight", "one.*"), tiles(vectors)))
    half = block_window(cosine, [r.dim for r in run.select("dim").distinct().collect()])
    side = lambda c: run.select(F.col("block").alias(c), *(F.col(n).alias(f"{c}_{n}") for n in ("dim", "low", "high", "weight", "raw")))
    near = (F.col("i_dim") == F.col("j_dim")) & (F.struct("i_low", "i") <= F.struct("j_low", "j")) & (F.col("j_low") <= F.col("i_high") + half)
    # partitions meet as they lie in the shared folder: a key would shuffle every block to all those near it
    meet = side("i").hint("shuffle_replicate_nl").join(side("j"), near)
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def compared(batches):
        found, held = [], 0
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c: b.column(c)[r].as_py()
                weights_x, weights_y = (b.column(f"{c}_weight")[r].values.to_numpy() for c in "ij")
                x, y = (np.frombuffer(get(f"{c}_raw"), kind).reshape(-1, get("i_dim")).astype(np.float64) for c in "ij")
                ids_x, ids_y = ((get(c) << 24) + np.arange(len(v)) for c, v in (("i", x), ("j", y)))
                i, j = links_between(x, y, get("i") == get("j"), cosine)
                if len(i):
                    found.append(merged([(ids_x[i], weights_y[j], ids_y[j]), (ids_y[j], weights_x[i], ids_x[i])]))
                    held += len(found[-1][0])
                if held > MOST_HELD:
                    found = [merged(found)]
                    held = 0
        if found:
            rep, links, low = merged(found)
            for at in range(0, len(rep), 1 << 16):
                yield batch(schema, **{n: v[at : at + (1 << 16)] for n, v in (("rep", rep), ("links", links), ("low", low))})

    found = cut(meet.select("i", "i_dim", "i_weight", "i_raw", "j", "j_weight", "j_raw").mapInArrow(lean(compared), "rep long, links long, low long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    known = run.select("block", "dim", F.posexplode(F.arrays_zip("key_a", "key_b", "least", "weight")).alias("place", "c")).select((F.shiftleft("block", 24) + F.col("place")).alias("rep"), "dim", "c.*")
    known = known.join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").select(*keys, "least", "weight", "links", F.coalesce("component", "rep").alias("group"))
    known = cut(known)
    smallest = known.groupBy("group").agg(F.min("least").alias("component_id"))
    of_class = known.join(smallest, "group").select(*keys, "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = prepared(vectors, whole=False).join(of_class, keys, "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
