"""Near-duplicates by SuperMinHash, banding, verification and union-find.

SuperMinHash draws for each element of a set a random permutation of the signature's places and
fractions in [0, 1); a place holds the least of rank + fraction over all elements. Ranks are
correlated within an element, which lowers the variance, and the work can stop early: once every
place is below a rank, no element can change it from there on. Here the ranks of all elements of
a batch advance together, and a document leaves when its largest value is below the next rank.

Documents with equal sets are one class from the start. Classes that agree in a band are
candidates: each with the smallest and the largest class of its bucket, then, in buckets that
still hold several components, with members of the others. In buckets of up to ``SMALL`` classes
those are pairs; large ones that share classes are joined to one group, and in it the classes
outside the largest component meet all others, block by block, where only links between
components come out. All candidates are confirmed on their full sets. Links make components.

Null and empty texts have the empty set: they link with nothing. A row without a doc_id is kept. A text of fewer than ``k``
words has its whole sequence as its one shingle. Rows that repeat a doc_id are one node and each
get their row. Shingles are compared by 64-bit hashes: two of a pair's n shingles share one with
a probability of n * n / 2**64, which a confirmed pair would need about n / 5 times. Other columns
are ignored, and kept by ``keep_one_each`` whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_ready, batch, cut, lean, stored, text_bytes
from .graph import connected_components

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)
#: Elements whose permutations are held at once.
HELD = 60_000
#: Classes of a bucket that are compared pair by pair.
SMALL = 40
#: A bucket with at least one place in so many is frequent; no more than so many are.
FREQUENT = 4096
#: Shingles of a block, about; and columns of the matrix that counts common ones.
BLOCK, COLUMNS = 50_000, 8192


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    if len(words) < k:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - k + 1
    s = h[:n].copy()
    for i in range(1, k):
        s = s * ODD + h[i : i + n]
    return np.unique(mix(s))


def super_min_hash(elements: np.ndarray, owners: np.ndarray, n_sets: int, places: int) -> np.ndarray:
    """Signatures (n_sets x places) of the sets whose elements and owners (ascending) are given."""
    out = np.full(n_sets * places, np.inf)
    live, owner, state, order = elements, owners, elements.copy(), None
    for rank in range(places):
        state = state + GOLDEN
        x = mix(state)
        at = rank + ((x >> np.uint64(32)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
        fraction = (x & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32
        if rank == 0:
            first, place = at, at
        else:
            row = np.arange(len(live))
            place = order[row, at].astype(np.int64)
            order[row, at] = order[row, rank]
        np.minimum.at(out, owner * places + place, rank + fraction)
        open_sets = out.reshape(n_sets, places).max(1) >= rank + 1
        keep = open_sets[owner]
        if not keep.any():
            break
        if rank == 0:
            live, owner, state, first = live[keep], owner[keep], state[keep], first[keep]
            order = np.tile(np.arange(places, dtype=np.uint16), (len(live), 1))
            order[np.arange(len(live)), first] = 0
        elif not keep.all():
            live, owner, state, order = live[keep], owner[keep], state[keep], order[keep]
    return out.reshape(n_sets, places)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * ODD + bits[:, :, i])
    return key.view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("bands", pa.list_(pa.int64()))])


def sign(documents: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, size of the set, a 128-bit key of the set, and its band keys."""

    def signed(batches):
        for b in batches:
            ids, sets = b.column(0).to_pylist(), [shingles(t.as_py(), k) for t in b.column(1)]
            at = 0
            while at < len(sets):
                end, held = at, 0
                while end < len(sets) and (end == at or held + len(sets[end]) <= HELD):
                    held += len(sets[end])
                    end += 1
                part = sets[at:end]
                elements = np.concatenate(part) if part else np.array([], np.uint64)
                owners = np.repeat(np.arange(len(part)), [len(s) for s in part])
                keys = band_keys(super_min_hash(elements, owners, len(part), bands * rows), bands, rows)
                total = lambda s, c: int((mix(s ^ c)).sum(dtype=np.uint64).view(np.int64))
                yield batch(SIGNED, doc_id=ids[at:end], n=[len(s) for s in part], key_a=[total(s, GOLDEN) for s in part], key_b=[total(s, ODD) for s in part], bands=[keys[i].tolist() if len(s) else [] for i, s in enumerate(part)])
                at = end

    arrow_ready(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(lean(signed), "doc_id long, n long, key_a long, key_b long, bands array<long>")


def full_sets(ids: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """id and the bytes of its shingles, for the given ids."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def cut_up(batches):
        for b in batches:
            yield batch(schema, id=b.column(0), shingles=[shingles(t.as_py(), k).tobytes() for t in b.column(1)])

    ids = stored(ids, "ids")  # so that the planner knows their size: few ids go to the texts, not the texts to them
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("text")).join(ids, "id", "left_semi")
    return cut(texts.mapInArrow(lean(cut_up), "id long, shingles binary"))


def confirm(pairs: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    linked = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    good.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch(linked, a=b.column(0), b=b.column(1)).filter(pa.array(good, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = full_sets(ids, documents, k)
    left, right = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(lean(compared), "a long, b long")


def common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of xs has in common with each of ys."""
    sizes = [len(s) for s in xs + ys]
    _, column = np.unique(np.concatenate(xs + ys), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(xs), len(ys)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        dense = np.zeros((len(sizes), COLUMNS), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += dense[: len(xs)] @ dense[len(xs) :].T
    return out.astype(np.int64)


def across_components(rest: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components within groups of classes (group, rep, n, label), at least one where there are any."""
    sums = rest.groupBy("group", "label").agg(F.count("*").alias("classes"), F.sum("n").alias("n"))
    groups = cut(sums.groupBy("group").agg(F.max_by("label", F.struct("classes", "label")).alias("largest"), F.max_by("n", F.struct("classes", "label")).alias("largest_n"), F.sum("n").alias("all_n")))
    of = lambda n: F.ceil(n / BLOCK).cast("int")
    placed = rest.join(groups, "group").select("group", "rep", "label", (F.col("label") != F.col("largest")).alias("apart"), of(F.col("all_n") - F.col("largest_n")).alias("apart_blocks"), of(F.col("all_n")).alias("all_blocks"))
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    as_apart = F.when(F.col("apart"), F.transform(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda i: F.struct(own(F.col("apart_blocks")).alias("x"), i.alias("y"), F.lit(True).alias("is_x"))))
    as_any = F.transform(F.sequence(F.lit(0), F.col("apart_blocks") - 1), lambda i: F.struct(i.alias("x"), own(F.col("all_blocks")).alias("y"), F.lit(False).alias("is_x")))
    none = F.array().cast("array<struct<x:int,y:int,is_x:boolean>>")
    sets = full_sets(rest.select(F.col("rep").alias("id")).distinct(), documents, k)
    dealt = placed.join(sets, F.col("rep") == F.col("id")).select("group", "rep", "label", "shingles", F.explode(F.concat(F.coalesce(as_apart, none), as_any)).alias("at")).select("group", "rep", "label", "shingles", "at.*")
    linked = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(rows: pa.Table) -> pa.Table:
        rep, label, is_x = (np.array(rows.column(c)) for c in ("rep", "label", "is_x"))
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in rows.column("shingles")]
        x, y = np.nonzero(is_x)[0], np.nonzero(~is_x)[0]
        found: dict = {}
        if len(x) and len(y):
            both = common([sets[i] for i in x], [sets[j] for j in y])
            n = np.array([len(s) for s in sets])
            good = (100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)) & (label[x][:, None] != label[y][None, :])
            for i, j in zip(*np.nonzero(good)):
                found.setdefault((label[x[i]], label[y[j]]), (rep[x[i]], rep[y[j]]))
        return pa.table({"a": [int(a) for a, _ in found.values()], "b": [int(b) for _, b in found.values()]}, schema=linked)

    return dealt.groupBy("group", "x", "y").applyInArrow(compared, "a long, b long")


def met_by_band(rows: DataFrame, table: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` (band, rep, ...) joined with ``table``, which has a row for each of some bands. Rows of ``frequent`` bands meet a
    broadcast copy of theirs, ``FREQUENT`` rows at most, and are dealt out by themselves, so that no task gets all rows of one."""
    others = [c for c in table.columns if c != "band"]
    known = table.join(F.broadcast(frequent), "band", "left_semi").select("band", F.struct(F.lit(True).alias("met"), *others).alias("known"))
    light = table.join(F.broadcast(frequent), "band", "left_anti").select(F.col("band").alias("key"), F.struct(F.lit(True).alias("met"), *others).alias("found"))
    dealt = rows.join(F.broadcast(known), "band", "left").withColumn("key", F.when(F.col("known").isNull(), F.col("band")).otherwise(F.xxhash64("rep")))
    both = dealt.join(light, "key", "left").withColumn("all", F.coalesce("known", "found")).where("all is not null")
    return both.select(*rows.columns, *[F.col(f"all.{c}").alias(c) for c in others])


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, bands: int = 26, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    signed = cut(sign(documents, k, bands, rows))
    keys = ["key_a", "key_b", "n"]
    classes = cut(signed.where("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep")))
    members = signed.select("doc_id", *keys).join(classes, keys, "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    one_each = signed.join(classes, keys).where("doc_id = rep").select("rep", "n", F.explode("bands").alias("band"))
    buckets = cut(one_each.groupBy("band").agg(F.count("*").alias("size"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high"))
    places = buckets.agg(F.sum("size")).first()[0] or 0
    frequent = buckets.where(F.col("size") * FREQUENT >= places).select("band")  # FREQUENT rows at most
    placed = cut(met_by_band(one_each, buckets, frequent))

    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = placed.select(F.explode(F.array(pair(F.col("rep"), F.col("low")), pair(F.col("rep"), F.col("high")))).alias("p")).select("p.*").where("a < b").distinct()
    tested = cut(stars)
    links = cut(confirm(tested, documents, k, percent))

    found = connected_components(links)
    label = F.coalesce("component", "rep")
    labelled = placed.where("size > 2").join(found, F.col("rep") == F.col("node"), "left").select("band", "size", "low", "rep", "n", label.alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("band")
    rest = cut(met_by_band(labelled, mixed, frequent))
    few, many = rest.where(F.col("size") <= SMALL), rest.where(F.col("size") > SMALL)
    x, y = few.alias("x"), few.alias("y")
    fits = F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    across = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.label") != F.col("y.label")) & fits).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    more = cut(across.join(tested, ["a", "b"], "left_anti"))
    found_more = []
    if not more.isEmpty():
        found_more.append(cut(confirm(more, documents, k, percent)))
    if not many.isEmpty():
        grouped = connected_components(many.select(F.col("rep").alias("a"), F.col("low").alias("b")))
        group = F.coalesce("component", "rep").alias("group")
        classes_in = many.select("rep", "n", "label").distinct().join(grouped, F.col("rep") == F.col("node"), "left").select(group, "rep", "n", "label")
        found_more.append(cut(across_components(cut(classes_in), documents, k, percent)))
    if found_more:
        for f in found_more:
            links = links.unionByName(f)
        found = connected_components(links)

    rows_out = members.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return rows_out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_each(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest of their component, with their own columns. Of rows that
    repeat a doc_id one stays; rows without a doc_id all stay.

    Only the ids of rows that may go are written and joined, so that texts move only where there are many."""
    found = near_duplicates(documents, k, percent).where("doc_id is not null")
    marked = found.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1")
    odd = stored(marked.select(F.col("doc_id").alias("odd_id"), "kept"), "copies")
    key = documents.doc_id.cast("long")
    once = documents.join(odd, key == odd.odd_id, "left_anti")
    repeated = documents.join(odd.where("kept"), key == odd.odd_id, "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(repeated)
