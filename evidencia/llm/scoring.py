"""LM scoring by prediction by partial matching.

A text is its tokens: each word's bytes and a closing blank, and one end sign at last. A byte is
predicted in the context of up to ``ORDER`` bytes before it: with ``across`` the bytes of the
whole text (from a blank before its first word on), else those of its word, the blank before it
included. The trie of contexts holds the bytes seen after each. In a context with T
occurrences of d distinct bytes, one of them with count c has probability c / (T + d); else the
prediction escapes, with probability d / (T + d), to the context that is one byte shorter, where
bytes already seen in the longer one are excluded (method C with symbol exclusion). What no
context has seen is equally likely among the bytes left.

A byte's code length depends on its window alone, which is its context and itself, so it is worked
out once for each distinct window of the corpus. Windows are counted over the whole corpus and
never gathered: all that agree in the last ``LOW`` + 1 bytes of the context lie in one partition,
which builds the higher orders of their trie; only the orders up to ``LOW`` (2**24 entries at most,
by the alphabet and not by the corpus) go to all executors. Order ``ORDER`` so holds at every
size. Words are counted for the base score. Texts find the most frequent words and windows in
broadcast tables of fixed size, all others in a join.

Null text counts as empty: the end sign alone. Without training texts every byte is equally
likely, and the base score is 0 for want of a vocabulary (N = V = 0). Repeated rows each get
their row, and count in training each time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_ready, batch, lean, remainder, row_base, stored, text_bytes

ORDER = 6
#: The highest order that all executors hold.
LOW = 2
FREQUENT = 65_536
#: Places for windows in the broadcast table, for each frequent word.
SLOTS = 128
#: The words' closing sign, and the sign of a text's end; neither byte occurs in a word.
CLOSE, END = 0x20, 0x0A
#: Words that a task gathers before it counts them and hands them on.
GATHER = 2_000_000
#: Windows that a task holds before it merges or scores them, and bytes of text taken at once.
HOLD, CHUNK = 2_000_000, 1_000_000


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Lower-case words of all texts in a row, how many each text has, and each text as words with single blanks."""
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    plain = pa.Array.from_buffers(kind, len(texts), texts.buffers(), texts.null_count, texts.offset)  # ASCII functions need no valid UTF-8
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(plain))
    lists = pc.ascii_split_whitespace(trimmed)
    words = lists.flatten()
    empty = np.asarray(pc.binary_length(trimmed)) == 0  # they have one empty word
    if empty.any():
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words, np.asarray(pc.list_value_length(lists), np.int64) - empty, pc.binary_join(lists, " ")


def as_binary(strings: pa.Array) -> pa.Array:
    return strings.cast(pa.binary()) if pa.types.is_large_string(strings.type) else strings.view(pa.binary())


def word_counts(documents: DataFrame, mod: int, held: int) -> DataFrame:
    """word (binary), training count and whole count of every distinct word."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("all", pa.int64())])

    def counted(batches):
        held_words: dict[bool, list] = {False: [], True: []}
        size = 0

        def flush():
            for outside, parts in held_words.items():
                if parts:
                    found = pa.chunked_array(parts).value_counts()
                    words, n = found.field(0), found.field(1)
                    for at in range(0, len(words), 50_000):
                        part = n.slice(at, 50_000)
                        yield batch(schema, word=as_binary(words.slice(at, 50_000)), c=pa.array(np.zeros(len(part), np.int64)) if outside else part, all=part)
                    parts.clear()

        for b in batches:
            words, n, _ = split_words(b.column(0))
            outside = np.repeat(np.array(b.column(1).to_pylist(), bool), n)
            for k in (False, True):
                held_words[k].append(words.filter(pa.array(outside == k)))
            size += len(words)
            if size > GATHER:
                yield from flush()
                size = 0
        yield from flush()

    rows = documents.select(text_bytes().alias("text"), (remainder("doc_id", mod) == held).alias("held_out"))
    return rows.mapInArrow(lean(counted), "word binary, c long, all long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("all").alias("all"))


def text_windows(texts: pa.Array, order: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """The window (depth and last bytes, as an entry) of every byte to predict, and the number of its text.
    Texts are words with single blanks between; ``order`` is 7 at most."""
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), " \n", pc.binary_join_element_wise(" ", texts, " \n", ""))
    offsets = np.frombuffer(marked.buffers()[1], np.int64 if pa.types.is_large_string(marked.type) else np.int32)[marked.offset : marked.offset + len(marked) + 1].astype(np.int64)
    offsets, data = offsets - offsets[0], memoryview(marked.buffers()[2])[int(offsets[0]) : int(offsets[-1])]
    n, start = len(data), offsets[:-1]
    padded = bytes(7) + bytes(data)
    # each byte with the seven before it, as one big-endian number
    packed = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.int64)
    flat = np.frombuffer(padded, np.uint8)[7:]
    if across:
        found = entry(packed, order)
        for k in range(order):  # the first bytes of a text have shorter contexts
            at = start + k
            at = at[at < offsets[1:]]
            found[at] = entry(packed[at], k)
    else:
        place = np.arange(n)
        blank = np.maximum.accumulate(np.where(flat == CLOSE, place, 0))
        depth = np.append(0, place[1:] - blank[:-1])
        found = entry(packed, np.minimum(depth, order))
    predicted = np.ones(n, bool)
    predicted[start] = False
    return found[predicted], np.repeat(np.arange(len(texts)), np.diff(offsets) - 1)


def chunks(texts: pa.Array):
    """(first, end) of runs of texts of about ``CHUNK`` bytes."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        end = min(len(texts), int(np.searchsorted(ends, before + CHUNK)) + 1)
        yield first, end
        first = end


def entry(packed: np.ndarray, order: int | np.ndarray) -> np.ndarray:
    """A trie entry's number: its order and the last ``order`` + 1 bytes."""
    return np.int64(1) * order << 56 | packed & ((np.int64(1) << 8 * (np.int64(1) * order + 1)) - 1)


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of their counts."""
    by = np.argsort(keys)
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(c[by], first) if len(first) else c for c in counts)


def window_counts(documents: DataFrame, mod: int, held: int, across: bool) -> DataFrame:
    """window and training count (0 if only held-out texts have it) of every distinct window."""
    schema = pa.schema([("window", pa.int64()), ("c", pa.int64())])

    def counted(batches):
        merged = (np.zeros(0, np.int64),) * 2
        waiting, size = [], 0

        def merge():
            return summed(*(np.concatenate(x) for x in zip(merged, *waiting)))

        def given():
            for at in range(0, len(merged[0]), 100_000):
                yield batch(schema, **{n: x[at : at + 100_000] for n, x in zip(schema.names, merged)})

        for b in batches:
            out = np.array(b.column(1).to_pylist(), bool)
            texts = split_words(b.column(0))[2]
            for first, end in chunks(texts):
                found, owner = text_windows(texts.slice(first, end - first), ORDER, across)
                outside = out[first:end][owner]
                for part, weight in ((found[~outside], 1), (found[outside], 0)):
                    keys, n = np.unique(part, return_counts=True)
                    waiting.append((keys, n * weight))
                    size += len(keys)
                if size > HOLD:
                    merged = merge()
                    waiting, size = [], 0
                    if len(merged[0]) > 2 * HOLD:
                        yield from given()
                        merged = (np.zeros(0, np.int64),) * 2
        merged = merge()
        yield from given()

    rows = documents.select(text_bytes().alias("text"), (remainder("doc_id", mod) == held).alias("held_out"))
    return rows.mapInArrow(lean(counted), "window long, c long").groupBy("window").agg(F.sum("c").alias("c"))


def orders(windows: np.ndarray, counts: np.ndarray, lowest: int, highest: int) -> tuple[np.ndarray, np.ndarray]:
    """The trie's entries of some orders, with their counts."""
    found = []
    for k in range(lowest, highest + 1):
        deep = (windows >> 56 >= k) & (counts > 0)
        found.append(summed(entry(windows[deep], k), counts[deep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def low_orders(windows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the orders up to ``LOW``, of all windows."""
    schema = pa.schema([("entry", pa.int64()), ("n", pa.int64())])

    def counted(batches):
        merged = (np.zeros(0, np.int64),) * 2
        waiting = []
        for b in batches:
            waiting.append(orders(np.array(b.column(0)), np.array(b.column(1)), 0, LOW))
            if len(waiting) == 200:
                merged = summed(*(np.concatenate(x) for x in zip(merged, *waiting)))
                waiting = []
        merged = summed(*(np.concatenate(x) for x in zip(merged, *waiting)))
        yield batch(schema, entry=merged[0], n=merged[1])

    found = windows.where("c > 0").select("window", "c").mapInArrow(lean(counted), "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
    return np.array(found.column("entry"), np.int64), np.array(found.column("n"), np.int64)


def window_keys(windows: np.ndarray) -> pa.Array:
    """Join keys that no word and no text can be."""
    keys = np.full((len(windows), 9), CLOSE, np.uint8)
    keys[:, 1:] = windows.astype(">i8").view(np.uint8).reshape(-1, 8)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(9), len(windows), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def slot(windows: np.ndarray, slots: int) -> np.ndarray:
    """A place below ``slots`` from the product's high bits, which depend on every bit of the window."""
    spread = windows.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(32)
    return ((spread * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def scored_windows(windows: DataFrame, slots: int) -> DataFrame:
    """window, training count, slot in the broadcast table and log10 probability of every distinct window."""
    low = windows.sparkSession.sparkContext.broadcast(low_orders(windows))
    schema = pa.schema([("window", pa.int64()), ("c", pa.int64()), ("slot", pa.int64()), ("score", pa.float64())])

    def scored(batches):
        held, size = [], 0

        def flush(rows):
            found, c = rows[0], rows[1]
            high = orders(found, c, LOW + 1, ORDER)
            trie = Trie(*(np.concatenate(x) for x in zip(low.value, high)), ORDER)
            score = trie.log10(found & ((1 << 56) - 1), found >> 56)
            for at in range(0, len(found), 100_000):
                part = found[at : at + 100_000]
                yield batch(schema, window=part, c=c[at : at + 100_000], slot=slot(part, slots), score=score[at : at + 100_000])

        for b in batches:
            held.append([np.array(b.column(i), np.int64) for i in range(3)])
            size += b.num_rows
            if size > HOLD // 2:
                rows = [np.concatenate(x) for x in zip(*held)]
                whole = int(np.searchsorted(rows[2], rows[2][-1]))  # the last group may go on
                if whole:
                    yield from flush([x[:whole] for x in rows])
                held = [[x[whole:] for x in rows]]
                size = size - whole if whole else 0
        if held:
            yield from flush([np.concatenate(x) for x in zip(*held)])

    # groups of windows whose contexts end alike; shorter contexts need no higher orders
    group = F.shiftright("window", 8).bitwiseAND((1 << 8 * (LOW + 1)) - 1)
    placed = windows.select("window", "c", group.alias("group")).repartition("group").sortWithinPartitions("group")
    return placed.mapInArrow(lean(scored), "window long, c long, slot long, score double")


def frequent_windows(windows: DataFrame, most: int) -> pa.Table:
    """window and score of the windows at least so frequent that ``most`` are at hand, rare ones first."""
    level = F.floor(F.log2("c") * 8).cast("int")  # of counts up to 2**63, so few rows
    sizes = {r.level: r.n for r in windows.where("c > 0").groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    least, held = 512, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        least = k
    found = windows.where("c > 0").where(level >= least).select("window", "score", "c").toArrow()
    return found.sort_by([("c", "ascending"), ("window", "ascending")]).select(["window", "score"])


class Trie:
    """Arrays sorted by entry and by context, and what prediction needs of each context."""

    def __init__(self, entries: np.ndarray, counts: np.ndarray, order: int):
        by = np.argsort(entries)
        self.order, self.entries, self.counts = order, entries[by], counts[by].astype(np.float64)
        del by
        contexts = self.entries >> 8  # the order stays in the high bits
        first = np.flatnonzero(np.diff(contexts, prepend=-1))
        self.contexts = contexts[first]
        self.distinct = np.diff(first, append=len(contexts)).astype(np.float64)
        self.total = np.add.reduceat(self.counts, first) if len(first) else np.zeros(0)
        # of each context: what its bytes count in the context one byte shorter
        own = np.zeros(len(contexts))
        for at in range(0, len(contexts), 1 << 18):
            part = self.entries[at : at + (1 << 18)]
            k = part >> 56
            own[at : at + (1 << 18)] = self.count(np.where(k > 0, entry(part & ((1 << 56) - 1), np.maximum(k - 1, 0)), -1))
        self.excluded = np.add.reduceat(own, first) if len(first) else np.zeros(0)

    def count(self, entries: np.ndarray) -> np.ndarray:
        if not len(self.entries):
            return np.zeros(len(entries))
        at = np.minimum(np.searchsorted(self.entries, entries), len(self.entries) - 1)
        return np.where(self.entries[at] == entries, self.counts[at], 0.0)

    def log10(self, packed: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """log10 probability of each packed byte after its context."""
        out = np.zeros(len(packed))
        open_ = np.arange(len(packed))
        gone_n, gone_d = np.zeros(len(packed)), np.zeros(len(packed))
        for k in range(self.order, -1, -1):
            if not len(self.contexts):
                break
            i = open_[depth[open_] >= k]
            keys = entry(packed[i], k)
            at = np.minimum(np.searchsorted(self.contexts, keys >> 8), len(self.contexts) - 1)
            known = self.contexts[at] == keys >> 8
            i, keys, at = i[known], keys[known], at[known]
            t, d, c = self.total[at] - gone_n[i], self.distinct[at] - gone_d[i], self.count(keys)
            hit = c > 0
            out[i[hit]] += np.log10(c[hit] / (t[hit] + d[hit]))
            miss = ~hit & (d > 0)
            out[i[miss]] += np.log10(d[miss] / (t[miss] + d[miss]))
            missed = ~hit
            gone_n[i[missed]], gone_d[i[missed]] = self.excluded[at[missed]], self.distinct[at[missed]]
            done = np.zeros(len(packed), bool)
            done[i[hit]] = True
            open_ = open_[~done[open_]]
        seen = self.distinct[0] if len(self.contexts) else 0.0  # of the empty context
        out[open_] -= np.log10(np.maximum(256 - seen, 1))
        return out


PARTS = pa.schema([("row", pa.int64()), ("key", pa.binary()), ("times", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
PARTS_DDL = "row long, key binary, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def score_texts(documents: DataFrame, mod: int = 7, held: int = 2, across: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = documents.sparkSession
    arrow_ready(spark)
    words = stored(word_counts(documents, mod, held))
    texts = documents.where(remainder("doc_id", mod) != held).count()
    n, v = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + texts, v + (texts > 0)
    room = n + v + 1

    def base(c):
        return np.log10((np.asarray(c, np.float64) + 1) / room)

    based_schema = pa.schema([("key", pa.binary()), ("known", pa.int64()), ("word_base", pa.float64()), ("word_score", pa.float64())])

    def based(batches):
        for b in batches:
            yield batch(based_schema, key=b.column(0), known=(np.array(b.column(1)) > 0).astype(np.int64), word_base=base(np.array(b.column(1))), word_score=np.zeros(b.num_rows))

    slots = SLOTS * FREQUENT
    windows = stored(scored_windows(stored(window_counts(documents, mod, held, across)), slots))
    best = frequent_windows(windows, slots // 4)
    near = spark.sparkContext.broadcast((np.array(best.column("window"), np.int64), np.array(best.column("score"), np.float64)))
    del best

    def spread_out():
        """Window (-1 if none) and score of every slot; of windows with one slot the most frequent, which comes last."""
        placed, placed_score = np.full(slots, -1, np.int64), np.zeros(slots)
        at = slot(near.value[0], slots)
        placed[at], placed_score[at] = near.value
        return placed, placed_score

    top = words.orderBy(F.desc("all"), "word").limit(FREQUENT).toArrow()
    top_words, top_counts = top.column("word").combine_chunks(), np.array(top.column("c"), np.float64)
    # the last place is for words that aren't frequent
    values = spark.sparkContext.broadcast((top_words.to_pylist(), np.stack([np.append(top_counts > 0, 0), np.append(base(top_counts), 0)])))
    end_base, end_known = float(base(texts)), int(texts > 0)
    del top, top_words, top_counts
    pa.default_memory_pool().release_unused()
    table = words.select("word", "c").mapInArrow(lean(based), "key binary, known long, word_base double, word_score double")

    def unplaced(batches):
        placed, _ = spread_out()
        for b in batches:
            found = np.array(b.column(0), np.int64)
            far = placed[np.array(b.column(1), np.int64)] != found
            m = int(far.sum())
            yield batch(based_schema, key=window_keys(found[far]), known=np.zeros(m, np.int64), word_base=np.zeros(m), word_score=np.array(b.column(2), np.float64)[far])

    table = table.unionAll(windows.select("window", "slot", "score").mapInArrow(lean(unplaced), "key binary, known long, word_base double, word_score double"))

    def parts(batches):
        frequent, known = values.value
        frequent = pa.array(frequent, pa.binary())
        placed = spread_out()
        row = row_base()
        none = known.shape[1] - 1
        for b in batches:
            words, n_words, joined = split_words(b.column(1))
            words = as_binary(words)
            owner = np.repeat(np.arange(b.num_rows), n_words)
            at = pc.fill_null(pc.index_in(words, frequent), none).to_numpy()
            n_known, total = (np.bincount(owner, values_of[at], b.num_rows) for values_of in known)
            yield from rare_words(words.filter(pa.array(at == none)), owner[at == none], row)
            score = np.zeros(b.num_rows)
            for first, end in chunks(joined):
                score[first:end], others = known_windows(joined.slice(first, end - first), *placed)
                yield rest(others[0] + (row + first), window_keys(others[1]), others[2])
            rows = row + np.arange(b.num_rows)
            yield batch(PARTS, row=rows, key=pa.array([b" %d" % r for r in rows.tolist()], pa.binary()), times=np.ones(b.num_rows, np.int64), doc_id=b.column(0), held_out=b.column(2), n_tokens=n_words + 1, n_known=n_known.astype(np.int64) + end_known, base=total + end_base, score=score)
            row += b.num_rows

    def rare_words(words, owner, row):
        """(document, word, times) of words that the broadcast table lacks."""
        if not len(words):
            return
        coded = words.dictionary_encode()
        pairs, times = np.unique(owner * np.int64(len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
        yield rest(pairs // len(coded.dictionary) + row, coded.dictionary.take(pa.array(pairs % len(coded.dictionary))), times)

    def known_windows(joined, placed, placed_score):
        """Each text's sum over the windows of the broadcast table; (text, window, times) of all others."""
        found, owner = text_windows(joined, ORDER, across)
        at = slot(found, slots)
        hit = placed[at] == found
        score = np.bincount(owner, np.where(hit, placed_score[at], 0.0), len(joined))
        owner, found = owner[~hit], found[~hit]
        by = np.lexsort((found, owner))
        owner, found = owner[by], found[by]
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
        return score, (owner[new], found[new], np.diff(new, append=len(found)))

    def rest(rows, keys, times):
        nothing = {name: pa.nulls(len(rows), PARTS.field(name).type) for name in PARTS.names[3:]}
        return batch(PARTS, row=rows, key=keys, times=times, **nothing)

    taken = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), (remainder("doc_id", mod) == held).alias("held_out"))
    # a document's own row carries a key that no word can be, so that both kinds of rows spread evenly
    met = taken.mapInArrow(lean(parts), PARTS_DDL).join(table, "key", "left")
    add = lambda own, word: (F.coalesce(F.sum(own), F.lit(0)) + F.coalesce(F.sum(F.col("times") * F.col(word)), F.lit(0))).alias(own)
    out = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), add("n_known", "known"), add("base", "word_base"), add("score", "word_score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
