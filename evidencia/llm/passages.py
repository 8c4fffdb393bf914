"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words. Each window has a phrase: of its runs of ``PHRASE`` words
the one with the least hash, so that equal windows have equal phrases and neighbouring windows share
one. Documents are dealt into blocks of about ``BLOCK_BYTES``, and the work has three steps:

* Phrases. Each block names its phrases with their number of places, two at most; a phrase with
  two places in the corpus recurs, and every block learns which of its own phrases do.
* Confirmation. The windows of recurring phrases are told by 128-bit digests of their words; each
  block hands over each of its windows once, and of all blocks' documents the smallest that holds
  a window is the one that keeps it.
* Automata. Each block compiles the recurring phrases that it holds into an Aho-Corasick automaton
  of pyahocorasick, one character to a word, and streams its documents through. Around each hit lie
  the recurring windows; all go but those that the document is the one to keep, at their first place.

An automaton thus holds the phrases of one block, never those of the corpus, and every document goes
through one automaton. Of a frequent phrase or window no task gets more than one row for each block.

Null and empty texts have no words. Rows that repeat a doc_id do not remove one another's words, nor do
rows without a doc_id, which count as later than all others and share a block; each row gets its own
result. Words are as they are, in any script; other columns are ignored. Texts are read whole, and a long
one makes a block of its own size. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_ready, release, stored, text_bytes
from .minhash import ODD, mix

#: Words of a phrase, at most.
PHRASE = 8
#: Bytes of text in a block, about, and blocks at least, so that small tables use all executors.
BLOCK_BYTES, LEAST_BLOCKS = 2 << 20, 256
#: Stands for rows without a doc_id.
NO_ID = (1 << 63) - 1
NOTHING = np.uint64((1 << 64) - 1)
#: A word of a block is so many characters, from this one on, so that no state of an automaton has many ways out of it.
DIGITS, FIRST_CHARACTER = 2, 0x10000


def word_hashes(words: list[bytes]) -> np.ndarray:
    """128-bit hashes, as rows of two numbers."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words: a polynomial in ODD, put together from those of runs of 1, 2, 4 words and so on."""
    n = len(hashes) - k + 1
    parts = [np.ascontiguousarray(hashes)]
    while 2 << len(parts) - 1 <= k:
        size = 1 << len(parts) - 1
        parts.append(parts[-1][:-size] * times(size) + parts[-1][size:])
    s, done = parts[-1][:n].copy(), 1 << len(parts) - 1
    for i in range(len(parts) - 2, -1, -1):
        if k >> i & 1:
            s *= times(1 << i)
            s += parts[i][done : done + n]
            done += 1 << i
    return mix(s)


def times(k: int) -> np.uint64:
    """ODD to the power of k."""
    return np.uint64(pow(int(ODD), k, 1 << 64))


def sliding(least, a: np.ndarray, k: int) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of each run of k numbers."""
    size = 1
    while 2 * size <= k:
        a, size = least(a[:-size], a[size:]), 2 * size
    return least(a[: len(a) - (k - size)], a[k - size :]) if k > size else a


class Text:
    """The words of a text, the hashes of its runs of phrase length, and each window's phrase."""

    def __init__(self, text: bytes, window: int):
        self.words, self.window = text.split(), window
        self.length = min(PHRASE, window)
        self.long_enough = len(self.words) >= window
        if self.long_enough:
            self.hashes = word_hashes(self.words)
            self.runs = rolled(self.hashes[:, 0], self.length)
            self.of_windows = sliding(np.minimum, self.runs, window - self.length + 1)

    def phrases(self) -> np.ndarray:
        """Hashes of the places that are the phrase of a window, one for each place."""
        span = self.window - self.length
        edge = np.zeros(span, np.uint64)
        best = sliding(np.maximum, np.concatenate([edge, self.of_windows, edge]), span + 1)
        return self.runs[best == self.runs]

    def recurring(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows whose phrase is at one of the given places (a mask)."""
        held = np.where(at, self.runs, NOTHING)
        return np.flatnonzero(at.any() and (sliding(np.minimum, held, self.window - self.length + 1) == self.of_windows))

    def digests(self, half: int) -> np.ndarray:
        """One of the two halves of each window's digest."""
        return rolled(self.hashes[:, half], self.window).view(np.int64)


def texts(rows: pa.Table, window: int):
    """(doc_id, Text) of a block's rows, ascending."""
    ids = rows.column("doc_id").to_numpy()
    column = rows.column("text")
    for i in np.argsort(ids, kind="stable").tolist():
        yield int(ids[i]), Text(column[i].as_py(), window)


def block_of(documents: DataFrame) -> Column:
    """The block that a doc_id belongs to."""
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return F.pmod(F.xxhash64("doc_id"), F.lit(max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))))


PHRASES = pa.schema([("phrase", pa.int64()), ("block", pa.int64()), ("places", pa.int8())])
WINDOWS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def recurring_phrases(docs: DataFrame, window: int) -> DataFrame:
    """block and phrase of the phrases with two places in the corpus, for the blocks that hold them."""

    def named(rows: pa.Table) -> pa.Table:
        found = [t.phrases() for _, t in texts(rows, window) if t.long_enough]
        phrase, n = np.unique(np.concatenate(found) if found else np.array([], np.uint64), return_counts=True)
        release()
        return pa.table([phrase.view(np.int64), np.full(len(phrase), rows.column("block")[0].as_py()), np.minimum(n, 2).astype(np.int8)], schema=PHRASES)

    each = docs.groupBy("block").applyInArrow(named, "phrase long, block long, places byte")
    return each.withColumn("all", F.sum("places").over(Window.partitionBy("phrase"))).where(F.col("all") > 1).select("block", "phrase")


def window_keepers(docs: DataFrame, phrases: DataFrame, window: int) -> DataFrame:
    """doc_id and digest of the windows of recurring phrases, each with the smallest document that holds it."""

    def confirmed(rows: pa.Table, known: pa.Table) -> pa.Table:
        recurring = np.sort(known.column("phrase").to_numpy())
        a, b, ids = [], [], []
        for doc_id, t in texts(rows, window):
            if t.long_enough and len(recurring):
                at = recurring[np.minimum(np.searchsorted(recurring, t.runs.view(np.int64)), len(recurring) - 1)] == t.runs.view(np.int64)
                starts = t.recurring(at)
                if len(starts):
                    a.append(t.digests(0)[starts]), b.append(t.digests(1)[starts]), ids.append(np.full(len(starts), doc_id))
        if not a:
            return WINDOWS.empty_table()
        a, b, ids = map(np.concatenate, (a, b, ids))
        order = np.lexsort((b, a))  # equal ones stay in the order of doc_id
        a, b, ids = a[order], b[order], ids[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        release()
        return pa.table([a[first], b[first], ids[first]], schema=WINDOWS)

    each = docs.groupBy("block").cogroup(phrases.groupBy("block")).applyInArrow(confirmed, "a long, b long, doc_id long")
    return each.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "a")


def spelled(words: np.ndarray) -> str:
    """The words in characters, ``DIGITS`` to a word: the digits of its number among the block's words. Each place has
    characters of its own, so that a phrase is only found where a word begins."""
    known, number = np.unique(words, return_inverse=True)
    base = 1
    while base**DIGITS < len(known):
        base += 1
    digits = np.stack([number // base**i % base + i * base for i in range(DIGITS)], 1)
    return (digits + FIRST_CHARACTER).astype("<u4").tobytes().decode("utf-32-le")


def hits(block: list[Text], recurring: np.ndarray) -> list[np.ndarray]:
    """For each text the mask of its places where a recurring phrase stands, found by the block's automaton."""
    import ahocorasick

    long = [t for t in block if t.long_enough]
    masks = {id(t): np.zeros(len(t.runs), bool) for t in long}
    if not long or not len(recurring):
        return [masks.get(id(t)) for t in block]
    line = spelled(np.concatenate([t.hashes[:, 0] for t in long]))
    runs = np.concatenate([np.concatenate([t.runs.view(np.int64), np.zeros(t.length - 1, np.int64)]) for t in long])
    phrase, first = np.unique(runs, return_index=True)
    first = first[np.isin(phrase, recurring, assume_unique=True)]
    length, automaton = long[0].length, ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i in first.tolist():
        automaton.add_word(line[DIGITS * i : DIGITS * (i + length)], i)
    automaton.make_automaton()
    at = 0
    for t in long:
        # a text's last places, too short for a phrase, have none in the block either, as texts are streamed one by one
        found = np.fromiter(chain.from_iterable(automaton.iter(line[DIGITS * at : DIGITS * (at + len(t.words))])), np.int64).reshape(-1, 2)
        start = found[:, 0] // DIGITS - length + 1
        masks[id(t)][start] = runs[at + start] == runs[found[:, 1]]
        at += len(t.words)
    return [masks.get(id(t)) for t in block]


def without_repeats(documents: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by a blank) of every document.

    A word goes if a window over it also starts earlier, in a smaller document or before in the same one."""

    def located(rows: pa.Table, known: pa.Table) -> pa.Table:
        docs = list(texts(rows, window))
        of, value = known.column("doc_id").to_numpy(zero_copy_only=False), known.column("value").to_numpy()
        is_phrase = known.column("is_phrase").to_numpy(zero_copy_only=False)
        order = np.argsort(of[~is_phrase], kind="stable")
        keeper, kept_window = of[~is_phrase][order], value[~is_phrase][order]
        out = []
        for (doc_id, t), mask in zip(docs, hits([t for _, t in docs], np.sort(value[is_phrase]))):
            gone = np.zeros(len(t.words) + 1, np.int64)
            if mask is not None and len(starts := t.recurring(mask)):
                own = kept_window[np.searchsorted(keeper, doc_id) : np.searchsorted(keeper, doc_id, "right")]
                digest = t.digests(0)[starts]
                first = np.zeros(len(starts), bool)
                first[np.unique(digest, return_index=True)[1]] = True
                later = starts[~(first & np.isin(digest, own))]
                np.add.at(gone, later, 1)
                np.add.at(gone, later + window, -1)
            removed = np.cumsum(gone)[:-1] > 0
            n = int(removed.sum())
            words = t.words if not n else [t.words[i] for i in np.flatnonzero(~removed).tolist()]
            out.append((None if doc_id == NO_ID else doc_id, len(t.words), n, b" ".join(words)))
        release()
        columns = [pa.array([o[i] for o in out], KEPT.field(i).type) for i in range(3)]
        return pa.table([*columns, pa.array([o[3] for o in out], pa.binary()).cast(pa.string())], schema=KEPT)

    arrow_ready(documents.sparkSession)
    block = block_of(documents)
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_bytes().alias("text")).withColumn("block", block)
    phrases = stored(recurring_phrases(docs, window), "phrases")
    keepers = window_keepers(docs, phrases, window)
    told = phrases.select("block", F.lit(True).alias("is_phrase"), F.lit(0).cast("long").alias("doc_id"), F.col("phrase").alias("value"))
    told = told.unionByName(keepers.select(block.alias("block"), F.lit(False).alias("is_phrase"), "doc_id", F.col("a").alias("value")))
    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(located, "doc_id long, n_words long, n_removed long, kept string")
