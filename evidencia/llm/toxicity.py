"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A written form such as ``1d10t``, ``i.d.i.o.t`` or ``idiiiot`` is a lattice: a digit or sign may
stand for the letters it resembles, a separator may be void or part two words, a run of one letter
may be shorter. So is a run of single characters with blanks between, where each blank is void or
parts two words. The Viterbi algorithm finds the path with the best sum of a channel's costs and of
the log probabilities of a character trigram model, in time linear in the form's length. A word of
letters alone, none of them doubled, has one path and stands as it is; one with doubled letters
stands beside its likeliest path.

The score is logistic in the evidence of restored words: their log odds between toxic and other
documents, learned with the character model from all labelled rows with distinct texts that are not
held out. Words are counted and added up across tasks; the model's letters are counted from the words
and their counts; its weights come from sums over all those rows, one small job for each round. Only
the model itself comes to the driver: words with strong evidence, letter trigrams and five weights.

Null text counts as empty; null labels are passed over; of several labels of one id or one text
the largest counts. Without both labels among them every score is the share of label 1, or 0
without labels. Repeated rows each get their row; other columns are ignored, and kept by
``keep_civil`` whatever their names. An empty table gives no rows. Long texts and long forms are
read whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_ready, batch, lean, remainder, stored, text_bytes
from .packing import Recent

#: Letters that a sign may stand for (fixed values).
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
VOID = set(".-_*'~^,/\\:;#%&=<>[]{}\"`´·•​‌‍﻿­")
STAND_IN, SHORTEN, SKIP = math.log(0.2), math.log(0.3), math.log(0.5)
#: Words of one letter (fixed values), which the character model doesn't learn, and the cost of ending there.
LONE, LONE_END = "aeiouyàô", math.log(0.1)
STRIP = ".,;:!?\"'()[]{}<>#$%&*|-_/\\…«»“”„’‘¿¡~^=+`"
#: Keys that a task holds while it counts.
HELD_KEYS = 200_000

LETTERS = re.compile(r"[^\W\d_]+")
DOUBLE = re.compile(r"(.)\1")
SPACED = re.compile(rb"(?<= )(?:[^ \xc2-\xf4] |[\xc2-\xdf][\x80-\xbf] ){3,}")


@dataclass
class Characters:
    """Trigram model with add-one smoothing on a linear mix with bigrams and letters."""

    counts: dict[str, int]

    def __post_init__(self):
        self.context: dict[str, int] = {}
        for g, n in self.counts.items():
            self.context[g[:-1]] = self.context.get(g[:-1], 0) + n
        self.memo: dict[str, float] = {}

    def log(self, gram: str) -> float:
        """Natural log probability of the last character after the two before."""
        found = self.memo.get(gram)
        if found is None:
            p = 1 / 256
            for g in (gram[2:], gram[1:], gram):
                p = 0.15 * p + 0.85 * self.counts.get(g, 0) / c if (c := self.context.get(g[:-1], 0)) else p
            found = self.memo[gram] = math.log(p)
        return found


def grams(word: str) -> list[str]:
    w = f"^^{word}$"
    return [w[i - k : i + 1] for i in range(2, len(w)) for k in (0, 1, 2)]


def options(written: str) -> list[list[tuple[str, float]]]:
    """For each run of one character, the strings that it may stand for, with log channel costs."""
    lattice = []
    for m in re.finditer(r"(.)\1*", written, re.S):
        c, n = m[1], len(m[0])
        if c in LOOKALIKES:
            found = [(x * k, STAND_IN * min(n, 3) + SHORTEN * (k < n)) for x in LOOKALIKES[c] for k in {1, min(n, 2)}]
            if c in "!|+(":
                found.append(("", SKIP * min(n, 3)))
        elif c in VOID:
            found = [("", SKIP), (" ", SKIP)]
        elif c == " ":
            found = [("", 0.0), (" ", 0.0)]
        elif n == 1:
            found = [(c, 0.0)]
        else:
            found = [(c, SHORTEN), (c * 2, SHORTEN if n > 2 else 0.0)]
        lattice.append(found)
    return lattice


def ending(state: str, model: Characters) -> float:
    """Log probability that a word ends after its last two characters; nothing to end at a word's start."""
    if state == "^^":
        return 0.0
    return LONE_END if state[0] == "^" and state[1] in LONE else model.log(state + "$")


def decode(written: str, model: Characters) -> str:
    """The likeliest words behind a written form, with blanks between."""
    best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for found in options(written):
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (total, path) in best.items():
            for letters, cost in found:
                s, p = state, total + cost
                if letters == " ":
                    if state != "^^":  # at a word's start there is nothing to part
                        p, s = p + ending(s, model), "^^"
                else:
                    for x in letters:
                        p += model.log(s + x)
                        s = s[1] + x
                if s not in after or p > after[s][0]:
                    after[s] = (p, (path, letters) if letters else path)
        best = after
    last = max(best, key=lambda s: best[s][0] + ending(s, model))
    path, found = best[last][1], []
    while path is not None:
        path, letters = path
        found.append(letters)
    return " ".join("".join(reversed(found)).split())


@dataclass
class Model:
    prior: float
    words: dict[str, float] = field(default_factory=dict)
    characters: dict[str, int] = field(default_factory=dict)
    weights: list[float] | None = None


class Restorer:
    """Restored words of texts, with a memo of written forms."""

    def __init__(self, characters: dict[str, int] | None, memo: int = 100_000):
        self.model = Characters(characters) if characters is not None else None
        self.forms = Recent(self.restore, memo)

    def restore(self, form: bytes) -> tuple[str, ...]:
        """Restored words of one form between blanks, already in ASCII lower case."""
        if b" " in form:  # single characters: also glued, as runs of one letter may be shorter
            spaced = form.decode("utf-8", "replace").lower()
            parted = decode(spaced, self.model).split() if LETTERS.search(spaced) else []
            return tuple(dict.fromkeys((*self.restore(form.replace(b" ", b"")), *parted)))
        text = form.decode("utf-8", "replace").lower()
        core = text.strip(STRIP)
        if LETTERS.fullmatch(core) and (self.model is None or not DOUBLE.search(core)) and text.lstrip("\"'([{<«“„’‘¿|-").startswith(core[:1]):
            return (core,)
        plain = tuple(LETTERS.findall(core))
        if self.model is None or not LETTERS.search(text):
            return plain
        signed = text.lstrip("\"'()[]{}<>#%&*-_/\\…«»“”„’‘¿~^=`.,;:").rstrip(STRIP)
        for candidate in {signed, text.rstrip(".,;:?\"'") if text[-1:] in "!$@|+" else signed}:
            if candidate and (word := decode(candidate, self.model)):
                plain += tuple(word.split())
        return tuple(dict.fromkeys(plain))

    def words(self, text: bytes) -> tuple[dict[str, int], int]:
        """Restored words with their numbers of places; how many forms the text has."""
        forms = text.lower().split()
        counts: dict[bytes, int] = {}
        for f in forms:
            counts[f] = counts.get(f, 0) + 1
        if self.model is not None:
            for m in SPACED.finditer(b" " + b" ".join(forms) + b" "):
                run = m[0].strip()
                if len(set(run.replace(b" ", b""))) > 2:
                    counts[run] = counts.get(run, 0) + 1
        out: dict[str, int] = {}
        memo = self.forms
        for f, n in counts.items():
            for w in memo[f]:
                out[w] = out.get(w, 0) + n
        return out, len(forms)


class Evidence(Restorer):
    """Evidence of texts: each form's memo holds only the restored words that the lexicon has."""

    NAMES = ("one", "odds", "best", "places", "forms")

    def __init__(self, model: Model):
        super().__init__(model.characters)
        self.lexicon, self.weights, self.prior = model.words, model.weights, model.prior

    def restore(self, form: bytes) -> tuple[str, ...]:
        return tuple(w for w in super().restore(form) if w in self.lexicon)

    def features(self, text: bytes) -> list[float]:
        found, n = self.words(text)
        odds = sorted((self.lexicon[w] for w in found), reverse=True)
        places = sum(self.lexicon[w] * min(k, 5) for w, k in found.items())
        return [1.0, sum(odds), odds[0] if odds else 0.0, math.log1p(places), math.log1p(n)]

    def score(self, text: bytes) -> float:
        if self.weights is None:
            return self.prior
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(np.dot(self.weights, self.features(text)))))))


def logistic(pairs: DataFrame, ridge: float = 1e-2, rounds: int = 50) -> list[float]:
    """Weights of a logistic regression of y on x by Newton's method; each round adds up its sums over all rows."""
    size = len(Evidence.NAMES)
    w = np.zeros(size)
    penalty = ridge * np.diag([0.0] + [1.0] * (size - 1)) + 1e-9 * np.eye(size)
    schema = pa.schema([("place", pa.int32()), ("value", pa.float64())])
    for _ in range(rounds):

        def summed(batches, w=w):
            total = np.zeros(size * (size + 1))
            for b in batches:
                x = b.column(0).flatten().to_numpy().reshape(-1, size)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
                total += np.concatenate([x.T @ (b.column(1).to_numpy() - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            yield batch(schema, place=np.arange(len(total), dtype=np.int32), value=total)

        sums = np.zeros(size * (size + 1))
        for r in pairs.mapInArrow(summed, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # a row for each sum
            sums[r.place] = r.value
        step = np.linalg.solve(sums[size:].reshape(size, size) + penalty, sums[:size] - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def text_key() -> Column:
    return F.unhex(F.md5("text")).alias("key")


def texts_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))


def marked_texts(documents: DataFrame, labels: DataFrame, mod: int, held: int) -> DataFrame:
    """key and label of the distinct texts of labelled documents that are not held out, with the smallest doc_id that has
    each and its number of rows."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & (remainder("doc_id", mod) != held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    keyed = texts_of(documents).select("doc_id", text_key()).join(marked, "doc_id")
    rows = keyed.groupBy("key", "doc_id").agg(F.max("toxic").alias("toxic"), F.count("*").alias("n"))
    first = rows.groupBy("key").agg(F.max("toxic").alias("toxic"), F.min(F.struct("doc_id", "n")).alias("first"))
    return stored(first.select("key", "toxic", "first.*"), "marked")


def counted_words(documents: DataFrame, marked: DataFrame) -> DataFrame:
    """word, toxic and clean: how many of the marked texts have each restored word."""
    texts = texts_of(documents).withColumn("key", text_key())
    rows = texts.join(marked.where("n = 1").drop("n"), ["doc_id", "key"]).select("text", "toxic")
    again = texts.join(marked.where("n > 1").drop("n"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("text", "toxic")  # rows that repeat

    def counted(batches):
        restorer = Restorer(None)
        yield from added((w, toxic, 1 - toxic) for b in batches for text, toxic in zip(b.column(0), b.column(1).to_pylist()) for w in restorer.words(text.as_py())[0])

    return tallied(rows.unionByName(again), counted)


def counted_grams(words: DataFrame) -> DataFrame:
    """The same of the letters of those words, each as often as its word."""

    def counted(batches):
        yield from added((g, t, c) for b in batches for w, t, c in zip(*(x.to_pylist() for x in b.columns)) if len(w) > 1 for g in grams(w))

    return tallied(words, counted)


def added(counts):
    """Batches of keys with their counts added up, ``HELD_KEYS`` of them at once."""
    schema = pa.schema([("key", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    totals: dict[str, list[int]] = {}

    def given():
        keys = list(totals)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield batch(schema, key=part, toxic=[totals[k][0] for k in part], clean=[totals[k][1] for k in part])
        totals.clear()

    for key, toxic, clean in counts:
        held = totals.get(key)
        if held is None:
            if len(totals) >= HELD_KEYS:
                yield from given()
            totals[key] = [toxic, clean]
        else:
            held[0] += toxic
            held[1] += clean
    yield from given()


def tallied(rows: DataFrame, counted) -> DataFrame:
    return rows.mapInArrow(lean(counted), "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def featured(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, key of the text and features of every document."""
    start = scorer(documents, model)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("x", pa.list_(pa.float64()))])

    def measured(batches):
        evidence = start()
        for b in batches:
            yield batch(schema, doc_id=b.column(0), key=b.column(2), x=[evidence.features(t.as_py()) for t in b.column(1)])

    rows = texts_of(documents).select("doc_id", "text", text_key())
    return stored(rows.mapInArrow(lean(measured), "doc_id long, key binary, x array<double>"), "features")


def learn(documents: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> tuple[Model, DataFrame | None]:
    """The model, and the features of all documents if it has weights."""
    arrow_ready(documents.sparkSession)
    marked = marked_texts(documents, labels, mod, held)
    n = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0), None
    t, c = F.col("toxic"), F.col("clean")
    words = stored(counted_words(documents, marked), "words")
    odds = F.log((t + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))
    sure = odds / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    top = words.filter((t >= 4) & (F.length("key") >= 3)).withColumn("odds", odds).withColumn("sure", sure).filter("odds >= 1.5 and sure >= 3").select("key", "odds").collect()  # the lexicon
    characters = {r.key: r.n for r in counted_grams(words).filter(t + c >= 2).select("key", (t + c).alias("n")).collect()}  # letters by three, two and one
    model = Model(n_toxic / (n_toxic + n_clean), {r.key: float(r.odds) for r in top}, characters)
    rows = featured(documents, model)
    pairs = rows.select("key", "x").join(marked.select("key", "toxic"), "key").dropDuplicates(["key"])
    model.weights = logistic(stored(pairs.select("x", F.col("toxic").cast("double").alias("y")), "pairs"))
    return model, rows


def scorer(documents: DataFrame, model: Model):
    """A function that gives each worker one Evidence for the model."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    arrow_ready(documents.sparkSession)
    return lambda: Evidence(shared.value)


def toxicity_scores(documents: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """doc_id and score of every document."""
    model, rows = learn(documents, labels, mod, held)
    if rows is None:
        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(model.prior).alias("score"))
    total = sum((F.get("x", F.lit(i)) * w for i, w in enumerate(model.weights)), F.lit(0.0))
    return rows.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), total))))).alias("score"))


def keep_civil(documents: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, least: float = 0.5) -> DataFrame:
    """The documents whose score is below ``least``, with their own columns."""
    start = scorer(documents, learn(documents, labels, mod, held)[0])

    def civil(batches):
        evidence = start()
        for b in batches:
            yield b.filter(pa.array([evidence.score((t.as_py() or "").encode()) < least for t in b.column("text")], pa.bool_()))

    return documents.mapInArrow(lean(civil), documents.schema)
