"""Prefix tree, filter audit and substring dedup against brute force, SQL and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from evidencia.llm import audit, passages, prefixes, toxicity
from evidencia.llm.oracles import oracle_sql
from scripts.compare import compare

from .test_operators import EDGE, prose

TURNS = "conv_id long, turn long, role string, text string, depth long, owner string, a long, leaves int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], TURNS)


# --- prefix tree


def regrown_plainly(rows):
    own = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def tree_plainly(grown):
    nodes = {}
    for c, turns in grown.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for p, members in nodes.items():
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(members) if len(grown[c]) == len(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def tree(spark, rows):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r[n] for n in names) for r in prefixes.prefix_tree(prefixes.regrown(chats(spark, rows))).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_tree_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(prefixes, "RUN_BITS", seed + 1)
    monkeypatch.setattr(prefixes, "FREQUENT", 3)
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "ab", "é"])) for c in r.sample(range(60), 45) for t in range(r.randint(1, 11))]
    rows += [(c, t, "user", "same") for c in range(100, 130) for t in range(3)]  # one conversation many times over
    rows += [(200, t, "user", "same") for t in range(40)]  # a long one
    r.shuffle(rows)
    got = tree(spark, rows)
    assert len(got) == len(set(got)) and set(got) == tree_plainly(regrown_plainly(rows))


def test_tree_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "x"), (1, 2, "user", "x"), (1, 2, "assistant", None), (2, 5, "user", ""), (2, None, "user", "long " * 20_000), (None, 1, "user", "nobody's"), (3, 1, "", ""), (7, 1, "user", "x"), (5, 1, "user", "y")]
    assert set(tree(spark, rows)) == tree_plainly(regrown_plainly(rows))
    assert tree(spark, []) == []
    assert tree(spark, [(None, 1, "user", "x")]) == []


# --- filter audit


def audit_by_sql(spark, documents, labels):
    db = duckdb.connect()
    for name, rows, columns in (("documents", documents, "doc_id bigint, text varchar, lang varchar"), ("labels", labels, "doc_id bigint, quality integer, toxic integer")):
        db.execute(f"create table {name} ({columns})")
        if rows:
            db.executemany(f"insert into {name} values (?, ?, ?)", rows)
    docs = spark.createDataFrame([(*d, 1, "x", "y", 3) for d in documents], "doc_id long, text string, lang string, fails long, part string, text_key string, copies long")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = audit.filter_audit(docs, told)
    return compare(frame, db.execute(oracle_sql()["op12_filter_audit"])), frame


def test_audit_matches_sql_and_the_definition(spark):
    r = random.Random(4)
    texts = [prose(1, 150), prose(2, 40), prose(3, 150) + " #", ("UP " * 120), "same words " * 80, *EDGE[:6]]
    documents = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(80)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 80, 2)]
    difference, frame = audit_by_sql(spark, documents, labels)
    assert difference == ""
    rows = frame.where("part = 'en'").collect()
    seen = set()
    fails = []
    for i, text, lang in documents:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        marks = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": text in seen}
        seen.add(text)
        if lang == "en":
            fails.append({f for f, failed in marks.items() if failed})
    assert len(rows) == 600 and {x.filter_order for x in rows} == {"".join(o) for o in itertools.permutations("ABCDE")}
    for x in rows:
        before, f = set(x.filter_order[: x.step - 1]), x.filter_order[x.step - 1]
        left = [s for s in fails if not s & before]
        assert (x.kept, x.removed, x.redundant, x.unique_fails) == (sum(f not in s for s in left), sum(f in s for s in left), sum(f in s and bool(s & before) for s in fails), sum(s == {f} for s in fails))
    for f in "ABCDE":
        assert len({x.shapley for x in rows if x.filter_order[x.step - 1] == f}) == 1
    assert sum(x.shapley for x in rows if x.filter_order == "ABCDE") == 120 * sum(map(bool, fails))


def test_audit_of_odd_rows(spark):
    long, other = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(200))
    documents = [(1, long, "en"), (1, long, "en"), (1, other, "en"), (None, long, "en"), (None, long, "en"), (2, long, "fr"), (3, None, None), (4, "", "en")]
    _, frame = audit_by_sql(spark, documents, [(1, 1, 0), (1, 0, 1), (None, 1, 1), (9, 1, 1)])
    last = {(x.part, x.filter_order): x for x in frame.where("step = 5 and filter_order = 'ABCDE'").collect()}
    assert last["en", "ABCDE"].kept == 5  # those that repeat an id or have none are no copies
    assert last["fr", "ABCDE"].removed == 1 and (last["", "ABCDE"].kept, last["", "ABCDE"].redundant) == (0, 0)
    first = {x.part: x for x in frame.where("step = 1 and filter_order = 'EDCBA'").collect()}
    assert (first["en"].good_lost, first["en"].toxic_lost, first["en"].kept) == (0, 0, 5)
    assert audit_by_sql(spark, [], [])[1].count() == 0


# --- substring dedup


def kept_plainly(documents, window):
    seen, out = {}, {}
    for i, text in sorted(documents, key=lambda d: d[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[p : p + window]), (i, p)) != (i, p):
                gone[p : p + window] = [True] * window
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def without_repeats(spark, documents, window):
    frame = spark.createDataFrame([(*d, 1, "x", 2, 3) for d in documents], "doc_id long, text string, block long, phrase string, kept long, n_words int")
    return passages.without_repeats(frame, window)


@pytest.mark.parametrize(("window", "blocks"), [(20, 3), (20, 256), (5, 7), (12, 1), (1, 4)])
def test_repeats_match_brute_force(spark, monkeypatch, window, blocks):
    monkeypatch.setattr(passages, "LEAST_BLOCKS", blocks)
    r = random.Random(window * blocks)
    shared = [prose(i, r.randint(window, 4 * window)) for i in range(5)]
    documents = []
    for i in r.sample(range(1000), 60):
        parts = [r.choice([prose(1000 + i * 7 + j, r.randint(1, 60)), r.choice(shared), " ".join(r.choice(shared).split()[r.randint(0, 5) :]), "so so " * r.randint(1, 30)]) for j in range(r.randint(0, 4))]
        documents.append((i, r.choice([" ", "\n", " \t "]).join(parts)))
    documents += [(2000 + i, documents[0][1]) for i in range(4)] + [(3000 + i, t) for i, t in enumerate(EDGE)] + [(4000, "a " * 300), (4001, "A " * 50)]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in without_repeats(spark, documents, window).collect()}
    assert got == kept_plainly(documents, window)


def test_repeats_of_odd_rows(spark):
    long = prose(1, 60)
    documents = [(1, long), (1, long), (None, long), (None, prose(2, 60)), (None, prose(2, 60)), (2, prose(3, 30) + "\u00a0" + long), (3, "\u2003".join(["x"] * 50))]
    got = sorted(((x.doc_id, x.n_words, x.n_removed) for x in without_repeats(spark, documents, 20).collect()), key=str)
    # equal ids don't remove one another's words, nor do rows without one; blanks beyond ASCII belong to words
    assert got == sorted([(1, 60, 0), (1, 60, 0), (None, 60, 60), (None, 60, 0), (None, 60, 0), (2, 89, 59), (3, 1, 0)], key=str)
    assert without_repeats(spark, [], 20).count() == 0


def test_a_window_has_the_phrase_of_its_words_alone():
    text = passages.Text((prose(4, 300) + " the the the the " * 9).encode(), 20)
    for start in range(len(text.words) - 19):
        alone = passages.Text(b" ".join(text.words[start : start + 20]), 20)
        assert alone.of_windows[0] == text.of_windows[start]
    named = set(text.phrases().tolist())
    assert set(text.of_windows.tolist()) == named


# --- toxicity


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_KEYS", 7)
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(3))
    rows = [(i, f"calm{word(i % 50)} words here " + ("blorgh" if i % 4 == 0 else "gentle")) for i in range(22000)] + [(5, None), (4, "calm twice"), (4, "calm twice")]
    documents = spark.createDataFrame([r for r in rows if r[0] < 22000], "doc_id long, text string").withColumn("text", F.concat("text", F.lit(" "), F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij")))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(22000)], "doc_id long, toxic int")
    marked = toxicity.marked_texts(documents, labels, 5, 0)
    learned = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(22000))
    assert marked.count() in range(learned, learned + 3)
    counts = {r.key: (r.toxic, r.clean) for r in toxicity.counted_words(documents, marked).where("key in ('blorgh', 'gentle', 'twice')").collect()}
    toxic = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(0, 22000, 4))
    assert counts["blorgh"] == (toxic, 0) and counts["gentle"] == (0, learned - toxic)
    assert sum(counts.get("twice", (0, 0))) == (zlib.crc32(b"4") % 5 != 0)
