"""Operators on small fixtures, against brute force, exact round trips and plain rules."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from evidencia.llm import chat, decontaminate, embeddings, licenses, minhash, packing, quality, scoring, toxicity, urls
from evidencia.llm.graph import connected_components

DOC = "doc_id long, text string, extra string, n long, rep long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts, first)], DOC)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def edited(text, *places):
    words = text.split()
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


EDGE = [None, "", "  \n ", "one", "two words", "ß É 中文   x", "a" * 50_000, prose(9, 20_000)]


# --- license scan


def test_license_base_rules_and_fuzzy_spans(spark):
    texts = ["MIT-License, the mit  license", "Released under teh MIT Licence.", "GNU General Public\nLicense", "permit license", *EDGE]
    rows = {r.doc_id: r for r in licenses.license_scan(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels, rows[0].n_words) == (2, 0, 3, ["mit"], 5)
    assert rows[1].n_base == 0 and rows[1].first_word is None and rows[1].labels == ["mit"] and 0.8 < rows[1].score < 1
    span = rows[1].spans[0]
    assert (span.first_word, span.end_word) == (0, 5) and span.edits == 3
    assert rows[2].base_labels == ["gpl"] and rows[3].n_base == 0
    assert rows[4].n_words == 0 and rows[4].score == 0
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        assert rows[i].n_words == len(pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))
    assert licenses.license_scan(docs(spark, [])).count() == 0


def test_license_seeds_cover_every_bounded_edit():
    for notice in licenses.NOTICES:
        k = licenses.errors_allowed(notice)
        r = random.Random(notice)
        for _ in range(10):
            s = list(notice)
            for _ in range(k):
                s[r.randrange(len(s))] = "q"
            found = licenses.scan(f"xx {''.join(s)} yy".encode())
            assert found["spans"], notice


# --- decontamination


def test_reparameterised_item_is_caught_and_inconsistent_slots_are_not(spark):
    item = "yesterday evening John bought 12 apples and gave John 12 more because nobody else wanted any of them at the market"
    changed = item.replace("John", "Maria").replace("12", "40")
    mixed = "yesterday evening Maria bought 12 apples and gave Pete 40 more"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    texts = [f"{prose(1, 50)}. {changed} {prose(2, 9)}", item, prose(3, 400), mixed, *EDGE]
    found = decontaminate.contaminated(docs(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 1), (1, 1)}
    assert all(r.n_slots >= 2 for r in found)
    kept = {r.doc_id for r in decontaminate.keep_clean(docs(spark, texts), bench).collect()}
    assert kept == set(range(2, len(texts)))
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def plain_words(text):
    import regex

    text = re.sub(r"[.,](?=[0-9])(?<=[0-9].)", "", (text or "").replace("\x01", " "))
    named = regex.sub(r"(?<=[\p{Ll}\p{N},;] )\p{Lu}(?=\p{Ll})", lambda m: "\x01" + m[0], text)
    words = [w for w in regex.split(r"[^\p{L}\p{N}\x01]+", named.lower()) if w]
    return words, [2 if w[0] == "\x01" else 1 if "0" <= w[0] <= "9" else 3 if w in decontaminate.UNITS else w for w in words]


def brute_contaminated(texts, items):
    """(document, item, windows) by the definition, over two dictionaries of texts."""
    w, want = decontaminate.WINDOW, set()
    split = {d: plain_words(t) for d, t in texts.items()}
    for i, b in items.items():
        bw, bk = plain_words(b)
        where = {}
        for q in range(len(bk) - w + 1):
            where.setdefault(tuple(bk[q : q + w]), []).append(q)
        for d, (dw, dk) in split.items():
            shifts = {}
            for p in range(len(dk) - w + 1):
                for q in where.get(tuple(dk[p : p + w]), ()):
                    places, slots = shifts.setdefault(p - q, (set(), set()))
                    places.add(q)
                    slots |= {(bw[q + j], dw[p + j]) for j in range(w) if isinstance(bk[q + j], int)}
            places = set().union(*(p for p, s in shifts.values() if len(s) == len({x for x, _ in s})), set())
            if len(bk) >= w and places and (len(places) >= decontaminate.LEAST_SHARE * (len(bk) - w + 1) or len(places) >= decontaminate.LEAST_WINDOWS):
                want.add((d, i, len(places)))
    return want


def test_decontamination_matches_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["red", "blue", "km", "7", "13", "Anna", "Ben", "the", "a", "of", "ran", "sat"]
    text = lambda n: "Start " + " ".join(r.choice(vocabulary) for _ in range(n))
    items = [text(14) for _ in range(6)]
    texts = [text(30) + " " + (items[i % 6].replace("Anna", "Zoe") if i % 2 else "") + " " + text(20) for i in range(40)]
    got = {(x.doc_id, x.item_id, x.n_windows) for x in decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = brute_contaminated(dict(enumerate(texts)), dict(enumerate(items)))
    assert got == want and want


def test_windows_that_equal_the_item_count_beside_an_inconsistent_slot(spark):
    item = "the old keeper counted 12 boats at dawn and wrote the number down in a book before the tide came in and took 12 away"
    texts = [item[:-7] + "13 away", item.replace("12 boats", "13 boats").replace("took 12", "took 14"), "she counted 12 boats at dawn"]
    found = {r.doc_id: r.n_windows for r in decontaminate.contaminated(docs(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    words = item.split()
    runs = [words[i : i + 5] for i in range(len(words) - 4)]
    assert found == {0: sum("12" not in r for r in runs[10:]) + 10, 1: sum("12" not in r for r in runs)}


# --- vectors


def brute_vectors(rows, cosine):
    ok = {}
    for n, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            ok[n] = np.array(v, float) / np.linalg.norm(v)
    links = {n: set() for n in range(len(rows))}
    for a, b in itertools.combinations(ok, 2):
        if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
            links[a].add(b)
            links[b].add(a)
    low = {n: rows[n][0] for n in links}
    for _ in rows:
        for n in links:
            low[n] = min([low[n], *(low[m] for m in links[n])])
    return sorted((rows[n][0], len(links[n]), low[n]) for n in links)


def test_vectors_match_brute_force(spark):
    g = np.random.default_rng(1)
    base = g.standard_normal((60, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(200):
        rows.append((100 + i, (base[i % 20] + 0.3 * g.random() * g.standard_normal(64)).tolist()))
    rows += [(900, rows[3][1]), (901, rows[3][1]), (901, rows[3][1]), (902, None), (903, [0.0] * 64), (904, [float("nan")] * 64), (905, [float("inf")] * 64), (906, [1.0] * 3), (907, [None] + [1.0] * 63), (908, [])]
    frame = spark.createDataFrame([(i, v, 1, i) for i, v in rows], "vec_id long, embedding array<double>, label int, rep long")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(frame).collect())
    want = brute_vectors(rows, 0.95)
    assert sum(n for _, n, _ in got) >= 0.97 * sum(n for _, n, _ in want)
    assert sum(a == b for a, b in zip(got, want)) >= 0.95 * len(want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_narrow_blocks_lose_no_pairs_at_the_least_similarity(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 4)
    g = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(g.standard_normal((400, 64)))
    aside = g.standard_normal((400, 64))
    aside = unit(aside - (aside * a).sum(1, keepdims=True) * a)
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * aside
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    linked = sum(r.n_links > 0 for r in embeddings.near_vectors(frame).collect())
    assert linked >= 0.99 * 800, linked


@pytest.mark.parametrize("parts, held", [(8, 1 << 20), (3, 1)])
def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch, parts, held):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    monkeypatch.setattr(embeddings, "LEAST_TILES", parts)
    monkeypatch.setattr(embeddings, "MOST_HELD", held)
    plans, plain = [], embeddings.cut

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(embeddings, "cut", cut)
    g = np.random.default_rng(5)
    base = g.standard_normal((30, 16)).astype(np.float32)
    rows = [(i, (base[i % 30] * (1 + i % 3) + 0.02 * (i % 7) * g.standard_normal(16)).astype(np.float32).tolist()) for i in range(300)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    want = brute_vectors(rows, 0.95)
    assert sum(n for _, n, _ in want) > 2000 and sum(n for _, n, _ in got) >= 0.99 * sum(n for _, n, _ in want)
    assert sum(a == b for a, b in zip(got, want)) >= 0.9 * len(want)
    pairs = [p for p in plans if "j_raw" in p]
    assert len(pairs) == 1 and "Exchange" not in pairs[0]


def test_counts_are_calibrated():
    assert embeddings.least_count(24, 0.9545, 0.998) == 19
    assert embeddings.least_count(8, 1.0, 0.9) == 8


# --- near-duplicate documents


def brute_documents(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    low = list(range(len(texts)))
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return sorted((i, len(s), low[i]) for i, s in enumerate(sets))


def test_near_duplicates_match_brute_force(spark):
    texts = []
    for i in range(12):
        t = prose(i, 120 + 7 * i)
        texts += [t, t.upper(), edited(t, 5), edited(t, 5, 60), edited(t, 5, 60, 90), edited(t, 5, 60, 90, 30), edited(t, *range(0, 100, 3))]
    texts += [*EDGE, *EDGE, "a b c", "A  b\tc", "a b d"]
    random.Random(3).shuffle(texts)
    for k in (4, 5):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts), k).collect())
        assert got == brute_documents(texts, k, 80)
    kept = {r.doc_id for r in minhash.keep_one_each(docs(spark, texts)).collect()}
    assert kept == {i for i, _, low in brute_documents(texts, 5, 80) if i == low}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("small", [2, 1000])
def test_a_hub_joins_texts_that_agree_in_a_band_alone(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 1500)
    monkeypatch.setattr(minhash, "COLUMNS", 512)
    base = prose(77, 160)
    texts = [edited(base, i, 150 - i) for i in range(1, 60)] + [base]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts), 4).collect())
    assert got == brute_documents(texts, 4, 80)


def test_super_min_hash_is_the_rank_by_rank_minimum_and_estimates_jaccard():
    g = np.random.default_rng(0)
    pool = g.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.unique(pool[:n]) for n in (1, 3, 40, 900)] + [np.unique(pool[300:1200])]
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    together = minhash.super_min_hash(np.concatenate(sets), owners, len(sets), 130)
    for i, s in enumerate(sets):
        alone = minhash.super_min_hash(s, np.zeros(len(s), int), 1, 130)
        assert (alone[0] == together[i]).all() and np.isfinite(alone).all()
        assert len(s) > 1 or sorted(np.floor(alone[0])) == list(range(130))
    assert abs((together[3] == together[4]).mean() - 0.5) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (5, 5)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90}


# --- classifiers


def test_quality_learns_and_keeps_columns(spark):
    good = [prose(i, 80) + "." for i in range(40)]
    bad = ["### $$$ " * 20 + prose(i, 5).upper() for i in range(40)]
    frame = docs(spark, good + bad + EDGE)
    labels = spark.createDataFrame([(i, int(i < 40), None) for i in range(80)] + [(0, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in quality.quality_scores(frame, labels).collect()}
    assert len(scores) == 80 + len(EDGE) and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[i] >= 0.7) == (i < 40) for i in range(80))
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} >= set(range(40))
    none = quality.quality_scores(frame, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(frame.limit(0), labels).count() == 0


def test_deobfuscation_restores_words():
    counts = {}
    for w in ["idiot", "stupid", "trash", "clown", "moron", "loser", "there", "tion", "water"] * 30:
        for g in toxicity.grams(w):
            counts[g] = counts.get(g, 0) + 1
    restorer = toxicity.Restorer(counts)
    for written, word in {"1d10t": "idiot", "$tupid": "stupid", "i.d.i.o.t": "idiot", "traaaash": "trash", "cl0wn!!": "clown", "m*o*r*o*n": "moron", "L0SER": "loser"}.items():
        assert word in restorer.words(written.encode())[0], written
    assert "idiot" in restorer.words(b"you i d i o t there")[0]
    assert restorer.words(b"plain words, here.")[0] == {"plain": 1, "words": 1, "here": 1}
    assert restorer.words(b"")[0] == {}


def test_deobfuscation_parts_spaced_words_and_takes_doubles_and_long_forms():
    counts = {}
    for w in ["idiot", "stupid", "moron", "are", "now", "you", "there", "water"] * 30:
        for g in toxicity.grams(w):
            counts[g] = counts.get(g, 0) + 1
    found = lambda t: toxicity.Restorer(counts).words(t.encode())[0]
    assert {"are", "idiot", "now"} <= set(found("are a i d i o t now"))
    assert {"idiot", "moron"} <= set(found("i d i o t m o r o n"))
    assert "idiot" in found("you iddiiott") and "idiot" in found("i i i d i o t")
    assert {"idiot", "moron"} <= set(found("1d10t-m0r0n"))
    assert {"idiot", "moron", "stupid"} <= set(found("-".join(["1d10t", "m0r0n", "$tup1d"] * 6)))
    assert len(found("-".join(["1d10t", "w4ter"] * 20_000))) < 100


def test_toxicity_learns_and_catches_disguises(spark):
    clean = [prose(i, 60) for i in range(60)]
    toxic = [prose(100 + i, 30) + " idiot " + prose(200 + i, 20) + " moron." for i in range(30)]
    hidden = [prose(300, 30) + " 1d10t " + prose(301, 30) + " m-o-r-o-n", prose(302, 60)]
    frame = docs(spark, clean + toxic + hidden + EDGE)
    labels = spark.createDataFrame([(i, None, int(i >= 60)) for i in range(90)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame, labels).collect()}
    assert len(scores) == 92 + len(EDGE) and all((scores[i] >= 0.5) == (i >= 60) for i in range(91)) and scores[91] < 0.5
    kept = toxicity.keep_civil(frame, labels)
    assert kept.columns == frame.columns and set(range(60)) <= {r.doc_id for r in kept.collect()} <= set(range(60)) | set(range(91, 200))
    assert {r.score for r in toxicity.toxicity_scores(frame, labels.limit(0)).collect()} == {0.0}


# --- urls


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), (None, "/x", "block")], "host string, path string, verdict string")
    cases = {"http://A.Example.COM/en/78?q": ("example.com/en/7", "allow"), "https://other.com/en/7": ("com/en/", "block"), "http://example.com/en": (None, "allow"), "http://com/en/x#y": ("com/en/", "block"), "http://xcom/en/": (None, "allow"), "http://a.net/de/?z": ("net/de/", "allow"), "nothing": (None, "allow"), "": (None, "allow"), None: (None, "allow"), "http://h.com?/en/": (None, "allow"), "http://" + "a." * 9000 + "com/en/": ("com/en/", "block")}
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*cases, *cases])], "page_id long, url string, verdict string")
    rows = sorted(urls.url_verdicts(pages, rules).collect(), key=lambda r: r.page_id)
    assert len(rows) == 2 * len(cases)
    for r in rows:
        assert (r.rule, r.verdict) == cases[r.url]
    assert rows[0].host == "a.example.com" and rows[0].path == "/en/78" and rows[6].host == "" == rows[6].path
    assert urls.url_verdicts(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.url_verdicts(pages, rules.limit(0)).collect()} == {"allow"}


# --- packing


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [prose(1, 3000), "It's <|endoftext|> 12 İstanbul Ǆ ﬁ é ΑΣ ΌΣΟΣ\u001fx\u0085y _a_ don't'll", "<|ENDOFTEXT|> Naïve Straße, l'été!", *EDGE]
    rows = packing.pack(docs(spark, texts), path, 1024).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        by_doc.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == 4 * r.length and r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 and 2**r.bucket == r.length
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in enumerate(texts):
        want = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert b"".join(r.ids for r in by_doc[i]) == want, t[:50]
        assert [r.start for r in by_doc[i]] == list(itertools.accumulate([0] + [r.length for r in by_doc[i]][:-1]))
    assert packing.pack(docs(spark, []), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, []), path, 1000)


# --- LM scoring


def ppm_log10(words, counts, texts, order):
    """Plain PPM of one word list by dictionaries."""
    tree = {}

    def see(seq, n):
        for i in range(1, len(seq)):
            for k in range(min(order, i) + 1):
                tree.setdefault(bytes(seq[i - k : i]), {}).setdefault(seq[i], 0)
                tree[bytes(seq[i - k : i])][seq[i]] += n

    for w, n in counts.items():
        see(b" " + w + b" ", n)
    if texts:
        see(b" \n", texts)
    total = 0.0
    for seq in [b" " + w + b" " for w in words] + [b" \n"]:
        for i in range(1, len(seq)):
            gone = set()
            for k in range(min(order, i), -1, -1):
                node = {s: n for s, n in tree.get(bytes(seq[i - k : i]), {}).items() if s not in gone}
                if bytes(seq[i - k : i]) not in tree:
                    continue
                if seq[i] in node:
                    total += np.log10(node[seq[i]] / (sum(node.values()) + len(node)))
                    break
                if node:
                    total += np.log10(len(node) / (sum(node.values()) + len(node)))
                gone |= set(tree[bytes(seq[i - k : i])])
            else:
                total -= np.log10(max(1, 256 - len(gone)))
    return total


@pytest.mark.parametrize("frequent", [3, 1000])
def test_scoring_matches_plain_ppm(spark, monkeypatch, frequent):
    monkeypatch.setattr(scoring, "FREQUENT", frequent)
    texts = [prose(i, 30) for i in range(20)] + ["The THE the", None, "", "ünïcode 中文", prose(1, 2000)]
    rows = {r.doc_id: r for r in scoring.score_texts(docs(spark, texts)).collect()}
    words = [(t or "").encode().lower().split() for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {}
    for i in train:
        for w in words[i]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for i in range(len(texts)):
        r = rows[i]
        assert r.held_out == (i not in train) and r.n_tokens == len(words[i]) + 1 and r.train_tokens == n
        assert r.n_known == sum(w in counts for w in words[i]) + 1
        want = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words[i]) + np.log10((len(train) + 1) / (n + v + 1))
        assert abs(r.base_score - want) < 1e-6
        if len(words[i]) < 100:
            assert abs(r.score - ppm_log10(words[i], counts, len(train), scoring.ORDER)) < 1e-6
    assert scoring.score_texts(docs(spark, [])).count() == 0


def test_scoring_keeps_order_6_whatever_the_size_of_the_trie(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TRIE_LIMIT", 100, raising=False)
    texts = [prose(i, 30) for i in range(12)]
    counts = {}
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    for w in " ".join(train).encode().split():
        counts[w] = counts.get(w, 0) + 1
    for r in scoring.score_texts(docs(spark, texts)).collect():
        assert abs(r.score - ppm_log10(texts[r.doc_id].encode().split(), counts, len(train), 6)) < 1e-6


def ppm_across_log10(texts, train, order):
    """Plain PPM of whole texts by dictionaries: each text's score after training on some."""
    stream = lambda t: b" " + b"".join(w + b" " for w in (t or "").encode().lower().split()) + b"\n"
    tree = {}
    for t in train:
        seq = stream(t)
        for i in range(1, len(seq)):
            for k in range(min(order, i) + 1):
                node = tree.setdefault(seq[i - k : i], {})
                node[seq[i]] = node.get(seq[i], 0) + 1
    for t in texts:
        seq, total = stream(t), 0.0
        for i in range(1, len(seq)):
            gone = set()
            for k in range(min(order, i), -1, -1):
                whole = tree.get(seq[i - k : i])
                if whole is None:
                    continue
                node = {s: n for s, n in whole.items() if s not in gone}
                if seq[i] in node:
                    total += np.log10(node[seq[i]] / (sum(node.values()) + len(node)))
                    break
                if node:
                    total += np.log10(len(node) / (sum(node.values()) + len(node)))
                gone |= set(whole)
            else:
                total -= np.log10(max(1, 256 - len(gone)))
        yield total


@pytest.mark.parametrize("frequent, hold", [(1, 500), (1000, 2_000_000)])
def test_scoring_across_words_matches_plain_ppm_and_sees_word_order(spark, monkeypatch, frequent, hold):
    monkeypatch.setattr(scoring, "FREQUENT", frequent)
    monkeypatch.setattr(scoring, "HOLD", hold)
    monkeypatch.setattr(scoring, "CHUNK", 700)
    texts = [prose(i, 30) for i in range(20)] + ["The THE the", None, "", "  a\tb\n", "ünïcode 中文", "\x01\x02 \x00", prose(1, 300)]
    texts.append(" ".join(reversed(prose(3, 30).split())))
    rows = {r.doc_id: r for r in scoring.score_texts(docs(spark, texts), across=True).collect()}
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    for i, want in enumerate(ppm_across_log10(texts, train, scoring.ORDER)):
        assert abs(rows[i].score - want) < 1e-6, i
    assert abs(rows[3].score - rows[len(texts) - 1].score) > 0.1


# --- chat


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "b<|end|>\\<\\|"), (1, 0, "user", "a"), (1, 2, "assistant", None), (1, 3, "user", "<"), (2, 0, None, "x\ny"), (3, 0, "user", ""), (3, 0, "user", ""), (4, None, "assistant", "é中😀|>"), (4, 5, "odd<|body|>\n", "z"), (None, 0, "assistant", "q"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.format_chats(frame))).collect()}
    shown = {r.conv_id: r.formatted for r in chat.format_chats(frame).collect()}
    assert shown[1].count("<|start|>") == 3 and shown[1].count("<|next|>") == 1
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: (x[0] is not None, x))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert tuple(got[conv])[1:5] == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learnt), sha(learnt))
        assert got[conv].formatted_chars == len(shown[conv])
    assert chat.format_chats(frame.limit(0)).count() == 0
