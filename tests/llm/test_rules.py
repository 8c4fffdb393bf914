"""Corpus operators against exhaustive search, plain formulas and held-out labels; odd rows and columns."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from evidencia.llm import decontaminate, embeddings, licenses, minhash, packing, quality, queries, toxicity, urls
from evidencia.llm.common import table

from .test_operators import docs, prose

SMALL, MIDDLE, LARGE = (f"/root/testdata/sf{n}" for n in ("0.001", "0.01", "0.1"))


# --- license scan: every place of every notice by dynamic programming


def best_edits(notice: bytes, text: bytes) -> int:
    """The least number of edits between the notice and any part of the text."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        before, row[0] = row[0], 0
        for j in range(1, len(row)):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (notice[j - 1] != c))
        best = min(best, row[-1])
    return best


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def noisy(text: str, edits: int, r: random.Random) -> str:
    for _ in range(edits):
        i = r.randrange(len(text))
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + r.choice("aeox ") + text[i:], text[:i] + r.choice("zqk") + text[i + 1 :]])
    return text


@pytest.mark.parametrize("seed", range(4))
def test_license_spans_match_an_exhaustive_search(seed):
    r = random.Random(seed)
    for notice in r.sample(list(licenses.NOTICES), 5):
        k = licenses.errors_allowed(notice)
        for edits in (0, 1, k, k + 1, k + 3):
            text = f"{prose(r.random(), 12)} {noisy(notice, edits, r)} {prose(r.random(), 12)}"
            whole = b" ".join(text.encode().translate(licenses.WORD_BYTES).split())
            found = licenses.scan(text.encode())
            words = whole.split()
            for other, label in licenses.NOTICES.items():
                d = best_edits(other.encode(), whole)
                spans = [s for s in found["spans"] if s[0] == label]
                if d <= licenses.errors_allowed(other):  # found, or covered by a notice with as few edits
                    assert any(s[3] <= d for s in found["spans"]), (other, d)
                elif all(best_edits(n.encode(), whole) > licenses.errors_allowed(n) for n, x in licenses.NOTICES.items() if x == label):
                    assert not spans
            for label, first, end, n in found["spans"]:
                part = b" ".join(words[first:end])
                assert min(distance(x.encode(), part) for x, y in licenses.NOTICES.items() if y == label) <= n + 2  # the span is widened to whole words
            assert all(a[2] <= b[1] for a, b in itertools.pairwise(found["spans"]))


@pytest.mark.parametrize("seed", range(3))
def test_license_notices_side_by_side_all_have_their_spans(seed):
    assert [s[1:] for s in licenses.scan(b"released under the mt licens released under the mit license")["spans"]] == [(0, 5, 2), (5, 10, 0)]
    r = random.Random(seed)
    for notice in r.sample(list(licenses.NOTICES), 6):
        edits = [r.choice([0, 1, licenses.errors_allowed(notice)]) for _ in range(4)]
        parts = []
        for n in edits:
            words = notice.split()
            for i in r.sample(range(len(words)), min(n, len(words))):
                words[i] = words[i][:-1] + "q"
            parts.append(" ".join(words))
        found = licenses.scan(" ".join(parts).encode())
        n = len(notice.split())
        assert sorted(s[1] // n for s in found["spans"]) == [0, 1, 2, 3], (notice, edits, found["spans"])  # its label, or that of a notice as near


def test_license_base_labels_and_places_of_a_long_text():
    text = "the MIT license and; an Apache  License " * 3000
    found = licenses.scan(text.encode())
    assert (found["n_base"], found["first_word"], found["last_word"]) == (6000, 1, 7 * 2999 + 5)


# --- quality: the plain discriminant, and labels that it never saw


def plain_discriminant(rows, shrink=0.1, ridge=0.05):
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    centre, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z, d = (x - centre) / scale, x.shape[1]
    covariance = {k: np.cov(z[y == k].T, bias=True) for k in (0, 1)}
    pooled = sum((y == k).mean() * covariance[k] for k in (0, 1))

    def score(v):
        v = np.clip((v - centre) / scale, -quality.REACH, quality.REACH)
        logs = []
        for k in (0, 1):
            share = shrink + (1 - shrink) * d / (d + (y == k).sum())
            c = (1 - share) * covariance[k] + share * pooled
            c = (1 - ridge) * c + ridge * np.trace(c) / d * np.eye(d)
            gap = v - z[y == k].mean(0)
            logs.append(math.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * gap @ np.linalg.solve(c, gap))
        return 1 / (1 + math.exp(max(-50, min(50, logs[0] - logs[1]))))

    return score


def test_quality_scores_match_the_plain_formula(spark):
    texts = {r.doc_id: r.text for r in table(spark, MIDDLE, "documents").select("doc_id", "text").collect()}
    labels = {}
    for r in table(spark, MIDDLE, "labels").collect():
        if r.quality is not None:
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.quality)
    train = [(quality.statistics((texts[d] or "").encode()), y) for d, y in labels.items() if d in texts and zlib.crc32(str(d).encode()) % 4 != 2]
    score = plain_discriminant(train)
    found = {r.doc_id: r for r in queries.op5_quality(spark, MIDDLE).collect()}
    assert set(found) == set(texts)
    for d in list(texts)[::7]:
        assert abs(found[d].score - score(np.array(quality.statistics((texts[d] or "").encode())))) < 1e-6
    held = [d for d in labels if d in found and found[d].held_out]
    assert len(held) > 50 and np.mean([found[d].predicted == labels[d] for d in held]) > 0.9


# --- toxicity: every path of the lattice, and labels that it never saw


def every_path(written, model):
    best = {}
    for path in itertools.product(*toxicity.options(written)):
        state, total, words = "^^", 0.0, [""]
        for letters, cost in path:
            total += cost
            if letters == " ":
                if state != "^^":
                    total, state, words = total + toxicity.ending(state, model), "^^", [*words, ""]
                continue
            for c in letters:
                total += model.log(state + c)
                state = state[1] + c
            words[-1] += letters
        total += toxicity.ending(state, model)
        text = " ".join(w for w in words if w)
        best[text] = max(best.get(text, -math.inf), total)
    return best


def test_decoding_finds_the_best_path_of_the_lattice():
    counts = {}
    for word in "idiot moron the thing stupid loser hello tide total is it at in".split():
        for g in toxicity.grams(word):
            counts[g] = counts.get(g, 0) + 1
    model = toxicity.Characters(counts)
    for written in ["1d10t", "i.d.i.0.t", "m0r0n!", "iiddiioott", "1 d 1 o t", "l05er", "t-h-3", "s$tup!d", "h3ll0", "i t i s"]:
        paths = every_path(written, model)
        assert abs(paths[toxicity.decode(written, model)] - max(paths.values())) < 1e-9, written


def test_a_disguise_of_any_length_is_restored():
    counts = {}
    for word in ["idiot", "moron", "hello"]:
        for g in toxicity.grams(word):
            counts[g] = counts.get(g, 0) + 5
    restorer = toxicity.Restorer(counts)
    assert "idiot" in restorer.restore(b"i" + b".-" * 40 + b"d" + b".-" * 40 + b"iot")
    assert "idiot" in restorer.restore(b"i.-d.-i.-o.-t")


def test_toxicity_of_labels_that_were_held_out(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, LARGE, "labels").where("toxic is not null").collect()}
    found = {r.doc_id: r for r in queries.op10_toxicity(spark, LARGE).collect()}
    held = [d for d in labels if d in found and found[d].held_out]
    toxic = [d for d in held if labels[d]]
    assert len(held) > 500 and np.mean([found[d].predicted == labels[d] for d in held]) > 0.98
    assert np.mean([found[d].predicted for d in toxic]) > 0.9
    assert all(r.predicted == int(r.score >= 0.5) for r in found.values())


def test_equal_texts_with_both_labels_learn_the_same_whatever_their_order(spark):
    texts = [f"{prose(i, 12)} idiot" for i in range(12)] + [prose(i, 12) for i in range(100, 130)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)]
    marks = [(i, int(i < 12)) for i in range(len(texts))] + [(100 + i, 0) for i in range(len(texts))]
    got = []
    for order in (1, -1):
        documents = spark.createDataFrame(rows[::order], "doc_id long, text string")
        labels = spark.createDataFrame(marks[::order], "doc_id long, toxic int")
        got.append({r.doc_id: round(r.score, 9) for r in toxicity.toxicity_scores(documents, labels).collect()})
    assert got[0] == got[1]
    assert toxicity.toxicity_scores(documents.limit(0), labels).count() == 0


# --- odd rows and columns


def test_contaminated_rows_without_an_id_go_and_clean_ones_stay(spark):
    item = "a merchant sold 12 apples and 7 pears to Anna for 30 dollars before noon yesterday"
    rows = [(None, f"so {item} indeed", 1), (None, prose(4, 40), 2), (3, prose(5, 40), 3), (None, None, 4), (5, f"well {item}", 5)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, found long")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.found for r in decontaminate.keep_clean(documents, benchmark).collect()) == [2, 3, 4]
    assert decontaminate.keep_clean(documents.limit(0), benchmark).count() == 0
    assert decontaminate.keep_clean(documents, benchmark.limit(0)).count() == 5


def test_rows_that_share_a_vec_id_keep_their_own_links(spark):
    a, b = [1.0, 0.0, 0.2, 0.1], [0.0, 1.0, 0.1, 0.3]
    rows = [(1, a), (1, b), (2, [x * 1.01 for x in b]), (None, a), (7, None), (8, [0.0] * 4), (9, [float("nan")] * 4)]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.95).collect())
    assert got == [(-1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (7, 0, 7), (8, 0, 8), (9, 0, 9)]
    assert embeddings.expected_recall(0.95) > 0.998


def test_urls_keep_any_columns_and_all_rows(spark):
    rows = [("http://a.com/en/x", "h", 1, "v"), (None, "h", 2, "v"), ("http://a.com/en/x", "h", 3, "v"), ("none", "h", 4, "v")]
    pages = spark.createDataFrame(rows, "url string, host string, held_url long, rule_verdict string")
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    got = sorted((r.held_url, r.host, r.path, r.rule, r.verdict, r.rule_verdict) for r in urls.url_verdicts(pages, rules).collect())
    assert got == [(1, "a.com", "/en/x", "com/en/", "block", "v"), (2, "", "", None, "allow", "v"), (3, "a.com", "/en/x", "com/en/", "block", "v"), (4, "", "", None, "allow", "v")]
    assert urls.url_verdicts(pages.limit(0), rules).count() == 0 and urls.url_verdicts(pages, rules.limit(0)).count() == 4


def test_batches_hold_sequences_of_one_length(spark):
    pieces = packing.pack(docs(spark, [prose(i, 5 * i) for i in range(60)]), queries.tokenizer_path(), 256).collect()
    by_batch = {}
    for p in pieces:
        by_batch.setdefault(p.batch_id, []).append(p.length)
    assert all(len(set(x)) == 1 and sum(x) <= 256 for x in by_batch.values())
    assert any(len(x) > 1 for x in by_batch.values())


def test_a_tokenizer_of_another_kind_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_copies_with_repeated_and_missing_ids(spark):
    text = prose(1, 80)
    rows = [(1, text, 1), (1, text, 2), (2, text, 3), (None, text, 4), (5, prose(2, 80), 5), (6, None, 6), (6, "", 7)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    kept = minhash.keep_one_each(documents)
    assert kept.columns == documents.columns
    got = sorted(r.kept for r in kept.collect())
    assert len(got) == 4 and 4 in got and 5 in got and (1 in got) + (2 in got) == 1 and (6 in got) + (7 in got) == 1


def test_items_of_few_words_match_as_they_are(spark):
    bench = spark.createDataFrame([(1, "Blue Whale song"), (2, "12"), (3, "far beyond the blue whale song we heard"), (4, None), (5, "")], "item_id long, text string")
    texts = ["the blue, whale SONG went on", "blue whales song", "we counted 12", "we counted 13", "whale", None, ""]
    found = {(r.doc_id, r.item_id, r.n_windows, r.item_windows) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert found == {(0, 1, 1, 1), (2, 2, 1, 1)}
    assert {r.doc_id for r in decontaminate.keep_clean(docs(spark, texts), bench).collect()} == {1, 3, 4, 5, 6}


def test_columns_named_like_helpers_do_not_clash(spark):
    names = ["odd_id", "found", "document", "rep", "kept", "n", "label", "key_a", "band", "score", "predicted", "window", "words", "keys", "component", "node", "rows", "quality", "toxic"]
    rows = [(i, prose(i % 3, 60), *range(len(names))) for i in range(6)] + [(5, prose(2, 60), *range(len(names)))]
    many = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    once = minhash.keep_one_each(many)
    assert once.columns == many.columns and sorted(r.doc_id for r in once.collect()) == [0, 1, 2]
    assert decontaminate.keep_clean(many, spark.createDataFrame([(1, prose(0, 60))], "item_id long, text string")).count() == 5
    assert quality.keep_good(many, labels).columns == many.columns and toxicity.keep_civil(many, labels).columns == many.columns


def test_stages_take_odd_documents(spark):
    wanted = table(spark, SMALL, "documents").columns
    some = table(spark, SMALL, "documents").limit(30).collect()
    odd = [(None, some[0].text, None, None, None), (900_001, None, "en", "x", 0), (900_002, "", None, "x", 0), (900_003, " \n", "en", None, 3), (some[1].doc_id, some[1].text, "en", "x", 1), (900_004, "word " * 60_000, "en", "x", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    documents = spark.createDataFrame([tuple(r[c] for c in wanted) for r in some] + odd, schema).selectExpr("*", "'a' as kept", "1L as found", "2 as score", "'r' as rep")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (documents, documents.limit(0)):
            out = stage(spark, rows, SMALL)
            assert out.columns == documents.columns, name
            assert out.count() <= rows.count(), name
    name, stage = corpus_pipeline.STAGES[-1]
    assert {r.doc_id for r in stage(spark, documents, SMALL).select("doc_id").distinct().collect()} == {r.doc_id for r in documents.select("doc_id").distinct().collect()}
    assert stage(spark, documents.limit(0), SMALL).count() == 0


def test_plain_texts_are_told_apart_by_pre_tokens_alone(monkeypatch):
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), memo=8)
    wanted = lambda t: np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    odd = ["a <|endoftext|> B\tc", "\x1cone\x1ftwo three Ünï̇", "İSTANBUL ſtraße ×÷ 中文 ２３", "x\u0085y\n<| Z"]
    assert [encoder.encode(t.encode()) for t in odd] == [wanted(t) for t in odd]
    monkeypatch.setattr(encoder, "_chunk", None)
    plain = ["It's THEY'RE 'tis \"don't\"!\n\tA1b22_c-d×e÷f Été\x0bœuvre\x0cŸ ĳ", "", " \r\n", "w0rd w1rd, " * 30 + "'s'll'x''ve"]
    assert [encoder.encode(t.encode()) for t in plain] == [wanted(t) for t in plain]


def test_phrases_are_found_with_few_ways_out_of_a_state(spark):
    from evidencia.llm import passages

    g = random.Random(3)
    lines = [" ".join(f"w{g.randrange(3000)}" for _ in range(400)).encode() for _ in range(12)]
    lines += [b" ".join(lines[i].split()[100:160] + lines[i + 1].split()[7:40]) for i in range(6)] + [b"short"]
    block = [passages.Text(x, 20) for x in lines]
    runs = np.concatenate([t.runs for t in block if t.long_enough]).view(np.int64)
    recurring = np.unique(runs)[::3]
    found = passages.hits(block, recurring)
    assert [m is None for m in found] == [not t.long_enough for t in block]
    assert all((m == np.isin(t.runs.view(np.int64), recurring)).all() for t, m in zip(block, found) if m is not None)
    known = np.arange(3000, dtype=np.uint64)
    assert len(set(passages.spelled(known))) <= 2 * 55 and len(passages.spelled(known)) == 2 * 3000
