"""The ten operators against brute force on small tables, and on rows that are odd."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from claimweave.llm.decontamination import Index, contaminated, decontaminate
from claimweave.llm.exchange import _murmur3
from claimweave.llm.language_id import Model, counts, language_id, train
from claimweave.llm.licenses import PHRASES, RAREST, SHARE, TEMPLATES, evidence, hint, license_scan
from claimweave.llm.lm_scoring import LENGTH, STEP, _tokenizer, drawn_windows, fit, lm_scores, refined, subwords
from claimweave.llm.parity_join import jaccard_components
from claimweave.llm.quality import BUCKETS, THRESHOLD, quality
from claimweave.llm.queries import tokenizer_file
from claimweave.llm.source_mix import source_mix
from claimweave.llm.substring_dedup import substring_dedup
from claimweave.llm.token_counts import Vocabulary, counter, read_vocabulary, token_counts
from claimweave.llm.toxicity import EXCEPTIONS, fold, learn, toxicity

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(params=["table", "odd"])
def both(request, table, docs):
    return table if request.param == "table" else docs


def test_hash_partitioning(spark):
    assert [r[0] for r in spark.range(50).select(F.hash(F.col("id").cast("int"))).collect()] == _murmur3(np.arange(50)).tolist()


def test_substring_dedup(both):
    rows = [(r.doc_id, words(r.text)) for r in both.collect()]
    seen = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    want = []
    for i, w in rows:
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(both).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def components(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (words(low(t)) for _, t in rows)]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                part[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {g: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for g, m in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def test_jaccard_components(both):
    rows = [(r.doc_id, r.text) for r in both.collect()]
    assert sorted(map(tuple, jaccard_components(both).collect()), key=repr) == sorted(components(rows), key=repr)


def test_jaccard_components_of_many_near_copies(spark):
    """A family whose members are about as far apart as the bound allows, so that hubs don't settle it."""
    rng = np.random.default_rng(0)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for p in rng.choice(150, rng.integers(1, 5), replace=False):
            w[p] = f"n{i}_{p}"
        rows.append((i, " ".join(w)))
    for i in range(200, 260):
        n = int(rng.integers(1, 12))
        rows.append((i, " ".join(f"t{(i // 6) * 50 + k}" for k in range(n)) + (" extra" if i % 2 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df).collect())) == sorted(components(rows))


def test_quality(both):
    want = []
    for r in both.collect():
        t, w = r.text or "", words(r.text)
        lines = [x for x in t.split("\n") if words(x)]
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = len({p for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)})
        want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    out = quality(both).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=repr) == sorted(want, key=repr)
    assert not any(r.kept and r.base_failed for r in out)


def test_quality_scores(both):
    """The method word by word: bucket counts of the raw and the trusted texts, and each text's mean log ratio."""
    rows = [(r.doc_id, words(r.text), r.text or "") for r in both.collect()]
    bucket = lambda h: h % BUCKETS
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)

    def grams(w):
        h = [signed(xxhash.xxh64_intdigest(x.encode(), seed=42)) for x in w]
        return [bucket(x) for x in h] + [bucket(signed(a ^ signed(b << 1))) for a, b in zip(h, h[1:], strict=False)]

    raw, good = Counter(), Counter()
    for _, w, t in rows:
        raw.update(grams(w))
        lines = [x for x in t.split("\n") if words(x)]
        n = len(w)
        if n >= 50 and 50 * len(re.findall(r"[#*$%&|<>]", t)) <= n and len(lines) == len(set(lines)) and 5 * len(set(w)) >= n and 3 * n <= sum(map(len, w)) <= 9 * n:
            good.update(grams(w))
    r, g = sum(raw.values()), sum(good.values())
    ratio = lambda b: math.log((good[b] + 1) / (g + BUCKETS)) - math.log((raw[b] + 1) / (r + BUCKETS))
    want = [(i, round(sum(map(ratio, x)) / len(x), 6) if (x := grams(w)) else None) for i, w, _ in rows]
    out = quality(both).collect()
    assert sorted(((r.doc_id, None if r.score is None else round(r.score, 6)) for r in out), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (not r.base_failed and r.score >= THRESHOLD) for r in out)


def test_quality_follows_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = quality(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rates = {r.quality: r.rate for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] >= 0.99 and rates[0] <= 0.05


def test_licenses(both):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for r in both.collect():
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(r.text))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        want.append((r.doc_id, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    out = license_scan(both).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=repr) == sorted(want, key=repr)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)


def test_licenses_by_all_offsets(both):
    """Labels and score from each notice's rarest words laid at each offset."""
    split = {i: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(r.text)) for i, r in enumerate(both.collect())}
    often = Counter(x for w in split.values() for x in set(w))
    want = []
    for i, r in enumerate(both.collect()):
        w = split[i]
        line = f" {' '.join(w)} "
        base = {label for p, label in PHRASES.items() if f" {p} " in line}
        labels, best = set(base), 0.5 if base else 0.0
        for name, notice, keys in TEMPLATES:
            words = evidence(notice, keys)
            whole = min(RAREST, len({x for x, _ in words}))
            looked = sorted({x for x, _ in words} & set(w), key=lambda x: (often[x], x))[:RAREST]
            if all(f" {k} " in line for k in keys):
                for at in range(-len(notice.split()), len(w)):
                    n = len({x for x, k in words if x in looked and 0 <= at + k < len(w) and w[at + k] == x})
                    if n >= math.ceil(SHARE * whole):
                        labels.add(name)
                        best = max(best, n / whole)
        want.append((r.doc_id, ",".join(sorted(labels)), best))
    assert sorted(((r.doc_id, r.labels, r.score) for r in license_scan(both).collect()), key=repr) == sorted(want, key=repr)


def test_key_phrases_alone_give_no_label(spark):
    """The phrase without its notice, a notice with small edits, and a sentence that only mentions a licence."""
    texts = [*(f"he wrote {k} reviews" for _, _, keys in TEMPLATES for k in keys), "We do not accept code under the GNU General Public License version 3.", "a history of the MIT License and its readers"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(set(r.labels.split(",")) <= {"", "mit", "apache", "gpl"} for r in license_scan(df).collect())
    for name, notice, keys in TEMPLATES:
        words = evidence(notice, keys)
        if len({w for w, _ in words}) >= RAREST:
            edited = notice.split()
            edited[words[len(words) // 2][1]] = "xyz"
            got = license_scan(spark.createDataFrame([(0, "note " + " ".join(edited) + " end")], "doc_id long, text string")).first()
            assert name in got.labels.split(",") and got.score < 1.01


def test_licenses_lower_ascii_only(spark):
    df = spark.createDataFrame([(0, "MIT LICENSE"), (1, "M\u0130T License and \u212aIT")], "doc_id long, text string")
    assert [r.base_labels for r in license_scan(df).orderBy("doc_id").collect()] == ["mit", ""]


def test_license_method_labels(spark):
    df = spark.createDataFrame([(0, "x Licensed under CC BY-NC 4.0."), (1, "license of the mit"), (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software")], "doc_id long, text string")
    assert [r.labels for r in license_scan(df).orderBy("doc_id").collect()] == ["cc-by-nc-4.0", "", "mit-text"]


def test_licenses_of_several_notices(spark):
    """Each notice of a file is found, however many licence words the others bring."""
    whole = {name: notice for name, notice, _ in TEMPLATES}
    apart = [("mit-text", "apache-2.0"), ("apache-2.0", "gpl-3.0"), ("apache-2.0", "cc-by-nc-4.0"), ("gpl-3.0", "cc-by-nc-4.0"), ("bsd", "apache-2.0"), ("mit-notice", "mit-text"), tuple(whole)]
    df = spark.createDataFrame([(k, " filler ".join(whole[x] for x in names)) for k, names in enumerate(apart)], "doc_id long, text string")
    for r in license_scan(df).collect():
        assert set(apart[r.doc_id]) <= set(r.labels.split(",")) and r.score == 1


def test_licenses_without_the_word_license(spark):
    """Files are chosen by the key phrases of the templates given."""
    df = spark.createDataFrame([(0, "Text shared under CC BY-SA 4.0."), (1, "Photos are available under CC BY-NC 4.0"), (2, "dedicated to the Public Domain by its author")], "doc_id long, text string")
    assert [r.labels for r in license_scan(df).orderBy("doc_id").collect()] == ["cc-by-sa-4.0", "cc-by-nc-4.0", ""]
    own = (("pd", "dedicated to the public domain", ("public domain",)),)
    assert [r.labels for r in license_scan(df, templates=own).orderBy("doc_id").collect()] == ["", "", "pd"]
    for _, notice, keys in TEMPLATES:
        assert all(re.search(hint(p for _, _, k in TEMPLATES for p in k), k) for k in keys), notice


def test_toxicity(spark, docs):
    assert fold("1D1ОТ") == "idiot"
    lexicon = learn([("you idiot here", 1)] * 6 + [("fine day here", 0)] * 20)
    found = lexicon.automaton()
    assert lexicon.score(lexicon.features("an 1d1ot", found)) >= 0.5 > lexicon.score(lexicon.features("trash can", found))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    out = toxicity(docs, labels).collect()
    assert len(out) == 12 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    sf = "/root/testdata/sf0.01"
    out = toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (out.predicted == out.toxic).mean() >= 0.9


def test_toxicity_by_search(spark):
    """The automaton finds what a search for each term at each place finds, exceptions included."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = [(r.text or "", r.toxic) for r in docs.join(labels, "doc_id").where("doc_id % 3 > 0").collect()]
    lexicon = learn(rows)
    found = lexicon.automaton()
    some = max(lexicon.weights, key=lexicon.weights.get).rstrip("*")
    texts = [t for t, _ in rows[:150]] + ["trash can trash", f"{some} can, {some.upper()}x x{some}", "tra\u200bsh c\uff21n", "", "8\u0412$"]
    for t in texts:
        folded, hits = fold(t), {}
        safe = [(a, a + len(p)) for p in map(fold, EXCEPTIONS) for a, _ in [m.span() for m in re.finditer(rf"(?<!\w)(?={re.escape(p)}(?!\w))", folded)]]
        for m in re.finditer(r"(?<!\w)\w+", folded):
            word, at = m[0], m.start()
            weights = [w for term, w in lexicon.weights.items() if (word.startswith(term[:-1]) if term.endswith("*") else word == term)]
            if weights and not any(a <= at < b for a, b in safe):
                hits[at] = max(weights)
        total = sum(hits.values())
        want = (np.log1p(total), np.log1p(1000 * total / (len(t.split()) + 20))) if total else (0.0, 0.0)
        assert lexicon.features(t, found) == pytest.approx(want), t[:200]


def test_language_probabilities():
    """Scores from n-grams counted one by one."""
    rng = np.random.default_rng(3)
    dim, langs = 64, ["x", "y", "z"]
    model = Model(langs, rng.random(dim) + 1, rng.normal(size=(dim + 1, 3)), 1.7)
    for text in ("Hello\tworld", "a", "\u00c4\u4e2d\U0001f600 z" * 9):
        n = [0] * dim
        c = [32 if 9 <= ord(x) <= 13 else ord(x) for x in text.lower()]
        for k in range(len(c)):
            grams = [c[k] * 668265263]
            if k + 1 < len(c):
                grams.append(c[k] * 2654435761 + c[k + 1] * 40503 + 7919)
            if k + 2 < len(c):
                grams.append((c[k] * 2654435761 + c[k + 1] * 40503 + 7919) * 2246822519 + c[k + 2] * 3266489917)
            for g in grams:
                g %= 1 << 64
                n[((g >> 7) ^ g) % dim] += 1
        x = [math.log1p(v) * w for v, w in zip(n, model.idf, strict=True)]
        size = math.sqrt(sum(v * v for v in x))
        z = [(sum(v / size * model.weights[f, k] for f, v in enumerate(x)) + model.weights[dim, k]) / 1.7 for k in range(3)]
        want = [math.exp(v - max(z)) for v in z]
        assert counts(text, dim).tolist() == n
        assert model.probabilities(model.vector(counts(text, dim))) == pytest.approx([v / sum(want) for v in want])


def test_language(spark, docs):
    out = {r.doc_id: r for r in language_id(docs).collect()}
    assert len(language_id(docs).collect()) == 12 and all(out[i].lang_pred == "und" for i in (3, 4, 5, 7))
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id(real).where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)


def test_rare_languages_and_copies(spark):
    """A language of one row in a hundred is learnt, and copies of one text don't fill the sample."""
    rng = np.random.default_rng(1)
    say = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    rows = [(i, *((say("klmnopq"), "b") if i % 100 == 7 else ("copied " * 20, "a") if i % 3 == 0 else (say("abcdefg"), "a"))) for i in range(3000)]
    out = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=40).collect()
    assert all(r.lang_pred == r.lang for r in out)


def test_training_counts_of_long_texts(spark, monkeypatch):
    text = "a" * 65537 + " " * 70000
    monkeypatch.setattr("claimweave.llm.language_id.fit", lambda langs, idf, rows: list(rows))
    [(_, n)] = train(spark.createDataFrame([(text, "x")], "text string, lang string"), F.lit(True))
    assert np.array_equal(n, counts(text))


def test_decontamination(spark, table, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [(r.item_id, r.text) for r in items.collect()]
    planted = table.select("doc_id", "text").limit(40).withColumn("text", F.concat("text", F.lit(" " + texts[3][1]))).unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in contaminated(planted, items).collect()}
    assert {(r.doc_id, i) for r in planted.collect() for i, t in texts if r.text and t in r.text} <= found
    assert {r.doc_id for r in decontaminate(planted, items).collect()} == {-1, -2}
    assert contaminated(planted, items, index_bytes=2000).count() == len(found), "several blocks of items find the same"
    assert decontaminate(docs, items.where("false")).count() == 12
    assert contaminated(docs, items).count() == 0


def test_scores_do_not_follow_the_blocks_of_items(spark, table):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    part = items.select(F.monotonically_increasing_id().alias("doc_id"), F.expr("array_join(slice(split(text, ' '), int(size(split(text, ' ')) * 0.2) + 1, 10000), ' ')").alias("text"))
    one, several = ({(r.doc_id, r.item_id): r.score for r in contaminated(part, items, threshold=0.3, index_bytes=b).collect()} for b in (16 << 20, 2000))
    assert one and one == pytest.approx(several)


def test_wand_equals_scoring_all():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"v{int(x)}" for x in rng.zipf(1.4, 30) % 200) for _ in range(120)]
    index = Index(list(range(120)), texts)
    for _ in range(50):
        terms = np.unique(rng.integers(0, len(index.vocabulary), 25))
        total = np.zeros(index.n)
        for t in terms:
            a, b = index.bound[t], index.bound[t + 1]
            total[index.post_row[a:b]] += index.weight[a:b]
        assert sorted(r for r, _ in index.wand(terms, 0.2)) == np.flatnonzero(total >= 0.2 - 1e-9).tolist()


def test_lm_base(both):
    rows = [(r.doc_id, [*words(low(r.text)), None]) for r in both.collect()]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    c = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in rows), key=repr)
    out = lm_scores(both, tokenizer_file("byte_bpe_50k.tiktoken"), steps=30, sample=60).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr) == want
    assert all(r.score < 0 for r in out)


def test_lm_scores_token_by_token():
    """Batches of padded windows give what one id after another gives, each with its window's earlier ids alone."""
    rng = np.random.default_rng(6)
    size = 40
    spaced = np.append(rng.random(size) < 0.5, True)
    model = fit(rng.integers(0, 50, size + 1).astype(float), spaced, [np.append(rng.integers(0, size, 60), size) for _ in range(20)], steps=20, groups=5, members=4, inputs=10)
    texts = [rng.integers(0, size, n) for n in (0, 1, 30, 31, 32, 33, 55, 56, 57, 200)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    w, start = {k: v.astype(float) for k, v in model.weights.items()}, len(model.weights["E"]) - 1
    for text, got in zip(texts, model.score(np.concatenate(texts), first), strict=True):
        ids, want = np.append(text, size), 0.0
        rows = np.append(start, model.row_of[ids[:-1]])
        for i, y in enumerate(ids):
            begin = 0 if i < LENGTH else -(-(i + 1 - LENGTH) // STEP) * STEP
            h = w["E"][rows[begin : i + 1]] + w["P"][: i + 1 - begin]
            q, k, v = np.split(h @ w["QKV"], 3, axis=1)
            e = np.exp(q[-1] @ k.T / np.sqrt(h.shape[1]))
            z = h[-1] + (e / e.sum()) @ v @ w["O"]
            g, m = divmod(int(model.class_of[y]), 4)
            for logits, at in ((z @ w["V"] + w["b"], g), (z @ w["W"][g] + w["c"][g], m)):
                want += (logits[at] - np.log(np.exp(logits).sum())) / np.log(10)
            want += model.log_within[y]
        assert got == pytest.approx(want, rel=1e-4)


def test_lm_gradients():
    rng = np.random.default_rng(7)
    model = fit(rng.integers(1, 50, 21).astype(float), np.arange(21) % 2 == 0, [], groups=3, members=4, inputs=8)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, y = model.row_of[rng.integers(0, 21, (3, 9))], model.class_of[rng.integers(0, 21, (3, 9))]
    used = rng.random((3, 9)) < 0.7
    _, found = model.gradients(x, y, used)
    for name, w in model.weights.items():
        at = np.unravel_index(np.abs(found[name]).argmax(), w.shape)
        before, w[at] = w[at], w[at] + 1e-4
        high, _ = model.gradients(x, y, used)
        w[at] -= 2e-4
        low, _ = model.gradients(x, y, used)
        w[at] = before
        assert (high - low) / 2e-4 == pytest.approx(found[name][at], rel=2e-2, abs=1e-4), name


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(8)
    model = fit(rng.integers(0, 50, 31).astype(float), np.arange(31) % 2 == 0, [], groups=4, members=3, inputs=8)
    z = rng.normal(size=(1, len(model.weights["O"]))).astype(np.float32)
    total = sum(np.exp(model.log_probability(z, model.class_of[[y]])[0]) * 10 ** model.log_within[y] for y in range(31))
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_learns_from_texts_outside_the_sample(spark):
    """Two vocabularies of which a sample of one text can hold one; the third is in held-out texts only."""
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    lines = ["river stone river stone " * 8, "violet copper violet copper " * 8, "quartz meadow quartz meadow " * 8]
    rows = [(i, lines[i % 3]) for i in range(600) if i % 3 < 2 or held(i)]
    out = {}
    for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_file("byte_bpe_50k.tiktoken"), steps=20, sample=1).where("held_out").collect():
        out.setdefault(r.doc_id % 3, r.score)
    assert min(out[0], out[1]) > out[2] + 32


def test_lm_weights_follow_all_texts(spark):
    """Without any sample the rounds alone learn which of two equally frequent classes comes next, and partitions change nothing."""
    end = 2
    windows = np.array([drawn_windows(np.array([k % 2, 1 - k % 2] * 20), end, k, every=1)[1] for k in range(512)])
    rows = spark.createDataFrame([(k, bytearray(w.astype("<u2").tobytes())) for k, w in enumerate(windows)], "_row long, windows binary")
    fresh = fit(np.array([10.0, 10, 1]), np.array([True, True, True]), [], groups=3, members=1)
    models = [refined(fresh, rows.repartition(n), shard=200, rounds=4, rate=0.05) for n in (1, 3)]
    text, first = np.array([0, 1] * 20), np.array([0, 40])
    assert models[0].score(text, first)[0] > fresh.score(text, first)[0] + 5
    assert all(np.array_equal(models[0].weights[k], models[1].weights[k]) for k in fresh.weights)


def test_lm_trains_on_every_window(spark, monkeypatch):
    """Texts of many windows: the rounds together see each window once, whatever the text's length."""
    import claimweave.llm.lm_scoring as L

    texts, size = [np.arange(n) % 50 for n in (0, 5, 31, 32, 100, 3000)], 50
    model = fit(np.arange(1.0, size + 2), np.ones(size + 1, bool), [], groups=3, members=4)
    seen = []
    monkeypatch.setattr(L.Attention, "refine", lambda self, windows, *rest: seen.append(windows))
    batch = pa.RecordBatch.from_pydict({"_s": pa.array([0] * len(texts), pa.int32()), "ids": [t.astype("<u2").tobytes() for t in texts]})
    assert [r["n"] for b in L._refine(iter([batch]), model, 0.1) for r in b.to_pylist()] == [len(seen[0])]
    ends = [(w[1:] == size).sum() for w in seen[0]]
    assert sum(ends) >= len(texts)  # each text's end
    for t in texts:  # each id after the one before it, the start and the end included
        pairs = list(zip([size + 1, *t.tolist()], [*t.tolist(), size], strict=True))
        got = Counter(p for w in seen[0].tolist() for p in zip(w[:-1], w[1:], strict=True))
        assert all(got[p] >= c for p, c in Counter(pairs).items())
    assert len(seen[0]) == sum(max(1, -(-(len(t) + 1 - LENGTH) // STEP) + 1) for t in texts)
    rows = spark.createDataFrame([(k, bytearray(t.astype("<u2").tobytes())) for k, t in enumerate(texts)], "_row long, ids binary")
    monkeypatch.undo()
    models = [refined(model, rows.repartition(n), shard=40, rounds=2) for n in (1, 3)]
    assert all(np.array_equal(models[0].weights[k], models[1].weights[k]) for k in model.weights)


def test_lm_learns_each_id_once(monkeypatch):
    """Windows overlap; of whole texts each id and end is learnt once, from the place at which it is scored."""
    import claimweave.llm.lm_scoring as L

    texts, size = [np.arange(n) % 50 for n in (0, 5, 31, 32, 33, 100, 3000)], 50
    model, seen = fit(np.arange(1.0, size + 2), np.ones(size + 1, bool), [], groups=3, members=64), Counter()
    monkeypatch.setattr(L.Attention, "descend", lambda self, batches, rates: [seen.update(y[used].tolist()) for _, y, used in batches])
    batch = pa.RecordBatch.from_pydict({"_s": pa.array([0] * len(texts), pa.int32()), "ids": [t.astype("<u2").tobytes() for t in texts]})
    list(L._refine(iter([batch]), model, 0.1))
    assert seen == Counter(model.class_of[np.concatenate([np.append(t, size) for t in texts])].tolist())


def test_lm_leaves_out_classes_that_no_id_has():
    """A group's logits are computed for classes that some id has; others take no share, whatever their weights, and get no gradient."""
    freq = np.array([100.0] * 4 + [8, 7, 6, 5, 4, 3, 2, 1])
    model, rng = fit(freq, np.ones(12, bool), [], groups=5, members=16), np.random.default_rng(5)
    have = np.bincount(np.unique(model.class_of) // 16, minlength=len(model.weights["b"]))
    assert (have == 1).sum() >= 3 and (model.widths < 2 * have).all()
    for g, n in enumerate(model.widths):
        model.weights["c"][g, n:] = 30
    z = rng.normal(size=(4, len(model.weights["O"]))).astype(np.float32)
    whole = sum(np.exp(model.log_probability(z, model.class_of[[y] * 4])) * 10 ** model.log_within[y] for y in range(12))
    assert whole == pytest.approx(np.ones(4), abs=1e-3)
    _, found = model.gradients(model.row_of[rng.integers(0, 12, (3, 9))], model.class_of[rng.integers(0, 12, (3, 9))])
    assert all(not found["W"][g, :, n:].any() and not found["c"][g, n:].any() for g, n in enumerate(model.widths))


def test_lm_gradients_in_blocks(monkeypatch):
    """Blocks of windows and rows of any size give the gradients of one block, also where a block's first places aren't learnt."""
    import claimweave.llm.lm_scoring as L

    rng = np.random.default_rng(9)
    model = fit(rng.integers(1, 50, 41).astype(float), np.arange(41) % 2 == 0, [], groups=4, members=16, inputs=8)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, y = model.row_of[rng.integers(0, 41, (7, 12))], model.class_of[rng.integers(0, 41, (7, 12))]
    used = rng.random(x.shape) < 0.8
    used[:5, :4] = False
    loss, want = model.gradients(x, y, used)
    monkeypatch.setattr(L, "WINDOWS", 2)
    monkeypatch.setattr(L, "ROWS", 3)
    again, got = model.gradients(x, y, used)
    assert again == pytest.approx(loss) and all(np.allclose(got[k], want[k], rtol=1e-5, atol=1e-7) for k in want)


def test_subwords_split_a_word_once(monkeypatch):
    """Words known from earlier chunks aren't split again, and a cache that began anew gives the same ids."""
    import claimweave.llm.lm_scoring as L

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    texts = pa.array(["river stone A\u00a0b na\u00efve", "stone of a river", "", "12a% river x"])
    L._known(path).clear()
    once = [c.ids.tolist() for c in subwords(path, texts)]
    n = len(L._known(path).ids)
    assert [c.ids.tolist() for c in subwords(path, texts)] == once and len(L._known(path).ids) == n
    monkeypatch.setattr(L, "MOST_KNOWN", 1)
    assert [c.ids.tolist() for k in range(4) for c in subwords(path, texts.slice(k, 1))] == [c.ids[a:b].tolist() for c in subwords(path, texts) for a, b in itertools.pairwise(c.first)]


def test_lm_frees_the_shuffles_of_its_rounds(spark, both):
    """What counts and rounds have shuffled is off the disk once the scores can be asked for, and the session's setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    before, setting = files(), spark.conf.get(key)
    out = lm_scores(both, BPE, steps=5, sample=20)
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(key) == setting
    assert out.count() == both.count()


def test_subwords_are_those_of_each_word():
    texts = ["It's A\u00a0b  \u2003x\n\u3000", "", "na\u00efve \ud55c\uad6d\uc5b4 ''s 12a%\u0301 <|endoftext|>", "A" * 3000]
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    for c in subwords(path, pa.array(texts)):
        want = [[i for w in words(low(t)) for i in _tokenizer(path)[0].encode_ordinary(" " + w)] for t in texts]
        assert [c.ids[a:b].tolist() for a, b in zip(c.first[:-1], c.first[1:], strict=True)] == want and np.diff(c.at).tolist() == [len(words(t)) for t in texts]


def test_mix(both):
    out = source_mix(both).collect()
    assert len(out) == both.count() and all(r.copies <= 3 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    whole = sum(r.size for r in out)
    assert abs(sum(m[0].target for m in by.values()) - whole) <= 1e-6 * max(whole, 1)
    for m in by.values():
        assert sum(r.size for r in m) == m[0].source_size and m[0].target <= 3 * m[0].source_size + 1e-9
        assert abs(sum(r.copies * r.size for r in m) - m[0].target) <= 3 * max(r.size for r in m)


def test_token_counts(both):
    """Whole texts, as the tokenizer of the file counts them."""
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_file("piece_bpe_32k.model")
    exact = SentencePieceProcessor(model_file=path)
    for r in token_counts(both, path).collect():
        assert r.n_tokens == len(exact.encode(r.text or "")), r.text


def test_token_counts_of_any_text():
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_file("piece_bpe_32k.model")
    exact, own = SentencePieceProcessor(model_file=path), counter(read_vocabulary(path))
    rng = np.random.default_rng(4)
    letters = ["abcdefgh tionser ", "ab ", "\u00e9\u4e2d\U0001f600x \n\t", "\u2581 a", "  the of and in tion", "<s/>0xA "]
    texts = ["hello world", "internationalization of tokenizers", "a</s>b", "<unk> <0x41>", "  x", " ", "a" * 5000, "\x00 \ufffd"]
    texts += ["".join(rng.choice(list(letters[k % 6]), rng.integers(0, 50))) for k in range(3000)]
    for t in texts:
        assert own.text(t) == len(exact.encode(t)), t


def unigram_file(folder, pieces, byte):
    """A model file of the other kind with these pieces and scores; nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    kinds = {"<unk>": 2, "<s>": 3, "</s>": 3}
    more = [(f"<0x{b:02X}>", 0.0) for b in range(256)] if byte else []
    for piece, score in [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), *more, *pieces]:
        model.pieces.add(piece=piece, score=score, type=kinds.get(piece, 6 if piece.startswith("<0x") else 1))
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = byte
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    path = folder / f"unigram{byte}.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("byte", [True, False])
def test_token_counts_by_viterbi(tmp_path, byte):
    """The best path over a unigram vocabulary, ties and unknown characters included, as the library that owns the format finds it."""
    from sentencepiece import SentencePieceProcessor

    real = [p for p in read_vocabulary(tokenizer_file("piece_bpe_32k.model")).pieces if not p[0].startswith("<0x")]
    pieces = [(p, -float(np.log(k + 2.0))) for k, (p, _) in enumerate(real)]
    path = unigram_file(tmp_path, pieces, byte)
    exact, own = SentencePieceProcessor(model_file=path), counter(read_vocabulary(path))
    rng = np.random.default_rng(5)
    letters = ["abcdefgh tionser ", "ab ", "\u00e9\u4e2d\U0001f600x ", "  the of and in tion"]
    for k in range(1500):
        t = "".join(rng.choice(list(letters[k % 4]), rng.integers(0, 60)))
        assert own.text(t) == len(exact.encode(t)), t


def test_pieces_across_words():
    vocabulary = Vocabulary([("\u2581", -3.0), ("a", -2.0), ("b", -2.0), ("\u2581a", -4.0), ("a\u2581b", -1.0), ("\u2581\u2581a", -3.5)])
    assert [counter(vocabulary).text(t) for t in ("a b", "a", "  a", "c d")] == [2, 1, 2, 4]


BPE, PIECES = tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("piece_bpe_32k.model")
#: Operators that give a row for each row, on a table of documents.
EACH = {
    "op1": quality,
    "op2": substring_dedup,
    "op3": lambda d: toxicity(d, d.sparkSession.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")),
    "op4": jaccard_components,
    "op5": license_scan,
    "op6": lambda d: decontaminate(d, d.sparkSession.read.parquet(f"{SF}/benchmark.parquet")),
    "op7": lambda d: lm_scores(d, BPE, steps=5, sample=20),
    "op8": source_mix,
    "op9": lambda d: token_counts(d, PIECES),
    "op10": language_id,
}
PASSING = [k for k in EACH if k not in ("op4", "op7")]


@pytest.mark.parametrize("name", EACH)
def test_empty_tables(docs, name):
    assert EACH[name](docs.where("false")).count() == 0


def test_empty_benchmark_and_labels(spark, docs):
    items, labels = spark.read.parquet(f"{SF}/benchmark.parquet").where("false"), spark.createDataFrame([], "doc_id long, toxic int")
    assert decontaminate(docs, items).count() == docs.count() and contaminated(docs, items).count() == 0
    assert toxicity(docs, labels).count() == docs.count() and toxicity(docs.where("false"), labels).count() == 0


CLASHES = ["_key", "_row", "_words", "_hashes", "_w", "_weights", "_class", "_salt", "_rank", "_before", "_file", "_places", "_base", "_more", "_best", "_text", "_x", "_h", "row_key", "cuts", "file", "slot", "chunk"]


@pytest.mark.parametrize("name", EACH)
def test_columns_that_clash(docs, name):
    """Columns named like an operator's own go through unchanged; those named like its results, in any case, are replaced."""
    wide = docs.drop("score").select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES), F.create_map(F.lit("k"), F.col("doc_id")).alias("a_map"))
    wide = wide.select("*", *(F.lit(-7).alias(c) for c in ("SCORE", "N_Words", "Size", "Held_Out", "N_TOKENS", "Kept")))
    out = EACH[name](wide)
    rows = out.collect()
    assert len(rows) == docs.count()
    if name in PASSING:
        assert {c.lower() for c in wide.columns} <= {c.lower() for c in out.columns} and len({c.lower() for c in out.columns}) == len(out.columns)
        assert all(r[c] == c + ("none" if r.doc_id is None else str(r.doc_id)) for r in rows for c in CLASHES) and all(r.a_map == {"k": r.doc_id} for r in rows)
        plain = {c for c in EACH[name](docs.drop("score")).columns} - set(docs.columns)
        assert all(r[c] != -7 for r in rows for c in plain if r[c] is not None)


ODD_NAMES = ["a.b", "a`b", "a b", "text.x", "`", "."]


@pytest.mark.parametrize("name", EACH)
def test_columns_of_odd_names(docs, name):
    """Dots, backticks and spaces in names of further columns change nothing."""
    wide = docs.drop("score").select("*", *(F.lit(k).alias(c) for k, c in enumerate(ODD_NAMES)))
    out = EACH[name](wide)
    rows = out.collect()
    assert len(rows) == docs.count()
    if name in PASSING:
        assert set(wide.columns) <= set(out.columns)
        at = [out.columns.index(c) for c in ODD_NAMES]
        assert all([r[i] for i in at] == list(range(len(ODD_NAMES))) for r in rows)


def test_stages_with_columns_of_odd_names(spark, docs):
    from corpus_pipeline import STAGES

    wide = docs.drop("score").select("*", *(F.lit(k).alias(c) for k, c in enumerate(ODD_NAMES)))
    for name, stage in STAGES:
        assert set(wide.columns) <= set(stage(spark, wide, SF).columns), name
        assert stage(spark, wide, SF).count() >= 1 or name == "language_id"


@pytest.mark.parametrize("name", EACH)
def test_a_very_long_text(spark, docs, name):
    """Five megabytes in one text, the end of which counts."""
    rng = np.random.default_rng(9)
    long = " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 450_000)) + " Released under the MIT License."
    df = docs.drop("score").unionByName(spark.createDataFrame([(77, long, "en", "a")], "doc_id long, text string, lang string, source string"))
    [row] = EACH[name](df).where("doc_id = 77").collect()
    n = len(words(long))
    if name in ("op1", "op2"):
        assert row.n_words == n
    assert name != "op4" or row.n_shingles == n - 4
    assert name != "op5" or (row.n_base, row.last_word, row.labels) == (1, n - 2, "mit,mit-notice")
    assert name != "op7" or row.n_tokens == n + 1
    assert name != "op8" or row.size == n
    assert name != "op9" or row.n_tokens > n


def hot(spark, n=400):
    """One line, window, shingle and word in every text, a third of all rows alike, dealt over many partitions."""
    line = " ".join(f"shared{k}" for k in range(40))
    rows = [(i, f"{line} own{i} " + " ".join(f"t{i}_{k}" for k in range(30)) if i % 3 else f"{line} copied text") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(12), line


def test_hot_windows_send_little(spark, monkeypatch):
    """What a reducer gets of a window that all texts share follows the tasks and not the texts."""
    import claimweave.llm.exchange as exchange
    import claimweave.llm.parity_join as join
    import claimweave.llm.substring_dedup as dedup

    df, line = hot(spark)
    keys = {}
    real = exchange.dealt

    def counting(at):
        def run(source, pack_batches, n):
            out = real(source, pack_batches, n)
            if at not in keys:
                keys[at] = out.agg(F.max(F.length("keys")) / 8, F.sum(F.length("keys")) / 8).first()
            return out

        return run

    monkeypatch.setattr(dedup, "dealt", counting("op2"))
    monkeypatch.setattr(join, "dealt", counting("op4"))
    gone = {r.doc_id: r.n_removed for r in substring_dedup(df).collect()}
    assert all(gone[i] == (40 if i % 3 else 42) for i in gone)
    texts = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, jaccard_components(df).collect())) == sorted(components(texts))
    # 6 windows in all texts of 12 tasks, and some 70 of each text that no other has but are alone
    alone = sum(len(words(t)) - 34 - 6 for i, t in texts if i % 3)
    assert keys["op2"][1] <= alone + 12 * (6 + 2) + 100
    assert keys["op4"][1] <= sum(len(words(t)) for i, t in texts if i % 3) + 12 * 2 * 50


def stage_input(spark, docs, items):
    """Documents of one language with copies, near copies, shared passages and leaks."""
    passage = " ".join(f"passage{k}" for k in range(50))
    texts = [(r.doc_id, r.text) for r in docs.where("lang = 'en' and n_chars > 400").orderBy("doc_id").limit(30).collect()]
    rows = [(i, t, "en", "a" if i % 2 else "b", len(t)) for i, t in texts]
    rows += [(1000 + i, t, "en", "a", len(t)) for i, t in texts[:5]] + [(2000 + i, t + " more words", "en", "b", len(t) + 11) for i, t in texts[5:9]]
    rows += [(3000 + k, f"{passage} then {t}", "en", "c", len(t)) for k, (_, t) in enumerate(texts[10:14])]
    rows += [(4000 + k, f"{texts[20 + k][1]} {items[k]} end", "en", None, 5) for k in range(3)]
    rows += [(5000, passage, "en", "a", 5), (5001, None, None, None, None), (5002, "", "en", "a", 0), (None, "a short text here", "en", "b", 17), (None, "a short text here", "en", "b", 17)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_stages(spark, table):
    """Each stage by brute force on its own input."""
    import corpus_pipeline as cp

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    first = stage_input(spark, table, items)
    stage = dict(cp.STAGES)

    named = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id(first).collect()}
    out = stage["language_id"](spark, first, SF)
    want = [(r.doc_id, r.text) for r in first.collect() if named[r.doc_id, r.text][0] != "und" and named[r.doc_id, r.text][1] >= cp.LEAST_LANGUAGE_SCORE]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr) and out.columns == first.columns
    assert not {5001, 5002} & {i for i, _ in want}

    out = stage["near_duplicates"](spark, first, SF)
    rows = [(r.doc_id, r.text) for r in first.collect()]
    kept = {c for i, _, c in components(rows) if i is not None}
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(kept)
    assert [r.text for r in out.where("doc_id is null").collect()] == ["a short text here"] and out.columns == first.columns

    out = {r.doc_id: r for r in stage["substring_dedup"](spark, first, SF).collect() if r.doc_id is not None}
    seen = Counter(tuple(w[k : k + 35]) for _, t in rows for w in [words(t)] for k in range(len(w) - 34))
    for i, t in rows:
        w = words(t)
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        if i is not None:
            left = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
            assert (i not in out) if gone and len(gone) == len(w) else out[i].text == left and (not gone or out[i].n_chars == len(left))

    out = {r.doc_id for r in stage["decontamination"](spark, first, SF).collect()}
    leaks = {i for i, t in rows if any(x in (t or "") for x in items)}
    assert {4000, 4001, 4002} <= leaks and not leaks & out and out | leaks == {i for i, _ in rows}

    out = {(r.doc_id, r.text): r.copies for r in stage["source_mix"](spark, first, SF).collect()}
    assert out == {(r.doc_id, r.text): r.copies for r in source_mix(first).collect() if r.copies > 0}

    wide = first.select("*", F.create_map(F.lit("k"), F.col("doc_id")).alias("a_map"), *(F.lit(1).alias(c) for c in ("row_key", "cuts", "score", "N_Words", "kept_text", "aside", "lang_pred", "slot")))
    for name, f in cp.STAGES:
        assert f(spark, first.where("false"), SF).count() == 0, name
        if name != "source_mix":
            out = f(spark, wide, SF)
            assert out.columns == wide.columns and all(r.score == r.aside == 1 and r.a_map == {"k": r.doc_id} for r in out.collect()), name


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert out and not any(t in r.text for r in out for t in items) and all(r.copies > 0 for r in out)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    """Unlinked texts of one id all stay, and copies with null ids become one."""
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "y"), (3, a, "y"), (None, c, "x"), (None, c, "x"), (None, c, "y"), (4, d, "x"), (None, d, "x")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).collect()
    assert sorted((r.doc_id, r.text) for r in out if r.doc_id is not None) == [(1, a), (1, b), (4, d)]
    assert [r.text for r in out if r.doc_id is None] == [c]
