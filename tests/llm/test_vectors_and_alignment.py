"""Hard negatives, near copies of embeddings and alignment of tokenizers against brute force, and on rows that are odd."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import claimweave.llm.alignment as alignment
from claimweave.llm.alignment import aligned
from claimweave.llm.embedding_graph import embedding_components, neighbour_links
from claimweave.llm.hard_negatives import hard_negatives
from claimweave.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
FILES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], "vec_id long, embedding array<float>, label int, score double, `a.b` string")


@pytest.fixture
def odd(spark):
    """Null, empty, zero and non-finite vectors, nulls in every column, copies, ties, repeated ids, two lengths."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6)).round(1)
    x[10:20] = x[3]
    x[20:24] = x[20]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(100, None, 1), (101, [], 1), (102, [0.0] * 6, 1), (103, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (104, [math.nan] * 6, 1), (105, [math.inf] + [1.0] * 5, 1), (106, x[3].tolist(), None), (None, x[3].tolist(), 0), (3, x[30].tolist(), 0), (110, [1.0, 2.0], 1), (111, [2.0, 4.0], 1), (112, [1e30] * 6, 1), (113, [1e30] * 6, 1), (114, [-1e30] * 6, 2)]
    return vectors(spark, rows)


def usable(rows):
    return [r for r in rows if r.vec_id is not None and r.label is not None and r.embedding is not None and all(v is not None and math.isfinite(v) for v in r.embedding)]


def mined(rows, every, positives=5, k=10):
    rows = [(r.vec_id, r.label, [math.floor(256 * v) for v in r.embedding]) for r in usable(rows)]
    rows = [r for r in rows if sum(v * v for v in r[2]) < 2**53]
    out, seen = [], set()
    for i, label, v in rows:
        if i % every or (i, label, tuple(v)) in seen:
            continue
        seen.add((i, label, tuple(v)))
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in rows if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            near = [(t, n) for t, n, m in scored if m != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(near[:k], 1)]
    return sorted(out)


def test_hard_negatives(spark, odd):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    for df, every in ((table, 50), (odd, 3)):
        want = mined(df.collect(), every)
        assert want and sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % every == 0).collect()) == want


def test_hard_negatives_over_many_blocks(spark, odd, monkeypatch):
    from claimweave.llm import hard_negatives as module

    own = module.against_all
    monkeypatch.setattr(module, "against_all", lambda *a: own(*a, queries_each=4, rows_each=7))
    assert sorted(tuple(r) for r in hard_negatives(odd, F.col("vec_id") % 3 == 0).collect()) == mined(odd.collect(), 3)


def linked(rows, least=0.93):
    """Sorted (id, links, component, kept) by brute force."""
    fine = [r in usable([r]) and any(v for v in r.embedding) for r in rows]
    unit = [np.array(r.embedding, float) / np.abs(r.embedding).max() if f else None for r, f in zip(rows, fine, strict=True)]
    near = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and fine[i] and fine[j] and rows[i].label == rows[j].label and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]) >= least:
                    near[i].append(j)
    out = []
    for i, r in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in reach and not reach.add(j)]
        part = min((rows[j].vec_id for j in reach if rows[j].vec_id is not None), default=None)
        out.append((r.vec_id, len(near[i]), part, r.vec_id == part))
    return sorted(out, key=repr)


def test_embedding_components(spark, odd):
    got = sorted((tuple(r) for r in embedding_components(odd).collect()), key=repr)
    assert got == linked(odd.collect())
    assert embedding_components(odd.limit(0)).collect() == []


def test_saturated_lists_and_recall(spark, monkeypatch):
    """Families larger than a list, a chain, and lone pairs among vectors in no order: every link is counted."""
    from claimweave.llm import embedding_graph as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 24))
    x[100:160] = x[100] + 0.03 * rng.normal(size=(60, 24))
    turn = np.arange(30) * 0.2
    x[200:230] = 0
    x[200:230, 0], x[200:230, 1] = np.cos(turn), np.sin(turn)
    x[300:500:8] = x[301:500:8] + 0.05 * rng.normal(size=(25, 24))
    df = vectors(spark, [(int(i), v.tolist(), 1) for i, v in zip(rng.permutation(500), x, strict=True)])
    assert sorted((tuple(r) for r in embedding_components(df).collect()), key=repr) == linked(df.collect())


def test_audit_asks_for_more(spark, monkeypatch):
    """With one cut and no joins the audit finds too few links, and more follow."""
    from claimweave.llm import embedding_graph as module

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[::2] = x[1::2] + 0.12 * rng.normal(size=(300, 16))
    monkeypatch.setattr(module, "LEAF", 8)
    nodes = module._nodes(vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")))
    _, once = neighbour_links(nodes, 0.93, neighbours=2, trees=1, rounds=0, attempts=1)
    _, more = neighbour_links(nodes, 0.93, neighbours=2, trees=1, rounds=1, attempts=9)
    assert once < 0.95 < more


def alignment_of(rows):
    a = Tokenizer.from_file(tokenizer_file(FILES[0]))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_file(FILES[1]))
    plain = {**{c: c for c in map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)])}}
    rest = [n for n in range(256) if chr(n) not in plain]
    byte = {c: ord(c) for c in plain} | {chr(256 + k): n for k, n in enumerate(rest)}
    docs = []
    for doc_id, text in rows:
        x, y = [], []
        if text:
            x = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            for i in b.encode(text):
                p = b.id_to_piece(i)
                y.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
            if any(b"".join(p for _, p in z) != (" " + text).encode() for z in (x, y)):
                x, y = [], []
        ends = [dict(zip(np.cumsum([len(p) for _, p in z]).tolist(), [i for i, _ in z], strict=True)) for z in (x, y)]
        both = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][e], ends[1][e]) for e in both]
        groups = ["|".join(",".join(str(i) for e, i in z.items() if lo < e <= hi) for z in ends) for lo, hi in zip([0, *both], both, strict=False)]
        docs.append((doc_id, len(x), len(y), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if both else ""))
    count = Counter(pair for d in docs for pair in d[3])
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return sorted(((i, m, n, len(ls), len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls), s) for i, m, n, ls, s in docs), key=repr)


ODD = [None, "", " ", "  two  spaces ", "a▁b", "<s> <|endoftext|> <0x41>", "tab\tand\r\nlines\n\n", "ﬁne ​zero\x00", "été naïve 東京 🎉🎉", "x" * 3000, "don't can't we'll  12,345.67", "same text", "same text"]


def aligned_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_alignment(spark, docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(11, "same text"), (None, "no id"), (None, None)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a long, `h.m` string")
    files = [tokenizer_file(f) for f in FILES]
    assert aligned_rows(aligned(table, *files)) == alignment_of(rows)
    assert aligned(table.limit(0), *files).collect() == []
    whole = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert aligned_rows(aligned(whole, *files)) == alignment_of([tuple(r) for r in whole.collect()])
    assert aligned(docs, *files).count() == docs.count()


def test_alignment_over_many_stretches_and_chunks(spark, monkeypatch):
    """Long texts cross stretches, slabs and chunks; tiny bounds must not change a row."""
    import inspect

    long = " ".join(f"wörd{i % 97} 東{i}" for i in range(400))
    rows = [(1, long), (2, long[:1500]), (3, "x"), (4, None), (5, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files = [tokenizer_file(f) for f in FILES]
    want = alignment_of(rows)
    assert aligned_rows(aligned(df, *files)) == want
    # tasks take the bounds from their own import of the module
    source = inspect.getsource(alignment)
    assert "STRETCH, LINKS, PARTS, SLAB, TEXTS = 1 << 16, 1 << 20, 1 << 16, 1 << 18, 4 << 20" in source
    small = {**vars(alignment)}
    exec(source.replace("STRETCH, LINKS, PARTS, SLAB, TEXTS = 1 << 16, 1 << 20, 1 << 16, 1 << 18, 4 << 20", "STRETCH, LINKS, PARTS, SLAB, TEXTS = 64, 400, 3, 100, 1000").replace("from __future__ import annotations", ""), small | {"__name__": "__main__"}, small)
    assert aligned_rows(small["aligned"](df, *files)) == want


def test_other_tokenizer_files_fail_early(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"model": {"type": "WordPiece", "vocab": {}}, "pre_tokenizer": {"type": "ByteLevel"}}')
    with pytest.raises(ValueError, match="byte-level"):
        aligned(spark.createDataFrame([(1, "x")], "doc_id long, text string"), str(tmp_path / "x.json"), tokenizer_file(FILES[1]))
