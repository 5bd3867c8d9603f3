"""Token alignment, licence scans and hard negatives against plain versions, with nulls, ties, repeats, empty tables and
clashing names."""

import bisect
import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lakeloom.llm.hard_negatives import Rotation, mine, op11_hard_negatives
from lakeloom.llm.hard_negatives import ORACLE_SQL as NEGATIVES_SQL
from lakeloom.llm.license_scan import ORACLE_SQL as LICENSE_SQL
from lakeloom.llm.license_scan import PHRASES, known_licenses, op12_license_scan, scan_licenses
from lakeloom.llm.token_alignment import align
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = ("row", "words", "id", "n_words", "tid", "label", "whole", "length", "k", "tpos", "dpos", "run", "stripe", "pairs", "n", "docs", "doc", "times", "text_", "v", "anchor", "tile", "side", "near", "low", "high", "place", "score", "rank")


def plain_alignment(texts):
    """Every number of the contract, from whole texts and sets of links."""
    a_model, b_model = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a_model.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    docs = []
    for t in texts:
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        a_bytes = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            docs.append((0, 0, []))
            continue
        ends_a, ends_b = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        docs.append((len(a), len(b), groups))
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for _, _, g in docs]
    counts, most = Counter(p for each in links for p in each), defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    digest = lambda g: hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g).encode()).hexdigest() if g else ""
    return [(a, b, len(g), sum(each.values()), sum(n for p, n in each.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in each.items()), digest(g)) for (a, b, g), each in zip(docs, links)]


ODD_TEXTS = [
    None, "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  ", "a  b", "a \n b", "a\n b", "a\n\n  b\t", "\tx", "x  y", "x  y", "x　 y", "x\x1c y", "x\x85 y", "a\r\n b", "<|endoftext|> and <s> </s> <unk> <0x0A>", "▁x", "x ▁", "it's we'll I'D 'tis", "naïve café ÀÉ", "ﬁ ½ ² K", "日本語 テキスト 12", "🙂🙂 👩‍👩‍👧 a🙂b", "é ́x",
    "x" * 3000, "word " * 5000, "a b\n" * 3000, "0123456789 1,234.5 --- ... ((( )))", "don't  stop \t now   ok", "​x ​ y", "\x00 a\x00b", "Ω≈ç√∫˜µ≤", "اللغة العربية", "हिन्दी भाषा",
]


def aligned(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_alignment_of_odd_texts(spark):
    texts = [*ODD_TEXTS, *ODD_TEXTS[6:14]]
    docs = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = [(i if i != 3 else None, *w) for i, w in enumerate(plain_alignment(texts))]
    for options in ({}, {"run_bytes": 2000, "task_bytes": 300, "block_bytes": 8 << 20}):
        got = align(docs, *PATHS, **options)
        assert Counter(tuple(r) for r in got.select("doc_id", *columns).collect()) == Counter(want)
    assert align(docs.limit(0), *PATHS).count() == 0


def test_alignment_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, plain_alignment([r.text for r in rows])))
    got = align(docs, *PATHS).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(map(tuple, got.collect())) == want


def test_long_texts_are_cut_at_seams(spark, monkeypatch):
    from lakeloom.llm import token_alignment

    whole, cut = token_alignment.Vocabularies(*PATHS), token_alignment.Vocabularies(*PATHS)
    texts = [t for t in ODD_TEXTS if t] + [" ".join(t for t in ODD_TEXTS if t)]
    want = whole.encode(texts)
    monkeypatch.setattr(token_alignment, "PART", 5)
    got = cut.encode(texts)
    assert (want[0] == got[0]).all() and want[1] == got[1] and all((x == y).all() for x, y in zip(want[2:], got[2:]))


def test_license_digest_against_sql(spark):
    assert_same(op12_license_scan(spark, SF).toPandas(), LICENSE_SQL, SF)


def test_license_edges(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    words = mit.split()
    rows = [(1, "MIT License"), (1, "MIT License"), (2, None), (3, ""), (4, "..."), (None, "the mit\nlicense apache license CC-BY, cc by"), (5, "mıt license MIT LİCENSE mitlicense"), (6, "GNU general public gnu general public license"),
            (7, mit), (8, " ".join([*words[:10], "new", *words[10:]])), (9, " ".join(words[:12])), (10, " ".join(reversed(words))), (11, "x " * 30_000 + mit + " y" * 30_000), (12, "cc " * 5 + "by")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})
    got = defaultdict(list)
    for r in scan_licenses(docs, known_licenses(spark)).collect():
        got[r.row.doc_id].append((r.n_words, [(s.start, s.end, s.label, s.whole) for s in r.spans], r.best))
    assert got[1] == [(2, [(0, 2, "mit", True)], 1.0)] * 2
    assert got[2] == got[3] == got[4] == [(0, [], 0.0)]
    assert got[None] == [(9, [(1, 3, "mit", True), (3, 5, "apache", True), (5, 7, "cc-by", True), (7, 9, "cc-by", True)], 1.0)]
    assert got[5] == [(5, [], 0.0)]
    assert got[6][0][1] == [(3, 7, "gpl", True)]
    n = len(re.findall(r"\w+", mit))
    assert got[7][0][1:] == ([(0, n, "mit", False)], 1.0) and got[8][0][1] == [(0, n + 1, "mit", False)] and got[11][0][1] == [(30_000, 30_000 + n, "mit", False)]
    assert got[9][0][1] == [] and 0.3 < got[9][0][2] < 0.5 and got[10][0][1] == []
    assert got[12][0][1] == [(4, 6, "cc-by", True)]
    none = scan_licenses(docs, known_licenses(spark).limit(0))
    assert none.count() == len(rows) and none.where("size(spans) > 0 or best > 0").count() == 0
    assert scan_licenses(docs.limit(0), known_licenses(spark)).count() == 0
    twice = known_licenses(spark).unionByName(known_licenses(spark)).unionByName(spark.sql("SELECT 'none' AS label, ' . ' AS text, true AS whole"))
    assert sorted(map(str, scan_licenses(docs, twice).collect())) == sorted(map(str, scan_licenses(docs, known_licenses(spark)).collect()))
    assert len(PHRASES) == 4


def plain_negatives(rows, is_anchor):
    """rows: (id, vector, label); every row is its own, also if its id or vector comes again."""
    fine = [(k, i, lab, np.floor(256 * np.array(v, float)).astype(int)) for k, (i, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    last = lambda i: (i is None, i or 0)
    out = []
    for k, i, lab, q in fine:
        if i is None or not is_anchor(i):
            continue
        scored = sorted(((-int(q @ x), last(j), m, j, other) for m, j, other, x in fine if m != k))
        for s, _, _, j, other in [x for x in scored if x[4] == lab][:5]:
            hits = [(n, -t) for t, _, _, n, o in scored if o != lab and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, r, n, -s, t) for r, (n, t) in enumerate(hits, 1)]
    return Counter(out)


def test_hard_negatives_against_sql(spark):
    assert_same(op11_hard_negatives(spark, SF).toPandas(), NEGATIVES_SQL, SF)


def test_hard_negatives_edges(spark):
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 1) / (i + 1) for i in range(12)]
    rows = [(i, vector(), rng.randrange(3)) for i in range(400)]
    same = vector()
    rows += [(i, same, i % 2) for i in range(400, 700)] + [(10, vector(), 1), (10, rows[10][1], rows[10][2]), (None, vector(), 2), (None, same, 1)]
    rows += [(800, [float("nan")] * 12, 1), (810, None, 1), (820, [None] * 12, 1), (830, vector(), None), (840, [0.0] * 12, 1), (850, [float("inf")] + [0.0] * 11, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(7) for c in CLASH if c != "label"})
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    for options in ({}, {"block_bytes": 3000, "group": 7, "probe": 50}, {"probe": 0}):
        got = mine(frame, F.col("vec_id") % 10 == 0, **options)
        assert Counter(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    odd = frame.unionByName(spark.createDataFrame([(0, [1.0], 1), (20, [1e300] * 12, 1)], "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(7) for c in CLASH if c != "label"}))
    assert Counter(map(tuple, mine(odd, F.col("vec_id") % 10 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    assert mine(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert mine(frame, F.lit(None).cast("boolean")).count() == 0
    assert mine(frame.where("label = 1"), F.col("vec_id") % 10 == 0).count() == 0


def test_partial_products_discard_only_what_lies_outside():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(500, 32)) * 256 / np.arange(1, 33)).astype(np.int64)
    rotation = Rotation(x[:200])
    assert np.allclose(rotation.basis @ rotation.basis.T, np.eye(32))
    score = x[:40] @ x.T
    low, high = np.quantile(score, 0.97, axis=1), np.quantile(score, 0.995, axis=1)
    q, block = rotation.turn(x[:40]), rotation.turn(x)
    row, column = rotation.survivors(q, block, low, high, np.ones((40, 500), bool))
    inside = (score >= low[:, None]) & (score <= high[:, None])
    assert {*zip(*np.nonzero(inside))} <= {*zip(row, column)} and len(row) < 2 * inside.sum()
