import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import registry
from lakeloom.llm._common import Words
from lakeloom.llm.decontaminate import find_leaks
from lakeloom.llm.line_dedup import drop_boilerplate
from lakeloom.llm.lm_score import BITS, fold, score_documents
from lakeloom.llm.minhash_dedup import _profile, near_duplicates
from lakeloom.llm.quality import score_quality
from lakeloom.llm.source_mix import mix_sources
from lakeloom.llm.token_count import count_tokens
from lakeloom.llm.toxicity import score_toxicity
from lakeloom.llm.url_filter import judge_urls, rule_table
from lakeloom.llm.vector_search import nearest
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=()):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + list(extra), DOC)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF).toPandas(), registry.ORACLE_SQL[name], SF)


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(60)]
    texts = ["", None, "  ", "one", "ONE", "a b", "a b"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for k in range(rng.randint(1, 6)):
            own = base[:]
            for _ in range(k * len(own) // 60):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [" ".join(shared + [rng.choice(words) for _ in range(rng.randint(5, 40))]) for _ in range(40)]
    for size, percent in ((2, 80), (5, 80)):
        n, comp = brute_components(texts, size, percent)
        got = {r.doc_id: r for r in near_duplicates(documents(spark, texts), size, percent).collect()}
        assert [got[i].n_shingles for i in range(len(texts))] == n
        assert [got[i].component_id for i in range(len(texts))] == comp
        assert all(got[i].kept == (i == comp[i]) for i in got)


def test_near_duplicates_that_share_one_band(spark):
    rng = random.Random(11)
    words, (run, _) = [f"w{i}" for i in range(5000)], _profile(1)

    def profiles(texts):
        batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        return [r for b in run([batch]) for r in b.to_pylist()]

    def edited(text, n):
        w = text.split()
        for i, new in zip(rng.sample(range(len(w)), n), rng.sample([f"n{i}" for i in range(5000)], n)):
            w[i] = new
        return " ".join(w)

    # 84 words, 12 others: similarity 72/96; the pair meets in one bucket only, and its larger node has a smaller hub elsewhere
    base = [" ".join(rng.sample(words, 84)) for _ in range(600)]
    copies = [edited(t, 12) for t in base]
    x, y = next((a, b) if p["node"] > q["node"] else (b, a) for a, b, p, q in zip(base, copies, profiles(base), profiles(copies)) if len(set(p["bands"]) & set(q["bands"])) == 1 and min(p["node"], q["node"]) > 0)
    px, py = profiles([x, y])
    near = [edited(x, 16) for _ in range(200)]
    z = next(t for t, p in zip(near, profiles(near)) if set(p["bands"]) & set(px["bands"]) and not set(p["bands"]) & set(py["bands"]) and p["node"] < py["node"])
    _, comp = brute_components([x, y, z], 1, 75)
    assert comp == [0, 0, 2]
    assert [r.component_id for r in near_duplicates(documents(spark, [x, y, z]), 1, 75).orderBy("doc_id").collect()] == comp


def test_leaks_are_found_within_edits(spark):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(900)]
    items = [[rng.choice(words) for _ in range(rng.randint(8, 40))] for _ in range(20)]
    texts, want = ["", None, "short"], set()
    for i, item in enumerate(items):
        own = item[:]
        for _ in range(i % (int(0.2 * len(item)) + 1)):
            own[rng.randrange(len(own))] = rng.choice(words)
        want.add((len(texts), i))
        texts.append(" ".join([rng.choice(words) for _ in range(30)] + own + [rng.choice(words) for _ in range(10)]))
        texts.append(" ".join(rng.choice(words) for _ in range(80)))
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (None, "a b c d e f"), (99, None), (98, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(documents(spark, texts), bench).collect()} == want
    assert find_leaks(documents(spark, texts), bench.limit(0)).count() == 0


def test_tokens_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", None, "Hello  world's\n\n <|endoftext|>x", "naïve łódź 漢字   ٣٤ aaaa" * 20, "a" * 5000, "\t \r\n" * 50]
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r.doc_id: r for r in count_tokens(documents(spark, texts), path).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 24)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] * 24), (1060, [1.0]), (None, [1.0] * 24)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    d = x.astype(float)
    assert set(got) == set(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        s = (d * d[q]).sum(axis=1)
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in found)
        hit += len(set(best) & {i for _, i, _ in found})
    assert hit / (20 * len(got)) >= 0.99
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_language_model_scores_against_plain_counts(spark):
    rng = random.Random(4)
    good, bad = [f"g{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    texts = [" ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(5, 30))) for i in range(60)] + ["", None]
    target = spark.createDataFrame([(i,) for i in range(1, 40, 2)] + [(None,), (1,)], "doc_id long")
    got = {r.doc_id: r for r in score_documents(documents(spark, texts), target).collect()}
    assert got[60].score == got[61].score == 0 and got[60].target_loss is None
    assert min(got[i].score for i in range(1, 60, 2)) > max(got[i].score for i in range(0, 60, 2))
    assert all(abs(r.background_loss - r.target_loss - r.score) < 1e-9 for r in got.values() if r.n_words)
    assert 1 << BITS > 1_000_000 and score_documents(documents(spark, [])  , target).count() == 0


def test_language_model_counts_every_word_and_pair(spark):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(70)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(120)] + ["", None, "w1 w1 w1"]
    texts += [texts[3], texts[3], " ".join(f"long{i}" for i in range(70_000)), " ".join(f"long{i}" for i in range(0, 70_000, 2))]
    docs, wanted = documents(spark, texts, [(None, texts[5], None, None, None)]), set(range(0, 120, 3)) | {125}
    rows = [(r.doc_id, (r.text or "").split(), r.f) for r in docs.withColumn("f", fold(F.col("text"))).collect()]
    pair, word, history = ({(f, k): Counter() for f in (0, 1) for k in (0, 1)} for _ in range(3))
    for i, w, f in rows:
        for k in (0, 1) if i in wanted else (1,):
            word[f, k].update(w)
            history[f, k].update([""] + w[:-1] if w else [])
            pair[f, k].update(zip([""] + w[:-1], w))
    size, want = len({x for _, w, _ in rows for x in w}) + 2, []
    for i, w, f in rows:
        means = []
        for k in (0, 1):
            o, target = (1 - f, k), word[1 - f, 0].total()
            scale = target / word[o].total() if k else 1
            alone = [50 * (word[o][x] * scale + 0.5) / (target + 0.5 * size) for x in w]
            loss = [-math.log((pair[o][a, b] * scale + p) / (history[o][a] * scale + 50)) for a, b, p in zip([""] + w[:-1], w, alone)]
            means.append(sum(loss) / len(w) if w else None)
        want.append((str(i), len(w), means))
    for bits in (BITS, 6, 0):
        got = sorted((str(r.doc_id), r.n_words, r.target_loss, r.background_loss) for r in score_documents(docs, spark.createDataFrame([(i,) for i in wanted], "doc_id long"), bits=bits).collect())
        assert [g[:2] for g in got] == sorted(x[:2] for x in want)
        for g, x in zip(got, sorted(want, key=lambda x: x[:2])):
            assert g[2:] == (None, None) if x[2][0] is None else g[2:] == pytest.approx(x[2], abs=1e-6)


def test_classifiers_tell_held_out_documents_apart(spark):
    rng = random.Random(6)
    nice, rude = ["alpha", "beta", "gamma", "delta"], ["grubble", "snark"]
    texts, labels = [], []
    for i in range(240):
        w = [rng.choice(nice) for _ in range(30)]
        y = i % 2
        if y:
            w[rng.randrange(30)] = rng.choice(rude)
        texts.append((" ".join(w).upper() + "!!! 123") if i % 3 == 0 else " ".join(w))
        labels.append((i, 0 if i % 3 == 0 else 1, y))
    docs, table = documents(spark, texts + ["", None]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for f, k in ((score_quality, 1), (score_toxicity, 2)):
        out = f(docs, table).collect()
        held = [r for r in out if r.held_out and r.doc_id < 240]
        assert len(out) == 242 and all(0 <= r.score <= 1 for r in out)
        assert sum(r.predicted == labels[r.doc_id][k] for r in held) / len(held) > 0.9
        assert f(docs, table.limit(0)).count() == 242


def test_empty_tables_nulls_and_clashing_columns(spark):
    empty = documents(spark, [])
    odd = documents(spark, ["a\nb", None, ""], [(None, "x", None, None, None), (1, "x", None, None, None)]).withColumns({"size": F.lit(1), "_host": F.lit("z"), "node": F.lit(2), "n_lines": F.lit(9)})
    for docs, n in ((empty, 0), (odd, 5)):
        assert near_duplicates(docs).count() == n
        assert drop_boilerplate(docs.drop("_host")).count() == n
        assert mix_sources(docs).count() == n
    urls = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://A.EXAMPLE.org/es/x?y"), (3, "HTTP://A.EXAMPLE.org/es/x?y"), (None, "http://x.com/de/#")], "page_id long, url string")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in judge_urls(urls, rule_table(spark)).collect())
    assert got[2:4] == [("3", "a.example.org", "/es/x", "example.org/es/", "block")] * 2 and got[4] == ("None", "x.com", "/de/", "com/de/", "block")
    assert judge_urls(urls.limit(0), rule_table(spark)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("taken > 2 * size").count() == 0
    kept = [r.text for r in out.select("text").collect()]
    assert len(set(kept)) == len(kept)


def test_pipeline_stages_decide_by_row(spark, tmp_path):
    rng = random.Random(8)
    good = [" ".join(rng.choice(["the", "river", "Bank", "stone", "of", "light"]) + str(i * k) for k in range(30)) for i in range(1, 9)]
    junk, item = "@@@ ### !!! 000 " * 12, " ".join(f"q{i}" for i in range(20))
    spark.createDataFrame([(i, i % 2, 0) for i in range(100, 160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    base = [(i, good[i % 8] + f" extra{i}" if i % 2 else junk + str(i), "en", "s", 9) for i in range(100, 160)]

    def through(stage, texts):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
        return Counter((r.doc_id, r.text) for r in stage(spark, spark.createDataFrame(rows, DOC), str(tmp_path)).collect())

    labelled = [r[:2] for r in base]
    got = through(corpus_pipeline.quality, [*labelled, (1, good[0]), (1, junk), (None, junk), (None, good[1]), (None, good[1])])
    assert got[1, good[0]] == 1 and got[None, good[1]] == 2 and not got[1, junk] and not got[None, junk]
    got = through(corpus_pipeline.near_copies, [(3, good[0]), (2, good[0]), (2, good[1]), (1, good[1]), (None, good[2]), (None, good[2]), (None, good[0]), (None, ""), (None, None), (5, " "), (4, good[3]), (4, good[3])])
    assert got == Counter([(2, good[0]), (1, good[1]), (None, good[2]), (None, ""), (None, None), (5, " "), (4, good[3])])
    got = through(corpus_pipeline.benchmark_free, [(1, good[0]), (1, item), (None, item), (None, good[1]), (2, None)])
    assert got == Counter([(1, good[0]), (None, good[1]), (2, None)])
    rows = [(1, good[0], "en", "a", 9), (1, good[0] + " more", "en", "a", 9), (1, "", "en", "a", 0), (None, good[1], "en", "a", 9), (None, good[2], None, None, 9), (2, good[3], "en", "b", 9), (2, good[3], "en", "b", 9)]
    docs = spark.createDataFrame(rows, DOC)
    got = corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect()
    taken = [r for r in mix_sources(docs).collect() if r.taken]
    assert sorted((str(r.doc_id), r.size, r.source_size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.source_size, r.taken) for r in taken)
    assert all(r["size"] == len(r.text.split()) for r in got) and sum(r.doc_id is None for r in got) == 2


def test_words(spark):
    w = Words(["Ab  c".encode(), b"", " \n".encode(), "ż".encode()])
    assert list(w.first) == [0, 2, 2, 2, 3]
