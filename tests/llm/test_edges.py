"""Each operator and stage with nulls, empty and very long texts, repeated rows, empty tables and clashing column names; and
plain versions of what SQL can't express."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm._common import Words
from lakeloom.llm.decontaminate import drop_leaks, find_leaks
from lakeloom.llm.line_dedup import drop_boilerplate
from lakeloom.llm.lm_score import score_documents
from lakeloom.llm.minhash_dedup import near_duplicates
from lakeloom.llm.quality import BITS, features, fit, score_quality
from lakeloom.llm.source_mix import mix_sources
from lakeloom.llm.token_count import count_tokens
from lakeloom.llm.toxicity import fit_ratios, score_toxicity, word_grams
from lakeloom.llm.url_filter import judge_urls, rule_table
from lakeloom.llm.vector_search import nearest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("_host", "_no_host", "_lines", "_drop", "_kept", "_row", "_key", "_text", "size", "node", "key", "kind", "label", "score", "group", "host", "lines", "row", "n_lines", "n_dropped", "k1", "k2", "_id", "_md5", "ordinal", "block", "word", "_stays", "_copy", "source_size", "target", "taken", "mark", "stays", "rows")
LONG = " ".join(f"w{i}" for i in range(20_000))


def odd_documents(spark):
    rows = [(1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (1, "other words", "en", "a", 1), (2, None, "en", "a", 0), (3, "", None, None, None), (4, " \n\t ", "en", "b", 0), (None, "one two three four five six", "en", "a", 1), (None, None, None, None, None), (5, LONG, "en", "b", 9), (6, LONG + " more", "en", "b", 9)]
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit(7) for c in CLASH})


def labels(spark, n=0):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_near_duplicates_edges(spark):
    got = rows_of(near_duplicates(odd_documents(spark)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == Counter({(1, 2, 1, True): 2, (1, 1, 1, True): 1, (2, 0, 2, True): 1, (3, 0, 3, True): 1, (4, 0, 4, True): 1, (None, 2, 1, False): 1, (None, 0, None, True): 1, (5, 19996, 5, True): 1, (6, 19997, 5, False): 1})
    assert near_duplicates(odd_documents(spark).limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "x y z"), (None, "x y z")], "doc_id long, text string")
    assert rows_of(near_duplicates(alone), "component_id", "kept") == {(None, True): 2}
    assert len(rows_of(near_duplicates(alone, keep=("text",)), "_text")) == 1


def test_many_members_of_a_bucket_that_are_not_alike(spark):
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(140)]
    texts = [" ".join(shared + [f"d{d}x{i}" for i in range(60)]) for d in range(300)] + [" ".join(shared)] * 500
    texts += [" ".join([*shared[:70], f"c{d}", *shared[71:]]) for d in range(200)]
    rng.shuffle(texts)
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1, 80).collect()
    alike = [i for i, t in enumerate(texts) if "x" not in t]
    assert {r.component_id for r in got if "x" not in texts[r.doc_id]} == {min(alike)}
    assert sum(r.kept for r in got) == 301 and all(r.component_id == r.doc_id for r in got if "x" in texts[r.doc_id])


def test_line_dedup_edges(spark):
    rows = [(i, "© all rights\nown line %d\n\n© all rights" % i, "en", "h" if i < 6 else None, 1) for i in range(12)]
    docs = spark.createDataFrame([*rows, (None, None, "en", "h", 0), (50, "", "en", "h", 0), (51, "© all rights", "en", "h", 0), (52, "single page", "en", "x", 0), (53, LONG + "\n© all rights", "en", "h", 0)], DOC).withColumns({c: F.lit(7) for c in CLASH})
    out = drop_boilerplate(docs)
    assert out.columns == [c for c in docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped, r._drop) for r in out.collect()}
    assert got[0] == ("own line 0\n", 4, 2, 7) and got[7] == ("own line 7\n", 4, 2, 7) and got[None] == (None, 0, 0, 7) and got[50] == ("", 1, 0, 7)
    assert got[51] == ("", 1, 1, 7) and got[52] == ("single page", 1, 0, 7) and got[53] == (LONG, 2, 1, 7)
    assert drop_boilerplate(docs.limit(0)).count() == 0


def plain_leaks(texts, items, rate=0.2):
    import re

    words = lambda t: re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", (t or "").lower()).split()
    found = set()
    for d, t in texts:
        w = words(t)
        for i, item in items:
            x = words(item)
            k, row = int(rate * len(x)), [0] * (len(w) + 1)
            for a, s in enumerate(x, 1):
                last, row = row, [a]
                for b, u in enumerate(w, 1):
                    row.append(min(last[b] + 1, row[-1] + 1, last[b - 1] + (s != u)))
            if x and min(row) <= k:
                found.add((d, i, min(row)))
    return found


def test_leaks_against_edit_distances_over_all_stretches(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 15, 20, 25, 30])]
    items += [(20, items[9][1]), (21, "v1  V2, v3"), (22, " ..."), (23, None), (None, "v1 v2")]
    texts = [(0, None), (1, ""), (2, items[11][1])]
    for d in range(3, 60):
        own = rng.choice(items[:14])[1].split()
        for _ in range(rng.randint(0, int(0.25 * len(own)) + 1)):
            at = rng.randrange(len(own) + 1)
            own[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        texts.append((d, " ".join(rng.choices(words, k=rng.randint(0, 30)) + own + rng.choices(words, k=rng.randint(0, 30)))))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(texts, [x for x in items if x[0] is not None and x[1]])
    found = find_leaks(docs, bench).collect()
    got = {(r.doc_id, r.item_id, r.edits) for r in found}
    print(f"recall {len(got & want) / len(want):.4f} of {len(want)}")
    assert len(got) == len(found) and {g[:2] for g in got} <= {w[:2] for w in want} and len({g[:2] for g in got}) >= 0.99 * len(want)
    hit = {g[0] for g in got}
    assert sorted(r.doc_id for r in drop_leaks(docs, bench).collect()) == sorted(d for d, _ in texts if d not in hit)


def test_decontamination_edges(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, "three four five"), (2, " ".join(f"w{i}" for i in range(19_980, 20_000))), (2, "three four five")], "item_id long, text string").withColumn("key", F.lit(1))
    got = rows_of(find_leaks(docs, bench), "doc_id", "item_id", "edits")
    assert got == Counter({(1, 1, 0): 2, (1, 2, 0): 2, (None, 1, 0): 1, (None, 2, 0): 1, (5, 2, 0): 1, (6, 2, 0): 1})
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == {(1,): 1, (2,): 1, (3,): 1, (4,): 1, (None,): 1}
    assert drop_leaks(docs, bench.limit(0)).count() == 10 and find_leaks(docs.limit(0), bench).count() == 0


def test_token_counts_edges(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = odd_documents(spark)
    library = Tokenizer.from_file(path)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert rows_of(count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens") == want
    assert count_tokens(docs.limit(0), path).count() == 0


def test_vectors_with_cells_blocks_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16)) * 3
    x = (centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16))).astype(np.float32)
    x[500:560] = x[500]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(4000, None), (None, [1.0] * 16), (20, [float(v) for v in x[20]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("k1", "v", "block", "cell", "ids", "side")})
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, 20, block_rows=40, probe_rows=300).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    d, hit, same = x.astype(float), 0, 0
    assert set(got) == set(range(0, 3000, 20))
    for q, found in got.items():
        s = d @ d[q]
        best = sorted((i for i in range(3000) if i != q), key=lambda i: (-s[i], i))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in found)
        hit, same = hit + len(set(best) & {i for _, i, _ in found}), same + ([i for _, i, _ in found] == best)
    print(f"recall {hit / (20 * len(got)):.4f}, equal lists {same} of {len(got)}")
    assert hit / (20 * len(got)) >= 0.99


def test_urls_edges(spark):
    urls = spark.createDataFrame([(1, None), (1, None), (None, "http://x.com/fr/"), (2, "http://A.com/fr/" + "x" * 50_000)], "page_id long, url string").withColumns({c: F.lit(3) for c in CLASH})
    got = rows_of(judge_urls(urls, rule_table(spark)), "page_id", "host", "rule", "verdict")
    assert {g[:3] for g in got} == {(1, "", None), (None, "x.com", "com/fr/"), (2, "a.com", "com/fr/")} and got.total() == 4
    assert rows_of(judge_urls(urls, rule_table(spark).limit(0)), "rule") == {(None,): 4}


def test_urls_follow_the_contracts_rules(spark):
    urls = spark.createDataFrame([(k, f"http://{u}") for k, u in enumerate(("a.org/x", "example.org/es/x", "sub.example.org/en/12", "example.org/en/2", "b.com/fr/", "b.com/de/", "b.net/"))], "page_id long, url string")
    got = [(r.rule, r.verdict) for r in judge_urls(urls, rule_table(spark)).orderBy("page_id").collect()]
    assert got == [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow")]


def test_classifiers_edges(spark):
    docs = odd_documents(spark)
    for score in (score_quality, score_toxicity):
        for table in (labels(spark), labels(spark, 9)):
            out = score(docs, table).collect()
            assert len(out) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out) and all(r.held_out is False for r in out if r.doc_id is None)
            by = {}
            for r in out:
                by.setdefault(r.doc_id, []).append(r.score)
            assert by[2] == by[3] == by[4]
        assert score(docs.limit(0), labels(spark, 9)).count() == 0
        first, again = (sorted(r.score for r in score(d, labels(spark, 9)).collect()) for d in (docs, docs.repartition(3)))
        assert first == pytest.approx(again, abs=1e-9)


def test_quality_features_and_solver_against_plain_versions(spark):
    seen = np.zeros(1 << BITS, bool)
    lists = list(features([b"", b"a a b", b"b a a", b"zz yy", b"Zz yy"], seen))
    assert len(lists[0]) == 0 and not seen.any() and set(lists[1]) != set(lists[2]) and set(lists[3]) != set(lists[4])
    one, other = set(lists[1]), set(next(features([b"c c d"], seen)))
    assert one != other  # the words differ, their shapes don't
    rng = np.random.default_rng(2)
    y = np.arange(60) % 2
    found = [np.flatnonzero(rng.random(40) < np.where(np.arange(40) < 20, 0.2 + 0.3 * label, 0.4)).astype(np.int64) for label in y]
    model = fit(found, y, cost=1.0, epochs=2000)
    used = [i for i in range(60) if i % 5 != 4]
    counts = np.ones((2, 1 << BITS))
    for i in used:
        counts[y[i]][found[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(model.ratio, ratio)
    dense = np.zeros((len(used), 41))
    for row, i in enumerate(used):
        dense[row, found[i]] = ratio[found[i]] / np.linalg.norm(ratio[found[i]])
    dense[:, 40], sign = 1.0, 2.0 * y[used] - 1
    primal = lambda w: 0.5 * w @ w + np.maximum(0, 1 - sign * (dense @ w)).sum()
    best, w = np.inf, np.zeros(41)
    for step in range(1, 60_000):
        w = w - (w - dense.T @ (sign * (sign * (dense @ w) < 1))) / (step + 50)
        best = min(best, primal(w))
    own = np.append(model.weight[:40], model.bias)
    assert primal(own) <= best * 1.002


def test_kneser_ney_against_dictionaries(spark):
    sides = [["abba", "abab", "baba", "cab"], ["abba", "bad", "badabb", "dab"]]
    tables = []
    for words in sides:
        w = Words([" ".join(words).encode()])
        tables.append(Counter(word_grams(w, np.arange(len(words)))[0].tolist()))
    grams = np.array(sorted(set(tables[0]) | set(tables[1])), np.uint64)
    model = fit_ratios(grams, *(np.array([t[int(g)] for g in grams]) for t in tables))

    def discount(counts):
        one, two = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
        return one / (one + 2 * two) if one and two else 0.75

    keys = [int(g).to_bytes(8, "little") for g in grams]  # the last byte of the n-gram comes first

    def shared(gram, n):
        if not n:
            return 1 / 256
        longer = {k[: n + 1] for k in keys}
        kinds = Counter(k[:n] for k in longer)
        d, context = discount(kinds.values()), gram[1:n]
        own = {k: c for k, c in kinds.items() if k[1:] == context}
        return (kinds[gram[:n]] - d + d * len(own) * shared(gram, n - 1)) / sum(own.values())

    def loss(table, gram):
        own = {g.to_bytes(8, "little"): c for g, c in table.items()}
        d, of = discount(own.values()), {k: c for k, c in own.items() if k[1:] == gram[1:]}
        back = shared(gram, 7)
        if not of:
            return math.log(back)
        return math.log((max(own.get(gram, 0) - d, 0) + d * len(of) * back) / sum(of.values()))

    want = [loss(tables[1], k) - loss(tables[0], k) for k in keys]
    assert np.allclose(model.gram_ratio, want, atol=1e-4)


def test_mix_and_language_model_edges(spark):
    docs = odd_documents(spark)
    out = mix_sources(docs).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter({(1, 6): 2, (1, 2): 1, (2, 0): 1, (3, 0): 1, (4, 0): 1, (None, 6): 1, (None, 0): 1, (5, 20_000): 1, (6, 20_001): 1})
    assert all(0 <= r.taken <= 2 * r.size for r in out) and mix_sources(docs.limit(0)).count() == 0
    again = mix_sources(docs.repartition(5)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    scored = score_documents(docs, labels(spark, 5))
    got = scored.collect()
    assert len(got) == 10 and all(r.score == 0 and r.n_words == 0 and r.target_loss is None for r in got if r.doc_id in (2, 3, 4))
    assert len({r.score for r in got if r.n_words == 6}) == 1 and score_documents(docs.limit(0), labels(spark, 5)).count() == 0


def test_stages_keep_what_they_should(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "q1 q2 q3")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    got = {name: Counter(r.doc_id for r in stage(spark, docs, str(tmp_path)).select("doc_id").collect()) for name, stage in corpus_pipeline.STAGES}
    everything = Counter(r.doc_id for r in docs.collect())
    assert got["decontamination"] == everything
    assert got["near-duplicates"] == Counter([1, 1, 2, 3, 4, None, 5])
    assert got["source mix"] <= everything and not {2, 3, 4} & set(got["source mix"])
    for name, stage in corpus_pipeline.STAGES:  # columns that clash with a stage's own stay as they are
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns and len(set(out.columns)) == len(out.columns), name
        assert out.select(*CLASH).distinct().collect() == [tuple(7 for _ in CLASH)], name
    added = corpus_pipeline.mixed(spark, docs, str(tmp_path)).select("doc_id", "text", "size_", "source_size_", "target_", "taken_")
    plain = corpus_pipeline.mixed(spark, docs.drop("size", "source_size", "target", "taken"), str(tmp_path)).select("doc_id", "text", "size", "source_size", "target", "taken")
    assert rows_of(added, *added.columns) == rows_of(plain, *plain.columns)
    # of rows with the same id and text one stays, and the same one every time
    other = spark.createDataFrame([(1, "one two three four five six", lang, "a", 1) for lang in ("fr", "de", "es")], DOC).withColumns({c: F.lit(7) for c in CLASH})
    kept = {str(corpus_pipeline.near_copies(spark, docs.unionByName(other).repartition(k), str(tmp_path)).where("doc_id = 1 and text like 'one%'").select("lang").collect()) for k in (1, 5)}
    assert len(kept) == 1
    with pytest.raises(Exception):
        corpus_pipeline.quality(spark, docs.drop("text"), str(tmp_path))
