import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import text as fx
from lakeloom.operators import curation, graph, temporal
from lakeloom.plans.request import Relation, Request
from lakeloom.sources import tables
from lakeloom.streaming import ledger


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_chunk_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n# note\n" + json.dumps({"source": "s", "text": "t", "tags": ["a"]}) + "\n" + json.dumps({"source": "s"}) + "\n{bad\n" + json.dumps({"source": "s", "text": "t", "source_type": "odd"}) + "\n")
    found = tables.read_chunks(spark, str(tmp_path / "a.jsonl")).collect()
    assert sorted((r.problem or "") for r in found) == ["", "no text", "not JSON", "unknown source_type"]


def test_chunks_keep_their_arrays(spark, tmp_path):
    whole = {c: [f" {c} ", "", " \t", "b"] for c in tables.ARRAYS} | {"source": "s", "text": " t ", "teta_version": " 1 ", "training_date": "d", "knowledge_version": "k"}
    odd = [[1, "a"], [None], ["a", None], "a", None, [["a"]]]
    lines = [whole, whole | {"keywords": []}, {"source": "s", "text": "t"}, *({"source": "s", "text": "t", "frames": x} for x in odd)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    found = tables.read_chunks(spark, str(tmp_path / "a.jsonl")).collect()
    assert all(found[0][c] == [c, "b"] for c in tables.ARRAYS) and found[1].keywords == [] and found[2].keywords is None
    assert (found[0].text, found[0].teta_version, found[0].training_date, found[0].knowledge_version) == ("t", "1", "d", "k")
    assert [r.problem for r in found] == [None] * 3 + ["frames isn't an array of strings"] * len(odd)
    tables.write_pack(tables.read_chunks(spark, str(tmp_path / "a.jsonl")), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p/chunks")).where("size(keywords) = 2").count() == 1


def test_pack_and_merge(spark, tmp_path):
    rows = spark.createDataFrame([("a", "global_video", "x"), ("b", "global_video", "y"), ("a", None, "z")], "source string, source_type string, text string")
    manifest = {r.source_type: (r.chunks, r.sources) for r in tables.write_pack(rows, str(tmp_path / "p")).collect()}
    assert manifest == {"global_video": (2, ["a", "b"]), None: (1, ["a"])}
    assert spark.read.json(str(tmp_path / "p/chunks")).count() == 3
    new = rows.limit(0).unionByName(spark.createDataFrame([("a", "global_video", "new")], rows.schema))
    assert sorted(r.text for r in tables.merge_by(rows, new, "source").collect()) == ["new", "y"]


def test_text_of_pages_and_subtitles(spark):
    assert one(spark, tables.html_text(F.col("x")), "<p>a&nbsp;&lt;b</p><script>x<1</script> <!-- c --> d&#322;&#x41;&#38;amp;<br>e") == "a <b\ndłA&\ne"
    assert one(spark, tables.subtitle_text(F.col("x")), "WEBVTT\n\n1\n00:00 --> 00:01\n<i>Hi</i> there\n") == "Hi there"
    assert one(spark, tables.html_text(F.col("x")), None) is None


def test_text_functions(spark):
    assert one(spark, fx.folded(F.col("x")), "ŻÓŁĆ a") == "zolc a"
    assert one(spark, fx.stems(F.col("x")), "abcdef") == ["abcdef", "abcde", "abcd"]
    assert one(spark, fx.terms(F.col("x"), 4, ("stop",)), "Stop longest word word") == ["longest", "word"]
    assert one(spark, fx.clock(F.col("x")), -3.0, "double") == "0:00:00"
    assert one(spark, fx.clock(F.col("x")), 3671.9, "double") == "1:01:11"
    assert one(spark, fx.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"))), "") == 0.5
    assert one(spark, fx.like_prefix(F.col("x"), "a_%"), "A_%b") and not one(spark, fx.like_prefix(F.col("x"), "a_%"), "abc")


def test_empty_groups_hold_nothing_and_unknown_words_fail(spark):
    rows = spark.range(3)
    assert Request(any_of=((),)).answer(rows).count() == 0 and Request(any_of=()).answer(rows).count() == 3
    assert Request(group_by=("k",)).answer(rows.selectExpr("id % 2 AS k", "id")).count() == 2
    day = date(2024, 1, 5)
    spans = spark.createDataFrame([(1, date(2024, 1, 1), day), (2, day, None), (3, date(2024, 1, 6), None)], "i int, a date, b date")
    valid = lambda *flags: sorted(r.i for r in Request(valid=("a", "b", day), valid_inclusive=flags).answer(spans).collect())
    assert (valid(True, True), valid(True, False), valid(False, True)) == ([1, 2], [2], [1])
    with pytest.raises(ValueError):
        Request(relations=(Relation(rows, (), "inner"),)).answer(rows)


def test_nearest_before_after_ties_and_gaps(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([("a", t(5)), ("a", t(0)), ("b", t(5))], "k string, t timestamp")
    right = spark.createDataFrame([("a", t(4), 1), ("a", t(6), 2), ("a", t(4), 0)], "k string, t timestamp, v int")
    got = {(r.k, r.t.minute): (r.before, r.after, r.nearest) for r in temporal.nearest_before_after(left, right, "k", "t", "v").collect()}
    assert got == {("a", 5): (1, 2, 1), ("a", 0): (None, 1, 1), ("b", 5): (None, None, None)}


def test_overlap_at_window_edges(spark):
    d = lambda x: datetime(1970, 1, x)
    rows = spark.createDataFrame([(1, d(1), d(8)), (2, d(7), d(9)), (3, d(5), d(5)), (4, None, d(5))], "i int, s timestamp, e timestamp")
    assert sorted((r.i, r.w) for r in temporal.overlapping(rows, "s", "e", 7, "w").collect()) == [(1, 0), (2, 0), (2, 1)]


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 5), (5, 7), (3, 3), (9, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and got[9] == got[7] == got[5] == 5 and 3 not in got
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_reach_in_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    root = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.depth) for r in graph.reach(e, root, 9).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_ledger_chain_shows_tampering(spark):
    rows = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, "u", "c")], "event_id long, user string, what string")
    chain = curation.chained(rows, "user", F.col("what"), "event_id")
    assert curation.broken_links(chain, "user").count() == 0
    bad = chain.withColumn("previous_sha", F.when(F.col("event_id") == 3, "x").otherwise(F.col("previous_sha")))
    assert [r.event_id for r in curation.broken_links(bad, "user").collect()] == [3]


def test_append_once_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "event_id long, what string")
    rows.write.parquet(str(tmp_path / "in"))
    for k in (1, 2):  # a new checkpoint reads all files again
        stream = ledger.event_stream(spark, str(tmp_path / "in"), "event_id long, what string")
        ledger.append_once(stream, str(tmp_path / "ledger"), str(tmp_path / f"check{k}")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2
