"""Every query with SQL gives DuckDB's rows; operators on small fixtures."""

import glob
import os
import random
import shutil

import duckdb
import pytest

from leafmark import config
from leafmark.functions import text as T
from leafmark.operators import ocr, pages, sections
from leafmark.plans.registry import ORACLE_SQL, QUERIES
from leafmark.sources.html_nodes import html_nodes
from leafmark.streaming import state

DATA = "/root/testdata/sf0.001"


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = con.sql(ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    want = sorted([tuple(rounded(r[i]) for i in order) for r in result.fetchall()], key=repr)
    assert sorted([tuple(rounded(r[c]) for c in columns) for r in df.collect()], key=repr) == want
    assert want


def test_queries_without_sql_return_rows(spark):
    for name in sorted(QUERIES.keys() - ORACLE_SQL.keys()):
        assert QUERIES[name](spark, DATA).columns


def test_nodes_blocks_headings_and_sections(spark):
    html = "<body><h1>Top</h1><p>" + "one two three four five six seven eight nine" + "<h2>Sub</h2><ul><li>" + "a b c d e f g h i j</ul><script>x</script></body>"
    nodes = html_nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"))
    found, heads = pages.blocks(nodes), pages.headings(nodes)
    assert [(r.tag, r.words) for r in found.orderBy("pos").collect()] == [("p", 9), ("li", 10)]
    got = {r.title: (r.words, r.blocks) for r in pages.heading_sections(heads, found).collect()}
    assert got == {"Top": (9, 1), "Sub": (10, 1)}
    at = {r.title: r.pos for r in heads.collect()}
    assert {r.pos: r.parent for r in pages.hierarchy(heads).collect()} == {at["Top"]: None, at["Sub"]: at["Top"]}


def test_hierarchy_equals_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(p, pos, rng.randint(1, 6)) for p in range(5) for pos in range(40)]
    got = {(r.page_id, r.pos): r.parent for r in pages.hierarchy(spark.createDataFrame(rows, "page_id long, pos long, level int")).collect()}
    for p, pos, level in rows:
        assert got[p, pos] == max((q for x, q, up in rows if x == p and q < pos and up < level), default=None)


def test_nodes_of_odd_markup(spark):
    rows = [(1, "<body><![foo[x]]><p>a <a href='#'>b c</a> d</p><p>e"), (2, "text only"), (3, "<a>" * 50)]
    got = html_nodes(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert {(r.text, r.words, r.link_words) for r in got if r.tag == "p"} == {("a b c d", 4, 2), ("e", 1, 0)}
    assert [(r.words, r.link_words) for r in got if r.tag == "body"] == [(5, 2)] and sum(r.page_id == 3 for r in got) == 50


def test_merged_sections_keep_the_first(spark):
    a = spark.createDataFrame([(1, 0.0, "A")], "page_id long, top double, title string")
    b = spark.createDataFrame([(1, 10.0, "a"), (1, 900.0, "B")], a.schema)
    assert sorted((r.top, r.title) for r in pages.merged_sections(a, b).collect()) == [(0.0, "A"), (900.0, "B")]


def test_search_prefers_phrase_and_never_mixes_pages(spark):
    text = "Licensed under the Apache License, Version 2.0. " + "filler words of no use are here again. " * 3
    docs = spark.createDataFrame([(1, text), (2, "nothing of that kind " * 10), (3, None), (4, "")], "doc_id long, text string")
    found = sections.search(sections.text_sections(docs), spark.createDataFrame([("q", "apache license")], "query_id string, query string")).collect()
    assert [r.page_id for r in found] == [1] and found[0].status in ("possible", "strong", "weak")


def test_greedy_sections_close_at_the_budget(spark):
    sentence = "Word " * 99 + "end. "
    rows = sections.text_sections(spark.createDataFrame([(1, sentence * 5)], "doc_id long, text string")).orderBy("section").collect()
    assert [r.words for r in rows] == [200, 200, 100] and config.CHUNK_WORDS == 190


def test_typo_scores_and_stems(spark):
    row = spark.sql("select 'procedure' a, 'procedrue' b, 'studies' c, 'running' d")
    from pyspark.sql import functions as F

    got = row.select(T.is_minor_typo(F.col("a"), F.col("b")).alias("t"), T.stem(F.col("c")).alias("s"), T.stem(F.col("d")).alias("r")).first()
    assert (got.t, got.s, got.r) == (True, "study", "run")


def test_reading_order_joins_hyphens(spark):
    lines = spark.createDataFrame([(1, "inter-", 0.0, 1.0), (1, "national law", 0.0, 2.0)], "page_id long, text string, x0 double, y0 double")
    assert ocr.reading_order(lines).first().text == "international law"


def test_stream_gives_the_closed_sessions_of_the_batch(spark, tmp_path):
    src = spark.read.parquet(f"{DATA}/events.parquet")
    (tmp_path / "in").mkdir()
    shutil.copy(f"{DATA}/events.parquet", tmp_path / "in" / "events.parquet")  # a stream reads a folder
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = state.debounced_stream(stream).writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("bursts").collect()}
    want = {tuple(r) for r in state.debounced(state.with_time(src)).collect()}
    assert got and got <= want
