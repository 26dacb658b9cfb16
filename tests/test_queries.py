"""Queries on small odd tables against their SQL, and how their work is parted."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from folioframe.operators import cache, links
from folioframe.operators.convert import sliced, spread_rows

WHITE = [chr(c) for c in (9, 10, 11, 12, 13, 28, 32, 133, 160, 5760, 8195, 8203, 8232, 8239, 12288)]


def differs(spark, tmp_path, name, table, columns):
    pq.write_table(pa.table(columns), f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]
    return {*got} ^ {*want}


def test_headings_as_their_sql(spark, tmp_path):
    texts = [None, "", " \n", *WHITE, *(f"{w}a{w}{w} b{w}" for w in WHITE), *(f"a \n{w}\t" for w in WHITE)]
    assert not differs(spark, tmp_path, "headings", "documents", {"doc_id": [*range(len(texts))], "text": pa.array(texts, pa.string())})


def test_titles_as_their_sql(spark, tmp_path):
    inner = ["a &quot;b&quot;", "x&nbsp;y &apos;z", "&amp;lt; &lt;b&gt; &copy;&middot;", "", *(f"{w}a{w} b{w}" for w in WHITE)]
    pages = [None, "", "<h1>head</h1>", "<title>open", "<TITLE id='x'>one</TITLE><title>two</title>", *(f"<title>{t}</title><h1>h</h1>" for t in inner)]
    assert not differs(spark, tmp_path, "page_title", "pages", {"page_id": [*range(len(pages))], "html": pa.array(pages, pa.string())})


@pytest.mark.parametrize("name", ["zip_features", "pdf_soundness", "fidelity_scores", "relinked", "packed_sitemaps"])
def test_rows_are_spread_before_documents_are_made(spark, tmp_path, name):
    """One file is one task: what makes documents must come after an exchange."""
    pq.write_table(pa.table({"p_partkey": [*range(40)], "p_name": ["green part"] * 40, "p_size": pa.array([3] * 40, pa.int32())}), f"{tmp_path}/part.parquet")
    out = __spark_entry__.queries()[name](spark, str(tmp_path))
    plan = out._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan.partition("Physical Plan")[2] or "REPARTITION_BY_NUM" in plan.partition("Physical Plan")[2]
    assert spread_rows(spark.range(9), "id", 2)._jdf.queryExecution().optimizedPlan().toString().startswith("RepartitionByExpression [id#")


def test_slices_hold_all_rows():
    batches = [(pa.array([*range(n)]), pa.array([*range(n)])) for n in (0, 1, 5, 6)]
    got = [(a.to_pylist(), b.to_pylist()) for a, b in sliced(iter(batches), 3)]
    assert [x for a, _ in got for x in a] == [0, *range(5), *range(6)] and all(a == b and len(a) <= 3 for a, b in got)


def test_links_join_without_broadcast_and_without_repeated_keys(spark):
    assert links.lookup_keys("http://h/x") == [("http://h/x", ""), ("http://h/x/", "")]
    assert links.lookup_keys("HTTP://H/x#f") == [("HTTP://H/x", "#f"), ("HTTP://H/x/", "#f"), ("http://h/x", "#f"), ("HTTP://H/x#f", "")]
    docs = spark.createDataFrame([("u", "a.md", "[x](http://h/x)")], "url string, path string, markdown string")
    out = links.rewrite_links(docs, spark.createDataFrame([("http://h/x", "x.md")], "url string, path string"))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.first()["markdown"] == "[x](x.md)"


def test_a_url_mapped_twice_is_joined_once(spark):
    docs = spark.createDataFrame([("a.md", "[x](http://h/x)")] * 3, "path string, markdown string")
    for paths in (["y.md", "x.md", "z.md"], ["x.md", "z.md", "y.md"], ["z.md", "y.md", "x.md"]):
        mapping = spark.createDataFrame([("http://h/x", p) for p in paths], "url string, path string").coalesce(1)
        out = links.rewrite_links(docs, mapping)
        assert [r["markdown"] for r in out.collect()] == ["[x](x.md)"] * 3


def test_a_filter_on_results_converts_nothing_twice(spark):
    """What may be kept is chosen by status: not by a second conversion, of all documents, below the join with the cache."""
    docs = spark.createDataFrame([("a", ".txt"), ("b", ".txt")], "content string, ext string").withColumn("content", F.col("content").cast("binary"))
    append = cache.convert_cached(docs, spark.createDataFrame([], cache.SCHEMA))[1]
    assert append._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2  # a look and a conversion
    assert sorted(r["markdown"] for r in append.collect()) == ["a\n", "b\n"]


def test_sweep_of_one_hour_needs_no_window_over_entries(spark):
    """All entries of one moment: the budget runs out by key, in sums of at most 256 groups at a time and no row of them."""
    rows = [(f"{i * 2654435761 % 2**32:08x}", i % 3 // 2, 10 + i % 7) for i in range(500)]
    e = spark.createDataFrame(rows, "key string, s long, size long").withColumn("used", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    kept = cache.survivors(e, 3000)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    run, want = 0, set()
    for key, _, size in sorted(rows, key=lambda r: (-r[1], r[0])):
        run += size
        want |= {key} if run <= 2400 else set()
    assert {r["key"] for r in kept.collect()} == want


def test_pdf_lexer_and_shared_fonts(monkeypatch):
    """Pages share a font's tables; numbers, references, comments and escapes are told apart."""
    from folioframe.operators.formats import pdf
    from folioframe.operators.formats.emit import Info, Options
    from folioframe.plans.builders import make_pdf

    made = []
    font = pdf.Font
    monkeypatch.setattr(pdf, "Font", lambda *a: made.append(1) or font(*a))
    out = pdf.convert_pdf(make_pdf([[(12, 72, 700, f"Page {k} \\(of\\050 it\\)")] for k in "abc"]), Info(), Options())
    assert len(made) == 1 and out.markdown.split("\n\n---\n\n")[1] == "Page b (of( it)"
    lx = pdf.Lexer(b"[1 -2 +3] [1 0 R 2] [] [ 4 5.5 (a)] %c [\n<< /A#20b [7 8]/C 9 0 R >> --5 .5- 1.2.3 (x(y)z) (p\\\nq)")
    got = [lx.object() for _ in range(10)]
    assert got == [[1, -2, 3], [pdf.Ref(1, 0), 2], [], [4, 5.5, b"a"], {"A b": [7, 8], "C": pdf.Ref(9, 0)}, -5.0, 0.5, "1.2.3", b"x(y)z", b"pq"]
