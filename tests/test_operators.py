"""Column functions and DataFrame operators on small tables."""

import gzip

import pytest
from pyspark.sql import functions as F

from folioframe.functions import hints as H
from folioframe.functions import markdown as M
from folioframe.functions import robots as R
from folioframe.functions import urls as U
from folioframe.operators import cache, crawl, dispatch, links, scoring
from folioframe.operators.convert import convert, recognise, summary
from folioframe.operators.formats import emit
from folioframe.operators.formats.emit import Info, Options
from folioframe.sources import files
from folioframe.plans.builders import compound, make_pdf, zipped


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()[0]


TEXTS = ["", "  a | b\r\nc\n", " x y ", "a\\b", "```\ncode````\n\n", "*", None]


def test_emitters_agree(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is not None]
    df = spark.createDataFrame(rows, "i int, t string")
    got = df.select("i", M.escape_cell("t").alias("cell"), M.collapse("t").alias("flat"), M.heading(F.col("i") * 3, "t").alias("head"), M.code_block(F.lit("py"), "t").alias("code"),
                    M.emphasise("t", "**").alias("em"), M.link_url("t").alias("url"), M.image("t", F.lit("u")).alias("img")).collect()
    for r in got:
        t = dict(rows)[r["i"]]
        assert r["cell"] == emit.escape_cell(t) and r["flat"] == emit.collapse(t) and r["head"] == emit.heading(r["i"] * 3, t)
        assert r["code"] == emit.code_block("py", t) and r["em"] == emit.emphasise(t, "**") and r["url"] == emit.link_url(t) and r["img"] == emit.image(t, "u")


def test_table_and_join(spark):
    df = spark.createDataFrame([(["a", "b"], [["1"], ["x|y", "2", "3"]], ["p\n ", "", "q"])], "h array<string>, r array<array<string>>, b array<string>")
    r = df.select(M.table(F.col("h"), F.col("r")).alias("t"), M.join_blocks(F.col("b")).alias("j")).first()
    assert r["t"] == emit.table(["a", "b"], [["1"], ["x|y", "2", "3"]]) and r["j"] == emit.join_blocks(["p\n ", "", "q"]) == "p\n\nq\n"
    assert one(spark, "body", lambda c: M.with_title(c, F.lit("T"))) == "# T\n\nbody" and one(spark, "# x", lambda c: M.with_title(c, F.lit("T"))) == "# x"


URLS = [
    ("HTTP://User@Ex.COM:80/a/../b//./c#f", "http://ex.com/b/c"), ("https://h:443", "https://h/"), ("https://h:8443/x/", "https://h:8443/x/"), ("http://h?q=A/../b", "http://h/?q=A/../b"),
    ("ftp://h/x", None), ("/rel", None), ("http:///x", None), (None, None), ("http://h/../../x/..", "http://h/"),
]


def test_normalise(spark):
    df = spark.createDataFrame([(u, w) for u, w in URLS], "u string, w string")
    for r in df.select("w", U.normalise(F.col("u")).alias("g")).collect():
        assert r["g"] == r["w"]


def test_local_paths_stay_inside_and_apart(spark):
    urls = ["http://h/", "http://h/index", "http://h/a/b", "http://h/a/b/", "http://h/a/b?x=1", "http://h/a/b?x=2", "http://h/A/b", "http://h/a%2fb", "http://h/a:b", "http://h/a..b", "http://h/....",
            "http://h/" + "x" * 5000, "http://h/" + "y/" * 200, "http://h/a-0123abcd", "http://h/\u202eb", "http://h:81/a/b", "http://other/a/b"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.local_path(F.col("u")).alias("p")).collect()
    paths = [r["p"] for r in rows]
    assert len(set(paths)) == len(urls) and all(len(p) <= 180 and not p.startswith("/") and ".." not in p and p.endswith(".md") for p in paths)
    assert paths[0] == "h/index.md"
    assert dict(zip(urls, paths))["http://h/a/b"] == "h/a/b.md"


def test_relative_paths(spark):
    for to, at, want in (("h/a/b.md", "h/a/c.md", "b.md"), ("h/x.md", "h/a/c.md", "../x.md"), ("o/x y.md", "h/c.md", "../o/x%20y.md"), ("h/a/b/c.md", "h/d.md", "a/b/c.md"), ("a.md", "b.md", "a.md")):
        got = spark.createDataFrame([(to, at)], "t string, s string").select(U.relative_to(F.col("t"), F.col("s"))).first()[0]
        assert got == want


def test_filters(spark):
    assert one(spark, "http://h/en/x", lambda c: U.allowed(c, ["/en/"], ["/x"])) is False
    assert one(spark, "http://h/en/y", lambda c: U.allowed(c, [], ["/x"])) is True
    with pytest.raises(ValueError):
        U.check_patterns(["(?=x)"])
    assert one(spark, "#x", U.skip_href) and one(spark, "MAILTO:a", U.skip_href) and not one(spark, "/x", U.skip_href)


def test_robots(spark):
    body = "User-agent: a\nUser-agent: folio\r\nDisallow: /private # no\nAllow: /private/ok\nDisallow: /*.pdf$\nDisallow: /q?x\n\nUser-agent: *\nDisallow: /\nSitemap: http://h/s.xml"
    robots = spark.createDataFrame([("http://h", body)], "origin string, body string")
    rules = R.parse(robots, "Folio/1.0")
    wants = {"/": True, "/private": False, "/private/ok/1": True, "/a.pdf": False, "/a.pdf?x": True, "/q?x=1": False, "/q": True}
    got = R.allow(spark.createDataFrame([("http://h", t) for t in wants], "origin string, target string"), rules)
    assert {r["target"]: r["allowed"] for r in got.collect()} == wants
    assert R.parse(robots, "zzz").count() == 1 and R.sitemaps(robots).first()["loc"] == "http://h/s.xml"
    none = R.allow(spark.createDataFrame([("http://o", "/x")], "origin string, target string"), rules)
    assert none.first()["allowed"] is True


def test_hints(spark):
    assert one(spark, "Text/HTML; charset=x", H.norm_mime) == "text/html" and one(spark, "HTML", H.norm_ext) == ".html"
    for path, ext in (("/a/b.TXT", ".txt"), (".gitignore", ".gitignore"), ("weird.", "."), ("none", "")):
        assert one(spark, path, H.ext_of) == ext
    for data, mime in ((b"%PDF-1.4", "application/pdf"), (b"  <!doctype html><p>", "text/html"), (b"a\0b", "application/octet-stream"), (b"", "text/plain"), (b"\x89PNG\r\n\x1a\n", "image/png")):
        assert one(spark, bytearray(data), H.sniff, "binary") == mime


CASES = [
    (b"a,b", ".csv", "", "csv"), (b"a,b", "", "", "plaintext"), (b'{"a":1}', "", "", "json"), (b'{"a":1} x', "", "", "plaintext"), (b'\xef\xbb\xbf{"a":1}', "", "", "plaintext"),
    (b'{"nbformat":4}', "", "", "ipynb"), (b"<!DOCTYPE html><p>", "", "", "html"), (b"<html>", ".xml", "", "plaintext"), (b"<rss version='2'>", ".xml", "", "rss"), (b"<rss version='2'>", "", "", "plaintext"),
    (make_pdf([[(12, 7, 7, "x")]]), "", "", "pdf"), (zipped({"a.txt": "x"}), "", "", "zip"), (zipped({"word/document.xml": "x"}), "", "", "docx"),
    (zipped({"xl/workbook.xml": "x"}), "", "", "xlsx"), (zipped({"ppt/presentation.xml": "x"}), "", "", "pptx"), (zipped({"mimetype": "application/epub+zip"}), "", "", "epub"),
    (b"\xff\xd8\xff\xe0", "", "", "image"), (b"ID3\0\xff", "", "", None), (b"\0\x01\x02", "", "", None), (b"", "", "", "plaintext"), (None, "", "", "plaintext"),
    (compound({"Workbook": b"x" * 10}), "", "", "xls"), (compound({"__substg1.0_0037001F": b"x" * 4}), "", "", "msg"), (b"x", "", "application/pdf", "pdf"), (b"x", ".json", "", "plaintext"),
]


def test_dispatch(spark):
    df = spark.createDataFrame([(i, c, e, m) for i, (c, e, m, _) in enumerate(CASES)], "i int, content binary, ext string, mime string")
    got = {r["i"]: r["format"] for r in dispatch.dispatch(df).collect()}
    assert got == {i: w for i, (*_, w) in enumerate(CASES)}
    for c, e, m, w in CASES:
        if not m and w != "image":
            assert recognise(c or b"", Info(ext=e)) == w
    mine = dispatch.Registry().register("mine", -1, lambda: F.col("_ext") == ".csv")
    assert dispatch.dispatch(df.where("i = 0"), mine).first()["format"] == "mine"


def test_convert_rows(spark):
    df = spark.createDataFrame([(1, b"a,b\n1,2", ".csv"), (2, b"\0\1", ""), (3, b"%PDF-1.4 junk", ""), (4, None, ".txt"), (5, b"<html><title>T</title><p>x", "")], "i int, content binary, ext string")
    got = {r["i"]: r for r in convert(df).collect()}
    assert got[1]["markdown"].startswith("| a | b |") and (got[2]["status"], got[2]["error_code"]) == ("error", "unsupported") and got[3]["error_code"] == "convert_failed"
    assert got[4]["markdown"] == "\n" and (got[5]["title"], got[5]["markdown"]) == ("T", "x\n")
    assert summary(convert(df)).count() == 5
    mine = dispatch.Registry().register("mine", -1, lambda: F.col("_ext") == ".csv")
    extra = {"mine": lambda d, i, o: emit.Result("mine\n")}
    assert convert(df.where("i = 1"), registry=mine, extra=extra).first()["markdown"] == "mine\n"


def test_cache(spark):
    docs = spark.createDataFrame([(1, b"x", ".txt"), (2, b"x", ".txt"), (3, b"y", ".txt"), (4, b"\0", ""), (5, b"%PDF-1.4 junk", "")], "i int, content binary, ext string")
    empty = spark.createDataFrame([], cache.SCHEMA)
    out, add = cache.convert_cached(docs, empty)
    assert out.count() == 5 and {r["markdown"] for r in add.collect()} == {"x\n", "y\n", None} and add.count() == 3
    rows = spark.createDataFrame(add.collect(), add.schema)
    out, add = cache.convert_cached(docs, rows)
    assert add.count() == 0 and sorted(r["markdown"] or "" for r in out.collect()) == ["", "", "x\n", "x\n", "y\n"]
    stale = rows.withColumn("schema", F.lit(9))
    assert cache.convert_cached(docs, stale)[1].count() == 3
    keys = lambda o: {r[0] for r in convert(docs).select(cache.cache_key(o)).collect()}
    assert not keys(Options()) & keys(Options(max_depth=3)) and not keys(Options()) & keys(Options(drop_images=True))
    assert cache.stats(rows).first()["entries"] == 3
    entries = spark.createDataFrame([(f"k{i}", f"2024-01-01 {i:02d}:00:00", 10) for i in range(20)], "key string, u string, size int").withColumn("used", F.to_timestamp("u"))
    assert sorted(r["key"] for r in cache.survivors(entries, 100).collect()) == sorted(f"k{i}" for i in range(12, 20))
    assert cache.survivors(entries, 1000).count() == 20


def test_crawl(spark):
    e = {"": ["a", "b", "x"], "a": ["c", "a"], "b": ["c"], "c": ["d"]}
    url = lambda p: f"http://h/{p}"
    rows = [(url(s), i, url(t) if t != "x" else "http://other/x") for s, ts in e.items() for i, t in enumerate(ts)]
    linked = spark.createDataFrame(rows, "url string, ord int, link string")
    pages = spark.createDataFrame([(url(p),) for p in ("", "a", "b", "c", "d")] + [("http://other/x",)], "url string")
    seeds = spark.createDataFrame([("HTTP://H/",)], "url string")
    got = crawl.crawl(seeds, linked, pages, crawl.CrawlOptions(max_depth=2))
    assert {(r["url"], r["depth"], r["source"]) for r in got.pages.collect()} == {(url(""), 0, "seed"), (url("a"), 1, "link"), (url("b"), 1, "link"), (url("c"), 2, "link")}
    assert got.truncated and got.skipped == 1
    few = crawl.crawl(seeds, linked, pages, crawl.CrawlOptions(max_depth=5, max_pages=2, exclude=["/a$"]))
    assert [r["url"] for r in few.pages.orderBy("depth").collect()] == [url(""), url("b")]
    rules = R.parse(spark.createDataFrame([("http://h", "User-agent: *\nDisallow: /b")], "origin string, body string"), "f")
    ruled = crawl.crawl(seeds, linked, pages, crawl.CrawlOptions(max_depth=1), rules)
    assert {r["url"] for r in ruled.pages.collect()} == {url(""), url("a")}
    some = crawl.crawl(seeds, linked, pages, crawl.CrawlOptions(sitemap_only=True), sitemap=spark.createDataFrame([(url("d"),), (url(""),)], "url string"))
    assert {(r["url"], r["source"]) for r in some.pages.collect()} == {(url(""), "seed"), (url("d"), "sitemap")}
    reach = crawl.reachable(linked.toDF("src", "o", "dst"), spark.createDataFrame([(url(""),)], "node string"), 2)
    assert {r["node"]: r["depth"] for r in reach.collect()}[url("c")] == 2


def test_crawl_and_reach_over_all_rows(spark, tmp_path):
    from folioframe.plans import catalog

    html = {0: '<a href="/1">1</a><a href="/x">x</a>', 1: '<a href="/2">2</a>', 2: ""}
    rows = [(i, f"http://h/{i}", html.get(i, "")) for i in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.queries()["crawl_pages"](spark, str(tmp_path)).collect()
    assert sorted((r["url"], r["depth"], r["source"]) for r in got) == sorted((u, 0, "seed") for _, u, _ in rows)
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    followed = crawl.crawl(pages.where("page_id = 0").select("url"), links.page_links(pages), pages, crawl.CrawlOptions(max_depth=2, max_pages=None))
    assert {(r["url"], r["depth"]) for r in followed.pages.collect()} == {("http://h/0", 0), ("http://h/1", 1), ("http://h/2", 2)} and not followed.truncated
    spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    reach = catalog.queries()["reach"](spark, str(tmp_path))
    assert {(r["node"], r["depth"]) for r in reach.collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_page_links(spark):
    pages = spark.createDataFrame([("http://h/d/p", '<a href="x#f">1</a><a href="X">2</a><a href="x">3</a><a href="tel:1">4</a>'), ("http://h/n", None)], "url string, html string")
    assert {(r["url"], r["link"]) for r in links.page_links(pages).collect()} == {("http://h/d/p", "http://h/d/x"), ("http://h/d/p", "http://h/d/X")}


def test_rewrite_text():
    to = {"http://h/a": "a.md", "http://h/i.png": "i.png"}.get
    for md, want in (
        ("[x](http://h/a) [y](http://h/b)", "[x](a.md) [y](http://h/b)"), ('[x](<http://h/a> "t")', '[x](a.md "t")'), ("`[x](http://h/a)` \\[x](http://h/a)", "`[x](http://h/a)` \\[x](http://h/a)"),
        ("```\n[x](http://h/a)\n```\n[x](http://h/a)", "```\n[x](http://h/a)\n```\n[x](a.md)"), ("\n    [x](http://h/a)", "\n    [x](http://h/a)"), ("[ref]: http://h/a 'T'", "[ref]: a.md 'T'"),
        ("[![i](http://h/i.png)](http://h/a)", "[![i](i.png)](a.md)"), ("[x](http://h/a", "[x](http://h/a"), ("[x] (http://h/a)", "[x] (http://h/a)"),
    ):
        assert links.rewrite(md, to) == want


def test_rewrite_links(spark):
    docs = spark.createDataFrame([("u1", "h/x/p.md", "[a](http://h/a#f) [b](http://h/b/) [c](HTTP://H/c) [n](http://n/)"), ("u2", "h/q.md", "none"), ("u3", "h/r.md", None)], "url string, path string, markdown string")
    mapping = spark.createDataFrame([("http://h/a", "h/a.md"), ("http://h/b", "h/b.md"), ("http://h/c", "h/c.md")], "url string, path string")
    got = {r["url"]: r["markdown"] for r in links.rewrite_links(docs, mapping).collect()}
    assert got == {"u1": "[a](../a.md#f) [b](../b.md) [c](../c.md) [n](http://n/)", "u2": "none", "u3": None}


def test_scoring(spark):
    gold = "# Title\n\nsome *text* here\n\n- a b\n- c\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n"
    assert set(scoring.score(gold, gold).values()) == {1.0}
    s = scoring.score(gold, "# Title\n\nhere text some\n")
    assert s["headings"] == 1 and s["lists"] == 0 and s["tables"] == 0 and 0 < s["order"] < s["content"] + 0.5
    df = spark.createDataFrame([(1, gold, gold, "a"), (2, gold, "", "b"), (3, "", "", "b")], "k int, gold string, candidate string, format string")
    scored = scoring.with_scores(df)
    rep = {r["format"]: r for r in scoring.report(scored).collect()}
    assert rep["a"]["content"] == 1 and rep["b"]["n"] == 2 and rep[None]["n"] == 3
    assert scoring.worst(scored, 1).first()["k"] == 2
    f1 = {r["k"]: r["f1"] for r in scoring.token_f1(df, "k", "gold", "candidate").collect()}
    assert f1 == {1: 1.0, 2: 0.0, 3: 1.0}


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    leaf = f"<urlset {ns}><url><loc> http://h/1 </loc><lastmod>2024-01-02T03:04:05+01:00</lastmod></url><url><loc>http://h/2</loc><lastmod>soon</lastmod></url></urlset>"
    docs = [("i", f"<sitemapindex {ns}><sitemap><loc>l</loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>".encode()), ("l", gzip.compress(leaf.encode())), ("bad", b"<urlset><url>"), ("no", b"<html/>")]
    got = files.sitemap_entries(spark.createDataFrame(docs, "url string, body binary"), spark.createDataFrame([("i",), ("bad",), ("no",)], "url string")).collect()
    assert {(r["loc"], str(r["lastmod"]), r["lastmod_raw"]) for r in got} == {("http://h/1", "2024-01-02 02:04:05", "2024-01-02T03:04:05+01:00"), ("http://h/2", "None", "soon")}


def test_sitemaps_hold_all_pages(spark, tmp_path, monkeypatch):
    from folioframe.plans import catalog

    url = F.concat(F.lit("http://h/"), F.col("id").cast("string"))
    spark.range(360_000).select(F.col("id").alias("page_id"), url.alias("url")).write.parquet(f"{tmp_path}/all/pages.parquet")
    assert catalog.queries()["sitemap_urls"](spark, f"{tmp_path}/all").count() == 360_000
    spark.range(90).select(F.col("id").alias("page_id"), url.alias("url")).write.parquet(f"{tmp_path}/few/pages.parquet")
    monkeypatch.setattr(catalog, "SITEMAP_LEAF_URLS", 10)
    monkeypatch.setattr(catalog, "SITEMAP_INDEX_URLS", 3)
    assert catalog.queries()["sitemap_urls"](spark, f"{tmp_path}/few").count() == 90


def test_files_and_stream(spark, tmp_path):
    from folioframe.streaming import intake

    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "in" / "sub" / "b.HTML").write_text("<title>T</title>x")
    docs = files.read_files(spark, str(tmp_path / "in"))
    assert {(r["file_name"], r["ext"], r["mime"]) for r in docs.collect()} == {("a.csv", ".csv", "text/csv"), ("b.HTML", ".html", "text/html")}
    out = files.plan_outputs(convert(docs).unionByName(convert(docs)).withColumn("o", F.monotonically_increasing_id()), "o")
    assert sorted(r["out_name"] for r in out.collect()) == ["a-1.md", "a.md", "b-1.md", "b.md"]
    assert files.write_markdown(out, (tmp_path / "out").as_uri()) == 4 and (tmp_path / "out" / "a.md").read_text().startswith("| a | b |")
    got = []
    stream = intake.watch(spark, str(tmp_path / "in"), "*.csv")
    q = intake.run(stream, str(tmp_path / "cp"), lambda df, n: got.extend(r["markdown"] for r in df.collect()))
    q.awaitTermination(60)
    (tmp_path / "in" / "c.csv").write_text("c\n")
    intake.run(stream, str(tmp_path / "cp"), lambda df, n: got.extend(r["markdown"] for r in df.collect())).awaitTermination(60)
    assert got == ["| a | b |\n| --- | --- |\n| 1 | 2 |\n", "| c |\n| --- |\n"]
    assert intake.deduplicated(stream).isStreaming


def test_entry_and_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_config(tmp_path):
    from folioframe.sources import config

    path = tmp_path / "c.json"
    assert config.load(str(path)) == {}
    path.write_text('{"url": "http://${HOST}/v1", "auth": {"api_key": "${KEY}"}, "names": ["${HOST}", 3]}')
    got = config.load(str(path), {"HOST": "h", "KEY": "abcdefghijkl"})
    assert got == {"url": "http://h/v1", "auth": {"api_key": "abcdefghijkl"}, "names": ["h", 3]}
    assert config.redacted(got)["auth"] == {"api_key": "...ijkl"}
    with pytest.raises(ValueError, match="auth.api_key.*KEY"):
        config.load(str(path), {"HOST": "h", "KEY": ""})


def test_paths_and_names(spark):
    inside = {"a.md": True, "a/../b.md": True, "../a.md": False, "a/../../b.md": False, "/a.md": False, "\\a.md": False, "C:a.md": False, "": False, "a/..": False, "./a.md": True}
    rows = spark.createDataFrame([(k,) for k in inside], "p string").select("p", files.contained(F.col("p")).alias("c")).collect()
    assert {r["p"]: r["c"] for r in rows} == inside
    names = ["a.txt", "a.md", "a-1.txt", "a.csv", "a-3.x", "a", "", None, "b c.txt"]
    docs = spark.createDataFrame(list(enumerate(names)), "o int, file_name string")
    got = {r["o"]: r["out_name"] for r in files.plan_outputs(docs, "o").collect()}
    assert [got[i] for i in range(9)] == ["a.md", "a-2.md", "a-1.md", "a-4.md", "a-3.md", "a-5.md", "document.md", "document-1.md", "b-c.md"]
    assert list(files.in_order(docs.withColumn("markdown", F.col("file_name")), "o")) == [n for n in names if n is not None]


def test_numbers(spark):
    from folioframe.functions import numbers as N

    assert one(spark, 133485408000000000, N.filetime_text, "long") == "2024-01-01 00:00:00 UTC" and one(spark, -1, N.filetime_text, "long") is None
    for ref, want in (("A1", (0, 0)), ("$AB$12", (11, 27)), ("zz9", (8, 701)), ("1A", (None, None)), ("", (None, None))):
        assert (one(spark, ref, N.cell_row), one(spark, ref, N.cell_column)) == want
    for raw, want in (("3", 3), ("0", 9), ("99", 9), ("-1", 1), ("x", 1), (None, 1), (" 2 ", 2)):
        assert one(spark, raw, lambda c: N.span(c, 9)) == want
    got = spark.range(1).select(N.degrees(F.lit(10.0), F.lit(30.0), F.lit(36.0), F.lit("S"))).first()[0]
    assert got == "-10.510000"
