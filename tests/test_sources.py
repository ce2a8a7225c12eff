import io
import zipfile

from ledgerloom.functions import text as T
from ledgerloom.sources import attachments, html, listings
from ledgerloom.streaming import observations
from pyspark.sql import functions as F

PAGE = '<html><head><style>x{}</style><script>var a="<p>";</script></head><body><h1>标题 &amp; 名</h1><ul><li><a href="/d/1.html">甲工程公告</a><span>2025-1-3</span></li><li><a href="b.html">no date</a></li></ul><a href="f/图.pdf#p">图纸</a><a href="download?id=3">招标文件下载</a><a href="x?id=3">招标文件下载</a><a href="javascript:void(0)">附件</a></body></html>'


def test_html_text_and_links(spark, rows):
    df = spark.createDataFrame([("https://a.test/l/", PAGE), ("https://a.test/n", None), (None, "")], "url string, html string")
    texts = [r.t for r in df.select(html.html_text("html").alias("t")).collect()]
    assert texts[0].split("\n")[0] == "标题 & 名" and "var a" not in texts[0] and texts[1] is None and texts[2] == ""
    assert rows(html.links(df), "url", "title") == [("https://a.test/l/download?id=3", "招标文件下载"), ("https://a.test/l/f/图.pdf", "图纸")]
    assert rows(html.list_rows(df), "title", "date", "url") == [("甲工程公告", "2025-01-03", "https://a.test/d/1.html")]


def test_api_rows(spark, rows):
    df = spark.createDataFrame([(1, '{"code":0,"data":{"rows":[{"title":" T ","name":"N"},{"title":"","name":"M"}]}}'), (2, '{"code":5,"data":{"rows":[{"title":"x"}]}}'), (3, "no json"), (4, None)], "id long, body string")
    assert rows(listings.from_api(df, "body", 0, "rows", "title string, name string", {"project_name": ["title", "name"]})) == [(1, "M"), (1, "T")]


def test_cells_lines_and_union(spark, rows):
    df = spark.createDataFrame([(["a", " b ", "c"],), (["x"],), (None,)], "cells array<string>")
    assert rows(listings.from_cells(df, "cells", {"second": 1}, 3)) == [("b",)]
    text = spark.createDataFrame([(1, "标题\n\n北京\n甲公司\n2025-01-02\n尾"), (2, None), (3, "2025-01-02")], "id long, t string")
    assert rows(listings.from_lines(text, "id", "t")) == [(1, "2025-01-02", "标题", "北京", "甲公司"), (3, "2025-01-02", None, None, None)]
    a, b = spark.createDataFrame([("k", 1), ("m", 1)], "k string, v int"), spark.createDataFrame([("k", 2)], "k string, v int")
    assert rows(listings.union_last_wins([a, b], ["k"])) == [("k", 2), ("m", 1)]


def test_registry_and_replies(spark, rows):
    s = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("c", False)], "id string, enabled boolean")
    assert rows(listings.registry_errors(s, spark.createDataFrame([("a",)], "id string"))) == [("a", "duplicate id"), ("b", "no reader")]
    r = spark.createDataFrame([(200, "", "访问频繁"), (429, "", "请登录"), (403, "", ""), (200, "t", "CloudWAF"), (200, "t", "请重新登录"), (502, "t", ""), (404, "t", "x"), (None, None, None), (200, None, None)], "s int, t string, b string")
    assert [x.k for x in r.select(listings.response_kind(F.col("s"), F.col("t"), F.col("b")).alias("k")).collect()] == ["RATE_LIMIT", "RATE_LIMIT", "WAF", "WAF", "AUTH_EXPIRED", "UPSTREAM_BROKEN", "ERROR", "ERROR", "OK"]
    assert listings.sample_notices(spark, ["x", "y"]).count() == 2


def _zip(**files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k.replace("__", "/").replace("_xml", ".xml").replace("_txt", ".txt").replace("_zip", ".zip"), v)
    return out.getvalue()


def test_attachments(spark, rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = _zip(word__document_xml=f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>段落</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>甲</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>乙</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    x = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    xlsx = _zip(xl__sharedStrings_xml=f'<sst xmlns="{x}"><si><t>名</t></si></sst>', xl__worksheets__sheet1_xml=f'<worksheet xmlns="{x}"><sheetData><row><c t="s"><v>0</v></c><c><v>3</v></c></row></sheetData></worksheet>')
    files = [("a.docx", docx), ("b.xlsx", xlsx), ("c.zip", _zip(n_txt="内", m_zip=_zip(x_txt="no"))), ("d.pdf", b"%PDF"), ("e.docx", b"bad"), ("f.txt", b"t\x00xt"), ("g.txt", None)]
    got = {r.path: (r.status, r.text, r.error) for r in attachments.texts(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["a.docx"][:2] == ("PARSED", "段落\n甲\t乙") and got["b.xlsx"][:2] == ("PARSED", "名\t3") and got["c.zip"][:2] == ("PARSED", "内")
    assert got["d.pdf"][::2] == ("FAILED", "no reader") and got["e.docx"][0] == "FAILED" and got["f.txt"][1] == "txt" and got["g.txt"][2] == "no content"


def test_text_functions(spark):
    df = spark.createDataFrame([("甲：不含箱梁。采用管片；\n其他", "A－1 b"), (None, None)], "t string, n string")
    a, b = df.select(T.sentences(F.col("t")).alias("s"), T.hits(F.col("t"), ["管片", "箱梁"]).alias("h"), T.negated(F.col("t"), ["箱梁"], ["不含"], ["除外"]).alias("no"), T.identifier(F.col("n")).alias("n"), T.ngrams(F.coalesce("t", F.lit("")), 30).alias("g")).collect()
    assert a.s == ["甲：不含箱梁。", "采用管片；", "其他"] and a.h == ["管片", "箱梁"] and a.no and a.n == "A-1B" and len(a.g) == 1
    assert b.s == [] and b.h == [] and b.no is None and b.n == "" and b.g == []
    s = spark.createDataFrame([("password=abc; x", "https://b.a.test/x", "https://q.test/"), ("Bearer aa.bb", "https://q.test/y", "https://q.test/"), ("k", "nonsense", None)], "m string, u string, p string")
    assert [r.x for r in s.select(T.scrubbed(F.col("m")).alias("x")).collect()] == ["password=***; x", "Bearer ***", "k"]
    assert [r.x for r in s.select(T.same_host(F.col("u"), F.col("p"), ["a.test"]).alias("x")).collect()] == [True, True, False]


def test_streams_equal_batches(spark, rows, tmp_path):
    from ledgerloom.operators import changes

    data = [(i, 1 + i % 5, i % 7, "s", i % 3, "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(data, "id long, run_id long, notice_id long, source_id string, day int, content_hash string")
    df = df.selectExpr("*", "timestamp_ntz '2025-01-01' + make_interval(0,0,0,day) as observed_at", "0 as is_first_seen", "1 as content_changed")
    df.coalesce(1).write.parquet(f"{tmp_path}/t")
    stream = observations.read(spark, f"{tmp_path}/t")
    assert rows(observations.run_all(observations.daily_counts(stream), "complete", "t"), "day", "n") == rows(df.groupBy(F.to_date("observed_at").alias("day")).agg(F.count("*").alias("n")))
    batch = changes.flags(changes.once_per_run(df, "run_id", "notice_id", "id"), "notice_id", ["run_id", "id"], "content_hash")
    got = observations.run_all(observations.change_flags(stream), "append", "f")
    assert rows(got, "id", "is_first", "is_changed") == rows(batch, "id", "is_first", "is_changed")
