import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from learngraph.schemas import ATOMIC_UNIT, EVALUATION, EXPORT, LEARNING_OBJECT
from learngraph.sources import connectors, documents, tables
from learngraph.sources.sections import dispatch, split_sections
from learngraph.streaming import incremental
from learngraph.streaming.logs import LogBuffer


@pytest.mark.parametrize("text,want", [
    (None, []), ("", []), ("  \n ", []), ("just a line", [(0, None, None, "")]), ("head\nbody", [(0, None, None, "body")]),
    ("--- Page 3 | Source: T ---\n\nA\nB\n", [(0, 3, "T", "A\nB")]), ("--- Page x | Source: T ---\nA", [(0, None, None, "A")]), ("--- Page 4\nA", [(0, 4, None, "A")]),
    ("--- Page 1 | Source: a | b ---\nA --- Page 2 | Source: c ---\nB", [(0, 1, "a", "A"), (1, 2, "c", "B")]),
])
def test_sections(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert sorted((r["seq"], r["page"], r["source"], r["content"]) for r in split_sections(df, "id", "text").collect()) == want


def test_html_sections():
    page = "<p>intro</p><h1>A</h1><p>x <b>a</b> b</p><h4>sub</h4><ul><li><p>in</p></li></ul><script>var s = '</p>';</script><nav><p>no</p></nav><h2>B &amp; C</h2><pre><code>c</code></pre><table><tr><td>1</td><td>2</td></tr></table><footer>f</footer>"
    assert documents.html_sections(page) == ["intro", "A xab sub in in", "B & C c c 12"]
    assert documents.html_sections(page, " ")[1] == "A x a b sub in in"
    assert documents.html_sections(None) == documents.html_sections("<p>  </p>") == [] and documents.html_sections("<p>only") == ["only"]


def deck():
    a, p, r = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = f'xmlns:a="{a}" xmlns:p="{p}" xmlns:r="{r}"'
    para = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    rels = lambda items: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{r}/{k}" Target="{t}"/>' for i, k, t in items) + "</Relationships>"
    slide = f'<p:sld {head}><p:cSld><p:spTree><p:sp><p:txBody>{para("Title")}{para(" ")}</p:txBody></p:sp><p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody>{para("c1")}</a:txBody></a:tc><a:tc><a:txBody>{para("c2")}</a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame></p:spTree></p:cSld></p:sld>'
    notes = f'<p:notes {head}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody>{para("say this")}</p:txBody></p:sp></p:spTree></p:cSld></p:notes>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {head}><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels([("a", "slide", "slides/s1.xml"), ("b", "slide", "slides/s2.xml")]))
        z.writestr("ppt/slides/s1.xml", slide)
        z.writestr("ppt/slides/_rels/s1.xml.rels", rels([("n", "notesSlide", "../notesSlides/n1.xml")]))
        z.writestr("ppt/slides/s2.xml", f"<p:sld {head}/>")
        z.writestr("ppt/notesSlides/n1.xml", notes)
    return out.getvalue()


def test_pptx_sections():
    assert documents.pptx_sections(deck()) == [(2, "Title\nc1 | c2\n[Notes: say this]")]


def test_pdf_pages():
    body = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj T* [(wor) -20 (ld)] TJ ET")
    data = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\n" + body + b"\nendstream\nendobj\nstream\nq Q\nendstream\nstream\nBT <4142> Tj ET\nendstream"
    assert documents.pdf_pages(data) == [(1, "Hello (you)\nworld"), (2, "AB")]


def test_scan_and_dispatch(spark):
    files = spark.createDataFrame([("d/a.HTML", b"<h1>T</h1><p>x</p>"), ("d/b.pptx", deck()), ("d/c.txt", b"?"), ("d/e.html", None), ("plain", b"")], "path string, content binary")
    known, refused = dispatch(files)
    assert sorted((r["id"], r["page"], r["source"]) for r in documents.scan(known).collect()) == [("d/a.HTML", 1, "a.HTML"), ("d/b.pptx", 2, "b.pptx")]
    assert sorted(r["reason"] for r in refused.collect()) == ["unsupported file format: ", "unsupported file format: .txt"]
    with pytest.raises(Exception, match="cannot read"):
        documents.scan(spark.createDataFrame([("x.pptx", b"junk", "pptx")], "path string, content binary, format string")).collect()


def test_tables(spark, tmp_path):
    for schema in (ATOMIC_UNIT, LEARNING_OBJECT, EVALUATION, EXPORT):
        assert spark.createDataFrame([], schema).count() == 0
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"lo_id": "a", "faithfulness": 3}, {"lo_id": None}]))
    assert [(r["lo_id"], r["faithfulness"]) for r in tables.read_json_array(spark, str(path), "lo_id string, faithfulness int").collect()] == [("a", 3), (None, None)]
    assert tables.from_rows(spark, [{"a": 1, "z": 2}, {}], "a int, b string").collect() == [(1, None), (None, None)]
    df = spark.createDataFrame([(2, ["x"]), (1, None)], "k int, v array<string>")
    assert json.loads(tables.as_json_array(df, "k").first()["json"]) == [{"k": 1}, {"k": 2, "v": ["x"]}]
    assert [r["v"] for r in tables.csv_ready(df).collect()] == ['["x"]', None]
    lines = {r["line"] for r in tables.key_values(spark.createDataFrame([(1, None)], "n int, m double")).collect()}
    assert lines == {"n:\t1", "m:\tNone"}
    assert tables.export_path("/r/", "a-b.json") == "/r/a-b.json"
    for bad in ("../x", "a/b", "", None, ".x", "a..b"):
        with pytest.raises(ValueError):
            tables.export_path("/r", bad)
    made = []
    for _ in range(2):
        out = tables.stage(spark, str(tmp_path / "stage"), lambda: made.append(1) or df)
    assert len(made) == 1 and out.count() == 2
    assert [r["k"] for r in tables.remaining(df, df.where("k = 1"), "k").collect()] == [2]
    tables.write_graph(df.select("k"), df.select("k"), str(tmp_path / "g"))
    assert [x.count() for x in tables.read_graph(spark, str(tmp_path / "g"))] == [2, 2]
    tables.write_key_values(spark.createDataFrame([(1,)], "n int"), str(tmp_path / "kv"))
    tables.write_json_lines(df, str(tmp_path / "jl"))
    assert spark.read.json(str(tmp_path / "jl")).count() == 2


def test_summaries_and_downloads(spark, tmp_path):
    one, many = spark.createDataFrame([(1, None)], "n int, m double"), spark.createDataFrame([("b", 2), ("a", 1)], 'k string, "v w" int'.replace('"', "`"))
    tables.write_summary({"scores": one, 'by "type"': many, "none": many.limit(0)}, str(tmp_path / "s"))
    (text,) = (r["value"] for r in spark.read.text(str(tmp_path / "s")).collect())
    assert json.loads(text) == {"scores": {"n": 1, "m": None}, 'by "type"': [{"k": "a", "v w": 1}, {"k": "b", "v w": 2}], "none": []}
    df = spark.createDataFrame([(1, ['x "q"', "y"], "a,b\nc"), (2, None, None)], "i int, xs array<string>, t string")
    tables.write_download(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "c"))
    assert sorted((r["i"], r["xs"], r["t"]) for r in back.collect()) == [("1", '["x \\"q\\"","y"]', "a,b\nc"), ("2", None, None)]
    tables.write_download(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(ValueError, match="kind"):
        tables.write_download(df, str(tmp_path / "x"), "xls")


def test_retries():
    waits = []
    config = connectors.Config(delay=0.5)
    answers = iter([ValueError(), "", "  ", "ok"])

    def ask():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert connectors.with_retries(ask, config, waits.append) == "ok" and waits == [0.5, 1, 2, 4]
    waits.clear()

    def limited():
        raise connectors.RateLimited

    with pytest.raises(connectors.RateLimited):
        connectors.with_retries(limited, connectors.Config(), waits.append)
    assert waits == [60, 90, 135, 202.5, 303.75]


def test_configuration():
    env = {"OPENAI_API_KEY": "o", "OPENROUTER_API_KEY": "r", "OPENROUTER_MODEL": "m", "LLM_DELAY_SECONDS": "0.1"}
    config = connectors.configuration(env, {"special": "openai"})
    assert config.provider.name == "openrouter" and config.provider_of(None).model == "m" and config.provider_of("special").key == "o" and config.delay == 0.1
    assert connectors.choose_provider({}) is None
    with pytest.raises(ValueError):
        connectors.Config().provider_of("x")


def test_embedding_column(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    a, b, c = (r["vector"] for r in connectors.embed(df, "t").collect())
    assert a == b and len(a) == 64 and abs(sum(x * x for x in a) - 1) < 1e-6 and set(c) == {0.0}


def test_log_buffer():
    logs = LogBuffer(3)
    logs.subscribe("x")
    logs.subscribe("y")
    logs.write("s", "1\n\n2")
    logs.write("t", "3\n4")
    assert logs.read("x") == ["s::1", "s::2", "t::3"] and logs.read("x") == [] and logs.frames("y")[0] == "data: s::1\n\n"


def test_incremental_graph_of_text_and_landed_uploads(spark, tmp_path):
    source, state, log = (str(tmp_path / n) for n in ("in", "state", "log"))
    for rows in ([(1, "b"), (1, "a")], [(2, "a"), (2, "b")], [(3, "b"), (3, "c")]):
        spark.createDataFrame(rows, "u long, c string").coalesce(1).write.mode("append").parquet(source)
        incremental.cooccurrence_stream(spark.readStream.schema("u long, c string").parquet(source), "u", "c", state, log).awaitTermination()
    assert sorted(tuple(r) for r in incremental.current(spark, state).collect()) == [("a", "b", 2), ("b", "c", 1)]
    assert len(incremental._edge_store(spark, state, "string").versions()) == 2
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.html").write_bytes(b"<p>x")
    (tmp_path / "up" / "b.txt").write_bytes(b"y")
    landed = incremental.uploads(spark, str(tmp_path / "up"), "*.html")
    incremental.append_units(landed, str(tmp_path / "landed"), str(tmp_path / "log3")).awaitTermination()
    assert [bytes(r["content"]) for r in spark.read.parquet(str(tmp_path / "landed")).collect()] == [b"<p>x"]


def test_incremental_graph(spark, tmp_path):
    source, state, log = (str(tmp_path / n) for n in ("in", "state", "log"))
    schema = "u long, c long"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = incremental.cooccurrence_stream(spark.readStream.schema(schema).parquet(source), "u", "c", state, log)
        q.awaitTermination()
        return sorted(tuple(r) for r in incremental.current(spark, state).collect())

    assert add([(1, 1), (1, 2)]) == [(1, 2, 1)]
    assert add([(2, 2), (2, 1), (2, 3)]) == [(1, 2, 2), (1, 3, 1), (2, 3, 1)]
    q = incremental.append_units(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "log2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
