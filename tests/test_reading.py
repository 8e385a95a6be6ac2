"""Pages, layout, alignment, plans and playback."""

import datetime
import io
import wave
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vocalis import cli
from vocalis.functions import tables as T
from vocalis.operators import reading, stores
from vocalis.sources import audio, uploads
from vocalis.streaming import live


def test_kinds(spark):
    cases = [("a.PDF", "", "pdf"), ("x", "application/pdf; q=1", "pdf"), ("b.epub", "application/pdf", "pdf"), ("b.epub", None, "epub"), (None, "text/html", "html"), ("c.xhtml", "", "html"), ("d.txt", "text/plain", "unknown"), ("", "", "unknown")]
    d = spark.createDataFrame(cases, "f string, c string, k string")
    assert all(r.k == r.g for r in d.select("k", uploads.kind(F.col("f"), F.col("c")).alias("g")).collect())


def test_page_status_and_splicing(spark):
    d = spark.createDataFrame([(1, 1, "A text layer of some length."), (1, 2, "short"), (1, 3, None), (2, 1, " " * 40)], "doc_id long, page int, text string")
    pages = reading.page_status(d, True).cache()
    assert {(r.doc_id, r.page): r.status for r in pages.collect()} == {(1, 1): "ready", (1, 2): "needs_ocr", (1, 3): "needs_ocr", (2, 1): "needs_ocr"}
    assert [r.ocr_error for r in reading.page_status(d, False).orderBy("doc_id", "page").collect()] == [False, True, True, True]
    seen = spark.createDataFrame([(1, 2, "Visto | bene"), (1, 3, None), (2, 1, " "), (1, 1, "not asked")], "doc_id long, page int, ocr_text string")
    got = {(r.doc_id, r.page): (r.status, r.text) for r in reading.splice_ocr(pages, seen).collect()}
    assert got == {(1, 1): ("ready", "A text layer of some length."), (1, 2): ("ready", "Visto bene"), (1, 3): ("ocr_failed", ""), (2, 1): ("empty", "")}
    eager = reading.eager_document(d.withColumn("ocr_text", F.when(F.col("page") == 2, "seen text")), "doc_id").orderBy("doc_id").collect()
    assert (eager[0].text, eager[0].ocr_pages, eager[0].ocr_used, eager[1].ocr_used) == ("A text layer of some length.\n\nseen text", [2], True, False)
    assert [r.text for r in reading.eager_pages(d.withColumn("ocr_text", F.lit(""))).orderBy("doc_id", "page").collect()] == ["A text layer of some length.", "short", "", ""]


def test_document_json(spark):
    d = spark.createDataFrame([(1, 1, "ready", "Uno. Due."), (1, 2, "needs_ocr", "")], "doc_id long, page int, status string, text string")
    import json

    got = json.loads(reading.document_json(d).first().json)
    assert got == {"doc_id": "1", "page_count": 2, "pages": [{"page": 1, "status": "ready", "sentences": ["Uno.", "Due."]}, {"page": 2, "status": "needs_ocr", "sentences": []}], "pending_pages": [2], "text": "Uno. Due.", "char_count": 9}


def test_html(spark):
    pages = {
        "<head><title>t</title></head><p>Uno &amp; due</p><script>x()</script><p>Tre": "\n\nUno & due\n\n\n\nTre",
        "<nav>a<nav>b</nav>c</nav>d": "d",
        "a<style>b": "a",
        "caff&egrave;<br>x": "caffè\n\nx",
        "<p>a</p>tail &am": "\n\na\n\n",
        "plain": "plain",
    }
    d = spark.createDataFrame([(k,) for k in pages], "html string")
    got = {r.html: r.text for r in uploads.html_text(d).collect()}
    for page, want in pages.items():
        assert got[page] == uploads.read_html(page) == want


def test_decoding(spark):
    d = spark.createDataFrame([(b"caff\xc3\xa8",), (b"caff\xe8",), (b"\xff\xfea\x00",), (b"\xe9ab",), (b"",)], "b binary")
    got = {bytes(r.b): r.t for r in uploads.decode(d, "b", "t").collect()}
    assert got == {b: uploads.decode_bytes(b) for b in got} and got[b"caff\xc3\xa8"] == "caffè" and got[b"\xe9ab"] == "éab"


def epub(chapters, spine, folder="OEBPS", extra=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        opf = f"{folder}/content.opf" if folder else "content.opf"
        z.writestr("META-INF/container.xml", f"<container xmlns='urn:c'><rootfiles><rootfile full-path='{opf}'/></rootfiles></container>")
        items = "".join(f"<item id='{i}' href='{h}'/>" for i, h, _ in chapters) + extra
        z.writestr(opf, f"<package xmlns='http://p'><manifest>{items}</manifest><spine>{''.join(f'<itemref idref={chr(39)}{s}{chr(39)}/>' for s in spine)}</spine></package>")
        for _, h, body in chapters:
            if body is not None:
                z.writestr(f"{folder}/{h}".strip("/").replace("%20", " ").split("#")[0], body)
    return out.getvalue()


def test_epub(spark):
    one = epub([("a", "uno.xhtml", "<p>Primo capitolo.</p>"), ("b", "due%20x.xhtml#s", "<p>Secondo.</p>"), ("c", "gone.xhtml", None), ("d", "vuoto.xhtml", "<p> </p>")], ["b", "x", "c", "d", "a"])
    two = epub([("a", "u.xhtml", "<p>Solo.</p>")], ["a"], folder="")
    d = spark.createDataFrame([("1", one), ("2", two), ("3", b"not a zip"), ("4", epub([], []))], "path string, content binary")
    got = sorted((r.path, r.page, r.text, r.status) for r in uploads.epub_pages(d).filter("path <> 3").collect())
    assert got == [("1", 1, "Secondo.", "ready"), ("1", 2, "Primo capitolo.", "ready"), ("2", 1, "Solo.", "ready"), ("4", 1, "", "empty")]


def test_plugged_parsers(spark):
    d = spark.createDataFrame([("a", b"x|y y")], "path string, content binary")
    pages = uploads.pdf_page_texts(d, lambda b: b.decode().split("|"))
    assert [(r.page, r.text) for r in pages.orderBy("page").collect()] == [(1, "x"), (2, "y y")]
    waiting = spark.createDataFrame([(1, "needs_ocr", b"q"), (2, "ready", b"q"), (3, "needs_ocr", b"")], "page int, status string, content binary")

    def see(data, page):
        if not data:
            raise ValueError
        return f"{data.decode()}{page}"

    assert {r.page: r.ocr_text for r in uploads.recognise(waiting, see).collect()} == {1: "q1", 3: None}


def test_layout(spark):
    words = [(1, 0, 0, "Ciao", 0.1, 0.10, 0.2, 0.12), (1, 1, 0, "a", 0.3, 0.105, 0.35, 0.12), (1, 2, 0, "tutti.", 0.1, 0.2, 0.3, 0.22), (1, 3, 1, "Poi", 0.1, 0.2, 0.2, 0.22), (1, 4, 1, "basta", 0.05, 0.2, 0.09, 0.22)]
    d = spark.createDataFrame(words, "doc_id long, pos int, page int, text string, x0 double, y0 double, x1 double, y1 double")
    got = reading.layout_sentences(d).orderBy("seq").collect()
    assert [r.sentence for r in got] == ["Ciao a tutti.", "Poi basta"]
    assert [[(b.page, b.x0, b.y0, b.x1, b.y1) for b in r.boxes] for r in got] == [[(0, 0.1, 0.1, 0.35, 0.12), (0, 0.1, 0.2, 0.3, 0.22)], [(1, 0.1, 0.2, 0.2, 0.22), (1, 0.05, 0.2, 0.09, 0.22)]]


def test_alignment(spark):
    d = spark.createDataFrame([(1, "mare e sole", 4.5), (2, " ", 2.0), (3, "a", 0.0), (4, "uno due  lunghissima", 7.77)], "clip_id long, text string, duration double")
    words = reading.aligned_words(d).cache()
    got = [(r.word, r.start, r.end) for r in words.filter("clip_id = 1").orderBy("pos").collect()]
    assert got == [("mare", 0.0, 2.0), ("e", 2.0, 2.5), ("sole", 2.5, 4.5)]
    four = words.filter("clip_id = 4").orderBy("pos").collect()
    assert four[0].start == 0 and four[-1].end == 7.77 and all(a.end == b.start for a, b in zip(four, four[1:]))
    assert four[2].end - four[2].start > four[1].end - four[1].start
    assert words.filter("clip_id in (2, 3)").count() == 0
    probes = spark.createDataFrame([(1, 1, 2.5), (1, 2, 99.0), (1, 3, -1.0), (9, 4, 1.0)], "clip_id long, probe long, t double")
    assert {r.probe: r.word for r in reading.words_at(words, probes).collect()} == {1: "sole", 2: "sole", 3: None, 4: None}


def test_chapters(spark):
    s = spark.createDataFrame([(1, 0, "Pagina 1", "Uno. Due."), (1, 1, "Pagina 2", "  "), (1, 2, "Pagina 3", "Tre.")], "doc_id long, section int, title string, text string")
    plan = reading.rendered(reading.speech_plan(s).withColumn("n_samples", F.lit(24_000).cast("long")))
    marks = reading.chapters(plan)
    assert [(r.title, r.start_ms, r.end_ms) for r in marks.orderBy("chapter").collect()] == [("Pagina 1", 0, 1300), ("Pagina 3", 1300, 2600)]
    assert reading.chapter_file(marks).first().metadata == ";FFMETADATA1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=1300\ntitle=Pagina 1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=1300\nEND=2600\ntitle=Pagina 3\n"


def test_playback_units(spark):
    words = [5, 4, 6, 30, 2, 11, 3, 1]
    rows = [(1, i, " ".join(["w"] * n), i == 5, i == 6) for i, n in enumerate(words)]
    d = spark.createDataFrame(rows, "doc_id long, seq int, sentence string, placeholder boolean, failed boolean")
    got = [(r.unit, r.kind, r.seq, r.w0, r.w1) for r in reading.playback_units(d).orderBy("unit", "seq").collect()]
    assert got == [(0, "seg", 0, 0, 5), (0, "seg", 1, 0, 4), (1, "seg", 2, 0, 6), (2, "seg", 3, 0, 12), (3, "seg", 3, 12, 24), (4, "seg", 3, 24, 30), (5, "seg", 4, 0, 2), (6, "ocr", 5, 0, 0), (7, "skip", 6, 0, 0), (8, "seg", 7, 0, 1)]


def test_wav(spark):
    d = spark.createDataFrame([([0.0, 1.0, -1.0],), (None,)], "w array<float>")
    got = [r.b for r in d.select(audio.to_wav(spark)(F.col("w")).alias("b")).collect()]
    with wave.open(io.BytesIO(bytes(got[0]))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (1, 2, T.SAMPLE_RATE, 3)
    assert got[1] is None
    chunks = spark.createDataFrame([("abc",)], "chunk string")
    assert audio.synthesised(chunks, lambda: lambda t: np.zeros(len(t) * 2)).first().n_samples == 6


def test_store_replay(spark):
    log = [("s", 1, 0.0, "put", "a", 60), ("s", 2, 5.0, "put", "b", 60), ("s", 3, 6.0, "get", "a", 0), ("s", 4, 7.0, "put", "c", 10), ("s", 5, 8.0, "get", "b", 0), ("s", 6, 200.0, "get", "a", 0), ("t", 7, 9.0, "get", "c", 0)]
    d = spark.createDataFrame(log, "store string, seq long, at double, op string, item string, n_bytes long").repartition(3)
    got = {r.seq: (r.hit, r.evicted, r.held) for r in stores.store_replay(d, "store", ttl=100, most_items=3, most_bytes=100).collect()}
    assert got == {1: (None, [], 60), 2: (None, [], 120), 3: (True, [], 120), 4: (None, ["b"], 70), 5: (False, [], 70), 6: (False, [], 10), 7: (False, [], 0)}


def test_job_replay(spark):
    log = [(1, 0.0, "create", "a"), (2, 1.0, "create", "b"), (3, 2.0, "finish", "b"), (4, 3.0, "create", "c"), (5, 4.0, "read", "a"), (6, 5.0, "create", "d"), (7, 6.0, "read", "a"), (8, 103.5, "read", "c"), (9, 104.0, "create", "e"), (10, 105.0, "read", "d")]
    d = spark.createDataFrame([("s", *x) for x in log], "store string, seq long, at double, op string, job string")
    got = {r.seq: (r.found, r.evicted) for r in stores.job_replay(d, "store", ttl=100, most_items=2).collect()}
    assert got == {1: (None, []), 2: (None, []), 3: (None, []), 4: (None, ["b"]), 5: (True, []), 6: (None, ["a"]), 7: (False, []), 8: (False, []), 9: (None, []), 10: (True, [])}


def test_wav_header_is_what_the_writer_makes(spark):
    d = spark.createDataFrame([(0,), (1,), (70_000,)], "n long")
    for r in d.select("n", audio.wav_header(F.col("n")).alias("h")).collect():
        assert bytes(r.h) == audio.wav_bytes(np.zeros(r.n))[:44]


def test_extraction_of_every_kind(spark):
    made = [("1", "a.html", "", b"<p>Una pagina.</p>"), ("2", "b.epub", "", epub([("a", "u.xhtml", "<p>Un capitolo.</p>")], ["a"])), ("3", "c.pdf", "", b"un testo abbastanza lungo|no"), ("4", "d.txt", "", b"x"), ("5", "e.html", "", b""), ("6", None, "text/html", b"<p>Altra.</p>")]
    d = spark.createDataFrame(made, "path string, filename string, content_type string, content binary")
    got = sorted((r.path, r.page, r.status, r.ocr_error, r.text) for r in uploads.extract(d, lambda b: b.decode().split("|")).collect())
    assert got == [("1", 1, "ready", False, "Una pagina."), ("2", 1, "ready", False, "Un capitolo."), ("3", 1, "ready", False, "un testo abbastanza lungo"), ("3", 2, "empty", True, ""), ("6", 1, "ready", False, "Altra.")]
    assert uploads.extract(d).filter("path = '3'").count() == 0


def test_job_state(spark):
    rows = [(1, 1, "synth", 0, 4, None), (1, 2, "synth", 2, 4, None), (2, 1, "synth", 0, 0, None), (3, 1, "done", None, None, None), (3, 2, "synth", 1, 2, None), (4, 1, "error", None, None, "x")]
    d = spark.createDataFrame(rows, "job_id long, seq long, phase string, done int, total int, detail string")
    got = {r.job_id: (r.phase, r.percent, r.status, r.detail) for r in stores.job_state(d).collect()}
    assert got == {1: ("synth", 50.0, 404, None), 2: ("synth", 0.0, 404, None), 3: ("done", 100.0, 200, None), 4: ("error", 0.0, 500, "x")}


def test_requests(spark):
    raw = ['{"text": "Ciao"}', '{"text": "", "voice": "if_sara"}', '{"text": "x", "speed": 9}', '{"text": "x", "format": "ogg"}', '{"text": " "}', '{"text": "x", "voice": "no"}']
    got = [r.error for r in uploads.requests(spark.createDataFrame([(x,) for x in raw], "value string")).collect()]
    assert got == [None, 422, 422, 400, 400, 400]


def test_streamed_hits(spark, tmp_path):
    rows = [("a", 1, 0, "put"), ("a", 2, 1000, "get"), ("a", 3, 2700, "get"), ("a", 4, 4600, "get"), ("b", 5, 10, "get")]
    d = spark.createDataFrame(rows, "item string, event_id long, at long, op string")
    d.write.parquet(f"{tmp_path}/in")
    q = live.document_hits(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), reclaim=False).writeStream.format("memory").queryName("hits").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {r.event_id: r.hit for r in spark.table("hits").collect()} == {1: False, 2: True, 3: True, 4: False, 5: False}


def test_streamed_progress(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    d = spark.createDataFrame([(1, at, "synth", 0, 1, None), (1, at, "synth", 0, 1, None), (1, at, "done", None, None, None)], "job_id long, ts timestamp, phase string, done int, total int, detail string")
    d.write.parquet(f"{tmp_path}/in")
    q = live.progress_events(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("lines").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.line for r in spark.table("lines").collect()) == ['data: {"phase":"done"}\n\n', 'data: {"phase":"synth","done":0,"total":1}\n\n']


def test_event_lines(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, 1, at, "synth", 0, 2, "a"), (1, 2, at + datetime.timedelta(seconds=40), "synth", 1, 2, "a"), (1, 3, at + datetime.timedelta(seconds=41), "done", 2, 2, "a"), (1, 4, at + datetime.timedelta(seconds=90), "synth", 2, 2, "a")]
    d = spark.createDataFrame(rows, "job_id long, seq long, ts timestamp, phase string, done int, total int, detail string")
    got = [(r.seq, r.beats, r.line) for r in stores.event_lines(d).orderBy("seq").collect()]
    assert [g[:2] for g in got] == [(1, 0), (2, 2), (3, 0)]
    assert got[1][2] == ": keep-alive\n\n" * 2 + 'data: {"phase":"synth","done":1,"total":2,"detail":"a"}\n\n'


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "in.txt").write_text("Ecco un testo. Finisce qui.", encoding="utf-8")
    cli.main([str(tmp_path / "in.txt"), str(tmp_path / "out"), "--chapters-per-page"])
    assert [r.chunk for r in spark.read.parquet(f"{tmp_path}/out/plan").collect()] == ["Ecco un testo. Finisce qui."]
    assert "title=Pagina 1" in spark.read.parquet(f"{tmp_path}/out/chapters").first().metadata
    monkeypatch.setattr("sys.stdin", io.StringIO("Dal flusso."))
    cli.main(["-", str(tmp_path / "two"), "--voice", "im_nicola"])
    assert spark.read.parquet(f"{tmp_path}/two/plan").first().voice == "im_nicola"
    assert "texts planned into" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["-", str(tmp_path / "three"), "--voice", "nobody"])


BAD_BOOKS = {
    "no archive": b"PK but no archive",
    "no container": {"mimetype": "application/epub+zip"},
    "cut container": {"META-INF/container.xml": "<container><rootfiles><rootf"},
    "no rootfile": {"META-INF/container.xml": "<container><rootfiles/></container>"},
    "no package": {"META-INF/container.xml": "<container><rootfile full-path='b.opf'/></container>"},
    "cut package": {"META-INF/container.xml": "<container><rootfile full-path='b.opf'/></container>", "b.opf": "<package><manifest><item id='a' href='a.xhtml'/>"},
}


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_one_bad_upload_is_one_row(spark):
    box = "<?xml version='1.0'?><!DOCTYPE container SYSTEM 'http://nowhere.invalid/x.dtd'><container><rootfile full-path='b.opf'/></container>"
    package = "<package><manifest><item id='a' href='50%.xhtml'/><item id='b' href='a%20b%2.xhtml#x'/><item id='c' href='bad.xhtml'/></manifest><spine><itemref idref='a'/><itemref idref='c'/><itemref idref='b'/></spine></package>"
    good = archive({"META-INF/container.xml": box, "b.opf": package, "50%.xhtml": "<p>Metà.</p>", "a b%2.xhtml": "<p>Altro.</p>", "bad.xhtml": "<p>" + "Rovinato, ma lungo abbastanza. " * 20})
    at = good.index(b"bad.xhtml") + 20  # inside the member's own bytes
    good = good[:at] + b"\xff" * 12 + good[at + 12 :]
    books = [("good", good), *((k, v if isinstance(v, bytes) else archive(v)) for k, v in BAD_BOOKS.items())]
    made = [(k, f"{k}.epub", v) for k, v in books] + [("pdf 1", "a.pdf", b"broken"), ("pdf 2", "b.pdf", b"una pagina lunga abbastanza"), ("html", "c.html", b"<p>Testo.</p>")]
    d = spark.createDataFrame([(k, n, "", v) for k, n, v in made], "path string, filename string, content_type string, content binary").repartition(3)

    def parse(data):
        if data == b"broken":
            raise ValueError("no pages")
        return [data.decode()]

    got = {}
    for r in uploads.extract(d, parse).collect():
        got.setdefault(r.path, []).append((r.page, r.status, r.text, bool(r.error), r.ocr_error))
    refused = [(None, "refused", "", True, False)]
    assert got == {**dict.fromkeys(BAD_BOOKS, refused), "pdf 1": refused, "good": [(1, "ready", "Metà.", False, False), (2, "ready", "Altro.", False, False)],
                   "pdf 2": [(1, "ready", "una pagina lunga abbastanza", False, False)], "html": [(1, "ready", "Testo.", False, False)]}


def test_pages_of_requests_count_from_one(spark):
    d = spark.createDataFrame([("d", 1), ("d", 0), ("d", -3), ("d", None), (None, 2)], "doc_id string, page int")
    assert [r.e for r in d.select(uploads.page_request_error(F.col("doc_id"), F.col("page")).alias("e")).collect()] == [None, 422, 422, 422, 422]
    raw = spark.createDataFrame([('{"text": "x", "page": 0}',), ('{"text": "x", "page": 2}',)], "value string")
    assert [r.error for r in uploads.requests(raw).collect()] == [422, None]
