"""Files put together from parts, archives read by members, and the command line with plug-ins."""

import io
import os
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalis import cli
from vocalis.sources import audio, files


def test_wav_files_of_documents(spark, tmp_path):
    r = np.random.default_rng(3)
    waves = {(d, k): r.uniform(-1.2, 1.2, r.integers(0, 50)).astype(np.float32) for d in ("uno", "due/è", "tre") for k in range(4)}
    rows = [(d, k, w.tolist()) for (d, k), w in waves.items()] + [("vuoto", 0, None)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_no int, samples array<float>").repartition(5)
    at = str(tmp_path / "out")
    audio.write_wav(chunks, at, rate=8000, gap=0.002)
    assert sorted(os.listdir(at)) == ["due%2F%C3%A8.wav", "tre.wav", "uno.wav", "vuoto.wav"]
    for d, name in (("uno", "uno.wav"), ("due/è", "due%2F%C3%A8.wav"), ("vuoto", "vuoto.wav")):
        with wave.open(f"{at}/{name}") as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 2, 8000)
            got = np.frombuffer(w.readframes(w.getnframes()), "<i2")
        parts = [waves[d, k] for k in range(4)] if d != "vuoto" else [np.zeros(0)]
        want = np.concatenate([np.concatenate([(np.clip(p.astype(float), -1, 1) * 32767).astype("<i2"), np.zeros(16, "<i2")]) for p in parts])
        assert got.tolist() == want.tolist()


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    at = str(tmp_path / "out")
    parts = spark.createDataFrame([(f"f{i}", 0, b"x") for i in range(20)] + [("bad/name", 0, b"x")], "file string, part int, content binary")
    with pytest.raises(Exception, match="slash"):
        files.write_parts(parts, at)
    assert not os.path.exists(at) or os.listdir(at) == []
    files.register(spark)
    apart = spark.createDataFrame([("f", 0, b"a"), ("f", 1, b"b")], "file string, part int, content binary").repartitionByRange(2, "part")
    with pytest.raises(Exception, match="one task"):
        apart.write.format("part_files").mode("append").save(at)
    assert os.listdir(at) == []
    files.write_parts(parts.filter("file <> 'bad/name'"), at)
    assert len(os.listdir(at)) == 20
    files.write_parts(parts.limit(0), at)
    assert len(os.listdir(at)) == 20


def test_archives_by_members(spark, tmp_path):
    members = {f"m{i:02}": os.urandom(2_000 + i) for i in range(40)}
    for n in range(3):
        with zipfile.ZipFile(tmp_path / f"{n}.epub", "w") as z:
            for name, body in members.items():
                z.writestr(name, body)
    (tmp_path / "broken.epub").write_bytes(b"PK nothing")
    data = bytearray((tmp_path / "2.epub").read_bytes())
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        at = z.getinfo("m07").header_offset
    data[at + 100] ^= 0xFF  # its checksum fails
    (tmp_path / "2.epub").write_bytes(data)
    for task_bytes in (10_000, 1 << 30):
        df = files.archive_members(spark, str(tmp_path), task_bytes=task_bytes)
        assert df.rdd.getNumPartitions() == (1 if task_bytes > 1 << 20 else 28)
        got = {(os.path.basename(r.path), r.name): (r.size, r.body and bytes(r.body), bool(r.error)) for r in df.collect()}
        assert len(got) == 121 and got["broken.epub", None] == (None, None, True)
        for n in range(3):
            for name, body in members.items():
                assert got[f"{n}.epub", name] == ((len(body), None, True) if (n, name) == (2, "m07") else (len(body), body, False))
    # names and sizes alone unpack nothing, so they have no errors of members
    assert files.archive_members(spark, str(tmp_path), "name string, size long").filter("name is not null").agg(F.sum("size")).first()[0] == 3 * sum(map(len, members.values()))
    with pytest.raises(Exception, match="no such columns"):
        files.archive_members(spark, str(tmp_path), "nome string").collect()


def parser(data):
    return [x.decode() for x in data.split(b"|")]


def loader():
    return lambda text: np.full(len(text), 0.5, np.float32)


def test_command_line_with_a_parser_and_a_synthesiser(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/uno.pdf").write_bytes("Una prima pagina, lunga abbastanza.|Una seconda pagina, anche lei lunga.".encode())
    (tmp_path / "in/due.html").write_bytes("<p>Una pagina sola.</p>".encode())
    out = str(tmp_path / "out")
    spark.sparkContext.addPyFile(__file__)  # workers import it by name
    here = __name__
    cli.main([str(tmp_path / "in"), out, "--chapters-per-page", "--pdf", f"{here}:parser", "--speech", f"{here}:loader"])
    plan = spark.read.parquet(f"{out}/plan").collect()
    assert sorted(r.chunk for r in plan) == ["Una pagina sola.", "Una prima pagina, lunga abbastanza.", "Una seconda pagina, anche lei lunga."]
    lengths = {}
    for name in os.listdir(f"{out}/audio"):
        with wave.open(f"{out}/audio/{name}") as w:
            lengths["uno" if "uno" in name else "due"] = w.getnframes()
    assert lengths == {"uno": 35 + 36 + 2 * 7200, "due": 16 + 7200}
    assert {r.metadata.count("[CHAPTER]") for r in spark.read.parquet(f"{out}/chapters").collect()} == {1, 2}
