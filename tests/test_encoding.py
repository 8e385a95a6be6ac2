"""Texts misread in code pages, and composition, against bytes and the standard library."""

import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from vocalis.functions import encoding, text
from vocalis.operators import reading
from vocalis.sources import uploads

PROSE = ["perché la città è già così, più in là", "L’uomo disse: «perché?» — 5 € … “no”", "Příliš žluťoučký kůň úpěl ďábelské ódy", "Привет, мир! Ёлка и объём", "Größe, Übung, Maß, señor ¿qué? Ångström", "naïve cœur 日本語 テスト", "Ελληνικά κείμενα", "ok 😀 va bene"]
RIGHT = ["PERCHÉ» disse", "«ТРЁХ» ВСЁ", "CAFÉ® É»", "VOILÀ… À“", "СЁСТРЫ", "Ã e Â", "chauxç. Èèé aique", "ßäü. Schbe", "10 °C ±2 §4", "plain", ""]


@pytest.mark.parametrize("page", encoding.PAGES)
def test_misread_once(page):
    for t in PROSE:
        assert encoding.undo(encoding.shown(t.encode(), page)) == t


def test_misread_twice_and_more():
    for t in PROSE:
        for _ in range(3):
            misread = t
            for _ in range(random.Random(t).randint(2, 3)):
                misread = encoding.shown(misread.encode(), "cp1252")
            assert encoding.undo(misread) == t


def test_right_texts_stay():
    assert [encoding.undo(t) for t in PROSE + RIGHT] == PROSE + RIGHT


def test_letters_are_no_digit_or_sign_of_another_script():
    """Three letters beyond ASCII that are the bytes of a Myanmar digit or of a Yi radical."""
    right = ["einver chßüä tesch", "für dieerßüü ererbeheit", "ar. Ííñ la", "As.\nÍíí los", "schßüè, ßüë"]
    assert [encoding.undo(t) for t in right] == right
    other = ["हिन्दी में १२३।", "မြန်မာ ၁၂၃၊", "العربية، ١٢٣؟", "ไทย ๑๒", "가 → ✓ ™ 5 ‰", "שָׁלוֹם"]
    for t in other:
        for page in ("cp1252", "latin-1", "iso8859-2", "cp437"):
            assert encoding.undo(encoding.shown(t.encode(), page)) == t


def test_in_spark_only_suspects_reach_python(spark):
    uploads.ship(spark)
    damaged = [encoding.shown(t.encode(), p) for t in PROSE for p in ("latin-1", "cp1251")] + RIGHT + PROSE
    d = spark.createDataFrame([(i, t) for i, t in enumerate(damaged)] + [(999, None)], "i int, t string")
    got = {r.i: r.u for r in d.select("i", encoding.undone(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(len(damaged))] == [t for t in PROSE for _ in range(2)] + RIGHT + PROSE and got[999] is None
    suspects = {r.i for r in d.filter(F.col("t").rlike(encoding.suspect())).collect()}
    assert suspects >= set(range(2 * len(PROSE))) and not any(damaged[i].isascii() for i in suspects)
    whole = reading.repaired(spark.createDataFrame([(encoding.shown(encoding.shown("perché ﬁne​".encode(), "cp1252").encode(), "cp1252"),), (None,)], "text string"))
    assert sorted(r.text for r in whole.collect()) == ["", "perché fine"]


def test_composition_of_every_script(spark):
    apart = {unicodedata.normalize("NFD", chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.decomposition(chr(c)) and "<" not in unicodedata.decomposition(chr(c))}
    apart |= {unicodedata.normalize("NFD", chr(c)) for c in range(0xAC00, 0xD7A4, 7)}
    r = random.Random(1)
    marks = [chr(c) for c in range(0x300, 0x370)] + ["़", "ַ", "゙"]
    apart |= {r.choice("aeiouqAΩЖ한क") + "".join(r.sample(marks, 4)) for _ in range(2_000)}
    cases = sorted(apart)
    d = spark.createDataFrame([(x,) for x in cases], "x string").repartition(4)
    got = {x.x: x.c for x in d.select("x", text.nfc(F.col("x")).alias("c")).collect()}
    assert got == {x: unicodedata.normalize("NFC", x) for x in cases}
    con = duckdb.connect()
    con.execute("create table c (x varchar)")
    con.executemany("insert into c values (?)", [[x] for x in r.sample(cases, 1_000)])
    assert all(got[x] == y for x, y in con.execute("select x, nfc_normalize(x) from c").fetchall())
