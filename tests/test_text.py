"""Text rules on literal cases, and their invariants."""

import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vocalis.functions import speech, text
from vocalis.functions import tables as T
from vocalis.operators import reading


def apply(spark, rule, values):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in d.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (text.clean_text, {
        "una barca gran-\ndiosa": "una barca grandiosa", "prima\nseconda": "prima seconda", "capo\n\ncoda": "capo\n\ncoda", "sole\n \n\n vento   mare": "sole\n\n vento mare",
        "": "", " \n ": "", "cosÃ¬ sia": "così sia", "ﬂotta": "flotta", "bi­nario​": "binario", "caffe\u0301 nero": "caffé nero", "verita' e mo'": "verità e mo'",
        "dal 01/03/1987 . . . poi": "dal primo marzo 1987… poi", "Davvero?! (mah)": "Davvero?! (mah)",
    }),
    (text.ocr_clean, {
        "rosso | ~ 17 verde": "rosso 17 verde", "alto????": "alto?", "8 %": "8 %", "P & Q": "P & Q", "35 °": "35 °", "x\u0007y\tz\nw": "xy\tz\nw",
        "ﬃcio e\u0300": "fficio è", "====": "=", "k\n\n¦ m": "k\n\nm", "": "",
    }),
    (text.accents, {
        "benche'": "benché", "percio'": "perciò", "trentatre'": "trentatré", "Tornero'": "Tornerò", "d'oro": "d'oro", "mo'": "mo'", "FINCHE'": "FINCHÉ", "sta', di'": "sta', di'",
        "vicere'.": "viceré.", "bonta’!": "bontà!", "quest'ora": "quest'ora", "tribu´": "tribù",
    }),
    (text.despace, {"v e l a": "vela", "u o a i": "u o a i", "m n o": "m n o", "ecco F I N E qui": "ecco FINE qui", "r a m o scello": "ramo scello"}),
    (text.lexicon, {"PIU": "PIÙ", "te": "te", "la": "la", "papa": "papa", "Verita": "Verità", "gia detto": "già detto", "veritas": "veritas", "x.cosi": "x.così"}),
    (text.dates, {
        "nel 01/12/1955": "nel primo dicembre 1955", "7/13/1990": "7/13/1990", "45/02/1990": "45/02/1990", "v. 3.0.2": "v. 3.0.2", "8-9-1943": "8 settembre 1943", "03.06.0070": "3 giugno 70",
        "30/02/1999": "30 febbraio 1999", "912/05/1999": "912/05/1999",
    }),
    (text.ellipses, {"Dunque . . . basta": "Dunque… basta", "z.....": "z…", "z..": "z..", "z… …": "z…", "z….": "z…"}),
]


@pytest.mark.parametrize("rule,cases", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_cases(spark, rule, cases):
    assert dict(zip(cases, apply(spark, rule, list(cases)))) == cases


def test_every_word_of_the_lexicon(spark):
    words = T.lexicon()
    assert len(words) == 83
    want = {b: w for b, w in words.items()} | {b.upper(): w.upper() for b, w in words.items()} | {b.capitalize(): w.capitalize() for b, w in words.items()}
    assert dict(zip(want, apply(spark, text.lexicon, list(want)))) == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("aeiobcE'’ .,/1029\n…àé"), max_size=40), min_size=40, max_size=40))
def test_normalising_again_changes_nothing(spark, texts):
    once = apply(spark, text.normalize_for_speech, texts)
    assert apply(spark, text.normalize_for_speech, once) == once


SENTENCES = {
    "La Sig.ra Neri canta. Poi tace!": ["La Sig.ra Neri canta.", "Poi tace!"], "G. Verdi compose.": ["G. Verdi compose."], "Forse... Chissà.": ["Forse...", "Chissà."],
    "Alba.\n\nSera": ["Alba.", "Sera"], "grida: «Fermo!» Corre": ["grida: «Fermo!»", "Corre"], "pag. e poi. allora": ["pag. e poi. allora"], "": [], " \n\n ": [], "Sera. ... Notte": ["Sera.", "...", "Notte"],
    "Piove? No.": ["Piove?", "No."],
}


def test_sentences(spark):
    assert dict(zip(SENTENCES, apply(spark, speech.sentences, list(SENTENCES)))) == SENTENCES


def test_sentence_ends(spark):
    cases = {"fine.": True, "dott.": False, "A.": False, "vero?»": True, "parola": False, "…": False, "": False, "ciao!\"": True}
    assert dict(zip(cases, apply(spark, speech.is_sentence_end, list(cases)))) == cases


def test_chunks(spark):
    verses = ["Canta il mare.", "Tace.", "Il vento sale piano.", "Dorme.", "Sogna."]
    for most in (14, 15, 20, 21, 27, 60):
        want, now = [], None
        for v in verses:
            if now is not None and len(now) + 1 + len(v) <= most:
                now += " " + v
            else:
                want += [now] if now else []
                now = v
        d = spark.createDataFrame([(verses,)], "s array<string>")
        assert d.select(speech.chunks(F.col("s"), most).alias("c")).first().c == [*want, now]
    assert spark.createDataFrame([([],)], "s array<string>").select(speech.chunks(F.col("s"), 9).alias("c")).first().c == []


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(3)
    bits = [*"aeiouxbPÈ'’ʼ´`  .,;-\n\n\t\r…0/9\x00\x07\x0c\x1c\x85\xa0\xadâÃ¬“ﬁ\u0300\u200b\u2003\u3000ł😀", "perche", "Citta", "PIU", "gia", "e'", "f o n d o", " . . .", "..", "3/4/1950", "-\n", "\n \n", "sole vento"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(3_000)] + [c + "a" + c for c in text.WHITE] + ["x" + chr(c) for c in range(0x400)]


def test_what_leaves_texts_alone_takes_in_all_that_rules_change(spark, odd_texts):
    """The rules without the looks that go before them give the same texts."""

    def clean(t):
        t = text.despace(text.accents(text.nfc(text.unwrap(text.repair(t)))))
        return F.regexp_replace(text.ellipses(text.dates(text.lexicon(t))), r"(?U)^\s+|\s+\z", "")

    same = lambda f, g: [(x, y, z) for x, y, z in zip(odd_texts, apply(spark, f, odd_texts), apply(spark, g, odd_texts)) if y != z]
    assert same(text.clean_text, clean) == []
    assert same(text.trim, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+\z", "")) == []
    assert same(text.despaced_lexicon, lambda t: text.lexicon(text.despace(t))) == []
    with pytest.MonkeyPatch.context() as m:
        always = lambda t, _, rule: text.let(t, rule)
        for name in ("where_found", "where_any", "unless_only"):
            m.setattr(text, name, always)
        bare = apply(spark, clean, odd_texts)
    assert [x for x in zip(odd_texts, bare, apply(spark, text.clean_text, odd_texts)) if x[1] != x[2]] == []


CLEANED = {"clean_text": lambda d: d.select(text.clean_text(F.col("text"))), "eager_pages": lambda d: reading.eager_pages(d.withColumn("ocr_text", F.lit("")))}


@pytest.mark.parametrize("cleaned", CLEANED)
def test_plain_prose_costs_a_few_looks(spark, cleaned):
    """F14, F16: prose that no rule changes, against six looks by a pattern of one class."""
    prose = "Haanth hewh onon hahehe. Ing that of ontiontion, as thatndou the antiing thin. " * 40_000
    d = spark.range(2).select(F.lit(prose).alias("text")).cache()

    def took(some):
        seconds = []
        for _ in range(3):
            began = time.perf_counter()
            some.write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        return min(seconds)

    assert took(CLEANED[cleaned](d)) < 3.5 * took(d.select([F.col("text").rlike(f"[{c}]").alias(c) for c in "QWXYZK"]))
