"""Sentences and words as column expressions. Nothing here shuffles: a text's sentences are found
within its row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocalis.functions import tables as T
from vocalis.functions.text import let, one_of, tokens, trim

_END = f"[{T.TERMINALS}]+{one_of(T.CLOSERS)}*"
_CUT = "\x01"


def _marked(paragraph: Column) -> Column:
    """The sentences of a paragraph: pieces end at marks and white space; those that don't end a
    sentence are put together again."""
    # possessive all through: each character is looked at once
    mark, closer = f"[{T.TERMINALS}]++", f"{one_of(T.CLOSERS)}*+"
    rest = f"[^{T.TERMINALS}]*+"
    pieces = F.regexp_extract_all(paragraph, F.lit(rf"(?sU)(?:{rest}{mark}(?!{closer}\s))*+{rest}{mark}{closer}\s++|.+"), F.lit(0))

    def joined(some: Column) -> Column:
        def last_word(x: Column) -> Column:
            return F.regexp_extract(x, r"(?sU)\A(?:.*\s)?(\S+)\s*\z", 1)

        def closes(x: Column, i: Column) -> Column:
            own = last_word(F.regexp_replace(x, rf"(?U){_END}\s+\z", ""))
            word = let(own, lambda w: F.when(w != "", w).when(i > 0, last_word(F.get(some, i - 1))).otherwise(""))
            ended = let(F.rtrim(F.lower(word), F.lit(".")), lambda w: ~w.isin(T.ABBREVIATIONS) & (F.length(w) != 1))
            return ended & ~F.coalesce(F.get(some, i + 1), F.lit("")).rlike(r"^\p{javaLowerCase}")

        return F.array_join(F.transform(some, lambda x, i: F.concat(x, F.when(closes(x, i), _CUT).otherwise(""))), "")

    return F.filter(F.transform(F.split(let(pieces, joined), _CUT), trim), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Array of a text's sentences in order; paragraphs are parted by blank lines."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), trim), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, _marked))


def sentences_or_text(text: Column) -> Column:
    """Sentences; else the whole text if it isn't blank."""
    return let(sentences(text), lambda s: F.when(F.size(s) > 0, s).when(trim(text) != "", F.array(text)).otherwise(F.array().cast("array<string>")))


def is_sentence_end(word: Column) -> Column:
    """Whether a placed word ends a sentence."""
    bare = F.rtrim(word, F.lit(T.CLOSERS))
    token = F.lower(F.rtrim(bare, F.lit(T.TERMINALS)))
    return F.right(bare, F.lit(1)).isin(*T.TERMINALS) & ~token.isin(T.ABBREVIATIONS) & (F.length(token) > 1)


def chunks(some: Column, max_chars: int = T.MAX_CHUNK) -> Column:
    """Sentences packed in order into texts of at most max_chars; a longer sentence stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def add(state: Column, s: Column) -> Column:
        fits = F.length(state["now"]) + 1 + F.length(s) <= max_chars
        return (
            F.when(state["now"].isNull(), F.struct(state["done"].alias("done"), s.alias("now")))
            .when(fits, F.struct(state["done"].alias("done"), F.concat(state["now"], F.lit(" "), s).alias("now")))
            .otherwise(F.struct(F.concat(state["done"], F.array(state["now"])).alias("done"), s.alias("now")))
        )

    return F.aggregate(some, start, add, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def line_boxes(words: Column) -> Column:
    """Words (structs of page, x0, y0, x1, y1, in order) merged into one box for each line."""
    box = "struct<page:int,x0:double,y0:double,x1:double,y1:double>"
    start = F.struct(F.array().cast(f"array<{box}>").alias("done"), F.lit(None).cast(box).alias("now"))
    tolerance = F.lit(T.LINE_TOLERANCE)

    def make(w: Column, **new: Column) -> Column:
        return F.struct(*(new.get(c, w[c]).cast("int" if c == "page" else "double").alias(c) for c in ("page", "x0", "y0", "x1", "y1")))

    def add(state: Column, w: Column) -> Column:
        now = state["now"]
        same = (w["page"] == now["page"]) & (F.abs(w["y0"] - now["y0"]) < tolerance) & (w["x0"] >= now["x0"] - tolerance)
        wider = make(now, x1=F.greatest(now["x1"], w["x1"]), y0=F.least(now["y0"], w["y0"]), y1=F.greatest(now["y1"], w["y1"]))
        return (
            F.when(now.isNull(), F.struct(state["done"].alias("done"), make(w).alias("now")))
            .when(same, F.struct(state["done"].alias("done"), wider.alias("now")))
            .otherwise(F.struct(F.concat(state["done"], F.array(now)).alias("done"), make(w).alias("now")))
        )

    return F.aggregate(words, start, add, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def n_words(text: Column) -> Column:
    return F.size(tokens(text))
