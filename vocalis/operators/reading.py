"""Documents to pages, sentences, chunks, chapters, word times and playback units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalis.functions import encoding, speech, text
from vocalis.functions import tables as T
from vocalis.operators import sequences
from vocalis.scratch import Scratch
from vocalis.shipping import ship


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, seq (from 0), sentence."""
    return docs.select(id_col, F.posexplode(speech.sentences(F.col(text_col))).alias("seq", "sentence"))


def repaired(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts without damage from extraction: read back from any code page, then text.repair."""
    ship(docs.sparkSession)
    return docs.withColumn(text_col, encoding.undone(F.col(text_col))).withColumn(text_col, text.repair(F.coalesce(F.col(text_col), F.lit(""))))


def page_status(pages: DataFrame, ocr_available: bool | Column, text_col: str = "text") -> DataFrame:
    """Text layers of MIN_TEXT_LAYER characters or more are ready and cleaned; others wait for
    recognition, or are empty with an error where there is none (for all pages, or by a column). Short text
    is dropped."""
    enough = F.length(text.trim(F.coalesce(F.col(text_col), F.lit("")))) >= T.MIN_TEXT_LAYER
    return (
        pages.withColumn("status", F.when(enough, "ready").when(F.lit(ocr_available), "needs_ocr").otherwise("empty"))
        .withColumn("ocr_error", ~enough & ~F.lit(ocr_available))
        .withColumn(text_col, F.when(enough, text.clean_text(F.col(text_col))).otherwise(""))
    )


def eager_pages(pages: DataFrame, text_col: str = "text", ocr_col: str = "ocr_text") -> DataFrame:
    """The eager variant: recognised text replaces a short text layer only if it isn't blank."""
    short = F.length(text.trim(F.coalesce(F.col(text_col), F.lit("")))) < T.MIN_TEXT_LAYER
    seen = text.ocr_clean(F.col(ocr_col))
    use = short & (text.trim(seen) != "")
    return pages.withColumn("ocr_used", use).withColumn(text_col, text.clean_text(F.when(use, seen).otherwise(F.coalesce(F.col(text_col), F.lit("")))))


def eager_document(pages: DataFrame, id_col: str = "doc_id", text_col: str = "text", ocr_col: str = "ocr_text") -> DataFrame:
    """A row per document: pages joined by blank lines and cleaned once, pages recognised, counts."""
    short = F.length(text.trim(F.coalesce(F.col(text_col), F.lit("")))) < T.MIN_TEXT_LAYER
    seen = text.ocr_clean(F.col(ocr_col))
    use = short & (text.trim(seen) != "")
    one = pages.select(id_col, "page", use.alias("used"), F.when(use, seen).otherwise(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    some = F.sort_array(F.collect_list(F.struct("page", "body", "used")))
    return one.groupBy(id_col).agg(some.alias("p")).select(
        id_col,
        text.clean_text(F.array_join(F.col("p.body"), "\n\n")).alias("text"),
        F.size("p").alias("page_count"),
        F.transform(F.filter("p", lambda x: x["used"]), lambda x: x["page"]).alias("ocr_pages"),
    ).withColumn("ocr_used", F.size("ocr_pages") > 0)


def document_summary(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """pages with status and cleaned text: a row per document, as an upload is answered."""
    some = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("page", "text"))))
    return (
        pages.groupBy(id_col)
        .agg(
            F.count(F.lit(1)).alias("page_count"),
            F.count_if(F.col("status") == "needs_ocr").alias("pending_pages"),
            F.bool_or(F.coalesce(F.col("ocr_error"), F.lit(False))).alias("ocr_error"),
            F.array_join(F.transform(some, lambda x: x["text"]), "\n\n").alias("text"),
        )
        .withColumn("char_count", F.length("text"))
        .withColumn("sentence_count", F.size(speech.sentences(F.col("text"))))
    )


def document_json(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The answer to an upload as JSON: pages with their sentences, pending pages, counts."""
    page = F.struct("page", "status", speech.sentences(F.col("text")).alias("sentences"), F.col("text"))
    some = pages.groupBy(id_col).agg(F.sort_array(F.collect_list(page)).alias("p"))
    full = F.array_join(F.transform(F.filter("p", lambda x: x["text"] != ""), lambda x: x["text"]), "\n\n")
    answer = F.struct(
        F.col(id_col).cast("string").alias("doc_id"),
        F.size("p").alias("page_count"),
        F.transform("p", lambda x: F.struct(x["page"].alias("page"), x["status"].alias("status"), x["sentences"].alias("sentences"))).alias("pages"),
        F.transform(F.filter("p", lambda x: x["status"] == "needs_ocr"), lambda x: x["page"]).alias("pending_pages"),
        full.alias("text"),
        F.length(full).alias("char_count"),
    )
    return some.select(id_col, F.to_json(answer).alias("json"))


def splice_ocr(pages: DataFrame, seen: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Recognition results (id, page, ocr_text or null for a failure) put into the pages that wait for
    them: ready, empty where nothing could be read, ocr_failed where recognition failed."""
    seen = seen.select(F.col(id_col).alias("_id"), F.col("page").alias("_page"), "ocr_text", F.lit(True).alias("_tried"))
    both = pages.join(seen, (F.col(id_col) == F.col("_id")) & (F.col("page") == F.col("_page")), "left")
    cleaned = text.clean_text(text.ocr_clean(F.col("ocr_text")))
    due = (F.col("status") == "needs_ocr") & F.coalesce("_tried", F.lit(False))
    status = F.when(~due, F.col("status")).when(F.col("ocr_text").isNull(), "ocr_failed").when(cleaned == "", "empty").otherwise("ready")
    body = F.when(~due, F.col("text")).when(F.col("ocr_text").isNull(), "").otherwise(cleaned)
    return both.select(id_col, "page", status.alias("status"), body.alias("text"))


def viewer_sentences(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The reader's flat list: a placeholder for a page that waits, a message for one that failed,
    else the page's sentences. id, page, nth (on the page), sentence, placeholder, failed."""
    no = F.col("page").cast("string")
    shown = (
        F.when(F.col("status") == "needs_ocr", F.array(F.concat(F.lit("Pagina "), no, F.lit(T.WAITS))))
        .when(F.col("status") == "ocr_failed", F.array(F.concat(F.lit("Pagina "), no, F.lit(T.FAILED))))
        .otherwise(speech.sentences(F.col("text")))
    )
    return pages.select(id_col, "page", (F.col("status") == "needs_ocr").alias("placeholder"), (F.col("status") == "ocr_failed").alias("failed"), F.posexplode(shown).alias("nth", "sentence"))


def first_readable(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The first row of each document that can be read: id, page, nth."""
    return rows.filter(~F.col("failed")).groupBy(id_col).agg(F.min(F.struct("page", "nth")).alias("at")).select(id_col, "at.page", "at.nth")


def export_text(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The client's export text: sentences of a page joined by a space, pages by a blank line."""
    body = F.array_join(speech.sentences(F.col("text")), " ")
    one = pages.select(id_col, "page", body.alias("body")).filter("body <> ''")
    return one.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "\n\n").alias("text"))


def layout_words(words: DataFrame) -> DataFrame:
    """Words with boxes in points to fractions of the page; a width or height of 0 counts as 1."""
    w, h = (F.when(F.col(c) == 0, 1.0).otherwise(F.col(c)) for c in ("width", "height"))
    return words.select("*", *((F.col(c) / (w if c[0] == "x" else h)).alias(f"{c}_share") for c in ("x0", "y0", "x1", "y1")))


def layout_sentences(words: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Placed words (id, pos, page, text, x0, y0, x1, y1): sentences with their boxes."""
    ends = speech.is_sentence_end(F.col("text")).cast("int")
    numbered = sequences.running(words, id_col, "pos", {"_ended": ends}).withColumn("seq", (F.col("_ended") - ends).cast("int"))
    some = F.sort_array(F.collect_list(F.struct("pos", "text", "page", "x0", "y0", "x1", "y1")))
    return numbered.groupBy(id_col, "seq").agg(some.alias("w")).select(id_col, "seq", F.array_join(F.col("w.text"), " ").alias("sentence"), speech.line_boxes(F.col("w")).alias("boxes"))


def laid_out(docs: DataFrame, id_col: str = "doc_id", words: str = "words") -> DataFrame:
    """layout_sentences of documents that hold their placed words in order as an array of structs: within the
    row, without a shuffle. A document's words must fit a task's memory."""

    def cut(ws: Column) -> Column:
        marks = F.filter(F.transform(ws, lambda w, i: F.when(speech.is_sentence_end(w["text"]), i + 1)), lambda i: i.isNotNull())
        # words after the last end are a sentence too
        ends = text.let(marks, lambda m: F.when(F.coalesce(F.get(m, F.size(m) - 1), F.lit(0)) < F.size(ws), F.concat(m, F.array(F.size(ws)))).otherwise(m))
        before = lambda e, k: F.coalesce(F.get(e, k - 1), F.lit(0))
        return text.let(ends, lambda e: F.transform(e, lambda to, k: F.slice(ws, before(e, k) + 1, to - before(e, k))))

    some = docs.select(id_col, F.posexplode(text.let(F.col(words), cut)).alias("seq", "w"))
    return some.select(id_col, "seq", F.array_join(F.col("w.text"), " ").alias("sentence"), speech.line_boxes(F.col("w")).alias("boxes"))


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_chars: int = T.MAX_CHUNK) -> DataFrame:
    """id, chunk_no (from 0), chunk."""
    return docs.select(id_col, F.posexplode(speech.chunks(speech.sentences_or_text(F.col(text_col)), max_chars)).alias("chunk_no", "chunk"))


def speech_plan(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sections (id, section, title, text) to chunks in order; only a section's first has the title."""
    one = sections.select(id_col, "section", "title", F.posexplode(speech.chunks(speech.sentences_or_text(F.col("text")))).alias("nth", "chunk"))
    order = Window.partitionBy(id_col).orderBy("section", "nth")
    return one.select(id_col, (F.row_number().over(order) - 1).alias("chunk_no"), F.when(F.col("nth") == 0, F.col("title")).alias("title"), "chunk")


def rendered(plan: DataFrame, id_col: str = "doc_id", rate: int = T.SAMPLE_RATE, gap: float = T.GAP_SECONDS) -> DataFrame:
    """Plan rows with n_samples: each chunk's end in seconds, silence included, and where it starts."""
    length = F.col("n_samples") + F.lit(int(rate * gap))
    seconds = lambda n: n / F.lit(float(rate))
    some = sequences.running(plan, id_col, "chunk_no", {"_up_to": length})
    return some.withColumns({"end": seconds(F.col("_up_to")), "start": seconds(F.col("_up_to") - length)}).drop("_up_to")


def chapters(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rendered plan rows: a chapter for each title, to the next one's start or the end of all.
    start_ms and end_ms are cut off, as the chapter file has them."""
    # read several times below
    plan = Scratch(plan.sparkSession).write(plan.select(id_col, "chunk_no", "title", "start", "end"), "chapters")
    some = sequences.totals(plan, id_col, {"_total": F.max("end")})
    marks = sequences.running(some.filter("title is not null"), id_col, "chunk_no", {"_nth": F.lit(1)}).withColumn("chapter", (F.col("_nth") - 1).cast("int"))
    marks = sequences.following(marks, id_col, "chapter", "start", "_next").withColumn("chapter_end", F.coalesce("_next", "_total"))
    ms = lambda c: (F.col(c) * 1000).cast("long")
    return marks.select(id_col, "chapter", "title", "start", F.col("chapter_end").alias("end"), ms("start").alias("start_ms"), ms("chapter_end").alias("end_ms"))


def chapter_file(marks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The text of each document's chapter file."""
    one = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms"), F.lit("\nEND="), F.col("end_ms"), F.lit("\ntitle="), F.col("title"))
    some = F.sort_array(F.collect_list(F.struct("chapter", one.alias("body"))))
    return marks.groupBy(id_col).agg(F.concat(F.lit(";FFMETADATA1\n"), F.array_join(F.transform(some, lambda x: x["body"]), "\n"), F.lit("\n")).alias("metadata"))


def page_sections(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One section for each page, titled by its number."""
    return pages.select(id_col, F.col("page").alias("section"), F.concat(F.lit("Pagina "), F.col("page")).alias("title"), "text")


#: Words that are timed together: a short array's running sums cost little, and need no shuffle.
TIMED = 64


def _milliseconds(x: Column) -> Column:
    """Rounded half up: of the binary value, not of its shortest decimal."""
    return F.floor(x * 1000 + 0.5) / 1000


def _timed_blocks(clips: DataFrame, id_col: str, text_col: str, duration: str, weight) -> DataFrame:
    """Clips cut into blocks: id, duration, n (the clip's words), total, first, before, items, sums (of the
    items before each)."""
    some = clips.filter(F.col(duration) > 0).select(id_col, duration, text.tokens(F.col(text_col)).alias("w"))
    blocks = some.select(id_col, duration, F.size("w").alias("n"), F.explode(sequences.in_blocks(F.col("w"), weight, sequences.ROWS)).alias("b"))
    fine = blocks.select(id_col, duration, "n", "b.total", "b.first", "b.before", F.explode(sequences.in_blocks(F.col("b.items"), weight, TIMED)).alias("c"))
    sums = F.aggregate("c.items", F.array(F.lit(0).cast("long")), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + weight(w))))
    return fine.select(id_col, duration, "n", "total", (F.col("first") + F.col("c.first")).alias("first"), (F.col("before") + F.col("c.before")).alias("before"), "c.items", sums.alias("sums"))


def _weight(min_weight: int):
    return lambda w: F.greatest(F.length(w), F.lit(min_weight)).cast("long")


def aligned_words(clips: DataFrame, id_col: str = "clip_id", text_col: str = "text", duration: str = "duration", min_weight: int = 1) -> DataFrame:
    """Words with start and end in seconds: the duration shared out by length. Within a clip's row, block by block."""
    blocks = _timed_blocks(clips, id_col, text_col, duration, _weight(min_weight))
    words = text.let(F.col("sums"), lambda s: F.transform("items", lambda w, i: F.struct(w.alias("word"), F.get(s, i).alias("from"), F.get(s, i + 1).alias("to"))))
    some = blocks.select(id_col, duration, "n", "total", "first", "before", F.posexplode(words).alias("i", "w"))
    at = lambda n: _milliseconds(F.col(duration) * (F.col("before") + n) / F.col("total"))
    pos = F.col("first") + F.col("i")
    end = F.when(pos == F.col("n") - 1, _milliseconds(F.col(duration))).otherwise(at(F.col("w.to")))
    return some.select(id_col, pos.alias("pos"), "w.word", at(F.col("w.from")).alias("start"), end.alias("end"))


def clip_words_at(clips: DataFrame, probes: DataFrame, id_col: str = "clip_id", text_col: str = "text", duration: str = "duration", min_weight: int = 1) -> DataFrame:
    """words_at of aligned clips: the sort for each clip has a row for a block of words, and the word is found
    within its block."""
    blocks = _timed_blocks(clips, id_col, text_col, duration, _weight(min_weight))
    at = lambda d, before, total: _milliseconds(d * before / total)
    b = F.struct(F.col(duration).alias("duration"), "total", "first", "before", "items")
    kinds = blocks.select(id_col, at(F.col(duration), F.col("before"), F.col("total")).alias("at"), F.lit(0).alias("kind"), b.alias("b"), F.lit(None).cast("long").alias("probe"))
    asked = probes.select(id_col, F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(kinds.schema["b"].dataType).alias("b"), "probe")
    order = Window.partitionBy(id_col).orderBy("at", "kind", F.col("b.first")).rowsBetween(Window.unboundedPreceding, 0)
    found = kinds.unionByName(asked).withColumn("b", F.last("b", ignorenulls=True).over(order)).filter("kind = 1")
    weight, f = _weight(min_weight), F.col("b")
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
    # starts never fall, so the words that have begun are the block's first ones
    begun = F.aggregate(
        f["items"], start, lambda s, w: F.struct((s["sum"] + weight(w)).alias("sum"), (s["n"] + (at(f["duration"], f["before"] + s["sum"], f["total"]) <= F.col("at")).cast("int")).alias("n")), lambda s: s["n"] - 1
    )
    found = found.select(id_col, "probe", F.col("at").alias("t"), f.alias("b"), begun.alias("i"))
    return found.select(id_col, "probe", "t", (F.col("b.first") + F.col("i")).alias("pos"), F.get("b.items", F.col("i")).alias("word"))


def words_at(words: DataFrame, probes: DataFrame, id_col: str = "clip_id") -> DataFrame:
    """Aligned words and probes (id, probe, t): the word sounding at t, the last word past its end,
    none before the first. An as-of join by one sort for each clip, without a range join's pairs."""
    kinds = words.select(id_col, F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("pos", "word").alias("w"), F.lit(None).cast("long").alias("probe"))
    asked = probes.select(id_col, F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<pos:int,word:string>").alias("w"), "probe")
    both = kinds.unionByName(asked)
    order = Window.partitionBy(id_col).orderBy("at", "kind", F.col("w.pos")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("w", ignorenulls=True).over(order)).filter("kind = 1").select(id_col, "probe", F.col("at").alias("t"), "found.pos", "found.word")


def playback_units(rows: DataFrame, id_col: str = "doc_id", size: int = T.UNIT_WORDS) -> DataFrame:
    """Viewer rows (id, seq, sentence, placeholder, failed) to units: id, unit, kind (seg, ocr, skip),
    seq, w0, w1. Short sentences are grouped up to size words; long ones are cut into slices.

    A huge document is cut by many tasks, see sequences.greedy_units."""
    some = rows.select(id_col, "seq", "placeholder", "failed", F.size(text.tokens(F.col("sentence"))).alias("n"))
    kind = F.when(F.col("failed"), "skip").when(F.col("placeholder"), "ocr").otherwise("seg")
    some = some.select(id_col, "seq", "n", kind.alias("kind")).withColumn("alone", (F.col("kind") != "seg") | (F.col("n") > size))
    slices = F.when((F.col("kind") == "seg") & F.col("alone"), F.ceil(F.col("n") / size)).otherwise(1).cast("int")
    # what a row is, in its number of words: -1 and -2 for rows without
    coded = some.select(id_col, "seq", "alone", slices.alias("units"), F.when(F.col("kind") == "skip", -1).when(F.col("kind") == "ocr", -2).otherwise(F.col("n")).alias("n"))
    every = sequences.greedy_units(coded, id_col, size)
    cut = every.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
    spoken = F.col("n") >= 0
    w1 = F.when(spoken, F.least((F.col("k") + 1) * size, F.col("n"))).otherwise(0)
    kind = F.when(spoken, "seg").when(F.col("n") == -1, "skip").otherwise("ocr")
    return cut.select(id_col, (F.col("first") + F.col("k")).cast("int").alias("unit"), kind.alias("kind"), "seq", (F.col("k") * size).cast("int").alias("w0"), w1.cast("int").alias("w1"))


def next_units(units: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each playback unit with the one to fetch while it plays: the next one, if it is spoken."""
    one = units.groupBy(id_col, "unit").agg(F.min("kind").alias("kind"), F.min("seq").alias("seq"))
    after = Window.partitionBy(id_col).orderBy("unit")
    return one.select(id_col, "unit", "kind", "seq", F.when(F.lead("kind").over(after) == "seg", F.lead("unit").over(after)).alias("fetch"))


def page_rows(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pages as an upload's answer has them: id, page, status, sentences."""
    return pages.select(id_col, "page", "status", speech.sentences(F.col("text")).alias("sentences"))


def first_of_pages(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Where each page's own sentences begin in the reader's flat list (viewer rows): id, page, at."""
    order = Window.partitionBy(id_col).orderBy("page", "nth")
    shown = rows.withColumn("at", (F.row_number().over(order) - 1).cast("int")).filter(~F.col("placeholder") & ~F.col("failed"))
    return shown.groupBy(id_col, "page").agg(F.min("at").alias("at"))


def sample(pages: DataFrame, id_col: str = "doc_id", short: int = 70, long: int = 160) -> DataFrame:
    """The start of each page's first sentence, and of its text."""
    return pages.select(id_col, "page", F.left(F.try_element_at(speech.sentences(F.col("text")), F.lit(1)), F.lit(short)).alias("first"), F.left("text", F.lit(long)).alias("start"))


def latency_ratio(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Timed runs (id, eager, fast in seconds): how many times longer the eager way takes, where pages wait."""
    return runs.select(id_col, F.try_divide("eager", "fast").alias("ratio"))


def document_units(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The page view's units: one sentence each, to its end (w1 = -1)."""
    return rows.select(id_col, F.col("seq").alias("unit"), F.lit("seg").alias("kind"), "seq", F.lit(0).alias("w0"), F.lit(-1).alias("w1"))


def overlay_boxes(sentences: DataFrame, geometry: DataFrame) -> DataFrame:
    """Boxes of layout sentences in points of their page (page_index, width, height)."""
    one = sentences.select("*", F.explode("boxes").alias("b"))
    return one.join(geometry, F.col("b.page") == F.col("page_index")).select(
        *[c for c in sentences.columns if c != "boxes"], "page_index", *((F.col(f"b.{c}") * F.col("width" if c[0] == "x" else "height")).alias(c) for c in ("x0", "y0", "x1", "y1"))
    )


def pending_pages(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The numbers of the pages that wait for recognition."""
    return pages.filter("status = 'needs_ocr'").groupBy(id_col).agg(F.sort_array(F.collect_list("page")).alias("pending_pages"))


def accents_kept(text_col: Column) -> Column:
    """How many of the six accented vowels a text holds."""
    return F.size(F.filter(F.array(*map(F.lit, T.VOWELS[5:])), lambda c: text_col.contains(c)))


def control_characters(text_col: Column) -> Column:
    return F.regexp_count(text_col, F.lit(r"[\x00-\x08\x0b-\x1f\x7f]"))


def voices(spark: SparkSession) -> DataFrame:
    """The voices and the default one."""
    return spark.createDataFrame([(v, i == 0) for i, v in enumerate(T.VOICES)], "voice string, is_default boolean")


def engine_info(spark: SparkSession, ocr_available: bool = False, model_state: str = "cold") -> DataFrame:
    """One row: status, version, recogniser, model and voices."""
    from vocalis import __version__

    return spark.range(1).select(
        F.lit("ok").alias("status"), F.lit(__version__).alias("version"), F.lit(ocr_available).alias("ocr_available"), F.lit(model_state).alias("model_state"),
        F.lit(model_state == "ready").alias("model_ready"), F.array(*map(F.lit, T.VOICES)).alias("voices"),
    )


def model_state(events: DataFrame, model: str = "model", order: str = "seq") -> DataFrame:
    """Lifecycle events (model, seq, event: warm, loaded, failed) to states: cold, warming, ready or
    failed. Warming again changes nothing once a model is ready."""
    ever = F.bool_or(F.col("event") == "loaded")
    last = F.max_by("event", order)
    state = F.when(ever, "ready").otherwise(F.when(last == "failed", "failed").when(last == "warm", "warming").otherwise("cold"))
    return events.groupBy(model).agg(state.alias("state"))
