"""spark-submit entry point: texts to a speech plan.

    python -m vocalis.cli INPUT OUTPUT [--voice V] [--speed S] [--chapters-per-page] [--pdf MODULE:FUNCTION] [--speech MODULE:FUNCTION]

INPUT is a file or folder of UTF-8 texts (form feeds part pages), or - for standard input. OUTPUT is a
folder: plan (Parquet: a row for each chunk to be spoken, with voice and speed) and, with chapters,
chapters (Parquet: the chapter file of each input, of a length of SAMPLES for each character). With a
synthesiser (a function that loads one, see sources.audio.synthesised) there is also audio: a WAV file for
each input, and chapters are of its true length. With a PDF parser (see sources.uploads.pdf_page_texts)
INPUT's PDFs, EPUBs and HTML files are read, each page of theirs a page.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vocalis.functions import tables as T
from vocalis.operators import reading
from vocalis.sources import audio, uploads

#: Samples that a character of speech takes, for estimates before synthesis.
SAMPLES = 1600


def plugged(name: str):
    """The function that MODULE:FUNCTION names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vocalis")
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--voice", default=T.VOICES[0], choices=T.VOICES)
    parser.add_argument("--speed", type=float, default=1.0)
    parser.add_argument("--chapters-per-page", action="store_true")
    parser.add_argument("--pdf", metavar="MODULE:FUNCTION", help="parser of PDF bytes to a list of pages' texts; reads documents instead of texts")
    parser.add_argument("--speech", metavar="MODULE:FUNCTION", help="loader of a synthesiser of text to samples")
    args = parser.parse_args(argv)
    if not 0.5 <= args.speed <= 2.0:
        parser.error("--speed must be from 0.5 to 2.0")
    spark = SparkSession.builder.getOrCreate()
    if args.pdf:
        found = uploads.read_uploads(spark, args.input).withColumns({"filename": F.col("path"), "content_type": F.lit("")})
        pages = uploads.extract(found, plugged(args.pdf)).filter("status = 'ready'").select(F.col("path").alias("doc_id"), "page", "text")
        if not args.chapters_per_page:
            whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n")
            pages = pages.groupBy("doc_id").agg(whole.alias("text")).select("doc_id", F.lit(1).alias("page"), "text")
    else:
        if args.input == "-":
            texts = spark.createDataFrame([("-", sys.stdin.read())], "path string, text string")
        else:
            texts = uploads.read_texts(spark, args.input)
        pages = texts.select(F.col("path").alias("doc_id"), F.posexplode(F.split("text", "\f" if args.chapters_per_page else r"\z")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page"), "text")
    plan = reading.speech_plan(reading.page_sections(pages))
    if args.speech:
        plan = audio.synthesised(plan, plugged(args.speech))
    else:
        plan = plan.withColumn("n_samples", F.length("chunk").cast("long") * SAMPLES)
    plan = plan.withColumns({"voice": F.lit(args.voice), "speed": F.lit(args.speed)})
    plan.write.mode("overwrite").parquet(f"{args.output}/plan")
    plan = spark.read.parquet(f"{args.output}/plan")
    if args.speech:
        audio.write_wav(plan, f"{args.output}/audio")
    marks = reading.chapters(reading.rendered(plan))
    if args.chapters_per_page:
        reading.chapter_file(marks).write.mode("overwrite").parquet(f"{args.output}/chapters")
    total = audio.export_summary(plan, marks).agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("s"), F.sum("megabytes").alias("mb")).first()
    print(f"{total.n} texts planned into {args.output}; as WAV about {total.s or 0:.0f} seconds and {total.mb or 0:.1f} megabytes")


if __name__ == "__main__":
    main()
