"""Audio sinks: WAV bytes of a waveform, its base64, and a pluggable synthesiser."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalis.functions import tables as T
from vocalis.sources import files
from vocalis.shipping import ship


def wav_bytes(samples: np.ndarray, rate: int = T.SAMPLE_RATE) -> bytes:
    """Mono 16-bit PCM of a waveform in [-1, 1]."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def to_wav(spark: SparkSession, rate: int = T.SAMPLE_RATE) -> Callable[[Column], Column]:
    ship(spark)

    @F.pandas_udf("binary")
    def run(waves: pd.Series) -> pd.Series:
        return waves.map(lambda x: None if x is None else wav_bytes(np.asarray(x), rate))

    return run


def clip_json(audio: Column, words: Column) -> Column:
    """The answer to an aligned clip: base64 audio and its words."""
    return F.to_json(F.struct(F.base64(audio).alias("audio"), words.alias("words")))


def synthesised(chunks: DataFrame, load: Callable[[], Callable[[str], np.ndarray]], text: str = "chunk") -> DataFrame:
    """Chunks through a synthesiser that is loaded once for each Python worker: samples, n_samples."""
    ship(chunks.sparkSession)

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        speak = load()
        for some in texts:
            yield some.map(lambda t: np.asarray(speak(t), np.float32).tolist())

    return chunks.withColumn("samples", run(F.col(text))).withColumn("n_samples", F.size("samples").cast("long"))


def media_type(fmt: Column) -> Column:
    """The MIME type of an export format, null for others."""
    return F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, T.FORMATS)), F.array(*map(F.lit, T.FORMATS.values()))), F.lower(fmt))


def join_audio(chunks: DataFrame, id_col: str = "doc_id", rate: int = T.SAMPLE_RATE, gap: float = T.GAP_SECONDS, more: Sequence[Column] = ()) -> DataFrame:
    """Length of each document's audio, silence after each chunk included: n_samples, duration; and more aggregates."""
    total = F.sum(F.col("n_samples") + F.lit(int(rate * gap)))
    return chunks.groupBy(id_col).agg(total.alias("n_samples"), *more).withColumn("duration", F.col("n_samples") / F.lit(float(rate)))


def wav_header(n_samples: Column, rate: int = T.SAMPLE_RATE) -> Column:
    """The 44 bytes before the samples of a mono 16-bit WAV file."""

    def little(x: Column, width: int) -> Column:
        return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(x.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for i in range(width))))

    size = n_samples * 2
    fixed = [(16, 4), (1, 2), (1, 2), (rate, 4), (rate * 2, 4), (2, 2), (16, 2)]
    word = lambda x: F.encode(F.lit(x), "US-ASCII")
    return F.concat(word("RIFF"), little(size + 36, 4), word("WAVEfmt "), *(little(F.lit(x), w) for x, w in fixed), word("data"), little(size, 4))


def pcm(spark: SparkSession) -> Callable[[Column], Column]:
    """16-bit samples of a waveform in [-1, 1]: a WAV file's bytes after its header."""
    ship(spark)

    @F.pandas_udf("binary")
    def run(waves: pd.Series) -> pd.Series:
        return waves.map(lambda x: (np.clip(np.asarray(x if x is not None else [], np.float64), -1, 1) * 32767).astype("<i2").tobytes())

    return run


def wav_parts(chunks: DataFrame, id_col: str = "doc_id", rate: int = T.SAMPLE_RATE, gap: float = T.GAP_SECONDS) -> DataFrame:
    """Chunks (id, chunk_no, samples) to the parts of a WAV file for each document: file, part, content.
    The header comes first, and silence follows each chunk."""
    silence = int(rate * gap)
    name = F.concat(F.url_encode(F.col(id_col).cast("string")), F.lit(".wav"))
    length = F.sum(F.coalesce(F.size("samples"), F.lit(0)).cast("long") + silence)
    headers = chunks.groupBy(id_col).agg(length.alias("n")).select(name.alias("file"), F.lit(-1).cast("long").alias("part"), wav_header(F.col("n"), rate).alias("content"))
    quiet = F.unhex(F.repeat(F.lit("00"), 2 * silence))
    bodies = chunks.select(name.alias("file"), F.col("chunk_no").cast("long").alias("part"), pcm(chunks.sparkSession)(F.col("samples")).alias("content"))
    return headers.unionByName(bodies.withColumn("content", F.concat("content", quiet)))


def write_wav(chunks: DataFrame, path: str, id_col: str = "doc_id", rate: int = T.SAMPLE_RATE, gap: float = T.GAP_SECONDS) -> None:
    """One WAV file for each document below path, named by its id. Chunks stream through the task that
    writes their file; a job that fails leaves no file."""
    files.write_parts(wav_parts(chunks, id_col, rate, gap), path)


def encoding(fmt: Column, has_chapters: Column) -> Column:
    """How an export format is encoded: codec, container, bitrate and whether a chapter file goes along;
    null for formats that aren't offered."""
    out = F.when(F.lit(False), F.lit(None))
    for name, (codec, container, bitrate) in T.ENCODINGS.items():
        value = F.struct(F.lit(codec).alias("codec"), F.lit(container).alias("container"), F.lit(bitrate).cast("string").alias("bitrate"), (F.lit(name == "m4b") & has_chapters).alias("chapters"))
        out = F.when(F.lower(fmt) == name, value).otherwise(out)
    return out


def export_summary(plan: DataFrame, marks: DataFrame, id_col: str = "doc_id", rate: int = T.SAMPLE_RATE) -> DataFrame:
    """What an export tells at its end: seconds, megabytes as WAV, chunks and chapters."""
    length = join_audio(plan, id_col, rate, more=[F.count(F.lit(1)).alias("n_chunks")])
    titles = marks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_chapters"))
    both = length.join(titles, id_col, "left")
    return both.select(id_col, F.round("duration", 1).alias("seconds"), F.round((F.col("n_samples") * 2 + 44) / 1e6, 1).alias("megabytes"), "n_chunks", F.coalesce("n_chapters", F.lit(0)).alias("n_chapters"))
