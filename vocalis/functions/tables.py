"""Fixed values of the Italian speech rules, as data. Other languages bring tables of their own."""

from __future__ import annotations

import unicodedata

# --- Fixed values: they must equal the rules' published ones for right results ------------------

#: Words that end in a period without ending a sentence.
ABBREVIATIONS = (
    "sig sigg sig.ra dott dr prof egr gent ing avv rag geom arch on rev ecc es pag pagg art artt cap fig tab vol nr tel vs ca "
    "seg segg gen feb mar apr mag giu lug ago set sett ott nov dic"
).split()
TERMINALS = ".!?…"
CLOSERS = "\"»”'’)]"
APOSTROPHES = "'’ʼ´`"
#: Truncations that keep their apostrophe.
TRUNCATED = "po mo be va da fa sta di to".split()
#: Words in -e that take the acute accent, besides those in -che and -tre.
ACUTE = "ne se merce vicere teste scimpanze".split()
MONTHS = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split()
VOWELS = "aeiouàèéìòù"
#: After a word's apostrophe, besides white space.
AFTER_WORD = r".,;:!?\"»”)\]…"
#: Curly quotes by the plain one, line ends besides the line feed, control characters and combining marks (ranges).
PLAIN_QUOTES = {"'": "‘’‚‛", '"': "“”„‟"}
LINE_ENDS = "\r\u2028\u2029\u0085"
CONTROLS = r"\x00-\x08\x0b\x0e-\x1f\x7f"
INVISIBLE = "­​‌‍⁠﻿"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
NOISE = "|~^`_\\¦•·◦¬"
#: Words whose accented form is the only one in running prose.
ACCENTED = (
    "perché poiché benché affinché finché giacché nonché cosicché sicché purché anziché fuorché dacché macché allorché dopodiché "
    "più già così perciò ciò "
    "città università qualità libertà verità realtà società attività possibilità facoltà velocità difficoltà identità autorità "
    "comunità umanità civiltà novità quantità proprietà maestà virtù gioventù servitù schiavitù "
    "curiosità dignità povertà priorità responsabilità serietà varietà volontà opportunità personalità profondità località "
    "modalità attualità diversità entità fedeltà finalità utilità vanità visibilità generosità pubblicità sincerità eternità "
    "intensità maturità oscurità tranquillità "
    "giù lassù laggiù quaggiù quassù caffè può però"
).split()
#: Tags whose text isn't spoken, and tags that break paragraphs.
SKIPPED_TAGS = "script style head title nav footer aside".split()
BLOCK_TAGS = "p div br li tr section article blockquote figcaption pre h1 h2 h3 h4 h5 h6 hr ul ol table header main".split()
#: Kinds of upload in the order in which they are tested: file extensions and MIME types.
KINDS = {
    "pdf": ([".pdf"], ["application/pdf", "application/x-pdf"]),
    "epub": ([".epub"], ["application/epub+zip", "application/epub", "application/zip"]),
    "html": ([".html", ".htm", ".xhtml"], ["text/html", "application/xhtml+xml", "application/xml", "text/xml"]),
}
FORMATS = {"wav": "audio/wav", "mp3": "audio/mpeg", "m4b": "audio/mp4"}
VOICES = ["if_sara", "im_nicola"]
MIN_TEXT_LAYER = 20
MAX_UPLOAD = 50 * 1024 * 1024
MAX_SPEAK = 20_000
MAX_EXPORT = 500_000
MAX_CHUNK = 1500
LINE_TOLERANCE = 0.012
SAMPLE_RATE = 24_000
GAP_SECONDS = 0.3
UNIT_WORDS = 12
#: What the reader shows for a page, after its number, that waits for recognition or that failed.
WAITS, FAILED = ": in attesa del riconoscimento.", ": nessuna parola riconosciuta."
DOC_TTL, DOC_ITEMS, DOC_BYTES = 30 * 60, 8, 256 * 1024 * 1024
JOB_TTL, JOB_ITEMS = 15 * 60, 16
HEARTBEAT = 15
#: Audio encodings by format: codec, container, bit rate; a chapter file goes into the last.
ENCODINGS = {"wav": ("pcm_s16le", "wav", None), "mp3": ("libmp3lame", "mp3", "64k"), "m4b": ("aac", "mp4", "64k")}

# --- Tables made by rule ------------------------------------------------------------------------


def bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def lexicon() -> dict[str, str]:
    """Bare form to accented form."""
    return {bare(w): w for w in ACCENTED}


def misread() -> dict[str, str]:
    """UTF-8 read as Windows-1252, for Latin-1 letters and signs and common punctuation."""
    out = {}
    for c in map(chr, [*range(0xA0, 0x100), *range(0x2013, 0x2015), *range(0x2018, 0x201F), 0x2022, 0x2026, 0x20AC]):
        wrong = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in c.encode())
        out[wrong] = c
    return out
