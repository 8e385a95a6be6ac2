"""UTF-8 that was read as a single-byte code page, once or several times over, undone by a scored search.

Whatever the page, bytes from 0x80 up become characters beyond ASCII, so what was misread stands in runs of
such characters. For each page a run is read back: characters to bytes to UTF-8. A reading counts if all of
the run but typographic signs is used up and if it costs less than the run as it stands: rare characters
cost more than letters, and so do pairs of neighbours that writing doesn't make, such as a small letter
before a capital one beyond ASCII. The page whose readings save most over the whole text is applied, all but the readings that cost more, and the
search begins again until nothing is saved, so a text misread twice is read back twice.

Texts in which no page has a lead character before a following one stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Code pages tried, in this order on a tie. The first stands for Latin-1 and Windows-1252 at once.
PAGES = ("cp1252", "iso8859-2", "cp1250", "cp1251", "koi8-r", "mac-roman", "cp437")
ROUNDS = 6
#: Signs that writers put beside letters; a run may hold them besides what was misread.
TYPOGRAPHIC = "“”‘’‚„«»–—…•·€°"
#: Ranges of signs that stand in texts of any script: punctuation, symbols, arrows, CJK signs, forms of signs, emoji.
SIGNS = ((0x2000, 0x2BFF), (0x2E00, 0x2E7F), (0x3000, 0x303F), (0x3099, 0x309C), (0xFE00, 0xFFEF), (0x1F000, 0x1FAFF))


def shown(data: bytes, page: str) -> str:
    """Bytes as a reader of the page shows them, those that it leaves open as control characters."""
    return re.sub("[\udc80-\udcff]", lambda m: chr(ord(m[0]) - 0xDC00), data.decode(page, "surrogateescape"))


@cache
def bytes_of(page: str) -> dict[str, int]:
    """Character to byte from 0x80 up. A byte that the page leaves open is the control character of its number."""
    out = {shown(bytes([b]), page): b for b in range(0x80, 0x100)}
    if page == "cp1252":  # read by a strict reader, the same bytes are control characters
        out |= {chr(b): b for b in range(0x80, 0xA0)}
    return out


def _class(some: dict[str, int], low: int, high: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in some.items() if low <= b <= high) + "]"


def sequences(page: str) -> str:
    """A pattern for a UTF-8 character of two to four bytes as the page shows it."""
    some = bytes_of(page)
    more = _class(some, 0x80, 0xBF)
    return "|".join(_class(some, a, b) + more * n for a, b, n in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3)))


@cache
def _patterns(page: str) -> tuple[re.Pattern, re.Pattern]:
    """A whole run as a reading, and one character of it."""
    one = sequences(page)
    return re.compile(f"(?:{one}|[{TYPOGRAPHIC}])+"), re.compile(one)


def suspect() -> str:
    """A pattern, for the JVM, of a lead character before a following one in any page."""
    wide = lambda c: f"\\x{{{ord(c):x}}}"
    part = lambda p, a, b: "[" + "".join(wide(c) for c, x in bytes_of(p).items() if a <= x <= b) + "]"
    return "|".join(part(p, 0xC2, 0xF4) + part(p, 0x80, 0xBF) for p in PAGES)


@cache
def _kind(c: str) -> tuple[str, float]:
    """Script and case of a letter, or sign; and its cost."""
    n, category = ord(c), unicodedata.category(c)
    if n < 0x80:
        return ("latin lower" if c.islower() else "latin upper" if c.isupper() else "ascii"), 0.0
    if c in TYPOGRAPHIC:
        return "typographic", 1.0
    if category[0] == "L":
        script = unicodedata.name(c, "?").split(" ")[0].lower()
        common = n < 0x250 or 0x386 <= n <= 0x3CE or 0x401 <= n <= 0x45F or n >= 0x5D0 and category == "Lo"
        case = "lower" if category == "Ll" else "upper" if category == "Lu" else ""
        # three letters aren't misread for being one letter of three bytes
        return f"{script} {case}", 6.0 if not common else 1.0 if n < 0x800 else 3.0
    if category in ("Cc", "Cn", "Co", "Cs"):
        return "odd", 4.0
    if n < 0x370 or any(low <= n <= high for low, high in SIGNS):
        return "sign", 2.0
    if category[0] in "MNP":  # a script's marks, digits and punctuation are as its letters
        return re.split("[ -]", unicodedata.name(c, "?"))[0].lower() + " ", 2.0 if n < 0x800 else 3.0
    return "sign", 6.0


@cache
def _beside(a: str, b: str) -> float:
    """What it costs that b follows a."""
    if ord(a) < 0x80 and ord(b) < 0x80:
        return 0.0
    (x, _), (y, _) = _kind(a), _kind(b)
    letters = [k.split(" ") for k in (x, y) if " " in k]
    if len(letters) == 2:
        (script, case), (script2, case2) = letters
        return 3.0 if script != script2 else 2.0 if case == "lower" and case2 == "upper" else 0.0
    if " " in x and ord(a) >= 0x80 and y in ("sign", "typographic"):
        return 2.0 if y == "sign" or x.endswith("upper") else 0.5
    return 0.0


def cost(text: str) -> float:
    return sum(_kind(c)[1] for c in text) + sum(map(_beside, text, text[1:]))


_RUN = re.compile(r"[^\x00-\x7f]+")


def _read_back(text: str, page: str) -> tuple[str, float]:
    """text with the page's readings, and what they save."""
    whole, one = _patterns(page)
    values, saved = bytes_of(page), 0.0

    def character(m: re.Match) -> str:
        try:
            return bytes(values[c] for c in m[0]).decode()
        except UnicodeDecodeError:
            return m[0]

    def run(m: re.Match) -> str:
        nonlocal saved
        if not whole.fullmatch(m[0]):
            return m[0]
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        new = one.sub(character, m[0])
        less = cost(before + m[0] + after) - cost(before + new + after)
        if new == m[0] or less < 0:  # one that saves nothing goes along with others
            return m[0]
        saved += less
        return new

    return _RUN.sub(run, text), saved


def undo(text: str) -> str:
    """The text read back, as often as that makes it cheaper."""
    for _ in range(ROUNDS):
        best = max((_read_back(text, p) for p in PAGES), key=lambda x: x[1])
        if best[1] <= 0:
            break
        text = best[0]
    return text


@F.pandas_udf(StringType())
def _undo_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else undo(t))


def undone(text: Column) -> Column:
    """The text read back. Only texts that may have been misread go through Python, the others as nulls;
    needs the package shipped (shipping.ship), and can't stand inside a lambda function."""
    return F.coalesce(_undo_udf(F.when(text.rlike(suspect()), text)), text)
