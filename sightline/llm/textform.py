"""One consistent form for text that looks alike but is stored differently.

``Forms.skeleton`` decomposes a text, replaces every character by the prototype of
its look-alike class and decomposes again; ``Forms.consistent`` composes that
skeleton.  Case, accents, tabs and line ends stay as they are.

Prototypes come from the published confusables data, which Spark brings along with
ICU: a letter of another script stands for the single Latin letter that the data
give it.  The data also put together what looks different here (I, l and 1; O and
0; capitals and small letters; sigma and o), so only letters of the same case count
and DIFFERENT lists exceptions.  Width and presentation variants come from the
compatibility mappings of Unicode.

The work is done in Python (Spark has no normaliser), but only for texts that hold a
character outside ``SAFE``: over that alphabet the form is the identity, so a JVM
regular expression keeps all other texts out of the Arrow stream.

Null stays null; the empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import arrow_udf

# Letters that the published data hold for like a Latin letter although they are told apart at sight.
DIFFERENT = "гσ"
# Letters like Latin ones that the published data lack, script variants of Latin letters, and those that look like the Vietnamese D with stroke.
MORE_FROM = "ҺԚɑɡÐƉ"
MORE_TO = "HQagĐĐ"

#: Compatibility mappings that are only another width or presentation.  Super- and
#: subscripts, circled characters and fractions look different and stay.
PRESENTATION = ("<wide>", "<narrow>", "<small>", "<font>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")

#: Characters that show nothing although they are not format characters.
BLANK = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2065, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

#: Over these characters alone a text is in consistent form already: ASCII,
#: composed Latin letters without look-alikes, and common punctuation.
#: Few ranges, the commonest first: the JVM tests them one by one.
SAFE = (
    "\\x20-\\x7e\\t\\n\\r\\xa9\\xab\\xb0\\xb1\\xb7\\xbb\\u00c0-\\u00cf\\u00d1-\\u0131\\u0150-\\u017e\\u01a0-\\u01b0"
    "\\u1ea0-\\u1ef9\\u2012-\\u2022"
)

#: After decomposition, anything but plain characters and accents may have a prototype.
_ODD = re.compile(f"[^{SAFE}\\u0300-\\u033f]")
_PLAIN = re.compile(f"[^{SAFE}]")


class _Prototypes(dict):
    """Code point -> what stands for it in a skeleton, worked out on first use."""

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cf" or cp in BLANK or (kind == "Cc" and ch not in "\t\n\r"):
            out = ""
        elif kind in ("Zs", "Zl", "Zp"):
            out = " "
        else:
            out = ch
            mapping = unicodedata.decomposition(ch)
            if mapping.startswith(PRESENTATION):
                plain = unicodedata.normalize("NFKD", ch)
                if " " not in plain:
                    out = "".join(self[ord(c)] for c in plain)
        self[cp] = out
        return out


class Forms:
    """Skeletons and consistent forms by one table of look-alikes (letter -> Latin letter), a few thousand entries at most."""

    def __init__(self, look_alikes: dict[str, str]):
        self.look_alikes = look_alikes
        self.prototypes = _Prototypes({ord(a): b for a, b in look_alikes.items()})

    def __reduce__(self):
        return Forms, (self.look_alikes,)

    def skeleton(self, text: str) -> str:
        """Decomposed look-alike prototype of ``text``: equal for equal-looking texts."""
        replaced = _ODD.sub(lambda m: self.prototypes[ord(m[0])], unicodedata.normalize("NFD", text))
        return unicodedata.normalize("NFD", replaced)

    def consistent(self, text: str) -> str:
        """The skeleton with its accents composed."""
        return text if _PLAIN.search(text) is None else unicodedata.normalize("NFC", self.skeleton(text))


def look_alikes(published: dict[str, str]) -> dict[str, str]:
    """Letters of other scripts that look like a Latin letter of their case, from published skeletons of single letters."""
    out = dict(zip(MORE_FROM, MORE_TO, strict=True))
    for ch, like in published.items():
        kind = unicodedata.category(ch)
        if kind == "Lu" and like == "l":
            like = "I"  # one published class; a capital is the capital
        other_case = (kind == "Lu" and not like.isupper()) or (kind == "Ll" and not like.islower())
        if len(like) == 1 and like.isascii() and like.isalpha() and not other_case and ch not in DIFFERENT:
            out.setdefault(ch, like)
    return out


def published_skeletons(spark: SparkSession) -> dict[str, str]:
    """The published skeleton of every letter that is not Latin and not composed, all by one call on the driver."""
    letters = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c)[0] == "L" and not unicodedata.decomposition(c) and "LATIN" not in unicodedata.name(c, "LATIN")]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    return dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True))


@cache
def forms() -> Forms:
    """The forms by the data of the running session's Spark; the table goes to the executors with the functions that use it."""
    return Forms(look_alikes(published_skeletons(SparkSession.builder.getOrCreate())))


def consistent_form(text: str) -> str:
    return forms().consistent(text)


def is_plain(text: Column) -> Column:
    """True where the text holds only characters for which the form is the identity."""
    return text.rlike(f"\\A[{SAFE}]*+\\z")


def form_column(text: Column) -> Column:
    """``consistent_form`` as a column; only texts that are not plain leave the JVM."""
    return F.coalesce(arrow_udf(forms().consistent)(F.when(~is_plain(text), text)), text)


def words_of_form(form: Column) -> Column:
    """Array of maximal runs of letters and digits of an already consistent text, in lower case."""
    return F.regexp_extract_all(F.lower(form), F.lit("([\\p{L}\\p{Nd}]+)"), F.lit(1))


def words_column(text: Column) -> Column:
    """``words_of_form`` of any text."""
    return words_of_form(form_column(text))
