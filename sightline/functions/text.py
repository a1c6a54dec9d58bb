"""Vietnamese text functions as columns: normal form, tokens, n-grams.

All but composing (only for texts that hold combining marks) stays in the JVM.
Null gives null for strings and an empty array for lists.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


# Function words, template phrases, and words that frame a query.
STOPWORDS = """
và của có là các một những trong cho được với người khi đã cũng này đó tại về
từ đến trên dưới ra vào theo như thì mà nhưng hoặc bị nên rất sẽ không chưa
https http www com vn youtube youtu be bit ly fb facebook
""".split()
NOISE_PHRASES = ["đăng ký kênh", "đăng ký để xem", "bấm đăng ký", "like và đăng ký", "xem thêm tại", "theo dõi kênh", "mới nhất 2024", "mới nhất 2025"]
QUERY_FRAME_WORDS = """
đoạn clip video phân cảnh tìm cần mô tả thấy hãy khoảnh khắc xác tiên gồm
vài nữa kèm tạo cảm giác nổi bật chính đây đó sau lần lượt khác thêm còn việc
""".split()


def arrow_udf(function):
    """A Python function of one text as an Arrow function of a column; null stays null."""
    import pyarrow as pa

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else function(t) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def _base_letters() -> tuple[str, str]:
    """Composed characters and the single base character that is left of each without its marks."""
    composed, base = [], []
    for cp in [*range(0xC0, 0x2000)]:
        rest = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c) != "Mn")
        if len(rest) == 1 and rest != chr(cp):
            composed.append(chr(cp))
            base.append(rest)
    return "".join([*composed, "đ", "Đ"]), "".join([*base, "d", "D"])


_COMPOSED, _BASE = _base_letters()


def strip_diacritics(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _COMPOSED, _BASE), "\\p{Mn}+", "")


def compose(text: Column) -> Column:
    """NFC; only texts with a combining mark or a character that composing replaces leave the JVM."""
    nfc = arrow_udf(lambda t: unicodedata.normalize("NFC", t))
    return F.coalesce(nfc(F.when(text.rlike("[\\p{M}\\u0340-\\u0345\\u0374\\u037e\\u0387\\u1100-\\u11ff\\u1f71-\\u1ffd\\u2000\\u2001\\u2126\\u212a\\u212b]"), text)), text)


def normalize(text: Column) -> Column:
    """NFC, lower case, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(compose(text)), "(?U)[\\s\\x1c-\\x1f]+", " "))


def _without_noise(text: Column) -> Column:
    for phrase in NOISE_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    return text


def tokens(text: Column, drop_stopwords: bool = True) -> Column:
    """Syllables: runs of letters, digits and underscores, without template phrases and, by default, stop words."""
    found = F.regexp_extract_all(_without_noise(normalize(F.coalesce(text, F.lit("")))), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS)) if drop_stopwords else found


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the text without marks; a shorter text is its own gram, an empty one has none."""
    flat = F.regexp_replace(F.lower(strip_diacritics(F.coalesce(text, F.lit("")))), "(?U)\\s+", " ")
    chars = F.filter(F.split(flat, ""), lambda c: c != "")
    size = F.greatest(F.lit(0), F.size(chars) - (n - 1))
    # Shifted copies side by side: what stands within a lambda is worked out for every element.
    shifted = F.arrays_zip(*(F.slice(chars, k + 1, size) for k in range(n)))
    grams = F.array_distinct(F.transform(shifted, lambda z: F.concat(*(z[str(k)] for k in range(n)))))
    return F.when(size > 0, grams).when(flat != "", F.array(flat)).otherwise(F.array().cast("array<string>"))


def timecode(seconds: Column) -> Column:
    return F.format_string("%02d:%06.3f", F.floor(seconds / 60), seconds - F.floor(seconds / 60) * 60)


def informative(terms: Column) -> Column:
    """Query terms that may tell documents apart: no frame words, no digits, two characters or more."""
    return F.filter(terms, lambda t: ~t.isin(QUERY_FRAME_WORDS) & ~t.rlike("^\\p{N}+$") & (F.length(t) >= 2))
