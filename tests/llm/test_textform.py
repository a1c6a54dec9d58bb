import re
import unicodedata

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.llm import textform as tf

ALPHABET = "aAđĐÐ ạ́ớệ̛́  ​﻿АаОоскΑΒοｆＵ０！|\n\t\r²①ﬁ бгл"


def test_lookalikes_meet(spark):
    same = ["Đoàn lân đỏ", "Ðoàn lân đỏ", "Đoàn lân​ đỏ", unicodedata.normalize("NFD", "Đoàn lân đỏ"), "Ｄ".replace("Ｄ", "Đ") + "оàn lân đỏ"]
    assert len({tf.consistent_form(t) for t in same}) == 1
    assert tf.consistent_form("ＡＢＣ　１２") == "ABC 12"
    assert tf.consistent_form("СООР") == "COOP" and tf.consistent_form("ΑΒΕΖ") == "ABEZ"


def test_different_stay_different(spark):
    for a, b in [("tải", "tãi"), ("A", "a"), ("0", "O"), ("l", "I"), ("m²", "m2"), ("①", "1"), ("к", "k"), ("d", "đ"), ("rn", "m"), ("a\nb", "a b")]:
        assert tf.consistent_form(a) != tf.consistent_form(b), (a, b)


def test_letters_of_the_published_table(spark):
    """Whole classes of letters, not only those of the nearest scripts; different case, digits and other shapes stay apart."""
    same = {"ꓐ": "B", "Ꮤ": "W", "ⲟ": "o", "ߋ": "ߋ", "𝐀": "A", "ѡ": "w", "Ⲥ": "C", "ᎪᏴ": "AB", "Ӏ": "I", "Ι": "I"}
    assert {a: tf.consistent_form(a) for a in same} == same
    assert len(tf.forms().look_alikes) > 250
    for ch, like in tf.forms().look_alikes.items():
        assert unicodedata.category(ch)[0] == "L" and len(like) == 1 and tf.consistent_form(ch) == like
    for ch in "гσЬЗбктпмзжя":
        assert tf.consistent_form(ch) == ch


@given(st.text(ALPHABET, max_size=30))
def test_form_is_stable(text):
    form = tf.consistent_form(text)
    assert tf.consistent_form(form) == form == unicodedata.normalize("NFC", form)
    assert tf.consistent_form(unicodedata.normalize("NFD", text)) == form
    assert form.count("\n") == text.count("\n")


def test_safe_characters_are_their_own_form(spark):
    safe = [chr(c) for c in range(0x10000) if re.match(f"[{tf.SAFE}]", chr(c))]
    assert len(safe) > 300 and all(unicodedata.normalize("NFC", tf.forms().skeleton(c)) == c for c in safe)


def test_column_equals_function(spark):
    texts = ["", "plain", "Ðoàn", "á", "x" * 100_000 + "Ａ", "dòng\r\nmột", "(!—)", None, "​"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tf.form_column(F.col("t")).alias("f"), tf.words_column(F.col("t")).alias("w")).collect()
    for t, f, w in rows:
        assert f == (None if t is None else tf.consistent_form(t))
        assert w == (None if t is None else re.findall(r"[^\W_]+", tf.consistent_form(t).lower()))
    few = spark.createDataFrame([(t,) for t in texts], "t string").where(tf.is_plain(F.col("t"))).count()
    assert few == 4
