"""Per-document text quality: statistics, and a classifier of prose against lists, tables and junk.

The statistics are taken over the whole text in consistent form, in one pass.  The
classifier is gradient-boosted trees on them, trained on weakly labelled documents
(annotators err and disagree); its score is calibrated by a logistic fit on a
holdout, documents on which two annotators agree: nothing here is checked by hand,
and two judges of one mind come closest.  What is left of them tells how well the
probabilities hold (``calibration``).

Null and empty texts have zero statistics and are not prose, but no case either:
``not_prose`` leaves them out, as nothing of them is a list, a table or junk.
A document delivered more than once comes out once; where its deliveries differ,
the greatest statistics count, and the delivery that is least like prose.
"""

from __future__ import annotations

import math
import re
import zipfile
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.find_spark_home import _find_spark_home
from pyspark.sql import functions as F

from sightline.llm.textform import forms
from sightline.operators.versions import latest
from sightline.session import cut

# Function words of Vietnamese (pronouns, particles, prepositions, conjunctions, aspect and measure words).  The English ones come with Spark.
COMMON_VI = """
tôi ta mình anh chị em ông bà nó họ chúng ai gì nào đâu sao này đó kia ấy đây
là có không chưa đã đang sẽ vừa mới còn vẫn cũng đều chỉ rất quá lắm hơn nhất nữa rồi
và với hay hoặc nhưng mà thì nên vì do bởi nếu khi tuy để cho của bằng về từ đến tới tại ở trong ngoài trên dưới trước sau giữa bên qua theo như
các những mọi mỗi một hai nhiều ít vài được bị phải ra vào lên xuống lại đi cái con chiếc người việc
""".split()

#: Bound on the labelled documents that the trees are fitted on, and on those that calibrate them.
TRAIN_DOCS = 20_000
CALIBRATION_DOCS = 20_000
TREES, DEPTH, LEAST_IN_LEAF, SEED = 30, 3, 10, 7
#: Share of the agreed documents that is held out.
HOLDOUT = 0.5

STATISTICS = ["words", "mean_word_length", "symbol_share", "punctuated_line_share", "common_word_share"]
FEATURES = [
    "mean_word_length", "symbol_share", "digit_share", "punctuated_line_share", "common_word_share", "distinct_share", "capital_share", "words_per_line",
    "short_share", "bullet_share", "ruled_share", "structured_share", "separator_rate", "tag_rate", "sentence_rate", "hash_rate",
]
_COLUMNS = ["words", *dict.fromkeys([*STATISTICS[1:], *FEATURES])]

_DIGIT, _SYMBOL = re.compile(r"\d"), re.compile(r"[^\w\s]|_")
_BULLET = re.compile(r"\s*(?:[-*•▶+>·]|\d{1,3}[.):])\s*\S")
_TAG, _SENTENCE = re.compile(r"<[^<>\n]{1,80}>"), re.compile(r"\w\w[.!?…](?=\s|$)")
_CLOSERS = "\"”»)]' \t\r"


def measure(text: str, common: frozenset[str]) -> tuple:
    """The values of ``words`` and of all statistics and features of one text in consistent form, in the order of _COLUMNS."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return (0, *[0.0] * (len(_COLUMNS) - 1))
    inked, chars = sum(map(len, words)), len(text)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    ended = short = bullet = ruled = structured = 0
    for line in lines:
        body = line.rstrip(_CLOSERS)
        sentence = body[-1:] in ".!?…" if body else False
        ended += sentence
        size = len(line)
        is_bullet = _BULLET.match(line) is not None
        is_ruled = line.count("|") > 1 or line.count("\t") > 1 or line.count(";") > 1 or (line.count(",") > 2 and not sentence and line.count(",") * 8 > len(line.split()))
        is_short = size < 60 and not sentence and len(line.split()) <= 4
        bullet, ruled, short = bullet + size * is_bullet, ruled + size * is_ruled, short + size * is_short
        structured += size * (is_bullet or is_ruled or is_short)
    total = sum(map(len, lines))
    separators = text.count(",") + text.count("|") + text.count("\t") + text.count(";")
    return (
        n, inked / n, len(_SYMBOL.findall(text)) / chars, ended / len(lines), sum(map(common.__contains__, words)) / n,
        len(_DIGIT.findall(text)) / chars, len(set(words)) / n, sum(w[0].isupper() for w in text.split()) / n, n / len(lines),
        short / total, bullet / total, ruled / total, structured / total, separators / n, len(_TAG.findall(text)) / n, len(_SENTENCE.findall(text)) / n, text.count("#") / n,
    )


@cache
def english_words() -> tuple[str, ...]:
    """The English stop words that Spark brings along, read from its library on the driver."""
    for jar in sorted(Path(_find_spark_home()).glob("jars/spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            return tuple(z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split())
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def common_words() -> frozenset[str]:
    """Function words of the two languages."""
    return frozenset([*english_words(), *COMMON_VI])


def _measurer(names: list[str], common: frozenset[str], consistent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(consistent(t), common) for t in b["text"].to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.int64() if k == "words" else pa.float64()) for k, c in zip(names, columns, strict=True))], names=["doc_id", *names])

    return run


def _measured(documents: DataFrame) -> DataFrame:
    """(doc_id, words, statistics, features) in one pass, no shuffle; measured in Python, which is several times faster here than regular expressions in the JVM."""
    texts = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_measurer(_COLUMNS, common_words(), forms().consistent), "doc_id long, words long, " + ", ".join(f"{c} double" for c in _COLUMNS[1:]))


def statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_share, punctuated_line_share, common_word_share) of every document."""
    return latest(_measured(documents).select("doc_id", *STATISTICS), "doc_id", F.struct(*STATISTICS))


def weak_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label, agreed): 1 where the annotations say list, table or junk; documents with a tie are left out."""
    bad = (F.col("kind") != "prose").cast("int")
    votes = labels.where(F.col("doc_id").isNotNull() & F.col("kind").isNotNull()).select("doc_id", "annotator", bad.alias("bad")).distinct().groupBy("doc_id").agg(F.avg("bad").alias("share"), F.count("*").alias("n"))
    return votes.where("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("double").alias("label"), ((F.col("n") > 1) & F.col("share").isin(0.0, 1.0)).alias("agreed"))


class ProseModel:
    """Boosted trees with a calibrated score: the probability that a document is not prose."""

    def __init__(self, trees, slope: float, offset: float):
        self.trees, self.slope, self.offset = trees, slope, offset

    @classmethod
    def fit(cls, documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> ProseModel | None:
        """None where the labels know one class only."""
        from pyspark.ml.classification import GBTClassifier

        lottery = F.xxhash64(F.lit(SEED), F.col("doc_id"))
        known = weak_labels(labels).withColumn("lot", lottery)
        held = F.col("agreed") & (F.pmod(F.shiftright("lot", 7), F.lit(1000)) < HOLDOUT * 1000)
        chosen = known.where(~held).orderBy("lot").limit(train_docs).withColumn("use", F.lit("train")).unionByName(known.where(held).orderBy("lot").limit(2 * calibration_docs).withColumn("use", F.when(F.col("lot") % 2 == 0, "hold").otherwise("check")))
        # At most train_docs + 2 * calibration_docs rows of an id and a label: a bounded broadcast.
        measured = latest(_measured(documents.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text")), "doc_id", F.struct(*_COLUMNS))
        rows = cut(measured.join(F.broadcast(chosen), "doc_id"))
        train = rows.where("use = 'train'")
        if train.select("label").distinct().count() < 2:
            return None
        few = _vector(train).select("features", "label").coalesce(4)
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.2, subsamplingRate=0.8, seed=SEED, minInstancesPerNode=LEAST_IN_LEAF).fit(few)
        slope, offset = _calibrate([(r["m"], r["label"]) for r in cls(trees, 1.0, 0.0).margins(rows.where("use = 'hold'"), "label").collect()])
        model = cls(trees, slope, offset)
        model.checked = rows.where("use = 'check'")
        return model

    def save(self, path: str) -> None:
        """Write the model to a folder, so that it need not be fitted for every run."""
        self.trees.write().overwrite().save(f"{path}/trees")
        SparkSession.active().createDataFrame([(self.slope, self.offset)], "slope double, offset double").coalesce(1).write.mode("overwrite").parquet(f"{path}/calibration")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ProseModel:
        from pyspark.ml.classification import GBTClassificationModel

        of = spark.read.parquet(f"{path}/calibration").first()
        return cls(GBTClassificationModel.load(f"{path}/trees"), of["slope"], of["offset"])

    def calibration(self, bins: int = 10) -> DataFrame:
        """(bin, documents, predicted, observed) over agreed documents that neither the trees nor the calibration have seen."""
        scored = self.score(self.checked, "label").withColumn("bin", F.least(F.floor(F.col("not_prose") * bins), F.lit(bins - 1)).cast("int"))
        return scored.groupBy("bin").agg(F.count("*").alias("documents"), F.avg("not_prose").alias("predicted"), F.avg("label").alias("observed"))

    def margins(self, measured: DataFrame, *keep: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        scored = self.trees.transform(_vector(measured))
        return scored.select(*keep, F.element_at(vector_to_array("rawPrediction"), 2).alias("m"))

    def score(self, measured: DataFrame, *keep: str) -> DataFrame:
        """``keep`` and not_prose, the calibrated probability."""
        return self.margins(measured, *keep).withColumn("not_prose", 1 / (1 + F.exp(-(F.lit(self.slope) * F.col("m") + F.lit(self.offset))))).drop("m")


def _vector(measured: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(measured)


def _calibrate(points: list[tuple[float, float]], steps: int = 50) -> tuple[float, float]:
    """Logistic slope and offset of the margin by Newton steps, slightly smoothed; (2, 0), the trees' own link, without both classes."""
    pos = sum(y for _, y in points)
    if not 0 < pos < len(points):
        return 2.0, 0.0
    high, low = (pos + 1) / (pos + 2), 1 / (len(points) - pos + 2)
    a, b = 2.0, 0.0
    for _ in range(steps):
        ga = gb = 0.0
        haa = hab = hbb = 1e-6
        for m, y in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * m + b))))
            d, w = (high if y else low) - p, p * (1 - p)
            ga, gb, haa, hab, hbb = ga + d * m, gb + d, haa + w * m * m, hab + w * m, hbb + w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a + da / size, b + db / size
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def not_prose(documents: DataFrame, labels: DataFrame, least: float = 0.5, model: ProseModel | None = None) -> DataFrame:
    """(doc_id, not_prose) of the documents that are mostly a list, a table or junk; a model that is there is not fitted again."""
    model = model or ProseModel.fit(documents, labels)
    if model is None:
        return documents.select("doc_id", F.lit(0.0).alias("not_prose")).where("false")
    found = model.score(_measured(documents).where("words > 0"), "doc_id").where(F.col("not_prose") >= least)
    return found.groupBy("doc_id").agg(F.max("not_prose").alias("not_prose"))
