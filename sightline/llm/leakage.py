"""Evaluation texts leaking into training text.

The held-out items form a BM25 inverted index whose postings are kept in blocks of
items with each block's greatest impact per term.  A training document is read as
passages, its stretches of indexed words, and every run of ``words`` words in them is
a query.  The block maxima are summed first (a WAND bound): only blocks whose bound
reaches the block's threshold are opened, and only items whose BM25 score reaches the
item's threshold are retrieved.  An item's threshold is the least score that any of
its own runs has, so none can be missed.  Retrieved runs are verified word by word.

``leaked_items`` tells which items a document holds, ``overlaps`` also how much of an
item's body and of its question.

Words are maximal runs of letters and digits in consistent form and lower case.
Null and empty texts match nothing.  Items of fewer than ``words`` words match
nothing by default; with ``least_words`` those of at least so many words match where
they stand as a whole.  Documents may repeat; each (document, item) comes out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.textform import form_column
from sightline.session import cut

WORDS = 12
#: Impacts that are laid out at once for a passage.
CELLS = 1 << 21
BLOCK = 16
#: Characters of item text that one broadcast index may hold; more items are taken in several passes over the formed words.
#: Postings, impacts and runs take about 20 bytes a character then: at most some 80 MB.
INDEX_CHARS = 4_000_000
#: Words of a document handled at once, so that a very long text needs no more memory.
SEGMENT = 1 << 14
K1, B = 1.2, 0.75
_FACTOR, _ITEM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _windows(codes: np.ndarray, words: int) -> np.ndarray:
    """A 64-bit hash of every ``words`` consecutive codes."""
    power = _FACTOR ** np.arange(words, dtype=np.uint64)
    return (np.lib.stride_tricks.sliding_window_view(codes.astype(np.uint64) + np.uint64(1), words) * power).sum(1, dtype=np.uint64)


class ItemIndex:
    """Impacts of terms in items, in blocks of items, with thresholds."""

    def __init__(self, ids: list[int], texts: list[list[str]], words: int = WORDS):
        self.words = words
        use = [k for k, t in enumerate(texts) if len(t) >= words]
        self.ids = np.array([ids[k] for k in use], np.int64)
        self.vocabulary: dict[str, int] = {}
        coded = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in texts[k]], np.int32) for k in use]
        n, v = len(coded), len(self.vocabulary) + 1
        self.blocks = max(1, -(-n // BLOCK))
        length = np.array([len(t) for t in coded], np.float64)
        item, term = np.repeat(np.arange(n), length.astype(int)), np.concatenate([np.zeros(0, np.int64), *coded]).astype(np.int64)
        pair, tf = np.unique(item * v + term, return_counts=True)
        item, term = pair // v, pair % v
        df = np.bincount(term, minlength=v)
        norm = K1 * (1 - B + B * length / max(float(length.mean()) if n else 1.0, 1e-9))
        impact = (np.log(1 + (n - df + 0.5) / (df + 0.5))[term] * tf * (K1 + 1) / (tf + norm[item])).astype(np.float32)
        ends = np.searchsorted(pair, np.arange(n + 1) * v)
        least = np.zeros(n)
        for k, t in enumerate(coded):
            own = impact[ends[k] : ends[k + 1]][np.searchsorted(term[ends[k] : ends[k + 1]], t)]
            least[k] = np.lib.stride_tricks.sliding_window_view(own, words).sum(1).min() * 0.999
        # Items of like threshold share a block, so that one low threshold does not open many others.
        order = np.argsort(least, kind="stable")
        place = np.argsort(order)
        self.ids, self.coded = self.ids[order], [coded[k] for k in order]
        self.threshold = np.full(self.blocks * BLOCK, np.inf)
        self.threshold[:n] = least[order]
        self.block_threshold = self.threshold.reshape(self.blocks, BLOCK).min(1)
        # Postings: one cell of BLOCK impacts per (term, block) that occurs, in order of term and block.
        self.cells, where = np.unique(term * self.blocks + place[item] // BLOCK, return_inverse=True)
        self.impacts = np.zeros((len(self.cells) + 1, BLOCK), np.float32)
        self.impacts[where, place[item] % BLOCK] = impact
        self.cell_max = self.impacts.max(1)
        # Block maxima as a table where that is small; else they are looked up by posting.
        self.table = None
        if v * self.blocks <= 2 * CELLS:
            self.table = np.zeros((v, self.blocks), np.float32)
            self.table.ravel()[self.cells] = self.cell_max[:-1]
        self.term_cells = np.searchsorted(self.cells, np.arange(v + 1) * self.blocks)
        # Where each run of an item stands in it, by a hash of run and item.
        count = [len(t) - words + 1 for t in self.coded]
        keys = np.concatenate([np.zeros(0, np.uint64), *(_windows(t, words) + np.array([k], np.uint64) * _ITEM for k, t in enumerate(self.coded))])
        sort = np.argsort(keys, kind="stable")
        self.run_keys = keys[sort]
        self.run_item = np.repeat(np.arange(n, dtype=np.int32), count)[sort]
        self.run_at = np.concatenate([np.zeros(0, np.int32), *(np.arange(c, dtype=np.int32) for c in count)])[sort]

    def rows(self, passage: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Impact of each word of a passage on each item of the given blocks."""
        key = passage.astype(np.int64)[:, None] * self.blocks + blocks
        at = np.minimum(np.searchsorted(self.cells, key), len(self.cells) - 1)
        return self.impacts[np.where(self.cells[at] == key, at, len(self.cells))].reshape(len(passage), -1)

    def _sums(self, rows: np.ndarray) -> np.ndarray:
        """Sums of every ``words`` consecutive rows."""
        total = np.zeros((len(rows) + 1, rows.shape[1]))
        np.cumsum(rows, 0, dtype=np.float64, out=total[1:])
        return total[self.words :] - total[: -self.words]

    def opened(self, codes: np.ndarray) -> np.ndarray:
        """Blocks of which a run of the passage reaches the bound, by the block maxima of its words' postings."""
        if self.table is not None:
            return np.flatnonzero((self._sums(self.table[codes]) >= self.block_threshold).any(0))
        start, end = self.term_cells[codes], self.term_cells[codes + 1]
        size = end - start
        cell = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        row, block = np.repeat(np.arange(len(codes)), size), self.cells[cell] % self.blocks
        out, step = [], max(1, CELLS // len(codes))
        for at in range(0, self.blocks, step):
            some = (block >= at) & (block < at + step) if step < self.blocks else slice(None)
            dense = np.zeros((len(codes), min(step, self.blocks - at)), np.float32)
            dense[row[some], block[some] - at] = self.cell_max[cell[some]]
            out.append(at + np.flatnonzero((self._sums(dense) >= self.block_threshold[at : at + step]).any(0)))
        return np.concatenate(out)

    def find(self, text: list[str]) -> dict[int, set[int]]:
        """Positions of the items of which ``text`` holds ``words`` consecutive words, and where in the item those stand."""
        found: dict[int, set[int]] = {}
        get = self.vocabulary.get
        for start in range(0, max(1, len(text) - self.words + 1), SEGMENT):
            codes = np.array([get(w, 0) for w in text[start : start + SEGMENT + self.words - 1]], np.int32)
            # A passage is a stretch of indexed words; a shorter one than `words` can hold no run.
            known = np.r_[False, codes > 0, False]
            edges = np.flatnonzero(known[1:] != known[:-1])
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= self.words:
                    self._passage(codes[a:b], found)
        return found

    def _passage(self, codes: np.ndarray, found: dict[int, set[int]]) -> None:
        blocks, hashes = self.opened(codes), None
        step = max(1, CELLS // (len(codes) * BLOCK))
        for at in range(0, len(blocks), step):
            some = blocks[at : at + step]
            items = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            start, column = np.nonzero(self._sums(self.rows(codes, some)) >= self.threshold[items])
            if len(start) and hashes is None:
                hashes = _windows(codes, self.words)
            if not len(start):
                continue
            wanted = hashes[start] + items[column].astype(np.uint64) * _ITEM
            place = np.searchsorted(self.run_keys, wanted)
            hit = np.flatnonzero(self.run_keys[np.minimum(place, len(self.run_keys) - 1)] == wanted)
            for k, key, at in zip(start[hit].tolist(), wanted[hit], place[hit].tolist(), strict=True):
                while at < len(self.run_keys) and self.run_keys[at] == key:
                    item, p = int(self.run_item[at]), int(self.run_at[at])
                    if (self.coded[item][p : p + self.words] == codes[k : k + self.words]).all():
                        found.setdefault(item, set()).add(p)
                    at += 1


def _words(text) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(form_column(text)), "[^\\p{L}\\p{Nd}]+", " "))


def _search(shared):
    """(doc_id, item_id, begins, words): where the runs that a document shares with an item begin in it, and their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, items, begins, sizes = [], [], [], []
            for key, text in zip(b["doc_id"].to_pylist(), b["words"].to_pylist(), strict=True):
                split = text.split(" ")
                for own in shared.value:
                    for k, at in own.find(split).items():
                        docs.append(key)
                        items.append(int(own.ids[k]))
                        begins.append(sorted(at))
                        sizes.append(own.words)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(begins, pa.list_(pa.int32())), pa.array(sizes, pa.int32())], names=["doc_id", "item_id", "begins", "words"])

    return run


def shared_runs(documents: DataFrame, items: DataFrame, words: int = WORDS, index_chars: int = INDEX_CHARS, least_words: int | None = None) -> DataFrame:
    """(doc_id, item_id, begins, words) of every document that holds ``words`` consecutive words of an item, or a shorter item as a whole."""
    spark = documents.sparkSession
    wanted = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", _words(F.col("text")).alias("words")).where("words <> ''").distinct()
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", _words(F.col("text")).alias("words"))
    total = wanted.agg(F.sum(F.length("words"))).first()[0] or 0
    passes = -(-total // index_chars)
    if passes > 1:
        texts, wanted = cut(texts), cut(wanted)
    found = None
    for k in range(passes):
        part = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        rows = [(r[0], r[1].split(" ")) for r in part.collect()]  # a stated query set: about index_chars characters a pass
        sizes = {min(len(t), words) for _, t in rows if len(t) >= (least_words or words)}
        indexes = [ItemIndex(*zip(*[(i, t) for i, t in rows if min(len(t), words) == n], strict=True), n) for n in sorted(sizes)]
        if indexes:
            hits = texts.mapInArrow(_search(spark.sparkContext.broadcast(indexes)), "doc_id long, item_id long, begins array<int>, words int")
            found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], "doc_id long, item_id long, begins array<int>, words int") if found is None else found


def leaked_items(documents: DataFrame, items: DataFrame, words: int = WORDS, index_chars: int = INDEX_CHARS, least_words: int | None = None) -> DataFrame:
    """(doc_id, item_id): the document holds ``words`` or more consecutive words of the item."""
    return shared_runs(documents, items, words, index_chars, least_words).select("doc_id", "item_id").distinct()


def overlaps(documents: DataFrame, items: DataFrame, words: int = WORDS, index_chars: int = INDEX_CHARS, least_words: int | None = None) -> DataFrame:
    """(doc_id, item_id, item_words, shared_words, question_words, shared_question): how much of a leaked item the document holds in shared runs.

    The question is what follows the last stop, semicolon or line end before the last
    question mark; an item without one has no question words.
    """
    runs = shared_runs(documents, items, words, index_chars, least_words)
    each = runs.select("doc_id", "item_id", F.explode("begins").alias("begin"), "words").select("doc_id", "item_id", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("words") - 1)).alias("at")).distinct()
    count = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))
    question = F.regexp_extract("text", "(?s)([^.!;\\n?]*)\\?[^?]*\\z", 1)
    before = F.when(F.col("question") == "", F.col("text")).otherwise(F.regexp_extract("text", "(?s)\\A(.*?)[^.!;\\n?]*\\?[^?]*\\z", 1))
    formed = items.where("item_id is not null and text is not null").select("item_id", "text", question.alias("question")).withColumn("before", before).select("item_id", _words(F.col("text")).alias("w"), _words(F.col("before")).alias("b"), _words(F.col("question")).alias("q"))
    sizes = formed.groupBy("item_id").agg(F.max(count(F.col("w"))).alias("item_words"), F.max(count(F.col("b"))).alias("first"), F.max(count(F.col("q"))).alias("question_words"))
    asked = (F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("question_words"))
    return each.join(sizes, "item_id").groupBy("doc_id", "item_id", "item_words", "question_words").agg(F.count("*").alias("shared_words"), F.count_if(asked).alias("shared_question")).select("doc_id", "item_id", "item_words", "shared_words", "question_words", "shared_question")


def leaked_summary(found: DataFrame) -> DataFrame:
    """(item_id, documents): how many documents each leaked item is in."""
    return found.groupBy("item_id").agg(F.count("*").alias("documents"))
