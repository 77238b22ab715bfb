"""Benchmark decontamination with a distributed positional inverted index.

Test items are cut into windows of `window` consecutive words. Spark counts how
often each word of the windows occurs in the training texts; a window's anchors
are its rarest words. The index holds a posting (word, document, place) for
every occurrence of an anchor. A window's occurrences start where the places of
all its anchors, each less the anchor's offset in the window, are the same: the
lists are intersected from the rarest anchor on, and what is left is compared
with the document's own words, which makes the phrase match exact. For
proximity, the anchors have to stand within a stretch of words in any order.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlight.session import cut

#: Fixed: what separates words after A-Z have been lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in order; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, BETWEEN), lambda w: w != "")


def windows_of(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, window, wid): distinct windows of each item as arrays of words, with a short name; a shorter item is one window, an item without words has none."""
    words = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))
    cut_out = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(window)))).alias("window")).distinct()
    return cut_out.withColumn("wid", F.xxhash64("window"))


def _document_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "version", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A document is its id and a digest of its text, so that rows with one id and different texts are told apart."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))


class PositionalIndex:
    """Postings of the anchors of all windows, and the windows. `anchors`: how many of a window's distinct words, from the rarest."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = 10, anchors: int = 2, doc_id: str = "doc_id", text: str = "text"):
        self.docs, self.window, self.n_anchors = _keyed(docs, doc_id, text), window, anchors
        self.item_windows = cut(windows_of(items, window))
        distinct = self.item_windows.select("wid", "window").distinct()
        terms = cut(distinct.select(F.explode("window").alias("word")).distinct())
        counts = _document_words(self.docs).join(terms, "word").groupBy("word").count()
        rated = (distinct.select("wid", "window", F.posexplode("window").alias("offset", "word")).groupBy("wid", "window", "word").agg(F.min("offset").alias("offset"))
                 .join(counts, "word", "left").na.fill(0, ["count"]))
        order = Window.partitionBy("window").orderBy("count", "offset")
        # a window with a word that no document has cannot occur
        chosen = rated.withColumn("nr", F.row_number().over(order)).withColumn("least", F.min("count").over(Window.partitionBy("window")))
        self.anchors = cut(chosen.where((F.col("nr") <= anchors) & (F.col("least") > 0)).select("wid", F.size("window").alias("n"), "word", "offset", "nr").distinct())
        self.postings = cut(_document_words(self.docs).join(self.anchors.select("word").distinct(), "word").select("word", "doc_id", "version", "pos"))

    def _lists(self, nr: int) -> DataFrame:
        """Offset-adjusted postings of each window's nr-th rarest anchor."""
        return (self.anchors.where(F.col("nr") == nr).select("word", "wid", "offset").join(self.postings, "word")
                .select("wid", F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("no_id"), "version", (F.col("pos") - F.col("offset")).alias("start"))
                .where("start >= 0"))

    def phrases(self) -> DataFrame:
        """(doc_id, version, start, window): every exact occurrence of a window, once."""
        at = self._lists(1)
        for nr in range(2, self.n_anchors + 1):
            # windows of fewer distinct words have no such list
            has = self.anchors.where(F.col("nr") == nr).select("wid").distinct()
            at = at.join(self._lists(nr), at.columns, "left_semi").unionByName(at.join(has, "wid", "left_anti"))
        windows = self.item_windows.select("wid", "window").distinct()
        found = cut(at.join(windows, "wid").select(F.when(~F.col("no_id"), F.col("d")).alias("doc_id"), "version", "start", "window")
                    .groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "window")).alias("found")))
        # only the texts that have a candidate are read again
        near = self.docs.join(found, self.docs.doc_id.eqNullSafe(found.doc_id) & (self.docs.version == found.version))
        checked = near.select(self.docs.doc_id, self.docs.version, "found", words_of(F.col("text")).alias("w")).select(
            "doc_id", "version", F.filter("found", lambda f: F.slice("w", f["start"] + 1, F.size(f["window"])) == f["window"]).alias("found"))
        return checked.select("doc_id", "version", F.explode("found").alias("f")).select("doc_id", "version", "f.start", "f.window").distinct()

    def near(self, slop: int) -> DataFrame:
        """(doc_id, version, window): documents in which all anchors of a window stand, in any order, within its length plus `slop` words."""
        places = self.anchors.join(self.postings, "word").select("doc_id", "version", "wid", "n", "nr", "pos")
        last = Window.partitionBy("doc_id", "version", "wid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        needed = self.anchors.groupBy("wid").agg(F.max("nr").alias("needed"))
        latest = [F.max(F.when(F.col("nr") == k, F.col("pos"))).over(last).alias(f"p{k}") for k in range(1, self.n_anchors + 1)]
        seen = places.select("doc_id", "version", "wid", "n", "pos", *latest).join(needed, "wid")
        never = F.lit(-(1 << 30))
        first = reduce(lambda a, k: F.when(F.col("needed") >= k, F.least(a, F.coalesce(f"p{k}", never))).otherwise(a), range(2, self.n_anchors + 1), F.coalesce("p1", never))
        hits = seen.where(F.col("pos") - first < F.col("n") + slop).select("doc_id", "version", "wid").distinct()
        return hits.join(self.item_windows.select("wid", "window").distinct(), "wid").select("doc_id", "version", "window")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, anchors: int = 2, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit (words inside an occurrence of a window), item_ids (sorted strings).

    Null or wordless texts have no words and no hits. Rows that repeat a doc_id
    each get the result of their own text. Items of equal text are all named.
    An empty table of items hits nothing; an empty table of documents gives no
    rows. Other columns of both tables are not looked at.
    """
    tests = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    index = PositionalIndex(docs, tests, window, anchors, doc_id, text)
    found = cut(index.phrases())
    before = Window.partitionBy("doc_id", "version").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.select("doc_id", "version", "start", (F.col("start") + F.size("window")).alias("end")).distinct()
    hit = (ends.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
           .groupBy("doc_id", "version").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "covered"))).cast("bigint").alias("n_hit")))
    named = (found.select("doc_id", "version", "window").distinct().join(index.item_windows.drop("wid"), "window")
             .groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")))
    result = hit.join(named, hit.doc_id.eqNullSafe(named.doc_id) & (hit.version == named.version)).select(hit.doc_id, hit.version, "n_hit", "item_ids")
    sizes = index.docs.select("doc_id", "version", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    return (sizes.join(result, sizes.doc_id.eqNullSafe(result.doc_id) & (sizes.version == result.version), "left")
            .select(sizes.doc_id, "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, anchors: int = 2, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` without any word inside an occurrence of a test window, all columns as they are."""
    index = PositionalIndex(docs, items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), window, anchors, doc_id, text)
    hit = cut(index.phrases().select(F.col("doc_id").alias("_hit_id"), F.col("version").alias("_hit_version")).distinct())
    return docs.join(hit, docs[doc_id].eqNullSafe(hit["_hit_id"]) & (F.xxhash64(docs[text]) == hit["_hit_version"]), "left_anti")
