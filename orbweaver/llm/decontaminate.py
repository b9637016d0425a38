"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Texts are cut into words once; the words are written and read by all later steps. Test items become
windows of consecutive words. Corpus counts of the test terms say which two terms of each window are
rarest, and the postings (term, document, position) of these terms alone are stored as the index. Each
posting, moved back by its term's offset in a window, is a place where the window could begin; the lists
of a window's two rarest terms are intersected, and only documents with a common place are looked at for
the window's other words. No posting of a frequent term is ever moved between machines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweaver.operators.lexical import ascii_lower
from orbweaver.session import cut, drop_path, scratch_path

#: Anything that is no ASCII letter or digit and no other character from U+0080 on parts words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms of test windows (short strings) or numbers of documents that may be broadcast; beyond, they meet postings and words in a shuffle.
BROADCAST_WINDOWS = 160_000
#: Bytes, compressed, of a row group of stored words and postings: what a task holds before it writes, and reads at once.
ROW_GROUP = 2 << 20
#: Rows after which a row group's size is looked at first, so that long texts don't pile up before.
FIRST_LOOK = 4


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, cut at ASCII characters other than letters and digits; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _windows(items: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((wid, w array): each distinct window of the test items; (wid, item_id): the items that hold it)."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    last = F.greatest(F.size("ws") - size, F.lit(0))
    w = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("ws", i + 1, size))).alias("w")).distinct()
    distinct = cut(w.select("w").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return distinct, cut(w.join(distinct, "w").select("wid", "item_id"))


def _checked(rows: DataFrame) -> DataFrame:
    """``rows`` (one a test term or a document found), to be broadcast if they are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_WINDOWS else rows


class _Index:
    """The words of a table of documents, written to the shared folder, and postings of chosen terms.

    doc numbers the stored rows; key is the document's id and the hash of its text.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        self.spark, self.paths = docs.sparkSession, []
        key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
        self.words = self.stored(docs.select(F.monotonically_increasing_id().alias("doc"), key.alias("key"), words(F.col(text_col)).alias("ws")), "words")

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(scratch_path(self.spark, name))
        sizes = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": FIRST_LOOK}
        df.write.options(compression="zstd", **sizes).parquet(self.paths[-1])
        # a vectored read keeps a buffer outside the heap, as large as a column's part of a row group, in each of its threads
        return self.spark.read.schema(df.schema).option("parquet.hadoop.vectored.io.enabled", False).parquet(self.paths[-1])

    def drop(self) -> None:
        for p in self.paths:
            drop_path(self.spark, p)

    def rarest(self, distinct: DataFrame) -> DataFrame:
        """(wid, first, second): term and offset of the two rarest words of each window all of whose words occur somewhere.

        second is null where a window has one word. Counts are taken of the test terms only and aggregate
        before any shuffle.
        """
        terms = cut(distinct.select(F.explode("w").alias("term")).distinct())
        counts = self.words.select(F.explode("ws").alias("term")).join(_checked(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
        each = distinct.select("wid", F.posexplode("w").alias("offset", "term")).join(counts, "term", "left")
        lists = each.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("l"))  # a window's words
        return cut(lists.filter(F.col("l")[0]["n"] > 0).select("wid", F.get("l", F.lit(0)).alias("first"), F.get("l", F.lit(1)).alias("second")))

    def postings(self, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((tid, doc, pos): the postings of the terms (column term) of ``chosen``, stored; (tid, term))."""
        terms = cut(chosen.select("term").filter("term IS NOT NULL").distinct().withColumn("tid", F.monotonically_increasing_id()))
        found = self.words.select("doc", F.posexplode("ws").alias("pos", "term")).join(_checked(terms), "term")
        return self.stored(found.select("tid", "doc", "pos"), "postings"), terms

    def verified(self, found: DataFrame, distinct: DataFrame, fits) -> DataFrame:
        """(key, wid, at, n) of those rows of ``found`` (wid, doc, at) for which fits(words, at, window) holds; n is the window's length.

        The places of a document are looked at beside its words, in one row.
        """
        per = found.join(distinct, "wid").groupBy("doc").agg(F.collect_set(F.struct("wid", "at", "w")).alias("xs"))  # of one document
        near = self.words.join(_checked(cut(found.select("doc").distinct())), "doc", "left_semi")  # most documents have no such place
        rows = near.join(per, "doc").select("key", F.filter("xs", lambda x: fits(F.col("ws"), x["at"], x["w"])).alias("xs"))
        return rows.select("key", F.explode("xs").alias("x")).select("key", "x.wid", "x.at", F.size("x.w").alias("n"))

    def phrases(self, distinct: DataFrame) -> DataFrame:
        """(wid, key, start, length): every place where a window occurs."""
        chosen = self.rarest(distinct)
        postings, terms = self.postings(chosen.select("first.term").union(chosen.select("second.term")))
        a, b = (terms.select(F.col("tid").alias(f"tid{k}"), F.col("term").alias(f"term{k}")) for k in (1, 2))
        lists = chosen.join(a, F.col("first.term") == F.col("term1")).join(b, F.col("second.term") == F.col("term2"), "left")
        lists = cut(lists.select("wid", F.col("tid1").alias("tid"), F.col("first.offset").alias("offset"), "tid2", (F.col("second.offset") - F.col("first.offset")).alias("step")))
        # the rarest term's list, moved to where a window would begin, and of it what the next list agrees with
        placed = postings.join(_checked(lists), "tid").filter("pos >= offset").select("wid", "doc", (F.col("pos") - F.col("offset")).alias("at"), F.col("tid2").alias("tid"), (F.col("pos") + F.col("step")).alias("pos"))
        agreed = placed.filter("tid IS NOT NULL").join(postings, ["tid", "doc", "pos"], "left_semi")
        found = cut(agreed.unionByName(placed.filter("tid IS NULL")).select("wid", "doc", "at"))
        rows = self.verified(found, distinct, lambda ws, at, w: F.slice(ws, at + 1, F.size(w)) == w)
        return rows.select("wid", "key", F.col("at").alias("start"), F.col("n").alias("length"))


def occurrences(docs: DataFrame, items: DataFrame, size: int = 8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(key, item_id, start, length): each place in a document where a window of a test item occurs, exactly.

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one
    window. Every document and every position is looked at; key is the document's id. Texts may be of
    any length; null and empty ones and empty tables have no occurrences.
    """
    index = _Index(docs, id_col, text_col)
    try:
        return _occurrences(index, items, size, item_id_col, item_text_col).select("key.id", "item_id", "start", "length").withColumnRenamed("id", "key")
    finally:
        index.drop()


def _occurrences(index: _Index, items: DataFrame, size: int, item_id_col: str, item_text_col: str) -> DataFrame:
    distinct, named = _windows(items, size, item_id_col, item_text_col)
    return cut(index.phrases(distinct).join(named, "wid").select("key", "item_id", "start", "length").distinct())


def proximity(docs: DataFrame, items: DataFrame, within: int = 16, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = 4) -> DataFrame:
    """(key, item_id, start): places where all words of a window lie within ``within`` words, in any order.

    ``start`` is the position of the window's rarest word; ``within`` counts to either side of it.
    """
    index = _Index(docs, id_col, text_col)
    try:
        distinct, named = _windows(items, size, item_id_col, item_text_col)
        chosen = index.rarest(distinct).select("wid", "first.term")
        postings, terms = index.postings(chosen)
        found = postings.join(_checked(cut(chosen.join(terms, "term"))), "tid").select("wid", "doc", F.col("pos").alias("at"))

        def near(ws: Column, at: Column, w: Column) -> Column:
            around = F.slice(ws, F.greatest(at - within + 1, F.lit(1)), within + 1 + F.least(at, F.lit(within)))
            return F.size(F.array_except(w, around)) == 0

        hits = index.verified(found, distinct, near)
        return cut(hits.join(named, "wid").select(F.col("key.id").alias("key"), "item_id", F.col("at").alias("start")).distinct())
    finally:
        index.drop()


def contamination(docs: DataFrame, items: DataFrame, size: int = 8, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of a window, n_items the items with occurring
    windows; items_sha256 is over their ids, sorted as strings and comma-joined; a document is
    contaminated from ``min_items`` items on. Null and empty texts have no words. Rows with the same
    id and text are the same document and get the same result; rows that share an id but not a text
    are told apart. Texts of any length are read whole. Null ids, empty tables and other columns of any
    name do no harm.
    """
    index = _Index(docs, id_col, text_col)
    try:
        return _contamination(index, _occurrences(index, items, size, item_id_col, item_text_col), min_items, id_col)
    finally:
        index.drop()


def _contamination(index: _Index, found: DataFrame, min_items: int, id_col: str) -> DataFrame:
    # of the words between two starts, each is hit once: count new ones by the furthest end so far
    order = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("key", "start").agg(F.max("length").alias("length"))
    spans = spans.withColumn("end", F.col("start") + F.col("length"))
    spans = spans.withColumn("new", F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(order), F.lit(0))), F.lit(0)))
    hit = spans.groupBy("key").agg(F.sum("new").alias("n_hit"))
    named = found.select("key", "item_id").distinct().groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    counted = index.words.select("key", F.size("ws").cast("long").alias("n_words"))
    out = counted.join(cut(hit.join(named, "key")), "key", "left").select(
        F.col("key.id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_items", F.lit(0)) >= min_items).alias("contaminated"),
    )
    return cut(out)


def clean(docs: DataFrame, items: DataFrame, size: int = 8, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without test passages, with all their columns.

    A document goes if it holds a whole window of ``size`` words of any item, or windows of
    ``min_items`` items (which counts for items too short to have a whole window: one such phrase
    alone may be chance). Documents that share an id share their fate; null ids are an id too.
    """
    found = occurrences(docs, items, size, id_col, text_col)
    per = found.groupBy("key").agg(F.max("length").alias("longest"), F.count_distinct("item_id").alias("n_items"))
    bad = per.filter((F.col("longest") >= size) | (F.col("n_items") >= min_items)).select(F.col("key").alias("__bad"))
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("__bad")), "left_anti")
