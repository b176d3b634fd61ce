"""Benchmark decontamination over a positional inverted index, in DataFrame functions throughout.

Words: A-Z lower-cased, runs of [0-9a-z] and non-ASCII characters. A window is ``WINDOW`` consecutive words of a test
item, or the whole of a shorter item that has words.

1. The training texts' words are written once. Test terms are counted in them, and each window is given its two
   rarest terms; a window with a term that occurs nowhere is done.
2. The index holds the postings (term, document, position) of those terms, with the words around each position.
3. A window's matches: the postings of its rarest term, moved back by the term's offset in the item, intersected with
   those of its second rarest, moved back likewise; the words stored around the position then confirm the phrase and
   say how far the match goes on. With ``slop``, proximity matches hold all words of a window, in any order,
   within ``slop`` words more than the window has.

Defined results: null, empty and wordless texts have no words and no hits; wordless items have no windows; items that
share an item_id count once; equal frequencies are settled by position; repeated rows of a document repeat its result;
empty tables give no hits or no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, unused

WINDOW = 10
#: Test terms, or probes, at most for a broadcast (some 60 MB); beyond it the join shuffles.
BROADCAST_ROWS = 300_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint, given only when the rows have been counted and are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _before(w: Column, at: Column, n: int) -> Column:
    """The ``n`` words before 0-based position ``at``, nearest first."""
    return F.reverse(F.slice(w, F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n))))


def _agree(x: Column, y: Column) -> Column:
    """How many leading words two arrays share."""
    same = F.zip_with(x, y, lambda a, b: a.isNotNull() & b.isNotNull() & (a == b))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (a hash that tells repeated doc_ids with different texts apart), words, n_words; written once."""
    out = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), words(F.col(text)).alias("words"))
    return materialize(out.withColumn("n_words", F.size("words").cast("long")), "words")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The items with words: iid (key), item_id, words, n (words of a window)."""
    out = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("words")).where(F.size("words") > 0).distinct()
    return out.select(F.xxhash64("item_id", "words").alias("iid"), "item_id", "words", F.least(F.size("words"), F.lit(window)).alias("n"))


def probes(tokens: DataFrame, items: DataFrame, reach: int, starts: bool = False) -> DataFrame:
    """For each window that can occur its two rarest terms: t1 at o1, t2 at o2 in the item, and the item's words around o1.

    Windows that share these are one row; with ``starts`` it also lists where they begin.
    """
    at = items.select("iid", "n", F.size("words").alias("m"), F.posexplode("words").alias("o", "term"))
    terms = at.select("term").distinct()
    seen = tokens.select(F.explode("words").alias("term")).join(_bounded(terms), "term").groupBy("term").agg(F.count("*").alias("df"))
    at = at.join(seen, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # n follows the item, so a window of all rows ahead is cut to n
    ahead = Window.partitionBy("iid").orderBy("o").rowsBetween(0, WINDOW - 1)
    rare = at.withColumn("ahead", F.collect_list(F.struct("df", "o", "term")).over(ahead)).where("o + n <= m")
    rare = rare.withColumn("ahead", F.array_sort(F.slice("ahead", F.lit(1), F.col("n")))).where("ahead[0].df > 0")
    second = F.coalesce(F.get("ahead", F.lit(1)), F.get("ahead", F.lit(0)))
    rare = rare.select("iid", F.col("ahead")[0]["o"].alias("o1"), F.col("ahead")[0]["term"].alias("t1"), second["o"].alias("o2"), second["term"].alias("t2"), *[F.col("o").alias("start")] * starts)
    rare = rare.groupBy("iid", "o1", "t1", "o2", "t2").agg(F.collect_set("start").alias("starts")) if starts else rare.distinct()
    joined = rare.join(items, "iid")
    return materialize(
        joined.select("iid", "item_id", "n", "t1", "o1", "t2", "o2", _before(F.col("words"), F.col("o1"), reach).alias("i_left"), F.slice("words", F.col("o1") + 2, reach).alias("i_right"), "words", *["starts"] * starts), "probes"
    )


def index(tokens: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The postings of ``terms``: term, doc_id, th, pos, d_left and d_right (the words around, nearest first), in term order by task."""
    at = tokens.select("doc_id", "th", "words", F.posexplode("words").alias("pos", "term")).join(_bounded(terms), "term")
    out = at.select("term", "doc_id", "th", "pos", _before(F.col("words"), F.col("pos"), reach).alias("d_left"), F.slice("words", F.col("pos") + 2, reach).alias("d_right"))
    return materialize(out.sortWithinPartitions("term"), "postings")


def matches(tokens: DataFrame, items: DataFrame, slop: int = 0, window: int = WINDOW) -> DataFrame:
    """doc_id, th, item_id, start and stop (words, inclusive), kind: ``exact``, and with ``slop`` also ``near``.

    Exact rows cover all occurrences of all windows; one row may cover several windows that overlap.
    """
    reach = window - 1 + slop
    found = probes(tokens, items, reach, starts=slop > 0)
    terms = found.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()
    postings = index(tokens, terms, reach)
    small = _bounded(found)
    first = postings.join(small, F.col("term") == F.col("t1"))
    left, right = _agree(F.col("d_left"), F.slice("i_left", 1, window - 1)), _agree(F.col("d_right"), F.slice("i_right", 1, window - 1))
    placed = first.select("doc_id", "th", "item_id", "n", "words", "o1", "t2", "pos", (F.col("pos") - F.col("o1") + F.col("o2")).alias("pos2"), "d_left", "d_right", "term", "i_left", "i_right", *["starts"] * (slop > 0))
    second = postings.select(F.col("doc_id").alias("doc2"), F.col("th").alias("th2"), F.col("term").alias("term2"), F.col("pos").alias("at2"))
    both = placed.join(second, (F.col("doc_id").eqNullSafe(F.col("doc2"))) & (F.col("th") == F.col("th2")) & (F.col("t2") == F.col("term2")) & (F.col("pos2") == F.col("at2")), "left_semi")
    exact = both.withColumn("l", left).withColumn("r", right).where("l + r + 1 >= n")
    out = exact.select("doc_id", "th", "item_id", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("stop"), F.lit("exact").alias("kind"))
    if slop:
        around = F.concat(F.reverse("d_left"), F.array("term"), "d_right")
        near = placed.withColumn("around", around).withColumn("begin", F.explode("starts")).withColumn("wanted", F.array_distinct(F.slice("words", F.col("begin") + 1, F.col("n"))))
        near = near.where(F.size(F.array_except("wanted", "around")) == 0)  # before the places are tried
        near = near.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.size("around") - F.col("n") - slop, F.lit(0)))))
        near = near.where(F.size(F.array_except("wanted", F.slice("around", F.col("k") + 1, F.col("n") + slop))) == 0)
        base = F.col("pos") - F.size("d_left") + F.col("k")
        out = out.union(near.select("doc_id", "th", "item_id", base.alias("start"), (base + F.least(F.col("n") + slop, F.size("around") - F.col("k")) - 1).alias("stop"), F.lit("near").alias("kind")).distinct())
    return out


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated."""
    tokens = tokenize(docs)
    hits = matches(tokens, windows(items)).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("ranges"), F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("ids"))
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))
    merged = F.aggregate("ranges", start, lambda s, r: F.struct(F.greatest(s["end"], r["stop"]).alias("end"), (s["n"] + F.greatest(r["stop"] - F.greatest(s["end"], r["start"] - 1), F.lit(0))).alias("n")))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), merged["n"].alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.array_join(F.array_sort("ids"), ",").alias("ids"))
    rows = tokens.select("doc_id", "th", "n_words").join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of any item."""
    doc, th = unused(docs, "doc", "th")
    hits = matches(tokenize(docs), windows(items)).select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct()
    hits = _bounded(materialize(hits, "hits"))  # so few keys need not move the texts
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left_anti")
