"""Document fingerprints by winnowing, in DataFrame functions only.

A text is read as symbols: runs of ASCII letters and digits, and every other character that is not
white space by itself, so scripts without spaces are covered as well. Each k-gram of symbols has a
hash; of every window of w hashes the smallest is chosen, the rightmost on ties, and its position
is kept. Any run of at least k + w - 1 equal symbols in two texts shares a choice.

SQL functions hold no running state, so a k-gram's hash is taken over its k symbols at each step
instead of being updated from the one before; the sequence of hashes is the same. Window minima
come from log2(w) passes, each the smaller of two neighbouring windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import documents, settled

GRAM = 5
WINDOW = 8  # a power of two
SYMBOL = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"
LOW = (1 << 31) - 1  # the lower bits of a mark count positions down, so the rightmost of equal hashes is smallest


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _wider(least: Column, width: int) -> Column:
    """Minima of windows of ``width`` to those of windows twice as wide; shorter ones at the end."""
    return bound(least, lambda m: F.zip_with(m, F.slice(m, F.lit(width + 1), F.size(m)), lambda x, y: F.least(x, y)))


def marks(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Ascending positions' choices as bigints: 33 bits of hash, then LOW minus the position (from 1).

    A text of fewer than k symbols, the empty one too, has one mark over all it has.
    """

    def grams(symbols: Column) -> Column:
        last = F.greatest(F.lit(1), F.size(symbols) - (gram - 1))
        return F.transform(
            F.sequence(F.lit(1), last),
            lambda i: F.xxhash64(F.slice(symbols, i, F.lit(gram))).bitwiseAND(F.lit(-1 - LOW)).bitwiseOR(F.lit(LOW) - i),
        )

    def minima(hashes: Column) -> Column:
        windows = F.greatest(F.lit(1), F.size(hashes) - (window - 1))
        least, width = hashes, 1
        while width < window:
            least = _wider(least, width)
            width *= 2
        return F.array_distinct(F.slice(least, F.lit(1), windows))

    symbols = F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0))
    return bound(bound(symbols, grams), minima)


def hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda m: F.shiftright(m, 31)))


def positions(found: Column) -> Column:
    return F.transform(found, lambda m: F.lit(LOW) - m.bitwiseAND(F.lit(LOW)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' chosen hashes; texts without symbols are alike."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / (F.size(a) + F.size(b) - both)


def digest(found: Column) -> Column:
    """One string for all hashes and positions."""
    return F.sha2(F.array_join(found.cast("array<string>"), ","), 256)


def fingerprints(df: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hashes, positions): parallel arrays of the chosen hashes and their k-gram positions from 1.

    One row per input row with an id; NULL texts count as empty, repeated rows repeat.
    """
    found = documents(df, id_col, text_col).select("doc_id", marks(F.col("text"), gram, window).alias("m"))
    return found.select("doc_id", F.transform("m", lambda m: F.shiftright(m, 31)).alias("hashes"), positions(F.col("m")).alias("positions"))


# ---------------------------------------------------------------- neighbours in id order

BUCKET = 64  # ids a bucket spans


def with_next(docs: DataFrame) -> DataFrame:
    """Add next_text to (doc_id, text): the text of the next larger id, of the first one after the last.

    Ids are cut into buckets of 64 consecutive values, which hold few rows each, and neighbours are
    found within a bucket; its last row takes the first row of the next bucket that has any. Texts
    are shuffled once, to their buckets. Rows of equal id follow each other in text order.
    """
    docs = docs.withColumn("bucket", F.expr(f"doc_id div {BUCKET} - if(doc_id % {BUCKET} < 0, 1, 0)"))
    heads = settled(docs.groupBy("bucket").agg(F.min("doc_id").alias("head")), "heads")
    links = settled(_previous(heads), "links")
    # The first text of each bucket once more, for the bucket before it.
    copies = docs.join(links, docs["doc_id"] == links["head"]).groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    copies = copies.select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("copy"))
    both = docs.select("doc_id", "text", "bucket", F.lit(False).alias("copy")).unionByName(copies)
    order = Window.partitionBy("bucket").orderBy("copy", "doc_id", "text")
    found = both.withColumn("next_text", F.lead("text").over(order)).where(~F.col("copy"))
    return found.select("doc_id", "text", "next_text")


def _previous(heads: DataFrame) -> DataFrame:
    """(head, to): the bucket before that of each head; for the first head, the last bucket.

    Bucket numbers are grouped by 64 like ids, level by level, until one group is left: every
    window sees at most 64 rows.
    """
    ends = heads.agg(F.min("bucket"), F.max("bucket")).first()
    if ends[0] is None:
        return heads.select("head", F.col("bucket").alias("to"))
    level = heads.select((F.col("bucket") - ends[0]).alias("place"), "head", F.col("bucket").alias("last"))
    found = None
    while True:
        group = F.expr(f"place div {BUCKET}")
        before = F.lag("last").over(Window.partitionBy(group).orderBy("place"))
        seen = settled(level.withColumn("to", before), "level")
        pairs = seen.where("to is not null").select("head", "to")
        found = pairs if found is None else found.union(pairs)
        level = seen.groupBy(group.alias("place")).agg(F.min("head").alias("head"), F.max("last").alias("last"))
        if len(level.take(2)) < 2:
            return found.union(level.select("head", F.lit(ends[1]).alias("to")))


def edited_text(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``other``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(other, half))


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, marks, edited_marks, near_edited, near_next) of every document."""
    docs = with_next(documents(df, id_col, text_col))
    docs = docs.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    found = docs.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        marks(F.col("text")).alias("marks"),
        marks(F.col("edited")).alias("edited_marks"),
        marks(F.col("next_text")).alias("next_marks"),
    )
    own = hashes(F.col("marks"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "marks", "edited_marks",
        bound(own, lambda h: likeness(h, hashes(F.col("edited_marks")))).alias("near_edited"),
        bound(own, lambda h: likeness(h, hashes(F.col("next_marks")))).alias("near_next"),
    )
