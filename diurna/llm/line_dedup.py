"""Line deduplication with DataFrame operations only.

Long lines are hashed, range-partitioned by hash and document and sorted within each range by hash,
document and position; the first occurrence of a line in each document streams out of that order and
counts the documents that hold it. What comes back is a sparse bitmap per document, never the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Tasks that the lines of one key are dealt to.
SALTS = 16
#: Lines are looked at as an array; a null or empty text is one empty line.
LINES = "split(coalesce({text}, ''), '\\n', -1)"


def line_hashes(docs: DataFrame, *, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row per line whose key has ``min_chars`` code points: ``h1, h2`` (128 bits), ``doc``, ``row``, ``pos``.

    The key is the line without white space at both ends and with A-Z in lower case. ``row`` tells apart
    rows that share an id: it is a hash of the row's text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("row"), F.translate(text, UPPER, LOWER).alias("folded"))
    lines = rows.select("doc", "row", F.posexplode(F.split("folded", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "row", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "row", "pos")


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The bitmaps of documents that lose lines: ``doc``, ``row``, ``dropped`` (64-line word -> bits).

    A key found in ``min_docs`` documents or more stays only in the largest id that holds it. The bitmap
    is sparse: words that keep all their lines are left out, and so are documents that keep everything.

    Rows that share an id are one document: a key they share counts once, and each row gets its own
    bitmap. A null id is smaller than any other and does not count as a document. An empty table gives an empty result; columns besides
    the id and the text are not read.
    """
    lines = line_hashes(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    ranged = lines.repartitionByRange("h1", "h2", "doc")
    in_order = Window.partitionBy("h1", "h2", "doc").orderBy("row", "pos")
    # A hot line spreads over the ranges by document, and each range sends on one row for it.
    holders = ranged.withColumn("nth", F.row_number().over(in_order)).where("nth = 1").groupBy("h1", "h2")
    common = holders.agg(F.count("doc").alias("n"), F.max("doc").alias("last")).where((F.col("n") >= min_docs) & F.col("last").isNotNull())
    # Few keys are common, so each is repeated for every salt, and the lines of a hot one go to as many tasks.
    spread = common.select("h1", "h2", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = ranged.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    lost = salted.join(spread, ["h1", "h2", "salt"]).where(F.coalesce(F.col("doc") < F.col("last"), F.lit(True)))
    words = lost.select("doc", "row", F.expr("cast(pos div 64 as bigint) AS word"), F.expr("shiftleft(1L, pos % 64) AS bit"))
    words = words.groupBy("doc", "row", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("doc", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__lines``, ``__dropped`` (counts) and ``__kept`` (the text that is left) added."""
    left = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    marks = bitmaps.select(F.col("doc").alias("__doc"), F.col("row").alias("__bitmap_row"), F.col("dropped").alias("__bits"))
    joined = left.join(marks, left[id_col].eqNullSafe(marks["__doc"]) & (left["__row"] == marks["__bitmap_row"]), "left")
    lines = LINES.format(text=f"`{text_col}`")
    stays = "(coalesce(element_at(__bits, cast(i div 64 as bigint)), 0L) & shiftleft(1L, i % 64)) = 0"
    kept = F.when(F.col("__bits").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.expr(f"array_join(filter({lines}, (x, i) -> {stays}), '\\n')"))
    dropped = F.expr("coalesce(aggregate(map_values(__bits), 0L, (n, bits) -> n + bit_count(bits)), 0L)")
    added = {"__lines": F.expr(f"cast(size({lines}) as bigint)"), "__dropped": dropped, "__kept": kept}
    return joined.withColumns(added).drop("__row", "__doc", "__bitmap_row", "__bits")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the text that is left and its length; ``n_chars`` follows where it exists."""
    text_col = options.get("text_col", "text")
    ids = {k: v for k, v in options.items() if k in ("id_col", "text_col")}
    out = apply_bitmaps(docs, keep_bitmaps(docs, **options), **ids).withColumn(text_col, F.col("__kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast("bigint"))
    return out.select(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


REPORT_SQL = """
WITH lines AS (
  SELECT doc_id, rid, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, rid, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)) t
), common AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, coalesce(l.doc_id < c.last, c.last IS NOT NULL) AS lost FROM lines l LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (lost))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
