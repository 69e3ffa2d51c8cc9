"""Bottom-k sketches of word shingles, in DataFrame functions only.

The fingerprint of a text is the ``K`` smallest 64-bit hashes of its distinct 5-word shingles, ascending; a
text of fewer words has its whole word sequence as its one shingle, a text without words none. The sketch of
a union is the bottom k of the sketches' union, so parts merge in any order; overlap among the bottom k of a
union estimates resemblance, containment and, by the k-th smallest hash, the number of distinct shingles.
Estimates are exact while no sketch is full.

Null texts are empty; two empty sketches are alike (1), an empty and another are not (0); equal texts have
equal fingerprints; null ids sort first; repeated ids are ordered by text, and a repeated row follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WIDTH = 5
BLOCK_BYTES = 16 << 20
MOST_BLOCKS = 20_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a text column, an ascending array of longs."""

    def of(words: Column) -> Column:
        at = lambda i, j: F.get(words, i + j)
        starts = F.sequence(F.lit(0), F.size(words) - width)
        shingles = F.transform(starts, lambda i: F.xxhash64(*(at(i, j) for j in range(width))))
        whole = F.array(F.xxhash64(F.array_join(words, " ")))
        return F.when(F.size(words) >= width, shingles).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    # A one-element transform names the word array once, so it is split once.
    hashes = F.get(F.transform(F.array(words_of(text)), of), F.lit(0))
    return bottom(hashes, k)


def bottom(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct values, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets."""
    shared = lambda both: F.size(F.array_intersect(F.array_intersect(both, a), b))
    part = F.get(F.transform(F.array(merge(a, b, k)), lambda both: shared(both) / F.greatest(F.size(both), F.lit(1))), F.lit(0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(part)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: k - 1 over the share of the hash range below the k-th value."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance x union size over a's size."""
    union = distinct_shingles(merge(a, b, k), k)
    own = distinct_shingles(a, k)
    return F.when(own == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / own))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merge_parts(parts: DataFrame, key: str, sketch_column: str = "sketch", k: int = K, salt: int = 16) -> DataFrame:
    """One sketch per key from the sketches of its parts; hot keys are merged in ``salt`` groups first."""
    hashes = parts.select(key, F.explode_outer(sketch_column).alias("h"))
    spread = hashes.select(key, F.pmod(F.xxhash64("h"), F.lit(salt)).alias("s"), "h").distinct()
    ranked = spread.withColumn("r", F.row_number().over(Window.partitionBy(key, "s").orderBy("h"))).where(F.col("r") <= k)
    return ranked.groupBy(key).agg(bottom(F.collect_list("h"), k).alias(sketch_column))


def neighbours(docs: DataFrame, id_column: str, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with the struct ``following``: ``columns`` of the next row by id, after the last the first.

    Rows are dealt into blocks of ids; the first row of each block is copied to the end of the block before,
    so one shuffle serves all rows and no window exceeds a block. ``derived`` columns are made of a row's own
    columns and belong to ``following`` too; the search for the first row does not compute them.
    """
    derived = derived or {}
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(columns[0])).alias("b")).first()
    blocks = int(min(MOST_BLOCKS, max(8, (total["b"] or 0) // BLOCK_BYTES)))
    cuts = [i / blocks for i in range(1, blocks)]
    found = docs.agg(F.min(id_column).alias("low"), F.percentile_approx(id_column, cuts, 20 * blocks).alias("cuts")).first()
    edges = sorted(set(found["cuts"] or []) - {found["low"]})
    points = F.array(*map(F.lit, edges)).cast("array<bigint>")
    own = F.when(F.col(id_column).isNull(), F.lit(0)).otherwise(F.size(F.filter(points, lambda e: e <= F.col(id_column))))
    # Null ids come first in the order of structs, too.
    first = docs.agg(F.min(F.struct(id_column, *columns)).alias("_first")).where(F.col("_first").isNotNull()).select("_first.*").withColumns(derived)
    columns = [*columns, *derived]
    dealt = docs.withColumns(derived).withColumn("_block", own)
    # Copies: the first row of block b closes block b - 1; the first row of all closes the last block.
    heads = dealt.where(F.col(id_column).isin(edges)) if edges else dealt.limit(0)
    heads = heads.groupBy("_block").agg(F.min(F.struct(columns[0], *columns[1:])).alias("_head"))
    heads = heads.select((F.col("_block") - 1).alias("_block"), *(F.col(f"_head.{c}").alias(c) for c in columns))
    last = first.select(F.lit(len(edges)).alias("_block"), *columns)
    ghosts = heads.unionByName(last).withColumns({"_ghost": F.lit(True), id_column: F.lit(None).cast("bigint")})
    rows = dealt.withColumn("_ghost", F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    order = Window.partitionBy("_block").orderBy("_ghost", F.col(id_column).asc_nulls_first(), columns[0])
    # Each column on its own: a struct would travel beside the columns it is made of.
    led = rows.select("*", *(F.lead(c).over(order).alias(f"_next{i}") for i, c in enumerate(columns))).where(~F.col("_ghost"))
    following = F.struct(*(F.col(f"_next{i}").alias(c) for i, c in enumerate(columns)))
    return led.select(*docs.columns, *derived, following.alias("following"))


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to it.

    The edited text keeps the first half of the text and takes the beginning of the next document's for the
    rest. Texts and sketches travel in one shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = neighbours(rows, "doc_id", ["text"], {"sketch": sketch(F.col("text"), k)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("following.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "sketch", F.col("following.sketch").alias("next"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), k).alias("edited_sketch"), "next")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next"), k).alias("near_next"),
    )
