"""Bottom-k sketches of word shingles, in SQL functions only.

A text's shingles are its runs of five words (ASCII case folded, split at ASCII white
space); a text of one to four words is one shingle. Each word is hashed once, a
shingle's hash is the hash of its words' hashes. The sketch is the sorted list of the
k smallest different hashes. The smallest k of the union of two sketches are the
sketch of both texts together, so sketches merge across parts, and the share of them
that lies in both estimates resemblance; with fewer than k shingles it is exact.

Defined cases: null is the empty text; a text without words has an empty sketch,
which is like another empty one (1.0) and unlike any other (0.0); the order, ties and
repetition of shingles don't matter; a text of any length is sketched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_text, with_next

K = 128
WIDTH = 5
SPACE = "[\\x20\\x09-\\x0D]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the words in order; upper-case ASCII letters count as lower-case."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of(words: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k smallest different shingle hashes, made non-negative, ascending."""
    n = F.size(words)
    at = F.when(n > width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array(F.lit(1)))
    full = F.transform(
        at, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(width)]), 1)
    )
    return F.when(n > 0, F.slice(F.sort_array(F.array_distinct(full)), 1, k)).otherwise(F.array().cast("array<bigint>"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all shingles of both."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both)).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact below k."""
    top = F.element_at(a, -1).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << 63)) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and both counts."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(na == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def text_form(sketch: Column) -> Column:
    """A sketch as text: hexadecimal hashes, comma-joined."""
    return F.array_join(F.transform(sketch, lambda h: F.hex(h)), ",")


def sketches(df: DataFrame, text: str = "text", out: str = "sketch", k: int = K, width: int = WIDTH) -> DataFrame:
    """df with the sketch of its text as a new column."""
    if out in df.columns or "_words" in df.columns:
        raise ValueError(f"column {out} or _words exists already")
    # the hashes are kept as a column of their own, so that they are made once per text
    words = df.withColumn("_words", F.explode(F.array(word_hashes(whole_text(text)))))
    return words.withColumn(out, F.explode(F.array(sketch_of(F.col("_words"), k, width)))).drop("_words")


def compare_with_edit(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Each text against its edited form and against the next document's text.

    The edited text replaces the last quarter of the code points by the first as many
    of the next document in ascending key; repeated keys are ordered by text hash.
    """
    base = df.select(F.col(key), whole_text(text).alias("body")).withColumn("n_chars", F.length("body").cast("long"))
    base = sketches(base, "body", "print", k, width)
    ring = with_next(base, key, F.xxhash64("body"), ["body", "print"], keys=df.select(key))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring("body", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_body", F.lit(1), quarter)
    )
    changed = ring.select(key, "n_chars", "print", "next_print", edited.alias("edited"))
    changed = sketches(changed, "edited", "edited_print", k, width)
    return changed.select(
        key, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_form(F.col("print")).alias("fingerprint"), text_form(F.col("edited_print")).alias("edited_fingerprint"),
        resemblance(F.col("print"), F.col("edited_print"), k).alias("near_edited"),
        resemblance(F.col("print"), F.col("next_print"), k).alias("near_next"),
        distinct_count(F.col("print"), k).alias("n_shingles"),
        containment(F.col("edited_print"), F.col("print"), k).alias("edited_contained"),
    )
