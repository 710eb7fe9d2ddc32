"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import bucket_of, cuts_array, quantile_cuts

#: Words in a shingle.
SHINGLE = 5
#: Bins of the permutation, a power of two, and the low-order bits that are kept of each.
BINS, BITS = 128, 8
_SHIFT = 63 - (BINS - 1).bit_length()
_EMPTY = (1 << _SHIFT) - 1
#: Hashed probes before an empty bin walks all bins in an order of its own.
PROBES = 8
_SPACES = r"[\x20\x09-\x0D]+"


def _filled(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_EMPTY)) != _EMPTY


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with array<tinyint> column name: the packed low-order bits of each bin's least shingle hash.

    A shingle's 63-bit hash is its bin (high bits) and its value. Hashes and one sentinel a bin are sorted once; the
    first of each bin is its minimum, or the sentinel where the bin is empty. An empty bin takes the value of the bin
    that its own sequence of hashes names first among those filled (optimal densification). Texts of fewer words are
    one shingle; texts without words (or null) give zeros. Each step is a projection that refers to the last one more
    than once, so that it is computed once a row.
    """
    w, h, s, m = (f"_{name}_{x}" for x in "whsm")
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _SPACES), lambda x: x != "")
    out = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]), 1))
    sentinels = F.array(*[F.lit((i << _SHIFT) + _EMPTY) for i in range(BINS)]).cast("array<bigint>")
    out = out.withColumn(s, F.sort_array(F.concat(F.when(F.size(w) > 0, grams).otherwise(F.array().cast("array<bigint>")), sentinels)))
    bin_of = lambda x: F.shiftrightunsigned(x, _SHIFT)
    out = out.withColumn(m, F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))

    def value(x: Column, i: Column) -> Column:
        probe = lambda t: F.get(m, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int"))
        tries = [F.when(_filled(probe(t)), probe(t)) for t in range(PROBES)]
        walk = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda t: F.get(m, F.pmod(i + t * (F.pmod(F.xxhash64(i), F.lit(BINS)).cast("int") * 2 + 1), F.lit(BINS))))
        return F.coalesce(F.when(_filled(x), x), *tries, F.get(F.filter(walk, _filled), F.lit(0)), F.lit(0).cast("bigint"))

    packed = F.transform(m, lambda x, i: (value(x, i).bitwiseAND(F.lit((1 << BITS) - 1)) - (1 << (BITS - 1))).cast("tinyint"))
    return out.withColumn(name, F.when(F.size(m) > 0, packed)).drop(w, h, s, m)


def as_hex(fingerprint: str) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("int") + (1 << (BITS - 1))), BITS // 4, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """The similarity that the share of equal bins shows, less what unrelated bits share by chance; 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / BINS
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))


def with_next(df: DataFrame, key: str, tie: Column, columns: dict[str, str], rows_per_bucket: int = 2000) -> DataFrame:
    """df with further columns: those of the next row by ascending key (after the last: the first).

    columns: new name -> column of df. Rows are dealt into ranges of the key. The first row of each range also visits
    the range before (the table's first row: the last range), so each row finds its next in its own range. Rows of the
    same key follow in the order of tie; a row without key is its own next.
    """
    cuts = quantile_cuts(df.select(key), key, rows_per_bucket)
    k = F.col(key).cast("bigint")
    spread = -1 - F.pmod(tie, F.lit(256)).cast("int")
    if cuts:
        bounds = cuts_array(cuts)
        home = F.when(k.isNull(), spread).otherwise(bucket_of(k, cuts) - 1)
        before = F.when(F.col("_home") == 0, len(cuts) - 1).otherwise(F.col("_home") - 1)
        first = (F.col("_home") >= 0) & (F.get(bounds, F.col("_home")) == k)
    else:
        home, before, first = spread, F.lit(0), F.lit(False)
    visits = F.when(first, F.array(F.struct(F.col("_home").alias("at"), F.lit(0).alias("guest")), F.struct(before.alias("at"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("_home").alias("at"), F.lit(0).alias("guest"))))
    placed = df.withColumn("_tie", tie).withColumn("_home", home).withColumn("_visit", F.explode(visits)).withColumns({"_at": F.col("_visit.at"), "_guest": F.col("_visit.guest")})
    w = Window.partitionBy("_at").orderBy("_guest", key, "_tie")
    out = placed.withColumns({new: F.when(F.col("_at") < 0, F.col(old)).otherwise(F.lead(old).over(w)) for new, old in columns.items()})
    return out.filter("_guest = 0").drop("_tie", "_home", "_visit", "_at", "_guest")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_chars, the fingerprint, that of its edited text, and its likeness to that and to the next document's.

    The edited text: the last floor(n_chars / 4) code points are replaced by the first as many of the next document,
    by ascending doc_id (rows of one doc_id: by the text's hash; a row without doc_id is its own next). Null texts
    count as empty; texts without words have one fingerprint, like only to itself. Only the two columns are read, whatever
    the others are called; each text is shuffled once, with its successor's, so the two must fit into a row (2 GB); an empty
    table gives an empty one.
    """
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = with_fingerprint(base, "text", "fp")
    chained = with_next(marked, "doc_id", F.xxhash64("text"), {"next_text": "text", "next_fp": "fp"})
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = chained.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.substring("text", F.lit(1), n - q), F.substring("next_text", F.lit(1), q)).alias("edited"))
    both = with_fingerprint(edited, "edited", "edited_fp")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_hex("fp").alias("fingerprint"), as_hex("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
