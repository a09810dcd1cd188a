"""MinHash near-duplicates with tensored banding, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.llm.shared import components, documents, stored
from returnlens.llm.words import BASE, blocks, mix, word_hashes

HASHES_PER_BAND = 3
MISS = 1e-4
PAIRS_PER_SALT = 500
BITMAP = 1 << 25
PROFILE = "doc_id long, check long, key long, n_shingles long, h1 long, h2 long, bands array<long>"


def bands_per_side(percent: int, per_band: int = HASHES_PER_BAND, miss: float = MISS) -> int:
    """Sub-bands in each of the two collections: the fewest with which a pair at the threshold
    shares none on one of the sides with at most the given probability."""
    agree = (percent / 100) ** per_band
    return int(np.ceil(np.log(miss / 2) / np.log1p(-agree)))


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts laid end to end, and the n + 1 bounds.

    With fewer words than a shingle has, the whole sequence is one shingle; without words, none.
    """
    hashes, bounds = word_hashes(column)
    counts = np.diff(bounds)
    rolled = hashes.copy()
    for step in range(1, words):
        rolled[:len(hashes) - step] = mix(rolled[:len(hashes) - step] * BASE + hashes[step:])
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(hashes)) + words <= bounds[1:][doc]
    short = np.flatnonzero((counts > 0) & (counts < words))
    extra = np.zeros(len(short), dtype=np.uint64)
    for i, d in enumerate(short):
        value = np.array([counts[d]], dtype=np.uint64)
        for h in hashes[bounds[d]:bounds[d + 1]]:
            value = mix(value * BASE + h)
        extra[i] = value[0]
    doc = np.concatenate([doc[inside], short])
    values = np.concatenate([rolled[inside], extra])
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return values[fresh], np.searchsorted(doc[fresh], np.arange(len(counts) + 1))


def _profiles(words: int, sides: int, per_band: int):
    factors = np.random.default_rng(85).integers(0, 1 << 63, 2 * sides * per_band, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            values, bounds = shingle_sets(batch.column(3), words)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            starts = bounds[:-1][some]
            h = np.zeros((2, len(sizes)), dtype=np.uint64)
            keys = np.zeros((len(sizes), 2 * sides), dtype=np.uint64)
            if len(some):
                h[0, some] = np.add.reduceat(values, starts)
                h[1, some] = np.add.reduceat(mix(values), starts)
                for band in range(2 * sides):
                    key = np.full(len(some), band, dtype=np.uint64)
                    for factor in factors[band * per_band:(band + 1) * per_band]:
                        scrambled = values * factor
                        scrambled ^= scrambled >> np.uint64(32)
                        key = mix(key * BASE + np.minimum.reduceat(scrambled, starts))
                    keys[some, band] = key
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, 2 * sides, 0))]).astype(np.int32)
            flat = pa.array(keys[some].ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "check", "key", "n_shingles", "h1", "h2", "bands"])

    return run


def marked(ids: DataFrame) -> np.ndarray:
    """Bitmap of hashed ids (column ``place``). Its size is fixed: the more ids, the more places
    are shared, and the more rows pass that nobody asks for."""
    one = F.col("place") + 1  # the bitmap functions count from 1
    rows = (ids.select(F.bitmap_bucket_number(one).alias("bucket"), F.bitmap_bit_position(one).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    for row in rows:  # at most BITMAP / 32768
        out[(row.bucket - 1) * 4096:row.bucket * 4096] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def place_of(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITMAP))


def _sets(words: int, wanted):
    """Shingle sets of the rows (doc_id, check, text, place) whose place the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in blocks(batches, "text"):
            place = batch.column(3).to_numpy(zero_copy_only=False)
            own = batch.filter(pa.array((bits[place >> 3] >> (place & 7)) & 1 == 1))
            values, bounds = shingle_sets(own.column(2), words)
            sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*own.columns[:2], sets], ["doc_id", "check", "shingles"])

    return run


def linked(left: Column, right: Column, percent: int) -> Column:
    """Whether two shingle sets have at least the given Jaccard percentage."""
    shared = F.size(F.array_intersect(left, right))
    return F.lit(100) * shared >= F.lit(percent) * (F.size(left) + F.size(right) - shared)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets link. ``a`` may be in any number of pairs: they spread
    over salts, one per 500 of them, and its set is laid out once per salt."""
    often = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_SALT).cast("int").alias("salts"))
    spread = pairs.join(often, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    left = (sets.withColumnRenamed("rep", "a").join(often, "a")
            .select("a", F.col("shingles").alias("left"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right"))
    return (spread.join(right, "b").join(left, ["a", "salt"])
            .where(linked(F.col("left"), F.col("right"), percent)).select("a", "b"))


def candidate_tables(reps: DataFrame, sides: int) -> DataFrame:
    """(rep, x, key): tables in which a representative may meet another.

    A table's key combines a sub-band x of the first collection with one of the second. Keys are
    formed only of sub-bands that two representatives at least share.
    """
    rows = reps.select("rep", F.posexplode("bands").alias("band", "sub"))
    shared = rows.groupBy("sub").agg(F.count("*").alias("n")).where("n > 1").select("sub")
    alive = (rows.join(shared, "sub").groupBy("rep")
             .agg(F.collect_list(F.when(F.col("band") < sides, F.col("sub"))).alias("first"),
                  F.collect_list(F.when(F.col("band") >= sides, F.col("sub"))).alias("second")))
    return (alive.where("size(first) > 0 AND size(second) > 0").select("rep", F.explode("first").alias("x"), "second")
            .select("rep", "x", F.explode("second").alias("y")).select("rep", "x", F.xxhash64("x", "y").alias("key")))


def remaining_pairs(unresolved: DataFrame, percent: int) -> DataFrame:
    """Exact candidates among representatives (rep, component, shingles) of different components.

    Two sets that link share a shingle among the first n - ceil(n * percent / 100) + 1 of either, in
    any one order of all shingles; here the rarest come first. Size and place bound what a pair can
    still share.
    """
    n = F.size("shingles")
    rows = unresolved.select("rep", F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    own = rows.join(often, "s").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("own"))
    # Shingles of one set alone precede all others; how many there are is the size less the rest.
    alone = F.col("n") - F.size("own")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = (unresolved.select("rep", "component", n.alias("n")).join(own, "rep").where(alone < length)
              .select("rep", "component", "n", alone.alias("alone"), F.posexplode(F.slice("own", 1, (length - alone).cast("int"))))
              .select("rep", "component", "n", F.col("col.s").alias("s"), (F.col("pos") + F.col("alone")).alias("place")))
    x, y = prefix.alias("x"), prefix.alias("y")
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    fits = ((F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component"))
            & (F.lit(100) * F.least("x.n", "y.n") >= F.lit(percent) * F.greatest("x.n", "y.n"))
            & (F.lit(100 + percent) * rest >= F.lit(percent) * (F.col("x.n") + F.col("y.n"))))
    return x.join(y, (F.col("x.s") == F.col("y.s")) & fits).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents (doc_id, text), and its ``key`` if
    the rows have a unique one (long) of that name.

    1. Equal sets fall together: one representative each, which stands for its copies from there on.
    2. Tensored banding puts representatives into tables. In a bucket all others are held against
       its smallest member, on full sets; so a bucket costs its length, not its square.
    3. Where a bucket's other members then lie in more than one component, they and the members of
       the other buckets of its first sub-band go to ``remaining_pairs``, which misses no pair, and
       what links there is joined on.

    ``component_id`` is the smallest id of the rows that links reach (null if none of them has one).
    Of every component one row is ``kept``: of that id, and if several have it, or none, the first. Rows
    with a null id or an id that repeats are documents of their own. A null or empty text has no set
    and links with nothing; a short text is one shingle; other columns play no part; an empty table
    gives no rows.
    """
    sides = bands_per_side(percent)
    own = F.lit(None).cast("long") if key is None else F.col(key)
    texts = docs.select("doc_id", F.xxhash64("text").alias("check"), own.alias("key"), "text")
    profiles = texts.mapInArrow(_profiles(words, sides, HASHES_PER_BAND), PROFILE)
    profiles = stored(profiles.withColumn("key", F.coalesce("key", F.monotonically_increasing_id())), "profiles")
    same = ["h1", "h2", "n_shingles"]
    # The first row of a group: smallest id, null last, then smallest key.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    groups = (profiles.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("doc_id", "check", "bands")).alias("best"), first)
              .select(*same, F.monotonically_increasing_id().alias("rep"), F.col("best.doc_id").alias("doc_id"), F.col("best.check").alias("check"), "best.bands", "first"))
    groups = stored(groups, "groups")
    tables = stored(candidate_tables(groups, sides), "tables")
    centres = tables.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("key", "a")
    met = stored(tables.join(centres, "key").where("a < rep"), "met")
    stars = met.select("a", F.col("rep").alias("b")).distinct()
    involved = groups.join(met.select(F.explode(F.array("a", "rep")).alias("rep")).distinct(), "rep", "left_semi")
    bits = docs.sparkSession.sparkContext.broadcast(marked(involved.select(place_of("doc_id", "check").alias("place"))))
    marks = texts.select("doc_id", "check", "text", place_of("doc_id", "check").alias("place"))
    found = stored(marks.mapInArrow(_sets(words, bits), "doc_id long, check long, shingles array<long>"), "found")
    named = involved.select("rep", F.col("doc_id").alias("_d"), F.col("check").alias("_c"))
    matched = found.join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("check") == F.col("_c")))
    sets = stored(matched.select("rep", "shingles").dropDuplicates(["rep"]), "sets")
    links = stored(confirm(stars, sets, percent), "links")
    labelled = met.join(components(links), F.col("rep") == F.col("node"), "left").select(
        "key", "x", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = stored(labelled, "labelled")
    open_buckets = labelled.groupBy("x", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    members = labelled.select("x", "rep", "component").distinct()
    unresolved = members.join(open_buckets.select("x").distinct(), "x", "left_semi").select("rep", "component").distinct()
    pairs = stored(remaining_pairs(unresolved.join(sets, "rep"), percent), "pairs")
    joined = components(links.union(confirm(pairs, sets, percent)))
    placed = stored(groups.join(joined, F.col("rep") == F.col("node"), "left").select(*same, "first", F.coalesce("component", "rep").alias("component")), "placed")
    heads = placed.groupBy("component").agg(F.min("first").alias("head"))
    final = placed.join(heads, "component").select(*same, "head")
    chosen = F.coalesce(F.col("head.key") == F.col("key"), F.lit(True))
    component = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    rows = profiles.join(final, same, "left").select("doc_id", "n_shingles", component.alias("component_id"), chosen.alias("kept"), "key")
    return rows.drop("key") if key is None else rows.withColumnRenamed("key", key)


def kept_rows(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of every component of documents (doc_id, text), with all its columns."""
    rows = stored(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("key")), "rows")
    gone = near_duplicates(rows.select("row.doc_id", "row.text", "key"), words, percent, "key").where("NOT kept").select("key")
    return rows.join(gone, "key", "left_anti").select("row.*")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)
