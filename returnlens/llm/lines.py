"""Removal of repeated passages by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.llm.near import marked, place_of
from returnlens.llm.shared import documents, free_name, joined_spread, stored

LINES_PER_CHUNK = 4
LONG_LINE_WORDS = 50
PASSAGE_WORDS = 20
WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of every document from the line pairs and long lines that other documents share.

    A chunk ends where the hash of the two lines at hand is divisible, whatever stands around it.
    Between two such ends the lines whose pairs are all shared are one unit, two lines at least; what
    lies before a run's first end or behind its last, or has one line, gives its pairs, one by one.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    for batch in batches:
        out = []
        for doc_id, check, items in zip(*(batch.column(i).to_pylist() for i in range(3))):
            pairs = {i["at"]: i["item"] for i in items if not i["alone"]}
            out += [(doc_id, check, i["at"], 1, False) for i in items if i["alone"]]
            for at in sorted(pairs):
                if at - 1 in pairs:
                    continue
                stop = at
                while stop in pairs:
                    stop += 1
                ends = [i for i in range(at, stop) if pairs[i] % LINES_PER_CHUNK == 0]
                whole = [(a + 1, b + 1) for a, b in zip(ends, ends[1:]) if b - a > 1]
                out += [(doc_id, check, a, b - a, True) for a, b in whole]
                inside = {i for a, b in whole for i in range(a, b - 1)}
                out += [(doc_id, check, i, 2, False) for i in range(at, stop) if i not in inside]
        columns = zip(*out) if out else ([],) * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "check", "start", "size", "chunk"])


def _holding(bits, held: bool = True):
    """Rows whose place (the last column) the bitmap holds, or does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((bits.value[place >> 3] >> (place & 7)) & 1 == int(held)))

    return run


def earlier_units(units: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Those of the units (doc_id, check, start, size) that a document of a smaller id holds byte for byte.

    Texts (doc_id, check, text) are cut once per document. A unit that a large part of the documents
    holds spreads over many tasks.
    """
    key = ["doc_id", "check"]
    grouped = units.groupBy(*key).agg(F.collect_set(F.struct("start", "size")).alias("units"))
    cut = F.expr("""transform(array(split(text, '\\n', -1)), l -> transform(units, u -> struct(
        u.start AS start, u.size AS size, array_join(slice(l, u.start + 1, u.size), '\\n') AS lines)))[0]""")
    held = stored(grouped.hint("merge").join(wanted, key).select(*key, F.inline(cut)), f"{name}_held")
    first = held.groupBy("lines", "size").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows"))
    first = stored(first.where("first < last").select(F.xxhash64("lines").alias("hash"), F.col("lines").alias("bytes"), F.col("size").alias("many"), "first", "rows"), f"{name}_first")
    same = (F.col("bytes") == F.col("lines")) & (F.col("many") == F.col("size")) & (F.col("first") < F.col("doc_id"))
    return joined_spread(held.withColumn("hash", F.xxhash64("lines")), first, "hash", "rows", ("doc_id", "start"), same).select(*key, "start", "size")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, check, start, size) of lines of a document (doc_id, text) that, two or more in a row or one
    long one, a document of a smaller id holds byte for byte; ``check`` is the text's hash.

    Line pairs and long lines are counted by hash over all documents; those that two documents share
    go on. Chunks are compared first. The pairs of chunks that nobody holds whole, and the pairs
    outside of chunks, are compared exactly, so no repeated pair is missed wherever it stands.
    """
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("check"))
    hashed = texts.select("doc_id", "check", F.expr("transform(split(text, '\\n', -1), l -> struct(xxhash64(l) AS h, regexp_count(l, r'[^ \\t\\n\\x0B\\f\\r]+') AS w))").alias("lines"))
    items = hashed.select("doc_id", "check", F.explode(F.expr(f"""concat(
        transform(slice(lines, 2, greatest(size(lines) - 1, 0)), (l, i) -> struct(i AS at, xxhash64(lines[i].h, l.h) AS item, false AS alone)),
        filter(transform(lines, (l, i) -> IF(l.w > {LONG_LINE_WORDS}, struct(i AS at, xxhash64(l.h, 1) AS item, true AS alone), NULL)), x -> x IS NOT NULL))""")).alias("i")).select("doc_id", "check", "i.*")
    items = stored(items, "lines")
    shared = items.groupBy("item").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("item")
    found = items.join(shared.hint("merge"), "item").groupBy("doc_id", "check").agg(F.collect_set(F.struct("at", "item", "alone")).alias("items"))
    units = stored(found.mapInArrow(_chunks, "doc_id long, check long, start int, size int, chunk boolean"), "chunks")
    bits = docs.sparkSession.sparkContext.broadcast(marked(units.select(place_of("doc_id").alias("place"))))
    wanted = texts.withColumn("place", place_of("doc_id")).mapInArrow(_holding(bits), "doc_id long, text string, check long, place long")
    wanted = stored(wanted.drop("place").dropDuplicates(["doc_id", "check"]), "texts")
    unit = ["doc_id", "check", "start", "size"]
    chunks = stored(earlier_units(units.where("chunk").select(*unit), wanted, "chunks"), "repeated")
    # The pairs of all other chunks, those of first holders too: an earlier document may have them elsewhere.
    rest = units.where("chunk").join(chunks.hint("merge"), unit, "left_anti")
    inner = rest.select("doc_id", "check", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 2)).alias("start"), F.lit(2).alias("size"))
    pairs = earlier_units(units.where("NOT chunk").select(*unit).union(inner), wanted, "pairs")
    return chunks.union(pairs)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line ranges of a document that its repeated units cover together."""
    for batch in batches:
        rows = []
        for units in batch.column(2).to_pylist():
            joined: list[list[int]] = []
            for start, size in sorted((u["start"], u["size"]) for u in units):
                if joined and joined[-1][1] >= start:
                    joined[-1][1] = max(joined[-1][1], start + size)
                else:
                    joined.append([start, start + size])
            rows.append([{"start": a, "stop": b} for a, b in joined])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, kind)], ["_d", "_c", "_cuts"])


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """All documents with their columns, ``text`` without repeated passages, and the number of lines taken
    out, in a last column ``_removed`` (with more underscores in front if the documents have that).

    A passage is two lines or more in a row, together of at least ``PASSAGE_WORDS`` words, or a line of
    over ``LONG_LINE_WORDS``; it stays in the document of the smallest id that has it. Shorter ones,
    such as blank lines and closing brackets, stay everywhere, and so do repetitions within one
    document. Only texts that may lose lines move; all others pass by them. Null ids and null texts
    pass unchanged; rows that repeat an id never take from each other; an empty table gives no rows.
    """
    count = free_name(docs.columns, "_removed")
    units = repeated_lines(docs.select("doc_id", "text")).groupBy("doc_id", "check").agg(F.collect_set(F.struct("start", "size")).alias("units"))
    cuts = stored(units.mapInArrow(_ranges, "_d long, _c long, _cuts array<struct<start: int, stop: int>>"), "cuts")
    bits = docs.sparkSession.sparkContext.broadcast(marked(cuts.select(place_of("_d").alias("place"))))
    placed = docs.select(F.struct(*docs.columns).alias("_row"), place_of("doc_id").alias("_place"))
    touched = placed.mapInArrow(_holding(bits), placed.schema).withColumn("_h", F.xxhash64("_row.text"))
    joined = touched.join(cuts.hint("merge"), (F.col("_row.doc_id") == F.col("_d")) & (F.col("_h") == F.col("_c")), "left")
    # One element, so that a text is split once and not for every cut.
    split = joined.withColumn("_cuts", F.expr(f"""transform(array(split(_row.text, '\\n', -1)), l -> filter(_cuts, c ->
        regexp_count(array_join(slice(l, c.start + 1, c.stop - c.start), '\\n'), r'{WORD}') >= IF(c.stop - c.start > 1, {PASSAGE_WORDS}, {LONG_LINE_WORDS + 1})))[0]"""))
    kept = F.expr("array_join(filter(split(_row.text, '\\n', -1), (l, i) -> NOT exists(_cuts, c -> i >= c.start AND i < c.stop)), '\\n')")
    removed = F.expr("coalesce(aggregate(_cuts, 0, (n, c) -> n + c.stop - c.start), 0)")
    text = F.when(F.coalesce(F.size("_cuts"), F.lit(0)) > 0, kept).otherwise(F.col("_row.text"))
    cleaned = split.select(F.col("_row").withField("text", text).alias("_row"), removed.alias("_n"))
    others = placed.mapInArrow(_holding(bits, False), placed.schema).select("_row", F.lit(0).alias("_n"))
    return cleaned.union(others).select("_row.*", F.col("_n").alias(count))


def op7_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return remove_repeated_lines(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", F.col("_removed").cast("long").alias("removed_lines"), lines.cast("long").alias("kept_lines"), "text")
