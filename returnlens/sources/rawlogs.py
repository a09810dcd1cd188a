"""Raw log files: one pass over their lines, and from there identity, dialect, records and row numbers.

The files are read once, split-wise, as lines, and stored with the place each line has in its split.
All else is computed from that table: how many lines stand before a split gives every line its number
in the file; sums over the lines give the file an identity that knows their order; where a quoted
field is open at the end of a line, the lines up to its close make one record. None of it depends on
the size of the splits or on the other files of the batch.
"""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returnlens.functions import rules
from returnlens.operators.canonical import canonicalize, spread

DELIMITERS = (";", ",")
DEFAULT_DELIMITER = ";"
UTF8, LATIN1 = "UTF-8", "ISO-8859-1"
BYTE_ORDER_MARK = "\ufeff"
# Two primes under 2**31, so that products fit a long, and a base for each.
DIGEST_FIELDS = ((2147483647, 1103515245), (2147483629, 69069))
POWER_DIGITS = 6  # base-256 digits of a line number
LOCAL_BITS = 33  # of a row's place in its partition
Store = Callable[[DataFrame, str], DataFrame]


def detect_separator(header: Column) -> Column:
    """``;`` if the header line has one, else ``,``, else ``;``."""
    chain = F.when(header.contains(DELIMITERS[0]), DELIMITERS[0])
    for delimiter in DELIMITERS[1:]:
        chain = chain.when(header.contains(delimiter), delimiter)
    return chain.otherwise(DEFAULT_DELIMITER)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, bytes, block, at, value) of every line; ``block`` is where its split starts, ``at`` grows
    within a split without gaps. Only a line feed ends a line: it never occurs inside a UTF-8 character."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def power(base: int, exponent: Column, prime: int) -> Column:
    """``base ** exponent`` modulo a prime, by tables for the digits of the exponent."""
    result = F.lit(1).cast("long")
    for digit in range(POWER_DIGITS):
        table = [pow(base, d << (8 * digit), prime) for d in range(256)]
        place = F.shiftrightunsigned(exponent, 8 * digit).bitwiseAND(F.lit(255)).cast("int")
        result = result * F.get(F.lit(table).cast("array<long>"), place) % prime
    return result


def _quotes(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit('"'), F.lit("")))


def describe_splits(lines: DataFrame) -> DataFrame:
    """One row per split (path, block): its lines, their digests and what the dialect depends on.

    ``d0`` and ``d1`` are polynomials in the line hashes. Multiplied by the base to the power of the
    lines before, those of a file's splits add up to the polynomial of the whole file.
    """
    local = F.col("at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    digests = [F.sum(F.pmod(F.xxhash64("value"), F.lit(p)) * power(b, local, p) % p).alias(f"d{k}") for k, (p, b) in enumerate(DIGEST_FIELDS)]
    splits = lines.groupBy("path", "block").agg(
        F.max("bytes").alias("bytes"), F.count("*").alias("lines"), F.min("at").alias("first"), F.min_by("value", "at").alias("header"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(_quotes(F.col("value")) % 2 == 1).alias("odd"),
        F.bit_xor(F.xxhash64("value")).alias("xor"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("sum"), *digests)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("start", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    skipped = F.col("first").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    for k, (p, b) in enumerate(DIGEST_FIELDS):
        own = F.col(f"d{k}") % p * power(pow(b, -1, p), skipped, p) % p
        placed = placed.withColumn(f"d{k}", own * power(b, F.col("start"), p) % p)
    return placed


def describe_files(splits: DataFrame) -> DataFrame:
    """One row per file: ``file_hash``, header, separator, encoding, whether a quoted field may span
    lines, and ``problema``, why the file cannot be read (null: it can).

    One rule for every size: the digest covers length, lines, their hashes and their order.
    """
    sums = [(F.sum(f"d{k}") % p).cast("string") for k, (p, _) in enumerate(DIGEST_FIELDS)]
    files = splits.groupBy("path").agg(
        F.min_by("header", "block").alias("header"), F.bool_and("utf8").alias("utf8"), F.bool_or("odd").alias("multiline"),
        F.md5(F.concat_ws(":", F.max("bytes"), F.sum("lines"), F.bit_xor("xor"), F.sum("sum").cast("string"), *sums)).alias("file_hash"))
    header = F.when(F.col("utf8"), F.col("header")).otherwise(F.decode(F.col("header").cast("binary"), LATIN1))
    header = F.regexp_replace(header, f"^{BYTE_ORDER_MARK}|\r$", "")
    separator = detect_separator(F.col("header"))
    names = F.transform(F.split(F.replace(F.lower("header"), F.lit('"'), F.lit("")), F.concat(F.lit("["), F.col("separator"), F.lit("]"))), F.trim)
    wanted = F.arrays_overlap(names, F.lit(list(rules.REQUIRED_ANY)))
    return (files.withColumn("header", header).withColumn("separator", separator)
            .select("path", "file_hash", "header", "separator", F.when(F.col("utf8"), UTF8).otherwise(LATIN1).alias("encoding"), "multiline",
                    F.when(~wanted, F.lit(f"nenhuma das colunas {', '.join(rules.REQUIRED_ANY)}")).alias("problema")))


def _open_after(text: Column, separator: str) -> Column:
    """Whether a line that starts outside quotes ends inside a quoted field (escaped quotes removed)."""
    closed = F.regexp_replace(text, f'(^|{separator})[ \\t]*"[^"]*"(?=[ \\t\\r]*(?:{separator}|$))', "$1")
    return F.regexp_like(closed, F.lit(f'(?:^|{separator})[ \\t]*"'))


def _transitions(value: Column, separator: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted field, if it starts outside one, and if it starts inside."""
    plain = F.replace(value, F.lit('""'), F.lit(""))
    closing = f'"(?=[ \\t\\r]*(?:{separator}|$))'
    rest = F.regexp_extract(plain, f"(?s){closing}(.*)$", 1)
    none = ~F.contains(plain, F.lit('"'))
    outside = ~none & _open_after(plain, separator)
    inside = none | ~F.regexp_like(plain, F.lit(closing)) | _open_after(rest, separator)
    return outside, inside


def joined_records(lines: DataFrame, store: Store) -> DataFrame:
    """Records (path, file_hash, separator, header, linha, text) of lines whose quoted fields may span lines.

    A line maps the state before it (outside or inside a quoted field) to the state behind it. Lines
    that set the state, and lines that turn it round, compose: the state anywhere follows from the
    last setting and the turns since, within a split by a window and over the splits by their sums. A
    field that never closes is none: from its first line on, lines are records of their own.
    """
    keep = ["path", "block", "file_hash", "separator", "header", "linha", "text"]
    chosen = [_transitions(F.col("text"), d) for d in DELIMITERS]
    outside, inside = (F.when(F.col("separator") == DELIMITERS[0], a).otherwise(b) for a, b in zip(*chosen))
    marked = lines.withColumn("_o", outside).withColumn("_i", inside)
    marked = marked.withColumn("_turn", (F.col("_o") & ~F.col("_i")).cast("int"))
    split = Window.partitionBy("path", "block").orderBy("linha")
    turned = marked.withColumn("_turns", F.sum("_turn").over(split))
    setting = F.when(F.col("_o") == F.col("_i"), F.col("_o").cast("int").bitwiseXOR((F.col("_turns") % 2).cast("int")))
    here = store(turned.withColumn("_set", setting).select(*keep, "_turn", "_turns", "_set"), "linhas_marcadas")
    sums = here.groupBy("path", "block").agg(F.sum("_turn").alias("t"), F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col("linha"))).alias("s"))
    file = Window.partitionBy("path").orderBy("block")
    sums = sums.withColumn("_all", F.sum("t").over(file))
    # A setting, seen from the start of the file, counts the turns of the splits before its own.
    fixed = F.col("s").bitwiseXOR(((F.col("_all") - F.col("t")) % 2).cast("int"))
    sums = sums.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(file))
    state = F.coalesce("_fixed", F.lit(0)).bitwiseXOR((F.col("_all") % 2).cast("int"))
    entering = sums.select("path", "block", F.coalesce(F.lag(state).over(file), F.lit(0)).alias("_enter"))
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    known = here.join(F.broadcast(entering), ["path", "block"])
    last = F.coalesce(F.last("_set", ignorenulls=True).over(before), F.col("_enter"))
    open_before = last.bitwiseXOR(((F.col("_turns") - F.col("_turn")) % 2).cast("int"))
    started = known.withColumn("_start", F.when(open_before == 0, F.col("linha")))
    started = store(started.withColumn("_record", F.max("_start").over(split)).select(*keep, "_start", "_record", "_set", "_turns", "_enter"), "linhas_abertas")
    ends = started.groupBy("path", "block").agg(
        F.max("_start").alias("_last"), F.max_by(F.struct("_set", "_turns"), "linha").alias("e"),
        F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col("linha"))).alias("s"), F.max("_enter").alias("_enter"))
    left_open = F.coalesce("s", "_enter").bitwiseXOR((F.col("e._turns") % 2).cast("int"))
    carried = F.max("_last").over(file.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("path", "block", carried.alias("_carried"), "_last", left_open.alias("_open"))
    never = ends.groupBy("path").agg(F.max_by("_open", "block").alias("_open"), F.max("_last").alias("_from"))
    never = never.select("path", F.when(F.col("_open") == 1, F.col("_from")).alias("_never"))
    placed = started.join(F.broadcast(ends.select("path", "block", "_carried")), ["path", "block"]).join(F.broadcast(never), "path")
    record = F.when(F.col("linha") >= F.col("_never"), F.col("linha")).otherwise(F.coalesce("_record", "_carried"))
    grouped = placed.withColumn("_record", record).groupBy("path", "file_hash", "separator", "header", "_record").agg(
        F.array_sort(F.collect_list(F.struct("linha", "text"))).alias("parts"))
    return grouped.select("path", "file_hash", "separator", "header", F.col("_record").alias("linha"), F.array_join("parts.text", "\n").alias("text"))


def read_records(lines: DataFrame, splits: DataFrame, files: DataFrame, store: Store) -> DataFrame:
    """Records (path, file_hash, separator, header, linha, text) of the given files, without header and
    blank lines; ``linha`` is the number of a record's first line in its file, from 0 for the header."""
    known = files.select("path", "file_hash", "separator", "header", "encoding", "multiline")
    placed = splits.select("path", "block", "start", "first").join(known, "path")
    text = F.when(F.col("encoding") == UTF8, F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), LATIN1))
    # The stored lines are compressed, so their scan has few splits for the work on their text, and by its size the
    # planner would broadcast them. What goes to every task is a row per split.
    rows = spread(lines.select("path", "block", "at", "value")).join(F.broadcast(placed), ["path", "block"]).select(
        "path", "block", "file_hash", "separator", "header", "multiline", (F.col("start") + F.col("at") - F.col("first")).alias("linha"), text.alias("text"))
    rows = rows.where("linha > 0")
    single = rows.where("NOT multiline").select("path", "file_hash", "separator", "header", "linha", "text")
    several = files.where("multiline").limit(1).count() > 0
    records = single.union(joined_records(rows.where("multiline").drop("multiline"), store)) if several else single
    return records.withColumn("text", F.regexp_replace("text", "\r$", "")).where(F.trim("text") != "")


def header_names(header: str, separator: str) -> list[str]:
    """Column names of a header line, trimmed and in lower case."""
    return [name.strip().lower() for name in next(csv.reader([header], delimiter=separator), [])]


def parse_records(records: DataFrame, files: DataFrame, ingest_ts: Column) -> DataFrame:
    """Canonical columns of all records, with ``log_id``, ``file_hash``, ``linha`` and ``rejeitada``, the
    text of a record that does not fit its header (null: it fits).

    Every header is parsed by its own schema; headers are collected, files are not. Of a file only the
    canonical columns go on, so its names never meet the engine's. ``log_id`` is the file's identity
    and the line number.
    """
    tables = []
    for r in files.select("separator", "header").distinct().collect():
        names = header_names(r.header, r.separator)
        schema = ", ".join([*(f"c{i} STRING" for i in range(len(names))), "ruim STRING"])
        options = {"sep": r.separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "ruim", "multiLine": "true"}
        own = records.where((F.col("header") == r.header) & (F.col("separator") == r.separator))
        parsed = own.select("file_hash", "linha", "text", F.from_csv("text", schema, options).alias("valores"))
        wanted = {n: i for i, n in enumerate(names) if n in (*rules.COLUMN_DEFAULTS, *rules.PROTOCOL_COLUMNS, *rules.DATE_COLUMNS)}
        engine = F.struct("file_hash", "linha", F.when(F.col("valores.ruim").isNotNull(), F.col("text")).alias("rejeitada")).alias("motor")
        named = parsed.select(engine, *(F.col(f"valores.c{i}").alias(n) for n, i in wanted.items()))
        tables.append(canonicalize(named, ingest_ts, keep=("motor",)))
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    log_id = F.concat_ws("_", F.lit("log"), "motor.file_hash", "motor.linha")
    return rows.select(log_id.alias("log_id"), *(c for c in rows.columns if c != "motor"), "motor.*")
