"""Posting table over the texts of a lake, so that a text search reads the files and rows it may find.

For every run of three characters (gram) the table lists the rows of the nested table whose texts hold it:
by batch, event day, data file and row number in the file. A term is looked up by its grams; rows that
hold all of them are candidates, and the search itself then decides on the text, so its result is that
of the full scan.

Messages are compared without regard to case, protocols and entity values as they stand; the two
kinds have postings of their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.operators.filters import LogFilter
from returnlens.operators.model import LogModel
from returnlens.sources.silver import BATCH, DAY, NESTED, _read, _write, ledger, open_silver

POSTINGS = "indice_texto"
INDEXED = "lotes_indexados"
GRAM = 3
# Postings lie in this many folders by the gram's checksum, so a lookup lists few files.
FOLDERS = 64
# Rows of one file per posting row: the bound of its array.
BLOCK_ROWS = 1 << 16
# Characters that a task inverts at once.
PIECE_CHARS = 1 << 20
# Up to this many candidate files are named to the scan, which then opens no other; beyond, the join alone picks the rows.
MOST_FILES = 1000
MESSAGE, VALUE = "mensagem", "valor"
FILE, ROW = "arquivo", "linha"
PLACE = (BATCH, DAY, FILE, ROW)


def grams(text: Column) -> Column:
    """The distinct grams of a text; none of a shorter one. Linear in the text's length: its letters are
    split once, as the variable of a lambda."""

    def runs(letters: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(letters) - GRAM, F.lit(0)))
        return F.transform(places, lambda i: F.concat(*(F.get(letters, i + k) for k in range(GRAM))))

    found = F.get(F.transform(F.array(F.split(text, "")), runs), F.lit(0))
    return F.array_distinct(F.filter(found, lambda g: g.isNotNull()))


def _grams_of_all(texts: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), grams)))


def _located(spark: SparkSession, root: str) -> DataFrame:
    """The nested table with the place of every row; file and row come from the reader."""
    return spark.read.parquet(f"{root}/{NESTED}").withColumns({FILE: F.col("_metadata.file_name"), ROW: F.col("_metadata.row_index")})


def _inverted(piece_chars: int) -> Callable:
    """The task's part of the postings: batches of (campo, place, bloco, linha, textos) to rows per gram
    and block, with the sorted rows that hold the gram. Texts are taken in pieces of bounded length."""
    gram, columns = GRAM, ("campo", BATCH, DAY, FILE, "bloco")

    def invert(keys: list, rows, texts: list):
        import numpy as np
        import pyarrow as pa

        joined = "".join(texts)
        letters = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        starts = np.flatnonzero(owner[gram - 1:] == owner[:1 - gram])
        code = np.zeros(len(starts), np.int64)
        for k in range(gram):
            code = code << 21 | letters[starts + k]
        codes, which = np.unique(code, return_inverse=True)
        # Keys are few: the rows of a batch stand in a few files.
        number: dict = {}
        key_of = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)[owner[starts]]
        row_values, row_of = np.unique(rows, return_inverse=True)
        held = np.unique((key_of * len(codes) + which) * len(row_values) + row_of[owner[starts]])
        group, row = np.divmod(held, len(row_values))
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        of_key, of_code = np.divmod(group[first], len(codes))
        names = ["".join(chr(c >> 21 * k & 0x1FFFFF) for k in reversed(range(gram))) for c in codes.tolist()]
        known = list(number)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(held)].astype(np.int32)), pa.array(row_values[row]))
        return {"gram": pa.array([names[c] for c in of_code.tolist()], pa.string()), "linhas": lists,
                **{n: pa.array([known[k][i] for k in of_key.tolist()]) for i, n in enumerate(columns)}}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        order = [*columns, "gram", "linhas"]
        for batch in batches:
            keys, rows, texts, chars = [], [], [], 0
            # A row of several texts gives one entry for each.
            parts = zip(*(batch.column(c).to_pylist() for c in (*columns, ROW, "textos")))
            for *key, row, values in parts:
                for text in values:
                    if len(text) >= gram:
                        keys.append(tuple(key)), rows.append(row), texts.append(text)
                        chars += len(text)
                if chars >= piece_chars:
                    found = invert(keys, np.array(rows, np.int64), texts)
                    yield pa.RecordBatch.from_arrays([found[c] for c in order], order)
                    keys, rows, texts, chars = [], [], [], 0
            if texts:
                found = invert(keys, np.array(rows, np.int64), texts)
                yield pa.RecordBatch.from_arrays([found[c] for c in order], order)

    return run


def _postings(table: DataFrame) -> DataFrame:
    """Tasks invert the rows they read, batch by batch; only lists per gram and block then meet, so what
    is shuffled is the row numbers and not a row for every gram of every text."""
    texts = F.transform("rejeicoes.mensagem_original", lambda m: F.lower(m))
    values = F.concat(F.array("protocolo"), F.transform(F.flatten("rejeicoes.entidades"), lambda e: e["entidade_valor"]))
    block = F.floor(F.col(ROW) / BLOCK_ROWS).alias("bloco")
    both = F.array(*(F.struct(F.lit(kind).alias("campo"), F.array_distinct(F.filter(column, lambda t: t.isNotNull())).alias("textos"))
                     for kind, column in ((MESSAGE, texts), (VALUE, values))))
    rows = table.select(*PLACE, block, F.inline(both)).where(F.size("textos") > 0)
    key = ("campo", BATCH, DAY, FILE, "bloco")
    types = {**dict(rows.dtypes), "gram": "string", "linhas": "array<bigint>"}
    found = rows.mapInArrow(_inverted(PIECE_CHARS), ", ".join(f"{n} {types[n]}" for n in (*key, "gram", "linhas")))
    # Two texts of one row may stand in two pieces.
    together = F.array_sort(F.array_distinct(F.flatten(F.collect_list("linhas")))).alias("linhas")
    return found.groupBy("campo", "gram", *key[1:]).agg(together).withColumn("pasta", (F.crc32("gram") % FOLDERS).cast("int"))


def _rows_of(spark: SparkSession, root: str, batches: list[str]) -> DataFrame:
    """The rows of some batches where the scan reads them. A join would bring all rows of a batch to one task."""
    return _located(spark, root).where(F.col(BATCH).isin(batches))


def index_texts(spark: SparkSession, root: str) -> None:
    """Write the postings of every ingested batch that has none.

    A batch in the ledger is complete and never written anew, so its rows keep their places. A batch
    counts as indexed only when its postings are complete; what an interrupted run left is replaced.
    """
    done, batches = _read(spark, f"{root}/{INDEXED}"), ledger(spark, root)
    if batches is None or _read(spark, f"{root}/{NESTED}") is None:
        return
    fresh = batches.select(BATCH).distinct()
    # Fixed here, so that a batch that comes in meanwhile is left to the next call. One row per ingest.
    fresh = (fresh if done is None else fresh.join(done, BATCH, "left_anti")).collect()
    if not fresh:
        return
    chosen = spark.createDataFrame(fresh, f"{BATCH} string")
    postings = _postings(_rows_of(spark, root, [r[BATCH] for r in fresh]))
    order = (BATCH, "pasta", "campo", "gram", DAY, FILE)
    _write(postings.repartitionByRange(*order, "bloco").sortWithinPartitions(*order), f"{root}/{POSTINGS}", BATCH, "pasta")
    chosen.write.mode("append").parquet(f"{root}/{INDEXED}")


def is_indexed(spark: SparkSession, root: str) -> bool:
    """Whether every ingested batch has postings."""
    done, batches = _read(spark, f"{root}/{INDEXED}"), ledger(spark, root)
    return done is not None and batches is not None and batches.join(done, BATCH, "left_anti").isEmpty()


def _term_grams(spark: SparkSession, term: str, ignore_case: bool) -> list[str]:
    """Grams that a text with the term must hold: those of its parts between wildcards."""
    literal = F.lit(term)
    text = spark.range(1).select((F.lower(literal) if ignore_case else literal).alias("t")).first()["t"]
    parts = [part for part in re.split("[%_]", text) if part]
    if not parts:
        return []
    return spark.range(1).select(_grams_of_all(F.array(*map(F.lit, parts))).alias("g")).first()["g"]


def _holding(postings: DataFrame, kind: str, wanted: list[str]) -> DataFrame:
    """Places of the rows that hold all grams in texts of the kind."""
    folders = sorted({zlib.crc32(g.encode()) % FOLDERS for g in wanted})
    found = postings.where(F.col("pasta").isin(folders) & (F.col("campo") == kind) & F.col("gram").isin(wanted))
    rows = found.select(BATCH, DAY, FILE, F.explode("linhas").alias(ROW))
    return rows.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select(*PLACE)


def _lookup(spark: SparkSession, root: str, term: str) -> Callable[[str], DataFrame | None]:
    """By kind, the candidates of a term; ``None`` where it has no gram to look up."""

    def candidates(kind: str) -> DataFrame | None:
        wanted = _term_grams(spark, term, ignore_case=kind == MESSAGE)
        return _holding(spark.read.parquet(f"{root}/{POSTINGS}"), kind, wanted) if wanted else None

    return candidates


def _restricted(table: DataFrame, places: DataFrame) -> DataFrame:
    files = places.select(BATCH, DAY, FILE).distinct().limit(MOST_FILES + 1).collect()
    if len(files) <= MOST_FILES:
        for name in (BATCH, DAY, FILE):
            table = table.where(F.col(name).isin(sorted({f[name] for f in files})))
    return table.join(places, list(PLACE), "left_semi")


def open_indexed(spark: SparkSession, root: str, search: str = "", log_filter: LogFilter | None = None) -> LogModel:
    """Model of the logs under a filter that may hold a text in protocol, message or entity.

    Use it as ``detail_rows(open_indexed(spark, root, text, chosen), search=text)``. Only the candidates of the
    text, and of the filter's own texts, are read. A term without three plain characters in a row is not
    looked up, and a lake with batches that are not indexed is scanned; the rows are the same.
    """
    log_filter = log_filter or LogFilter()
    narrowed: list[DataFrame] = []
    if is_indexed(spark, root) and _read(spark, f"{root}/{POSTINGS}") is not None:
        for term, kinds in ((search, (MESSAGE, VALUE)), (log_filter.mensagem, (MESSAGE,)), (log_filter.protocolo, (VALUE,))):
            found = [c for c in map(_lookup(spark, root, term), kinds)] if term.strip() else [None]
            if all(c is not None for c in found):
                narrowed.append(reduce(DataFrame.union, found).distinct())
    if not narrowed:
        return open_silver(spark, root).where(log_filter)
    places = reduce(lambda a, b: a.join(b, list(PLACE), "left_semi"), narrowed)
    return LogModel.from_nested(_restricted(_located(spark, root), places).drop(FILE, ROW)).where(log_filter)
