"""Document fingerprints: a Merkle tree over spans, paragraphs and sections, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returnlens.llm.shared import documents, ranked, stored

SPAN_WORDS = 8
SPAN = f"[ \\n]*+(?:[^ \\n]++ *+){{1,{SPAN_WORDS}}}+\\n*+|[ \\n]++"
NULL_KEY = -(1 << 63)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the fingerprint of a text column, a string ``root:sections:paragraphs:spans``.

    The leaves are spans of up to eight words of one line; a line is a paragraph; a section ends
    behind a blank line or a paragraph whose last digest starts with 0 to 3, so that an insertion
    moves no later boundary. Every node is the digest of its children's; the root keeps all its
    digits, other nodes eight, grouped by their parents with semicolons.
    """
    leaf, levels = f"_{name}_leaves", f"_{name}_levels"
    return (
        df.withColumn(leaf, F.expr(f"""transform(transform(regexp_extract_all({text}, '{SPAN}', 0),
            s -> concat(md5(s), CASE WHEN endswith(s, '\\n\\n') THEN '/' WHEN endswith(s, '\\n') THEN ';' ELSE ',' END)),
            x -> IF(endswith(x, ';') AND x < '4', concat(left(x, 32), '/'), x))"""))
        .withColumn(levels, F.expr(f"""transform(split(array_join({leaf}, ''), '/'), s -> transform(split(s, ';'), p -> sha2(p, 256)))"""))
        .withColumn(f"_{name}_sections", F.expr(f"transform({levels}, p -> sha2(array_join(p, ''), 256))"))
        .withColumn(name, F.expr(f"""concat_ws(':', sha2(array_join(_{name}_sections, ''), 256),
            array_join(transform(_{name}_sections, h -> left(h, 8)), ','),
            array_join(transform({levels}, p -> array_join(transform(p, h -> left(h, 8)), ',')), ';'),
            array_join(transform({leaf}, x -> concat(left(x, 8), IF(endswith(x, ','), ',', ';'))), ''))"""))
        .drop(leaf, levels, f"_{name}_sections"))


def root(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, ":", 1)


def likeness(left: Column, right: Column) -> Column:
    """1 for equal roots, else twice the common spans over all spans, each text's distinct ones."""
    spans = [F.array_remove(F.split(F.substring_index(f, ":", -1), "[,;]"), "") for f in (left, right)]
    a, b = (F.array_distinct(s) for s in spans)
    total = F.size(a) + F.size(b)
    return F.when(root(left) == root(right), F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(
        2.0 * F.size(F.array_intersect(a, b)) / total)


def changed_paragraphs(left: Column, right: Column) -> Column:
    """Numbers, from 0, of the paragraphs of ``left`` whose node ``right`` has not; none for equal roots."""
    nodes = [F.split(F.split(f, ":").getItem(2), "[,;]") for f in (left, right)]
    moved = F.filter(F.transform(nodes[0], lambda h, i: F.when(~F.array_contains(nodes[1], h), i)), lambda i: i.isNotNull())
    return F.when(root(left) == root(right), F.array().cast("array<int>")).otherwise(moved)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document (doc_id, text), of its text with the last half of the code
    points replaced by as many of the next document's first ones, and their likeness.

    The next document is the one with the next smaller id; after the last comes the first. Ids
    alone are sorted; texts move once, by id, and each document then sends its neighbour its
    fingerprint and the part that it borrows. A null text is empty; a null id comes last; of
    rows that repeat an id the smallest text is what a neighbour borrows, and a repeated row is
    fingerprinted like any other. Other columns play no part; an empty table gives no rows.
    """
    own = docs.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    lengths = own.groupBy("key").agg(F.max(F.char_length("text")).alias("n")).withColumn("all", F.lit(0))
    order = stored(ranked(lengths, ["all"], [F.col("all"), F.col("key").desc()]).select("key", "n", "rank"), "order")
    last = order.agg(F.count("*")).first()[0]
    before = order.select(F.col("key").alias("neighbour"), F.floor(F.col("n") / 2).cast("int").alias("need"),
                          F.when(F.col("rank") == last, 1).otherwise(F.col("rank") + 1).alias("rank"))
    lends = order.select("key", "rank").join(before, "rank").select("key", "neighbour", "need")
    first = F.row_number().over(Window.partitionBy("key").orderBy("text"))
    lender = own.join(lends.hint("merge"), "key").withColumn("place", first).where("place = 1")
    lent = with_fingerprint(lender, "text", "next").select(
        F.col("neighbour").alias("key"), F.expr("left(text, need)").alias("borrowed"), "next")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = (own.join(lent.hint("merge"), "key")
              .withColumn("edited", F.concat(F.left("text", n - half), F.left("borrowed", half))).withColumn("n_chars", n.cast("long"))
              .select("key", "n_chars", "text", "edited", "next"))
    both = with_fingerprint(with_fingerprint(edited, "text", "fingerprint"), "edited", "edited_fingerprint")
    return both.select(
        F.nullif("key", F.lit(NULL_KEY)).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))


def op1_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))


def _sql_fingerprint(source: str, text: str, name: str) -> str:
    return f"""
{name}_leaf AS (
  SELECT *, list_transform(list_transform(regexp_extract_all({text}, '[ \\n]*(?:[^ \\n]+ *){{1,{SPAN_WORDS}}}\\n*|[ \\n]+'),
      lambda s: md5(s) || CASE WHEN ends_with(s, chr(10) || chr(10)) THEN '/' WHEN ends_with(s, chr(10)) THEN ';' ELSE ',' END),
      lambda x: CASE WHEN ends_with(x, ';') AND x < '4' THEN left(x, 32) || '/' ELSE x END) AS leaf
  FROM {source}),
{name}_levels AS (
  SELECT *, list_transform(string_split(list_aggregate(leaf, 'string_agg', ''), '/'),
      lambda s: list_transform(string_split(s, ';'), lambda p: sha256(p))) AS levels
  FROM (SELECT * REPLACE (CASE WHEN len(leaf) = 0 THEN [''] ELSE leaf END AS leaf) FROM {name}_leaf)),
{name}_sections AS (SELECT *, list_transform(levels, lambda p: sha256(list_aggregate(p, 'string_agg', ''))) AS sections FROM {name}_levels),
{name}_done AS (
  SELECT * EXCLUDE (leaf, levels, sections), sha256(list_aggregate(sections, 'string_agg', '')) || ':' ||
      list_aggregate(list_transform(sections, lambda h: left(h, 8)), 'string_agg', ',') || ':' ||
      list_aggregate(list_transform(levels, lambda p: list_aggregate(list_transform(p, lambda h: left(h, 8)), 'string_agg', ',')), 'string_agg', ';') || ':' ||
      list_aggregate(list_transform(leaf, lambda x: CASE WHEN x = '' THEN '' ELSE left(x, 8) || CASE WHEN ends_with(x, ',') THEN ',' ELSE ';' END END), 'string_agg', '') AS {name}
  FROM {name}_sections)"""


def _sql_likeness(left: str, right: str) -> str:
    spans = [f"list_distinct(list_filter(regexp_split_to_array(split_part({f}, ':', 4), '[,;]'), lambda x: x <> ''))" for f in (left, right)]
    return (f"CASE WHEN split_part({left}, ':', 1) = split_part({right}, ':', 1) THEN 1.0 WHEN len({spans[0]}) + len({spans[1]}) = 0 THEN 0.0 "
            f"ELSE 2.0 * len(list_intersect({spans[0]}, {spans[1]})) / (len({spans[0]}) + len({spans[1]})) END::DOUBLE")


OP1_SQL = f"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_sql_fingerprint("own", "text", "fingerprint")},
paired AS (
  SELECT *, coalesce(lead(text) OVER later, first_value(text) OVER later) AS next_text,
         coalesce(lead(fingerprint) OVER later, first_value(fingerprint) OVER later) AS next
  FROM fingerprint_done WINDOW later AS (ORDER BY doc_id DESC NULLS LAST)),
edits AS (
  SELECT doc_id, length(text)::BIGINT AS n_chars, fingerprint, next,
         left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited
  FROM paired),
{_sql_fingerprint("edits", "edited", "edited_fingerprint")}
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       {_sql_likeness("fingerprint", "edited_fingerprint")} AS near_edited, {_sql_likeness("fingerprint", "next")} AS near_next
FROM edited_fingerprint_done
"""
