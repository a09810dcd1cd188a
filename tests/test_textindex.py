"""Text search through postings, and detail pages from stored ranges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from returnlens import LogFilter
from returnlens.plans import detail
from returnlens.sources import textindex
from returnlens.sources.pages import DIRECTORY, ROWS, page_at, page_count, write_pages
from returnlens.sources.silver import NESTED, ingest, open_silver
from returnlens.sources.textindex import BATCH, POSTINGS, grams, index_texts, is_indexed, open_indexed
from tests.test_ingest import NAMES
from tests.test_scenarios import write_csv

TEXTS = ("Município de destino inválido: AÇÃO-{0:04}", "A placa ABC-{0:04} não pertence ao RNTRC 12345678.", "ΑΣ {0} ΑΣΒ 𝄞𝄞𝄞x", "100% _ {0}", "ab")


def log_row(i: int, day: int):
    return (f"PROT{day:02}{i:05}", f"{day:02}/01/2024 10:00:00", f"C{i % 3}", "Emitir CIOT", "999", TEXTS[i % len(TEXTS)].format(i))


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("texts")
    write_csv(folder / "a.csv", [log_row(i, 1 + i % 20) for i in range(400)], header=NAMES)
    root = str(folder / "lake")
    ingest(spark, str(folder / "a.csv"), root)
    index_texts(spark, root)
    return folder, root


def found(model, search=""):
    return sorted(tuple(map(str, r)) for r in detail.detail_rows(model, search).select("protocolo", "rejeicao_id", "mensagem_original").collect())


def scanned(plan) -> list[tuple[int, str]]:
    """(files, text) of every scan below a plan that ran."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return scanned(plan.executedPlan())
    if name.endswith("QueryStage"):
        return scanned(plan.plan())
    if name.startswith("Scan"):
        return [(plan.metrics().apply("numFiles").value(), plan.toString())]
    children = plan.children().iterator()
    result = []
    while children.hasNext():
        result += scanned(children.next())
    return result


def test_batches_are_indexed_where_they_are_read(spark, lake):
    """No row of a batch moves before it is inverted, so a batch of any size has as many tasks as its scan."""
    root = lake[1]
    rows = textindex._rows_of(spark, root, [r[BATCH] for r in textindex.ledger(spark, root).collect()])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 400 and "Exchange" not in plan and "Join" not in plan and textindex._rows_of(spark, root, ["x"]).isEmpty()


def test_grams(spark):
    rows = spark.createDataFrame([(None,), ("",), ("ab",), ("abc",), ("ababab",), ("çãé" + "x" * 50_000,)], "t string")
    got = [r[0] for r in rows.select(grams(F.col("t"))).collect()]
    assert not got[0] and got[1:5] == [[], [], ["abc"], ["aba", "bab"]]
    assert set(got[5]) == {"çãé", "ãéx", "éxx", "xxx"}


@pytest.mark.parametrize("term", ["prot0100", "abc-00", "ação-0005", "12345678", "placa%rntrc", "ΑΣ", "ασβ", "𝄞𝄞𝄞", "% _", "ab", "", "a\\b"])
def test_the_index_changes_no_result(spark, lake, term):
    root = lake[1]
    assert found(open_indexed(spark, root, term), term) == found(open_silver(spark, root), term)


def test_the_index_under_filters(spark, lake):
    root = lake[1]
    for chosen in (LogFilter(mensagem="placa%ABC"), LogFilter(protocolo="ROT0_", status="ERRO"), LogFilter(mensagem="MUNICÍPIO", protocolo="00010")):
        some = found(open_indexed(spark, root, "", chosen))
        assert some and some == found(open_silver(spark, root).where(chosen))


def test_files_read(spark, lake, monkeypatch):
    """A rare term opens the files of its rows only, and only its rows come out of the lookup."""
    root = lake[1]
    every = spark.read.parquet(f"{root}/{NESTED}").select("_metadata.file_path").distinct().count()
    model = open_indexed(spark, root, "PROT1100010")
    assert model.logs().count() == 1
    rows = model.logs()
    rows.collect()
    nested = [n for n, text in scanned(rows._jdf.queryExecution().executedPlan()) if NESTED in text]
    assert nested == [1] and every >= 20
    monkeypatch.setattr(textindex, "MOST_FILES", 0)  # too many files to name: the join alone decides
    assert found(open_indexed(spark, root, "abc-00"), "abc-00") == found(open_silver(spark, root), "abc-00")


def test_postings_are_bounded(spark, lake, monkeypatch, tmp_path):
    """A gram that every row holds is listed in blocks."""
    folder = lake[0]
    root = str(tmp_path / "lake")
    monkeypatch.setattr(textindex, "BLOCK_ROWS", 4)
    ingest(spark, str(folder / "a.csv"), root)
    index_texts(spark, root)
    postings = spark.read.parquet(f"{root}/{POSTINGS}")
    assert postings.agg(F.max(F.size("linhas"))).first()[0] <= 4
    assert postings.where("gram = 'PRO'").agg(F.sum(F.size("linhas"))).first()[0] == 400
    assert found(open_indexed(spark, root, "PROT"), "PROT") == found(open_silver(spark, root), "PROT")


def test_batches(spark, lake, tmp_path):
    """Batches without postings are scanned; the next call indexes just those."""
    folder, root = lake[0], str(tmp_path / "lake")
    index_texts(spark, root)  # nothing there
    ingest(spark, str(folder / "a.csv"), root)
    index_texts(spark, root)
    write_csv(tmp_path / "b.csv", [log_row(i, 3) for i in range(1000, 1010)], header=NAMES)
    ingest(spark, str(tmp_path / "b.csv"), root)
    assert not is_indexed(spark, root)
    whole = found(open_silver(spark, root), "PROT0301")
    assert len(whole) == 10 and found(open_indexed(spark, root, "PROT0301"), "PROT0301") == whole
    before = spark.read.parquet(f"{root}/{POSTINGS}").count()
    index_texts(spark, root), index_texts(spark, root)
    after = spark.read.parquet(f"{root}/{POSTINGS}")
    assert is_indexed(spark, root) and after.select(BATCH).distinct().count() == 2 and after.count() > before
    assert found(open_indexed(spark, root, "PROT0301"), "PROT0301") == whole


def test_pages(spark, lake, tmp_path):
    """Every page in turn is the sorted table; rows of one moment, which share a third of them, spread over ranges."""
    rows = detail.detail_rows(open_silver(spark, lake[1])).withColumn("data_evento", F.expr("IF(log_id < '5', TIMESTAMP '2024-01-05 00:00:00', data_evento)"))
    path = str(tmp_path / "pages")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_pages(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    size = 90
    whole = detail.detail_page(rows, 1, 10_000).collect()
    last = page_count(spark, path, size)
    assert last == -(-len(whole) // size) and len(whole) > 300
    assert [tuple(r) for n in range(1, last + 1) for r in page_at(spark, path, n, size).collect()] == [tuple(r) for r in whole]
    assert page_at(spark, path, last + 1, size).collect() == [] and page_at(spark, path, 1, size).columns == detail.detail_page(rows).columns
    directory = spark.read.parquet(f"{path}/{DIRECTORY}")
    assert directory.count() > 1
    one = page_at(spark, path, last, size)
    one.collect()
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "faixa" in text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert sum(n for n, scan in scanned(one._jdf.queryExecution().executedPlan()) if ROWS in scan) <= 2


def test_pages_of_nothing(spark, lake, tmp_path):
    rows = detail.detail_rows(open_silver(spark, lake[1]), "nowhere at all")
    write_pages(rows, str(tmp_path / "pages"))
    assert page_count(spark, str(tmp_path / "pages")) == 0 and page_at(spark, str(tmp_path / "pages"), 1).collect() == []


def test_postings_come_without_a_row_per_gram(spark, lake):
    """Same postings as a row for every gram of every text, but no generator over the grams."""
    located = textindex._located(spark, lake[1])
    found = textindex._postings(located)
    assert "Generate explode" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.campo, r.gram, r.dia, r.arquivo, n) for r in found.collect() for n in r.linhas}
    messages = F.transform("rejeicoes.mensagem_original", lambda m: F.lower(m))
    values = F.concat(F.array("protocolo"), F.transform(F.flatten("rejeicoes.entidades"), lambda e: e["entidade_valor"]))
    wanted = set()
    for kind, texts in (("mensagem", messages), ("valor", values)):
        wanted |= {(kind, r.g, r.dia, r.arquivo, r.linha) for r in located.select("dia", "arquivo", "linha", F.explode(textindex._grams_of_all(texts)).alias("g")).collect()}
    assert got == wanted and len(got) > 4_000
    assert all(r.linhas == sorted(set(r.linhas)) for r in found.collect())


def test_pieces_of_texts(spark, lake, monkeypatch):
    """Pieces of a few characters, which end amid the rows of a file, change no posting."""
    located = textindex._located(spark, lake[1])

    def rows():
        return sorted(map(str, textindex._postings(located).collect()))

    whole = rows()
    monkeypatch.setattr(textindex, "PIECE_CHARS", 50)
    assert rows() == whole
