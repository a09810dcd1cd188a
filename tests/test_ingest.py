"""Raw files to lake: identity, dialects, records over several lines, rejected rows, layout."""

from __future__ import annotations

import csv
import io
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from returnlens import LogFilter
from returnlens.sources import rawlogs
from returnlens.sources.silver import LEDGER, NESTED, STAGING, TABLES, ingest, ledger, open_silver, open_table, register_views, rejected_lines
from tests.test_scenarios import write_csv

NAMES = ("protocolo", "dhr_registro", "contratante", "funcionalidade", "cod_mensagem", "des_resposta")


def stored(spark, tmp_path):
    count = iter(range(1000))

    def store(df, name):
        path = str(tmp_path / f"stored{next(count)}-{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store


@pytest.fixture
def split_size(spark):
    """Splits of the given number of bytes, so that small files have many."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def use(size):
        for k in keys:
            spark.conf.set(k, str(size))

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def described(spark, tmp_path, paths):
    store = stored(spark, tmp_path)
    lines = store(rawlogs.read_lines(spark, paths), "lines")
    splits = store(rawlogs.describe_splits(lines), "splits")
    return lines, splits, store(rawlogs.describe_files(splits), "files"), store


def hashes(spark, tmp_path, paths):
    return {r.path.rsplit("/", 1)[1]: r.file_hash for r in described(spark, tmp_path, paths)[2].collect()}


def test_identity_knows_the_order_at_every_split_size(spark, tmp_path, split_size):
    lines = ["protocolo;contratante", *(f"P{i};C{i % 3}" for i in range(700))]
    swapped = lines[:]
    swapped[10], swapped[690] = swapped[690], swapped[10]
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in (("a", lines), ("b", swapped), ("copy", lines), ("near", [*lines[:10], "P9;C9", *lines[11:]])):
        (folder / name).write_text("\n".join(content) + "\n")
    (folder / "open_end").write_text("\n".join(lines))
    found = []
    for part, size in enumerate((1 << 20, 4000, 333)):
        split_size(size)
        (tmp_path / f"s{part}").mkdir()
        found.append(hashes(spark, tmp_path / f"s{part}", str(folder)))
    (tmp_path / "alone").mkdir()
    found.append(found[0] | hashes(spark, tmp_path / "alone", str(folder / "b")))
    assert all(f == found[0] for f in found) and found[0]["a"] == found[0]["copy"]
    assert len(set(found[0].values())) == 4


def test_power():
    for prime, base in rawlogs.DIGEST_FIELDS:
        assert all(pow(base, prime - 1, prime) == 1 for _ in range(1)) and all(prime % d for d in range(2, 46341))


def test_dialects(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    header = (" Protocolo ", "Contratante", "cod_mensagem", "des_resposta")
    write_csv(folder / "a.csv", [("P1", "000123", "1", "não")], ",", "latin-1", header)
    write_csv(folder / "b.csv", [("P2", "C", "2", 'duas\nlinhas; "x"')], ";", "utf-8", header)
    (folder / "c.csv").write_text("protocolo;contratante\nP3;C\nP4;C;a;b\n\n  \nP5;C\n", encoding="utf-8")
    (folder / "d.csv").write_bytes("\ufeffprotocolo;log_id;file_hash;motor;c0\r\nP6;x;y;z;0\r\nP7;x;y;z;0".encode())
    (folder / "e.csv").write_text("coluna;outra\n1;2\n")
    (folder / "f.csv").write_text("Contratante;contratante\nA;B\n")
    lines, splits, files, store = described(spark, tmp_path, str(folder))
    dialects = {r["path"][-5:]: (r["separator"], r["encoding"], r["multiline"], r["problema"] is None) for r in files.collect()}
    assert dialects == {"a.csv": (",", "ISO-8859-1", False, True), "b.csv": (";", "UTF-8", True, True), "c.csv": (";", "UTF-8", False, True),
                        "d.csv": (";", "UTF-8", False, True), "e.csv": (";", "UTF-8", False, False), "f.csv": (";", "UTF-8", False, True)}
    good = files.where("problema IS NULL")
    rows = {r["cod_protocolo"]: r for r in rawlogs.parse_records(rawlogs.read_records(lines, splits, good, store), good, F.current_timestamp()).collect()}
    assert set(rows) == {"P1", "P2", "P3", "P4", "P5", "P6", "P7", "SEM_PROTOCOLO"}
    assert rows["P1"]["contratante"] == "000123" and rows["P1"]["des_resposta"] == "não"
    assert rows["P2"]["des_resposta"] == 'duas\nlinhas; "x"' and rows["SEM_PROTOCOLO"]["contratante"] == "B"
    assert {p: r["rejeitada"] for p, r in rows.items() if r["rejeitada"]} == {"P4": "P4;C;a;b"}
    assert len({r["log_id"] for r in rows.values()}) == 8
    assert [rows[p]["linha"] for p in ("P3", "P4", "P5", "P6", "P7")] == [1, 2, 5, 1, 2]


def odd_text(pick):
    return "".join(pick.choices(["a", "b ", '"', '""', "\n", "\n\n", ";", ",", "\r\n", "é", '";', '\n"'], k=pick.randint(0, 12)))


@pytest.mark.parametrize("size", [1 << 20, 700, 64])
@pytest.mark.parametrize("separator", [";", ","])
def test_records_over_lines(spark, tmp_path, split_size, size, separator):
    """Fields with quotes and line feeds, as a CSV writer writes them, come back whole at any split size."""
    pick = random.Random(size)
    rows = [(f"P{i}", odd_text(pick), odd_text(pick)) for i in range(200)]
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=separator, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows([("protocolo", "contratante", "des_resposta"), *rows])
    (tmp_path / "in.csv").write_bytes(out.getvalue().encode())
    split_size(size)
    lines, splits, files, store = described(spark, tmp_path, str(tmp_path / "in.csv"))
    assert size > 1000 or splits.count() > 5
    records = rawlogs.read_records(lines, splits, files, store)
    got = {r["cod_protocolo"]: r for r in rawlogs.parse_records(records, files, F.current_timestamp()).collect()}
    assert len(got) == len(rows) and not any(r["rejeitada"] for r in got.values())
    at = 1
    for protocol, client, response in rows:
        row = got[protocol]
        assert (row["contratante"], row["des_resposta"], row["linha"]) == (client or "CONTRATANTE DESCONHECIDO", response, at)
        at += 1 + client.count("\n") + response.count("\n")


def test_a_field_that_never_closes(spark, tmp_path, split_size):
    split_size(100)
    content = ['protocolo;contratante;des_resposta', 'P1;C;"a\nb"', 'P2;C;x"y', 'P3;"C;open', *(f"P{i};C;t" for i in range(4, 40))]
    (tmp_path / "in.csv").write_text("\n".join(content))
    lines, splits, files, store = described(spark, tmp_path, str(tmp_path / "in.csv"))
    got = {r["cod_protocolo"]: r for r in rawlogs.parse_records(rawlogs.read_records(lines, splits, files, store), files, F.current_timestamp()).collect()}
    assert len(got) == 39 and [p for p, r in got.items() if r["rejeitada"]] == ["P3"]
    assert got["P1"]["des_resposta"] == "a\nb" and got["P2"]["des_resposta"] == 'x"y' and got["P39"]["linha"] == 40


def log_rows(many, day="05", client="C"):
    return [(f"P{i}", f"{day}/01/2024 10:00:00", client, "Emitir CIOT", "999", "Retorno") for i in range(many)]


def test_row_numbers_do_not_depend_on_neighbours(spark, tmp_path, split_size):
    folder = tmp_path / "in"
    folder.mkdir()
    write_csv(folder / "same.csv", [("P", "05/01/2024", "C", "F", "1", "equal")] * 20000, header=NAMES)
    ids = []
    for part, size in enumerate((1 << 24, 50_000)):
        if part:
            write_csv(folder / "other.csv", log_rows(50), header=NAMES)
        split_size(size)
        root = str(tmp_path / f"lake{part}")
        assert ingest(spark, str(folder), root).first()["total_logs"] == 20000 + 50 * part
        ids.append({r[0] for r in spark.read.parquet(f"{root}/dim_log").where("protocolo = 'P'").select("log_id").collect()})
    assert ids[0] == ids[1] and len(ids[0]) == 20000


def test_accounts_and_batches(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "lake")
    folder.mkdir()
    write_csv(folder / "a.csv", log_rows(5), header=NAMES)
    (folder / "bad.csv").write_text("nada\n1\n")
    first = ingest(spark, str(folder), root).first()
    assert (first.status, first.total_logs, first.linhas_rejeitadas, first.arquivos_recusados) == ("processed", 5, 0, 1)
    with open(folder / "b.csv", "w") as file:
        file.write(";".join(NAMES) + "\nP9;06/01/2024;C;F;1;x\nshort;line\n" + ";" * 9 + "\n")
    write_csv(folder / "copy.csv", log_rows(5), header=NAMES)
    second = ingest(spark, str(folder), root).first()
    assert (second.status, second.total_logs, second.linhas_rejeitadas) == ("processed", 1, 2)
    again = ingest(spark, str(folder), root).first()
    assert (again.status, again.total_logs, again.unique_protocols) == ("cached", 6, 6)
    assert {(r.linha, r.texto) for r in rejected_lines(spark, root).collect()} == {(2, "short;line"), (3, ";" * 9)}
    assert ledger(spark, root).count() == 2 and spark.read.parquet(f"{root}/{NESTED}").count() == 6
    file_hash = ledger(spark, root).where("path LIKE '%b.csv'").first().file_hash
    register_views(spark, root, file_hash)
    assert [r[0] for r in spark.sql("SELECT protocolo FROM dim_log").collect()] == ["P9"]
    assert open_silver(spark, root, file_hash).logs().count() == 1 and open_silver(spark, root, "none").logs().count() == 0
    assert not list((tmp_path / "lake" / STAGING).glob("*"))


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "lake")
    folder.mkdir()
    write_csv(folder / "a.csv", log_rows(7), header=NAMES)
    ingest(spark, str(folder), root)
    for file in (tmp_path / "lake" / LEDGER).iterdir():
        file.unlink()  # as if the ingest had stopped before its last step
    (tmp_path / "lake" / LEDGER).rmdir()
    assert ingest(spark, str(folder), root).first().total_logs == 7
    assert spark.read.parquet(f"{root}/dim_log").count() == 7


def test_only_rejected_or_empty_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("protocolo;contratante\nx\n")
    (folder / "b.csv").write_text("protocolo;contratante\n")
    row = ingest(spark, str(folder), str(tmp_path / "lake")).first()
    assert (row.status, row.total_logs, row.linhas_rejeitadas, row.arquivos_recusados) == ("processed", 0, 1, 0)
    (folder / "a.csv").unlink(), (folder / "b.csv").unlink()
    (folder / "c.csv").write_text("nada\n")
    row = ingest(spark, str(folder), str(tmp_path / "other")).first()
    assert (row.status, row.total_logs, row.arquivos_recusados) == ("cached", 0, 1)


def test_layout_by_day(spark, tmp_path):
    """A period reads only its days' files; a batch has few files."""
    folder, root = tmp_path / "in", str(tmp_path / "lake")
    folder.mkdir()
    for k in range(6):
        write_csv(folder / f"{k}.csv", [r for d in range(1, 11) for r in log_rows(20, f"{d:02}", f"C{k}")], header=NAMES)
    ingest(spark, str(folder), root)
    model = open_silver(spark, root)
    chosen = model.where(LogFilter(inicio=date(2024, 1, 3), fim=date(2024, 1, 4)))
    plan = chosen.logs()._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "dia" in pruned
    read = chosen.logs().select(F.input_file_name().alias("f")).distinct().count()
    whole = model.logs().select(F.input_file_name().alias("f")).distinct().count()
    assert chosen.logs().count() == 240 and read < whole <= 30
    assert read == chosen.silver.select("_metadata.file_path").distinct().count()
    flat = type(model).from_tables(*(open_table(spark, root, t) for t in TABLES))
    assert flat.where(LogFilter(inicio=date(2024, 1, 3), fim=date(2024, 1, 4))).rejections().count() == 240
