"""Raw logs and files derived from the ``events`` table that show single rules, wide logs and file shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.operators.canonical import ROW, spread
from returnlens.plans.demo import raw_logs

# (functionality, code, message) by event_id modulo their number: one for each semantic rule, then one
# for each contextual rule.
RULE_RETURNS = (
    ("Emitir CIOT", "", "Dados enviados com sucesso"),
    ("Emitir CIOT", "", "Consulta feita com sucesso"),
    ("Emitir CIOT", "", "Transportador sem vínculo ANTT"),
    ("Emitir CIOT", "", "Modalidade de pagamento recusada"),
    ("Emitir CIOT", "", "O campo peso é inválido"),
    ("Emitir CIOT", "", "Transportador contratado: CPF/CNPJ e RNTRC em conflito"),
    ("Emitir CIOT", "", "A data de início da viagem não pode ser inferior à data atual"),
    ("Emitir CIOT", "", "CEP inexistente"),
    ("Emitir CIOT", "", "IBGE destino divergente"),
    ("Emitir CIOT", "", "Eixo inválido no conjunto"),
    ("Emitir CIOT", "", "Natureza da carga inválida"),
    ("Emitir CIOT", "", "Placa sem vínculo com RNTRC"),
    ("Emitir CIOT", "", "CIOT duplicado"),
    ("Emitir CIOT", "", "CIOT encerrado pelo emissor"),
    ("Emitir CIOT", "", "iniciomovi invalido"),
    ("Emitir CIOT", "", "Período superior a 90 dias"),
    ("Emitir CIOT", "", "Fora da tolerância"),
    ("Emitir CIOT", "", "Erro ao consultar dados da frota"),
    ("Emitir CIOT", "", "br.com.acme.Tipo@ab12cd34"),
    ("Emitir CIOT", "", "Registro previamente realizado"),
    ("Consultar CIOT", "", "Veículo localizado"),
    ("Emitir CIOT", "503", "Serviço"),
    ("Emitir CIOT", "", "timeout na chamada"),
    ("Emitir CIOT", "", "certificate vencido"),
    ("Emitir CIOT", "", "senha inválida"),
    ("Emitir CIOT", "", "host unreachable"),
    ("Emitir CIOT", "", "excedeu o total de requisicoes"),
    ("Emitir CIOT", "", "xml malformado"),
    ("Emitir CIOT", "", "soap fault"),
)
WIDE_MESSAGES, WIDE_VALUES, LONG_REPEATS = 30, 25, 2600
EVENTS_PER_FILE = 4000


def _canonical(events: DataFrame, functionality, code, response) -> DataFrame:
    return events.select(
        F.concat(F.lit("log_"), F.col("event_id").cast("string")).alias("log_id"), F.lit("C").alias("contratante"),
        functionality.alias("funcionalidade"), code.alias("cod_mensagem"), response.alias("des_resposta"),
        F.concat(F.lit("P"), F.col("event_id").cast("string")).alias("cod_protocolo"), F.col("ts").alias("data"), ROW)


def rule_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical logs of one message each, with a case for every rule."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"), keep_row=True).withColumn("k", (F.col("event_id") % len(RULE_RETURNS)).cast("int"))
    return _canonical(events, *(F.get(F.lit([r[i] for r in RULE_RETURNS]), F.col("k")) for i in range(3)))


def wide_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical logs with many messages, with many entities of one kind, or with an entity far behind."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"), keep_row=True)
    messages = F.expr(f"""concat('{{"Codigo":"209","Mensagem":["', array_join(transform(sequence(1, {WIDE_MESSAGES}),
        i -> concat('O CEP 01001-', lpad(i, 3, '0'), ' ainda não está cadastrado.')), '","'), '"]}}')""")
    values = F.expr(f"concat('CEP inexistente: ', array_join(transform(sequence(1, {WIDE_VALUES}), i -> concat('02000-', lpad(i, 3, '0'))), ' '))")
    behind = F.expr(f"concat(repeat('x ', {LONG_REPEATS}), 'A placa ABC1D23 não pertence ao RNTRC 12345678.')")
    kind = F.col("event_id") % 3
    return _canonical(events, F.lit("Emitir CIOT"), F.when(kind == 0, "209").otherwise(""), F.when(kind == 0, messages).when(kind == 1, values).otherwise(behind))


def write_raw_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The derived logs as raw files of ``EVENTS_PER_FILE`` events, in event order, one folder each.

    Every second file is separated by commas, every third is Latin-1. Each JSON text of the first kind
    holds a line feed; behind every 101st event stands a line that does not fit; one file more has
    none of the columns.
    """
    logs = raw_logs(spark, sf_dir).withColumn("event_id", F.expr("CAST(substring(log_id, 5) AS BIGINT)"))
    logs = logs.withColumn("arquivo", F.floor(F.col("event_id") / EVENTS_PER_FILE)).withColumn("dhr_registro", F.date_format("dhr_registro", "dd/MM/yyyy HH:mm:ss"))
    names = ["protocolo", "dhr_registro", "contratante", "funcionalidade", "cod_mensagem", "des_resposta"]
    broken = F.replace("des_resposta", F.lit('"217","Mensagem"'), F.lit('"217",\n"Mensagem"'))
    logs = logs.withColumn("des_resposta", F.when(F.col("event_id") % 24 == 0, broken).otherwise(F.col("des_resposta")))
    separator = F.when(F.col("arquivo") % 2 == 1, ",").otherwise(";")
    fields = [F.concat(F.lit('"'), F.replace(F.coalesce(n, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for n in names]
    row = F.array_join(F.array(*fields), ";")
    row = F.when(F.col("arquivo") % 2 == 1, F.array_join(F.array(*fields), ",")).otherwise(row)
    bad = F.concat(F.lit("linha"), separator, F.lit("quebrada "), F.col("event_id").cast("string"))
    lines = logs.select("arquivo", "event_id", F.posexplode(F.when(F.col("event_id") % 101 == 0, F.array(row, bad)).otherwise(F.array(row))).alias("n", "value"))
    header = F.when(F.col("arquivo") % 2 == 1, ",".join(names)).otherwise(";".join(names))
    heads = logs.select("arquivo").distinct().select("arquivo", F.lit(-1).cast("long").alias("event_id"), F.lit(0).alias("n"), header.alias("value"))
    none = spark.range(1).select(F.lit(-1).cast("long").alias("arquivo"), F.lit(0).cast("long").alias("event_id"), F.lit(0).alias("n"), F.lit("nada;disso").alias("value"))
    encoded = F.when(F.pmod("arquivo", F.lit(3)) == 2, F.encode("value", "ISO-8859-1")).otherwise(F.encode("value", "UTF-8")).cast("string")
    together = lines.union(heads).union(none).repartition("arquivo").sortWithinPartitions("arquivo", "event_id", "n")
    together.select(encoded.alias("value"), "arquivo").write.mode("overwrite").partitionBy("arquivo").text(path)
