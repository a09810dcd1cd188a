"""The shared log filter and the local search predicates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL_STATUSES = "TODOS"
# Entity groups of the rankings: name -> kinds.
ENTITY_GROUPS = {"DOC": ("CPF", "CNPJ", "DOC"), "CEP_MUN": ("CEP", "MUNICIPIO")}


def _pattern(text: str) -> str:
    return "%" + text.replace("\\", "\\\\") + "%"


def like_contains(column: Column, text: str) -> Column:
    """LIKE with the text inside; ``%`` and ``_`` in it stay wildcards, a backslash is literal."""
    return column.like(_pattern(text))


def ilike_contains(column: Column, text: str) -> Column:
    """As ``like_contains``, ignoring case."""
    return column.ilike(_pattern(text))


def _one_of(values: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda column: column.isin(*values)


def all_of(conditions: list[Column]) -> Column:
    """Conjunction; true without conditions."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class LogFilter:
    """Choice of logs. Empty fields do not restrict.

    ``causas``, ``tipos``, ``codigos`` and ``mensagem`` pick whole logs: a log stays, with all
    its rejections, when one of them fits.
    """

    inicio: date | None = None
    fim: date | None = None
    protocolo: str = ""
    status: str = ALL_STATUSES
    contratantes: tuple[str, ...] = ()
    funcionalidades: tuple[str, ...] = ()
    causas: tuple[str, ...] = ()
    tipos: tuple[str, ...] = ()
    codigos: tuple[str, ...] = ()
    mensagem: str = ""

    def _period(self) -> tuple[date | None, date | None]:
        return self.inicio or self.fim, self.fim or self.inicio

    def day_predicate(self, day: Column) -> Column:
        """The period as a condition on the event day, for tables partitioned by it."""
        first, last = self._period()
        return F.lit(True) if first is None else day.between(F.lit(first), F.lit(last))

    def log_predicate(self) -> Column:
        """Condition over the columns of the log itself."""
        conditions = []
        first, last = self._period()
        if first is not None:
            lower = F.lit(f"{first:%Y-%m-%d} 00:00:00").cast("timestamp")
            upper = F.lit(f"{last:%Y-%m-%d} 23:59:59").cast("timestamp")
            conditions.append(F.col("data_evento").between(lower, upper))
        if self.protocolo.strip():
            conditions.append(like_contains(F.col("protocolo"), self.protocolo))
        if self.status != ALL_STATUSES:
            conditions.append(F.col("status_geral") == self.status)
        if self.contratantes:
            conditions.append(F.col("contratante").isin(*self.contratantes))
        if self.funcionalidades:
            conditions.append(F.col("funcionalidade").isin(*self.funcionalidades))
        return all_of(conditions)

    def rejection_predicates(self) -> list[tuple[str, Callable[[Column], Column]]]:
        """Conditions on one rejection column each, of which each must hold for some rejection of
        the log."""
        predicates: list[tuple[str, Callable[[Column], Column]]] = []
        for name, values in (("causa_raiz", self.causas), ("tipo_rejeicao_semantica", self.tipos),
                             ("codigo_antt", self.codigos)):
            if values:
                predicates.append((name, _one_of(values)))
        if self.mensagem.strip():
            predicates.append(("mensagem", lambda column: ilike_contains(column, self.mensagem)))
        return predicates


def entity_predicate(kind: str, value: str = "") -> Column:
    """Entities of a kind or group, optionally with a text inside the value."""
    condition = F.col("entidade_tipo").isin(*ENTITY_GROUPS.get(kind, (kind,)))
    return condition & like_contains(F.col("entidade_valor"), value) if value.strip() else condition
