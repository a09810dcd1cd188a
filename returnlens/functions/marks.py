"""Words and shapes of numbers in a message, looked for in one pass and kept as bits.

The rules ask for some two hundred literal words, and each pattern of numbers runs only where its shape may be.
Asked one by one, each of them reads the message again; here a batch of messages is read once, as bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from returnlens.functions import rules
from returnlens.functions.regex import required_alternatives
from returnlens.functions.sqltext import Ref, Stage, any_of, text

# Necessary conditions of the patterns of numbers, by the digits that stand together: lengths of their runs and what
# stands between them. A digit or blank beyond Latin-1 counts as every shape.
SHAPES = ("digit", "date_slash", "date_dash", "plate", "cnpj", "cpf", "postcode", "comma", "point", "run7", "run8", "run8_12",
          "run11", "run12_16", "run14", "blanks")
BITS = 62
FOLDED, LOWERED = "marca_", "marca_minuscula_"
PIECE = 1 << 19


def _words() -> tuple[str, ...]:
    """Every word that the classification asks for."""
    texts = [*rules.SERVER_ERROR_WORDS, *rules.LOOKUP_HITS, *rules.NEGATIONS, *(w for g in rules.KEYWORD_GROUPS for w in g.keywords)]
    patterns = [*(p for r in (*rules.SEMANTIC_RULES, *rules.CONTEXT_RULES) for p in r.patterns), *rules.SUCCESS_PATTERNS,
                *(e.pattern for e in rules.ENTITY_RULES if e.pattern.startswith("(?i)")), rules.MASK_PREFIX[0][0], rules.MASK_LABELLED[0][0], rules.MASK_PROTOCOL[0][0]]
    texts += [w for p in patterns for options in required_alternatives(p) for w in options]
    return tuple(dict.fromkeys([*texts, "eixo", "@"]))


WORDS = _words()
PLACES = {mark: divmod(i, BITS) for i, mark in enumerate((*(("shape", s) for s in SHAPES), *(("word", w) for w in WORDS)))}
FIELDS = tuple(f"m{i}" for i in range(-(-len(PLACES) // BITS)))


# What masking writes, apart from what it takes over.
_WRITTEN = tuple(dict.fromkeys(
    re.sub(r"\\\d", "", written) for _, written in (*rules.MASK_OBJECTS, *rules.MASK_PREFIX, *rules.MASK_NUMBERS, *rules.MASK_PROTOCOL,
                                                  *rules.MASK_AMOUNTS, *rules.MASK_LISTS)))


class Marks:
    """Conditions over the columns of marks whose names start with ``prefix``."""

    def __init__(self, r: Ref, prefix: str = FOLDED) -> None:
        self.columns = [r(prefix + f) for f in FIELDS]

    def _masks(self, marks: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
        masks: dict[int, int] = {}
        for mark in marks:
            field, bit = PLACES[mark]
            masks[field] = masks.get(field, 0) | 1 << bit
        return [(self.columns[f], f"{m}L") for f, m in sorted(masks.items())]

    def words(self, words: Iterable[str]) -> str:
        """Whether one of the words occurs."""
        return any_of(f"({column} & {mask}) != 0" for column, mask in self._masks(("word", w) for w in words))

    def shapes(self, *shapes: str) -> str:
        """Whether one of the shapes may occur."""
        return any_of(f"({column} & {mask}) != 0" for column, mask in self._masks(("shape", s) for s in shapes))

    def every(self, words: Iterable[str]) -> list[str]:
        """Conditions that all of the words occur."""
        return [f"({column} & {mask}) = {mask}" for column, mask in self._masks(("word", w) for w in words)]

    def pattern(self, pattern: str) -> str:
        """What every match of a pattern needs."""
        needed = required_alternatives(pattern)
        conditions = [*self.every(o[0] for o in needed if len(o) == 1), *(self.words(o) for o in needed if len(o) > 1)]
        return "(" + " AND ".join(conditions) + ")" if conditions else "true"


def _windows(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The eight bytes from each place on as one number, all but ``width`` of them cleared."""
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))[at].copy().view("<u8").ravel()
    return eight if width >= 8 else eight & np.uint64((1 << 8 * width) - 1)


class MaskedMarks(Marks):
    """The same for a message and its masked form together. A word of letters and digits that only the masked form
    holds lies within what masking wrote, which stands apart from other letters."""

    def __init__(self, r: Ref, masked: str) -> None:
        super().__init__(r)
        self.masked = masked

    def every(self, words: Iterable[str]) -> list[str]:
        words = tuple(words)
        written = [word for word in words if any(word in w.lower() for w in _WRITTEN)]
        return [*super().every(w for w in words if w not in written), *(self.words((w,)) for w in written)]

    def words(self, words: Iterable[str]) -> str:
        words = tuple(words)
        written = [w for w in _WRITTEN if any(word in w.lower() for word in words)]
        return any_of([super().words(words), *(f"contains({self.masked}, {text(w)})" for w in written)])


def _reader() -> Callable[[pa.Array], pa.StructArray]:
    """Marks of texts that are folded, or lowered, and end in a line feed each; null for null.

    What it needs comes along in the closure, so that workers need no package but numpy and pyarrow.
    """
    words, shapes = [(w.encode(), *PLACES["word", w]) for w in WORDS], {s: PLACES["shape", s] for s in SHAPES}
    fields, piece_bytes, tables = list(FIELDS), PIECE, []

    def build() -> tuple:
        """Pairs of bytes that a word starts with; group of words by three bytes, hashed; words of each group as field,
        bit and pieces of eight bytes; the shorter words."""
        pairs, groups, members, short = np.zeros(1 << 16, bool), np.zeros(1 << 16, np.uint8), [[]], []
        for raw, field, bit in words:
            if len(raw) < 3:
                short.append((raw, field, bit))
                continue
            pairs[raw[0] | raw[1] << 8] = True
            key = hashed(raw[0] | raw[1] << 8, raw[2])
            if not groups[key]:
                groups[key] = len(members)
                members.append([])
            members[groups[key]].append((field, bit, [(i, min(8, len(raw) - i), int.from_bytes(raw[i:i + 8], "little")) for i in range(0, len(raw), 8)]))
        return pairs, groups, members, short

    def hashed(pair, third):
        return (pair * 31 + third * 2477) & 0xFFFF

    def window(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """The eight bytes from each place on as one number, all but ``width`` of them cleared."""
        return cleared(np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))[at], width)

    def cleared(eight: np.ndarray, width: int) -> np.ndarray:
        return eight if width >= 8 else eight & np.uint64((1 << 8 * width) - 1)

    def mark(out: np.ndarray, ends: np.ndarray, at: np.ndarray, field: int, bit: int) -> None:
        if len(at):
            out[field, np.searchsorted(ends, at, "right")] |= 1 << bit

    def mark_words(data: np.ndarray, length: int, ends: np.ndarray, out: np.ndarray) -> None:
        pairs, groups, members, short = tables[0]
        pair = np.ndarray((length,), "<u2", data, 0, (1,)).copy()
        at = np.flatnonzero(pairs.take(pair))
        group = groups.take(hashed(pair[at].astype(np.int64), data[at + 2].astype(np.int64)))
        at, group = at[group != 0], group[group != 0]
        order = np.argsort(group, kind="stable")
        at, bounds = at[order], np.searchsorted(group[order], np.arange(len(members) + 1))
        for g, mates in enumerate(members):
            if bounds[g] == bounds[g + 1]:
                continue
            here = at[bounds[g]:bounds[g + 1]]
            first = window(data, here, 8)
            for field, bit, ((_, width, value), *others) in mates:
                hit = here[cleared(first, width) == np.uint64(value)]
                for i, width, value in others:
                    hit = hit[window(data, hit + i, width) == np.uint64(value)]
                mark(out, ends, hit, field, bit)
        for raw, field, bit in short:
            mark(out, ends, np.flatnonzero(data[:length] == raw[0] if len(raw) == 1 else pair == raw[0] | raw[1] << 8), field, bit)

    def mark_shapes(data: np.ndarray, length: int, ends: np.ndarray, out: np.ndarray) -> None:
        body = data[:length]

        def shape(name: str, at: np.ndarray) -> None:
            mark(out, ends, at, *shapes[name])

        # Decimal digits beyond ASCII have lead bytes from 0xD9 on, but for 0xE2; blanks beyond it 0xC2 and from 0xE1 on.
        odd = np.flatnonzero(body >= 0xC2)
        odd = odd[(body[odd] == 0xC2) | (body[odd] >= 0xD9)]
        if len(odd):
            lead = body[odd]
            shape("blanks", odd[(lead == 0xC2) | (lead >= 0xE1)])
            for name in shapes:
                if name != "blanks":
                    shape(name, odd[(lead >= 0xD9) & (lead != 0xE2)])
        shape("blanks", np.flatnonzero((body[:-1] == 32) & (body[1:] == 32)))
        control = (body - np.uint8(9) < 5) | (body - np.uint8(28) < 4)
        control[ends[ends > 0] - 1] = False
        shape("blanks", np.flatnonzero(control))
        digit = np.zeros(length + 2, bool)
        digit[1:-1] = body - np.uint8(48) < 10
        edge = np.flatnonzero(digit[1:] != digit[:-1])
        start, stop = edge[::2], edge[1::2]
        if not len(start):
            return
        size, behind = stop - start, data[stop]
        shape("digit", start)
        for name, low, high in (("run7", 7, 7), ("run8", 8, 8), ("run8_12", 8, 12), ("run11", 11, 11), ("run12_16", 12, 16), ("run14", 14, 14)):
            shape(name, start[(size >= low) & (size <= high)])
        one, two, then = size[:-1], size[1:], behind[1:]
        by = np.where(start[1:] == stop[:-1] + 1, behind[:-1], 0)
        for name, found in (
            ("date_slash", (one == 2) & (by == ord("/")) & (two == 2) & (then == ord("/"))),
            ("date_dash", (one == 4) & (by == ord("-")) & (two == 2) & (then == ord("-"))),
            ("cnpj", (one == 3) & (by == ord("/")) & (two == 4) & (then == ord("-"))),
            ("cpf", (one == 3) & (by == ord(".")) & (two == 3) & (then == ord("-"))),
            ("postcode", (one == 5) & (by == ord("-")) & (two == 3)),
            ("comma", (by == ord(",")) & (two == 2)),
            ("point", (by == ord(".")) & (two == 2)),
        ):
            shape(name, start[:-1][found])
        # A plate: two or three letters, perhaps a dash or blank, a digit, three or four letters or digits, nothing more.
        letter = np.zeros(256, bool)
        letter[ord("a"):ord("z") + 1] = True
        plain = letter.copy()
        plain[ord("0"):ord("9") + 1] = True

        def byte(at: np.ndarray) -> np.ndarray:
            return np.where(at < 0, 10, data[np.maximum(at, 0)])

        before = byte(start - 1)
        last = start - 1 - ((before == 32) | (before == ord("-")))
        third, fourth = plain[byte(last - 2)], plain[data[start + 4]]
        letters = letter[byte(last)] & letter[byte(last - 1)] & ~(third & plain[byte(last - 3)])
        rest = plain[data[start + 1]] & plain[data[start + 2]] & plain[data[start + 3]] & ~(fourth & (third | plain[data[start + 5]]))
        shape("plate", start[letters & rest])

    def read(texts: pa.Array) -> pa.StructArray:
        if not tables:
            tables.append(build())
        texts = texts.cast(pa.large_binary())
        count, raw = len(texts), texts.buffers()[2]
        out = np.zeros((len(fields), count), np.int64)
        if count and raw is not None:
            offsets, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + count + 1], np.frombuffer(raw, np.uint8)
            first = 0
            while first < count:
                until = max(first + 1, int(np.searchsorted(offsets, offsets[first] + piece_bytes, "right")) - 1)
                length = int(offsets[until] - offsets[first])
                if length:
                    piece = np.concatenate((data[offsets[first]:offsets[until]], np.full(64, 10, np.uint8)))
                    ends, rows = offsets[first + 1:until + 1] - offsets[first], out[:, first:until]
                    mark_words(piece, length, ends, rows)
                    mark_shapes(piece, length, ends, rows)
                first = until
        return pa.StructArray.from_arrays([pa.array(row) for row in out], fields, mask=texts.is_null())

    return read


@lru_cache(1)
def _function():
    read = _reader()

    def marks(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield read(texts)

    return F.arrow_udf(marks, ", ".join(f"{f} long" for f in FIELDS))


def marks(value: str) -> Column:
    """Marks of an SQL expression for a folded or lowered text."""
    return _function()(F.expr(f"concat({value}, '\n')"))


def marks_stages(folded: str, lowered: str) -> list[Stage]:
    """``marca_...`` and ``marca_minuscula_...``: the marks of a folded and of a lowered text, which nearly always are the same;
    none where there is no text."""
    return [
        lambda r: {"marcas": marks(r(folded)), "marcas_minusculas": marks(f"if({r(lowered)} = {r(folded)}, NULL, {r(lowered)})")},
        lambda r: {FOLDED + f: f"coalesce({r('marcas')}.{f}, 0L)" for f in FIELDS}
        | {LOWERED + f: f"coalesce({r('marcas_minusculas')}.{f}, {r('marcas')}.{f}, 0L)" for f in FIELDS},
    ]
