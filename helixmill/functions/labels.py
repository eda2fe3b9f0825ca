"""Packed label cells: one value per slot, read by a parsing expression grammar with ordered alternatives.

    cell   <- slots !.
    slots  <- slot (delim slot)*
    slot   <- blank* (quoted / bracketed / bare)? blank*
    quoted <- q body q &(blank* (delim / end))   q: the quote char, repeated one to three times; tried longest first
    body   <- slots, when every one of them is a value or says nothing; else one slot with a remark after its value
    bracketed <- '[' slots ']' / '(' slots ')' / '{' slots '}'   around the whole of the text
    bare   <- sign? digits ('.' '0'+)? remark? / sign? name remark? / nothing

An alternative that fails gives back what it read. A quote that never closes is malformed: the cell is read again with
that quote as blank, and its values carry the flag `bad_quote`. Text in a slot that is neither a value nor one of the
words for nothing gives a null value with the flag `unreadable`, without a position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTES = "\"'`“”„«»‘’"
CLOSING = {"“": "”", "„": "”“", "«": "»", "‘": "’"}
BRACKETS = {"[": "]", "(": ")", "{": "}"}
SIGNS = {"+": 1, "＋": 1, "﹢": 1, "-": -1, "−": -1, "–": -1, "—": -1, "‐": -1, "‑": -1, "‒": -1, "﹣": -1, "－": -1}
DELIMS = ";,|/、；，｜؛،\t\n\r\v\f"
#: Slots that say nothing is known, in any case.
NOTHING = frozenset(["", "?", "??", "na", "n/a", "n.a.", "none", "null", "nan", "nil", "unknown", "unk", "-", "--", "—", "–", ".", "missing", "not known", "tbd"])
_NUMBER = re.compile(r"([^\w\s.])?\s*(\d+)(?:[.．]0*)?(?![\w.])")
_WORD = re.compile(r"([^\w\s.])?\s*([^\W_][\w.]*)")
_EMPTY_END = re.compile(rf"\s*(?:$|[{re.escape(DELIMS)}])")
_NOTHING_WORD = re.compile(r"(?:n/a|n\.a\.|none|null|nan|na|unknown|\?+|--?|[–—−.])(?=\s|$)", re.I)
_BLANK = re.compile(r"\s*")
_NA = re.compile(r"n/a(?!\w)", re.I)
_MAX = 2**31 - 1
#: Quotes inside quotes are read to this depth; a cell nested deeper is one unreadable slot.
DEEP = 200


class Value(NamedTuple):
    value: int | None
    flag: str | None


class _Fail(Exception):
    pass


class CellParser:
    """names: what stands for an id, in any case."""

    def __init__(self, names: dict[str, int] | None = None):
        self.names = {k.strip().casefold(): int(v) for k, v in (names or {}).items() if k and k.strip() and v is not None}
        self.read = lru_cache(100_000)(self._read)

    def _read(self, cell: str) -> tuple[Value, ...]:
        try:
            return tuple(self._slots(cell.strip(), True, 0))
        except RecursionError:
            return (Value(None, "unreadable"),)

    # -- atoms ---------------------------------------------------------------------------------------------------------
    def _atom(self, s: str, at: int = 0) -> tuple[int, int] | None:
        """(value, end) of a sign with a number or a name at a place of s."""
        m = _NUMBER.match(s, at)
        if m and (m[1] is None or m[1] in SIGNS):
            v = SIGNS.get(m[1], 1) * int(digits) if len(digits := m[2].lstrip("0") or "0") <= 10 else _MAX + 1
            return (v, m.end()) if abs(v) <= _MAX else None
        m = _WORD.match(s, at)
        if m and (m[1] is None or m[1] in SIGNS) and (k := self.names.get(m[2].casefold())) is not None:
            return SIGNS.get(m[1], 1) * k, m.end()
        return None

    def _bare(self, s: str, remark: bool) -> Value | None:
        """The value of a slot's text; None for nothing. remark: whether text may follow the value."""
        s = s.strip()
        if s.casefold() in NOTHING:
            return None
        a = self._atom(s)
        if a is None:
            return Value(None, "unreadable")
        rest = s[a[1] :]
        if rest.strip() and not remark:
            raise _Fail
        return Value(a[0], None)

    # -- slots ---------------------------------------------------------------------------------------------------------
    def _slots(self, s: str, top: bool, depth: int) -> list[Value]:
        """All slots of s."""
        while (whole := self._wrapped(s)) is not None:
            s = whole
        out: list[Value] = []
        i, n, fresh, bad = 0, len(s), True, False
        open_: set[tuple[str, int]] = set()  # quotes that nothing closes from here on
        while i < n:
            c = s[i]
            if c.isspace() or c in DELIMS:
                fresh, i = True, i + 1
                continue
            if c in QUOTES and fresh:
                got = self._quoted(s, i, depth, open_)
                if got is None:
                    bad, i = True, i + 1  # malformed: the quote is read as blank
                    continue
                out += got[0]
                i, fresh = got[1], False
                continue
            j = self._bare_end(s, i)
            text = s[i:j].rstrip(QUOTES) if bad else s[i:j]
            out += self._bare_run(text, bad)
            i, fresh = max(j, i + 1), True
        return out

    def _wrapped(self, s: str) -> str | None:
        """What a pair of brackets around the whole text holds."""
        if len(s) > 1 and s[0] in BRACKETS and s[-1] == BRACKETS[s[0]]:
            level = 0
            for i, c in enumerate(s):
                level += (c == s[0]) - (c == BRACKETS[s[0]])
                if level == 0 and i < len(s) - 1:
                    return None
            return s[1:-1].strip()
        return None

    def _quoted(self, s: str, i: int, depth: int, open_: set[tuple[str, int]]) -> tuple[list[Value], int] | None:
        """Values and end of a quoted slot at i, or None: the quote is malformed and what was read of it is given back.

        Longer quotes are tried first. The end is the nearest closing quote with a delimiter, bracket, blank or nothing behind
        it. No farther end is tried for a body that can't be read: it would start with the same text.
        """
        q = s[i]
        closing = CLOSING.get(q, q)
        most = 1
        while most < 3 and s[i : i + most + 1] == q * (most + 1):
            most += 1
        if s[i : i + 2] == q * 2 and _EMPTY_END.match(s, i + 2):
            return [], i + 2  # an empty quoted slot
        for width in range(most, 0, -1):
            if (q, width) in open_:
                continue
            j = i + width
            while j + width <= len(s):
                if s[j] in closing and all(c in closing for c in s[j : j + width]):
                    end = j + width
                    if (end == len(s) or s[end].isspace() or s[end] in DELIMS or s[end] in BRACKETS.values()) and depth < DEEP:
                        return self._body(s[i + width : j].strip(), depth), end
                j += 1
            open_.add((q, width))
        return None

    def _body(self, s: str, depth: int) -> list[Value]:
        """A quoted body: a list of values if it is one, else one value with a remark."""
        if (whole := self._wrapped(s)) is not None:
            s = whole
        if s and s[0] in QUOTES:
            return self._slots(s, False, depth + 1)
        a = self._atom(s)
        parts = re.split(f"[{re.escape(DELIMS)}]", s) if not (s.casefold() in NOTHING) else [""]
        try:
            got = [self._bare(p, False) for p in parts]
            if any(v is not None and v.flag for v in got):
                raise _Fail
            return [v for v in got if v is not None]
        except _Fail:
            pass
        if len(spaced := s.split()) > 1:
            try:
                got = [self._bare(p, False) for p in spaced]
                if not any(v is not None and v.flag for v in got):
                    return [v for v in got if v is not None]
            except _Fail:
                pass
        if a is None:
            return [Value(None, "unreadable")] if s.casefold() not in NOTHING else []
        return [Value(a[0], None)]

    def _bare_end(self, s: str, i: int) -> int:
        """Where the bare text that starts at i ends: at a delimiter, but n/a is one word."""
        if (m := _NA.match(s, i)) is not None:
            return m.end()
        j, level = i, 0
        while j < len(s):
            c = s[j]
            if c in BRACKETS:
                level += 1
            elif c in BRACKETS.values():
                level = max(0, level - 1)
            elif level == 0 and (c in DELIMS or (c in QUOTES and j > i and s[j - 1].isspace())):
                break
            j += 1
        return j

    def _bare_run(self, text: str, bad: bool) -> list[Value]:
        """Values of bare text between delimiters: blanks part values too, as long as each part is one; else a remark follows."""
        flag = "bad_quote" if bad else None
        t = text.strip()
        if (whole := self._wrapped(t)) is not None:
            return self._slots(whole, False, DEEP - 1)
        if t.casefold() in NOTHING:
            return []
        out: list[Value] = []
        at, n = 0, len(t)
        while at < n:
            if (m := _NOTHING_WORD.match(t, at)) is not None:
                at = _BLANK.match(t, m.end()).end()
                continue
            a = self._atom(t, at)
            if a is None or (a[1] < n and not t[a[1]].isspace() and t[a[1]] not in "([{"):
                if not out:
                    out.append(Value(None, "unreadable"))
                break
            out.append(Value(a[0], flag))
            at = _BLANK.match(t, a[1]).end()
            if at < n and t[at] in "([{":
                close = t.find(BRACKETS[t[at]], at)
                at = _BLANK.match(t, close + 1).end() if close > 0 else n
        return out


def label_values(df: DataFrame, names: dict[str, int] | None = None, key: str = "row_index", cell: str = "labels", loaded: str | None = "loaded_at") -> DataFrame:
    """(key, pos, label_value, flag, is_first): one row per value of each record's cell.

    pos counts the values of the cell from 1, repeated values each; is_first marks the first use of a value in its cell. A slot with text that can't be read has null pos and
    value and the flag `unreadable`; a value read from a cell with an unclosed quote has the flag `bad_quote`. Null, empty
    and blank cells give no row. Of several deliveries of a record the first loaded counts; rows without key are left out.
    """
    one = first_delivery(df, key, [cell], loaded).where(F.col(cell).isNotNull())
    names = dict(names or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = CellParser(names)
        for b in batches:
            keys, pos, val, flag, new = [], [], [], [], []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, seen = 0, set()
                for v in parser.read(c):
                    n += v.value is not None
                    keys.append(k)
                    pos.append(n if v.value is not None else None)
                    val.append(v.value)
                    flag.append(v.flag)
                    new.append(v.value is not None and v.value not in seen)
                    seen.add(v.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pos, pa.int32()), pa.array(val, pa.int32()), pa.array(flag, pa.string()), pa.array(new, pa.bool_())], names=[key, "pos", "label_value", "flag", "is_first"])

    return one.mapInArrow(run, f"`{key}` long, pos int, label_value int, flag string, is_first boolean")


def first_delivery(df: DataFrame, key: str, columns: list[str], loaded: str | None = "loaded_at") -> DataFrame:
    """(key, *columns) of each record once: the first loaded delivery, the smallest columns on a tie. Rows without a key are left out."""
    t = F.col(loaded).cast("timestamp") if loaded is not None and loaded in df.columns else F.lit(None).cast("timestamp")
    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k_"), t.alias("t_"), *[F.col(c).alias(f"c{i}_") for i, c in enumerate(columns)])
    one = src.groupBy("k_").agg(F.min(F.struct("t_", *[f"c{i}_" for i in range(len(columns))])).alias("m_"))
    return one.select(F.col("k_").alias(key), *[F.col(f"m_.c{i}_").alias(c) for i, c in enumerate(columns)])
