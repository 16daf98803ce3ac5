"""Rows of a sheet's XML as columns of texts.

A stretch of whole rows is read as arrays: places of tags, attributes and values, then a column at a time. Cells with more than a
value (formulas, inline strings, entities) are parsed as XML by themselves, all of a stretch at once. A stretch that is laid out
in any other way is parsed as XML row by row, with the same result.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .cellformats import compiled, compiled_many, placed

# Tags as arrays tell them apart; a tag that holds nothing comes after the one that opens.
_OTHER, _ROW, _ROW_EMPTY, _ROW_END, _CELL, _CELL_EMPTY, _CELL_END, _VALUE, _VALUE_END = range(9)
# By the first two bytes of a tag, the second one higher.
_BY_START = np.zeros(1 << 16, np.int8)
for _kind, _starts in (_ROW, "ro"), (_ROW_END, "/r"), (_CELL, "c> c/ c\t c\n c\r c"), (_CELL_END, "/c"), (_VALUE, "v> v\t v\n v\r v"), (_VALUE_END, "/v"):
    for _start in _starts.split(" "):
        _BY_START[ord(_start[0]) + 256 * ord(_start[1:] or " ")] = _kind
# Which tag may follow which. Others stand in cells, beside a value; so tags that all may follow each other are nested well.
_FOLLOWS = np.zeros((9, 9), bool)
for _kind, _next in {
        _ROW: (_CELL, _CELL_EMPTY, _ROW_END), _ROW_EMPTY: (_ROW, _ROW_EMPTY), _ROW_END: (_ROW, _ROW_EMPTY), _CELL: (_VALUE, _CELL_END, _OTHER),
        _CELL_EMPTY: (_CELL, _CELL_EMPTY, _ROW_END), _CELL_END: (_CELL, _CELL_EMPTY, _ROW_END), _VALUE: (_VALUE_END,),
        _VALUE_END: (_CELL_END, _OTHER), _OTHER: (_OTHER, _VALUE, _CELL_END)}.items():
    _FOLLOWS[_kind, list(_next)] = True
_FOLLOWS = _FOLLOWS.ravel()
# Kinds of cells, by their type attribute.
_NUMBER, _SHARED, _TRUTH, _AS_IS, _NOTHING, _PARSED = range(6)
_KINDS = {ord("n"): _NUMBER, ord("s"): _SHARED, ord("b"): _TRUTH, ord("e"): _AS_IS, ord("d"): _AS_IS}
# No space, control that separates, or separator in Unicode, as ``rlike`` with the pattern for CSV cells has it.
_VISIBLE = re.compile("[^ \t\n\x0b\f\r\x1c-\x1f\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: XML read as arrays at a time.
_BLOCK_BYTES = 1 << 20
_SPACES = frozenset(b"\t\n\r")


def local_name(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def inner_text(element) -> str:
    """The text of a string item or inline string, without the phonetic runs beside it."""
    if local_name(element) == "rPh":
        return ""
    return (element.text or "" if local_name(element) == "t" else "") + "".join(inner_text(child) for child in element)


def _position(reference: str) -> int:
    position = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        position = position * 26 + ord(letter) - 64
    return position - 1


def _wrapped(head: bytes, xml: bytes) -> bytes:
    return b"".join((head, xml, b"</", re.match(rb"<([\w:]+)", head)[1], b">"))


def stretch_rows(head: bytes, rows: bytes, strings: Sequence[str] | Mapping[int, str], formats: Mapping[int, str], from_1904: bool) -> Iterator[list[str | None]]:
    """What the cells of a stretch show, row by row."""
    for _, element in ElementTree.iterparse(io.BytesIO(_wrapped(head, rows))):
        if local_name(element) != "row":
            continue
        row: list[str | None] = []
        for cell in element:
            if local_name(cell) != "c":
                continue
            reference = cell.get("r")
            position = _position(reference) if reference else len(row)
            row.extend([None] * (position + 1 - len(row)))
            row[position] = _cell_text(cell, strings, formats, from_1904)
        element.clear()
        yield row


def _cell_text(cell, strings: Sequence[str] | Mapping[int, str], formats: Mapping[int, str], from_1904: bool) -> str | None:
    parts = {local_name(part): part for part in cell}
    if "f" in parts and parts["f"].text:
        return parts["f"].text
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return inner_text(parts["is"]) if "is" in parts else None
    value = parts["v"].text if "v" in parts else None
    if value is None:
        return None
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind == "n":
        return compiled(formats.get(int(cell.get("s") or 0), "General"), from_1904)(float(value))
    return value


class _Tags:
    """Where the tags of a stretch are and what they are; ``regular`` if its cells can be read from that."""

    def __init__(self, rows: bytes):
        self.bytes = raw = np.frombuffer(rows + b"\0\0\0\0", np.uint8)
        self.start, self.end = np.flatnonzero(raw == ord("<")), np.flatnonzero(raw == ord(">"))
        self.regular = False
        if len(self.start) != len(self.end) or (self.start > self.end).any() or (self.end[:-1] > self.start[1:]).any():
            return
        if b"<!" in rows or b"<?" in rows or not _SPACES.issuperset(raw[:-4][raw[:-4] < 32].tolist()):
            return
        self.kind = kind = _BY_START[raw[self.start + 1] + raw[self.start + 2].astype(np.uint16) * 256]
        for known, rest in ((_CELL_END, b">"), (_VALUE_END, b">"), (_ROW_END, b"ow>"), (_ROW, b"w")):
            at = np.flatnonzero(kind == known)
            for n, byte in enumerate(rest, start=3):
                kind[at[raw[self.start[at] + n] != byte]] = _OTHER
        self.closed = raw[self.end - 1] == ord("/")
        empty = np.flatnonzero(self.closed)
        if len(empty):
            kind[empty[kind[empty] == _VALUE]] = _OTHER
            kind[empty[(kind[empty] == _CELL) | (kind[empty] == _ROW)]] += 1
        row = np.flatnonzero((kind == _ROW) | (kind == _ROW_EMPTY))
        ends = raw[self.start[row] + 4]
        self.regular = bool(
            len(kind) and kind[0] in (_ROW, _ROW_EMPTY) and kind[-1] in (_ROW_END, _ROW_EMPTY) and _FOLLOWS[kind[:-1] * np.int8(9) + kind[1:]].all()
            and ((ends <= 32) | (ends == ord(">")) | (ends == ord("/"))).all())


class _Cells:
    """The cells of regular rows: row, position (``None`` if only some cells name theirs), kind, style and value of each."""

    def __init__(self, tags: _Tags, head: bytes, rows: bytes, strings, formats: Mapping[int, str], from_1904: bool):
        kind, raw = tags.kind, tags.bytes
        open_ = np.flatnonzero((kind == _CELL) | (kind == _CELL_EMPTY))
        rows_before = np.searchsorted(open_, np.flatnonzero((kind == _ROW) | (kind == _ROW_EMPTY)))
        self.rows = len(rows_before)
        self.row = np.repeat(np.arange(self.rows), np.diff(rows_before, append=len(open_)))
        closed = kind[open_] == _CELL_EMPTY
        padded = np.concatenate([kind, np.zeros(3, np.int8)])
        simple = ~closed & (padded[open_ + 1] == _VALUE) & (padded[open_ + 2] == _VALUE_END) & (padded[open_ + 3] == _CELL_END)
        empty = closed | (padded[open_ + 1] == _CELL_END)
        close = open_.copy()
        close[~closed] = np.flatnonzero(kind == _CELL_END)
        at, until = tags.start[open_], tags.end[close]
        self.type, self.style, self.position, plain = _attributes(raw, at, tags.end[open_], closed)
        value = np.minimum(open_ + 1, len(kind) - 1)
        self.start = np.where(simple, tags.end[value] + 1, 0)
        self.end = np.where(simple, tags.start[np.minimum(value + 1, len(kind) - 1)], 0)
        self.type[empty | simple & (self.start == self.end)] = _NOTHING
        plain &= simple | empty
        for byte in (b"&", b"\r"):
            if byte in rows:
                found = np.flatnonzero(raw == byte[0])
                plain &= np.searchsorted(found, at) == np.searchsorted(found, until)
        self.parsed: dict[int, str | None] = {}
        odd = np.flatnonzero(~plain)
        if len(odd):
            xml = b"".join(rows[a : b + 1] for a, b in zip(at[odd].tolist(), until[odd].tolist()))
            for n, cell in zip(odd.tolist(), ElementTree.fromstring(_wrapped(head, xml)), strict=True):
                self.parsed[n] = _cell_text(cell, strings, formats, from_1904)
                self.position[n] = _position(cell.get("r")) if cell.get("r") else -1
            self.type[odd] = _PARSED
            self.start[odd] = self.end[odd] = 0
        named = self.position >= 0
        if not named.any():
            first = np.concatenate([[True], self.row[1:] != self.row[:-1]])[: len(self.row)]
            self.position = np.arange(len(self.row)) - np.maximum.accumulate(np.where(first, np.arange(len(self.row)), 0))
        elif not named.all():
            self.position = None
        self.values = _values(raw, self.start, self.end)

    @classmethod
    def of(cls, blocks: Sequence[_Cells]) -> _Cells:
        """The cells of one block after another."""
        if len(blocks) == 1:
            return blocks[0]
        out, rows, cells = cls.__new__(cls), 0, 0
        out.parsed = {}
        for block in blocks:
            block.row += rows
            out.parsed |= {n + cells: text for n, text in block.parsed.items()}
            rows, cells = rows + block.rows, cells + len(block.row)
        for name in ("row", "position", "type", "style"):
            setattr(out, name, np.concatenate([getattr(block, name) for block in blocks]))
        out.rows, out.values = rows, pa.concat_arrays([block.values for block in blocks])
        return out


def _attributes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, closed: np.ndarray):
    """Kind, style and position that the tags of cells name, and which tags hold nothing but these, written plainly."""
    quotes = np.flatnonzero(raw == ord('"'))
    first, last = np.searchsorted(quotes, start), np.searchsorted(quotes, end)
    count = last - first
    kind, style, position = (np.full(len(start), n, np.int64) for n in (_NUMBER, 0, -1))
    plain, seen = count % 2 == 0, np.zeros((3, len(start)), bool)
    before = start + 1  # the byte before each attribute's space
    quotes = np.concatenate([quotes, np.zeros(8, np.int64)])
    for n in range(0, min(int(count.max(initial=0)), 6), 2):
        more = plain & (count > n)
        has = slice(None) if more.all() else np.flatnonzero(more)
        a, b = quotes[first[has] + n], quotes[first[has] + n + 1]
        ok = (a == before[has] + 4) & (raw[a - 1] == ord("=")) & (raw[a - 3] == ord(" "))
        before[has] = b
        name, size = raw[a - 2], b - a - 1
        for m, (letter, read) in enumerate((("r", _reference), ("s", _digits), ("t", _type))):
            mine = name == ord(letter)
            if not mine.any():
                continue
            mine = slice(None) if mine.all() else np.flatnonzero(mine)
            place = mine if isinstance(has, slice) else has[mine]
            found, good = read(raw, a[mine] + 1, size[mine])
            (position, style, kind)[m][place] = found
            ok[mine] &= good & ~seen[m, place]
            seen[m, place] = True
        ok &= (name == ord("r")) | (name == ord("s")) | (name == ord("t"))
        plain[has] &= ok
    plain &= (count <= 6) & (before + 1 + closed == end)
    return kind, style, position, plain


def _reference(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    position, letters = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    good = size > 1
    for n in range(4):
        if not letters.any():
            break
        byte = raw[at + n]
        letters &= (byte >= ord("A")) & (byte <= ord("Z")) & (n < size)
        good &= bool(n) | letters
        position = np.where(letters, position * 26 + byte - 64, position)
    return position - 1, good & ~letters


def _digits(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number, good = np.zeros(len(at), np.int64), (size > 0) & (size < 8)
    for n in range(min(int(size.max(initial=0)), 7)):
        byte, within = raw[at + n], n < size
        good &= ~within | (byte >= ord("0")) & (byte <= ord("9"))
        number = np.where(within, number * 10 + byte - 48, number)
    return number, good


def _type(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind, good = np.full(len(at), _NUMBER, np.int64), np.zeros(len(at), bool)
    for byte, known in _KINDS.items():
        found = (size == 1) & (raw[at] == byte)
        kind[found], good[found] = known, True
    if (size == 3).any():
        text = (size == 3) & (raw[at] == ord("s")) & (raw[at + 1] == ord("t")) & (raw[at + 2] == ord("r"))
        kind[text], good[text] = _AS_IS, True
    return kind, good


def _values(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Parts of the bytes as texts."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = raw[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]).cast(pa.string())


def _numbers(values: pa.Array, to: pa.DataType, read) -> np.ndarray:
    try:
        return values.cast(to).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # blanks around it, for one
        return np.array([read(v) for v in values.to_pylist()])


def _texts(values: pa.Array, kind: int, style: int, strings, formats: Mapping[int, str], from_1904: bool) -> pa.Array:
    if kind == _NUMBER:
        return compiled_many(formats.get(style, "General"), from_1904)(_numbers(values, pa.float64(), float))
    if kind == _SHARED:
        return pa.array([strings[n] for n in _numbers(values, pa.int64(), int).tolist()], pa.string())
    if kind == _TRUTH:
        return pc.if_else(pc.equal(values, "1"), "TRUE", "FALSE")
    return values if kind == _AS_IS else pa.nulls(len(values), pa.string())


def _column(cells: _Cells, mine: np.ndarray, values: pa.Array, count: int, strings, formats: Mapping[int, str], from_1904: bool) -> pa.Array:
    """One column of a stretch; ``mine`` are its cells, in the order of rows."""
    kinds, row = cells.type[mine], cells.row[mine]
    look = kinds + 8 * np.where(kinds == _NUMBER, cells.style[mine], 0)
    pieces, same = [], len(look) and (look == look[0]).all()
    for code in [look[0].item()] if same else np.unique(look).tolist():
        at = np.arange(len(look)) if same else np.flatnonzero(look == code)
        some = values if len(at) == len(look) else values.take(pa.array(at))
        texts = (pa.array([cells.parsed[n] for n in mine[at].tolist()], pa.string()) if code % 8 == _PARSED
                 else _texts(some, code % 8, code // 8, strings, formats, from_1904))
        pieces.append((at, texts))
    texts = placed(len(mine), pieces) if pieces else pa.nulls(0, pa.string())
    if len(row) == count and (row == np.arange(count)).all():
        return texts
    at = np.full(count, -1, np.int64)
    at[row] = np.arange(len(row))  # of cells at one place the last one counts
    return texts.take(pa.array(at, mask=at < 0))


def stretch_columns(head: bytes, rows: bytes, strings: Sequence[str] | Mapping[int, str], formats: Mapping[int, str], from_1904: bool,
                    width: int, skip: int = 0) -> list[pa.Array]:
    """What the first ``width`` columns of a stretch show, without the first ``skip`` rows and rows that show nothing."""
    prefix = re.match(rb"<(\w+:)", head)
    plain = rows.replace(b"<" + prefix[1], b"<").replace(b"</" + prefix[1], b"</") if prefix else rows
    found = _all_cells(head, plain, strings, formats, from_1904)
    if found is None:
        whole = [(row + [None] * width)[:width] for row in stretch_rows(head, rows, strings, formats, from_1904)][skip:]
        columns = [pa.array(column, pa.string()) for column in zip(*whole)] if whole else [pa.nulls(0, pa.string())] * width
        return _shown_rows(columns)
    cells, count = found
    cells.row -= skip
    used = np.flatnonzero((cells.position < width) & (cells.row >= 0))
    used = used[np.argsort(cells.position[used].astype(np.uint16), kind="stable")]
    values = cells.values.take(pa.array(used))
    bounds = np.searchsorted(cells.position[used], np.arange(width + 1))
    return _shown_rows([
        _column(cells, used[a:b], values[a:b], max(count - skip, 0), strings, formats, from_1904) for a, b in zip(bounds.tolist(), bounds[1:].tolist())])


def _all_cells(head: bytes, rows: bytes, strings, formats: Mapping[int, str], from_1904: bool) -> tuple[_Cells, int] | None:
    """The cells of a stretch and the number of its rows, read by blocks that stay in the processor's cache; ``None`` if a block isn't regular."""
    blocks, at = [], 0
    while at < len(rows) or not blocks:
        end = rows.rfind(b"</row>", at, at + _BLOCK_BYTES)
        end = end if end >= 0 else rows.find(b"</row>", at)
        end = end + 6 if end >= 0 else len(rows)
        if len(rows) - end < _BLOCK_BYTES // 8:
            end = len(rows)
        tags = _Tags(rows[at:end])
        cells = _Cells(tags, head, rows[at:end], strings, formats, from_1904) if tags.regular else None
        if cells is None or cells.position is None:
            return None
        blocks.append(cells)
        at = end
    return _Cells.of(blocks), sum(block.rows for block in blocks)


def _shown_rows(columns: list[pa.Array]) -> list[pa.Array]:
    """Columns without the rows in which nothing but white space is shown; a cell without any visible character is NULL."""
    shown, out = np.zeros(len(columns[0]), bool), []
    for column in columns:
        first = _first_bytes(column)
        plain = (first > 32) & (first < 127)
        shown |= plain
        odd = np.flatnonzero(~plain & (column.is_valid().to_numpy(zero_copy_only=False)))
        if len(odd):
            texts = column.take(pa.array(odd)).to_pylist()
            shown[odd] |= [bool(text.strip()) for text in texts]
            blank = np.zeros(len(column), bool)
            blank[odd] = [not _VISIBLE.search(text) for text in texts]
            column = pc.if_else(pa.array(blank), pa.scalar(None, pa.string()), column)
        out.append(column)
    return out if shown.all() else [column.filter(pa.array(shown)) for column in out]


def _first_bytes(texts: pa.Array) -> np.ndarray:
    """The first byte of each text, 0 for none."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), np.uint8)
    if size.any():
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts)]
        out[size > 0] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[size > 0]]
    return out
