"""Reading column-oriented JSON (``{column: {row: value}}``) in bounded memory.

A file holds its columns one after the other, so a row's values lie far apart. One pass over the
bytes finds where each column begins and ends; then every column is read by a cursor of its own,
a chunk at a time, and the cursors go on in step. Nothing holds a column, let alone a file, as a
whole. Where the columns' rows differ, the rest of the file is matched by row key, in as many turns
as keep a turn's keys within ``HELD`` bytes.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
HELD = 64 << 20
_PARSE = json.JSONDecoder(parse_float=str, parse_int=str, parse_constant=str)


def opened(path: str):
    """A file of any store that Arrow knows (``file:``, ``s3:``, ``hdfs:`` …), for random reads."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def _plain(raw: bytes) -> np.ndarray:
    """The bytes with escape sequences blanked, so that every quote left opens or closes a string."""
    return np.frombuffer(raw.replace(b"\\\\", b"  ").replace(b'\\"', b"  "), dtype=np.uint8)


def _chunks(f, start: int, end: int, size: int) -> Iterator[bytes]:
    """The bytes of ``[start, end)`` in pieces that end in no half of an escape sequence."""
    f.seek(start)
    left, kept = end - start, b""
    while left:
        raw = f.read(min(size, left))
        if not raw:
            raise ValueError("file ends early")
        left -= len(raw)
        raw = kept + raw
        back = len(raw) - len(raw.rstrip(b"\\"))
        kept = raw[-1:] if back % 2 and left else b""
        yield raw[:len(raw) - len(kept)]


def layout(f, length: int, chunk: int = CHUNK) -> list[tuple[str, int, int]]:
    """``(column, start, end)``: the bytes between the braces of each column."""
    found, at, depth, inside, begun = [], 0, 0, 0, 0
    name = b""
    for raw in _chunks(f, 0, length, chunk):
        plain = _plain(raw)
        quotes = plain == 34
        outside = (np.cumsum(quotes) + inside) % 2 == 0
        taken = 0  # of this piece, up to where names have been looked for
        for i in np.flatnonzero(((plain == 123) | (plain == 125) | (plain == 91)) & outside):
            if plain[i] == 91:
                raise ValueError("an array")
            if plain[i] == 123:
                depth += 1
                if depth == 1:
                    if (name + raw[taken:i]).strip():
                        raise ValueError("text before the object")
                elif depth == 2:
                    label = (name + raw[taken:i]).strip().lstrip(b",").strip()
                    if not label.endswith(b":"):
                        raise ValueError("a column without a name")
                    found.append([json.loads(label[:-1].decode()), at + int(i) + 1, -1])
                else:
                    raise ValueError("a nested value")
            else:
                depth -= 1
                if depth == 1:
                    found[-1][2] = at + int(i)
                elif depth == 0:
                    if (name + raw[taken:i]).strip():
                        raise ValueError("a column that is no object")
                else:
                    raise ValueError("a brace too many")
            name, taken = b"", i + 1
            begun = 1
        if depth != 2:
            name += raw[taken:]
        inside = (inside + int(quotes.sum())) % 2
        at += len(raw)
    if depth or inside or name.strip() or not begun:
        raise ValueError("no whole object")
    return [tuple(x) for x in found]


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else ("true" if v else "false")


def entries(f, start: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[list[str], list[str | None]]]:
    """A column's row keys and values (as text), a chunk at a time."""
    rest, size, read = b"", chunk, start
    while read < end or rest:
        raw = b""
        for raw in _chunks(f, read, min(end, read + size), size):
            break
        read += len(raw)
        raw = rest + raw
        if read >= end:
            part, rest = raw, b""
        else:
            back = len(raw) - len(raw.rstrip(b"\\"))
            if back % 2:  # the pieces of _chunks end whole, one that is cut short here does not
                raw, read = raw[:-1], read - 1
            plain = _plain(raw)
            commas = np.flatnonzero((plain == 44) & (np.cumsum(plain == 34) % 2 == 0))
            if not len(commas):
                rest, size = raw, size * 2  # one value fills the chunk
                continue
            part, rest, size = raw[:commas[-1]], raw[commas[-1] + 1:], chunk
        if part.strip():
            found = _PARSE.decode("{" + part.decode() + "}")
            yield list(found), [_text(v) for v in found.values()]


def rows(f, length: int, columns: list[str], chunk: int = CHUNK, held: int = HELD) -> Iterator[tuple[list[str], list[list[str | None]]]]:
    """Batches ``(row keys, values of each of columns)``; a column the file lacks is all null. The rows are the union
    of the columns' keys."""
    where = {name: (a, b) for name, a, b in layout(f, length, chunk)}
    have = [c for c in columns if c in where]
    if not have:
        return
    cursors = [entries(f, *where[c], chunk) for c in have]
    keys: list[list[str]] = [[] for _ in have]
    values: list[list] = [[] for _ in have]
    open_ = [True] * len(have)
    while True:
        for j, c in enumerate(cursors):
            if not keys[j] and open_[j]:
                more = next(c, None)
                open_[j] = more is not None
                keys[j], values[j] = more or ([], [])
        n = min(map(len, keys))
        if not n or any(k[:n] != keys[0][:n] for k in keys[1:]):
            break
        yield keys[0][:n], [values[have.index(c)][:n] if c in where else [None] * n for c in columns]
        keys, values = [k[n:] for k in keys], [v[n:] for v in values]
    if any(keys):
        yield from _matched(f, where, columns, have, cursors, keys, values, held)


def _matched(f, where, columns, have, cursors, keys, values, held):
    """What is left of columns whose rows differ, matched by key, some of the keys at a turn."""
    rest = [list(zip(k, v, strict=True)) for k, v in zip(keys, values, strict=True)]
    done = [r[0][0] if r else None for r in rest]  # the first row of each column that is still to come
    turns = max(1, -(-sum(b - a for a, b in (where[c] for c in have)) * 4 // held))
    for turn in range(turns):
        found: dict[str, list] = {}
        for j, c in enumerate(have):
            if done[j] is None:
                continue
            i, coming = columns.index(c), False
            for ks, vs in entries(f, *where[c]):
                for k, v in zip(ks, vs, strict=True):
                    coming = coming or k == done[j]
                    if coming and (turns == 1 or zlib.crc32(k.encode()) % turns == turn):
                        found.setdefault(k, [None] * len(columns))[i] = v
        every = list(found)
        for a in range(0, len(every), 10_000):
            part = every[a:a + 10_000]
            yield part, [[found[k][i] for k in part] for i in range(len(columns))]


def column_names(f, length: int) -> list[str]:
    return [name for name, _, _ in layout(f, length)]


def as_file(content: bytes | None, path: str):
    return io.BytesIO(content) if content is not None else opened(path)
