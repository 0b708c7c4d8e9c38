"""Pages of plain PDF files by random access: only the objects of the pages asked for are read.

This is the reader where no PDF library is installed.  It knows cross-reference tables, streams that
are plain or deflated, and fonts of one byte a character; what needs more (cross-reference streams,
encryption, composite fonts, other filters) raises ``ValueError``, so that it is told and not guessed.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from typing import BinaryIO, NamedTuple

from .pdf import Page

#: Width of a character of a font without widths, in thousandths of its size; gap that parts words, in sizes.
WIDTH, GAP, DEPTH = 500.0, 0.2, 64

_TOKEN = re.compile(rb"[\x00\t\n\f\r ]+|%[^\r\n]*|(<<|>>|\[|\])|/([^\x00\t\n\f\r ()<>\[\]{}/%]*)|\(|<([0-9A-Fa-f\x00\t\n\f\r ]*)>|([^\x00\t\n\f\r ()<>\[\]{}/%]+)|.", re.S)
_ESCAPE = re.compile(rb"\\(\r\n|[0-7]{1,3}|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Ref(NamedTuple):
    number: int


class Name(str):
    """A PDF name without its slash."""


class Word(bytes):
    """A keyword or operator."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose bracket opens before ``at``, and where it ends."""
    depth, i = 1, at
    while depth:
        found = re.compile(rb"[\\()]").search(data, i)
        if not found:
            raise ValueError("open string")
        i = found.end() + (found[0] == b"\\")
        depth += {b"(": 1, b")": -1}.get(found[0], 0)
    code = lambda m: _NAMED.get(m[1], bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else m[1])
    return _ESCAPE.sub(code, data[at : i - 1]), i


def tokens(data: bytes):
    """Values and operators of ``data`` in order, each with its end; brackets come as words."""
    at = 0
    while at < len(data):
        m = _TOKEN.match(data, at)
        at = m.end()
        if m[1]:
            yield Word(m[1]), at
        elif m[2] is not None:
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), m[2]).decode("latin-1")), at
        elif m[0] == b"(":
            value, at = _literal(data, at)
            yield value, at
        elif m[3] is not None:
            digits = re.sub(rb"\s", b"", m[3].replace(b"\0", b"")).decode()
            yield bytes.fromhex(digits + "0" * (len(digits) % 2)), at
        elif m[4]:
            try:
                yield (float(m[4]) if b"." in m[4] else int(m[4])), at
            except ValueError:
                yield Word(m[4]), at


def values(data: bytes):
    """Values and operators with arrays and dictionaries put together, each with its end."""
    stack: list[list] = []
    out: list = []
    for token, end in tokens(data):
        if isinstance(token, Word) and token in (b"<<", b"["):
            stack.append(out)
            if len(stack) > DEPTH:
                raise ValueError("nested too deep")
            out = []
            continue
        if isinstance(token, Word) and token in (b">>", b"]"):
            if not stack:
                raise ValueError("bracket without beginning")
            token, out = (out if token == b"]" else dict(zip(out[::2], out[1::2], strict=True))), stack.pop()
        elif isinstance(token, Word) and token == b"R" and len(out) > 1 and isinstance(out[-2], int):
            token = Ref(out[-2])
            del out[-2:]
        elif isinstance(token, Word) and token in (b"true", b"false", b"null"):
            token = {b"true": True, b"false": False, b"null": None}[bytes(token)]
        if stack:
            out.append(token)
        elif isinstance(token, Ref):
            yield token, end
        else:
            out = [*out[-1:], token]  # a reference's two numbers
            yield token, end


class Document:
    """An open file: ``len`` is its number of pages, ``page(i)`` reads one."""

    def __init__(self, file: BinaryIO):
        self.file = file
        size = file.seek(0, 2)
        tail = self._bytes(max(0, size - 2048), size)
        at = re.findall(rb"startxref\s+(\d+)", tail)
        if not at:
            raise ValueError("no cross-references")
        self.where: dict[int, int] = {}
        self.root, follow, seen = None, int(at[-1]), set()
        while follow is not None and follow not in seen:
            seen.add(follow)
            trailer = self._table(self._bytes(follow, size))
            self.root = self.root or trailer.get("Root")
            follow = trailer.get("Prev")
            if "Encrypt" in trailer:
                raise ValueError("encrypted")
        self.starts = sorted({*self.where.values(), *seen, size})
        self.pages = self.get(self.get(self.root)["Pages"])

    def _bytes(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(end - start)

    def _table(self, data: bytes) -> dict:
        if not data.startswith(b"xref"):
            raise ValueError("cross-reference streams are not read")
        head, _, rest = data.partition(b"trailer")
        lines = head.split()[1:]
        i = 0
        while i + 1 < len(lines):
            first, n = int(lines[i]), int(lines[i + 1])
            for j in range(n):
                offset, _, used = lines[i + 2 + 3 * j : i + 5 + 3 * j]
                if used == b"n":
                    self.where.setdefault(first + j, int(offset))
            i += 2 + 3 * n
        return next(v for v, _ in values(rest) if isinstance(v, dict))

    def get(self, value, stream: bool = False):
        """What ``value`` refers to; with ``stream`` the decoded bytes of the object."""
        for _ in range(DEPTH):
            if not isinstance(value, Ref):
                return value
            start = self.where.get(value.number)
            if start is None:
                return None
            data = self._bytes(start, self.starts[bisect_right(self.starts, start)])
            body = data.index(b"obj") + 3
            inner, end = next(((v, e) for v, e in values(data[body:])), (None, 0))
            if stream:
                return self._stream(inner, data[body + end :])
            value = inner
        raise ValueError("references in a circle")

    def _stream(self, head, rest: bytes) -> bytes:
        m = re.match(rb"\s*stream\r?\n", rest)
        if not isinstance(head, dict) or not m:
            raise ValueError("no stream")
        raw = rest[m.end() : m.end() + int(self.get(head.get("Length", 0)))]
        filters = self.get(head.get("Filter")) or []
        for name in [filters] if isinstance(filters, str) else filters:
            if name not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {name} is not read")
            raw = zlib.decompress(raw)
        return raw

    def __len__(self) -> int:
        return int(self.get(self.pages.get("Count", 0)))

    def page(self, i: int) -> Page:
        """Page ``i`` from 0, found by the counts of the page tree."""
        node, held = self.pages, {}
        for _ in range(DEPTH):
            held |= {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" not in node:
                return self._read(node, held)
            for kid in self.get(node["Kids"]):
                below = self.get(kid)
                n = int(self.get(below.get("Count", 1))) if "Kids" in below else 1
                if i < n:
                    node = below
                    break
                i -= n
            else:
                raise ValueError("no such page")
        raise ValueError("page tree too deep")

    def _read(self, page: dict, held: dict) -> Page:
        contents = page.get("Contents")
        inner = self.get(contents)
        parts = inner if isinstance(inner, list) else [contents] if contents else []
        data = b"\n".join(self.get(p, stream=True) for p in parts)
        fonts = self.get((self.get(held.get("Resources")) or {}).get("Font")) or {}
        top = float(self.get(held.get("MediaBox", [0, 0, 612, 792]))[3])
        placed, ruled = drawn(data, {k: self._font(self.get(v)) for k, v in fonts.items()}, top)
        return Page(lines(placed), ruled, [w[:4] for w in placed])

    def _font(self, font: dict) -> tuple[int, list[float]]:
        if font.get("Subtype") == "Type0":
            raise ValueError("composite fonts are not read")
        return int(self.get(font.get("FirstChar", 0))), [float(self.get(w)) for w in self.get(font.get("Widths")) or []]


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def drawn(data: bytes, fonts: dict, top: float) -> tuple[list[tuple], bool]:
    """Words (text, x0, x1, top, size) that a content stream draws, and whether it draws a grid of lines."""
    whole = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, text, line, saved, args, words, strokes = whole, whole, whole, [], [], [], 0
    font, size, lead, chars, spaces = (0, []), 1.0, 0.0, 0.0, 0.0

    def show(raw: bytes):
        nonlocal text
        first, widths = font
        for code in raw:
            wide = widths[code - first] if 0 <= code - first < len(widths) else WIDTH
            step = wide / 1000 * size + chars + (spaces if code == 32 else 0)
            at, after = _times(text, ctm), _times((1, 0, 0, 1, step, 0), _times(text, ctm))
            sign = bytes([code]).decode("cp1252", "replace")
            height = abs(at[3]) * size
            if sign.strip():
                last = words[-1] if words else None
                if last and last[5] and abs(last[3] - (top - at[5] - height)) < 0.5 and 0 <= at[4] - last[2] + 0.01 <= GAP * height + 0.01:
                    words[-1] = (last[0] + sign, last[1], after[4], *last[3:])
                else:
                    words.append((sign, at[4], after[4], top - at[5] - height, height, True))
            elif words:
                words[-1] = (*words[-1][:5], False)
            text = _times((1, 0, 0, 1, step, 0), text)

    for token, _ in values(data):
        if not isinstance(token, Word):
            args.append(token)
            continue
        op = bytes(token)
        if op == b"BT":
            text = line = whole
        elif op == b"Tf":
            font, size = fonts.get(args[-2], (0, [])), float(args[-1])
        elif op in (b"Td", b"TD"):
            lead = -args[-1] if op == b"TD" else lead
            text = line = _times((1, 0, 0, 1, args[-2], args[-1]), line)
        elif op == b"Tm":
            text = line = tuple(map(float, args[-6:]))
        elif op in (b"TL", b"Tc", b"Tw"):
            lead, chars, spaces = (args[-1] if op == n else v for n, v in ((b"TL", lead), (b"Tc", chars), (b"Tw", spaces)))
        elif op in (b"T*", b"'", b'"'):
            text = line = _times((1, 0, 0, 1, 0, -lead), line)
        elif op == b"cm":
            ctm = _times(tuple(map(float, args[-6:])), ctm)
        elif op == b"q":
            saved.append((ctm, font, size, lead, chars, spaces))
        elif op == b"Q" and saved:
            ctm, font, size, lead, chars, spaces = saved.pop()
        strokes += op in (b"l", b"re")
        if op in (b"Tj", b"'", b'"'):
            show(args[-1])
        elif op == b"TJ":
            for part in args[-1]:
                if isinstance(part, bytes):
                    show(part)
                else:
                    text = _times((1, 0, 0, 1, -part / 1000 * size, 0), text)
        args = []
    return words, strokes >= 4


def lines(words: list[tuple]) -> str:
    """The words as text, in lines from the top."""
    rows: dict[int, list[tuple]] = {}
    for w in words:
        rows.setdefault(round(w[3]), []).append(w)
    return "\n".join(" ".join(w[0] for w in sorted(rows[t], key=lambda w: w[1])) for t in sorted(rows))
