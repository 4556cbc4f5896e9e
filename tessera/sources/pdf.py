"""Text and document information of PDF files (S5, S7), with the standard library only.

Objects are found by scanning the file, so damaged cross-reference tables do not
matter; compressed object streams are opened. Text is what the pages' content
streams show, decoded by each font's ToUnicode map or else as Windows-1252. Scans,
encrypted files and filters other than Flate are refused with a reason.
"""

from __future__ import annotations

import re
import zlib

MAX_STREAM = 200 << 20
_SPACE, _DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}


class PdfError(ValueError):
    """A PDF file that cannot be read."""


class Name(str):
    """/Name"""


class Ref(int):
    """n 0 R"""


class Operator(str):
    """A bare word: an operator of a content stream, or true, false, null."""


class _Reader:
    """Objects from PDF syntax: dict, list, bytes for strings, Name, Ref, numbers and Operator."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        m = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*").match(self.data, self.at)
        self.at = m.end()

    def next(self) -> object:
        """The next object; EOFError at the end."""
        self._skip()
        two, one = self.data[self.at : self.at + 2], self.data[self.at : self.at + 1]
        if not one:
            raise EOFError
        if two == b"<<":
            self.at += 2
            items = self._until(b">>")
            return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, str)}
        if one == b"[":
            self.at += 1
            return self._until(b"]")
        if one == b"(":
            return self._literal()
        if one == b"<":
            end = self.data.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at + 1 : end if end > 0 else len(self.data)])
            self.at = end + 1 if end > 0 else len(self.data)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if one == b"/":
            m = re.compile(rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)").match(self.data, self.at)
            self.at = m.end()
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), m[1]).decode("latin-1"))
        if m := re.compile(rb"(\d+)\s+\d+\s+R(?![A-Za-z0-9])").match(self.data, self.at):
            self.at = m.end()
            return Ref(m[1])
        m = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+").match(self.data, self.at)
        if not m:
            self.at += 1
            return Operator("")
        self.at = m.end()
        word = m[0].decode("latin-1")
        if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)", word):
            return float(word) if "." in word else int(word)
        return Operator(word)

    def _until(self, end: bytes) -> list:
        out = []
        while True:
            self._skip()
            if self.data.startswith(end, self.at):
                self.at += len(end)
                return out
            try:
                out.append(self.next())
            except EOFError:
                return out

    def _literal(self) -> bytes:
        out, depth = [], 0
        for m in re.compile(rb"\\(\d{1,3}|\r\n|.)|[()]|[^\\()]+", re.S).finditer(self.data, self.at):
            token = m[0]
            if token == b"(":
                depth += 1
                if depth == 1:
                    continue
            elif token == b")":
                depth -= 1
                if not depth:
                    self.at = m.end()
                    return b"".join(out)
            elif token[:1] == b"\\":
                inner = m[1]
                token = bytes([int(inner, 8) & 255]) if inner.isdigit() and inner.strip(b"89") == inner else b"" if inner in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(inner, inner)
            out.append(token)
        self.at = len(self.data)
        return b"".join(out)


class Pdf:
    """The objects of a file."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise PdfError("not a PDF file")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        self.trailer: dict = {}
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b", data):
            self._object(data, int(m[1]), m.end())
        for m in re.finditer(rb"\btrailer\b", data):
            self._trailer(_Reader(data, m.end()))
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == "XRef":
                self.trailer |= value
        if "Encrypt" in self.trailer:
            raise PdfError("the file is encrypted")
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._packed(number, value)

    def _trailer(self, reader: _Reader) -> None:
        try:
            found = reader.next()
        except EOFError:
            return
        self.trailer |= found if isinstance(found, dict) else {}

    def _object(self, data: bytes, number: int, at: int) -> None:
        reader = _Reader(data, at)
        try:
            value = reader.next()
        except (EOFError, RecursionError):
            return
        self.objects[number] = value
        if m := re.compile(rb"\s*stream\r?\n?").match(data, reader.at):
            length = value.get("Length") if isinstance(value, dict) else None
            end = m.end() + length if isinstance(length, int) and not isinstance(length, Ref) else -1
            if end < 0 or not re.compile(rb"\s*endstream").match(data, end):
                end = data.find(b"endstream", m.end())
            self.streams[number] = data[m.end() : end if end >= 0 else len(data)]

    def _packed(self, number: int, value: dict) -> None:
        data, first = self.stream(number), self.get(value.get("First"))
        head = _Reader(data[: first or 0])
        numbers = [n for n in head._until(b"\x00\x00never") if isinstance(n, int)]
        for n, offset in zip(numbers[::2], numbers[1::2], strict=False):
            try:
                self.objects.setdefault(n, _Reader(data, (first or 0) + offset).next())
            except EOFError:
                continue

    def get(self, value: object) -> object:
        """The object that a reference stands for."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def stream(self, number: int) -> bytes:
        """A stream without its filters."""
        data, info = self.streams.get(number, b""), self.objects.get(number)
        filters = self.get(info.get("Filter")) if isinstance(info, dict) else None
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.get(f) not in ("FlateDecode", "Fl"):
                raise PdfError(f"no reader for the filter {self.get(f)}")
            data = zlib.decompressobj().decompress(data, MAX_STREAM)
        return data

    def pages(self) -> list[dict]:
        """The pages in their order."""
        root, out, seen = self.get(self.trailer.get("Root")), [], set()
        todo = [(root.get("Pages"), {})] if isinstance(root, dict) else []
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and int(ref) in seen:
                continue
            if isinstance(ref, Ref):
                seen.add(int(ref))
            node = {k: v for k, v in above.items() if k == "Resources"} | node
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(k, node) for k in reversed(kids)]
            else:
                out.append(node)
        return out or [v for _, v in sorted(self.objects.items()) if isinstance(v, dict) and v.get("Type") == "Page"]

    def text_of(self, page: dict) -> str:
        resources = self.get(page.get("Resources"))
        fonts = self.get(resources.get("Font")) if isinstance(resources, dict) else None
        fonts = {k: self._font(v) for k, v in fonts.items()} if isinstance(fonts, dict) else {}
        contents = page.get("Contents")
        listed = self.get(contents)
        refs = listed if isinstance(listed, list) else [contents]
        return shown_text(b"\n".join(self.stream(int(r)) for r in refs if isinstance(r, Ref)), fonts)

    def _font(self, ref: object) -> tuple[int, dict[int, str]]:
        """(bytes of a code, codes to text) of a font."""
        font = self.get(ref)
        known = font.get("ToUnicode") if isinstance(font, dict) else None
        if isinstance(known, Ref):
            return to_unicode(self.stream(int(known)))
        return 1, {}


def _utf16(code: bytes) -> str:
    return code.decode("utf-16-be", "replace") if len(code) > 1 else code.decode("latin-1")


def to_unicode(data: bytes) -> tuple[int, dict[int, str]]:
    """A ToUnicode map: the bytes of a code, and what codes stand for."""
    width, codes = 1, {}
    for section in re.finditer(rb"begin(codespacerange|bfchar|bfrange)(.*?)end\1", data, re.S):
        items = _Reader(section[2])._until(b"\x00\x00never")
        if section[1] == b"codespacerange":
            width = max([len(x) for x in items if isinstance(x, bytes)] or [1])
        elif section[1] == b"bfchar":
            codes |= {int.from_bytes(a): _utf16(b) for a, b in zip(items[::2], items[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
        else:
            for low, high, to in zip(items[::3], items[1::3], items[2::3], strict=False):
                first, last = int.from_bytes(low), min(int.from_bytes(high), int.from_bytes(low) + 65_535)
                for i in range(last - first + 1):
                    if isinstance(to, list):
                        if i < len(to) and isinstance(to[i], bytes):
                            codes[first + i] = _utf16(to[i])
                    elif isinstance(to, bytes) and to:
                        codes[first + i] = _utf16((int.from_bytes(to) + i).to_bytes(len(to)))
    return width, codes


def shown_text(content: bytes, fonts: dict[str, tuple[int, dict[int, str]]]) -> str:
    """What a content stream writes: a new line where the text position moves down, a blank at a wide gap."""
    reader, stack, font, out = _Reader(content), [], (1, {}), []

    def write(code: object) -> None:
        if not isinstance(code, bytes):
            return
        width, codes = font
        if codes:
            parts = [int.from_bytes(code[i : i + width]) for i in range(0, len(code), width)]
            out.append("".join(codes.get(p, "") for p in parts))
        else:
            out.append(code.decode("cp1252", "replace"))

    while True:
        try:
            token = reader.next()
        except EOFError:
            break
        if not isinstance(token, Operator):
            stack.append(token)
            continue
        if token == "Tf" and stack:
            font = fonts.get(stack[-2] if len(stack) > 1 else "", (1, {}))
        elif token in ("Tj", "'", '"'):
            if token != "Tj":
                out.append("\n")
            write(stack[-1] if stack else None)
        elif token == "TJ" and stack and isinstance(stack[-1], list):
            for part in stack[-1]:
                if isinstance(part, (int, float)) and part < -200:
                    out.append(" ")
                write(part)
        elif token in ("Td", "TD") and len(stack) > 1:
            out.append("\n" if stack[-1] else " ")
        elif token in ("T*", "Tm", "ET"):
            out.append("\n")
        elif token == "ID":  # an inline image's bytes
            end = re.compile(rb"\sEI(?=\s|$)").search(content, reader.at)
            reader.at = end.end() if end else len(content)
        stack.clear()
    lines = [" ".join(line.split()) for line in "".join(out).split("\n")]
    return "\n".join(line for line in lines if line)


def told(value: object) -> str | None:
    """A text string of the document information: UTF-16 with its mark, else Latin."""
    if not isinstance(value, bytes):
        return None
    text = value[2:].decode("utf-16-be", "replace") if value[:2] == b"\xfe\xff" else value.decode("utf-8-sig" if value[:3] == b"\xef\xbb\xbf" else "latin-1", "replace")
    return text.strip("\x00 ") or None


def when(value: object) -> str | None:
    """A date, D:YYYYMMDDHHmmSS, in ISO form as far as it goes."""
    m = re.match(r"(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?", told(value) or "")
    if not m:
        return told(value)
    y, mo, d, h, mi, s = (x or y for x, y in zip(m.groups(), ("0000", "01", "01", "00", "00", "00"), strict=True))
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}"


def fingerprint_of(pdf: Pdf) -> dict:
    """Author, dates and the producing program, else the creating one."""
    info = pdf.get(pdf.trailer.get("Info"))
    info = {k: pdf.get(v) for k, v in info.items()} if isinstance(info, dict) else {}
    return {"author": told(info.get("Author")), "app": told(info.get("Producer")) or told(info.get("Creator")), "created": when(info.get("CreationDate")), "modified": when(info.get("ModDate"))}


def page_texts(data: bytes) -> tuple[list[str], dict]:
    """The text of each page and the document's fingerprint. A file without any text is refused: it may be a scan."""
    pdf = Pdf(data)
    texts = [pdf.text_of(p) for p in pdf.pages()]
    if not any(texts):
        raise PdfError("no text in the file; it may be a scan")
    return texts, fingerprint_of(pdf)
