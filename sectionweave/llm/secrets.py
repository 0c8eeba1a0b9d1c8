"""Secret scans of whole texts and of everything that is encoded inside them.

A worklist holds layers. Every layer is scanned, and unwrapped: URL escapes and Unicode escapes are decoded in
place, which gives another version of the whole layer, or two if the bytes are no UTF-8; base64 runs, wrapped at any
width, and the bytes of escapes are decompressed as often as they are compressed, and give layers of their own. A layer that was seen at the same place is not followed again,
which ends cycles, so the list runs empty. Each character of a layer knows the span of the text that it came
from, so every finding is given as a span of the text.
"""

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import record_batch, sliced

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A text without any of these, in either case, has no assignment: much faster to see than by the pattern.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Maximal runs of enough characters are the runs of any length that are long enough.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_RUN = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2})|\\u[0-9A-Fa-f]{4}"
                         r"|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: No secret in base64 is shorter: the shortest has 16 characters.
LEAST_BASE64 = 22
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{22,}={0,2}")
#: What may part the lines of a wrapped run: a line break, also an escaped one, and what the next line is indented by.
BREAK = r"(?:\r?\n|\\r\\n|\\n)[ \t]*"
LINE_BREAK = re.compile(BREAK)
#: A break between two digits, seen from its literal characters: without any there are no wrapped runs.
BETWEEN = (re.compile(r"\n[ \t]*[A-Za-z0-9+/_-]"), re.compile(r"\\n[ \t]*[A-Za-z0-9+/_-]"))
DIGITS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
#: Lines may be one run, or end one: the next line can also be a word that follows it, and the first one a word before it.
#: The letter of an escaped break is no digit of the run behind it.
BASE64_LINES = re.compile(rf"(?:(?<=\\[nr])|(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nr]))[A-Za-z0-9+/_-]{{4,}}(?:{BREAK}[A-Za-z0-9+/_-]+)+={{0,2}}")
#: Escapes of Python and JSON for bytes that stand for single characters.
BYTE_ESCAPE = re.compile(r"\\u00([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\([nrtabfv0\\'\"/])")
SINGLE = {"n": "\n", "r": "\r", "t": "\t", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
#: How compressed data begins, and the characters below U+0100 that it may be made of.
STREAM = re.compile("\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
BYTES = re.compile("[\x00-\xff]*")
BASE64_PART = re.compile(r"[A-Za-z0-9]{22,}={0,2}")
#: Bytes of a layer that are scanned at a time. Larger layers are counted in n_oversize and scanned in pieces.
MAX_LAYER = 16 << 20
#: What two neighbouring pieces have in common. An encoded run that is longer and cut by a piece makes the layer an unread one.
OVERLAP = 4 << 20
#: Bytes that all decompressors of one run may give in all, and formats one inside the other: what has more can be a bomb, and is unread.
MAX_INFLATED = 1 << 30
MAX_DEPTH = 100
#: Memory of an xz decompressor; the largest preset needs 65 MiB. What needs more is unread.
XZ_MEMORY = 256 << 20
INFLATED = 1 << 20
#: Characters of a layer that can wait; larger ones are scanned at once.
SMALL = 1 << 20
RUN_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-\r\n%\\{}&#;"

FINDING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()), T.StructField("layer", T.StringType())])
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("findings", T.ArrayType(FINDING)),
                      T.StructField("n_layers", T.LongType()), T.StructField("n_oversize", T.LongType())])


def scan_layer(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret that stands in ``text`` itself, by start, then kind."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    return sorted(found)


@dataclass
class Layer:
    text: str
    name: str
    #: For each character its span in the document; None in the document itself.
    starts: np.ndarray | None
    ends: np.ndarray | None

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (int(self.starts[start:end].min()), int(self.ends[start:end].max()))

    def rewritten(self, name: str, pieces: list[tuple[int, int, str, list[int]]]) -> "Layer":
        """This layer with the spans of ``pieces`` replaced; each holds, for every new character, the characters it came from."""
        n = len(self.text)
        starts = np.arange(n) if self.starts is None else self.starts
        ends = np.arange(1, n + 1) if self.ends is None else self.ends
        text, froms, tos, at = [], [], [], 0
        for begin, end, new, widths in pieces:
            right = begin + np.cumsum(widths, dtype=np.int64)
            text += [self.text[at:begin], new]
            froms += [starts[at:begin], starts[right - widths]]
            tos += [ends[at:begin], ends[right - 1]]
            at = end
        return Layer("".join([*text, self.text[at:]]), f"{self.name}>{name}", np.concatenate([*froms, starts[at:]]), np.concatenate([*tos, ends[at:]]))

    def inner(self, name: str, text: str, begin: int, end: int) -> "Layer":
        start, stop = self.span(begin, end)
        return Layer(text, f"{self.name}>{name}", np.broadcast_to(np.int64(start), len(text)), np.broadcast_to(np.int64(stop), len(text)))


@dataclass
class Missed:
    """The span of a layer that is over MAX_LAYER or was not read whole."""

    start: int
    end: int
    unread: bool


def url_decoded(run: str) -> tuple[str, list[int]]:
    """Bytes that are no UTF-8 become the replacement character, one each."""
    text = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    widths = [3 * (1 if o < 0x80 or 0xDC80 <= o <= 0xDCFF else 2 if o < 0x800 else 3 if o < 0x10000 else 4) for o in map(ord, text)]
    return re.sub("[\ud800-\udfff]", "\ufffd", text), widths


def url_bytes(run: str) -> tuple[str, list[int]]:
    """Every byte as the character of its number."""
    return bytes.fromhex(run.replace("%", "")).decode("latin-1"), [3] * (len(run) // 3)


def byte_character(m: re.Match) -> str:
    return SINGLE.get(m[3], m[3]) if m[3] else chr(int(m[1] or m[2], 16))


def unicode_decoded(escape: str) -> str:
    """The character of one escape, or of a surrogate pair; what is no character becomes the replacement character."""
    if escape.startswith("&#"):
        code = int(escape[3:-1], 16) if escape[2] in "xX" else int(escape[2:-1])
    elif escape[:2] == "\\u" and len(escape) == 12 and escape[2] != "{":
        code = 0x10000 + (int(escape[2:6], 16) - 0xD800 << 10) + int(escape[8:12], 16) - 0xDC00
    else:
        code = int(escape[2:].strip("{}"), 16)
    return chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else "\ufffd"


def magic(data: bytes) -> str | None:
    if data[:3] == b"\x1f\x8b\x08":
        return "gzip"
    if data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return "zlib"
    return "bz2" if data[:3] == b"BZh" else "xz" if data[:6] == b"\xfd7zXZ\x00" else None


class Member:
    """One decompressor for all formats: ``give`` yields what it makes of more input, in bounded pieces."""

    def __init__(self, name: str):
        self.inflate = (zlib.decompressobj(31) if name == "gzip" else zlib.decompressobj() if name == "zlib"
                        else bz2.BZ2Decompressor() if name == "bz2" else lzma.LZMADecompressor(memlimit=XZ_MEMORY))
        self.zlib = name in ("gzip", "zlib")

    def give(self, data: bytes) -> Iterator[bytes]:
        while True:
            out = self.inflate.decompress(data, INFLATED)
            if out:
                yield out
            data = self.inflate.unconsumed_tail if self.zlib else b""
            if self.inflate.eof or (len(out) < INFLATED and not data if self.zlib else self.inflate.needs_input):
                return


class Run:
    """The bytes inside a base64 run, decompressed as often as they are compressed, as a stream of pieces.

    sound: all streams ended with their data. unread: something was left out, as it needs too much memory or is too long.
    """

    def __init__(self, data: bytes, name: str = "base64"):
        self.names, self.sound, self.unread, self.left = [name], True, False, MAX_INFLATED
        self.pieces, seen = iter([data]), set()
        while True:
            head = b""
            while len(head) < 8 and (piece := next(self.pieces, None)) is not None:
                head += piece
            self.pieces = chain([head], self.pieces)
            if not (name := magic(head)):
                return
            digest = hashlib.sha256(head).digest()
            if digest in seen or len(self.names) > MAX_DEPTH:  # it holds itself
                self.unread = digest not in seen
                self.pieces = iter(())
                return
            seen.add(digest)
            read: list[bytes] = []
            inner = self.members(name, self.pieces, read)
            first = next(inner, None)
            if first is None:
                self.pieces = chain(read, self.pieces)  # not compressed, or empty
                return
            read.clear()
            self.names.append(name)
            self.pieces = chain([first], inner)

    def members(self, name: str, pieces: Iterator[bytes], read: list[bytes]) -> Iterator[bytes]:
        """What all members give, one after another; what follows them is given as it is."""
        member, given, after, fresh = Member(name), False, b"", False
        for piece in pieces:
            if not given:
                read.append(piece)
            if member is None:
                yield piece
                continue
            data = after + piece
            after = b""
            while data:
                if fresh and not data.strip(b"\0"):  # padding between members
                    break
                if fresh:
                    if len(data.lstrip(b"\0")) < 8 and not magic(data.lstrip(b"\0")):
                        after = data
                        break
                    if not (kind := magic(data.lstrip(b"\0"))):
                        member, self.sound = None, False
                        yield b"\n" + data
                        break
                    member, data, fresh = Member(kind), data.lstrip(b"\0"), False
                try:
                    for out in member.give(data):
                        given = True
                        self.left -= len(out)
                        if self.left < 0:
                            self.unread = True
                            return
                        yield out
                except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError) as error:
                    if "emory" in str(error):
                        self.unread = True
                    elif given:
                        member, self.sound = None, False
                        yield b"\n" + data
                        break
                    return
                if not member.inflate.eof:
                    break
                data, fresh = member.inflate.unused_data, True
        if after.strip(b"\0"):
            self.sound = False
            if given:
                yield b"\n" + after
        elif member and not member.inflate.eof:
            self.sound = False


@dataclass
class Inside:
    """What is inside a base64 token: texts (several pieces of a large layer), the names of its layers, whether it reads well,
    which is printable or decompressed to the end, and whether it is large or has unread parts."""

    texts: Iterator[str]
    name: str
    well: bool
    large: bool
    run: Run


def _text(data: bytes) -> str:
    """Where it is no UTF-8, each byte becomes a character: secrets are ASCII, and can stand among any others."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _parts(begin: bytes, run: Run) -> Iterator[str]:
    buffer = bytearray(begin)
    while True:
        text = buffer[:MAX_LAYER].decode("latin-1")
        if len(text) - len(text.rstrip(RUN_CHARACTERS)) > OVERLAP:
            run.unread = True
        yield text
        if len(buffer) <= MAX_LAYER:
            return
        del buffer[:MAX_LAYER - OVERLAP]
        while len(buffer) <= MAX_LAYER and (piece := next(run.pieces, None)) is not None:
            buffer += piece


def unwrapped(token: str) -> Inside | None:
    """What is inside a base64 token; None if there is nothing."""
    raw = re.sub(r"\\[rn]|[\s=]", "", token).translate(str.maketrans("-_", "+/"))
    raw = raw[: len(raw) - (len(raw) % 4 == 1)]
    try:
        data = base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    run = Run(data)
    begin = bytearray()
    while len(begin) <= MAX_LAYER and (piece := next(run.pieces, None)) is not None:
        begin += piece
    if not begin and not run.unread:
        return None
    name, compressed = ">".join(run.names), len(run.names) > 1
    if len(begin) > MAX_LAYER:
        return Inside(_parts(begin, run), name, compressed, True, run)
    if compressed:
        return Inside(iter([_text(bytes(begin))]), name, run.sound, False, run)
    try:
        text = begin.decode("utf-8")
        if text.translate({9: None, 10: None, 13: None}).isprintable():
            return Inside(iter([text]), name, True, False, run)
    except UnicodeDecodeError:
        pass
    return Inside(iter([begin.decode("latin-1")]), name, False, False, run)


def reads_well(token: str) -> bool:
    return bool((inside := unwrapped(token)) and inside.well)


def blocks_of(lines: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Lines of one length, each time with the shorter one that ends them."""
    blocks, size = [], 0
    for line in lines:
        if blocks and size and line[1] - line[0] <= size:
            blocks[-1].append(line)
            size = size if line[1] - line[0] == size else 0
        else:
            blocks.append([line])
            size = line[1] - line[0]
    return blocks


def whole_runs(lines: list[tuple[int, int]], reads: Callable[[tuple[int, int]], bool]) -> list[tuple[int, int]]:
    """Of neighbouring lines, the runs that read well: all of them; else of each block, with or without its last line.

    What is in none of these runs is left to the reading of single lines.
    """
    if reads(run := (lines[0][0], lines[-1][1])):
        return [run]
    found = []
    for block in blocks_of(lines):
        for part in (block, block[:-1]):
            if part and _digits(part) >= LEAST_BASE64 and reads(run := (part[0][0], part[-1][1])):
                found.append(run)
                break
    return found


def within(layer: Layer, begin: int, end: int, lines: list[tuple[int, int]] = ()) -> Iterator[Layer | Missed]:
    """What is inside a run; with ``lines``, bytes that do not read well have the spans of the lines that they come from."""
    if not (inside := unwrapped(layer.text[begin:end])):
        return
    name = inside.name
    if inside.well or inside.large or not lines or name != "base64":
        for text in inside.texts:
            yield layer.inner(name, text, begin, end)
        if inside.large or inside.run.unread:
            yield Missed(*layer.span(begin, end), inside.run.unread)
        return
    text = next(inside.texts)
    if inside.run.unread:
        yield Missed(*layer.span(begin, end), True)
    lines = [line for line in lines if begin <= line[0] and line[1] <= end]
    past = np.cumsum([line[1] - line[0] for line in lines])
    spans = np.array([layer.span(*line) for line in lines])
    first = 4 * np.arange(len(text)) // 3  # the digits that hold a byte are this one and the next
    last = np.minimum(first + 1, past[-1] - 1)
    yield Layer(text, f"{layer.name}>{name}", spans[np.searchsorted(past, first, "right"), 0], spans[np.searchsorted(past, last, "right"), 1])


def stream_end(data: bytes) -> int:
    """Where the compressed data ends that ``data`` begins with, further members included; 0 if it is none."""
    end = 0
    while name := magic(data[end:]):
        member, left = Member(name), MAX_INFLATED
        try:
            for out in member.give(data[end:]):
                left -= len(out)
                if left < 0:
                    return len(data)
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
            return len(data) if left < MAX_INFLATED else end
        if not member.inflate.eof:
            return len(data) if left < MAX_INFLATED else end
        end = len(data) - len(member.inflate.unused_data)
    return end


def streams(layer: Layer) -> Iterator[Layer | Missed]:
    """What is inside compressed data whose bytes stand in a layer as characters."""
    at = 0
    while m := STREAM.search(layer.text, at):
        at = m.end()
        data = BYTES.match(layer.text, m.start())[0].encode("latin-1")
        if not (size := stream_end(data)):
            continue
        at = m.start() + size
        run, text = Run(data[:size], "bytes"), bytearray()
        while len(text) <= MAX_LAYER and (piece := next(run.pieces, None)) is not None:
            text += piece
        name = ">".join(run.names)
        for part in _parts(text, run) if len(text) > MAX_LAYER else [_text(bytes(text))]:
            yield layer.inner(name, part, m.start(), at)
        if run.unread or len(text) > MAX_LAYER:
            yield Missed(*layer.span(m.start(), at), run.unread)


def wrapped_lines(text: str) -> Iterator[list[tuple[int, int]]]:
    """The lines of every run of digits that goes over line breaks."""
    if not any(text[m.start() - 1 - (text[m.start() - 1:m.start()] == "\r")] in DIGITS for m in BETWEEN[0].finditer(text) if m.start()) \
            and not ("\\n" in text and BETWEEN[1].search(text)):
        return
    for m in BASE64_LINES.finditer(text):
        breaks = [(m.start() + b.start(), m.start() + b.end()) for b in LINE_BREAK.finditer(m[0])]
        yield list(zip([m.start(), *(e for _, e in breaks)], [*(b for b, _ in breaks), m.end()], strict=True))


def _digits(lines: list[tuple[int, int]]) -> int:
    return sum(end - begin for begin, end in lines)


def unwrap(layer: Layer) -> Iterator[Layer | Missed]:
    """The layers right under a layer, large ones in pieces; after those that are large or not read whole, their spans."""
    text = layer.text
    if "%" in text and (pieces := [(m.start(), m.end(), *url_decoded(m[0])) for m in URL_RUN.finditer(text)]):
        yield layer.rewritten("url", pieces)
        if any("\ufffd" in new for _, _, new, _ in pieces):  # bytes of another kind
            yield layer.rewritten("url_bytes", [(m.start(), m.end(), *url_bytes(m[0])) for m in URL_RUN.finditer(text)])
    if ("\\" in text or "&#" in text) and (pieces := [(m.start(), m.end(), unicode_decoded(m[0]), [m.end() - m.start()]) for m in UNICODE_RUN.finditer(text)]):
        yield layer.rewritten("unicode", pieces)
        if "\\x" in text or "\\u00" in text:
            yield layer.rewritten("escaped_bytes", [(m.start(), m.end(), byte_character(m), [m.end() - m.start()]) for m in BYTE_ESCAPE.finditer(text)])
    if layer.starts is not None and layer.starts.strides != (0,):  # escapes have been decoded in it
        yield from streams(layer)
    covered = []
    for lines in wrapped_lines(text):
        if _digits(lines) < LEAST_BASE64:
            continue
        whole = (lines[0][0], lines[-1][1])
        runs = whole_runs(lines, lambda run: reads_well(text[run[0]:run[1]]))
        covered += runs
        if runs != [whole]:  # some of it does not read well, however it is parted
            for block in blocks_of(lines):
                if len(block) > 1 and _digits(block) >= LEAST_BASE64:
                    yield from within(layer, block[0][0], block[-1][1], lines)
            yield from within(layer, *whole, lines)
        for begin, end in runs:
            yield from within(layer, begin, end)
    ends = [end for _, end in covered]
    for m in BASE64_RUN.finditer(text):
        tokens = [(m.start(), m.end())]
        if m[0][0] in "nr" and text[m.start() - 1:m.start()] == "\\":  # perhaps the letter of an escaped break
            tokens.append((m.start() + 1, m.end()))
        if any(c in m[0] for c in "/_-+"):  # a token may stand in a path: its parts on their own as well
            tokens += [(m.start() + p.start(), m.start() + p.end()) for p in BASE64_PART.finditer(m[0]) if p[0] != m[0]]
        over = bisect_left(ends, m.end())
        if over < len(ends) and covered[over][0] <= m.start():
            continue  # one line of a run that was read as a whole
        for begin, end in tokens:
            yield from within(layer, begin, end)


def _place(layer: Layer) -> bytes:
    """A digest of the text and the spans of its characters; those of a run are equal, and count once."""
    digest = hashlib.sha256(layer.text.encode())
    for spans in (layer.starts, layer.ends):
        digest.update((spans[:1] if spans.strides == (0,) else spans).tobytes())
    return digest.digest()


def scan_all(text: str) -> tuple[list[tuple[int, int, int, str]], int, int, list[tuple[int, int]]]:
    """As ``scan``, and the spans of runs that could not be read whole."""
    found: dict[tuple[int, int, int], str] = {}
    missed: dict[tuple[int, int], bool] = {}
    work, seen, n_layers = deque([Layer(text, "base", None, None)]), set(), 0
    while work:
        # Each layer is read where it is unwrapped, so no more than one piece of a large one waits at each depth.
        layer = work.popleft()
        stack = [iter([layer])]
        while stack:
            under = next(stack[-1], None)
            if under is None:
                stack.pop()
            elif isinstance(under, Missed):
                missed[under.start, under.end] = missed.get((under.start, under.end), False) or under.unread
            elif under.text:
                if under is not layer:
                    if (place := _place(under)) in seen:
                        continue
                    seen.add(place)
                if under is not layer and len(under.text) < SMALL:
                    work.append(under)
                    continue
                n_layers += 1
                for start, kind, end in scan_layer(under.text):
                    begin, stop = under.span(start, end)
                    found.setdefault((begin, kind, stop), under.name)
                stack.append(unwrap(under))
    return [(s, k, e, found[s, k, e]) for s, k, e in sorted(found)], n_layers, len(missed), sorted(m for m, unread in missed.items() if unread)


def scan(text: str) -> tuple[list[tuple[int, int, int, str]], int, int]:
    """(start, kind, end, layer) of all secrets in all layers, each span and kind once; layers seen; runs with layers that
    are large (scanned in pieces) or could not be read whole.

    A span that is found in the text itself is named ``base``, others by the first layer that shows them.
    """
    return scan_all(text)[:3]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1, 16 << 20):
        results = [scan(text or "") for text in batch.column(1).to_pylist()]
        findings = [[{"kind": KINDS[k], "start": s, "end": e, "layer": layer} for s, k, e, layer in found] for found, _, _ in results]
        yield record_batch(FOUND, [batch.column(0).to_pylist(), findings, [n for _, n, _ in results], [o for _, _, o in results]])


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, findings (kind, start, end, layer; code points, end exclusive), n_layers and n_oversize of every row.

    Null texts count as empty; null or repeated doc_ids keep their rows. Reads doc_id and text only.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, FOUND)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts of each kind in the texts themselves, the digest of their spans, and all spans."""
    base = F.filter("findings", lambda f: f["layer"] == "base")
    kinds = F.transform(base, lambda f: f["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return findings(docs).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                                 _joined(F.col("findings")).alias("spans"), "n_layers", "n_oversize")


def redacted(text: str) -> str:
    """The text with every secret, every encoded run that holds one, and every run that could not be read whole replaced by [SECRET].

    Overlapping spans are one.
    """
    found, _, _, unread = scan_all(text)
    out, at = [], 0
    for start, end in sorted([(s, e) for s, _, e, _ in found] + unread):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in ``text``; where that changes a text, the column ``n_chars``, if any, follows. Nulls stay."""
    names, schema = docs.columns, docs.schema
    text, size = names.index("text"), names.index(n_chars) if n_chars in names else None

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, 16 << 20):
            old = batch.column(text).to_pylist()
            new = [t and redacted(t) for t in old]
            columns = list(batch.columns)
            columns[text] = pa.array(new, batch.column(text).type)
            if size is not None:
                was = batch.column(size).to_pylist()
                columns[size] = pa.array([len(b) if a != b else n for a, b, n in zip(old, new, was, strict=True)], batch.column(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(replace, schema)
