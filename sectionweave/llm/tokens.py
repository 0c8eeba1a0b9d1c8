"""Byte-level BPE ids of whole texts with the tokenizers library, cached by pre-token chunk.

A byte-level BPE pre-tokenizer never joins a character to white space that follows it, so a text may be cut
wherever white space begins: the ids of the text are the ids of its chunks, one after the other. Texts repeat
their words, so a chunk is encoded once and looked up afterwards. Texts with the separators U+001C to U+001F,
on which Python and the tokenizer disagree about white space, are encoded whole.
"""

import re
from array import array
from collections.abc import Callable, Iterator

CHUNK = re.compile(r"\s*\S+|\s+")
CUT = re.compile(r"(?<=\S)\s")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: White space other than the single spaces and line breaks that most texts have.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Characters of a text that are split into chunks at a time.
SLICE = 1 << 20
#: Chunks of a generation; a worker remembers two generations of three kinds, about 200 bytes each chunk.
GENERATION = 400_000
#: The cut is proved for this pre-tokenizer only.
BYTE_LEVEL = "ByteLevel(add_prefix_space=False"
#: Marks that may follow a word; with it they are two pre-tokens.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below this are letters to every version of Unicode.
LATIN_END = "\u0250"

_encoders: dict[str, "ChunkEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "ChunkEncoder":
    """The encoder of this worker: loaded once for a file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class Known(dict[str, bytes]):
    """Ids of chunks, encoded when first asked for; those unused for a generation are forgotten."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        self[chunk] = ids
        return ids


def byte_alphabet() -> dict[int, int]:
    """The letters of byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(others)}


class ChunkEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuttable = self.tokenizer.normalizer is None and str(self.tokenizer.pre_tokenizer).startswith(BYTE_LEVEL)
        self.pieces, self.alphabet = self.tokenizer.model.tokenize, byte_alphabet()
        self.chunks, self.spaced, self.words = Known(self.whole), Known(self.after_space), Known(self.word)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a space and a word of Latin letters, which is one pre-token: the model alone is asked."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [piece.id for piece in self.pieces("\u0120" + letters)]).tobytes()

    def after_space(self, chunk: str) -> bytes:
        """Ids of a chunk that stands behind a space, or of one that begins with a line break."""
        if chunk[0] == "\n":
            return self.whole(chunk)
        word = chunk.rstrip(MARKS)
        if word.isalpha() and (word.isascii() or max(word) < LATIN_END):
            return self.words[word] + self.chunks[chunk[len(word):]] if len(word) < len(chunk) else self.words[word]
        return self.whole(f" {chunk}")

    def cuts(self, text: str) -> Iterator[str]:
        """The text in pieces of about SLICE characters that begin at white space."""
        begin = 0
        while begin < len(text):
            cut = CUT.search(text, begin + SLICE)
            end = cut.start() if cut else len(text)
            yield text[begin:end]
            begin = end

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers (the byte order of all machines that Spark runs its workers on)."""
        if not self.cuttable or ODD_SPACE.search(text) or any(token in text for token in self.added):
            return self.whole(text)
        return b"".join(map(self.joined, self.cuts(text)))

    def joined(self, text: str) -> bytes:
        """Ids of a text by its chunks."""
        if not OTHER_SPACE.search(text):
            # Cheaper to split, and most texts are like that. An empty chunk, or a line break alone, shows a run of white space.
            first, *rest = text.replace("\n", " \n").split(" ")
            if first and "" not in rest and "\n" not in rest:
                return self.chunks[first] + b"".join(map(self.spaced.__getitem__, rest))
        return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))
