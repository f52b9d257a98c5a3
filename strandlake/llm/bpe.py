"""Byte-level BPE encoding and decoding with a public vocabulary.

A text is cut at added tokens and then by the pre-token pattern. Each pre-token is
encoded by merging its symbols in order of merge rank: a priority queue of
candidate merges over a doubly linked symbol list, where entries whose symbols
have changed since they were queued are skipped. Decoding concatenates the
vocabulary strings of the ids and reads the bytes as UTF-8.

Every whole text is encoded in one task as a stream of pre-tokens; nothing is
shuffled. Ids of short pre-tokens are kept in a bounded table per Python worker.

Letters and numbers are those of Unicode 16.0, which the library that reads this
format knows, whatever version is installed here.

Defined results: a null text is encoded as the empty text (no ids, empty decoded
text); added tokens standing in a text get their own id, as in the library; bytes
that are not valid UTF-8 decode to U+FFFD; repeated rows are encoded one by one; an
empty table gives an empty table; columns named as the output's are replaced. A
text is encoded whole: memory grows with the longest one, about a hundred bytes for
each of its pre-tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.textblocks import lean
from strandlake.storage import spread

# The byte-level pre-token pattern and the printable stand-ins of
# bytes are part of the public vocabulary format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# Letters and numbers that Unicode 16.0 added to 15.1.
ADDED_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
ADDED_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
]

MAX_KEPT = 150_000
MAX_KEPT_CHARS = 40
_ROWS = 256


def _stand_ins() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary strings."""
    others = [b for b in range(256) if b not in set(_PLAIN_BYTES)]
    return {chr(b): b for b in _PLAIN_BYTES} | {chr(256 + k): b for k, b in enumerate(others)}


def _set(points: list[int]) -> str:
    """The inside of a character set that holds ascending code points."""
    out, k = [], 0
    while k < len(points):
        e = k
        while e + 1 < len(points) and points[e + 1] == points[e] + 1:
            e += 1
        out.append(f"\\U{points[k]:08X}-\\U{points[e]:08X}")
        k = e + 1
    return "".join(out)


def _exact_classes() -> tuple[str, str, str]:
    """Sets for letters and numbers as of Unicode 16.0, and one of the code points the pattern engine takes otherwise."""
    odd, sets = [], []
    for kind, added in (("L", ADDED_LETTERS), ("N", ADDED_NUMBERS)):
        engine, more, less = regex.compile(rf"\p{{{kind}}}"), [], []
        for block in range(0, 0x110000, 256):
            if 0xD800 <= block < 0xE000:
                continue
            known = set(map(ord, engine.findall("".join(map(chr, range(block, block + 256))))))
            fixed = {c for c in range(block, block + 256) if unicodedata.category(chr(c))[0] == kind}
            fixed |= {c for a, b in added for c in range(max(a, block), min(b + 1, block + 256))}
            more += sorted(fixed - known)
            less += sorted(known - fixed)
        sets.append((f"[\\p{{{kind}}}--[{_set(less)}]]" if less else f"\\p{{{kind}}}") + _set(more))
        odd += more + less
    return sets[0], sets[1], _set(sorted(set(odd)))


class Codec:
    """Encoder and decoder of one vocabulary file in the tokenizers JSON format."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        byte_of = _stand_ins()
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *added.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.of_byte = [0] * 256
        for c, b in byte_of.items():
            self.of_byte[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in added.items()}
        longest_first = sorted(added, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
        self.pattern = regex.compile(PATTERN)
        letters, numbers, odd = _exact_classes()
        exact = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"?\p{L}", f"?[{letters}]").replace(r"?\p{N}", f"?[{numbers}]")
        self.exact = regex.compile(exact, regex.V1) if odd else self.pattern
        self.odd = re.compile(f"[{odd}]") if odd else None
        self.kept = _Kept(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        merges = self.merges
        symbol = [*map(self.of_byte.__getitem__, piece)]
        n = len(symbol)
        before, after = [*range(-1, n - 1)], [*range(1, n), -1]
        queue = [(f[0], k, *pair, f[1]) for k, pair in enumerate(zip(symbol, symbol[1:], strict=False)) if (f := merges.get(pair))]
        heapq.heapify(queue)
        while queue:
            _, k, left, right, joined = heapq.heappop(queue)
            m = after[k]
            if symbol[k] != left or m < 0 or symbol[m] != right:
                continue  # stale: one of the two has been merged since
            symbol[k], symbol[m] = joined, -1
            after[k] = after[m]
            if after[m] >= 0:
                before[after[m]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0:
                    found = merges.get((symbol[a], symbol[b]))
                    if found:
                        heapq.heappush(queue, (found[0], a, symbol[a], symbol[b], found[1]))
        return [x for x in symbol if x >= 0]

    def _is_odd(self, text: str) -> bool:
        """Whether a text has a letter or number the pattern engine takes otherwise; none of these is in Latin-1."""
        if self.odd is None or text.isascii():
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.odd.search(text) is not None
        return False

    def _plain(self, text: str) -> bytes:
        pattern = self.exact if self._is_odd(text) else self.pattern
        return b"".join(map(self.kept.__getitem__, pattern.findall(text)))

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode_bytes(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


class _Kept(dict):
    """Ids of pre-tokens met lately; a full table becomes the one before, whose entries come back when met, so memory is bounded."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = np.array(self.codec.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= MAX_KEPT_CHARS:
            if len(self) >= MAX_KEPT // 2:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_codecs: dict[str, Codec] = {}


def codec_of(file: bytes) -> Codec:
    """The codec of a vocabulary file, built once per process."""
    key = hashlib.sha256(file).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(file)
    return _codecs[key]


def vocabulary_file(path: str | None = None) -> bytes:
    """Read on the driver and broadcast: a vocabulary has a fixed size of a few MB."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, vocabulary: bytes, make, fields: str, drop: list[str]) -> DataFrame:
    """``docs`` without ``drop``, with the columns ``make(codec, batch)`` returns; columns of those names are replaced."""
    file = docs.sparkSession.sparkContext.broadcast(vocabulary)
    replaced = {x.split()[0].lower() for x in fields.split(", ")} | {x.lower() for x in drop}
    kept = [f for f in docs.schema.fields if f.name.lower() not in replaced]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file.value)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                columns = {f.name: batch.column(f.name) for f in kept}
                yield pa.RecordBatch.from_pydict(columns | make(codec, batch))

    return docs.mapInArrow(lean(run), out)


def encode(docs: DataFrame, vocabulary: bytes, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` plus ``ids_col`` (array<int>), the token ids of each whole text."""

    def make(codec: Codec, batch: pa.RecordBatch) -> dict:
        ids = [np.frombuffer(codec.encode_bytes(t or ""), "<u4").astype(np.int32) for t in batch.column(text_col).to_pylist()]
        return {ids_col: pa.array(ids, pa.list_(pa.int32()))}

    return _mapped(docs, vocabulary, make, f"{ids_col} array<int>", [])


def decode(tokens: DataFrame, vocabulary: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` plus ``text_col``, the concatenated vocabulary strings of ``ids_col``."""

    def make(codec: Codec, batch: pa.RecordBatch) -> dict:
        texts = [codec.decode_bytes(np.array(x or [], "<u4").tobytes()) for x in batch.column(ids_col).to_pylist()]
        return {text_col: pa.array(texts, pa.string())}

    return _mapped(tokens, vocabulary, make, f"{text_col} string", [])


def encode_and_check(docs: DataFrame, vocabulary: bytes, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` without its text, plus ``ids_col`` and ``round_trip``: whether the ids decode to the text (a null: to the empty text)."""

    def make(codec: Codec, batch: pa.RecordBatch) -> dict:
        ids, same = [], []
        for text in batch.column(text_col).to_pylist():
            packed = codec.encode_bytes(text or "")
            ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
            same.append(codec.decode_bytes(packed) == (text or ""))
        return {ids_col: pa.array(ids, pa.list_(pa.int32())), "round_trip": pa.array(same, pa.bool_())}

    return _mapped(docs, vocabulary, make, f"{ids_col} array<int>, round_trip boolean", [text_col])


def encode_and_digest(docs: DataFrame, vocabulary: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens and digests of the ids and of the text decoded from them."""

    def make(codec: Codec, batch: pa.RecordBatch) -> dict:
        n, ids_sha, text_sha = [], [], []
        for text in batch.column(text_col).to_pylist():
            ids = codec.encode_bytes(text or "")
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(codec.decode_bytes(ids).encode()).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha), "decoded_sha256": pa.array(text_sha)}

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, vocabulary, make, fields, [text_col])


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text")))
    return encode_and_digest(docs, vocabulary_file())
