"""Packing by power-of-two decomposition.

Each document's token ids are cut into pieces whose lengths are powers of two: as many of
``max_tokens`` as fit, then one for each set bit of the rest, the largest first. A piece is a
sequence of its own, so a sequence never crosses documents and never needs padding. Sequences
of one length form a bucket; each task fills batches of ``max_tokens`` tokens from its bucket, so
a batch holds sequences of one length alone (each task's last batch of a length may be short).

Null text counts as empty: such a document has one piece with the end id alone. Rows that
repeat a doc_id are packed one by one. Other columns of the input are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_ready, batch, lean, row_base, text_bytes

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("batch_id", pa.int64())])
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, batch_id long"

#: Texts and chunks whose pre-tokens the standard library's patterns find as the tokenizer does:
#: printable ASCII, ASCII white space and precomposed Latin letters, which normalisation leaves alone.
PLAIN = re.compile("[\t-\r\x20-\x7eÀ-įı-ž]*")
LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ž"
PRE_TOKEN = re.compile(rf"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9{LETTERS}]+")


class Recent(dict):
    """A memo of two generations: when the newer one is full, the older one goes."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


#: Texts that a tokenizer must encode as this encoder does.
PROBES = ["The quick brown fox's 12 jumps, over ÉTÉ's \"lazy\" dogs!!", "a_b don't we'll x99y\n\n  naïve--coöp; Straße 中文 <|x|> e\u0301", "ALL CAPS, mixedCase & snake_case...?!"]


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(others)) for b in range(256)]


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space, so a text's ids are those of its pre-tokens, one after the
    other, and a memo of pre-tokens saves most of the work. Of a text that isn't ``PLAIN``, or
    holds a special token's string, the chunks between ASCII white space are told apart, and those
    that are the reason go through the whole tokenizer.
    """

    def __init__(self, path: str, memo: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.four = struct.Struct("<I").pack
        self.words = Recent(self._word, memo)
        for probe in PROBES:
            plain = b"".join(map(self.four, self.tokenizer.encode(probe, add_special_tokens=False).ids))
            if self.encode(probe.encode()) != plain:
                raise ValueError(f"{path}: this tokenizer doesn't lower case, split and encode as the memo of pre-tokens does")

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
        found = self.model.tokenize(shown)
        return self.four(found[0].id) if len(found) == 1 else b"".join([self.four(t.id) for t in found])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, PRE_TOKEN.findall(text.lower())))

    def _chunk(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return b"".join(map(self.four, self.tokenizer.encode(text, add_special_tokens=False).ids))
        return self._plain(text)

    def encode(self, text: bytes) -> bytes:
        whole = text.decode()
        if "<|" not in whole and PLAIN.fullmatch(whole):
            return self._plain(whole)
        if "<|" not in whole:  # else lower case could turn a text's own words into a special token's string
            text = text.lower()
        return b"".join([self._chunk(chunk.decode()) for chunk in text.split()])


def cuts(tokens: int, max_tokens: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces; ``max_tokens`` is a power of two."""
    start = 0
    while tokens - start >= max_tokens:
        yield start, max_tokens
        start += max_tokens
    size = max_tokens >> 1
    while size:
        if (tokens - start) & size:
            yield start, size
            start += size
        size >>= 1


ENCODERS: dict[str, Encoder] = {}


def pack(documents: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, bucket (the length's base-2 logarithm) and batch_id (sequences of one bucket)."""
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    end = end_id.to_bytes(4, "little")

    def pieces(batches):
        encoder = ENCODERS.get(tokenizer_path) or ENCODERS.setdefault(tokenizer_path, Encoder(tokenizer_path))
        sequence = fresh = row_base()
        open_batches: dict[int, tuple[int, int]] = {}  # of each length: the batch and the sequences that it still takes
        for b in batches:
            out = {n: [] for n in SCHEMA.names}
            held = 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.encode(text.as_py()) + end
                n = len(ids) // 4
                for start, length in cuts(n, max_tokens):
                    batch_id, room = open_batches.get(length, (0, 0))
                    if not room:
                        batch_id, room, fresh = fresh, max_tokens // length, fresh + 1
                    open_batches[length] = batch_id, room - 1
                    for name, value in zip(SCHEMA.names, (doc_id, start, length, ids[4 * start : 4 * (start + length)], n, sequence, 0, batch_id)):
                        out[name].append(value)
                    sequence += 1
                held += len(ids)
                if held > 8 << 20:
                    yield batch(SCHEMA, **out)
                    out, held = {n: [] for n in SCHEMA.names}, 0
            yield batch(SCHEMA, **out)

    arrow_ready(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(lean(pieces), DDL).withColumn("bucket", F.log2("length").cast("int"))
