"""Sentence-piece ids of whole texts with the original bytes that each piece stands for, and texts back from ids.

A text is normalised first: at each place the longest prefix that the model's compiled character map knows is replaced by its
image, all else stays; spaces become U+2581, and a dummy one goes in front. Beside every byte of the normalised text stands the
byte of the original that it came from. The merges run on the normalised text, so the number of bytes of each piece tells where
it begins there, and the alignment tells where that is in the original: a piece's span is [alignment at its begin, alignment at
its end). Byte pieces of one character share its span: the last one has all of it, those before are empty, at its start. The
added begin has the span (0, 0), the added end is empty too, behind the last byte.

No piece of a usual model goes on after a letter with U+2581, so no merge crosses the place before a run of it, and the ids of a
text are those of its segments (such a run and what follows) in a row. Segments are cached; unknown ones go to the sentencepiece
library in one call, under the same model without normaliser. If some piece does cross, the whole text is one segment.

Null texts count as empty; an empty text has the begin and end ids only. Repeated rows give repeated rows, whatever their ids; a
null id stays null; other columns aren't read. An empty table gives an empty result. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Segments kept by a Python worker, and the letters of the longest that is kept.
CACHE_SEGMENTS, CACHE_LETTERS = 600_000, 60
#: Bytes of text whose pieces are held at once; a longer text is held alone.
CHUNK_BYTES = 4 << 20
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """The compiled character map: the size of a double-array trie, its units, and the images, each with a zero behind it."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.images = blob[4 + size :]
        firsts = [b for b in range(256) if self._step(self._root(), b) is not None] if blob else []
        #: Bytes at which some rule begins, as a pattern; None without rules.
        self.starts = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in firsts) + b"]") if firsts else None

    def _root(self) -> int:
        return self._offset(self.units[0])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        """The place of the unit reached from node by byte."""
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and image of the longest prefix of raw[at:] that has a rule."""
        if self.starts is None:
            return None
        node, found = self._root(), None
        for k in range(at, len(raw)):
            here = self._step(node, raw[k])
            if here is None:
                break
            unit = self.units[here]
            node = here ^ self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.images[found[1] : self.images.index(b"\0", found[1])]


class Pieces:
    """A model's normaliser, merges and decoder."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        model = sentencepiece_model_pb2.ModelProto.FromString(raw)
        spec, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        if model.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("a model that marks white space otherwise than by U+2581 before words isn't supported")
        if not model.trainer_spec.byte_fallback or {USER, UNUSED} & set(kinds) or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("a model without byte fall-back, with pieces of users or unused ones, or with a denormaliser isn't supported")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.full = SentencePieceProcessor(model_proto=raw)
        self.begin, self.end = self.full.bos_id(), self.full.eos_id()
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.bare = SentencePieceProcessor(model_proto=model.SerializeToString())
        names = [p.piece for p in model.pieces]
        #: What each id stands for in the normalised text.
        self.bytes = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else n.encode() for n, k in zip(names, kinds)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.unknown = self.full.unk_id()
        crosses = any(SPACE in n.lstrip(SPACE) for n, k in zip(names, kinds) if k == NORMAL)
        self.segments = (lambda text: [text] if text else []) if crosses else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.cache: dict[str, bytes] = {}

    def _mapped(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text under the character map: its bytes, the place of the character that each came from, and whether a space may go."""
        code = np.frombuffer(raw, np.uint8)
        here = np.maximum.accumulate(np.where((code & 0xC0) != 0x80, np.arange(len(code)), 0))
        go = np.ones(len(code), bool)
        if self.map.starts is None:
            return code, here, go
        parts, done = [], 0
        for m in self.map.starts.finditer(raw):
            at = m.start()
            if at < done or (rule := self.map.longest(raw, at)) is None:
                continue
            image = np.frombuffer(rule[1], np.uint8)
            lead = len(rule[1]) - len(rule[1].lstrip(b" "))
            parts += [(code[done:at], here[done:at], go[done:at]), (image, np.full(len(image), at), np.arange(len(image)) < lead)]
            done = at + rule[0]
        parts.append((code[done:], here[done:], go[done:]))
        code, here, go = (np.concatenate(x) for x in zip(*parts))
        return code, here, go

    def _margin(self, raw: bytes) -> int:
        """Where the characters that become a space end, at the head of a text; no piece stands for them."""
        at = 0
        while at < len(raw):
            size, image = self.map.longest(raw, at) or (1, raw[at : at + 1])
            if image != b" ":
                break
            at += size
        return at

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of the original there."""
        raw = text.encode("utf-8", "replace")
        if not raw:
            return b"", np.zeros(1, np.int64)
        code, here, go = self._mapped(raw)
        last = len(raw)
        if self.squeeze:
            space = code == 0x20
            before = np.concatenate(([True], space[:-1]))
            keep = ~(space & go & before)
            code, here = code[keep], here[keep]
        blank = code == 0x20
        out = code.tobytes().replace(b" ", SPACE_BYTES)
        here = np.repeat(here, np.where(blank, len(SPACE_BYTES), 1))
        if self.dummy:
            first = self._margin(raw) if self.squeeze else 0
            out, here = SPACE_BYTES + out, np.concatenate((np.full(len(SPACE_BYTES), first), here))
        while self.squeeze and out.endswith(SPACE_BYTES):
            cut = len(out) - len(SPACE_BYTES)
            out, here, last = out[:cut], here[:cut], int(here[cut])
        return out, np.append(here, last)

    def _ids(self, segments: list[str]) -> bytes:
        """Ids of all segments in a row."""
        cache = self.cache
        missing = {s for s in segments if s not in cache}
        if len(cache) + len(missing) > CACHE_SEGMENTS:
            cache.clear()
            missing = set(segments)
        long = {}
        if missing:
            some = list(missing)
            for s, ids in zip(some, self.bare.encode(some, num_threads=1)):
                (cache if len(s) <= CACHE_LETTERS else long)[s] = np.array(ids, "<u4").tobytes()
        return b"".join([long[s] if s in long else cache[s] for s in segments] if long else map(cache.__getitem__, segments))

    def encode(self, text: str, begin: bool = True, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first byte and the byte behind the last of the original for each."""
        out, here = self.normalise(text)
        ids = np.frombuffer(self._ids(self.segments(out.decode("utf-8", "replace"))), "<u4")
        bounds = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        if bounds[-1] != len(out):
            raise ValueError("pieces don't add up to the normalised text")
        places = here[bounds]
        starts, ends = places[:-1], places[1:]
        n = here[-1]
        if begin:
            ids, starts, ends = np.append(np.uint32(self.begin), ids), np.append(0, starts), np.append(0, ends)
        if end:
            ids, starts, ends = np.append(ids, np.uint32(self.end)), np.append(starts, n), np.append(ends, n)
        return ids.astype("<u4"), starts, ends

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of ids: what the pieces stand for in a row, U+2581 as spaces, without the dummy one."""
        if self.squeeze or (ids == self.unknown).any():
            return self.full.decode(ids.tolist())
        out = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        try:
            text = out.decode()
        except UnicodeDecodeError:  # byte pieces that make no character
            return self.full.decode(ids.tolist())
        if self.dummy and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _rows(docs: DataFrame, columns: str, made: list[tuple[str, pa.DataType]], path: str | None, row) -> DataFrame:
    """doc_id and what row(pieces, value) makes of the other column, some megabytes at a time."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            ids, values = batch.columns
            at = 0
            while at < len(values):
                out, first, size = [], at, 0
                while at < len(values) and size < CHUNK_BYTES:
                    value = values[at].as_py()
                    out.append(row(pieces, value))
                    size += len(value)
                    at += 1
                yield pa.RecordBatch.from_arrays([ids.slice(first, at - first), *(pa.array(c, t) for c, (_, t) in zip(zip(*out), made))], ["doc_id", *(n for n, _ in made)])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(columns).fields])
    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends: the ids of the text with begin and end, and the original bytes [start, end) of each."""
    made = [(n, pa.list_(pa.int32())) for n in ("ids", "starts", "ends")]
    return _rows(_texts(docs), "ids array<int>, starts array<int>, ends array<int>", made, path, lambda p, text: tuple(x.astype(np.int32) for x in p.encode(text)))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of ids; null ids count as none."""
    ids = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return _rows(ids, "text string", [("text", pa.string())], path, lambda p, ids: (p.decode(np.array(ids, np.int64)),))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and spans_sha256: of all starts, then all ends, as little-endian unsigned 64-bit numbers."""

    def row(p: Pieces, text: str) -> tuple[int, str, str, str]:
        ids, starts, ends = p.encode(text)
        spans = hashlib.sha256(starts.astype("<u8").tobytes() + ends.astype("<u8").tobytes())
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(p.decode(ids).encode()).hexdigest(), spans.hexdigest()

    made = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string())]
    return _rows(_texts(docs), "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", made, path, row)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
