"""SentencePiece encoding and decoding with byte spans.

Text is normalised by longest-prefix matching in the model's compiled character map (a double-array trie and a pool of
replacements), and the source byte of every normalised byte is recorded. Since each piece
that merging gives is a run of normalised text, it projects to a span of the original bytes.

The merging itself is the library's, on text that is normalised already; what it gives is cut into spans here.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import SLICE_CHARS, slices, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces in the file format


class CharMap:
    """A compiled character map: UTF-8 prefixes to replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that data[at:] begins with."""
        if not self.units:
            return None
        jump = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
        found, node = None, jump(self.units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= jump(unit)
            if unit & 0x100:
                begin = self.units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.pool[begin : self.pool.index(0, begin)])
        return found


class Codec:
    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != 2 or spec.trainer_spec.treat_whitespace_as_suffix or any(p.type in (USER, UNUSED) for p in spec.pieces):
            raise ValueError("only BPE models without user-defined or unused pieces, with the space mark in front")
        n = spec.normalizer_spec
        self.map = CharMap(n.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
        self.kind = [p.type for p in spec.pieces]
        self.piece = [p.piece for p in spec.pieces]
        self.fallback = spec.trainer_spec.byte_fallback
        self.unknown = self.kind.index(UNKNOWN)
        self.unknown_text = spec.trainer_spec.unk_surface
        named = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == CONTROL}
        self.begin, self.end = named["<s>"], named["</s>"]
        self.controls = np.array([i for i, k in enumerate(self.kind) if k == CONTROL], np.uint32)
        self.width = np.array([1 if k == BYTE else len(w.encode()) for w, k in zip(self.piece, self.kind)], np.uint32)
        bare = sentencepiece_model_pb2.ModelProto()  # the same model for text that is normalised already
        bare.CopyFrom(spec)
        bare.normalizer_spec.name, bare.normalizer_spec.precompiled_charsmap = "identity", b""
        bare.normalizer_spec.add_dummy_prefix = bare.normalizer_spec.remove_extra_whitespaces = bare.normalizer_spec.escape_whitespaces = False
        self.merger = SentencePieceProcessor(model_proto=bare.SerializeToString())

    # Normalisation

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """Normalised text, and the source byte of each of its bytes and of its end."""
        data = text.encode()
        out, source = bytearray(), []
        at, size = 0, len(data)

        def step(at: int) -> tuple[int, bytes]:
            return self.map.longest(data, at) or (w := utf8_width(data[at]), data[at : at + w])

        if self.squeeze:
            while at < size:
                width, said = step(at)
                if said != b" ":
                    break
                at += width
        if at == size:
            return "", [at]
        mark = MARK.encode() if self.escape else b" "
        if self.dummy:
            out += mark
            source += [at] * len(mark)
        spaced = self.squeeze
        while at < size:
            width, said = step(at)
            if spaced and said.startswith(b" "):
                said = said.lstrip(b" ")
            if said:
                new = said.replace(b" ", mark)
                out += new
                source += [at] * len(new)
                spaced = self.squeeze and said.endswith(b" ")
            at += width
        end = size
        if self.squeeze:
            while out.endswith(mark):
                end = source[-len(mark)]
                del out[-len(mark) :], source[-len(mark) :]
        return out.decode(), [*source, end]

    # Merging

    def widths(self, unit: str, ids: np.ndarray) -> np.ndarray:
        out = self.width[ids]
        if not self.fallback and (ids == self.unknown).any():  # an unknown run has what lies between known pieces
            out = self._unknown_widths(unit, ids)
        return out

    def _unknown_widths(self, unit: str, ids: np.ndarray) -> np.ndarray:
        data, at, out = unit.encode(), 0, []
        for k, i in enumerate(ids.tolist()):
            if i != self.unknown:
                size = int(self.width[i])
            elif k + 1 == len(ids):
                size = len(data) - at
            else:
                size = data.index(self.piece[ids[k + 1]].encode(), at + 1) - at
            out.append(size)
            at += size
        return np.array(out, np.uint32)

    def encode(self, text: str, ends: bool = True) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Ids as little-endian unsigned 32-bit integers, with first and end byte of each in the original text."""
        data = np.frombuffer(text.encode(), np.uint8)
        if not text:
            norm, at = "", np.zeros(1, np.int32)
        elif self.map.units or self.squeeze or not self.escape or MARK in text:
            norm, source = self.normalise(text)
            at = np.array(source, np.int32)
        else:  # as the record of sources has it: a space became three bytes, and all else stayed
            norm = (MARK if self.dummy else "") + text.replace(" ", MARK)
            at = np.repeat(np.arange(len(data) + 1, dtype=np.int32), np.append(np.where(data == 0x20, 3, 1), 1))
            if self.dummy:
                at = np.concatenate([np.zeros(3, np.int32), at])
        ids = np.array(self.merger.encode(norm), np.uint32)
        stop = np.cumsum(self.widths(norm, ids), dtype=np.int64)
        start = at[np.concatenate([np.zeros(1, np.int64), stop])[:-1]]
        stop = at[stop]
        if ends:
            ids = np.concatenate([[np.uint32(self.begin)], ids, [np.uint32(self.end)]])
            start = np.concatenate([[np.int32(0)], start, [np.int32(len(data))]])
            stop = np.concatenate([[np.int32(0)], stop, [np.int32(len(data))]])
        return ids.tobytes(), start, stop

    # Decoding

    def decode(self, ids: bytes) -> str:
        """Text of ids, with the mark that stands for the start removed; bytes that are no UTF-8 become U+FFFD each."""
        if not hasattr(self, "raw"):
            self.raw, self.special = [], set()
            for i, (p, kind) in enumerate(zip(self.piece, self.kind)):
                self.raw.append(bytes([int(p[3:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else self.unknown_text.encode() if kind == UNKNOWN else p.replace(MARK, " ").encode())
            self.raw_of = self.raw.__getitem__
        order = np.frombuffer(ids, np.uint32)
        inside = np.isin(order[1:-1], self.controls).any()
        order = order.tolist()
        if inside:  # a control id also ends a character's bytes
            return self._decode_broken(order)
        joined = b"".join(map(self.raw_of, order))
        if self.dummy or self.squeeze:
            first = next((i for i in order if self.kind[i] != CONTROL), None)
            if first is not None and self.kind[first] == NORMAL and self.piece[first].startswith(MARK):
                joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return self._decode_broken(order)

    def _decode_broken(self, order: list[int]) -> str:
        out, held, fresh = [], bytearray(), True

        def flush() -> None:
            at = 0
            while at < len(held):
                width = utf8_width(held[at])
                try:
                    out.append(bytes(held[at : at + width]).decode())
                    at += width
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            held.clear()

        for i in order:
            if self.kind[i] == BYTE:
                held.append(self.raw[i][0])
                fresh = False
                continue
            flush()
            if self.kind[i] == CONTROL:
                continue
            said = self.raw[i].decode()
            if fresh and (self.dummy or self.squeeze) and self.kind[i] == NORMAL and self.piece[i].startswith(MARK):
                said = said[1:]
            out.append(said)
            fresh = False
        flush()
        return "".join(out)


def spans_digest(starts: np.ndarray, stops: np.ndarray) -> str:
    """SHA-256 of all (first, end) byte pairs in order, as little-endian unsigned 32-bit integers."""
    return hashlib.sha256(np.stack([starts, stops], axis=1).astype("<u4").tobytes()).hexdigest()


def utf8_width(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


@cache
def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(1, np.int32), np.cumsum(np.array(sizes, np.int64))]).astype(np.int32))


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Rows with ids_le (ids as little-endian unsigned 32-bit integers, begin and end ids included), starts and ends
    (array<int>, original bytes of each id, end exclusive), spans_sha256 of both and decoded. keep: with all columns of df, whose own columns of
    these names are replaced; else with the id only.

    Null or empty text: begin and end id, decoded to empty text. Repeated rows, null ids: each row for itself. An empty table
    gives an empty one. A single pass without a shuffle; memory holds a slice of about a million characters or one text.
    """
    new = ["ids_le", "starts", "ends", "spans_sha256", "decoded"]
    held = [c for c in df.columns if c not in new] if keep else [id_col]
    rows = df.select(*[F.col(f"`{c}`") for c in held], F.col(text_col).cast("string").alias("__codec_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)

        def out(batch: pa.RecordBatch, a: int, b: int, done: list) -> pa.RecordBatch:
            sizes = _offsets([len(x[1]) for x in done])
            spans = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([x[k] for x in done]))) for k in (1, 2)]
            ids = pa.array([x[0] for x in done], pa.binary())
            said = pa.array([x[3] for x in done], pa.string())
            whole = batch.slice(a, b - a)
            digest = pa.array([spans_digest(x[1], x[2]) for x in done], pa.string())
            return pa.RecordBatch.from_arrays([*whole.columns[:-1], ids, *spans, digest, said], names=[*held, *new])

        for batch in batches:
            texts = [x or "" for x in batch.column(len(held)).to_pylist()]
            for a, b in slices(texts, SLICE_CHARS):
                yield out(batch, a, b, [(*x, c.decode(x[0])) for x in map(c.encode, texts[a:b])])

    return rows.mapInArrow(work, f"{fields}, ids_le binary, starts array<int>, ends array<int>, spans_sha256 string, decoded string")


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) of what encode_decode gives."""
    return coded.select(
        id_col,
        F.size("starts").cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "spans_sha256",
    )


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
