"""SentencePiece BPE encoding and decoding through a table of last tokens.

For every prefix of a text exactly one vocabulary piece can end its encoding. The table stores it: an
Aho-Corasick automaton lists the pieces that end at a position, and the one is taken that agrees with
the last piece of the prefix before it (`agrees`: merging both pieces' characters gives just these two).
The ids follow backwards from the end. Time is linear in the text, also without any space.

Defined results: null text is the empty text (begin and end id only); null or repeated ids pass through.
"""

from __future__ import annotations

import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import map_slices, one_per_worker

SPACE = "▁"
#: Entries that a worker keeps at most of the pair tests and, twice, of the encoded chunks up to a length.
PAIRS_KEPT, CHUNKS_KEPT, CHUNK_CHARS = 500_000, 250_000, 32
#: Bytes of a model file that is sent to the executors.
MODEL_BYTES = 64 << 20


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} exceeds {MODEL_BYTES} bytes")
    return data


class PieceCodec:
    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte_id = [0] * 256
        self.raw: list[bytes] = []
        lib = self.library
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i):
                self.raw.append(b"")
            elif lib.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.rank[piece] = -lib.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, (piece, len(piece), {}))
        self.automaton.make_automaton()
        # No piece goes on after a space that follows another character, so a text may be cut there.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.cuts else re.compile("(?s).+")
        self.tested = 0
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The merges one by one: best score first, then leftmost. Only for texts of one or two pieces."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = rank.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score < best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def agrees(self, left: str, right: str, table: dict[str, bool]) -> bool:
        """Whether `right` is encoded as itself behind `left` (at the start: behind nothing)."""
        if self.tested >= PAIRS_KEPT:
            self.tested = 0
            for _, _, other in self.automaton.values():
                other.clear()
        known = not left or left + right not in self.rank
        known = known and self.merged(left + right) == ([left, right] if left else [right])
        self.tested += 1
        table[left] = known
        return known

    def last_pieces(self, text: str) -> list[str]:
        """For each prefix length from 1 the last piece of its encoding; a character of no piece stands for its bytes."""
        last, settled = ["", *text], -1
        for at, (piece, size, table) in self.automaton.iter(text):
            if at != settled:
                before = last[at + 1 - size]
                known = table.get(before)
                if known or known is None and self.agrees(before, piece, table):
                    last[at + 1] = piece
                    settled = at
        return last

    def encode_chunk(self, text: str) -> list[int]:
        last, at, out = self.last_pieces(text), len(text), []
        while at:
            piece = last[at]
            found = self.ids.get(piece)
            if found is None:
                out.extend(self.byte_id[b] for b in reversed(piece.encode()))
            else:
                out.append(found)
            at -= len(piece)
        return out[::-1]

    def encode_packed(self, text: str) -> bytes:
        """All ids with begin and end as little-endian unsigned 32-bit integers."""
        edges = [np.array([i], "<u4").tobytes() for i in (self.begin, self.end)]
        if not text:
            return b"".join(edges)
        chunks = self.chunk.findall(SPACE + text.replace(" ", SPACE))
        parts = list(map(self.chunks.get, chunks))
        if None in parts:
            parts = [self.packed_chunk(c) if p is None else p for c, p in zip(chunks, parts, strict=True)]
        return b"".join([edges[0], *parts, edges[1]])

    def packed_chunk(self, chunk: str) -> bytes:
        packed = self.chunks.get(chunk) or self.older.get(chunk)
        if packed is None:
            packed = struct.pack(f"<{len(ids := self.encode_chunk(chunk))}I", *ids)
        if len(chunk) <= CHUNK_CHARS:
            if len(self.chunks) >= CHUNKS_KEPT:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = packed
        return packed

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces side by side, without the space that encoding puts in front."""
        try:
            text = b"".join(map(self.raw.__getitem__, ids)).decode()
        except UnicodeDecodeError:  # byte ids that are no text: the library's own replacement rule
            return self.library.decode(ids)
        first = next((i for i in ids if self.raw[i]), None)
        if first is not None and text[0] == " " and self.library.id_to_piece(first)[0] == SPACE:
            return text[1:]
        return text


def codec_of(model: bytes) -> PieceCodec:
    """One codec in a worker process, so that its stores serve all the tasks it runs."""
    return one_per_worker(PieceCodec, model)


def encode_texts(
    df: DataFrame, model: bytes, id_column: str = "doc_id", text_column: str = "text", decoded: bool = True, packed: bool = True
) -> DataFrame:
    """Per row: its id, `n_tokens`, its ids (`packed`: little-endian binary, else array<int>) and the decoded text.

    A map over the scan: no shuffle. The model goes along as bytes, so executors need no file.
    """
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens bigint, " + ("packed binary" if packed else "ids array<int>")
    schema += ", decoded string" * decoded

    def make():
        codec = codec_of(model)

        def apply(batch):
            rows = [codec.encode_packed(t or "") for t in batch.column(1).to_pylist()]
            sizes = [len(r) // 4 for r in rows]
            if packed:
                out = [batch.column(0), sizes, pa.array(rows, pa.binary())]
            else:
                flat = np.frombuffer(b"".join(rows), "<i4")
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                out = [batch.column(0), sizes, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
            if decoded:
                out.append([codec.decode(np.frombuffer(r, "<u4").tolist()) for r in rows])
            return out

        return apply

    return map_slices(df.select(F.col(id_column), F.col(text_column).cast("string")), make, schema)


def encoded_digests(df: DataFrame, model: bytes) -> DataFrame:
    """Per document: number of ids and digests of the ids and of the decoded text."""
    return encode_texts(df, model).select(
        "doc_id",
        "n_tokens",
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
