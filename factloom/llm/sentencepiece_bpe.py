"""SentencePiece (BPE) encoding and decoding with a merge-type prefix table.

For each prefix of a segment the table stores the one token with which the prefix's encoding ends.
The candidates are the vocabulary pieces that end there, found by an Aho-Corasick automaton, and
the right one is the piece that is compatible with the last token of the prefix before it: merging
the two pieces' characters in vocabulary order must give back just these two. The ids are then read
backwards through the table, so the time is linear in the text, whatever its length.

No piece of the vocabulary holds the space mark after another character (checked when the model is
read), so no merge crosses from a word into the next space mark: a text is split there into
segments, and a table is built once for each distinct segment that a task meets.

Nulls: a null text counts as empty: no pieces, only the end id. Characters outside the vocabulary
become byte pieces. Repeated rows are encoded each for itself, an empty table gives no rows; columns
other than doc_id and text are not read. Texts of any length are encoded whole; ids may be of any type.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from factloom.llm.common import id_type, lean

MARK = "▁"
#: Segment: spaces (or marks, which are the same), then other characters; or spaces that end the text.
SEGMENT = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
#: A task keeps two generations of at most this many segments, to bound its memory; results do not depend on it.
CACHE_SEGMENTS = 100_000
CACHE_PAIRS = 200_000


class PrefixTableBPE:
    """Encoder and decoder of a sentencepiece BPE model file with byte fallback."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with identity normalisation is needed")
        self.dummy_prefix = spec.add_dummy_prefix
        kinds = {p.piece: (p.type, i) for i, p in enumerate(model.pieces)}
        self.surface = [b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.byte_id = [0] * 256
        self.unknown_id, self.eos = 0, kinds["</s>"][1]
        self.is_byte = [False] * len(model.pieces)
        self.rank: dict[str, float] = {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                b = int(p.piece[3:5], 16)
                self.byte_id[b], self.surface[i], self.is_byte[i] = i, bytes([b]), True
            elif p.type == 2:
                self.unknown_id, self.surface[i] = i, " ⁇ ".encode()
            elif p.type == 1:
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError(f"piece {p.piece!r} crosses a word")
                self.rank[p.piece] = -p.score
            elif p.type != 3:
                raise ValueError("user-defined and unused pieces are not supported")
        self.id_of = {p: kinds[p][1] for p in self.rank}
        self.byte_fallback = model.trainer_spec.byte_fallback
        self.pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.rank:
            if len(piece) > 1 and self.merged(piece) == [piece]:  # others are never the end of an encoding
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.known: dict[str, tuple[str, int, str]] = _Segments(self)

    def merged(self, text: str) -> list[str]:
        """Merges in vocabulary order, leftmost first; only for strings of one or two pieces."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether an encoding may hold these two pieces side by side."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def pieces(self, segment: str) -> list[str]:
        """Pieces of a segment, characters outside the vocabulary among them."""
        n = len(segment)
        last: list[str] = [""] * (n + 1)
        pairs = self.pairs
        for at, piece in self.automaton.iter(segment):
            at += 1
            if not last[at]:
                start = at - len(piece)
                if start:
                    left = last[start] or segment[start - 1]
                    fits = pairs.get((left, piece))
                    if fits is None:
                        fits = self.compatible(left, piece)
                    if not fits:
                        continue
                last[at] = piece
        out, i = [], n
        while i > 0:
            piece = last[i] or segment[i - 1]
            out.append(piece)
            i -= len(piece)
        out.reverse()
        return out

    def ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(segment):
            found = self.id_of.get(piece)
            if found is not None:
                out.append(found)
            elif self.byte_fallback:
                out.extend(self.byte_id[b] for b in piece.encode())
            else:
                out.append(self.unknown_id)
        return out

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        return SEGMENT.findall(" " + text if self.dummy_prefix else text)

    def encode(self, text: str, end: bool = True) -> list[int]:
        out = [int(i) for s in self.segments(text) for i in self.known[s][0].split(" ")]
        return [*out, self.eos] if end else out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: one leading space of the dummy prefix goes; broken byte pieces become U+FFFD."""
        out: list[str] = []
        pending, seen = bytearray(), not self.dummy_prefix
        for i in ids:
            if self.is_byte[i]:
                pending += self.surface[i]
                continue
            if pending:
                out.append(_bytes_text(bytes(pending)))
                pending.clear()
                seen = True
            piece = self.surface[i].decode()
            if not seen and piece:
                seen = True
                if i != self.unknown_id and piece.startswith(" "):
                    piece = piece[1:]
            out.append(piece)
        if pending:
            out.append(_bytes_text(bytes(pending)))
        return "".join(out)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the decoded text; by segment, as ids and texts only join."""
        found = [self.known[s] for s in self.segments(text)]
        ids = " ".join([*[x[0] for x in found], str(self.eos)])
        back = "".join([x[2] for x in found])
        if self.dummy_prefix and back.startswith(" "):
            back = back[1:]
        return sum([x[1] for x in found]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def _bytes_text(raw: bytes) -> str:
    """Text of byte pieces: valid characters, and U+FFFD for each byte that begins none."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


class _Segments(dict):
    """Segment -> (ids joined by a space, their number, decoded text); fills itself."""

    def __init__(self, coder: PrefixTableBPE) -> None:
        super().__init__()
        self.coder = coder
        self.older: dict[str, tuple[str, int, str]] = {}

    def __missing__(self, segment: str) -> tuple[str, int, str]:
        if len(self) >= CACHE_SEGMENTS:
            self.older = {}  # frees the older generation before the newer takes its place
            self.older.update(self)
            self.clear()
        found = self.older.get(segment)
        if found is not None:
            self[segment] = found
            return found
        ids = self.coder.ids(segment.replace(" ", MARK))
        surface = self.coder.surface
        raw = b"".join([surface[i] for i in ids])
        text = raw.decode()  # whole characters, so always valid
        found = " ".join(map(str, ids)), len(ids), segment if text == segment else text  # one string for both where they are equal
        if len(segment) <= 64:
            self[segment] = found
        return found


_coders: dict[str, PrefixTableBPE] = {}


def coder(path: str) -> PrefixTableBPE:
    if path not in _coders:
        _coders[path] = PrefixTableBPE(path)
    return _coders[path]


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = coder(model_path)
        for b in batches:
            rows = [c.digests(t.as_py() or "") for t in b.column("text")]  # one text at a time
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ids (array of int, end id last) of every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = coder(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.encode(t or "") for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {id_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of the ids; null ids count as none."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = coder(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), f"doc_id {id_type(encoded)}, text string")
