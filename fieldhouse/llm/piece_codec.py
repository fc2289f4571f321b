"""Subword piece encoding and decoding with byte offsets, from a compiled piece model file.

1. Normalisation: at each place the longest key of the model's compiled character map that starts there is replaced by
   its value; each normalised byte keeps the source range it came from. Then white space is escaped and the dummy prefix
   put in front, as the model's settings say.
2. The normalised text is cut before each run of the space mark. No piece holds the mark after another character (this is
   checked when the model is loaded), so no merge crosses a cut, and equal parts have equal pieces: parts are encoded
   once and looked up afterwards. Merging is by best score, leftmost first, on a heap; parts that are no piece fall back
   to bytes.
3. Each piece is projected through the alignment to a byte range of the source.

Only the model file's bytes come from outside (`model_file`, read on each executor); the merge table, character map and
decoder here are built from it. Null texts are empty: an end id only. Any length works; memory grows with one text.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhouse.llm.util import byte_values, chunks, ids_and_texts

SPACE = "▁"
MARK = SPACE.encode()
NONE = float("-inf")
#: Symbols up to which the list form of merging is used.
SHORT = 48
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts remembered per worker; forgetting costs time only.
MOST_PARTS = 200_000


def _fields(data: bytes):
    """The (number, value) fields of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            value, at = data[at : at + 4], at + 4
        yield key >> 3, value


class CharacterMap:
    """The compiled character map: a double array over key bytes, and the zero-ended values it points to."""

    def __init__(self, blob: bytes):
        self.rules: dict[bytes, bytes] = {}
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            units, values = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
            todo = [(0, b"")]
            while todo:
                node, key = todo.pop()
                unit = units[node]
                base = node ^ ((unit >> 10) << ((unit & 0x200) >> 6))
                if unit & 0x100 and key:  # a leaf: its value stands at the base
                    start = units[base] & 0x7FFFFFFF
                    self.rules[key] = values[start : values.index(b"\0", start)]
                todo += [(base ^ c, key + bytes([c])) for c in range(1, 256) if (base ^ c) < len(units) and units[base ^ c] & 0x800000FF == c]
        # regex alternation tries its branches in order, so longest first makes the longest prefix win
        self.find = re.compile(b"|".join(re.escape(k) for k in sorted(self.rules, key=len, reverse=True))) if self.rules else None

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """The normalised bytes, and for each of them and the end the source offset it starts from; None: the same bytes."""
        if self.find is None:
            return text, None
        out, source, done = [], [], 0
        for m in self.find.finditer(text):
            new = self.rules[m[0]]
            out += [text[done : m.start()], new]
            source += [np.arange(done, m.start()), np.full(len(new), m.start())]
            done = m.end()
        if not out:
            return text, None
        return b"".join([*out, text[done:]]), np.concatenate([*source, np.arange(done, len(text) + 1)]).astype(np.int64)


class PieceCodec:
    """Encoder and decoder of one model."""

    def __init__(self, model_file: str):
        with open(model_file, "rb") as f:
            message = list(_fields(f.read()))
        self.pieces, self.kinds, scores = [], [], []
        trainer, normaliser = {}, {}
        for number, value in message:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1])
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only merge-rank (BPE) piece models are supported")
        self.map = CharacterMap(normaliser.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.end_id = trainer.get(42, 2)
        self.unknown_id = trainer.get(40, 0)
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces are not supported: these do not merge by score")
        usable = {p.decode(): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in usable):
            raise ValueError("a piece crosses a space mark")
        self.text_ids, self.score = usable, {p: scores[i] for p, i in usable.items()}
        self.decimal = [str(i) for i in range(len(self.pieces))]
        #: first symbol -> second symbol -> score of what they make
        self.pairs: dict[str, dict[str, float]] = {}
        for p, score in self.score.items():
            for k in range(1, len(p)):
                self.pairs.setdefault(p[:k], {})[p[k:]] = score
        #: id -> what it adds to the decoded bytes
        self.surface = [
            bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, b" ")
            for p, k in zip(self.pieces, self.kinds)
        ]
        self.widths = np.array([1 if k == BYTE else len(p) for p, k in zip(self.pieces, self.kinds)], np.int64)
        #: what is remembered of parts: of escaped ones with widths in escaped bytes, of plain ones in bytes
        self.escaped = _Parts(self, self.widths.tolist(), lambda part: part)
        self.plain = _Parts(self, [1 if k == BYTE else len(p.replace(MARK, b" ")) for p, k in zip(self.pieces, self.kinds)], lambda part: part.replace(b" ", MARK))

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """The text as the encoder sees it, space marks included, and its alignment to the source (None: spaces only)."""
        new, source = self.map(text)
        if self.squeeze:
            source = np.arange(len(new) + 1) if source is None else source
            keep = np.ones(len(new), bool)
            for m in re.finditer(rb"^ +| +$|(?<= ) +", new):
                keep[m.start() : m.end()] = False
            new, source = bytes(np.frombuffer(new, np.uint8)[keep]), np.append(source[:-1][keep], source[-1])
        if self.prefix and new:
            new, source = b" " + new, None if source is None else np.concatenate([source[:1], source])
        return new, source

    def cut(self, normal: bytes) -> list[bytes]:
        """Parts that no merge crosses: a run of spaces and what follows it up to the next space."""
        if self.escape:
            normal = normal.replace(b" ", MARK)
        return _PARTS.findall(normal)

    def merge(self, part: bytes) -> tuple[int, ...]:
        """Ids of one part: repeatedly join the adjacent pair whose piece scores best, the leftmost among equals."""
        text = part.decode()
        symbols = self._merged_short(text) if len(text) <= SHORT else self._merged_long(text)
        ids, out = self.text_ids, []
        for s in symbols:
            i = ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in s.encode()] if self.byte_ids else [self.unknown_id]
        return tuple(out)

    def _merged_short(self, text: str) -> list[str]:
        """The scores of all adjacent pairs are kept in a list: quickest for a few symbols."""
        symbols, pairs = list(text), self.pairs
        scores = [pairs[a].get(b, NONE) if a in pairs else NONE for a, b in zip(text, text[1:])]
        while scores:
            best = max(scores)
            if best == NONE:
                break
            i = scores.index(best)
            joined = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del scores[i]
            if i:
                before = pairs.get(symbols[i - 1])
                scores[i - 1] = before.get(joined, NONE) if before else NONE
            if i < len(scores):
                after = pairs.get(joined)
                scores[i] = after.get(symbols[i + 1], NONE) if after else NONE
        return symbols

    def _merged_long(self, text: str) -> list[str]:
        """The same on a heap over linked symbols: n log n for a part of any length."""
        symbols: list[str | None] = list(text)
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        get, heap = self.score.get, []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols):
                joined = symbols[i] + symbols[j]
                if (s := get(joined)) is not None:
                    heapq.heappush(heap, (-s, i, j, joined))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]

    def encode(self, text: bytes, end: bool = True) -> list[int]:
        out = [i for part in self.cut(self.normalised(text)[0]) for i in self.merge(part)]
        return out + [self.end_id] if end else out

    def spans(self, text: bytes, ids: list[int]) -> np.ndarray:
        """Start and end byte in the source of each id of encode(text); control ids are empty ranges at the end."""
        return self._projected(*self.normalised(text), self._widths(ids))

    def _widths(self, ids: list[int] | tuple[int, ...]) -> np.ndarray:
        """Escaped bytes that each id stands for; control ids stand for none."""
        return np.where(np.array([self.kinds[i] == CONTROL for i in ids], bool), 0, self.widths[list(ids)]) if ids else np.zeros(0, np.int64)

    def _projected(self, normal: bytes, source: np.ndarray | None, widths: np.ndarray) -> np.ndarray:
        """Start and end byte in the source of pieces of these widths, which follow one another over the escaped text."""
        marks = np.frombuffer(normal, np.uint8) == 0x20 if self.escape else np.zeros(len(normal), bool)
        wide = np.repeat(np.arange(len(normal)), np.where(marks, len(MARK), 1))  # escaped byte -> normalised byte
        wide = np.append(wide, len(normal))
        if source is None:
            source = np.maximum(np.arange(len(normal) + 1) - int(self.prefix and len(normal) > 0), 0)
        ends = np.cumsum(widths)
        return np.stack([source[wide[ends - widths]], source[wide[ends]]], axis=1)

    def decode(self, ids: list[int]) -> bytes:
        surface = self.surface
        return self._finished(b"".join([surface[i] for i in ids]))

    def _finished(self, out: bytes) -> bytes:
        if self.prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode(errors="replace").encode()

    def summary(self, text: bytes) -> tuple[int, bytes, bytes, np.ndarray]:
        """Number of ids, the ids in decimal joined by a space, the decoded bytes, and the spans; put together part by part.

        If the alignment is the identity, all marks are escaped spaces and a mark is a piece (not three bytes), spans come
        from the remembered widths alone."""
        normal, source = self.normalised(text)
        direct = self.escape and source is None and SPACE in self.text_ids and MARK not in normal
        if direct:  # cut before escaping: the same parts
            found = list(map(self.plain.__getitem__, _WORDS.findall(normal)))
        else:
            found = list(map(self.escaped.__getitem__, self.cut(normal)))
        counts, digits, surfaces, widths = zip(*found) if found else ((), (), (), ())
        n = 1 + sum(counts)
        sizes = np.zeros(n, np.int64)  # the end id has no width
        sizes[:-1] = np.frombuffer(b"".join(widths), np.int32)
        if direct:
            edges = np.zeros(n + 1, np.int64)
            np.cumsum(sizes, out=edges[1:])
            edges = np.maximum(edges - int(self.prefix and len(normal) > 0), 0)
            spans = np.stack([edges[:-1], edges[1:]], axis=1)
        else:
            spans = self._projected(normal, source, sizes)
        return n, b" ".join([*digits, str(self.end_id).encode()]), self._finished(b"".join(surfaces)), spans


class _Parts(dict):
    """part -> number of ids, ids in decimal, decoded bytes, widths of the pieces as the bytes of an int32 array; worked out
    on first use. When it holds MOST_PARTS it starts anew and keeps the last generation for lookups, so that frequent parts
    stay: forgetting costs time only."""

    def __init__(self, own: PieceCodec, widths: list[int], escaped):
        super().__init__()
        self.own, self.widths, self.escape, self.last = own, widths, escaped, {}

    def __missing__(self, part: bytes) -> tuple[int, bytes, bytes, bytes]:
        if len(self) >= MOST_PARTS:
            self.last = dict(self)
            self.clear()
        found = self.last.get(part)
        if found is None:
            ids = self.own.merge(self.escape(part))
            surface = b"".join([self.own.surface[i] for i in ids])
            found = len(ids), " ".join([self.own.decimal[i] for i in ids]).encode(), surface, array("i", [self.widths[i] for i in ids]).tobytes()
        self[part] = found
        return found


#: Parts of a text whose spaces are not escaped yet.
_WORDS = re.compile(rb" +[^ ]*|[^ ]+")
_PARTS = re.compile(b"(?:" + MARK + b")+(?:(?!" + MARK + b").)*|(?:(?!" + MARK + b").)+", re.S)

_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """The codec of a model file, loaded once per worker process."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


ENCODED = "doc_id long, ids array<int>, spans array<struct<start:int,end:int>>, decoded string"


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document: piece ids with the end id, the source byte range of each, and the decoded text."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("spans", pa.list_(span)), ("decoded", pa.string())])

    def run(batches):
        own = codec(model_file)
        for batch in batches:
            texts = byte_values(batch.column(1))
            for part in chunks(texts):
                ids = [own.encode(t) for t in texts[part]]
                spans = [[{"start": a, "end": b} for a, b in own.spans(t, i).tolist()] for t, i in zip(texts[part], ids)]
                columns = [batch.column(0)[part.start : part.stop], ids, spans, [own.decode(i).decode() for i in ids]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return ids_and_texts(docs).mapInArrow(run, ENCODED)


def contract(docs: DataFrame, model_file: str) -> DataFrame:
    """The digest columns of op7; the same normalisation, merging, projection and decoding as `encode`, without keeping
    the lists. spans_sha256: over start and end of each piece in turn, as little-endian 32-bit integers."""
    from hashlib import sha256

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string())])

    def digests(text: bytes, own: PieceCodec) -> tuple[int, str, str, str]:
        n, ids, decoded, spans = own.summary(text)
        return n, sha256(ids).hexdigest(), sha256(decoded).hexdigest(), sha256(spans.astype("<i4").tobytes()).hexdigest()

    def run(batches):
        own = codec(model_file)
        for batch in batches:
            found = [digests(text, own) for text in byte_values(batch.column(1))]
            columns = [batch.column(0), *([x[k] for x in found] for k in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
