"""Exact merge-type SentencePiece encoding by backtracking over longest matches, and decoding.

A sequence of pieces is what merging gives if and only if every two neighbours, merged afresh from their characters,
give those two pieces again. So the encoder takes the longest piece at each place (Aho-Corasick), falls back to its
next shorter prefix where the neighbours aren't compatible, steps back over a piece when none fits, and marks in a
bitfield the places from which no continuation exists, so that each is tried once.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contagraph.llm.common import col, fresh, short_batches, spread, table

SPACE = "▁"
#: A worker keeps 2 * CACHE chunks and PAIRS pairs of pieces at most, and encodes ROWS texts at once. None changes a result.
CACHE, PAIRS, LONGEST_KEPT, ROWS = 150_000, 300_000, 48, 1000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class _Cache(dict):
    """Chunk -> ids as little-endian 32-bit bytes; holds the last CACHE to 2 * CACHE chunks."""

    def __init__(self, encode) -> None:
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        if (found := self.old.get(chunk)) is None:
            found = self.encode(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


class PieceModel:
    """A merge-type model with identity normalisation and, for characters without a piece, byte pieces."""

    def __init__(self, data: bytes) -> None:
        self.pieces, self.kinds, scores = [], [], []
        trainer, norm = {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.kinds.append(piece.get(3, _NORMAL))
                scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2 or norm.get(2) or trainer.get(24, 0) or not {*self.kinds} <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only merge-type models with identity normalisation and no user-defined or unused pieces")
        self.prefix, self.squeeze, self.escape = norm.get(3, 1), norm.get(4, 1), norm.get(5, 1)
        named = lambda i, default: trainer.get(i, default.encode()).decode() or default
        self.unk, self.bos, self.eos = (self.pieces.index(named(*x)) for x in ((45, "<unk>"), (46, "<s>"), (47, "</s>")))
        self.bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        self.normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _NORMAL}
        self.score = {p: scores[i] for p, i in self.normal.items()}
        reachable = {p: i for p, i in self.normal.items() if len(p) == 1 or self.merge(p) == [p]}
        self.matches = ahocorasick.Automaton()
        for p, i in reachable.items():
            self.matches.add_word(p, (len(p), i))
        self.matches.make_automaton()
        self.shorter = {i: next((reachable[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in reachable), -1) for p, i in reachable.items()}
        self.size = [len(p) for p in self.pieces]
        self.pairs: dict[int, bool] = {}
        # no merge crosses from another character to a blank, or any character without a piece
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.normal)
        known = {c for p in self.normal for c in p}
        self.single = {c for c in known if c in self.normal}
        # neighbours within a piece; a character without a piece of its own is always a part of its own
        self.joined = {p[i : i + 2] for p in reachable for i in range(len(p) - 1) if p[i] in self.single and p[i + 1] in self.single}
        self.apart = apart and "\n" not in known and self.prefix and self.escape
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.apart else r"[\s\S]+").findall
        self.cache, self.words = _Cache(self.encode_chunk), _Cache(self.encode_word)
        shown = [("" if k == _CONTROL else " ⁇ " if k == _UNKNOWN else p.replace(SPACE, " ")) for p, k in zip(self.pieces, self.kinds)]
        for b, i in self.bytes_at.items():
            shown[i] = chr(b)
        self.shown, self.byte_of = shown, {i: b for b, i in self.bytes_at.items()}
        self.high = frozenset(i for b, i in self.bytes_at.items() if b > 127)

    def forget(self) -> None:
        """Drop what is kept to save time: a worker lives on after its task."""
        for kept in (self.cache, self.cache.old, self.words, self.words.old, self.pairs):
            kept.clear()

    def merge(self, text: str) -> list[str]:
        """Merging itself: join the neighbours whose piece scores best, the leftmost first, until none has a piece."""
        parts, get, none = list(text), self.score.get, float("-inf")
        best = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while best:
            if (top := max(best)) == none:
                return parts
            i = best.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del best[i]
            if i:
                best[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(best):
                best[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            left, right = self.pieces[a], self.pieces[b]
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[int]:
        """The pieces of a text all of whose characters have pieces."""
        n, longest = len(text), {}
        for end, (size, piece) in self.matches.iter(text):
            longest[end - size + 1] = piece  # matches come by end, so the longest comes last
        size, shorter, compatible = self.size, self.shorter, self.compatible
        out: list[int] = []
        failed = bytearray(n + 1)
        at, piece = 0, longest[0]
        while True:
            end = at + size[piece]
            if not failed[end] and (not out or compatible(out[-1], piece)):
                out.append(piece)
                at = end
                if at == n:
                    return out
                piece = longest[at]
            elif (less := shorter[piece]) >= 0:
                piece = less
            else:
                failed[at] = 1
                piece = out.pop()
                at -= size[piece]

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk, part by part: no piece holds the two characters on either side of a cut, so no merge crosses it."""
        joined = self.joined
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in joined]
        if not cuts:
            return self.encode_part(chunk)
        return b"".join([self.cache[chunk[i:j]] for i, j in zip([0, *cuts], [*cuts, len(chunk)])])

    def encode_part(self, part: str) -> bytes:
        """Ids of a part without a cut: pieces, or the bytes of one character that has none."""
        if part[0] in self.single:
            ids = self.backtrack(part)
        else:
            ids = [self.bytes_at[b] for b in part.encode()] if self.bytes_at else [self.unk]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_word(self, word: str) -> bytes:
        """A word after one blank, or, if it starts with a line feed, after none."""
        if word[0] == "\n":
            return self.cache["\n"] + (self.cache[word[1:]] if len(word) > 1 else b"")
        return self.encode_chunk(SPACE + word)

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = " " + text if self.prefix else text
        return text.replace(" ", SPACE) if self.escape else text

    def encode(self, text: str, ends: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; with begin and end ids if ends."""
        spread = text.replace("\n", " \n")
        if self.apart and text and text[0] != "\n" and text[0] != " " and text[-1] != " " and "  " not in spread and SPACE not in text:
            body = b"".join(map(self.words.__getitem__, spread.split(" ")))
        else:
            body = b"".join(map(self.cache.__getitem__, self.chunks(self.normalised(text))))
        return np.uint32(self.bos).tobytes() + body + np.uint32(self.eos).tobytes() if ends else body

    def decode(self, ids: bytes) -> str:
        """Runs of byte pieces become characters, each byte that is no UTF-8 U+FFFD; one leading blank goes."""
        seq = np.frombuffer(ids, "<u4").tolist()
        shown = self.shown
        if not self.high.isdisjoint(seq):
            out, raw, byte_of = [], bytearray(), self.byte_of
            for i in seq:
                if (b := byte_of.get(i)) is not None:
                    raw.append(b)
                    continue
                if raw:
                    out.append(_from_bytes(raw))
                    raw = bytearray()
                out.append(shown[i])
            text = "".join([*out, _from_bytes(raw)])
        else:
            text = "".join(map(shown.__getitem__, seq))
        first = next((i for i in seq if self.kinds[i] != _CONTROL), None)
        return text[1:] if self.prefix and first is not None and self.pieces[first].startswith(SPACE) else text


def _from_bytes(raw: bytearray) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�")
            i += n
        return "".join(out)


_MODELS: dict[int, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    key = hash(data)
    if key not in _MODELS:
        _MODELS[key] = PieceModel(data)
    return _MODELS[key]


def encode_decode(docs: DataFrame, model_file: str | None = None, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids (binary: little-endian unsigned 32-bit, with begin and end ids) and decoded.

    Null text counts as empty: begin and end ids only, decoded "". Every row is handled alone, so repeats give equal
    rows and an empty table an empty one. Existing columns of these names are kept; ours then get an underscore.
    The model (a file of fixed size, read by the driver) is broadcast; a worker keeps at most 2 * CACHE chunks.
    """
    n_tokens, ids, decoded = fresh(docs, "n_tokens", "ids", "decoded")
    with open(model_file or default_model(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = docs.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        try:
            for whole in batches:
                for i in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(i, ROWS)
                    coded = [model.encode(t.as_py() or "") for t in batch.column(place)]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(coded, pa.binary()), pa.array(map(model.decode, coded), pa.string())],
                        names=[*names, n_tokens, ids, decoded],
                    )
        finally:
            model.forget()

    schema = T.StructType([*docs.schema.fields, T.StructField(n_tokens, T.LongType()), T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])
    return short_batches(docs).mapInArrow(run, schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
