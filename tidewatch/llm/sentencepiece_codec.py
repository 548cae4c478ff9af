"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here (wire format, no generated code): pieces with scores and types, model type, byte
fallback, normaliser.  From it a tokenizer is rebuilt: normaliser (character map, extra blanks, dummy prefix),
metaspace marker, unigram scores or BPE merges in score order, byte fallback, decoder.  The parity of the rebuilt
tokenizer with the sentencepiece library is verified on PROBES when a codec is made and on the first rows of every
task.  Where no piece can span the start of a word, words are encoded apart; texts with single blanks only, which
are most, need no normaliser then.  Model bytes travel in a broadcast, so executors need no file.  Map only: no
shuffle.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters handed to the library at once; longer texts are cut where no piece can span the cut.
CHUNK = 400_000
THREADS = 2
PARITY_ROWS = 4
PROBES = (
    "", " ", "a", "Hello world", "  two  blanks ", "line\nbreak\ttab", "naïve café – “quoted”", "日本語のテキスト", "emoji 🙂🙃 here",
    "!!!!! ###### aaaa aaaaa 1234567890", "<s> </s> <unk> <0x41>", "Thntblere of then, edtioner in inea", "ÇA!! ÉTÉ!! Straße 50%%%", "\u0000​﻿",
)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[i]
        value |= (b & 127) << shift
        i, shift = i + 1, shift + 7
        if b < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: ints for varints, bytes for all else."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        elif kind == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        else:
            raise ValueError(f"wire type {kind} in the model file")
        yield tag >> 3, value


class ModelFile:
    """What the protobuf says.  Field numbers are those of the public sentencepiece_model.proto."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.model_type, self.byte_fallback, self.unk_id, self.suffix = 1, False, 0, False
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for n, v in _fields(data):
            if n == 1:
                f = dict(_fields(v))
                self.pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif n == 2:
                f = dict(_fields(v))
                self.model_type, self.byte_fallback = f.get(3, 1), bool(f.get(35, 0))
                self.unk_id, self.suffix = f.get(40, 0), bool(f.get(24, 0))
            elif n == 3:
                f = dict(_fields(v))
                self.charsmap = f.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))


class Codec:
    def __init__(self, data: bytes, verify: bool = True):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        m = self.file = ModelFile(data)
        self.data = data
        if m.suffix or m.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models with leading markers are supported")
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        unk = m.pieces[m.unk_id][0]
        usable = [(p, s) for p, s, kind in m.pieces if kind in (NORMAL, USER_DEFINED)]
        if m.model_type == 1:
            # other kinds are never found in a text, whatever they are called, and the worst score sets that of unknowns;
            # bytes take the place of unknown characters afterwards
            low = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
            hidden = [(p, s) if kind in (NORMAL, USER_DEFINED) else (f"\uffff{i}\uffff", low) for i, (p, s, kind) in enumerate(m.pieces)]
            model = models.Unigram(hidden, m.unk_id, False)
            named = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
        else:
            real, merges = {p for p, _ in usable}, []
            for p, s in usable:
                splits = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in real and p[k:] in real]
                merges += [(-s, vocab[p], vocab[a], vocab[b], a, b) for a, b in splits]
            model = models.BPE(vocab, [(a, b) for *_, a, b in sorted(merges)], unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if m.escape else " "))
        if m.escape:
            steps.append(normalizers.Replace(" ", MARK))
        # no piece has a marker after another character: then nothing merges across the start of a run of markers
        self.apart = m.escape and m.model_type == 2 and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in usable)
        self.full, self.bare, self.single = Tokenizer(model), Tokenizer(model), Tokenizer(model)
        self.back = Tokenizer(named) if m.model_type == 1 else self.full
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE} if m.model_type == 1 and m.byte_fallback else {}
        if steps:
            self.full.normalizer = normalizers.Sequence(steps)
        undo = [decoders.Replace(MARK, " ")] if m.escape else []
        undo += [*([decoders.ByteFallback()] if m.byte_fallback else []), decoders.Fuse()]
        undo += [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
        for t in (self.full, self.bare, self.single, self.back):
            if self.apart and t is not self.single:
                t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
            t.decoder = decoders.Sequence(undo)
            t.encode_special_tokens = True
            if own := [p for p, _, kind in m.pieces if kind == USER_DEFINED]:
                t.add_tokens([AddedToken(p, normalized=False, special=False) for p in own])
        self.start = re.compile(f"(?<=[^{MARK}]){MARK}")
        # then the normal form is the text with a marker for each blank and one in front
        self.plain = self.apart and m.dummy_prefix and not m.squeeze and not m.charsmap
        self.single.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=True)
        self.spelling = [bytes([int(p[3:5], 16)]) if kind == BYTE else (p.replace(MARK, " ") if m.escape else p).encode() for p, _, kind in m.pieces]
        if verify:
            self.verify(PROBES)

    @classmethod
    def load(cls, path: str = MODEL) -> Codec:
        with open(path, "rb") as f:
            return cls(f.read())

    def verify(self, texts) -> None:
        """Raises ValueError if ids or decoded text differ from the sentencepiece library's for any text."""
        import sentencepiece

        if not hasattr(self, "peer"):
            self.peer = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        for t in texts:
            own, want = self.encode([t])[0], self.peer.encode(t)
            if own != want:
                raise ValueError(f"ids differ from the sentencepiece library's for {t[:80]!r}")
            back = self.decode([own])[0]
            if back != self.peer.decode(want) or self.restores(np.array(own, np.int32), t) != (back == t):
                raise ValueError(f"decoded text differs from the sentencepiece library's for {t[:80]!r}")

    def _single(self, text: str) -> bool:
        """Whether the normal form is a marker before each word, and the words are one blank apart."""
        return self.plain and bool(text) and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " "

    def _long(self, text: str) -> list[int]:
        normal = self.full.normalizer.normalize_str(text) if self.full.normalizer else text
        ids, at = [], 0
        while at < len(normal):
            cut = len(normal)
            if cut - at > CHUNK:
                found = self.start.search(normal, at + CHUNK)
                cut = found.start() if found else cut
            ids += self.bare.encode(normal[at:cut], add_special_tokens=False).ids
            at = cut
        return ids

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        kinds: dict[str, list[int]] = {"single": [], "full": []}
        for i, t in enumerate(texts):
            if self.apart and len(t) > CHUNK:
                out[i] = np.array(self._long(t), np.int32)
            else:
                kinds["single" if self._single(t) else "full"].append(i)
        for kind, at in kinds.items():
            tokenizer = self.single if kind == "single" else self.full
            encode = tokenizer.encode_batch if self.bytes else tokenizer.encode_batch_fast  # the fast one does not say what an unknown was
            for i, e in zip(at, encode([texts[i] for i in at], add_special_tokens=False), strict=True):
                out[i] = np.array(self._with_bytes(e), np.int32)
        return out

    def _with_bytes(self, e) -> list[int]:
        """The ids of an encoding, with bytes for unknown characters where the unigram model has them."""
        if not self.bytes or self.file.unk_id not in e.ids:
            return e.ids
        return [x for i, t in zip(e.ids, e.tokens, strict=True) for x in ([self.bytes[c] for c in t.encode("utf-8", "surrogatepass")] if i == self.file.unk_id else (i,))]

    def restores(self, ids: np.ndarray, text: str) -> bool:
        """Whether the pieces of the ids spell the text; the same as decoding, from the table of pieces."""
        spelled = b"".join(map(self.spelling.__getitem__, ids.tolist()))
        return (spelled[1:] if self.file.dummy_prefix and spelled[:1] == b" " else spelled) == text.encode("utf-8", "surrogatepass")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.encode_batch(texts)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.back.decode_batch(ids, skip_special_tokens=False)


def _chunks(lengths: list[int | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > CHUNK:
            yield start, i
            start, size = i, 0
        size += n or 0
    if start < len(lengths):
        yield start, len(lengths)


@lru_cache(1)
def _codec(data: bytes, threads: int) -> Codec:
    """One for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    return Codec(data, verify=False)


def encode_documents(docs: DataFrame, path: str = MODEL, threads: int = THREADS, parity_rows: int = PARITY_ROWS) -> DataFrame:
    """doc_id, ids (array of int), round_trip (whether the ids decode to the text).

    Null and empty texts have no ids and make the round trip (null is taken as empty).  Texts that the model's
    normaliser changes, or that hold its marker character, do not.  Any length is encoded whole.  Each row gives one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec.load(path).data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, left = _codec(shared.value, threads), parity_rows
        for b in batches:
            column = b.column("text")
            for start, end in _chunks(pc.utf8_length(column).to_pylist()):
                part = [t or "" for t in column.slice(start, end - start).to_pylist()]
                ids = codec.encode_batch(part)
                whole = [codec.restores(x, t) for x, t in zip(ids, part, strict=True)]
                if left > 0:
                    codec.verify([t for t in part[:left] if len(t) <= CHUNK])
                    left -= len(part)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(start, end - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(whole)],
                    ["doc_id", "ids", "round_trip"],
                )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str = MODEL, threads: int = THREADS) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give null, null ids within a list are left out."""
    shared = encoded.sparkSession.sparkContext.broadcast(Codec.load(path).data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, threads)
        for b in batches:
            ids = b.column("ids").to_pylist()
            text = codec.decode([[i for i in x or [] if i is not None] for x in ids])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else t for x, t in zip(ids, text, strict=True)], pa.string())], ["doc_id", "text"])

    rows = pick(encoded, "doc_id", "ids").select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(run, "doc_id long, text string")
