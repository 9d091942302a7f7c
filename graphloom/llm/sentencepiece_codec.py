"""SentencePiece models in the tokenizers library: the model file is parsed here, texts are encoded in batches.

The protobuf is read field by field. A unigram model keeps its scores; a BPE model gets its merges from the
pieces' scores. Normaliser, metaspace marker and byte fallback follow the model's own settings, and a backend that
disagrees with the sentencepiece library on a probe text is refused.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import struct
from array import array
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces as text_pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
# Fixed values of the model file: types of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message; lengths, varints and 32- and 64-bit values."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size = {5: 4, 1: 8}[kind]
            yield number, data[at : at + size]
            at += size


def parse(data: bytes) -> dict:
    """pieces (text, score, type) and the settings that encoding depends on."""
    out = {"pieces": [], "model": UNIGRAM, "byte_fallback": False, "rules": b"", "rule_name": "", "dummy_prefix": True, "squeeze": True, "escape": True}
    for number, value in _fields(data):
        if number == 1:
            piece = {"text": "", "score": 0.0, "type": NORMAL}
            for n, v in _fields(value):
                if n == 1:
                    piece["text"] = v.decode()
                elif n == 2:
                    piece["score"] = struct.unpack("<f", v)[0]
                elif n == 3:
                    piece["type"] = v
            out["pieces"].append((piece["text"], piece["score"], piece["type"]))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    out["model"] = v
                elif n == 35:
                    out["byte_fallback"] = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                name = {1: "rule_name", 2: "rules", 3: "dummy_prefix", 4: "squeeze", 5: "escape"}.get(n)
                if name:
                    out[name] = v.decode() if n == 1 else v if n == 2 else bool(v)
    return out


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All ways to join two pieces into a third, the best joined piece first."""
    score = {t: s for t, s, k in pieces if k in (NORMAL, USER_DEFINED, UNUSED)}
    rank = {t: i for i, (t, _, _) in enumerate(pieces)}
    found = [(-s, rank[t], rank[t[:i]], t[:i], t[i:]) for t, s in score.items() for i in range(1, len(t)) if t[:i] in score and t[i:] in score]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: dict, cached: int = 10_000):
    """A tokenizers.Tokenizer that encodes as the parsed model says."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = model["pieces"]
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), None)
    if model["model"] == UNIGRAM:
        core = models.Unigram([(t, s) for t, s, _ in pieces], unk_id=unknown, byte_fallback=model["byte_fallback"])
    elif model["model"] == BPE:
        core = models.BPE(vocab={t: i for i, (t, _, _) in enumerate(pieces)}, merges=_merges(pieces), unk_token=pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model["byte_fallback"], cache_capacity=cached)
    else:
        raise ValueError(f"no backend for a model of type {model['model']}")
    tokenizer = Tokenizer(core)
    steps = []
    if model["rules"]:
        steps.append(normalizers.Precompiled(model["rules"]))
    if model["squeeze"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(SPACE if model["escape"] else " "))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", SPACE))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    inner = any(SPACE in t.lstrip(SPACE) for t, _, k in pieces if k == NORMAL)
    if model["escape"] and not inner:  # no piece goes on past the start of a word, so words can be encoded one by one
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


# Texts on which the backend and the sentencepiece library must agree before it is used.
PROBES = ("", " ", "Hello world", "  two  spaces  ", "tab\tand\nnew line", "Éléphant naïve straße ñandú", "漢字かな交じり文 \U0001f600 ​", "a" * 300, "x=1;y=[2,3]; // 4.5e-6", "é ﬁ  .", "<s> </s> <unk> <0x0A>", "▁ marked▁text")


LEARNED = 8192  # new segments that are encoded, compared and decoded at once
REMEMBERED = 64 << 20  # bytes of segments, about, that a task remembers
OVERHEAD = 500  # bytes that a remembered segment takes beside its text and ids, as measured


class Codec:
    """Encodes and decodes with one model file; a task keeps it, and remembers the segments it has met.

    Where no piece goes on past the start of a word, a text is its segments (space markers and the word after them), and
    each distinct segment is encoded once, checked against the sentencepiece library and decoded again.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        model = parse(data)
        self.tokenizer, self.own = build(model), sentencepiece.SentencePieceProcessor(model_proto=data)
        self.tokenizer.encode_special_tokens = True
        self.by_segment = self.tokenizer.pre_tokenizer is not None
        self.plain = not model["rules"] and not model["squeeze"] and model["dummy_prefix"]
        if self.by_segment:
            self.core = build(model, 0)
            self.core.encode_special_tokens = True
            self.core.normalizer = self.core.pre_tokenizer = None
        self.remembered = remembered
        self.forget()
        for text in PROBES:
            if self.tokenizer.encode(text, add_special_tokens=False).ids != self.own.encode(text):
                raise ValueError(f"the backend differs from the model's own library on {text!r}")

    def forget(self) -> None:
        """Lets go of the segments."""
        self.segments, self.differing, self.lossy, self.held = {}, set(), set(), 0

    def release(self) -> None:
        """Lets go of the segments and gives their memory back: a worker stands by for other stages after its task."""
        self.forget()
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
            trim(0)

    def _normal(self, text: str) -> str:
        if self.plain:
            return SPACE + text.replace(" ", SPACE) if text else ""
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _learn(self, new: list[str]) -> None:
        ids = [e.ids for e in self.core.encode_batch_fast(new, add_special_tokens=False)]
        plain = [s[len(SPACE) :].replace(SPACE, " ") if s.startswith(SPACE) else s.replace(SPACE, " ") for s in new]
        own, back = self.own.encode(plain, num_threads=1), self.own.decode(ids)
        own = [[self.own.piece_to_id(SPACE)] if s == SPACE else o for s, o in zip(new, own, strict=True)]  # at a text's end; alone it is the empty text
        self.segments.update((s, array("i", i).tobytes()) for s, i in zip(new, ids, strict=True))
        self.held += sum(2 * len(s) + 4 * len(i) + OVERHEAD for s, i in zip(new, ids, strict=True))
        self.differing.update(s for s, i, o in zip(new, ids, own, strict=True) if i != o)
        self.lossy.update(s for s, p, b in zip(new, plain, back, strict=True) if p != b)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """By text: its ids as 4-byte integers, whether the sentencepiece library gives the same, and whether they decode to the text.

        A literal space marker decodes to a space, as in the library; such a text isn't restored.
        """
        if not self.by_segment:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return [(array("i", i).tobytes(), i == o, b == t) for t, i, o, b in zip(texts, ids, self.own.encode(texts), self.decode(ids), strict=True)]
        if self.held > self.remembered:
            self.forget()
        cut = [_SEGMENT.findall(self._normal(t)) for t in texts]
        new = list(set(chain.from_iterable(cut)) - self.segments.keys())
        for k in range(0, len(new), LEARNED):
            self._learn(new[k : k + LEARNED])
        out = []
        for text, segments in zip(texts, cut, strict=True):
            ids = b"".join(map(self.segments.__getitem__, segments))
            whole = SPACE not in text if self.plain else self.decode([array("i", ids).tolist()])[0] == text
            out.append((ids, self.differing.isdisjoint(segments), whole and self.lossy.isdisjoint(segments)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_tokens, token_ids, parity, round_trip.

    parity: the sentencepiece library gives the same ids; round_trip: decoding them restores the text. A null text
    counts as empty and has no tokens. Each row is encoded on its own; other columns are ignored. The model's path
    must be readable on every executor.
    """

    def run(batches):
        try:
            for batch in text_pieces(batches, "text", 512 << 10):
                rows = codec(model).encode([t or "" for t in batch.column("text").to_pylist()])
                sizes = [len(r[0]) // 4 for r in rows]
                ids = pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(r[0] for r in rows), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), ids, pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["doc_id", "n_tokens", "token_ids", "parity", "round_trip"])
        finally:  # also where the task is given up halfway
            codec(model).release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, parity boolean, round_trip boolean")


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """tokens (doc_id, token_ids) as doc_id, text. Null ids give a null text, null entries are skipped."""

    def run(batches):
        for batch in batches:
            rows = batch.column("token_ids").to_pylist()
            texts = codec(model).decode([[i for i in r or [] if i is not None] for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if r is None else t for r, t in zip(rows, texts, strict=True)], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "token_ids").mapInArrow(run, "doc_id long, text string")
