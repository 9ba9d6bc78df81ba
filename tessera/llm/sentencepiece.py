"""SentencePiece encoding and decoding: a shared-prefix forward pass over a trie of distinct words.

A text is cut into marked words (the mark stands for a space), which no piece crosses. The distinct words
of a batch are sorted, which is a depth-first walk of their trie, and one forward pass keeps its state for
each character of the current path, so words reuse what their common prefix has.

The forward state depends on the model. A unigram model keeps the best score and its last piece (Viterbi).
In a BPE model scores are merge ranks, not probabilities: the best sum of scores is not what the model
encodes. But each prefix of a word has one encoding, its last piece is the only one that is compatible with
the encoding of what stands before it (the two alone encode to themselves), and so the same walk with the
last piece as state gives the model's own result exactly.

Null and empty texts have no tokens. A character beyond the model's becomes its bytes. Decoding gives the
text again, but for the mark character itself, which reads as a space. Repeated rows get one result each,
an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_SCORE = -100.0
WORDS_KEPT, WORD_KEPT, PAIRS_KEPT, BATCH_CHARS = 200_000, 64, 400_000, 12_000_000


def vocabulary(model: bytes) -> tuple[str, list[str], list[float], list[str]]:
    """(kind, pieces, scores, types) of a SentencePiece model; types: normal, byte, or other."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = range(sp.get_piece_size())
    pieces, scores = [sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids]
    types = ["byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal" for i in ids]
    whole = sorted((s for s, t in zip(scores, types, strict=True) if t == "normal"), reverse=True)
    # merge ranks are whole numbers 0, -1, -2, ...; log probabilities are not
    kind = "bpe" if all(s == int(s) for s in whole[:1000]) else "unigram"
    return kind, pieces, scores, types


class Encoder:
    def __init__(self, kind: str, pieces: list[str], scores: list[float], types: list[str]):
        self.kind, self.pieces = kind, pieces
        self.id = {p: i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t == "normal"}
        self.score = {p: scores[i] for p, i in self.id.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t == "byte"}
        self.unknown = next((i for i, p in enumerate(pieces) if p == "<unk>"), 0)
        self.value = {i: p.encode() for p, i in self.id.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        # how long pieces can be that end with up to three given characters, the longest first: few ends have many lengths
        sizes: dict[str, set[int]] = {}
        for p in self.id:
            sizes.setdefault(p[-3:], set()).add(len(p))
        self.sizes = {end: tuple(sorted(set().union(*(sizes.get(end[k:], ()) for k in range(len(end)))), reverse=True)) for end in sizes}
        self.raw = {p: array("i", [i]).tobytes() for p, i in self.id.items()}
        # white space that is no piece ends words too
        breaks = "".join(c for c in "\n\r\t" if c not in self.id)
        self.cut = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+|[{breaks}]" if breaks else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}

    def merged(self, word: str) -> list[str]:
        """BPE as such: the adjacent pair with the best piece is merged, the first of equals, until none is left."""
        parts, score = list(word), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str | None, right: str) -> bool:
        """Whether the two pieces together encode to themselves; without a left one, whether the right one does."""
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[pair] = self.merged((left or "") + right) == ([right] if left is None else [left, right])
        return known

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each of the sorted words with its ids. The state of each prefix of the current path is its last piece (None at
        the word's begin, and after a character that is no piece) and its score (unigram): a word's ids are read off
        backwards, so memory is linear in the longest word."""
        last: list[str | None] = [None]
        total: list[float] = [0.0]
        before = ""
        raw, sizes, pairs, score, bpe = self.raw, self.sizes, self.pairs, self.score, self.kind == "bpe"
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if word[end - 1] not in raw:
                    last.append(None)
                    if not bpe:
                        total[end:] = [total[end - 1] + UNKNOWN_SCORE]
                    continue
                best, piece = None, ""
                for n in sizes.get(word[end - 3 : end] if end > 3 else word[:end]) or sizes.get(word[end - 2 : end] if end > 2 else word[end - 1 : end]) or sizes[word[end - 1]]:
                    if n > end:
                        continue
                    start = end - n
                    part = word[start:end]
                    if part not in raw:
                        continue
                    if bpe:
                        left = last[start]
                        known = pairs.get((left, part))
                        if self.fits(left, part) if known is None else known:
                            best, piece = start, part
                            break
                    elif best is None or total[start] + score[part] > total[best] + score[piece]:
                        best, piece = start, part
                last.append(piece)
                if not bpe:
                    total[end:] = [total[best] + score[piece]]
            before = word
            ids, end = [], len(word)
            while end:
                piece = last[end]
                ids.append(self.unknown_ids(word[end - 1]) if piece is None else raw[piece])
                end -= 1 if piece is None else len(piece)
            yield word, b"".join(reversed(ids))

    def unknown_ids(self, character: str) -> bytes:
        """Of a character that is no piece: its bytes, where the model has them."""
        return array("i", [self.byte[b] for b in character.encode()] if self.byte else [self.unknown]).tobytes()

    def words_of(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, four bytes each. Texts are cut twice, so only distinct words are held meanwhile."""
        distinct, known = set(), self.words
        for t in texts:
            distinct.update(self.words_of(t))
        if len(known) > WORDS_KEPT:  # words that this batch has are likely to come again
            known = self.words = {w: known[w] for w in distinct if w in known}
        known.update(self.walk(sorted(distinct - known.keys())))
        out = [b"".join([known[w] for w in self.words_of(t)]) for t in texts]
        for w in distinct:
            if len(w) > WORD_KEPT:  # a few words without spaces must not fill the memory
                del known[w]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        value = self.value
        text = b"".join([value.get(i, b"") for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_ENCODERS: dict[str, Encoder] = {}


def _shipped(docs: DataFrame, model_path: str):
    """(name, broadcast vocabulary) of a model file that the driver can read; its size is the model's."""
    with open(model_path, "rb") as f:
        model = f.read()
    return hashlib.sha256(model).hexdigest(), docs.sparkSession.sparkContext.broadcast(vocabulary(model))


def _encoder(name: str, known) -> Encoder:
    """One for each worker process and model: what it has learnt of words serves the next task too."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(*known.value)
    return _ENCODERS[name]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip (whether decoding gives the text again) of every row of docs.

    model_path: a file that the driver can read; executors get the vocabulary by broadcast (its size is the model's)."""
    name, known = _shipped(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, known)
        for b in batches:
            at = 0
            for texts in _slices([x or "" for x in b.column(1).to_pylist()]):
                found = encoder.encode(texts)
                same = [encoder.decode(array("i", ids)) == t.replace(MARK, " ") for ids, t in zip(found, texts, strict=True)]
                sizes = [len(ids) // 4 for ids in found]
                values = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(found))])
                lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), lists, pa.array(same)], ["doc_id", "n_tokens", "token_ids", "round_trip"])
                at += len(texts)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, *, key: str = "doc_id", ids: str = "token_ids", model_path: str = MODEL) -> DataFrame:
    """doc_id, text of every row of tokens; null ids give empty text."""
    name, known = _shipped(tokens, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, known)
        for b in batches:
            texts = [encoder.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = tokens.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
