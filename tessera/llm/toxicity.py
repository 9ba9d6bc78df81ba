"""Toxicity: nearest labelled examples by exact TF-IDF cosine over all words.

Texts are vectors of all their words, and of those beginnings of words (toxic words come in many endings)
that are marked. Marked terms tell labelled examples apart (chi squared, more often in toxic ones) and weigh
MARKED times as much. Weights are (1 + log tf) * idf, with idf over all texts; a word that no example has
cannot meet one and counts in the text's norm only, as a word of a single text. The K nearest come from a
block-max inverted index over all these terms (class Index) and are exact. Votes are weighted by nearness,
cos ** 2 / (1.05 - cos), against PRIOR clean votes, so far neighbours alone never make a text toxic.

The examples are a bounded sample (`examples` toxic ones and twice as many clean, by hash of the id) of the labelled rows that
aren't held out; everything else covers all rows. Null and empty texts, and texts that share no word with an example,
have score `base`. Ties in cosine go to the smaller example id. Repeated rows get one result each. Unless
there are toxic and clean labels all scores are `base`; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, stored

EXAMPLES, LEAST_EXAMPLES, LIFT, CHI = 2500, 5, 5.0, 12.0
MARKED, NEAR = 4.0, 2e-5
LONG, BLOCK, SEED = 512, 16, 8
PREFIXES = (3, 4, 5, 6)
K, BATCH, PRIOR, BASE = 9, 256, 0.8, 0.005
#: Digits, letters and bytes beyond ASCII stay; every other byte becomes a space.
_SPACED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of digits, ASCII letters and characters beyond ASCII, in UTF-8."""
    return text.lower().encode().translate(_SPACED).split()


def beginnings(word: bytes) -> list[bytes]:
    """Of PREFIXES characters, shorter than the word."""
    if word.isascii():
        return [word[:k] for k in PREFIXES if len(word) > k]
    letters = word.decode()
    return [letters[:k].encode() for k in PREFIXES if len(letters) > k]


def terms_of(text: str) -> Counter:
    """Words and, marked by a trailing *, their beginnings."""
    found = Counter(words_of(text))
    out = Counter({w.decode(): n for w, n in found.items()})
    for w, n in found.items():
        for head in beginnings(w):
            out[head.decode() + "*"] += n
    return out


def examples_of(docs: DataFrame, labels: DataFrame, label: str, examples: int) -> DataFrame:
    """(doc_id, text, y): at most `examples` toxic rows and twice as many clean ones, of those not held out."""
    rows = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    order = lambda y, n: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(n)
    chosen = order(1, examples).unionByName(order(0, 2 * examples))
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")


def terms_found(chosen: DataFrame, least: int = LEAST_EXAMPLES, lift: float = LIFT, chi_least: float = CHI) -> tuple[list[str], list[str]]:
    """All words of the examples, and the terms that tell toxic examples from clean ones, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = list(terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(t), pa.int32()), pa.array(t, pa.string())], ["y", "term"])

    n = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return [], []
    found = chosen.select(F.col("y").cast("int"), "text").mapInArrow(run, "y int, term string")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    counts = stored(found.groupBy("term").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")), "terms")
    words = counts.where(~F.col("term").endswith("*")).select("term").toArrow().column(0).to_pylist()
    total = float(toxic + clean)
    chi = total * F.pow(a * (clean - b) - b * (toxic - a), F.lit(2)) / (toxic * clean * (a + b) * F.greatest(total - a - b, F.lit(1.0)))
    # chance alone hardly gives a term CHI; the examples' number bounds what is found
    top = counts.where(a + b >= least).where(a / toxic > lift * (b + 0.5) / clean).where(chi > chi_least)
    return sorted(words), sorted(r["term"] for r in top.select("term").collect())


class Terms:
    """Numbers of the terms: all words of the examples, then the marked beginnings."""

    def __init__(self, words: list[str], marked: list[str]):
        begins = [t[:-1] for t in marked if t.endswith("*")]
        self.words = {w.encode(): i for i, w in enumerate(words)}
        self.begins = {t.encode(): len(words) + i for i, t in enumerate(begins)}
        self.heads, self.sizes = {t[:3] for t in self.begins}, sorted({len(t) for t in self.begins})
        self.n = len(words) + len(begins)
        self.marked = [self.begins[t[:-1].encode()] if t.endswith("*") else self.words[t.encode()] for t in marked]

    def begun(self, word: bytes) -> list[int]:
        """The marked beginnings of a word; bytes begin a word as their characters do."""
        return [i for k in self.sizes if k < len(word) and (i := self.begins.get(word[:k])) is not None]

    def held(self, text: str | None) -> list[int]:
        """The terms of a text alone."""
        words = set(words_of(text)) if text else set()
        heads = self.heads
        begun = {i for w in words if w[:3] in heads for i in self.begun(w)}
        return [i for i in map(self.words.get, words) if i is not None] + list(begun)

    def of(self, text: str | None) -> tuple[list[int], list[int], float]:
        """(terms, their counts, sum of squared (1 + log tf) of the words that no example has)."""
        found: dict[int, int] = {}
        rest, heads, number = 0.0, self.heads, self.words.get
        for w, n in Counter(words_of(text)).items() if text else ():
            i = number(w)
            if i is None:
                rest += 1.0 if n == 1 else (1 + math.log(n)) ** 2
            else:
                found[i] = n
            if w[:3] in heads:
                for i in self.begun(w):
                    found[i] = found.get(i, 0) + n
        return list(found), list(found.values()), rest


def vectors(docs: DataFrame, terms: Broadcast) -> DataFrame:
    """(doc_id, y, term array<int>, tf array<int>) of examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = terms.value.of
        for b in batches:
            found = [of(text) for text in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in (0, 1))], ["doc_id", "y", "term", "tf"])

    rows = docs.select("doc_id", F.col("y").cast("int").alias("y"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, term array<int>, tf array<int>")


def text_counts(docs: DataFrame, terms: Broadcast) -> np.ndarray:
    """How many texts hold each term, and last how many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = terms.value
        held = np.zeros(own.n + 1, np.int64)
        for b in batches:
            held[-1] += b.num_rows
            for text in b.column(0).to_pylist():
                held[own.of(text)[0]] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms.value.n + 1, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


class Index:
    """Examples as a block-max inverted index.

    Examples are numbered so that alike ones (label, heaviest common term) stand together, BLOCK to a block. The LONG longest
    posting lists are kept by block, each block with its greatest weight; shorter lists are read whole, for their blocks would
    hold a posting or two. A query's bound for a block is what the greatest weights of its long lists and its short lists can
    give there. Queries come in batches. Each query's SEED blocks of the highest bounds are scored first; of the rest only
    those whose bound reaches the k-th best cosine so far, so no neighbour is lost. A block is scored at once for all queries
    that reach it, in single precision, and all within NEAR (more than its error) of the k-th best again in double."""

    def __init__(self, rows: list[tuple[int, int, list[int], list[int]]], idf: np.ndarray, block: int = BLOCK, long: int = LONG):
        self.idf, self.block = idf, block
        rows = [r for r in rows if len(r[2])]
        units = [self.unit(np.asarray(r[2], np.int64), np.asarray(r[3])) for r in rows]
        held = np.bincount(np.concatenate([r[2] for r in rows]).astype(np.int64), minlength=len(idf)) if rows else np.zeros(len(idf), np.int64)
        heads = [int(r[2][np.argmax(np.where(held[r[2]] >= block, u, 0.0))]) for r, u in zip(rows, units, strict=True)]
        order = sorted(range(len(rows)), key=lambda i: (rows[i][1], heads[i], rows[i][0]))
        self.ids = np.array([rows[i][0] for i in order], np.int64)
        self.y = np.array([rows[i][1] for i in order], np.float64)
        self.number = {x: i for i, x in enumerate(self.ids.tolist())}
        self.blocks = -(-len(order) // block)
        example = np.repeat(np.arange(len(order)), [len(units[i]) for i in order])
        term = np.concatenate([np.asarray(rows[i][2], np.int64) for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([units[i] for i in order]) if order else np.zeros(0)
        often = np.argsort(-held, kind="stable")[:long]
        often = often[held[often] > max(1, self.blocks // 4)]
        self.place = np.full(len(idf), -1)
        self.place[often] = np.arange(len(often))
        at = self.place[term]
        self.full = np.zeros((len(often), self.blocks, block))
        self.full[at[at >= 0], example[at >= 0] // block, example[at >= 0] % block] = weight[at >= 0]
        self.tiles = np.ascontiguousarray(self.full.astype(np.float32).transpose(1, 0, 2))
        self.most = np.ascontiguousarray(self.tiles.max(2).T) if order else np.zeros((len(often), 0), np.float32)
        by_term = np.argsort(term[at < 0], kind="stable")
        self.example, self.weight = example[at < 0][by_term].astype(np.int32), weight[at < 0][by_term]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(term[at < 0], minlength=len(idf)))))

    @property
    def weights(self) -> np.ndarray:
        """terms x examples, for small indexes."""
        out = np.zeros((len(self.idf), len(self.ids)))
        out[self.place >= 0] = self.full.reshape(len(self.full), -1)[self.place[self.place >= 0], : len(self.ids)]
        out[np.repeat(np.arange(len(self.idf)), np.diff(self.start)), self.example] = self.weight
        return out

    def unit(self, term: np.ndarray, tf: np.ndarray, rest: float = 0.0) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[term]
        return w / np.sqrt((w * w).sum() + rest)

    def nearest(self, queries: list[tuple[list[int], list[int], float]], k: int, but: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of the k nearest of each query (terms, their counts, square of what lies outside the index),
        leaving out the example with id `but`."""
        m, shape = len(queries), (len(queries), self.blocks, self.block)
        if not m or not self.blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * m
        part, q_long = np.zeros(shape), np.zeros((m, len(self.most)))
        for i, (term, tf, rest) in enumerate(queries):
            if not len(term):
                continue
            term = np.asarray(term, np.int64)
            q, at = self.unit(term, np.asarray(tf), rest), self.place[term]
            q_long[i, at[at >= 0]] = q[at >= 0]
            short = term[at < 0]
            first, n = self.start[short], self.start[short + 1] - self.start[short]
            flat = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
            part[i] = np.bincount(self.example[flat], self.weight[flat] * np.repeat(q[at < 0], n), self.blocks * self.block).reshape(shape[1:])
            if but and but[i] in self.number:
                part[i].flat[self.number[but[i]]] = -np.inf
        single = q_long.astype(np.float32)
        bound = single @ self.most + part.max(2)
        cosine = np.full(shape, -np.inf, np.float32)

        def score(reach: np.ndarray) -> None:
            for b in np.flatnonzero(reach.any(0)):
                at = np.flatnonzero(reach[:, b])
                cosine[at, b] = part[at, b] + single[at] @ self.tiles[b]

        def least(row: np.ndarray) -> float:
            return max(0.0, np.partition(row, -k)[-k] - NEAR) if len(row) > k else 0.0

        seeds = np.argpartition(bound, -SEED, axis=1)[:, -SEED:] if self.blocks > SEED else np.tile(np.arange(self.blocks), (m, 1))
        reach = np.zeros((m, self.blocks), bool)
        np.put_along_axis(reach, seeds, True, axis=1)
        score(reach)
        best = np.take_along_axis(cosine, seeds[:, :, None], axis=1).reshape(m, -1)
        floor = np.array([least(row) for row in best])
        score((bound >= floor[:, None]) & ~reach)
        out = []
        for i in range(m):
            row = cosine[i].ravel()
            number = np.flatnonzero((row > 0) & (row >= floor[i]))
            number = number[row[number] >= least(row[number])]
            own = np.flatnonzero(q_long[i])
            full = part[i].ravel()[number] + q_long[i, own] @ self.full[own[:, None], number // self.block, number % self.block]
            order = np.lexsort((self.ids[number], -full.round(12)))[:k]
            out.append((number[order], full[order]))
        return out

    def scores(self, queries: list[tuple[list[int], list[int], float]], but: list[int | None] | None = None) -> list[tuple[float, list[int]]]:
        """(score, ids of the nearest) of each query."""
        out = []
        for at, cosine in self.nearest(queries, K, but):
            weight = cosine**2 / (1.05 - np.minimum(cosine, 1.0))
            out.append((float(BASE + (1 - BASE) * (weight @ self.y[at]) / (weight.sum() + PRIOR)), self.ids[at].tolist()))
        return out


_INDEXES: dict[str, Index] = {}


def _index(name: str, known: Broadcast) -> Index:
    """One for each worker process and query."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(*known.value)
    return _INDEXES[name]


def toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", label_key: str = "doc_id", examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples) of every row of docs.

    examples: most toxic rows that are learnt from, and half of the most clean ones; they bound what is broadcast."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    given = labels.select(F.col(label_key).alias("doc_id"), F.col(label).alias(label))
    chosen = stored(examples_of(rows, given, label, examples), "examples")
    known_terms = Terms(*terms_found(chosen))
    numbers = spark.sparkContext.broadcast(known_terms)
    found = vectors(chosen.dropDuplicates(["doc_id"]), numbers).toArrow()
    learnt = [(i, y, t.values.to_numpy(), n.values.to_numpy()) for i, y, t, n in zip(*(found.column(k) for k in (0, 1)), found.column(2), found.column(3), strict=True)]
    learnt = [(i.as_py(), y.as_py(), t, n) for i, y, t, n in learnt]
    counts = text_counts(rows, numbers)
    total = int(counts[-1])
    idf = np.log((total + 1) / (counts[:-1] + 1)) + 1e-6
    idf[known_terms.marked] *= MARKED
    lone = math.log((total + 1) / 2) ** 2
    index, query = spark.sparkContext.broadcast((learnt, idf)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, known = _index(query, index), numbers.value.of, {}
        learnt_ids = set(own.ids.tolist())
        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            scores, evidence = [], []
            for i in range(0, len(docs), BATCH):
                if len(known) > 20_000:
                    known.clear()
                names, new = [], {}
                for doc, words in zip(docs[i : i + BATCH], texts[i : i + BATCH], strict=True):
                    but = doc if doc in learnt_ids else None  # an example doesn't vote for itself
                    names.append((hashlib.sha256((words or "").encode("utf-8", "surrogatepass")).digest(), but))
                    if names[-1] not in known and names[-1] not in new:
                        term, tf, rest = of(words)
                        new[names[-1]] = term, tf, rest * lone
                known.update(zip(new, own.scores(list(new.values()), [name[1] for name in new]), strict=True))
                scores += [known[name][0] for name in names]
                evidence += [known[name][1] for name in names]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, evidence array<long>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted(F.col("score"), 0.5), "evidence")


def predicted(score: Column, least: float) -> Column:
    return F.when(score >= least, 1).otherwise(0).cast("int").alias("predicted")
