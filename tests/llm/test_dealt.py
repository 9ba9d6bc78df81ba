"""Importance resampling, conversation repair and line dedup against plain Python and their SQL's cases beyond the tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest

from tessera.llm.conversation_repair import damaged, repair, repaired_damage, summaries
from tessera.llm.importance import resampled
from tessera.llm.line_dedup import line_dedup
from tests.llm.test_exact import A, ALNUM, ODD, docs_of

WHITE = " \t\n\v\f\r"

# ---------------------------------------------------------------- line dedup


def lines_by_hand(rows, documents):
    keys = lambda t: [x.strip(WHITE).translate(A) for x in (t or "").split("\n")]
    at = {}
    for i, t in rows:
        for k in keys(t):
            at.setdefault(k, set()).add(i)
    gone = {k for k, v in at.items() if k and len(v) >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, keys(t)) if k not in gone]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("documents", [1, 3, 10])
def test_lines(spark, documents):
    rnd = random.Random(documents)
    shared = ["Read more", " read MORE\t", "É Ünder", "", "  ", "\r", "a\r", "x" * 3000, "İ"]
    rows = ODD + [(100 + i // 2, "\n".join(rnd.choice(shared) if rnd.random() < 0.7 else f"own {rnd.random()}" for _ in range(rnd.randint(0, 9)))) for i in range(40)]
    rows += [(500 + i, "one for all") for i in range(12)] + [(600, "\n" * 500), (601, "a line\n" * 4000)]
    got = line_dedup(docs_of(spark, rows), documents).select("doc_id", "n_lines", "n_dropped", "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(lines_by_hand(rows, documents), key=key)
    assert line_dedup(docs_of(spark, [])).count() == 0


# ---------------------------------------------------------------- importance resampling


def drawn_by_hand(rows, target, run, buckets, least, percent):
    words = lambda t: ALNUM.findall((t or "").translate(A))
    feats = lambda t: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for w in [words(t)] for n in range(1, run + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(feats(x))
    for _, x in target:
        t.update(feats(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, x in rows:
        f = feats(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {}
    for n, r in enumerate(able[: len(able) * percent // 100], 1):
        rank[id(r)] = n
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("run,buckets,least,percent", [(1, 10000, 20, 10), (2, 64, 3, 50), (3, 17, 0, 100)])
def test_resampling(spark, run, buckets, least, percent):
    rnd = random.Random(run)
    vocabulary = [f"word{i}" for i in range(40)] + ["É", "straße", "X1"]
    made = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))) for _ in range(30)]
    rows = ODD + [(100 + i, rnd.choice(made)) for i in range(90)]
    target = [(i, " ".join(rnd.choice(vocabulary[:8]) for _ in range(30))) for i in range(5)] + [(9, None)]
    got = resampled(docs_of(spark, rows), docs_of(spark, target), run=run, buckets=buckets, least_words=least, percent=percent).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(drawn_by_hand(rows, target, run, buckets, least, percent), key=key)
    nothing = docs_of(spark, [])
    assert resampled(nothing, nothing).count() == 0 and resampled(docs_of(spark, rows), nothing).count() == len(rows)


# ---------------------------------------------------------------- conversation repair


def repaired_by_hand(rows):
    """rows: (turn, role, text) of one conversation, damage done. All ways of editing, the least (cost, letters) of each suffix."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    fits = {0: "user", 1: "user", 2: "assistant", 3: "user"}

    @lru_cache(None)
    def best(i, q, put):
        ways = []
        if i == len(rows) and q in (0, 3):
            ways.append((0, "", ()))
        if put < 3:
            cost, letters, turns = best(i, steps[q, fits[q][0]], put + 1)
            ways.append((cost + 5, "I" + letters, ((fits[q], ""), *turns)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, letters, turns = best(i + 1, q, 0)
            ways.append((cost + 2, "D" + letters, turns))
            late = 5 * (faults[i] == "truncated")
            if faults[i] not in ("blank", "duplicate"):
                for letter, price, said in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if (q, said[:1]) in steps:
                        cost, letters, turns = best(i + 1, steps[q, said[:1]], 0)
                        ways.append((cost + price + late, letter + letters, ((said, text), *turns)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, turns = best(0, 0, 0)
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in turns)
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversations(rnd, n, longest):
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "User", "anyone"]
    texts = ["Hello.", "Well?", "no end", " ", "", None, "ÉÀ!", "So\n. \t", "x" * 500 + "."]
    rows = []
    for c in range(n):
        straight = rnd.random() < 0.6
        for t in range(rnd.randint(1, longest)):
            role = ("user", "assistant")[t % 2] if straight and rnd.random() < 0.8 else rnd.choice(roles)
            text = f"{rnd.random()}." if straight and rnd.random() < 0.7 else rnd.choice(texts)
            rows.append((c if c else None, None if rnd.random() < 0.03 else t * 2 if rnd.random() < 0.1 else t, role, text))
            if rnd.random() < 0.05:
                rows.append(rows[-1])
    return rows


COLUMNS = "conv_id long, turn long, role string, text string, seg int, m string, n double, copies_ string, state string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "m", 0.5, "c", "s") for r in rows], COLUMNS)


@pytest.mark.parametrize("options", [{}, {"long": 3, "segment": 2}, {"long": 0, "segment": 7}])
def test_repair(spark, options):
    rows = conversations(random.Random(5), 90, 24)
    got = {r["conv_id"]: tuple(r)[1:] for r in summaries(repair(frame(spark, rows), **options)).collect()}
    want = {c: repaired_by_hand([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_damage(spark):
    rows = conversations(random.Random(6), 60, 12) + [(1000 + i, None, None, None) for i in range(40)]
    kept = {}
    for c, t, role, text in rows:
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (t, "user" if n == 4 else role, "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text)
        kept.setdefault(c, []).extend([] if n == 0 else [row] * 2 if n == 3 else [row])
    got = repaired_damage(frame(spark, rows)).collect()
    assert len(got) == len(kept) and any(not v for v in kept.values())
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: repaired_by_hand(v) for c, v in kept.items()}
    empty = frame(spark, [])
    assert repaired_damage(empty).count() == 0 and damaged(empty).count() == 0


def test_one_conversation_of_copies(spark):
    """A conversation that is nearly all one row repeated: its copies are cut like other rows."""
    rows = [(7, 0, "system", "Be kind."), *[(7, 1, "user", "Hi.")] * 9000, (7, 2, "assistant", "Hello.")]
    got = summaries(repair(frame(spark, rows), long=100, segment=2)).first()
    assert (got["duplicate"], got["illegal"], got["cost"], got["gaps"]) == (8999, 8999, 17998, 0)
    assert got["audit"] == "KK" + "D" * 8999 + "K"
    assert got["repaired_sha256"] == hashlib.sha256(b"system:Be kind.\nuser:Hi.\nassistant:Hello.").hexdigest()
