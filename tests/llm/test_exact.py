"""Operators with an exact answer: against SQL, brute force, and libraries."""

import hashlib
import html as html_lib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tessera.llm import positional
from tessera.llm import queries as llm
from tests.llm.by_hand import components_by_hand
from tessera.llm.decontaminate import decontaminate
from tessera.llm.html_extract import html_extract, main_text
from tessera.llm.license_scan import OWN, REACH, license_scan
from tessera.llm.quality_rules import ODD_WORDS, RULES, START, accuracies, expectation_maximisation, quality_rules
from tessera.llm.sentencepiece import MODEL, Encoder, decode, encode, vocabulary
from tessera.llm.simhash import LIST, links, simhash
from tessera.llm.suffix_dedup import _answer_pieces, _rows, smallest_holder, suffix_dedup
from tessera.llm.url_filter import url_filter
from tests.oracle import agree

A = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that operators use themselves, as extra columns of the input.
CLASHES = "row string, words array<string>, body string, score double, sha string, block int, text_hash long, found string, fp long, kept_id long"


def docs_of(spark, rows):
    """Rows (doc_id, text) with extra columns that clash."""
    return spark.createDataFrame([(i, t, None, ["x"], "b", 1.0, "s", 0, 1, "f", 2, 3) for i, t in rows], f"doc_id long, text string, {CLASHES}")


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "É" * 40 + " straße ÀÉ"), (6, "word " * 3000), (6, "word " * 3000), (None, "no id " * 20), (7, "tie " * 30), (8, "tie " * 30), (9, "a\x00b \u2028 ﬁ İ Σ")]


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, sf, name):
    agree(spark, sf, llm.queries()[name], llm.oracle_sql()[name])


def test_licences_of_repeated_rows(spark):
    text = "under the mit license and the mit license"
    got = license_scan(docs_of(spark, [(1, text), (1, text), (None, text), (None, text), (2, text)])).collect()
    assert len(got) == 5 and [r.n_base for r in got] == [2] * 5


# ---------------------------------------------------------------- suffix array


def by_hand(rows, length):
    """What the contract of the suffix-array dedup says, directly."""
    texts = {i: (t or "").encode() for i, t in rows}
    least = {}
    for i in sorted(texts, reverse=True):
        for p in range(len(texts[i]) - length + 1):
            least[texts[i][p : p + length]] = i
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), int(gone.sum()), int(sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"block_bytes": 700, "bucket_bytes": 400}), (3, {"block_bytes": 300, "bucket_bytes": 500, "hot": 2}), (4, {"length": 12, "anchor": 5, "block_bytes": 500, "bucket_bytes": 300})])
def test_suffix_dedup(spark, seed, options):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(5, 120))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(passages) if rnd.random() < 0.6 else rnd.choice("ab") * rnd.randint(1, 90) for _ in range(rnd.randint(0, 5)))) for i in range(60)]
    rows[7] = (7, None)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs_of(spark, rows).repartition(3), **options).collect()}
    assert got == by_hand(rows, options.get("length", 50))


def test_suffix_search_takes_only_strings_that_may_repeat(monkeypatch):
    """Pieces that share an anchor but no string of 50 bytes are not sorted; of others only the runs that may occur twice."""
    from tessera.llm import suffix_dedup as module

    rng, searched = np.random.default_rng(3), []
    alone = [bytes(rng.integers(97, 123, 30, dtype=np.uint8)) + b"x" * 20 + bytes(rng.integers(97, 123, 30, dtype=np.uint8)) for _ in range(40)]
    shared = bytes(rng.integers(97, 123, 51, dtype=np.uint8))
    pieces = [*alone, b"0123456789" + shared, shared + b"9876543210"]
    sizes, holders = np.array([len(x) for x in pieces], np.uint32), np.arange(len(pieces), dtype=np.int64)
    message = _rows([(0, 0, b"".join(pieces), sizes.tobytes(), holders.tobytes(), bytes(len(pieces)))])
    monkeypatch.setattr(module, "sorted_suffixes", lambda text, real=module.sorted_suffixes: searched.append(len(text)) or real(text))
    (answer,) = _answer_pieces(message, length=50).to_pylist()
    assert sum(searched) < 120
    n = np.frombuffer(answer["a"], np.uint32)
    assert n.tolist() == [0] * 41 + [2]
    assert np.frombuffer(answer["b"], np.uint32).tolist() == [2, 10] and np.frombuffer(answer["c"], np.int64).tolist() == [40, 41]


@pytest.mark.parametrize("width", [1, 3, 7, 8, 9, 16, 20, 50])
def test_windows_hash_by_eight_bytes(width):
    """Equal substrings have equal numbers and anchors, and others differ; before, each byte was looked up and doubled."""
    from tessera.llm.suffix_dedup import _rolled, anchored

    buf = np.frombuffer(b"".join(random.Random(width).choices([b"ab", b"abc", b"cab" * 20], k=300)), np.uint8)
    n, raw = len(buf) - width + 1, buf.tobytes()
    found = _rolled(buf, n, width).tolist()
    strings = [raw[i : i + width] for i in range(n)]
    assert len(set(zip(strings, found))) == len(set(strings)) == len(set(found))
    sizes = np.array([200, len(buf) - 200])
    start, count, ids = anchored(buf, sizes, width + 30, width)
    places = [i + j for i, c in zip(start.tolist(), count.tolist()) for j in range(c)]
    assert places == [*range(200 - width - 29), *range(200, len(buf) - width - 29)]
    anchors = dict(zip(places, np.repeat(ids, count).tolist()))
    own = {}
    assert all(own.setdefault(raw[p : p + width + 30], a) == a for p, a in anchors.items())


@pytest.mark.parametrize("hot", [1, 2000])
def test_suffix_dedup_of_one_character(spark, hot):
    """Every string of the larger text is one string; it goes as one."""
    rows = [(1, "a" * 3_000_000), (2, "b" * 100 + "a" * 2_000_000), (3, "a" * 60 + "c")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(docs_of(spark, rows), hot=hot).collect()}
    assert got == {1: (3_000_000, 0, 0), 2: (2_000_100, 2_000_000, 1), 3: (61, 60, 1)}


def test_suffix_dedup_odd_rows(spark):
    rows = [*ODD, (10, "tie " * 30 + "x" * 60)]
    got = suffix_dedup(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [r.n_removed for r in got if r.doc_id == 6] == [0, 0]  # rows of one id never match each other
    assert [r.n_removed for r in got if r.doc_id == 8] == [120] and [r.n_removed for r in got if r.doc_id == 10] == [120]
    assert suffix_dedup(docs_of(spark, [])).count() == 0


def test_interval_expansion():
    rnd = random.Random(5)
    pieces = list({"".join(rnd.choice("ab") for _ in range(rnd.randint(6, 40))).encode() for _ in range(80)})
    holders = np.array([rnd.randint(0, 20) for _ in pieces])
    least = {}
    for p, h in zip(pieces, holders):
        for k in range(len(p) - 5):
            least[p[k : k + 6]] = min(h, least.get(p[k : k + 6], 99))
    assert smallest_holder(pieces, holders, 6).tolist() == [least[p[k : k + 6]] for p in pieces for k in range(len(p) - 5)]


# ---------------------------------------------------------------- SimHash


def hash_by_hand(text, n=3):
    w = SPACED.findall((text or "").translate(A))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: hash_by_hand(r.text) for r in rows}
    got = {r.doc_id: r for r in simhash(docs).collect()}
    assert {i: f"{f:016x}" for i, f in fps.items()} == {i: r.fingerprint for i, r in got.items()}
    assert components_by_hand(fps) == {i: r.component_id for i, r in got.items()}


def test_simhash_long_lists(spark):
    """More near fingerprints than a list pairs: components must be as by hand, and pairs must not be."""
    rnd = random.Random(9)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(16), rnd.randint(0, 3))) for _ in range(12 * LIST)} | {rnd.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in found)
    assert len(found) < 40 * len(fps)
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert components_by_hand({x: x & (1 << 64) - 1 for x in signed}) == {x: find(x) for x in signed}


def test_simhash_odd_rows(spark):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash(docs_of(spark, ODD)).collect()]
    assert len(got) == len(ODD)
    assert {c for i, f, c in got if f == "0" * 16} == {1} and {c for i, _, c in got if i in (7, 8)} == {7}
    assert all(f == f"{hash_by_hand(dict(ODD)[i]):016x}" for i, f, _ in got)
    assert simhash(docs_of(spark, [])).count() == 0
    assert len({r.fingerprint for r in simhash(docs_of(spark, [(1, "A b"), (2, "a\x0bB ")])).collect()}) == 1


def test_simhash_of_a_long_text_and_a_large_near_group(spark):
    """One text of 200,000 words, and 20,000 rows of near copies, which are one component."""
    long = " ".join(f"w{i % 9973}" for i in range(200_000))
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f g h i j k l m n o p " * 30), F.col("id") % 400).alias("text"))
    got = simhash(rows.unionByName(spark.createDataFrame([(-1, long)], "doc_id long, text string")))
    assert got.where("doc_id = -1").first().fingerprint == f"{hash_by_hand(long):016x}"
    near = {i: hash_by_hand("a b c d e f g h i j k l m n o p " * 30 + str(i)) for i in range(400)}
    want = components_by_hand(near)
    assert {r.doc_id: r.component_id for r in got.where("doc_id >= 0").collect()} == {i: want[i % 400] for i in range(20_000)}


# ---------------------------------------------------------------- decontamination, licences, rules


def test_decontamination_odd_rows(spark):
    items = [(0, "tie " * 13), (1, "one two"), (2, None), (3, "É É"), (4, "word " * 20), (4, "word " * 20)]
    got = decontaminate(docs_of(spark, ODD), spark.createDataFrame(items, "item_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and by[1].n_words == 0 and not by[1].contaminated and by[4].n_hit == 2 and by[7].n_hit == 30 and by[6].n_hit == 3000
    assert by[8].items_sha256 == hashlib.sha256(b"0").hexdigest() and by[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    none = decontaminate(docs_of(spark, ODD), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(ODD)


def test_decontamination_without_limits_of_a_scan(spark, monkeypatch):
    """More tokens than a plan takes, tables too large to broadcast, and a text of one looked-for word give the same."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))) for i in range(60)] + [(60, "same " * 14), (61, None)]
    docs = [(i, " ".join(items[rnd.randrange(60)][1] if rnd.random() < 0.3 else rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for i in range(80)] + [*ODD, (100, "same " * 5000)]
    args = docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontaminate(*args).collect()))
    monkeypatch.setattr(positional, "TOKENS_A_SCAN", 10)
    monkeypatch.setattr(positional, "PLACES_A_ROW", 7)
    monkeypatch.setattr(positional, "BROADCAST_ROWS", 5)
    assert sorted(map(str, decontaminate(*args).collect())) == want and len(want) == len(docs)
    assert [r.n_hit for r in decontaminate(*args).where("doc_id = 100").collect()] == [5000]


def test_licences(spark, sf):
    phrases = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
    extra = [(9001, "CC-BY cc by, MIT\nLicense the Apache; LICENSE GNU general public license version 3"), (9002, "permission is hereby granted free of charge"), (9003, "license gnu"), (9004, "x " * 70 + "subject to the terms of the Mozilla Public License, v. 2.0; neither the name of nor may be used to endorse or promote products derived from this software. Apache License, Version 2.0 (the License)"), *[(9010 + k, words) for k, (_, words, _) in enumerate(OWN)], *[(9100 + (i or 0), t) for i, t in ODD]]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + extra
    got = {r.doc_id: r for r in license_scan(docs_of(spark, rows)).collect()}
    for i, t in rows:
        v = ALNUM.findall((t or "").translate(A))
        at = [(k, lab) for lab, p in phrases for k in range(len(v)) if v[k : k + len(p.split())] == p.split()]
        want = (len(v), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1
    listed = [(lab, p.split(), p.split()) for lab, p in phrases] + [(lab, words.split(), p.split()) for lab, words, p in OWN]
    assert max(len(w) for _, w, _ in listed) <= REACH
    for i, t in rows:
        v, found = ALNUM.findall((t or "").translate(A)), []
        for lab, words, p in listed:
            at = next(k for k in range(len(words)) if words[k : k + len(p)] == p)
            for k in range(len(v)):
                if v[k : k + len(p)] == p:
                    found.append((lab, sum(0 <= k - at + j < len(v) and v[k - at + j] == w for j, w in enumerate(words)) / len(words)))
        assert got[i].labels == ",".join(sorted({x for x, _ in found})) and got[i].score == pytest.approx(max((x for _, x in found), default=0.0)), i
    assert got[9002].labels == "mit" and got[9002].base_labels == "" and "gpl-3.0" in got[9001].labels
    assert license_scan(docs_of(spark, [])).count() == 0


def test_rules(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(9000 + k, t) for k, (_, t) in enumerate(ODD)]
    rows += [(9500, "a b c d e f g h i " * 2), (9501, "a " * 9), (9502, " ".join(map(str, range(50))) + " x " + " ".join(map(str, range(5, 20))))]
    got = {r.doc_id: r for r in quality_rules(docs_of(spark, rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = SPACED.findall(t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules(docs_of(spark, [])).count() == 0
    odd = quality_rules(docs_of(spark, ODD)).collect()
    assert len(odd) == len(ODD) and [r.n_words for r in odd if r.doc_id == 6] == [3000, 3000] and [r.kept for r in odd if r.doc_id is None] == [False]


def by_hand_posterior(patterns):
    """The mixture by plain loops: posterior of a good text for each pattern."""
    good, alarm, own, other = START
    n, total = len(RULES), sum(patterns.values())
    share0 = [good] + [(1 - good) / n] * n
    bad0 = [[alarm] * n] + [[own if r == k else other for r in range(n)] for k in range(n)]
    share, bad = share0, bad0

    def kinds_of(p):
        like = [s * math.prod((b[r] if v < 0 else 1 - b[r]) for r, v in enumerate(p) if v) for s, b in zip(share, bad)]
        return [x / sum(like) for x in like]

    for _ in range(500):
        w = {p: [x * c for x in kinds_of(p)] for p, c in patterns.items()}
        new = [(sum(x[k] for x in w.values()) + 2 * share0[k]) / (total + 2) for k in range(n + 1)]
        bad = [[(sum(x[k] for p, x in w.items() if p[r] < 0) + 2 * bad0[k][r]) / (sum(x[k] for p, x in w.items() if p[r]) + 2) for r in range(n)] for k in range(n + 1)]
        moved, share = max(abs(a - b) for a, b in zip(new, share)), new
        if moved < 1e-9:
            break
    return {p: kinds_of(p)[0] for p in patterns}


def test_posterior_and_kept_by_hand(spark, sf):
    """Votes from the counts by plain Python, EM by plain loops, and the whole query's posterior and verdict."""
    names = [f"vote_{s}" for s, *_ in RULES]
    rows = llm.queries()["op8_quality_rules"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    share = lambda a, b: a / b if b else 0.0
    for r in rows:
        t = texts[r.doc_id]
        w, lines = SPACED.findall(t), [x for x in t.split("\n") if SPACED.search(x)]
        odd = len(regex.findall(ODD_WORDS, t))
        stats = [
            share(r.n_symbols, len(w)), share(r.n_dup_lines, len(lines)), share(r.n_repeat_words, len(w)), share(len(regex.findall(r"\p{Lu}", t)), r.word_chars), abs(share(r.word_chars, len(w)) - 5.5),
            max(0.0, 0.45 - share(len(set(w)), len(w)) * (max(len(w), 1) / 300) ** 0.25), share(odd, len(w)),
        ]
        assert [r[n] for n in names] == [1 if x <= good else -1 if x >= bad else 0 for x, (_, good, bad) in zip(stats, RULES, strict=True)], r.doc_id
    want = by_hand_posterior(Counter(tuple(r[n] for n in names) for r in rows))
    for r in rows:
        p = want[tuple(r[n] for n in names)]
        assert r.posterior == pytest.approx(p, abs=1e-6) and r.kept == (not r.base_failed and p >= 0.5)


def test_expectation_maximisation_finds_kinds():
    """Two faults, each seen by two rules: shares and accuracies come out, though START says other ones."""
    rnd = random.Random(2)
    counts = Counter()
    for _ in range(6000):
        kind = rnd.choices((0, 1, 2), (0.8, 0.12, 0.08))[0]
        sees = {0: (), 1: (0, 3), 2: (1, 2)}[kind]
        bad = lambda r: rnd.random() < (0.9 if r in sees else 0.005)
        counts[tuple(0 if rnd.random() < 0.1 else -1 if bad(r) else 1 for r in range(len(RULES)))] += 1
    found, bad = expectation_maximisation(sorted(counts.items()))
    assert abs(found[0] - 0.8) < 0.04 and all(good > 0.98 for _, good in accuracies(found, bad))
    assert [b for b, _ in accuracies(found, bad)[:4]] == pytest.approx([0.54, 0.36, 0.36, 0.54], abs=0.08)
    assert expectation_maximisation([])[0][0] == START[0]


def test_rules_against_labels(spark):
    """What EM finds without labels stands near what the labels say."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = llm.queries()["op8_quality_rules"](spark, sf).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n[0, True] < 0.02 * n[0, False] and n[1, False] < 0.04 * n[1, True]


# ---------------------------------------------------------------- URLs


def test_urls(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/de/", "block"), ("com/de/", "block")]
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y#z", "x://example.org", "https://notexample.org/es/", "https://example.org:80/es/", "http://b.com/de/", "http://b.com/DE/", "http://example.org/en/17", "http://example.org/en/17", "a://b://org/"]
    pages = spark.createDataFrame([(i, u, 1, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, block int, host string, rule string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter(pages, spark.createDataFrame(rules, "rule string, verdict string"), blocks=64).collect()}
    assert got[3] == ("a.example.org", "example.org/es/", "block") and got[4] == ("example.org", None, "allow") and got[5][1] == "org/" and got[6][1] is None
    assert got[7][2] == "block" and got[8][2] == "allow" and got[9] == got[10] and got[9][1] == "example.org/en/1" and got[0] == ("", None, "allow") and got[11][0] == "b:"
    assert url_filter(pages.limit(0), spark.createDataFrame(rules, "rule string, verdict string")).count() == 0


# ---------------------------------------------------------------- tokens


def test_tokens_are_the_librarys(spark, sf):
    import sentencepiece

    with open(MODEL, "rb") as f:
        model = f.read()
    sp, e = sentencepiece.SentencePieceProcessor(model_proto=model), Encoder(*vocabulary(model))
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aebtn oi▁.,\n  é日🙂1\t") for _ in range(rnd.randint(0, 60))) for _ in range(400)] + ["", "x" * 3000, " " * 50]
    assert [np.frombuffer(x, np.int32).tolist() for x in e.encode(texts)] == sp.encode(texts)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = encode(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = found.collect()
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) and r.token_ids == sp.encode(text[r.doc_id]) for r in rows) and len(rows) == len(text)
    assert {r.doc_id: r.text for r in decode(found).collect()} == text
    odd = encode(docs_of(spark, ODD)).collect()
    assert len(odd) == len(ODD) and all(r.round_trip for r in odd) and encode(docs_of(spark, [])).count() == 0


def test_words_of_any_length_take_linear_memory():
    import sentencepiece

    with open(MODEL, "rb") as f:
        model = f.read()
    sp, e = sentencepiece.SentencePieceProcessor(model_proto=model), Encoder(*vocabulary(model))
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé日本語0123456789+/\U0001f642") for _ in range(20_000))
    assert np.frombuffer(e.encode([long])[0], np.int32).tolist() == sp.encode(long)
    whole = long * 50  # a million characters
    tracemalloc.start()
    found = e.encode([whole])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert e.decode(np.frombuffer(found, np.int32).tolist()) == whole and most < 200e6
    assert all(len(w) <= 64 for w in e.words)


def test_unigram_models_take_the_best_score():
    pieces, scores = ["<unk>", "▁", "a", "b", "▁a", "ab", "▁ab"], [0.0, -1.5, -2.5, -2.5, -1.0, -1.2, -4.0]
    e = Encoder("unigram", pieces, scores, ["other"] + ["normal"] * 6)
    assert [pieces[i] for i in np.frombuffer(e.encode(["ab"])[0], np.int32)] == ["▁", "ab"]


# ---------------------------------------------------------------- HTML


def test_html():
    page = (
        '<!DOCTYPE html><html><head><title>T. x</title><script>var t="</p>";</script></head><body><header>Site head</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy, now. It is good.</div>'
        '<article><h1>Head &amp; more</h1><p><b>One &lt;two&gt;,\n  three.<br>four<p>Five, six &eacute; seven &am</p><form><p>Your mail, please.</p></form><p>x < y</p></article><section class="comments"><p>I think, that.</p></section><aside><p>Side, bar.</p></aside><footer>&copy; foot'
    )
    assert main_text(page) == "Head & more\n\nOne <two>, three. four\n\nFive, six é seven &am\n\nx < y"
    assert main_text("") == main_text("<p") == main_text("<nav>x</nav>") == ""
    assert main_text("plain text") == "plain text"
    assert main_text('<div class="content"><p>Long text, with sentences. And more of it.</p><p>Yes, more, and more.</p></div><div class="sidebar"><p>Side.</p></div><div id="cookie-notice">We use cookies, ok.</div>') == "Long text, with sentences. And more of it.\n\nYes, more, and more."


def test_html_keeps_all_of_an_article():
    page = (
        "<body><main><div class='breadcrumb'><a href='/'>Home, sweet.</a></div><article class='post'><h1>T</h1><div><p>Body, with marks. And so on.</p><table><tr><td>a cell</td><td>b</td></tr></table></div>"
        "<ul><li><a href='/x'>A link</a></li></ul><figure><img src=x><figcaption>Shown</figcaption></figure><div style='display: none'>Not shown, at all.</div><div class='newsletter-signup'><p>Sign up, now.</p></div></article>"
        "<div class='user-comments'><p>First, I say. No.</p></div></main></body>"
    )
    assert main_text(page) == "T\n\nBody, with marks. And so on.\n\na cell\n\nb\n\nA link\n\nShown"


PROSE = "<p>This is a paragraph of prose, with marks. It goes on, and on, for a while.</p>"
P = PROSE[3:-4]


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<body><div class="page has-sidebar"><div id="content">{PROSE * 3}</div><div class="sidebar"><p>Side text, here.</p></div></div>', [P] * 3),
        (f'<body><form id="main"><input name="q">{PROSE * 3}<p>An end.</p></form>', [P, P, P, "An end."]),
        (f'<div class="sidebar-layout"><main>{PROSE}</main><div class="sidebar">{PROSE}</div></div>', [P]),
        (
            f'<article><h1>T</h1>{PROSE}<p class="side-effects">Side effects, some. Yes.</p><p class="meta-analysis">Meta analysis, it is. Good.</p><p class="legal-notice">Legal notice, it is. Good.</p>'
            f'<section id="related-work">{PROSE}</section><section class="discussion">{PROSE}</section><div class="ad-slot">{PROSE}</div><div class="related-posts"><a href="x">Foo bar</a></div></article>',
            ["T", P, "Side effects, some. Yes.", "Meta analysis, it is. Good.", "Legal notice, it is. Good.", P, P],
        ),
        (f"<article><header><h1>Headline</h1><p>By someone, today.</p></header>{PROSE}</article><footer>Foot, of the page. {P * 9}</footer>", ["Headline", P]),
        (f'<div class="post">{PROSE}</div><div class="comments">{PROSE * 8}</div>', [P]),
        ("<div>" * 100_000 + PROSE + "</div>" * 100_000, [P]),
        ("<div><span></p>" * 50_000 + PROSE, [P]),
        (f"<p>{'long text, and more. ' * 100_000}", ["long text, and more. " * 99_999 + "long text, and more."]),
    ],
)
def test_html_layouts(page, want):
    assert main_text(page) == "\n\n".join(want)


PARA = "This paragraph is part of the text, with commas, full stops and words enough that nobody takes it for a menu or for a label. So it stays. "


@pytest.mark.parametrize(
    "page,want",
    [
        ("<body><h1>The headline of it</h1><div class=byline>By A</div><div class=text><p>{P}</p><p>{P}</p><p>{P}</p></div>", ["The headline of it", "{P}", "{P}", "{P}"]),
        ("<div class=content><h1>Head</h1><p>{P}</p><ul><li>one</li><li>two</li></ul><table><tr><td>1</td><td>2</td></tr></table><h2>Next</h2><p>{P}</p></div>", ["Head", "{P}", "one", "two", "1", "2", "Next", "{P}"]),
        ('<article><p>{P}</p><section class="social-issues"><p>{P}</p></section></article>', ["{P}", "{P}"]),
        ('<article><p>{P}</p><div id="comment-on-results"><p>{P}</p></div></article>', ["{P}", "{P}"]),
        ('<article><p>{P}</p><div class="widget-guide"><p>{P}</p></div></article>', ["{P}", "{P}"]),
        ('<article><p>{P}</p><div class="notice">We use cookies, please accept them all.</div><p>{P}</p></article>', ["{P}", "{P}"]),
        # ten pages without article
        ('<div id="page"><div id="nav"><a href=a>Home</a> <a href=b>About</a></div><div id="body"><h2>Part</h2><p>{P}</p><ol><li>first step</li><li>second step</li></ol><p>{P}</p></div></div>', ["Part", "{P}", "first step", "second step", "{P}"]),
        ('<div class="post"><p>{P}</p><table><caption>Figures</caption><tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>12</td></tr></table></div><div class="sidebar"><p>{P}</p></div>', ["{P}", "Figures", "Year", "Sum", "1999", "12"]),
        ("<table><tr><td><a href=a>Home</a><br><a href=b>News</a></td><td><h1>Old page</h1><p>{P}</p><p>{P}</p><p>{P}</p><p>{P}</p></td></tr></table>", ["Old page", "{P}", "{P}", "{P}", "{P}"]),
        ('<div class="text"><p>{P}</p><figure><img src=x><figcaption>A picture.</figcaption></figure><p>{P}</p></div><div class="footer">Imprint</div>', ["{P}", "A picture.", "{P}"]),
        ('<div class="text"><p>{P}</p><blockquote>Short quote.</blockquote><pre>x = 1</pre><p>{P}</p></div><div class="comments"><p>{P}</p></div>', ["{P}", "Short quote.", "x = 1", "{P}"]),
        ('<div class="text"><dl><dt>Word</dt><dd>{P}</dd></dl></div><div class="share-links"><a href=a>Share</a></div>', ["Word", "{P}"]),
        ('<body><h1>Title</h1><p>{P}</p><h2>Two</h2><p>{P}</p><div class="newsletter-signup"><form>Mail</form></div>', ["Title", "{P}", "Two", "{P}"]),
        ('<div class="cookie-banner">We use cookies.</div><h1>Title</h1><div class="story"><p>{P}</p><p>{P}</p></div><div class="related"><a href=x>More</a></div>', ["Title", "{P}", "{P}"]),
        ('<div class="content"><section class="social-issues"><h2>Issues</h2><p>{P}</p></section><section class="policy"><h2>Policy</h2><p>{P}</p></section></div>', ["Issues", "{P}", "Policy", "{P}"]),
        ('<div class="content"><p>{P}</p><p>Short one.</p><p>{P}</p><p>See <a href=x>this</a> as well.</p></div><div class="ad-slot">Buy this now, it is good.</div>', ["{P}", "Short one.", "{P}", "See this as well."]),
    ],
)
def test_html_keeps_what_belongs_to_the_text(page, want):
    assert main_text(page.replace("{P}", PARA)).split("\n\n") == [x.replace("{P}", PARA.strip()) for x in want]


def test_html_rows(spark):
    """Null, empty and repeated pages, a null id, columns that clash, and an empty table."""
    rows = [(1, None), (2, ""), (3, " \n"), (4, f"<body>{PROSE}"), (4, f"<body>{PROSE}"), (None, "<p>é &amp; 🙂"), (6, "<<<>&&#0;")]
    schema = "page_id long, url string, html string, text string, n_chars long, path string"
    pages = spark.createDataFrame([(i, f"u{k}", x, "t", 1, "p") for k, (i, x) in enumerate(rows)], schema)
    got = {(r.url, r.page_id): (r.text, r.n_chars) for r in html_extract(pages).collect()}
    assert len(got) == len(rows) and got["u0", 1] == got["u1", 2] == got["u2", 3] == ("", 0)
    assert got["u3", 4] == got["u4", 4] == (P, len(P)) and got["u5", None] == ("é & 🙂", 5) and all(len(t) == n for t, n in got.values())
    empty = html_extract(pages.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


def test_html_query_against_what_pages_are_made_of(spark, sf):
    """Pages of the table keep their article: each block of the result stands in the page, and no advert, menu or footer does."""
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in llm.queries()["op10_html_extraction"](spark, sf).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        article = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)
        if article and "<" in page:
            inner = re.sub(r"(?s)<(script|style|aside|form|nav|footer)\b.*?</\1>|<div class=\"ad\">.*?</div>|<!--.*?-->", " ", article[1])
            words = re.sub(r"\s+", "", html_lib.unescape(re.sub(r"<[^>]*>", " ", inner)))
            if "<" not in words and "comments" not in article[1]:
                assert re.sub(r"\s+", "", got[i]) == words, i
