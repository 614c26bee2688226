"""Collocations, suffix-array dedup and centroid clustering against brute force."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.llm import centroids, collocations, queries, suffix_dedup
from casework.llm.suffix_groups import suffix_array
from compare import DATA

SF = f"{DATA}/sf0.001"
DOCS = "doc_id BIGINT, text STRING, lang STRING"


# -- collocations ------------------------------------------------------------------------


def brute_phrases(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang, lower = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            ws = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(ws)
            for n in range(1, 5):
                counts[lang].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in frequent.items():
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items()
            )
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found_phrases(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


def mixed_texts(seed, n):
    rng = random.Random(seed)
    names = ["a", "B", "ß", "日本", "new", "york", "𝒳", "x", "the"]
    rows = [(i, "".join(rng.choice(names) + rng.choice([" ", " ", " ", "\t ", ".", ", ", "\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None])) for i in range(n)]
    return rows + [(None, None, "en"), (n, "", None), (n, "New York " * 50, "en"), (n, "New York " * 50, "en")]


@pytest.mark.parametrize("held, per_part", [(collocations.HELD, collocations.PER_PART), (300, 100)])
def test_phrases_equal_brute_force(spark, held, per_part):
    rows = mixed_texts(3, 150)
    df = spark.createDataFrame(rows, DOCS).withColumn("phrase", F.lit("clash")).withColumn("rank", F.lit(0)).withColumn("f", F.lit(1))
    assert found_phrases(df, least=5, top=30, held=held, per_part=per_part) == brute_phrases([r[1:] for r in rows], 5, 30)


def test_phrases_of_few_texts(spark):
    assert found_phrases(spark.createDataFrame([], DOCS)) == []
    assert found_phrases(spark.createDataFrame([(1, None, None), (2, "?!", "en")], DOCS)) == []
    # One text that is longer than a block of texts and than a task's counters.
    long = "big wide sea " * 40_000
    assert len(long) * 3 > collocations.BLOCK
    assert found_phrases(spark.createDataFrame([(1, long * 3, "en")], DOCS), held=1000) == brute_phrases([(long * 3, "en")], 30, 2000)


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(5)
    for _ in range(20):
        least, parts = 10, [rng.zipf(1.3, rng.integers(1, 800)).clip(max=10_000).astype(np.uint64) for _ in range(12)]
        mass = sum(map(len, parts))
        held, lost, capacity = [], 0, mass // least + 1
        for part in parts:
            keys, counts, off = collocations.trimmed(*collocations.summed([*held, np.unique(part, return_counts=True)]), capacity)
            held, lost = [(keys, counts)], lost + off
            assert len(keys) <= capacity
        true = Counter(int(x) for part in parts for x in part)
        assert lost < least and {k for k, n in true.items() if n >= least} <= {int(k) for k, n in zip(*held[0]) if n + lost >= least}


def test_large_counts_are_exact(spark):
    """Scores whose products pass 64 bits."""
    whole = "CAST({} AS DECIMAL(19,0))"
    a, b = 9 * 10**17, 9 * 10**17 + 7
    got = spark.range(1).select(F.expr(f"CAST({whole.format(2_000_000)} * {whole.format(a)} div {whole.format(a + b)} AS BIGINT)")).first()[0]
    assert got == 2_000_000 * a // (a + b)


# -- suffix-array dedup ------------------------------------------------------------------


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randint(0, rng.choice([0, 1, 2, 4])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    for s in ([0] * 500, [0, 1] * 300, list(range(300)), list(range(300, 0, -1))):
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_runs_no_python_for_each_symbol():
    """A loop over the symbols of all pieces was most of the query's time."""
    rng = random.Random(3)
    text = [rng.randint(1, 9) for _ in range(2000)]
    symbols = np.array([*text, 0, *text[500:1500], 0, *text, 0] + [rng.randint(0, 300) for _ in range(5000)] + [7] * 500)
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        found = suffix_array(symbols)
    finally:
        sys.settrace(before)
    s = symbols.tolist()
    assert found.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    assert lines < len(s) / 2


def brute_repeats(rows, size):
    raws, count = [(t or "").encode() for _, t in rows], Counter()
    for r in raws:
        count.update(r[i : i + size] for i in range(len(r) - size + 1))
    out = []
    for (doc, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if count[r[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((doc, len(r), sum(gone), runs, bytes(b for b, x in zip(r, gone) if not x)))
    return sorted(out, key=str)


def found_repeats(df, **options):
    rows = suffix_dedup.without_repeats(df, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), bytes(r.kept)) for r in rows), key=str)


def repeating_texts(seed):
    rng = random.Random(seed)
    text = lambda k, n: "".join(rng.choice("abé \n\0"[:k]) for _ in range(n))
    passage = text(4, 60)
    rows = [(1, None), (2, ""), (3, text(3, 50)), (5, "a" * 100), (6, "a" * 39), (7, passage), (None, passage), (7, passage), (8, "é" * 50)]
    rows += [(100 + i, text(4, rng.randint(0, 40)) + passage[rng.randint(0, 20) : rng.randint(30, 60)] + text(6, 30)) for i in range(50)]
    return rows + [(200 + i, text(2, 60)) for i in range(25)]


@pytest.mark.parametrize("size, anchor, group, cuts", [(20, 8, 2000, (11, 1)), (20, 8, 2, (5, 1)), (20, 12, 1, (3, 1)), (10, 4, 3, (4, 2, 1))])
def test_repeats_equal_brute_force(spark, size, anchor, group, cuts):
    rows = repeating_texts(size + group)
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("kept", F.lit(1)).withColumn("k1", F.lit("clash")).withColumn("spans", F.lit(None).cast("string"))
    assert found_repeats(df, size=size, anchor=anchor, group=group, cuts=cuts, most=300) == brute_repeats(rows, size)


def test_repeats_in_and_across_segments(spark, monkeypatch):
    """Texts longer than a segment, cut at other places than their copies."""
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(1300)
    rows = [(1, text(333) + shared + text(40)), (2, shared), (3, text(2000)), (4, text(90) + shared[200:900] + text(700) + shared[600:1000])]
    raws = {}
    for name, array in (("all", [t for _, t in rows]),):
        import pyarrow as pa

        for row, lo, p in suffix_dedup._segments(pa.array(array), 50, 16):
            for r, at, n in zip(row.tolist(), lo.tolist(), p.n.tolist()):
                raws.setdefault(r, []).extend(range(at, at + n))
    # Every window lies in exactly one piece.
    assert {r: sorted(v) for r, v in raws.items()} == {i: list(range(len(t) - 49)) for i, (_, t) in enumerate(rows)}


def test_long_text_and_empty_table(spark):
    assert found_repeats(spark.createDataFrame([], "doc_id BIGINT, text STRING")) == []
    rng = random.Random(4)
    unit = "".join(rng.choice("abcdefghij ") for _ in range(700))
    plain = "".join(rng.choice("abcdefghij ") for _ in range(suffix_dedup.SEGMENT + 500))
    rows = [(1, plain[:-300] + unit + plain[-300:]), (2, "x" + unit[:450])]
    got = {r[0]: r[1:4] for r in found_repeats(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))}
    assert got == {1: (len(plain) + 700, 450, 1), 2: (451, 450, 1)}


def test_query_of_repeats_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 200)]
    got = [tuple(r) for r in queries.op12_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got) == sorted(want) and any(r[2] for r in got)


# -- centroid clustering -----------------------------------------------------------------

VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>"


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.clip(np.floor(np.float64(np.float32(x)) * 1024), -(1 << 27), 1 << 27)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes())
    middle = [v for _, v in sorted(kept, key=mark)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(middle)), key=lambda j: (far(v, middle[j]), j))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)].append(v)
        middle = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if groups[j] else middle[j] for j in range(len(middle))]
    rows = [(i, nearest(v), v) for i, v in kept]
    own = Counter()
    for _, j, v in rows:
        own[j] += far(v, middle[j])
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, j, far(v, middle[j]), own[j], sum(own.values()), digest[j]) for i, j, v in rows), key=str)


def found_clusters(df, **options):
    return sorted((tuple(r) for r in centroids.centroid_clusters(df, **options).collect()), key=str)


@pytest.mark.parametrize("rewrite", [0.0, 0.1, 1.0])
def test_clusters_equal_brute_force(spark, rewrite):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) + rng.integers(0, 3, 4)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (7, [1.0, 2.0, 3.0, 4.0]), (8, None), (9, [1.0]), (10, [1.0, None, 0.0, 0.0]), (11, [float("nan")] * 4), (12, [float("inf"), 0.0, 0.0, 0.0]), (13, [])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("vec", F.lit("clash")).withColumn("cluster", F.lit(1))
    assert found_clusters(df, dims=4, rewrite=rewrite) == brute_clusters(rows, 8, 10, 4)


def test_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(20)]
    assert found_clusters(spark.createDataFrame(rows, VECTORS), dims=2) == brute_clusters(rows, 8, 10, 2)
    assert found_clusters(spark.createDataFrame(rows[:3], VECTORS), dims=2) == brute_clusters(rows[:3], 8, 10, 2)
    assert found_clusters(spark.createDataFrame([], VECTORS)) == []
    # Far beyond 32 bits: taken as 2^27, so that distances fit a long.
    huge = [(i, [(-1.0) ** i * 10.0 ** (i + 30), 0.0]) for i in range(6)]
    assert found_clusters(spark.createDataFrame(huge, VECTORS), dims=2) == brute_clusters(huge, 8, 10, 2)


def test_bounds_spare_most_vectors(spark):
    """Stored distances are loosened by the whole way of a centroid, and what fails is measured again."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(8, 16)) * 20
    rows = [(i, (middles[i % 8] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1600)]
    _, history, looked = centroids.clustered(spark.createDataFrame(rows, VECTORS), dims=16)
    assert len(history) == 11 and looked[0] == 1600 and sum(looked[1:]) < 0.5 * 9 * 1600
    there = [np.array([[0, 0], [10, 0]]), np.array([[3, 0], [10, 0]]), np.array([[0, 1], [10, 0]])]
    # Steps of 3 and 3.2 that end 1 away from the start: only that counts.
    far, cluster, taken = np.array([[16, 36]]), np.array([0]), np.array([0])
    assert not centroids.unsure(cluster, np.array([[4, 64]]), taken, there)[0]
    assert centroids.unsure(cluster, np.array([[25, 25]]), taken, there)[0] and not centroids.unsure(cluster, far, taken, there[::2])[0]
