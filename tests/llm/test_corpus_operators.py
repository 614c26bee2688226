"""Operators across documents: against brute force, and edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.llm import chat_tools, components, exact_dedup, jaccard_join, language_id, mixing, queries, warc_derivatives
from compare import DATA

SF = f"{DATA}/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.mark.parametrize("least", [1, 32])
def test_exact_copies(spark, least):
    rows = [(1, "a b", "x"), (1, "a\t b", "x"), (None, "a  b", "y"), (None, "q", None), (2, None, None), (3, "", None), (1, "zz", "k")]
    rows += [(0, "zz", "k")] * 2 + [(i, "many", None) for i in range(100, 150)] + [(7, "w " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, kept STRING")
    found = exact_dedup.copy_groups(docs, least=least).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[ \t-\r]+", " ", r[1] or "")].append(r[0])
    by = defaultdict(list)
    for r in found:
        by[r.text_sha256].append(r)
    assert sorted(map(len, by.values())) == sorted(map(len, groups.values()))
    for g in by.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert sum(r.kept for r in g) == 1 and all(r.group_size == len(g) and r.keep_id == min(ids, default=None) for r in g)
        assert next(r.doc_id for r in g if r.kept) == min(ids, default=None)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id) for r in kept.collect()))) == sorted(map(str, (min([x for x in g if x is not None], default=None) for g in groups.values())))
    assert exact_dedup.copy_groups(docs.limit(0)).count() == exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_components(spark):
    random.seed(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(random.randint(200, 260), random.randint(200, 260)) for _ in range(40)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()}
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {x: found.get(x, x) for x in parent} == {x: root(x) for x in parent}


def shingles(text, size=5):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if None not in (rows[x][0], rows[y][0]) and both and 100 * both >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((root(rows[x][0]), root(rows[y][0])))
                parent[b] = a
    return sorted((str(i), len(s), str(root(i)) if i is not None else "None") for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize("rounds, tile", [(2, 512), (0, 3)])
def test_jaccard_against_brute_force(spark, rounds, tile):
    random.seed(11)
    names = [f"w{i}" for i in range(400)]
    rows = [(None, "a b c d e f"), (5000, "a b c d e f"), (5001, "A b c d e  f"), (5002, None), (5003, ""), (5004, "one two"), (5005, "one two"), (5001, "q r s t u v w x")]
    passage, i = random.choices(names, k=40), 0
    for n in (12, 30, 80, 300, 80, 40):
        base = random.choices(names, k=n)
        for _ in range(random.choice([1, 2, 5, 40])):
            w = list(base)
            for _ in range(random.randint(0, max(1, n // 25))):
                w[random.randrange(n)] = random.choice(names)
            rows.append((i, " ".join(w[: random.randint(n * 3 // 4, n)] if random.random() < 0.3 else w + passage * (random.random() < 0.3))))
            i += 1
    rows += [(i + k, " ".join(passage + random.choices(names, k=random.randint(0, 60)))) for k in range(40)]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumn("component_id", F.lit("clash"))
    found = jaccard_join.jaccard_components(docs, rounds=rounds, tile=tile).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute_components(rows)
    if rounds:
        kept = jaccard_join.near_dedup(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {r.component_id for r in found}
        assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.int64).view(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 200), dtype=np.int64).view(np.uint64)]))
        if len(b):
            both = len(np.intersect1d(a, b))
            links = 100 * both >= 80 * (len(a) + len(b) - both)
            assert not links or jaccard_join.within_bound(len(a), jaccard_join.set_bits(a).tobytes(), len(b), jaccard_join.set_bits(b).tobytes())


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(3 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in rest))
        new = {s for s in rest if level * weight[s] > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= new


def test_mix_meets_its_targets(spark):
    random.seed(4)
    rows = []
    for s, n in [("a", 300), ("b", 40), ("é", 3), (None, 60), ("z", 1), ("", 25), ("c", 0)]:
        rows += [(len(rows), " ".join(["w"] * random.choice([1, 5, 20, 60])), s) for _ in range(n)]
    rows += [(9000, None, "a"), (9001, "", "q"), (5, "same id", "b"), (5, "same id", "b"), (None, "no id", "a"), (9002, "x " * 20_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING").withColumn("target", F.lit("clash"))
    found = mixing.mix(docs, block=16).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = brute_targets(sizes)
    assert len(found) == len(rows) and sum(r.size for r in found) == sum(sizes.values())
    assert {round(r.target, 6) for r in found} == {round(targets[s], 6) for s in sizes}
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[(r.source_size, round(r.target, 6))] += r.taken
    for (size, target), got in taken.items():
        # The landing may miss by half of the largest document.
        assert abs(got - target) <= max(s for r in found if r.source_size == size for s in [r.size]) / 2 + 1, (size, target, got)
    again = mixing.mix(docs.repartition(5), block=16).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    stage = mixing.mixed(docs, block=16)
    assert stage.columns == docs.columns and stage.count() == sum(r.copies for r in found)
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 200):
        size, chance = rng.integers(0, 50, n), np.full(n, 0.3)
        moved = mixing.flight(size, chance, rng.random(n))
        assert ((moved > 0) & (moved < 1)).sum() <= 2
        assert np.allclose([moved.sum(), (moved * size).sum()], [chance.sum(), (chance * size).sum()], atol=1e-5)


SCHEMAS = {"find": {"q": ("string", True), "n": ("integer", False), "o": ("object", False)}, "sum": {"x": ("array", True), "f": ("number", False), "b": ("boolean", False)}}


def test_tool_calls(spark):
    call = "conv_id LONG, turn LONG, call_id STRING, name STRING, arguments STRING, after ARRAY<STRING>"
    calls = [
        (1, 1, "a", "find", '{"q":"x", "n":1}', []),
        (1, 3, "b", "find", '{"n":"many","zz":1}', ["a"]),
        (1, 5, "c", "sum", '{"x":[1,2],"f":1.5,"b":true}', ["a", "b", "gone"]),
        (1, 7, "d", "sum", "[1]", ["e"]),
        (1, 9, "e", "sum", "{broken", ["d"]),
        (1, 11, "f", "other", None, None),
        (2, 1, "a", "find", '{"q":"é\\n\\"","o":{"b":2,"a":null}}', ["a"]),
        (None, 1, "a", "find", '{"q":"x"}', ["a"]),
        (3, 1, None, None, None, [None]),
        (1, 1, "a", "find", '{"q":"x", "n":1}', []),
    ]
    results = [(1, 2, "a", "first"), (1, 4, "a", "second"), (1, 2, "b", "too early"), (9, 1, "a", "lone"), (None, 2, "a", "n"), (1, 6, "c", None)]
    found = chat_tools.calls_and_results(spark.createDataFrame(calls, call), spark.createDataFrame(results, "conv_id LONG, turn LONG, call_id STRING, content STRING"), SCHEMAS)
    rows = sorted(found.collect(), key=str)
    got = {(r.conv_id, r.call_id, r.turn): (r.level, r.result_turn, r.problems, r.json) for r in rows}
    assert len(rows) == 14
    assert got[1, "a", 4][2] == ["extra_result"] and got[1, "b", 2][2] == ["early_result"]
    assert got[1, "a", 1] == (0, 2, [], '{"arguments":{"n":1,"q":"x"},"id":"a","name":"find","result":"first"}')
    assert got[1, "b", 3][:3] == (1, None, ["type:n", "missing:q", "unexpected:zz"])
    assert got[1, "c", 5][:3] == (2, 6, ["unknown_reference"])
    assert got[1, "d", 7][0] is None and got[1, "d", 7][2] == ["not_an_object", "cycle"]
    assert got[1, "e", 9][0] is None and '"arguments"' not in got[1, "e", 9][3]
    assert got[1, "f", 11][2] == ["unknown_tool"]
    assert got[2, "a", 1][2] == ["cycle"] and got[2, "a", 1][3].startswith('{"arguments":{"o":{"a":null,"b":2},"q":"é\\n\\""}')
    assert got[9, "a", 1][2] == ["no_call"] and got[None, "a", 1][1] is None
    empty = chat_tools.calls_and_results(spark.createDataFrame([], call), spark.createDataFrame([], "conv_id LONG, turn LONG, call_id STRING, content STRING"), SCHEMAS)
    assert empty.count() == 0


def test_warc_files(spark, tmp_path):
    html = '<html lang="de"><head><title>A  b</title></head><body><script>x="</p>"</script><p>one &amp; two<br>three <a href="u">l</a></p>\n\n<p>é</p></body>'
    pages = spark.createDataFrame([("http://a/", html, 1), ("http://b/", None, 2), (None, "", 3), ("http://a/", html, 1)], "url STRING, html STRING, block INT")
    records = warc_derivatives.derive(warc_derivatives.responses(pages, "2024-01-01T00:00:00Z"))
    rows = records.collect()
    assert len(rows) == 8 and len({r.record_id for r in rows}) == 6
    text = next(r for r in rows if r.record_type == "conversion" and r.target_uri == "http://a/")
    assert text.block == "one & two\nthree l\né"
    fields = next(r for r in rows if r.record_type == "metadata" and r.target_uri == "http://a/").block
    assert "title: A b\r\nlanguage: de\r\noutlinks: 1" in fields and "httpStatus: 200" in fields
    warc_derivatives.write_warc(records, str(tmp_path / "w"))
    back = warc_derivatives.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r.head, r.block) for r in back) == sorted((r["head"], r.block) for r in rows) and all(r.complete for r in back)
    assert {r.headers["WARC-Refers-To"] for r in back} == {r.refers_to for r in rows}
    odd = spark.createDataFrame([("i", "response", None, None, None, None), ("j", "response", "u", "d", "c", "no end"), ("k", "request", "u", "d", "c", "x")], "record_id STRING, record_type STRING, target_uri STRING, date STRING, content_type STRING, block STRING")
    assert warc_derivatives.derive(odd).count() == 4
    assert warc_derivatives.derive(odd.limit(0)).count() == 0


def test_mix_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    sizes = Counter()
    for d in docs:
        sizes[d.source] += len(d.text.split())
    targets, rows = brute_targets(sizes), {r.doc_id: r for r in queries.op7_source_mixing(spark, SF).collect()}
    for d in docs:
        r = rows[d.doc_id]
        assert r.size == len(d.text.split()) and r.source_size == sizes[d.source] and abs(r.target - targets[d.source]) < 1e-6


def test_warc_source_headers_and_digests(spark):
    http = "HTTP/1.1 301 Moved\r\nServer: x\r\nContent-Type: text/html\r\nLocation: /b\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n  more\r\nContent-Length: 99"
    block = f"{http}\r\n\r\n<p>x"
    schema = "record_id STRING, record_type STRING, target_uri STRING, date STRING, content_type STRING, block STRING, headers MAP<STRING, STRING>"
    own = {"WARC-Payload-Digest": "sha1:AAA", "warc-block-digest": "sha1:BBB", "WARC-IP-Address": "10.0.0.1"}
    rows = [("<i>", "response", "u", "d", "c", block, own), ("<j>", "response", "u", "d", "c", block, None)]
    got = {(r.refers_to, r.record_type): r for r in warc_derivatives.derive(spark.createDataFrame(rows, schema)).collect()}
    for kind in ("metadata", "conversion"):
        assert got["<i>", kind].payload_digest == "sha1:AAA" and "WARC-Source-Block-Digest: sha1:BBB" in got["<i>", kind]["head"]
        assert got["<j>", kind].payload_digest.startswith("sha256:")
    fields = got["<i>", "metadata"].block.split("\r\n")
    for line in ("Server: x", "Content-Type: text/html", "Location: /b", "Set-Cookie: a", "Set-Cookie: b more", "Content-Length: 99"):
        assert f"sourceHttpHeader: {line}" in fields
    assert "sourceWarcHeader: WARC-IP-Address: 10.0.0.1" in fields and "sourcePayloadDigest: sha1:AAA" in fields
    assert "sourceHttpHeader: Content-Length: 99" in got["<j>", "metadata"].block


def test_every_result_is_linked_or_listed(spark):
    call = "conv_id LONG, turn LONG, call_id STRING, name STRING, arguments STRING, after ARRAY<STRING>"
    calls = [(1, t, c, "find", '{"q":"x"}', []) for t, c in ((3, "a"), (3, "a"), (7, "a"), (5, "b"), (4, "c"))]
    results = [(1, 2, "a", "early"), (1, 4, "a", "one"), (1, 5, "a", "extra"), (1, 8, "a", None), (1, 8, "a", None), (1, 4, "b", "early"), (1, 6, "b", "valid")]
    results += [(1, 4, "c", "same turn"), (1, 9, "z", "lone"), (1, 10, "z", "lone"), (None, 1, "a", "n"), (1, 1, None, "n")]
    found = chat_tools.calls_and_results(spark.createDataFrame(calls, call), spark.createDataFrame(results, "conv_id LONG, turn LONG, call_id STRING, content STRING"), SCHEMAS)
    got = sorted((str(r.call_id), r.turn, r.name or "", r.result_turn or 0, " ".join(r.problems)) for r in found.collect())
    wanted = [("a", 3, "find", 4, "")] * 2 + [("a", 7, "find", 8, ""), ("b", 5, "find", 6, ""), ("c", 4, "find", 0, "")]
    wanted += [("a", 2, "", 2, "early_result"), ("a", 5, "", 5, "extra_result"), ("a", 8, "", 8, "extra_result"), ("b", 4, "", 4, "early_result"), ("c", 4, "", 4, "early_result")]
    wanted += [("z", 9, "", 9, "no_call"), ("z", 10, "", 10, "no_call"), ("a", 1, "", 1, "no_call"), ("None", 1, "", 1, "no_call")]
    assert got == sorted(wanted)


def test_warc_text_resolves_all_entities(spark):
    rows = [("it&#8217;s &#x2014; caf&eacute;&nbsp;&ldquo;q&rdquo;", "it\u2019s \u2014 caf\u00e9 \u201cq\u201d"), ("&amp;lt; &nosuch; &", "&lt; &nosuch; &"), ("&#128512;&euro;", "\U0001f600\u20ac")]
    pages = spark.createDataFrame([(str(k), f"<p>{html}</p>") for k, (html, _) in enumerate(rows)], "url STRING, html STRING")
    found = warc_derivatives.derive(warc_derivatives.responses(pages, "d")).filter("record_type = 'conversion'").collect()
    assert {r.target_uri: r.block for r in found} == {str(k): text for k, (_, text) in enumerate(rows)}


def test_warc_text_equals_the_steps_one_by_one(spark):
    """Odd markup; a line separator at the end of a text is no end of its last line."""

    def plain(html):
        name = "p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|blockquote|pre"
        text = re.sub("|".join(rf"<{x}\b.*?</{x}\s*>" for x in ("script", "style", "noscript", "head")) + "|<!--.*?-->", " ", html, flags=re.I | re.S | re.A)
        text = re.sub(rf"</?({name})\b[^>]*>", "\n", re.sub(r"\s+", " ", text, flags=re.A), flags=re.I | re.A)
        text = re.sub(r"<[^>]*>", "", text).replace("&nbsp;", " ").replace("&lt;", "<")
        return re.sub(r"^[ \n]+|[ \n]+\Z", "", re.sub(r" *\n[ \n]*", "\n", text))

    rng = random.Random(8)
    parts = "<div>|</DIV >|<p class='a'>| |  |\n|\r\n|\t|a|bc|<script>x<|</script >|</SCRIPT>|<!--|-->|<|</|<pre|<br/>|>|&nbsp;|&lt;|<head>|</head>|<header>|<style\n|</style>|<b>|</b>|<h2|<h7>|<noscript>|</noscript\n>|\x0b|\u2028|/>".split("|")
    rows = ["a \u2028", "", " \n ", "<p>a <b> b</b> \u2028"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(rows)), "i INT, html STRING")
    got = {r.i: r.text for r in df.select("i", warc_derivatives.plain_text(F.col("html")).alias("text")).collect()}
    assert got == {i: plain(html) for i, html in enumerate(rows)}


def test_every_source_comes_near_its_target(spark):
    """The query over sf0.1, sources of several blocks, and small ones beside one a hundred times larger."""
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "text", "source")
    beside = docs.withColumn("source", F.when(F.col("doc_id") % 101 == 0, "small").otherwise("large"))
    for rows, found in (
        (docs, queries.op7_source_mixing(spark, f"{DATA}/sf0.1")),
        (docs, mixing.mix(docs, block=64)),
        (beside, mixing.mix(beside)),
    ):
        got = found.join(rows.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        assert len(got) in (2, 20) and max(abs(r.taken - r.target) for r in got) <= 60
        assert found.filter("taken > 3 * size OR taken % greatest(size, 1) <> 0").count() == 0


def test_warc_title_and_version(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/1", "<title>a &amp; b&#8217;s &copy;&#10;c</title><p>x")], "page_id LONG, url STRING, html STRING")
    block = warc_derivatives.derive(warc_derivatives.responses(pages, "d")).filter("record_type = 'metadata'").first().block
    assert "title: a & b’s © c\r\n" in block
    assert "sourceHttpHeader: Content-Type: text/html; charset=utf-8\r\n" in block and "sourceHttpHeader: Content-Length: " in block
    # Records of three versions in one file.
    text = "".join(f"WARC/1.{v}\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nab{v}c\r\n\r\n" for v in (0, 1, 0))
    (tmp_path / "old.warc").write_bytes(text.encode())
    back = warc_derivatives.read_warc(spark, str(tmp_path / "old.warc")).collect()
    assert sorted((r["head"][:8], r.block, r.complete) for r in back) == [("WARC/1.0", "ab0c", True), ("WARC/1.0", "ab0c", True), ("WARC/1.1", "ab1c", True)]
    (tmp_path / "none").mkdir()
    assert warc_derivatives.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_item_limits_never_bound_counts(spark):
    """An item that one language chooses keeps its counts in the others, where it is rare."""
    rows = [("en", "the the the the cat sat"), ("en", "the cat a b c d e f"), ("fr", "le le le le le chat the"), ("fr", "le chat g h i j k l")]
    model = language_id.train(spark.createDataFrame(rows, "lang STRING, text STRING"), words=2, grams=3)
    assert set(model.words) == {"the", "cat", "le", "chat"}
    totals, counts = {"en": 14, "fr": 15}, {("the", "en"): 5, ("the", "fr"): 1, ("cat", "en"): 2, ("le", "fr"): 6, ("chat", "fr"): 2}
    for item, at in model.words.items():
        want = [math.log((counts.get((item, x), 0) + 0.5) / (totals[x] + 1)) for x in model.langs]
        assert np.allclose(model.word_scores[at], np.array(want) - np.mean(want))
