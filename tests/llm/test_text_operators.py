"""Operators on single texts: against plain Python, the library, and edge cases."""

import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from casework.llm import language_id, line_dedup, mixing, pieces, quality_rules, queries, sentencepiece_codec, token_counts, words, work
from compare import DATA

SF = f"{DATA}/sf0.001"
ODD = [None, "", " \n\t ", "one", "a b", "Ab aB  ab\tAB", "日本 ▁x <s>", "é" * 300 + " x", "\t\n\r\x00é́😀 zz", "a" * 5000, "x y z w v " * 400, " " * 60 + "x" + " " * 33]
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def frame(spark, texts, schema="doc_id LONG, text STRING"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


@pytest.mark.parametrize("most", [10, 1 << 20])
def test_words_and_shingles(monkeypatch, most):
    monkeypatch.setattr(words, "PIECE", 64)
    words._piece_powers.cache_clear()
    random.seed(1)
    texts = ODD + [" ".join(random.choices("ab cd EF é .".split(), k=random.randint(0, 30))) for _ in range(100)]
    known, back = {}, {}
    for i, block in words.blocks(pa.array(texts), most):
        hashes, (runs, at) = block.hashes(), block.shingles(5)
        for k in range(len(block)):
            own = (texts[i + k] or "").encode().translate(LOWER).split()
            sets = [tuple(own[j : j + 5]) for j in range(len(own) - 4)] if len(own) > 4 else [tuple(own)] * bool(own)
            for wanted, found in ((own, hashes[block.first[k] : block.first[k + 1]]), (sets, runs[at[k] : at[k + 1]])):
                assert len(wanted) == len(found)
                for x, y in zip(wanted, found.tolist()):
                    assert known.setdefault(x, y) == y and back.setdefault(y, x) == x
    words._piece_powers.cache_clear()


def models():
    model = pieces.read_model(f"/opt/tokenizers/{queries.MODEL}")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    # The same pieces as a unigram model, with scores that sums of 32-bit floats hold exactly.
    proto.trainer_spec.model_type = pieces.UNIGRAM
    for p in proto.pieces:
        p.score = max(p.score, -32000.0)
    return {"bpe": model, "unigram": proto.SerializeToString()}


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_pieces_are_those_of_the_library(spark, kind):
    model = models()[kind]
    library = SentencePieceProcessor(model_proto=model)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ODD
    rows = sentencepiece_codec.round_trip(frame(spark, texts), model).collect()
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, texts), model).collect()}
    for r in rows:
        if r.text is None:
            assert r.ids is None and r.decoded is None and counts[r.doc_id] == 0
            continue
        ids = library.encode(r.text)
        if kind == "bpe":
            assert r.ids == ids
        else:
            assert sum(map(library.get_score, r.ids)) >= sum(map(library.get_score, ids)) - 1e-3
        assert r.round_trip and r.decoded == r.text.replace("▁", " ") and counts[r.doc_id] == len(r.ids)


def test_codec_keeps_columns_and_empty_tables(spark):
    model = models()["bpe"]
    rows = spark.createDataFrame([(1, "a b", "x", 3), (1, "a b", "x", 3)], "doc_id LONG, text STRING, ids STRING, score INT")
    found = sentencepiece_codec.encode(rows, model)
    assert found.columns == ["doc_id", "text", "score", "ids"] and found.count() == 2
    assert sentencepiece_codec.round_trip(rows.limit(0), model).count() == 0
    assert token_counts.token_counts(rows.limit(0), model).count() == 0


def test_encoder_remembers_ids_without_much_around_them(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 40)
    model = pieces.pieces_of(models()["bpe"])
    encoder = sentencepiece_codec.Encoder(model)
    texts = [f"the w{i} thousand {i} then Zürich" for i in range(100)] * 2
    for text in texts:
        assert "".join(model.texts[i] for i in encoder.encode(text)) == model.escaped(text)
    held = [*encoder.known.values(), *encoder.older.values()]
    assert 20 <= len(held) <= 40 and all(sys.getsizeof(ids) <= 33 + 4 * 10 for ids in held)


def test_codec_gives_texts_back_some_at_a_time(spark, monkeypatch):
    texts = [f"text {i}" for i in range(950)] + [None]
    passed = []
    monkeypatch.setattr(sentencepiece_codec, "_lists", lambda rows, lists=sentencepiece_codec._lists: passed.append(len(rows)) or lists(rows))
    docs, whole = frame(spark, texts), pa.RecordBatch.from_pydict({"doc_id": range(951), "text": texts})
    # The function that a task runs, on one batch.
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: list(run(iter([whole]))))
    found = sentencepiece_codec._added(docs, "ids", "array<int>", "text", lambda part, state: sentencepiece_codec._lists([None if t is None else [1] for t in part.to_pylist()]))
    assert sum(passed) == 951 and max(passed) <= 200
    assert pa.Table.from_batches(found).column("text").to_pylist() == texts


def test_small_tables_need_no_python_workers(spark):
    rows = work.small(spark, lang=pa.array(["x", None], pa.string()), least=pa.array([1, 2], pa.int64()))
    assert rows.dtypes == [("lang", "string"), ("least", "bigint")] and [tuple(r) for r in rows.collect()] == [("x", 1), (None, 2)]
    assert work.small(spark, at=pa.array([], pa.int32())).collect() == []
    sources = spark.createDataFrame([("a", 5), (None, 1), ("b", 7)], "source STRING, source_size BIGINT").localCheckpoint()
    # Rows of the driver that went through Python workers would be a second scan of an RDD, beside that of the table itself.
    numbered = mixing._numbered(sources)
    assert "LogicalRDD [range" not in numbered._jdf.queryExecution().toString()
    assert {r.source: r.place for r in numbered.collect()} == {"a": 0, "b": 1, None: 2}
    rows = spark.createDataFrame([("aa", "un deux"), ("bb", "one two")], "lang STRING, text STRING")
    asked = []
    spark_type, make = type(spark), type(spark).createDataFrame
    try:
        spark_type.createDataFrame = lambda self, data, *a, **b: asked.append(type(data)) or make(self, data, *a, **b)
        assert language_id.train(rows).langs == ["aa", "bb"]
        assert language_id.train(rows.limit(0)).langs == []
    finally:
        spark_type.createDataFrame = make
    assert asked and set(asked) == {pa.Table}


def test_trie_starts_anew_and_counts_the_same():
    model = pieces.pieces_of(models()["bpe"])
    small, large = token_counts.Trie(model, 50), token_counts.Trie(model)
    for w in "▁the ▁there ▁then ▁thousand x abc ▁Zürich ▁the".split():
        assert small.tokens(w) == large.tokens(w) == len(model.merged(w))


def test_trie_reaches_a_prefix_once_and_keeps_what_is_met_often(monkeypatch):
    reached, reach = [], token_counts.Trie._reach
    monkeypatch.setattr(token_counts.Trie, "_reach", lambda self, *a: reached.append(1) or reach(self, *a))
    model = pieces.pieces_of(models()["bpe"])
    trie, often = token_counts.Trie(model, 40), "▁the ▁there ▁Zürich ▁日本".split()
    for i in range(100):
        for w in often:
            assert trie.tokens(w) == len(model.merged(w))
            # However many rare ones came between.
            assert i == 0 or not reached
        assert trie.tokens(f"▁r{i}") == len(model.merged(f"▁r{i}"))
        reached.clear()

    random.seed(5)
    texts = [["▁" + "".join(random.choices("abné", k=random.randint(1, 9))) for _ in range(random.randint(0, 60))] for _ in range(80)]
    for most, together in ((1 << 19, 1 << 21), (30, 1 << 21), (1 << 19, 7)):
        monkeypatch.setattr(token_counts, "TOGETHER", together)
        reached.clear()
        every, tokens = token_counts.Trie(model, most).sums(texts)
        assert every.tolist() == list(map(len, texts)) and tokens.tolist() == [sum(len(model.merged(w)) for w in t) for t in texts]
        if most > 30 and together > 7:
            assert len(reached) == len({w[:k] for t in texts for w in t for k in range(1, len(w) + 1)})


def test_repeats_against_brute_force():
    random.seed(3)
    for trial in range(150):
        docs = [[random.randint(0, random.choice([1, 2, 5])) for _ in range(random.randint(0, 40))] for _ in range(random.randint(1, 5))]
        docs += [docs[0] * 2] * (trial % 7 == 0)
        found = quality_rules.repeats(np.array(sum(docs, []), np.uint64), np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
        wanted = []
        for d in docs:
            for i in range(len(d)):
                ends = [next((k for k in range(len(d)) if max(i, j) + k >= len(d) or d[i + k] != d[j + k]), 0) for j in range(len(d)) if j != i]
                wanted.append(max(ends, default=0))
        assert found.tolist() == wanted


def test_quality_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(70))
    texts = ODD + [" ".join(f"v{i}" for i in range(2000)) + f" {long} and {long}", "good " + long + "\n#tag a\n\n#tag a"]
    rows = {r.doc_id: r for r in quality_rules.quality(frame(spark, texts)).collect()}
    assert rows[0].n_words == 0 and rows[0].base_failed and not rows[0].kept
    assert rows[10].n_repeat_words == 2000 and rows[10].base_failed
    # Under the base limit, but one passage is too long.
    assert not rows[12].base_failed and rows[12].longest_repeat == 70 and not rows[12].kept
    assert rows[13].kept and rows[13].n_symbols == 2 and rows[13].n_dup_lines == 1
    assert quality_rules.quality(frame(spark, []).selectExpr("*", "text AS kept", "1 AS n_words")).count() == 0


def brute_language(model, text):
    total, n = model.prior.copy(), 0
    for w, c in Counter(text.lower().split()).items():
        if language_id.strip(w):
            total, n = total + c * model.word(language_id.strip(w)), n + c
    return model.langs[int(np.argmax(np.round(total, 6)))]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, found = language_id.learn_and_predict(docs)
    rows = found.collect()
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(test) > 20 and sum(r.lang == r.lang_pred for r in test) >= 0.95 * len(test)
    assert all(r.lang_pred == brute_language(model, r.text) for r in rows)
    marked = queries.op2_language_id(spark, SF).collect()
    assert {r.doc_id for r in marked if r.held_out} == {r.doc_id for r in test}
    assert all(0 <= r.score <= 1 for r in marked)


def test_language_edge_cases(spark):
    rows = [(i, t, "en" if i % 2 else None, 1.0) for i, t in enumerate(ODD)] + [(None, "the and of", "en", 2.0)] * 2
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, score DOUBLE")
    _, found = language_id.learn_and_predict(docs)
    got = [(r.text, r.lang_pred) for r in found.collect()]
    assert len(got) == len(rows)
    for text, lang in got:
        assert (lang == "und") == (not text or not any(map(str.isalpha, text)))
    nothing = docs.withColumn("lang", docs.text.substr(0, 0)).filter("false")
    assert language_id.learn_and_predict(nothing)[1].count() == 0
    _, found = language_id.learn_and_predict(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert {r.lang_pred for r in found.collect()} == {"und"}
    assert language_id.identified(docs).columns == docs.columns


def test_scorer_forgets_but_scores_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, _ = language_id.learn_and_predict(docs)
    small, large = language_id.Scorer(model, 16), language_id.Scorer(model)
    for r in docs.limit(40).collect():
        assert small(r.text)[0] == large(r.text)[0] and abs(small(r.text)[1] - large(r.text)[1]) < 1e-6


def test_shared_lines(spark):
    rows = []
    for i in range(40):
        site = f"s{i % 8}" if i % 9 else None
        lines = [f"own {i}", "", "all  sites", "four sites" if i % 8 < 4 else "x%d" % i, "five sites" if i % 8 < 5 else "", "all sites "]
        rows.append((i, "\n".join(lines), site, "c"))
    rows += [(40, None, "s1", "c"), (41, "all sites", "s1", "c"), (41, "all sites", "s1", "c"), (None, "new\nall sites", None, "c")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING, n_lines STRING")
    found = line_dedup.without_shared_lines(docs)
    assert found.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    got = sorted(map(str, ((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect())))

    def cleaned(text):
        if text is None:
            return None, 0, 0
        lines = text.split("\n")
        kept = [x for x in lines if " ".join(x.split()) not in ("all sites", "five sites")]
        return "\n".join(kept), len(lines), len(lines) - len(kept)

    assert got == sorted(map(str, ((r[0], *cleaned(r[1])) for r in rows)))
    assert line_dedup.without_shared_lines(docs.limit(0)).count() == 0


def test_line_keys_are_made_once(spark, monkeypatch):
    # Digests of all lines are most of the time: one table holds them, and no other plan makes them again.
    plans = []
    monkeypatch.setattr(line_dedup, "stored", lambda rows, name: plans.append(rows) or work.stored(rows, name))
    rows = [(i, f" shared\t \x0bline\n\n shared line \nown {i}\nown {i}" if i % 2 else "shared line", f"s{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    found = line_dedup.without_shared_lines(docs)
    made = [p._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") for p in [*plans, found]]
    assert sum(made) == 1
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect()}
    assert got == {(i, f"\nown {i}\nown {i}", 5, 2) if i % 2 else (i, "", 1, 1) for i in range(12)}
    # A line has the same key alone and in a text.
    t = spark.createDataFrame([(" a \t b ",), ("a b",)], "t STRING")
    keys = t.select(line_dedup.line_key(t.t), line_dedup._line_keys(t.t)[0]).collect()
    assert len({bytes(x) for r in keys for x in r}) == 1


def test_words_are_looked_at_whole(spark):
    # No spaces: what tells the languages apart begins after the 64th character.
    same = "".join(chr(0x4E00 + i) for i in range(80))
    own = {x: "".join(chr(0x5000 + 300 * k + i % 200) for i in range(300)) for k, x in enumerate(("zh", "ja"))}
    rows = [(x, f"{same}{t}") for x, t in own.items()]
    model = language_id.train(spark.createDataFrame(rows, "lang STRING, text STRING"))
    # Learned whole: each word, and each n-gram as often as plain Python counts it.
    scorer = language_id.Scorer(model, 16)
    for x, text in rows:
        assert language_id.key(text) in model.words
        grams = {f"<{text}>"[i : i + n] for n in range(1, 5) for i in range(len(text) + 3 - n)}
        assert grams <= set(model.grams)
        # Unseen words that begin alike and end in one language.
        assert scorer(f"{same}{own[x][5:150]}")[0] == scorer(f"{same * 3}{own[x][40:]}")[0] == x
    counts = Counter(g for _, t in rows for g in (f"<{t}>"[i : i + 4] for i in range(len(t) - 1)))
    half = {x: np.log(0.5 / (len(t) - 1 + 1)) for x, t in rows}
    for x, text in rows:
        g = text[200:204]
        other = next(y for y in own if y != x)
        total = counts[g] + 0.5
        wanted = (np.log(total / (len(text) - 1 + 1)) - half[other]) / 2
        assert abs(model.gram_scores[model.grams[g]][model.langs.index(x)] - wanted) < 1e-9


def test_shares_are_those_of_all_labelled_rows(spark):
    texts = {"en": "the house and the garden", "fr": "la maison et le jardin", "de": "das haus und der garten"}
    rows = [(k, texts[x], x) for k, x in enumerate(["en"] * 240 + ["fr"] * 120 + ["de"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    learned = Counter(x for k, _, x in rows if zlib.crc32(str(k).encode()) % 4 != 2)
    model, _ = language_id.learn_and_predict(docs, sample=20)
    assert model.langs == ["en", "fr", "de"]
    assert np.allclose(np.exp(model.prior), [learned[x] / sum(learned.values()) for x in model.langs])
    # A text without evidence is dropped, whatever the sample and the shares are; one with evidence stays.
    more = docs.unionByName(spark.createDataFrame([(1000, "ψωξ", None), (1001, "haus", None), (1002, "la", None)], docs.schema))
    for sample in (20, 4000):
        kept = {r.doc_id for r in language_id.identified(more, sample=sample).collect()}
        assert kept == {*range(len(rows)), 1001, 1002}
