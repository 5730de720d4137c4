"""Corpus operators against plain Python, and the expectations of FIXTURES.md."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import audit, catalog, infer, parallel, restore, scoring, split, stats, tokens


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def corpus(spark, texts):
    return spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")


def test_summary_and_lengths(spark):
    df = corpus(spark, ["a b c", "a b c", "é x", "q w e r t"])
    s = stats.summary(df, "lang").first()
    assert (s.sentences, s.unique_sentences, s.tokens, s.vocabulary, s.hapax_words, s.sentences_with_diacritics) == (4, 3, 13, 10, 6 - 1 + 2, 1)
    assert s.vocabulary_without_diacritics == 9
    n = stats.lengths(df).first()
    assert (n["mean"], n["median"], n.p10, n.p90, n["max"]) == (3.25, 3.0, 2, 5, 5.0)
    assert stats.lengths(df.where("false")).first()["mean"] == 0.0
    v = stats.validate(spark.createDataFrame([("a",), ("b",), ("a",), ("",)], "text string")).first()
    assert (v.total, v.duplicates, v.empty) == (4, 1, 1)


def test_top_words_keep_first_seen_order(spark):
    df = corpus(spark, ["b a b", "c a c", "d"])
    got = [(r.word, r.n) for r in stats.top(stats.word_counts(stats.tokens(df, "doc_id")), 3).collect()]
    assert got == collections.Counter("b a b c a c d".split()).most_common(3)


def test_nearest_rank(spark):
    draw = random.Random(1)
    for n in (1, 2, 9, 16):
        xs = sorted(draw.randrange(5) for _ in range(n))
        counts = spark.createDataFrame([("g", k, m) for k, m in collections.Counter(xs).items()], "g string, v int, n long")
        got = stats.nearest_rank(counts, ["g"], "v", "n", {"p": 0.1, "q": 0.5, "r": 0.9}).first()
        assert [got.p, got.q, got.r] == [xs[round(q * (n - 1))] for q in (0.1, 0.5, 0.9)]


def test_rates(spark):
    pairs = [("a b c", "a x c"), ("abc", "axc"), ("", ""), ("", "x"), ("d e", "d e"), ("é b " * 30, "b é " * 29)]
    df = spark.createDataFrame(pairs, "ref string, hyp string")
    got = {(r.ref, r.hyp): (r.wer, r.cer) for r in scoring.pair_rates(df).collect()}
    rate = lambda a, b: (0.0 if not b else 1.0) if not a else edits(a, b) / len(a)
    assert got == {(a, b): (rate(a.split(), b.split()), rate(a, b)) for a, b in pairs}
    five = spark.createDataFrame([("a b c", "a x c"), ("d e", "d e")], "ref string, hyp string")
    assert scoring.corpus_rates(five).first().wer == 1 / 5
    assert scoring.corpus_rates(spark.createDataFrame([("ab", "ab"), ("cd", "cx")], "ref string, hyp string")).first().cer == 0.25
    assert scoring.corpus_rates(spark.createDataFrame([("", "x")], "ref string, hyp string")).first().wer == 0.0


def test_score_levels(spark):
    df = spark.createDataFrame([("Solēmi, pōraati", "solemi poraati")], "ref string, hyp string")
    got = {r.level: r for r in scoring.score_levels(df).collect()}
    assert got["strict"].wer == 1.0 and got["diacritic_blind"].wer == 0.0 and got["strict"].cer > got["normalized"].cer > 0


def test_word_edits_beyond_the_surrogates(spark):
    many = [f"w{i}" for i in range(40_000)]
    df = spark.createDataFrame([(many[-3:], many[-2:])], "r array<string>, h array<string>")
    assert df.select(scoring.word_edits("r", "h")).first()[0] == 1


def test_paired(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "sid long, text string")
    with pytest.raises(ValueError):
        scoring.paired(a, a.where("sid = 0"))
    assert scoring.paired(a, a).count() == 2


def test_translation_scores(spark):
    same = spark.createDataFrame([("1", "the cat sat on the mat", "the cat sat on the mat", ["x", "the cat sat on the mat"])], "id string, hyp string, ref string, refs array<string>")
    assert abs(scoring.chrf(same).first()[0] - 100) < 1e-9 and abs(scoring.bleu(same).first()[0] - 100) < 1e-9
    half = spark.createDataFrame([("1", "a b c d e", "a b c d f", ["a b c d f"])], "id string, hyp string, ref string, refs array<string>")
    want = 100 * (4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25
    assert abs(scoring.bleu(half).first()[0] - want) < 1e-9


def test_chrf_takes_the_best_of_several_references(spark):
    kinds = "id string, hyp string, refs array<string>"
    first, second, far = "the cat sat on the mat", "a dog lay under that table", "nothing alike here, is there"
    rows = [("1", second, [first, second]), ("2", first, [first, far]), ("3", "the dog sat under a mat", [far, None, "the dog sat under the mat"]), ("4", "words", ["", "wordy"])]
    best = [("1", second, second), ("2", first, first), ("3", "the dog sat under a mat", "the dog sat under the mat"), ("4", "words", "wordy")]
    got = scoring.chrf(spark.createDataFrame(rows, kinds)).first()[0]
    assert abs(got - scoring.chrf(spark.createDataFrame(best, "id string, hyp string, ref string")).first()[0]) < 1e-9
    by = {r.g: r.chrf for r in scoring.chrf(spark.createDataFrame(rows, kinds).withColumn("g", F.col("id") < "3"), "g").collect()}
    assert abs(by[True] - 100) < 1e-9 > by[False] - 100
    sets = {"bible": spark.createDataFrame([("1", second, [first, second]), ("2", first, [first, second])], "id string, src string, refs array<string>")}
    row = infer.evaluate_systems(sets, {"copy": lambda: lambda texts: texts}).first()
    assert row.n == 2 and abs(row.chrf - 100) < 1e-9 and abs(row.bleu - 100) < 1e-9


def components(items):
    low = {i: i for i, *_ in items}
    changed = True
    while changed:
        changed = False
        for a, *ka in items:
            for b, *kb in items:
                if low[a] > low[b] and any(x == y and x is not None for x, y in zip(ka, kb, strict=True)):
                    low[a], changed = low[b], True
    rank = {r: n for n, r in enumerate(sorted(set(low.values())))}
    return {i: rank[r] for i, r in low.items()}


def test_linked_groups(spark):
    fixed = [(0, "spk1", "a"), (1, "spk2", "a"), (2, "spk2", "b"), (3, "spk3", "c")]
    draw = random.Random(3)
    drawn = [(i, str(draw.randrange(30)), draw.choice([None, *map(str, range(25))])) for i in range(60)]
    chain = [(i, f"k{i // 2}", f"l{(i + 1) // 2}") for i in range(40)]
    for items in (fixed, drawn, chain):
        df = spark.createDataFrame(items, "item long, a string, b string")
        assert dict(split.linked_groups(df, "item", ["a", "b"]).collect()) == components(items)


def test_disjoint_split(spark):
    draw = random.Random(5)
    groups = [(i, draw.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(groups, "item long, grp long")
    for shuffle in ("hash", "python"):
        got = {r.item: r.split for r in split.disjoint_split(df, {"test": 0.1, "validation": 0.2}, shuffle=shuffle).collect()}
        assert len(got) == 300 and abs(sum(s == "test" for s in got.values()) - 30) <= 15
        sides = collections.defaultdict(set)
        for i, g in groups:
            sides[g].add(got[i])
        assert all(len(s) == 1 for s in sides.values())
    sizes = collections.Counter(g for _, g in groups)
    from hashlib import md5

    order = sorted(sizes, key=lambda g: (md5(f"42:{g}".encode()).hexdigest(), g))
    want = split.fill_splits([(g, sizes[g]) for g in order], {"test": 0.1, "validation": 0.2})
    got = {r.item: r.split for r in split.disjoint_split(df, {"test": 0.1, "validation": 0.2}).collect()}
    assert got == {i: want[g] for i, g in groups}
    for bad in ({"test": 0.0}, {"test": 0.6, "dev": 0.5}, {"train": 0.1}):
        with pytest.raises(ValueError):
            split.fill_splits([], bad)


def test_splits_and_leakage(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "key long, text string")
    done = split.train_test_split(df, "key")
    row = split.validate_split(done).first()
    assert (row.train, row.test, row.overlap, row.leak_free) == (90, 10, 0, True)
    assert split.permutation_split(100).count("test") == 10
    leak = spark.createDataFrame(list(zip("xxyz", ["train", "test", "test", "test"], strict=True)), "k string, split string")
    got = split.split_leakage(leak, "k").first()
    assert (got["items"], got.leaked_items, got.leaked_share) == (3, 1, 1 / 3)
    with pytest.raises(ValueError):
        split.train_test_split(df, "key", 1.5)


def test_restorer(spark):
    train = corpus(spark, ["solēmi pōraati.", "Pōraati solēmi solemi", "plain words only", "solēmi solēmi dimlū"])
    pairs = restore.plain_pairs(train)
    w, b, c = restore.fit_words(pairs), restore.fit_bigrams(pairs), restore.fit_chars(pairs)
    assert {(r.key, r.form): r.n for r in w.collect()}[("solemi", "solēmi")] == 4
    assert not w.where("key = 'plain'").count()
    text = spark.createDataFrame([(0, "Solemi, PORAATI! «solemi» 12  x-poraati"), (1, ""), (2, "!?")], "sid long, text string")
    got = dict(restore.restore(text, w, b, c).collect())
    assert got == {0: "Solēmi, PŌRAATI! «solēmi» 12  x-pōraati", 1: "", 2: "!?"}
    seen = restore.evaluate(corpus(spark, ["pōraati solēmi dimlū"]), w, b, c).first()
    assert (seen.words, seen.word_accuracy, seen.marked_words, seen.unseen_words) == (3, 1.0, 3, 0)
    new = restore.restore_unseen(spark.createDataFrame([("solema",), ("xyz",), ("pora",)], "plain string"), c)
    made = dict(new.collect())
    assert made["xyz"] == "xyz" and made["pora"][:2] == "kū" and made["solema"].startswith("solē")


def test_model_files(spark, tmp_path):
    from corpuslens.sources import writers

    pairs = restore.plain_pairs(corpus(spark, ["solēmi pōraati solemi"]))
    parts = restore.fit_words(pairs), restore.fit_bigrams(pairs), restore.fit_chars(pairs)
    writers.save_model(f"{tmp_path}/m", *parts)
    back = writers.load_model(spark, f"{tmp_path}/m")
    assert all(a.count() == b.count() for a, b in zip(parts, back, strict=True))
    small = writers.model_from_json(spark, writers.model_json(*parts))
    assert {tuple(r) for r in small[0].select("key", "form", "n").collect()} == {tuple(r) for r in parts[0].select("key", "form", "n").collect()}
    with pytest.raises(ValueError):
        writers.model_from_json(spark, '{"format": 9}')


def test_web_audit(spark):
    docs = spark.createDataFrame([(1, "s", "one two three four five six seven. uno dos tres."), (2, "s", "a b"), (3, "s", "uno dos tres cuatro. one two three.")], "doc_id long, source string, text string")
    ref = spark.createDataFrame([("One two three four five six seven!",)], "text string")
    label = F.when(F.col("sentence").contains("uno"), "other").otherwise("target")
    r = audit.web_audit(docs, ref, label, "target", ["target", "other"]).first()
    assert (r.documents, r.sentences, r.words, r.docs_target, r.docs_other) == (3, 4, 17, 1, 1)
    assert abs(r.share_target - 10 / 17) < 1e-9 and abs(r.overlap_share - 7 / 10) < 1e-9


def test_sections_and_pairs(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["intro", "Art 1", "a", "b", "Art 2", "Art 1", "c"])], "doc int, line int, text string")
    number = F.when(F.col("text").startswith("Art"), F.regexp_extract("text", r"(\d+)", 1).cast("int"))
    assert [(r.section, r.body) for r in parallel.sections(lines, number).collect()] == [(1, "a b c")]
    texts = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z")], "section int, lang string, body string")
    assert [tuple(r) for r in parallel.aligned(texts, ["a", "b"]).collect()] == [(1, "x", "y")]


def test_token_tax(spark):
    df = spark.createDataFrame([("x", "aaa bbb"), ("en", "e f")], "lang string, text string")
    got = {r.lang: r.tax for r in tokens.token_tax(df, {"c": lambda x: F.length(F.replace(x, F.lit(" "), F.lit("")))}, "en").collect()}
    assert got == {"x": 3.0, "en": 1.0}
    udf = tokens.counter(len)
    assert tokens.fertility(df, udf).first().pieces == 10


def test_tokenizer_experiment(spark, tmp_path):
    docs = corpus(spark, [f"solēmi pōraati mot{i % 7} {'ab' * (i % 5)} nāmba {i % 11}" for i in range(200)])
    got = tokens.tokenizer_experiment(docs, "doc_id", str(tmp_path), vocab_size=60)
    assert sorted(r.variant for r in got.collect()) == ["with diacritics", "without diacritics"]


class Model:
    """Fails on batches of more than two items and counts what it is given."""

    def __call__(self):
        def call(items):
            if len(items) > 2:
                raise RuntimeError("CUDA out of memory")
            return [f"{len(x)}" for x in items]

        return call


def test_backoff():
    sizes = []

    def run(items):
        sizes.append(len(items))
        if len(items) > 2:
            raise MemoryError
        return items

    assert infer.with_backoff(list(range(10)), run, 8) == (list(range(10)), 2)
    assert sizes == [8, 4, 2, 2, 2, 2, 2]
    with pytest.raises(ZeroDivisionError):
        infer.with_backoff([1], lambda x: 1 / 0, 1)


def test_inference(spark):
    clips = spark.createDataFrame([(str(i), [0.0] * n, 1, "t") for i, n in enumerate((5, 35, 7, 41, 3))], "id string, waveform array<float>, sample_rate int, text string")
    got = {r.id: r.hyp for r in infer.transcribe(clips, Model()).collect()}
    assert got == {"0": "5", "1": "35", "2": "7", "4": "3"}
    said = infer.translate(spark.createDataFrame([("ab",), (" ",), (None,)], "text string"), Model()).collect()
    assert sorted(r.hyp for r in said) == ["", "", "2"]
    with pytest.raises(ValueError):
        infer.evaluate_systems({}, {})
    heard = spark.createDataFrame([([[1.0, 3.0], [3.0, 5.0]], 8000)], "channels array<array<float>>, rate int")
    assert heard.select(infer.mono().alias("m")).first().m == [2.0, 4.0]
    assert heard.select(infer.to_16k("channels", "rate").alias("w")).first().w[:3] == [2.0, 3.0, 4.0]


def test_language_predictor(spark):
    from corpuslens.operators import lid

    docs = spark.createDataFrame([("en", "the cat and the dog with the hat"), ("fr", "le chat et le chien avec le chapeau")] * 3, "lang string, text string")
    predict = lid.predictor(lid.train(docs))
    got = spark.createDataFrame([("the dog and the cat",), ("le chien et le chat",)], "text string").select(predict("text").alias("p")).collect()
    assert [r.p.label for r in got] == ["en", "fr"]


def test_planner(spark):
    from corpuslens.plans.table_queries import _sources

    sources = _sources(spark)
    with pytest.raises(ValueError):
        catalog.plan(sources, only=["nowhere"])
    steps = {r.source_id: r for r in catalog.plan(sources).collect()}
    assert steps["voices"].reason == "text" and steps["clips"].reason.startswith("transcripts") and steps["web"].approx_bytes == 3_400_000
    failed = catalog.download(catalog.plan(sources), lambda s: 1 / 0 if s["source_id"] == "web" else None)
    assert [f[0] for f in failed] == ["web"]
