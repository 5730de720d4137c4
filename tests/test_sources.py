"""Readers, writers, lexicon tables and the command line."""

import gzip
import hashlib
import json
import random
import zipfile

import pytest

from corpuslens import cli
from corpuslens.operators import lexicon, report
from corpuslens.sources import readers, writers


def texts(df):
    return [tuple(r) for r in df.select("row", "text").orderBy("row").collect()]


def test_formats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "a\\tb"}\n\n{"text": null, "transcript": "c"}\n{"x": 1}\n{"text": " d "}\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('﻿verse_key,local\nX.1,"a, b"\nX.2,\n', encoding="utf-8")
    spark.createDataFrame([(b"x", "p"), (b"y", None)], "audio binary, content string").coalesce(1).write.parquet(f"{tmp_path}/c.parquet")
    get = lambda fmt, name: readers.extract_text(spark, f"{tmp_path}/{name}", {"format": fmt})
    assert texts(get("jsonl", "a.jsonl")) == [(0, "a b"), (1, "c"), (3, "d")]
    assert texts(get("csv", "b.csv")) == [(0, "a, b")]
    assert texts(get("parquet", "c.parquet")) == [(0, "p")]
    assert readers.extract_text(spark, "x", None) is None
    with pytest.raises(KeyError):
        get("xml", "a")
    with pytest.raises(KeyError):
        readers.resolve(spark.createDataFrame([(1,)], "n int"))
    with pytest.raises(ValueError):
        readers.speech(spark, "x", "dev")


def test_corpus_and_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text('text,n\n"a  b",1\n,2\nc,3\n', encoding="utf-8")
    (tmp_path / "t.txt").write_text("a b\r\n\x0cc\n", encoding="utf-8")
    (tmp_path / "q.tsv").write_text('text\tn\n"quoted\t1\n', encoding="utf-8")
    assert [tuple(r) for r in readers.corpus(spark, f"{tmp_path}/s.csv").collect()] == [(0, "a b"), (2, "c")]
    assert [r.text for r in readers.corpus(spark, f"{tmp_path}/s.csv", "other").collect()] == ["text,n", '"a b",1', ",2", "c,3"]
    assert [r.text for r in readers.lines(spark, f"{tmp_path}/t.txt").orderBy("row").collect()] == ["a", "b", "", "c"]
    assert [r.text for r in readers.read_lines(spark, f"{tmp_path}/q.tsv").collect()] == ['"quoted']
    assert [r.text for r in readers.first_column(spark, f"{tmp_path}/s.csv").collect()] == ["a  b", "c"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.txt", "one\r\ntwo\n")
    assert [r.text for r in readers.zip_lines(spark, f"{tmp_path}/z.zip", "m.txt").orderBy("line").collect()] == ["one", "two"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a\tb\n", None)], "x string, y string")
    writers.write_tsv(df.coalesce(1), f"{tmp_path}/o")
    part = next(p for p in (tmp_path / "o").iterdir() if p.suffix == ".csv")
    assert part.read_text(encoding="utf-8") == "x\ty\na b\t\n"
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.tsv").write_text("h\n1\n2\n")
    (tmp_path / "m/b.txt").write_text("1\n2\n")
    got = {r.path: (r.rows, r.lines, r.bytes) for r in writers.manifest(spark, f"{tmp_path}/m").collect()}
    assert got == {"a.tsv": (2, None, 6), "b.txt": (None, 2, 4)}
    (tmp_path / "catalog.json").write_text(json.dumps({"sources": [{"id": "a", "access": {"type": "hf"}}, {"id": "b"}]}))
    assert [r.id for r in readers.catalog(spark, f"{tmp_path}/catalog.json").collect()] == ["a", "b"]
    (tmp_path / "r.json").write_text(json.dumps({"model": "m", "dataset": "d", "clips": 2, "normalized": {"wer": 0.1}}))
    (tmp_path / "r2.json").write_text(json.dumps({"model": "m"}))
    assert readers.result_files(spark, f"{tmp_path}/r*.json").count() == 1


def test_manifest_holds_no_file_whole(spark, tmp_path):
    """Digests and counts are those of the bytes, in one block and in several, and no file's content is read at once."""
    mark, noise = b"\xef\xbb\xbf", random.Random(1).randbytes(20_000)
    held = {"a.tsv": b"h\n1\n2\n", "one.tsv": b"h", "mark.txt": mark, "mark_end.txt": mark + b"\n", "mark_open.txt": mark + b"x\ny", "marks.txt": mark + mark + b"x\n"}
    held |= {"one.txt": b"x", "end.txt": b"\n", "ends.txt": b"a\r\n\nb\r", "long.txt": "ä b\n".encode() * 5000, "noise.txt": noise, "a#%20 ü.txt": b"p\n"}
    held |= {"junk.gz": b"no gzip\n", "lines.txt.gz": gzip.compress(b"a\nb\n"), "junk.zst": b"x", "README": b"line\n" * 5000 + b"last", "noise.bin": noise, "mark.json": mark + noise + b"\n", "wide.json": b"q" * 9000 + b"\nz"}
    (tmp_path / "m/sub folder").mkdir(parents=True)
    for i, (name, data) in enumerate(held.items()):
        (tmp_path / ("m/sub folder" if i % 2 else "m") / name).write_bytes(data)
    ends = {name: data.count(b"\n") for name, data in held.items()}
    want = {n: (hashlib.sha256(d).hexdigest(), len(d), max(ends[n] - 1, 0) if n.endswith(".tsv") else None, ends[n] if n.endswith(".txt") else None) for n, d in held.items()}
    put = {"spark.sql.sources.binaryFile.maxLength": "5", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in [*put, "spark.sql.files.maxPartitionBytes"]}
    try:
        for block in ("100m", "3000", "997"):
            for k, v in (put | {"spark.sql.files.maxPartitionBytes": block}).items():
                spark.conf.set(k, v)
            rows = writers.manifest(spark, f"{tmp_path}/m").collect()
            assert len(rows) == len(want) and {r.path: (r.sha256, r.bytes, r.rows, r.lines) for r in rows} == want
        assert not writers.manifest(spark, f"{tmp_path}/m", "*.none").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_manifest_of_long_lines(spark, tmp_path, monkeypatch):
    """Files with lines beyond the bound are read as one value, and only those; lines about as long as the bound are neither lost nor cut."""
    monkeypatch.setattr(writers, "LONG_LINE", 1000)
    mark, short = b"\xef\xbb\xbf", b"short\n" * 5000
    held = {"short.txt": short, "short.json": short, "only.json": b"q" * 4000, "tail.txt": b"a\n" + b"q" * 4000, "head.tsv": mark + b"q" * 4000 + b"\nb\n", "a[1]{b} *?#%20 ü.json": b"z" * 3000}
    for n in range(994, 1006):
        held |= {f"{n}.txt": b"a\n" + b"q" * n + b"\nb\n", f"{n}.json": b"q" * n, f"{n}.bin": b"a\nb\n" + b"q" * n + b"\n" + b"c\n" * 400, f"{n}.dat": mark + b"q" * n + b"\n" + b"q" * n}
    (tmp_path / "m").mkdir()
    for name, data in held.items():
        (tmp_path / "m" / name).write_bytes(data)
    want = {n: (hashlib.sha256(d).hexdigest(), len(d), d.count(b"\n") - 1 if n.endswith(".tsv") else None, d.count(b"\n") if n.endswith(".txt") else None) for n, d in held.items()}
    put = {"spark.sql.sources.binaryFile.maxLength": "6000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in [*put, "spark.sql.files.maxPartitionBytes"]}
    try:
        for block in ("100m", "700"):
            for k, v in (put | {"spark.sql.files.maxPartitionBytes": block}).items():
                spark.conf.set(k, v)
            rows = writers.manifest(spark, f"{tmp_path}/m").collect()
            assert len(rows) == len(want) and {r.path: (r.sha256, r.bytes, r.rows, r.lines) for r in rows} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lexicon(spark):
    forms = spark.createDataFrame([("l", "10", "f", "s"), ("l", "9", "g", "s"), ("k", "9", "h", "s")], "Language_ID string, Parameter_ID string, Form string, Source string")
    params = spark.createDataFrame([("9", "n9", "G"), ("10", "n10", "H")], "ID string, Name string, Concepticon_Gloss string")
    assert [r.Form for r in lexicon.lexicon(forms, params, "l").collect()] == ["g", "f"]
    assert sorted(r.key for r in lexicon.cited(spark.createDataFrame([("a[1];b",), ("b",), (None,)], "Source string")).collect()) == ["a", "b"]


def test_report(spark):
    text = report.markdown("T", spark.createDataFrame([("a", 0.5, None)], "x string, y double, z int"), {"y": ".0%"}, "end")
    assert text.splitlines() == ["# T", "", "| x | y | z |", "| --- | --- | --- |", "| a | 50% |  |", "", "end"]
    made = report.render("tokens", spark.createDataFrame([("t", "en", 2.0, 1.256, 0.5)], "tokenizer string, lang string, tokens_per_word double, tax double, own_share double"))
    assert made.splitlines()[0] == "# Cost in tokens" and "| t | en | 2.00 | 1.26 | 50.0% |" in made
    with pytest.raises(KeyError):
        report.render("other", spark.range(1))


def test_lines_as_python_splits_them(spark, tmp_path):
    """Line ends of all kinds, with and without a last one, in files that several tasks read in part."""
    held = {"a": "x\x0by\r\nz\x0c", "b": "one\u2028two\x85\n\nthree\r", "c": "\n", "d": "no end", "e": "r\rs\r\n\r\n", "f": "ä\x1c\n", "g": "".join(f"line {i}\n" for i in range(3000))}
    (tmp_path / "l").mkdir()
    for name, text in held.items():
        (tmp_path / "l" / f"{name}.txt").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {}
        for r in readers.lines(spark, f"{tmp_path}/l").orderBy("file", "row").collect():
            got.setdefault(r.file.rsplit("/", 1)[1][0], []).append((r.row, r.text))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {name: list(enumerate(text.splitlines())) for name, text in held.items()}


def test_several_files_count_apart(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for name in ("p", "q"):
        (tmp_path / "v" / f"{name}.csv").write_text("id,said\n" + "".join(f'{i},"{name}, {i}\n"\n' for i in range(3)), encoding="utf-8")
    found = readers.extract_text(spark, f"{tmp_path}/v", {"format": "csv", "column": "said"}).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.row, r.text) for r in found) == [(f"{n}.csv", i, f"{n}, {i}") for n in ("p", "q") for i in range(3)]
    assert readers.first_column(spark, f"{tmp_path}/none.csv").count() == 0 and readers.report_name("a/b/text.tsv") == "b" and readers.report_name("a/corpus.csv") == "corpus"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t.txt").write_text("Solēmi  “pōraati”\nsolēmi\n", encoding="utf-8")
    (tmp_path / "h.txt").write_text("solemi poraati\nsolemi\n", encoding="utf-8")
    assert cli.main(["normalize", "--strip-diacritics", f"{tmp_path}/t.txt"]) == 0
    assert capsys.readouterr().out.splitlines() == ['Solemi "poraati"', "solemi"]
    assert cli.main(["stats", f"{tmp_path}/t.txt"]) == 0
    assert "| Word tokens | 3 |" in capsys.readouterr().out
    assert cli.main(["score", f"{tmp_path}/t.txt", f"{tmp_path}/h.txt"]) == 0
    assert "diacritic_blind: WER 0.0%" in capsys.readouterr().out
    (tmp_path / "m.json").write_text(json.dumps({"format": 1, "words": {"solemi": {"solēmi": 2}, "poraati": {"pōraati": 1}}, "bigrams": {"<s> solemi": {"solēmi": 1}}, "chars": {"0|_|a": {"ā": 1}}}), encoding="utf-8")
    assert cli.main(["restore", "--model", f"{tmp_path}/m.json", f"{tmp_path}/h.txt"]) == 0
    assert capsys.readouterr().out.splitlines() == ["solēmi pōraati", "solēmi"]
    for bad in (["normalize", f"{tmp_path}/none"], ["translate", f"{tmp_path}/t.txt"], ["restore", f"{tmp_path}/t.txt"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def fetch(step):
    if step["source_id"] == "b":
        raise OSError("gone")


def test_catalogue_commands(spark, tmp_path, capsys):
    path = tmp_path / "catalogue.json"
    path.write_text(json.dumps({"sources": [{"id": x, "license": "CC0", "access": {"type": "hf", "repo_id": f"org/{x}", "text_bytes": 1200}} for x in "ab"]}))
    assert cli.main(["list", str(path)]) == 0 and "| a |" in capsys.readouterr().out
    assert cli.main(["plan", str(path), "--only", "a"]) == 0 and "1 to fetch, 1.2 KB in all, 0 of unknown size" in capsys.readouterr().out
    assert cli.main(["plan", str(path), "--only", "z"]) == 2 and "z" in capsys.readouterr().err
    assert cli.main(["fetch", str(path), "--with", f"{__name__}:fetch"]) == 1 and "b: OSError: gone" in capsys.readouterr().err
    assert cli.main(["fetch", str(path), "--only", "a", "--with", f"{__name__}:fetch"]) == 0


def test_split_and_cost_commands(spark, tmp_path, capsys):
    rows = [{"utterance_id": f"u{i}", "text": f"sentence {i // 2}", "split": "train", "participant_record_id": f"s{i // 4}"} for i in range(60)]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert cli.main(["split", f"{tmp_path}/m.jsonl", "--out", f"{tmp_path}/split"]) == 0
    assert "| disjoint | test_sentence_leak |" in capsys.readouterr().out
    written = {r.utterance_id: r.disjoint_split for r in readers.csv(spark, f"{tmp_path}/split").collect()}
    assert len(written) == 60 and all(written[f"u{i}"] == written[f"u{i // 4 * 4}"] for i in range(60)) and set(written.values()) == {"train", "test", "validation"}
    (tmp_path / "en.txt").write_text("a b\n")
    (tmp_path / "xx.txt").write_text("aaaa bbbb\n")
    assert cli.main(["cost", f"en={tmp_path}/en.txt", f"xx={tmp_path}/xx.txt"]) == 0 and "| letters | xx | 2 | 9 | 4.50 | 3.00 |" in capsys.readouterr().out
