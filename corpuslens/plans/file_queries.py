"""Queries of sources and sinks: a table is written to the shared folder in a format by a writer and read back by a reader."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import catalog, infer, lexicon, restore, scoring
from corpuslens.plans import base as B
from corpuslens.plans.base import query, read
from corpuslens.plans.corpus_queries import _CHAR_ROWS, _PAIR_ROWS, _Whisper
from corpuslens.sources import readers, writers
from corpuslens.storage import shared_dir


def _path(spark, name: str) -> str:
    stem, dot, ending = name.partition(".")
    return f"{shared_dir(spark)}/files-{stem}-{uuid.uuid4().hex}{dot}{ending}"


def _turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))


def _clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '[\t\r\n]+', ' ', 'g'), '^{B.SPACE}+|{B.SPACE}+$', '', 'g')"


def _lines(x: str) -> str:
    return rf"unnest(string_split(regexp_replace({x}, '\r\n|[\r\x0b\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), chr(10)))"


@query(f"SELECT {B.norm('text')} AS text FROM conversations WHERE {B.norm('text')} <> ''")
def corpus_from_csv(spark, sf_dir):
    """A CSV corpus with the named column: quoted cells, some with line ends."""
    path = _path(spark, "corpus.csv")
    texts = _turns(spark, sf_dir).select("key", F.concat(F.lit(' "q",\n'), "text").alias("text"))
    texts.write.option("header", True).option("escape", '"').csv(path)
    return readers.corpus(spark, path).select(F.expr("substring(text, 6)").alias("text")).where("text <> ''")


@query(f"SELECT {B.norm('line')} AS text FROM (SELECT {_lines('text')} AS line FROM documents) WHERE {B.norm('line')} <> ''")
def corpus_from_lines(spark, sf_dir):
    """Plain text: every line is a sentence."""
    path = _path(spark, "corpus.txt")
    read(spark, sf_dir, "documents").select("text").where("text is not null").write.text(path)
    return readers.corpus(spark, path).select("text")


@query(f"SELECT line AS text FROM (SELECT {_lines('html')} AS line FROM pages)")
def split_lines(spark, sf_dir):
    path = _path(spark, "pages.txt")
    read(spark, sf_dir, "pages").select("html").where("html is not null").write.text(path)
    return readers.lines(spark, path).select("text")


@query(f"SELECT 'numbered from 0 without gaps' AS n, count(*) AS rows FROM (SELECT {_lines('text')} FROM documents)")
def line_numbers(spark, sf_dir):
    """Rows are numbered in each file from 0 without gaps, however many tasks read it."""
    path = _path(spark, "numbered.txt")
    read(spark, sf_dir, "documents").select("text").where("text is not null").write.text(path)
    by_file = readers.lines(spark, path).groupBy("file").agg(F.count("*").alias("n_rows"), F.count_distinct("row").alias("d"), F.min("row").alias("a"), F.max("row").alias("b"))
    told = F.when((F.col("a") == 0) & (F.col("b") == F.col("n_rows") - 1) & (F.col("d") == F.col("n_rows")), "numbered from 0 without gaps").otherwise("gaps")
    return by_file.select(told.alias("n"), "n_rows").groupBy("n").agg(F.sum("n_rows").alias("rows"))


@query(f"SELECT key, {_clean('text')} AS text FROM (SELECT conv_id || ':' || turn AS key, text FROM conversations)")
def tsv_round_trip(spark, sf_dir):
    """Cleaned cells without quotes, as the writer leaves them."""
    path = _path(spark, "turns.tsv")
    writers.write_tsv(_turns(spark, sf_dir).select("key", "text"), path)
    return readers.tsv(spark, path).select("key", F.coalesce("text", F.lit("")).alias("text"))


@query(f"SELECT {_clean('text')} AS text FROM conversations")
def lines_from_tsv(spark, sf_dir):
    """What the command line reads of a .tsv: its text column, not normalized, quotes as text."""
    path = _path(spark, "turns.tsv")
    writers.write_tsv(_turns(spark, sf_dir).select("key", F.concat(F.lit('"'), "text").alias("text")), path)
    return readers.read_lines(spark, path).select(F.expr("substring(text, 2)").alias("text"))


@query("SELECT text FROM (SELECT CASE WHEN turn % 3 = 0 THEN '' ELSE 'a ' || chr(34) || 'b' || chr(34) || chr(9) || text END AS text FROM conversations) WHERE text <> ''")
def quoted_tsv_texts(spark, sf_dir):
    """Tab-separated with quotes: cells hold tabs and quotes; empty ones go."""
    path = _path(spark, "quoted.tsv")
    made = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit('a "b"\t'), "text"))
    writers.write_tsv(_turns(spark, sf_dir).select("key", made.alias("text")), path, quote='"')
    return readers.tsv_texts(spark, path)


@query("SELECT coalesce(text, '') AS text FROM documents")
def parquet_texts(spark, sf_dir):
    """A column found by its name among those that hold text."""
    path = _path(spark, "speech.parquet")
    read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("transcription")).write.parquet(path)
    return readers.parquet_text(spark, path, "missing").select("text")


@query("SELECT coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, props, '') AS text FROM events")
def jsonl_fallback(spark, sf_dir):
    """JSON lines: a field where it is there, else the first fallback, else ''."""
    path = _path(spark, "events.jsonl")
    events = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("said"), F.col("props").alias("transcript"))
    writers.write_json(events, path)
    return readers.jsonl_text(spark, path, "said").select("text")


@query("SELECT p_name || ' ' || chr(34) || p_brand || chr(34) || ',' AS text FROM part")
def csv_texts(spark, sf_dir):
    """The first column that is no key; a cell with quotes and commas."""
    path = _path(spark, "parts.csv")
    made = F.concat("p_name", F.lit(' "'), "p_brand", F.lit('",'))
    read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("c").alias("chapter"), made.alias("words"), "p_type").write.option("header", True).option("escape", '"').csv(path)
    return readers.csv_text(spark, path).select("text")


@query(f"SELECT {_clean('text')} AS text FROM documents WHERE {_clean('text')} <> ''")
def extract_text(spark, sf_dir):
    """Files of a source by its specification: cells cleaned, empty ones dropped."""
    path = _path(spark, "source.jsonl")
    writers.write_json(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), path)
    return readers.extract_text(spark, path, {"format": "jsonl", "column": "content"}).select("text")


@query("SELECT p_name AS text FROM part")
def first_column(spark, sf_dir):
    path = _path(spark, "first.csv")
    read(spark, sf_dir, "part").select(F.col("p_name").alias("any name"), "p_brand").write.option("header", True).csv(path)
    return readers.first_column(spark, path).unionByName(readers.first_column(spark, path + ".missing"))


_SPLIT = "CASE WHEN {0} % 10 = 0 THEN 'test' WHEN {0} % 10 = 1 THEN 'validation' ELSE 'train' END"


def _speech(spark, sf_dir):
    side = F.when(F.col("conv_id") % 10 == 0, "test").when(F.col("conv_id") % 10 == 1, "validation").otherwise("train")
    rows = _turns(spark, sf_dir)
    return rows.select(F.col("key").alias("utterance_id"), "text", (F.length("text") / 15).alias("duration_seconds"), side.alias("split"), F.col("conv_id").cast("string").alias("participant_record_id"), F.lit(None).cast("string").alias("gender"))


@query(f"SELECT conv_id || ':' || turn AS utterance_id, text, length(text) / 15 AS duration_seconds, {_SPLIT.format('conv_id')} AS split, CAST(conv_id AS VARCHAR) AS participant_record_id FROM conversations")
def speech_metadata(spark, sf_dir):
    """JSON lines of three splits as one table of a given schema; fields that are missing are null."""
    paths = []
    for name in readers.SPLITS:
        paths.append(_path(spark, f"{name}.jsonl"))
        writers.write_json(_speech(spark, sf_dir).where(F.col("split") == name), paths[-1])
    return readers.utterances(spark, paths).where("gender is null and file_name is null").select("utterance_id", "text", "duration_seconds", "split", "participant_record_id")


@query("SELECT DISTINCT text FROM conversations WHERE conv_id % 10 = 1")
def saved_splits(spark, sf_dir):
    """A table for each split, of which one is read."""
    path = _path(spark, "speech")
    writers.write_splits(_speech(spark, sf_dir), path)
    return readers.speech(spark, path, "validation").select("text").distinct()


@query(f"SELECT {B.norm('text')} AS text FROM conversations WHERE {B.norm('text')} <> ''")
def transcripts(spark, sf_dir):
    path = _path(spark, "voices")
    writers.write_splits(_speech(spark, sf_dir).withColumnRenamed("text", "transcription"), path)
    return readers.transcripts(readers.speech(spark, path, "train").unionByName(readers.speech(spark, path, "test")).unionByName(readers.speech(spark, path, "validation")))


@query(f"SELECT conv_id || ':' || turn AS utterance_id, {_SPLIT.format('conv_id')} AS disjoint_split FROM conversations")
def split_table(spark, sf_dir):
    path = _path(spark, "split.csv")
    writers.write_split_csv(_speech(spark, sf_dir).select("utterance_id", F.col("split").alias("disjoint_split")), path)
    return readers.csv(spark, path)


@query(f"""
SELECT a.conv_id || '.' || a.turn AS verse_key, {B.norm('a.text')} AS src, {B.norm('b.text')} AS tgt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.turn % 5 <> 4 AND {B.norm('a.text')} <> '' AND {B.norm('b.text')} <> ''
""")
def verse_pairs(spark, sf_dir):
    """Verses that two versions share, written as pairs and read again; blank ones go."""
    c = read(spark, sf_dir, "conversations")
    key = lambda at: F.concat_ws(".", F.col("conv_id").cast("string"), at.cast("string")).alias("verse_key")
    src = c.select(key(F.col("turn")), F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("text")).alias("text"))
    tgt = c.select(key(F.col("turn") - 1), "text")
    path = _path(spark, "pairs.csv")
    readers.version_pairs(src, tgt).write.option("header", True).option("escape", '"').csv(path)
    return readers.pairs(spark, path, "src", "tgt")


@query("SELECT r_name AS model, 'd' AS dataset, CAST(r_regionkey * 10 AS BIGINT) AS clips FROM region WHERE r_regionkey <> 2")
def result_files(spark, sf_dir):
    """A JSON file for each run, over several lines; one without a needed key is left out."""
    path = _path(spark, "results")
    score = F.when(F.col("r_regionkey") != 2, F.struct(F.lit(0.5).alias("wer")))
    runs = read(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("model"), F.lit("d").alias("dataset"), (F.col("r_regionkey") * 10).alias("clips"), score.alias("normalized"))).alias("j"))
    runs.select(F.regexp_replace("j", ",", ",\n").alias("value"), F.col("r_regionkey").alias("run")).write.partitionBy("run").text(path)
    return readers.result_files(spark, f"{path}/*/*.txt").select("model", "dataset", "clips")


@query(f"SELECT CAST(l - 1 AS INTEGER) AS line, names[l] AS text FROM (SELECT list(n_name ORDER BY n_nationkey) AS names FROM nation), range(1, 26) r(l)")
def zip_member(spark, sf_dir):
    """A member of a zip file, with line ends of another system."""
    names = [r.n_name for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("names.txt", "\r\n".join(names) + "\r\n")
        z.writestr("other.txt", "no")
    path = _path(spark, "names.zip")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(held.getvalue()))
    out.close()
    return readers.zip_lines(spark, path, "names.txt").select("line", "text")


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS text, CAST(event_id % 50 + 1 AS INTEGER) AS samples, CAST((event_id % 50 + 1) * 65 AS DOUBLE) AS total FROM events WHERE event_id % 50 + 1 <= 40")
def audio_clips(spark, sf_dir):
    """Clips from bytes by an injected decoder; those of over 40 s are left out."""
    path = _path(spark, "audio.parquet")
    content = F.encode(F.expr("repeat('A', cast(event_id % 50 + 1 as int))"), "UTF-8")
    read(spark, sf_dir, "events").select(F.struct(content.alias("bytes"), F.col("event_id").cast("string").alias("path")).alias("audio"), F.col("event_type").alias("text")).write.parquet(path)
    clips = readers.audio_clips(spark, path, lambda b: ([float(x) for x in b], 1))
    return clips.select("id", "text", F.size("waveform").alias("samples"), F.aggregate("waveform", F.lit(0.0), lambda a, x: a + x).alias("total"))


# id, type, license, redistributable, in_repo, repo_id, url, text patterns, audio patterns, text bytes, audio bytes, transcripts in audio
SOURCES = [
    ("lexica", "github", "CC-BY-4.0", True, True, None, None, [], [], None, None, False),
    ("scans", "manual", "unknown", False, False, None, "https://example.org/scans", [], [], None, None, False),
    ("tape", "ftp", "CC0", True, False, None, None, [], [], None, None, False),
    ("web", "hf", "ODC-BY", True, False, "org/web", None, ["data/*.parquet"], [], 3_400_000, None, False),
    ("voices", "hf", "CC-BY-NC", False, False, "org/voices", None, ["meta/*.jsonl"], ["audio/*.tar"], 1_000, 8_300_000_000, False),
    ("clips", "hf", "CC-BY-4.0", True, False, "org/clips", None, ["README.md"], ["*.parquet"], 500, None, True),
]


def sources(spark):
    """The catalogue above, from a JSON file."""
    rows = [{"id": i, "name": i, "kind": "corpus", "license": lic, "redistributable": red, "in_repo": rep, "access": {"type": t, "repo_id": r, "url": u, "text_patterns": tp, "audio_patterns": ap, "text_bytes": tb, "audio_bytes": ab, "transcripts_in_audio": tr}} for i, t, lic, red, rep, r, u, tp, ap, tb, ab, tr in SOURCES]
    path = _path(spark, "catalogue.json")
    spark.createDataFrame([(json.dumps({"sources": rows}, indent=1),)], "value string").write.text(path)
    return readers.catalog(spark, path)


@query("SELECT n_name AS id, 'corpus' AS kind, r_name AS license, CASE WHEN n_nationkey % 2 = 0 THEN 'org/' || n_name ELSE coalesce('https://' || n_name, '') END AS location, CASE WHEN n_nationkey = 0 THEN 'size unknown' ELSE n_nationkey * 10 || ' B' END AS size FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_list(spark, sf_dir):
    """A catalogue made of nations, from its JSON file to the listing."""
    both = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    even = F.col("n_nationkey") % 2 == 0
    access = F.struct(F.lit("hf").alias("type"), F.when(even, F.concat(F.lit("org/"), "n_name")).alias("repo_id"), F.when(~even, F.concat(F.lit("https://"), "n_name")).alias("url"), F.when(F.col("n_nationkey") > 0, F.col("n_nationkey") * 10).alias("text_bytes"))
    row = F.struct(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.lit("corpus").alias("kind"), F.col("r_name").alias("license"), access.alias("access"))
    path = _path(spark, "nations.json")
    both.agg(F.to_json(F.struct(F.collect_list(row).alias("sources"))).alias("value")).write.text(path)
    return catalog.listing(readers.catalog(spark, path))


@query("SELECT n_name AS source_id, '{\"id\":\"' || n_name || '\",\"name\":\"' || lower(n_name) || '\",\"license\":\"' || r_name || '\"}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey")
def provenance(spark, sf_dir):
    both = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return writers.provenance(both.select(F.col("n_name").alias("id"), F.lower("n_name").alias("name"), F.col("r_name").alias("license"), F.lit("unused").alias("kind")))


@query("SELECT s FROM (VALUES ('nowhere'), ('web'), ('zero')) v(s) WHERE s NOT IN ('lexica', 'scans', 'tape', 'web', 'voices', 'clips')")
def unknown_sources(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in catalog.unknown_ids(sources(spark), ["web", "nowhere", "zero"])], "s string")


@query("""
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.sha IS NULL THEN 'missing' WHEN a.sha IS NULL THEN 'unexpected' ELSE 'changed' END AS status
FROM (SELECT 'd' || doc_id AS path, md5(text) AS sha FROM documents WHERE doc_id % 7 <> 3) a FULL JOIN (SELECT 'd' || doc_id AS path, md5(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 5 <> 2) b ON a.path = b.path
WHERE a.sha IS NULL OR b.sha IS NULL OR a.sha <> b.sha
""")
def manifest_diff(spark, sf_dir):
    """Two manifests of the documents, of which some are missing and some changed."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    made = lambda df, x: df.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.md5(x.cast("binary")).alias("sha256"))
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return catalog.manifest_diff(made(docs.where("doc_id % 7 <> 3"), F.col("text")), made(docs.where("doc_id % 5 <> 2"), changed))


@query("SELECT CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes, CAST(sum(1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) AS BIGINT) AS lines FROM documents")
def file_manifest(spark, sf_dir):
    """The manifest of text files that hold all documents: their bytes and lines; every file has a digest."""
    path = _path(spark, "texts")
    read(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    found = writers.manifest(spark, path, "*.txt").where("length(sha256) = 64")
    return found.agg(F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"))


@query(f"SELECT conv_id || ':' || turn AS id, length(text) / 15 AS seconds, {_clean('text')} AS reference, lower({_clean('text')}) AS hypothesis FROM conversations WHERE length(text) / 15 <= 40 AND trim(text) <> ''")
def hypotheses_file(spark, sf_dir):
    """A row per clip, written and read; line ends within texts become spaces."""
    path = _path(spark, "clips.tsv")
    seconds = F.length("text") / 15
    rows = _turns(spark, sf_dir).where(seconds <= infer.MOST_SECONDS).where("trim(text) <> ''").select(F.col("key").alias("id"), seconds.alias("seconds"), "text", F.lower("text").alias("hyp"))
    writers.write_hypotheses(rows, path)
    return readers.tsv(spark, path).select("id", F.col("seconds").cast("double").alias("seconds"), "reference", "hypothesis")


@query("SELECT conv_id || ':' || turn AS key, text AS src, 'p ' || text AS prediction, CASE WHEN turn % 3 = 0 THEN '' ELSE lower(text) END AS reference_1, 'x' AS reference_2 FROM conversations WHERE turn % 4 <> 1")
def predictions_file(spark, sf_dir):
    """Predictions with two references, of which one may be empty; texts without any are left out."""
    path = _path(spark, "predictions.tsv")
    first = F.when(F.col("turn") % 3 == 0, "").otherwise(F.lower("text"))
    refs = F.when(F.col("turn") % 4 == 1, F.array(F.lit(""), F.lit(None).cast("string"))).otherwise(F.array(first, F.lit("x")))
    writers.write_predictions(_turns(spark, sf_dir).select("key", F.col("text").alias("src"), F.concat(F.lit("p "), "text").alias("hyp"), refs.alias("refs")), path)
    return readers.tsv(spark, path, '"').select("key", "src", "prediction", F.coalesce("reference_1", F.lit("")).alias("reference_1"), "reference_2")


@query(f"WITH {_PAIR_ROWS}, {_CHAR_ROWS} SELECT 'words' AS part, key, form, n FROM tw UNION ALL SELECT 'bigrams', key, form, n FROM tb UNION ALL SELECT 'chars', key, form, n FROM tc")
def saved_restorer(spark, sf_dir):
    """A restorer's three tables, saved and loaded."""
    pairs = restore.plain_pairs(read(spark, sf_dir, "documents"))
    path = _path(spark, "restorer")
    writers.save_model(path, *restore.fit(pairs))
    rows = [df.select(F.lit(name).alias("part"), "key", "form", "n") for name, df in zip(("words", "bigrams", "chars"), writers.load_model(spark, path), strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT CAST(l_partkey AS VARCHAR) AS \"Parameter_ID\", p_name AS concept, p_brand AS gloss, l_orderkey || '-' || l_linenumber AS \"Form\", 's' AS \"Source\" FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'")
def lexicon_join(spark, sf_dir):
    """Forms of a language with their parameter's name, by the registered extractor."""
    forms = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("Parameter_ID"), F.col("l_returnflag").alias("Language_ID"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("Form"), F.lit("s").alias("Source"))
    params = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ID"), F.col("p_name").alias("Name"), F.col("p_brand").alias("Concepticon_Gloss"))
    return lexicon.extract("lexicon", {"forms": forms, "parameters": params}, "R")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def keep_first(spark, sf_dir):
    return readers.keep_first(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])


@query("SELECT conv_id, turn, n / 10.0 AS seconds, n || ' samples' AS hyp FROM (SELECT conv_id, turn, length(text) AS n FROM conversations) WHERE n BETWEEN 1 AND 400")
def duration_buckets(spark, sf_dir):
    """Clips of at most 40 s, long ones alone; a text's length stands for its duration."""
    clips = read(spark, sf_dir, "conversations").where("length(text) > 0").select("conv_id", "turn", F.array_repeat(F.lit(0.0).cast("float"), F.length("text")).alias("waveform"), F.lit(10).alias("sample_rate"))
    return infer.transcribe(clips, _Whisper()).select("conv_id", "turn", "seconds", "hyp")


@query(f"SELECT doc_id AS id, lower({B.norm('text')}) AS text FROM documents")
def positional_pairs(spark, sf_dir):
    """References and hypotheses by their position; the pairs' hypotheses are returned."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    refs = docs.select(F.col("doc_id").alias("sid"), "text")
    return scoring.paired(refs, refs.select("sid", T.sentence_key("text").alias("text"))).select(F.col("sid").alias("id"), F.col("hyp").alias("text"))
