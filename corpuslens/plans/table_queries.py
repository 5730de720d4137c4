"""Queries of sources, sinks, joins, catalogue and parallel text."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import catalog, lexicon, parallel
from corpuslens.plans import base as B
from corpuslens.plans.base import query, read
from corpuslens.plans.file_queries import SOURCES, sources
from corpuslens.sources import readers


@query("""
WITH f AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations)
SELECT conv_id, section, string_agg(t, ' ' ORDER BY turn) AS body FROM (SELECT conv_id, section, turn, trim(regexp_replace(text, '""" + B.SPACE + """+', ' ', 'g')) AS t FROM f WHERE section IS NOT NULL AND role <> 'user') WHERE t <> '' GROUP BY conv_id, section
""")
def sectionize(spark, sf_dir):
    return parallel.sections(read(spark, sf_dir, "conversations"), F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn")


@query("""
SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS "user", max(CASE WHEN role = 'assistant' THEN text END) AS assistant FROM conversations WHERE role IN ('user', 'assistant')
GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0
""")
def parallel_align(spark, sf_dir):
    return parallel.aligned(read(spark, sf_dir, "conversations"), ["user", "assistant"], "conv_id", "role", "text")


_PAIRS = """(VALUES
    ('GEN.1.1', 'a b', 'x', 0, 0, 1), ('GEN.1.1', 'a b', 'x', 1, 0, 2), ('GEN.1.2', 'c', 'y', 0, 0, 3), ('GEN.1.2', 'c', 'z', 0, 1, 4), ('TIT.1.1', 'd', 'w', 0, 0, 5), ('TIT.1.1', 'd', 'w', 0, 1, 6),
    ('RUT.1.1', 'e', 'u', 1, 0, 7), ('RUT.1.1', 'e', 'v', 1, 1, 8), ('RUT.1.2', 'f', 'u', 1, 0, 9), ('RUT.1.1', 'g', 'u', 0, 0, 10), ('JON.1.1', 'h', 'q', 1, 0, 11), ('JON.1.1', 'h', 'r', 1, 1, 12), ('JON.1.1', 'h2', 'q2', 1, 0, 13)
) v(key, src, tgt, src_version, tgt_version, seq)"""
_SPLIT = "CASE WHEN split_part(key, '.', 1) IN ('RUT', 'JON', 'PHP', 'JAS', '1JN') THEN 'test' WHEN split_part(key, '.', 1) IN ('TIT', 'ZEP') THEN 'dev' ELSE 'train' END"


@query(f"""
SELECT split, key, src, tgt FROM (SELECT *, row_number() OVER (PARTITION BY split, src, tgt ORDER BY src_version, tgt_version, key) AS n FROM (SELECT *, {_SPLIT} AS split FROM {_PAIRS})) WHERE n = 1 AND split <> 'test'
""")
def pair_split(spark, sf_dir):
    return parallel.pair_split(spark.sql(f"SELECT * FROM {_PAIRS}"))


@query(f"""
SELECT key, arg_max(src, seq) AS src, arg_max(tgt, seq) FILTER (tgt_version = 0) AS ref_0, arg_max(tgt, seq) FILTER (tgt_version = 1) AS ref_1 FROM {_PAIRS} WHERE {_SPLIT} = 'test' AND src_version = 1
GROUP BY key HAVING coalesce(arg_max(tgt, seq) FILTER (tgt_version = 0), '') <> '' AND coalesce(arg_max(tgt, seq) FILTER (tgt_version = 1), '') <> ''
""")
def pair_test_rows(spark, sf_dir):
    return parallel.test_rows(spark.sql(f"SELECT * FROM {_PAIRS}"), 1, [0, 1])


@query("SELECT * FROM (VALUES ('train', CAST(3 AS BIGINT)), ('dev', 1), ('test', 2)) v(split, n)")
def pair_split_counts(spark, sf_dir):
    return parallel.split_counts(spark.sql(f"SELECT * FROM {_PAIRS}"), 1, [0, 1])


def _sql(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else "'" + str(x) + "'"


_CATALOGUE = "(VALUES " + ", ".join("(" + ", ".join([*map(_sql, r[:7]), _sql(",".join(r[7])), _sql(",".join(r[8])), *(f"CAST({_sql(x)} AS BIGINT)" for x in r[9:11]), _sql(r[11])]) + ")" for r in SOURCES) + ") v(id, type, license, redistributable, in_repo, repo_id, url, texts, audio, text_bytes, audio_bytes, inside)"
_STEPS = f"""
a AS (SELECT *, CASE WHEN type = 'github' OR in_repo THEN 'in_repo' WHEN type = 'manual' THEN 'manual' WHEN type <> 'hf' THEN 'skip' WHEN NOT redistributable THEN 'skip' ELSE 'download' END AS action FROM {_CATALOGUE}),
steps AS (SELECT id AS source_id, action, CASE action WHEN 'in_repo' THEN 'already in the repository' WHEN 'manual' THEN 'download by hand: ' || url
        WHEN 'skip' THEN CASE WHEN type <> 'hf' THEN 'unsupported access type ' || type ELSE 'restricted license: ' || license END ELSE CASE WHEN audio <> '' THEN 'text + audio' ELSE 'text' END END AS reason,
    CASE WHEN action = 'download' THEN repo_id END AS repo_id, CASE WHEN action = 'download' THEN texts || CASE WHEN audio <> '' THEN ',' || audio ELSE '' END ELSE '' END AS patterns,
    CASE WHEN action = 'download' THEN CASE WHEN audio <> '' THEN text_bytes + audio_bytes ELSE text_bytes END END AS approx_bytes FROM a)
"""


@query(f"WITH {_STEPS} SELECT * FROM steps")
def plan_sources(spark, sf_dir):
    return catalog.plan(sources(spark), audio=True, skip_restricted=True).withColumn("patterns", F.array_join("patterns", ","))


@query(f"WITH {_STEPS} SELECT count(*) AS downloads, CAST(coalesce(sum(approx_bytes), 0) AS BIGINT) AS known_bytes, count(*) FILTER (approx_bytes IS NULL) AS unknown FROM steps WHERE action = 'download'")
def plan_totals(spark, sf_dir):
    return catalog.totals(catalog.plan(sources(spark), audio=True, skip_restricted=True))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS feature_id, coalesce(n_name, '') AS feature, CAST(s_nationkey AS VARCHAR) AS value, coalesce(r_name, '') AS value_label, '' AS comment, s_name AS source
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 5 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2
""")
def structure_join(spark, sf_dir):
    supplier, nation, region = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    some = nation.where("n_nationkey % 5 <> 0")
    values = supplier.join(some, supplier.s_nationkey == some.n_nationkey, "left").select(
        F.lit("x").alias("Language_ID"), F.col("n_nationkey").cast("string").alias("Parameter_ID"), F.col("n_regionkey").cast("string").alias("Code_ID"), F.col("s_nationkey").cast("string").alias("Value"),
        F.lit(None).cast("string").alias("Comment"), F.col("s_name").alias("Source"), "s_suppkey",
    )
    codes = region.where("r_regionkey <> 2").select(F.col("r_regionkey").cast("string").alias("ID"), F.when(F.col("r_regionkey") == 1, "").otherwise(F.col("r_name")).alias("Description"), F.col("r_name").alias("Name"))
    features = some.select(F.col("n_nationkey").cast("string").alias("ID"), F.col("n_name").alias("Name"))
    found = lexicon.structure(values, features, codes, "x")
    key = supplier.select(F.col("s_name").alias("source"), F.col("s_suppkey").cast("string").alias("feature_id"))
    return found.drop("feature_id").join(key, "source").select("feature_id", "feature", "value", "value_label", "comment", "source")


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS key FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def language_rows(spark, sf_dir):
    both = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lexicon.language_rows(both.select(F.col("n_name").alias("Name"), F.col("n_nationkey").alias("Key"), F.col("r_name").alias("Language_ID")), "ASIA", ["Name", "Key"])


@query("SELECT DISTINCT text FROM (SELECT text, CASE WHEN conv_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM conversations) WHERE split = 'test'")
def split_sentences(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("utterance_id", F.concat_ws(":", "conv_id", "turn"))
    assignment = c.select("utterance_id", F.when(F.col("conv_id") % 10 == 0, "test").otherwise("train").alias("split"))
    return readers.split_sentences(c, assignment).where("split = 'test'").select("text")


@query("SELECT DISTINCT d.text FROM documents d WHERE d.doc_id % 2 = 0 AND d.text IN (SELECT text FROM documents WHERE doc_id % 2 = 1)")
def text_overlap(spark, sf_dir):
    """Distinct texts that two halves of the documents share."""
    docs = read(spark, sf_dir, "documents")
    return docs.where("doc_id % 2 = 0").select("text").intersect(docs.where("doc_id % 2 = 1").select("text"))


_RUNS = """(VALUES ('m1', 'd1', 20, 'a.json'), ('m1', 'd1', 362, 'b.json'), ('m1', 'd2', 5, 'c.json'), ('m2', 'd1', 362, 'd.json'), ('m2', 'd1', 362, 'e.json'), ('m3', 'd1', NULL, 'f.json')) v(model, dataset, clips, path)"""


@query(f"SELECT model, dataset, clips, path FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY clips DESC, path) AS n FROM {_RUNS} WHERE clips IS NOT NULL) WHERE n = 1")
def best_run(spark, sf_dir):
    return catalog.best_runs(spark.sql(f"SELECT * FROM {_RUNS}"), {"m2": 0, "m1": 1}, "d1")


@query("SELECT item FROM (SELECT conv_id * 1000 + turn AS item, conv_id, text FROM conversations) WHERE conv_id % 10 = 0 AND text IN (SELECT text FROM conversations WHERE conv_id % 10 <> 0)")
def leaked_items(spark, sf_dir):
    """Held-out items whose text is in train: a semi join."""
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), "conv_id", "text")
    return c.where("conv_id % 10 = 0").join(c.where("conv_id % 10 <> 0").select("text").distinct(), "text", "left_semi").select("item")
