"""Word and character error rates, chrF++ and BLEU of hypotheses against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T

#: Words of a pair are written as characters from here on, past the surrogates where there are so many.
_FIRST_CODE, _SURROGATES, _HIGH = 0x4E00, 0xD800, 0x800


def split_words(x: Column | str) -> Column:
    """Words parted by Unicode white space; none of an empty text."""
    spaced = T.collapse_space(x)
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def char_edits(ref: Column | str, hyp: Column | str) -> Column:
    return F.levenshtein(T._col(ref), T._col(hyp)).cast("bigint")


def word_edits(ref: Column | str, hyp: Column | str) -> Column:
    """Edits between two word lists: each distinct word of the pair becomes one character, then the built-in distance does."""
    r, h = T._col(ref), T._col(hyp)

    def code(known: Column, w: Column) -> Column:
        point = F.array_position(known, w) + F.lit(_FIRST_CODE)
        point = F.when(point >= _SURROGATES, point + _HIGH).otherwise(point)
        return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")

    def coded(known: Column, x: Column) -> Column:
        return F.array_join(F.transform(x, lambda w: code(known, w)), "")

    return T.once(F.array_distinct(F.concat(r, h)), lambda known: F.levenshtein(coded(known, r), coded(known, h))).cast("bigint")


def _rate(edits: Column, length: Column, other: Column) -> Column:
    return F.when(length == 0, F.when(other == 0, 0.0).otherwise(1.0)).otherwise(edits / length)


def pair_rates(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """df with wer and cer of each pair; of an empty reference 0 if the hypothesis is empty too, else 1."""
    r, h = split_words(ref), split_words(hyp)
    words = df.withColumn("_r", r).withColumn("_h", h)
    wer = _rate(word_edits("_r", "_h"), F.size("_r"), F.size("_h"))
    cer = _rate(char_edits(ref, hyp), F.length(ref), F.length(hyp))
    return words.withColumn("wer", wer).withColumn("cer", cer).drop("_r", "_h")


def corpus_rates(df: DataFrame, *by: str, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(by, wer, cer) over all pairs: summed edits by summed lengths; 0 only where the references have no length."""
    words = df.withColumn("_r", split_words(ref)).withColumn("_h", split_words(hyp))
    each = words.select(*by, word_edits("_r", "_h").alias("we"), F.size("_r").alias("wn"), char_edits(ref, hyp).alias("ce"), F.length(ref).alias("cn"))
    rate = lambda a, n: F.coalesce(F.try_divide(F.sum(a), F.sum(n)), F.lit(0.0))
    return each.groupBy(*by).agg(rate("we", "wn").alias("wer"), rate("ce", "cn").alias("cer"))


LEVELS = {"strict": T.normalize_text, "normalized": T.scoring_form, "diacritic_blind": T.lenient_form}


def score_levels(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(level, wer, cer) at three levels of leniency, from one pass over the pairs."""
    forms = [F.struct(F.lit(level).alias("level"), form(ref).alias("ref"), form(hyp).alias("hyp")) for level, form in LEVELS.items()]
    rows = df.select(F.explode(F.array(*forms)).alias("p")).select("p.level", "p.ref", "p.hyp")
    return corpus_rates(rows, "level")


def paired(refs: DataFrame, hyps: DataFrame, ordinal: str = "sid", text: str = "text") -> DataFrame:
    """(sid, ref, hyp) by position; an unequal number of rows is an error."""
    both = refs.select(ordinal, F.col(text).alias("ref")).join(hyps.select(ordinal, F.col(text).alias("hyp")), ordinal, "full_outer")
    lone = both.where("ref is null or hyp is null").limit(1).count()
    if lone:
        raise ValueError("references and hypotheses differ in number")
    return both


def _grams(x: Column, n: int, sep: str) -> Column:
    return F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.array_join(F.slice(x, i, n), sep))).otherwise(F.array().cast("array<string>"))


def _of_order(n: int):
    return lambda x: _grams(x, n, " ")


def gram_matches(df: DataFrame, by: list[str], orders: list[tuple[str, int, Column, Column]]) -> DataFrame:
    """(by, kind, n, matched, of_hyp, of_ref) summed over pairs: clipped counts of common n-grams, with columns id, hyp and ref lists."""
    sides = []
    for side in ("hyp", "ref"):
        parts = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n"), (h if side == "hyp" else r).alias("grams")) for kind, n, h, r in orders])
        rows = df.select(*by, "id", F.explode(parts).alias("p")).select(*by, "id", "p.kind", "p.n", F.explode("p.grams").alias("gram"))
        sides.append(rows.groupBy(*by, "id", "kind", "n", "gram").agg(F.count("*").alias(side)))
    key = [*by, "id", "kind", "n", "gram"]
    both = sides[0].join(sides[1], key, "full_outer").na.fill(0, ["hyp", "ref"])
    return both.groupBy(*by, "kind", "n").agg(F.sum(F.least("hyp", "ref")).alias("matched"), F.sum("hyp").alias("of_hyp"), F.sum("ref").alias("of_ref"))


def chrf(df: DataFrame, *by: str, char_order: int = 6, word_order: int = 2, beta: float = 2.0) -> DataFrame:
    """(by, chrf): chrF++ of a corpus with columns id, hyp and ref or refs (array), as published: the mean of F-scores over character and word n-grams.

    Of several references a hypothesis counts with the one that gives it the best score of its own, the first of equals.
    """
    many = "refs" in df.columns
    if many:
        df = df.select(*by, "id", "hyp", F.posexplode_outer(F.filter("refs", lambda x: x.isNotNull())).alias("_k", "ref")).na.fill(0, ["_k"]).na.fill("", ["ref"])
        df = df.withColumn("_id", F.col("id"))
    one = ["_id", "_k"] if many else []
    letters = lambda c: F.filter(F.split(F.regexp_replace(c, r"\s+", ""), ""), lambda x: x != "")
    marked = lambda c: split_words(F.regexp_replace(F.regexp_replace(c, r"([^\p{L}\p{N}\s])(?=\s|$)", " $1"), r"(?<=\s|^)([^\p{L}\p{N}\s])", "$1 "))
    rows = df.select(*by, *one, "id", letters("hyp").alias("hc"), letters("ref").alias("rc"), marked("hyp").alias("hw"), marked("ref").alias("rw"))
    orders = [("char", n, _grams(F.col("hc"), n, ""), _grams(F.col("rc"), n, "")) for n in range(1, char_order + 1)]
    orders += [("word", n, _grams(F.col("hw"), n, " "), _grams(F.col("rw"), n, " ")) for n in range(1, word_order + 1)]
    p, r = F.try_divide(F.col("matched"), F.col("of_hyp")), F.try_divide(F.col("matched"), F.col("of_ref"))
    score = F.coalesce(F.try_divide((1 + beta**2) * p * r, beta**2 * p + r), F.lit(0.0))
    sums = gram_matches(rows, [*by, *one], orders)
    if many:
        own = F.coalesce(F.avg(F.when((F.col("of_hyp") > 0) & (F.col("of_ref") > 0), score)), F.lit(0.0)).alias("own")
        tried = sums.groupBy(*by, *one).agg(own, F.collect_list(F.struct("kind", "n", "matched", "of_hyp", "of_ref")).alias("s"))
        best = tried.groupBy(*by, "_id").agg(F.max_by("s", F.struct("own", -F.col("_k"))).alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.*")
        sums = best.groupBy(*by, "kind", "n").agg(*[F.sum(c).alias(c) for c in ("matched", "of_hyp", "of_ref")])
    each = sums.where("of_hyp > 0 and of_ref > 0").withColumn("f", score)
    return each.groupBy(*by).agg((100 * F.avg("f")).alias("chrf"))


def bleu(df: DataFrame, *by: str, order: int = 4) -> DataFrame:
    """(by, bleu): corpus BLEU with columns id, hyp and refs (array): clipped n-gram precision, brevity against the closest reference length, zero counts smoothed by halving."""
    rows = df.select(*by, "id", split_words("hyp").alias("h"), F.transform("refs", split_words).alias("rs"))
    gap = lambda x: F.struct(F.abs(F.size(x) - F.size("h")).alias("gap"), F.size(x).alias("n"))
    sized = rows.withColumn("closest", F.array_min(F.transform("rs", gap))["n"])
    lengths = sized.groupBy(*by).agg(F.sum(F.size("h")).alias("c"), F.sum("closest").alias("r"))
    parts = F.array(*[F.struct(F.lit(n).alias("n"), _grams(F.col("h"), n, " ").alias("hg"), F.transform("rs", _of_order(n)).alias("rg")) for n in range(1, order + 1)])
    grams = rows.select(*by, "id", F.explode(parts).alias("p")).select(*by, "id", "p.n", "p.hg", "p.rg")
    hyp = grams.select(*by, "id", "n", F.explode("hg").alias("gram")).groupBy(*by, "id", "n", "gram").agg(F.count("*").alias("in_hyp"))
    ref = grams.select(*by, "id", "n", F.posexplode("rg").alias("k", "g")).select(*by, "id", "n", "k", F.explode("g").alias("gram")).groupBy(*by, "id", "n", "k", "gram").agg(F.count("*").alias("m"))
    most = ref.groupBy(*by, "id", "n", "gram").agg(F.max("m").alias("in_ref"))
    both = hyp.join(most, [*by, "id", "n", "gram"], "left").na.fill(0, ["in_ref"])
    sums = both.groupBy(*by, "n").agg(F.sum(F.least("in_hyp", "in_ref")).alias("matched"), F.sum("in_hyp").alias("total"))
    lists = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "matched", "total"))), lambda x: F.struct(x["matched"].alias("m"), x["total"].alias("t"))).alias("s"))
    zero = F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("halved"))
    step = lambda acc, x: F.struct((acc["log"] + F.when(x["m"] > 0, F.log(x["m"] / x["t"])).otherwise(F.log(1 / (acc["halved"] * 2 * x["t"])))).alias("log"), F.when(x["m"] > 0, acc["halved"]).otherwise(acc["halved"] * 2).alias("halved"))
    total = F.aggregate("s", zero, step, lambda acc: acc["log"] / order)
    brevity = F.when(F.col("c") >= F.col("r"), 1.0).when(F.col("c") == 0, 0.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    joined = lists.join(lengths, list(by)) if by else lists.crossJoin(lengths)  # one row each
    return joined.select(*by, F.when(F.size("s") < order, 0.0).otherwise(100 * brevity * F.exp(total)).alias("bleu"))
