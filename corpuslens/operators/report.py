"""Markdown and JSON reports of small results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def table(rows: list[list], header: list[str]) -> str:
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])


def percent(x: float, digits: int = 1) -> str:
    return f"{x:.{digits}%}"


def markdown(title: str, df: DataFrame, formats: dict[str, str] | None = None, note: str = "") -> str:
    """A report of a small aggregate: a title, its rows as a table with a format per column, a note."""
    formats = formats or {}
    rows = [[format(r[c], formats.get(c, "")) if r[c] is not None else "" for c in df.columns] for r in df.collect()]
    return "\n".join([f"# {title}", "", table(rows, df.columns), "", *([note, ""] if note else [])])


#: Reports on a table of results: title, what it says, and the formats of its columns.
REPORTS: dict[str, tuple[str, str, dict[str, str]]] = {
    "split": ("Audit of splits", "Held-out items whose speaker or sentence is in train too, for the split as published and for the disjoint one.", {"leaked_share": ".1%"}),
    "sides": ("Sizes of splits", "Utterances, hours, speakers and sentences of each part.", {"hours": ".2f", "female_share": ".1%", "outdoor_share": ".1%"}),
    "web": ("Audit of web text", "Words by language of their sentence, documents by the language of most of their words, and words of the target language in sentences that the reference holds.", {}),
    "tokens": ("Cost in tokens", "Tokens of the same content by tokenizer and language; the tax is their number by that of the base language.", {"tokens_per_word": ".2f", "tax": ".2f"}),
    "restorer": ("Restored diacritics", "Words put back as they were, all of them, those with a mark, and those that the model had not seen.", dict.fromkeys(("word_accuracy", "baseline_accuracy", "marked_word_accuracy", "unseen_word_accuracy"), ".1%")),
    "tokenizer": ("Sub-word tokenizers", "Pieces a word on texts that were not learnt from.", {"pieces_per_word": ".3f"}),
    "translation": ("Translation", "chrF++ and BLEU of each system on each test set.", {"chrf": ".1f", "bleu": ".1f"}),
    "speech": ("Speech recognition", "Word and character error rates at three levels of leniency.", {"wer": ".1%", "cer": ".1%", "hours": ".2f"}),
    "benchmark": ("Best runs", "The run of most clips for each model and set of data.", {"wer": ".1%", "cer": ".1%"}),
}


def render(kind: str, df: DataFrame, note: str = "") -> str:
    """A report of REPORTS as Markdown; KeyError for another name. df holds a row per line of the report, in order; shares are percentages."""
    title, says, formats = REPORTS[kind]
    shares = {c: ".1%" for c in df.columns if c.startswith("share_") or c.endswith("_share")}
    return markdown(title, df, shares | formats, " ".join(filter(None, [says, note])))


def stats_report(summary: dict, lengths: dict, letters: list[tuple[str, int]], words: list[tuple[str, int]], title: str = "Corpus statistics", source: str = "") -> str:
    """The corpus report: measures, letters with diacritics, most frequent words."""
    measures = [
        ["Sentences", f"{summary['sentences']:,}"],
        ["Unique sentences", f"{summary['unique_sentences']:,}"],
        ["Word tokens", f"{summary['tokens']:,}"],
        ["Vocabulary (distinct words)", f"{summary['vocabulary']:,}"],
        ["Vocabulary with diacritics removed", f"{summary['vocabulary_without_diacritics']:,}"],
        ["Words seen only once", f"{summary['hapax_words']:,}"],
        ["Type-token ratio", f"{summary['type_token_ratio']:.3f}"],
        ["Words per sentence: mean / median", f"{lengths['mean']:.1f} / {lengths['median']:.0f}"],
        ["Words per sentence: 10th-90th percentile", f"{lengths['p10']:.0f}-{lengths['p90']:.0f} (max {lengths['max']:.0f})"],
        ["Sentences with diacritics", f"{summary['sentences_with_diacritics']:,} ({summary['diacritic_share']:.1%})"],
    ]
    parts = [f"# {title}", "", *([f"Source: {source}", ""] if source else []), table(measures, ["Measure", "Value"]), ""]
    parts += ["## Diacritic characters", "", table([[c, f"{n:,}"] for c, n in letters], ["Character", "Count"]), ""]
    parts += ["## Most frequent words", "", table([[i, w, f"{n:,}"] for i, (w, n) in enumerate(words, 1)], ["Rank", "Word", "Count"]), ""]
    return "\n".join(parts)


def dump_json(path: str, value) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.write("\n")
