"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document's counts. No rule is trusted: expectation-maximisation
over the vote patterns estimates how each votes on good and on bad documents, of which there is one class each, and a
document's posterior probability of being good decides. It begins by calling bad what two rules call bad, good what
none does, and leaves the rest open, so a rule whose bad votes stand alone turns out weak and is outvoted.

Nulls and empty texts have no words: they fail the base rule. Repeated rows get equal results. An empty
table gives an empty result. Extra columns are carried through untouched unless they bear a result's name,
in which case the result replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import Words, chunks, in_doc, materialise, read_table, session_defaults, tidy, utf8_parts, windows

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_marks", "n_ended_lines", "n_symbol_words")
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A document is kept when its posterior probability of being good is at least this.
KEEP_AT = 0.5

_symbol, _cont, _upper, _lower, _mark, _closing = (np.zeros(256, bool) for _ in range(6))
_symbol[list(SYMBOLS)] = True
_cont[0x80:0xC0] = True
_upper[65:91] = True
_lower[97:123] = True
_mark[list(b"!?")] = True
_closing[list(b".!?:;\"')")] = True


def _chunk_counts(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> dict[str, np.ndarray]:
    w = Words(raw, offsets, i, j)
    b, n = w.b, w.n_docs
    out = {"n_words": w.counts, "word_chars": w.per_doc(w.inside & ~_cont[b]), "n_symbols": w.per_doc(_symbol[b]), "n_marks": w.per_doc(_mark[b])}
    # lines: from the start of a text or a newline up to the next newline or the end
    breaks = np.flatnonzero(b == 10)
    start = np.concatenate((w.at[:-1], breaks + 1))
    owner = np.concatenate((np.arange(n), np.searchsorted(w.at[1:], breaks, side="right")))
    order = np.argsort(start * 2 + (np.arange(len(start)) >= n), kind="stable")
    # an empty text and the text after it start at the same place; sort by text, then place
    order = order[np.argsort(owner[order], kind="stable")]
    start, owner = start[order], owner[order]
    end = w.at[1:][owner].copy()
    same = owner[:-1] == owner[1:]
    end[:-1][same] = start[1:][same] - 1
    filled = np.concatenate(([0], np.cumsum(w.inside)))
    worded = filled[end] > filled[start]
    start, end, owner = start[worded], end[worded], owner[worded]
    out["n_lines"] = np.bincount(owner, minlength=n)
    again = pd.Series(in_doc(w.span_hash(start, end), owner)).duplicated().to_numpy() if len(start) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n)
    last_word = np.searchsorted(w.end, end, side="right") - 1
    out["n_ended_lines"] = np.bincount(owner[_closing[b[w.end[last_word] - 1]]], minlength=n) if len(start) else np.zeros(n, np.int64)
    if len(w.start):
        up, low, odd = (np.add.reduceat(t[b].astype(np.int32), w.start) for t in (_upper, _lower, _symbol))
        out["n_upper_words"] = np.bincount(w.doc[(up > 0) & (low == 0)], minlength=n)
        out["n_symbol_words"] = np.bincount(w.doc[odd > 0], minlength=n)
    else:
        out["n_upper_words"] = out["n_symbol_words"] = np.zeros(n, np.int64)
    key, doc, at = windows(w)
    covered = np.zeros(len(w.start) + 1, np.int64)
    if len(key):
        hit = at[pd.Series(in_doc(key, doc)).duplicated(keep=False).to_numpy()]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 5, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(w.doc[repeated], minlength=n)
    return out


def text_counts(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append COUNTS to the columns in `keep` (all by default), one pass over whole texts."""
    session_defaults(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in COUNTS]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), *(f"{c} bigint" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_parts(batch.column(batch.num_columns - 1))
            parts = [_chunk_counts(raw, offsets, i, j) for i, j in chunks(offsets)]
            made = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *COUNTS])

    return source.mapInArrow(tidy(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vote(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, with limits that are usual for web text. A ratio without a denominator abstains."""
    words = F.when(F.col("n_words") > 0, F.col("n_words").cast("double"))
    lines = F.when(F.col("n_lines") > 0, F.col("n_lines").cast("double"))
    mean = F.col("word_chars") / words
    symbols, odd, marks, upper, again = (F.col(c) / words for c in ("n_symbols", "n_symbol_words", "n_marks", "n_upper_words", "n_repeat_words"))
    twice, ended = F.col("n_dup_lines") / lines, F.col("n_ended_lines") / lines
    return {
        "length": _vote(words, (words < 50) | (words > 100_000), words >= 100),
        "word_size": _vote(mean, (mean < 3) | (mean > 12), (mean >= 3.5) & (mean <= 10)),
        "symbols": _vote(symbols, symbols > 0.1, symbols < 0.02),
        "plain_words": _vote(odd, odd > 0.2, odd < 0.05),
        "marks": _vote(marks, marks > 0.2, marks < 0.05),
        "capitals": _vote(upper, upper > 0.4, upper < 0.1),
        "repeats": _vote(again, again > 0.2, again <= 0.15),
        "same_lines": _vote(twice, twice > 0.5, twice <= 0.5),
        "line_ends": _vote(ended, ended < 0.1, ended > 0.6),
    }


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted vote patterns: (class weights, log-probabilities [class, rule, vote + 1]).

    Class 0 is a good document, class 1 a bad one; rules vote independently within a class. The tables are smoothed by
    one pseudo-count split by the rule's overall votes, so that no vote decides by a zero.
    """
    v = np.array([p for p, _ in patterns]) + 1
    n = np.array([c for _, c in patterns], float)
    hot = np.stack([v == k for k in range(3)], 2).astype(float)  # pattern, rule, vote
    overall = ((n[:, None, None] * hot).sum(0) + 1) / (n.sum() + 3)
    bad = np.choose(np.minimum((v == 0).sum(1), 2), (0.02, 0.5, 0.98))
    belongs = np.column_stack((1 - bad, bad))  # pattern, class
    for _ in range(rounds):
        held = (n[:, None] * belongs).sum(0) + 1e-3
        table = np.einsum("p,pc,prv->crv", n, belongs, hot) + overall
        table = np.log(table / table.sum(2, keepdims=True))
        odds = np.log(held / held.sum()) + np.einsum("prv,crv->pc", hot, table)
        new = np.exp(odds - odds.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved, belongs = np.abs(new - belongs).max(), new
        if moved < tolerance:
            break
    return np.log(held / held.sum()), table


def accuracies(weights: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How often each rule is right, by the estimate, where it votes."""
    share = np.exp(weights[:, None, None] + table)  # class, rule, vote
    right = share[0, :, 2] + share[1, :, 0]
    return right / (share[:, :, 0] + share[:, :, 2]).sum(0)


def fit(counted: DataFrame) -> Column:
    """The posterior probability of being good, as an expression over COUNTS, fitted on all rows of `counted`.

    The driver gets vote patterns with their counts only: 3 ** 9 rows at most, however large the table.
    """
    rules = list(votes().values())
    voted = counted.select(*[c.cast("int").alias(f"v{k}") for k, c in enumerate(rules)])
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*voted.columns).count().collect()]
    if not patterns:
        return F.lit(0.5)
    weights, table = fit_votes(sorted(patterns))
    ratios = table[0] - table[1]
    odds = F.lit(round(float(weights[0] - weights[1]), 9))
    for rule, row in zip(rules, ratios, strict=True):
        odds = odds + F.element_at(F.array(*[F.lit(round(float(x), 9)) for x in row]), rule.cast("int") + 2)
    return 1 / (1 + F.exp(-odds))


def with_verdict(counted: DataFrame, quality: Column, keep_at: float = KEEP_AT) -> DataFrame:
    return counted.withColumns({"base_failed": base_failed(), "quality": quality, "kept": ~base_failed() & (quality >= keep_at)})


def judge(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, keep_at: float = KEEP_AT) -> DataFrame:
    """COUNTS, base_failed, posterior `quality` and kept for every row."""
    counted = materialise(text_counts(df, text_col, keep))
    return with_verdict(counted, fit(counted), keep_at)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go. Texts are counted twice and never shuffled."""
    session_defaults(spark)
    made = {*COUNTS, "base_failed", "quality", "kept"}
    aside = {c: f"__own_{c}" for c in docs.columns if c in made}
    own = docs.withColumnsRenamed(aside)
    quality = fit(materialise(text_counts(own, keep=[])))
    return with_verdict(text_counts(own), quality).filter("kept").select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
