"""Languages of a text by mixture inference.

Every word is taken to come from one language; the likelihood of a word is that
of its byte trigrams. Expectation-maximisation estimates how much of a text each
language has; the set of languages is chosen by penalised likelihood, taking
away the least language as long as that pays.

Training counts trigrams per language over all labelled rows, in ``BINS`` bins,
so a task sends at most BINS numbers per language and the model has a fixed
size for a given number of languages.

Cases: a null text, an empty one and one without a letter give ``und`` with
score 0; without any labelled text all are ``und``; a tie goes to the language first in order;
repeated rows are predicted one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlake.llm.blocks import blocks, joined, send, spans

BINS = 1 << 16
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def trigrams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin of the trigram around each letter byte, word starts among them, words per text, letters per text)."""
    data, first, last = joined([t.lower() for t in texts])
    inside = LETTERS[data]
    clean = np.where(inside, data, 0x20).astype(np.uint32)
    code = np.empty(len(clean), np.uint32)
    code[1:-1] = clean[:-2] << 16 | clean[1:-1] << 8 | clean[2:]
    code[0] = 0x20 << 16 | clean[0] << 8 | (clean[1] if len(clean) > 1 else 0x20)
    code[-1] = 0x202020  # every text ends in a newline
    starts, ends = spans(inside)
    at = np.flatnonzero(inside)
    bins = (code[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    length = ends - starts
    words = np.searchsorted(starts, last) - np.searchsorted(starts, first)
    letters = np.searchsorted(at, last) - np.searchsorted(at, first)
    return bins, np.cumsum(length) - length, words, letters


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BINS x languages, log probabilities


def train(labelled: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Counts over all rows of ``text`` and ``lang``; the driver gets BINS numbers per language."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for frame in blocks(frames):
            for lang, part in frame.groupby("lang"):
                made = np.bincount(trigrams(part["text"])[0], minlength=BINS)
                totals[lang] = totals[lang] + made if lang in totals else made
        for lang, made in totals.items():
            bins = np.flatnonzero(made)
            yield pd.DataFrame({"lang": lang, "bin": bins.astype(np.int32), "n": made[bins]})

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInPandas(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((BINS, len(languages)), smoothing)
    for i, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        table[own["bin"].to_numpy(), i] += own["n"].to_numpy()
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32) if languages else table)


def _em(likelihood: np.ndarray, share: np.ndarray, counts: np.ndarray, begin: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares (languages x texts) after ``steps`` and the log likelihood of each text under them."""
    n = len(likelihood)
    for step in range(steps + 1):
        joint = [likelihood[i] * np.repeat(share[i], counts) for i in range(n)]
        total = np.sum(joint, axis=0)
        np.maximum(total, 1e-30, out=total)
        if step == steps:
            break
        scale = 1 / total
        share = np.stack([np.add.reduceat(joint[i] * scale, begin) for i in range(n)])
        share /= np.maximum(share.sum(axis=0), 1e-30)
    return share, np.add.reduceat(np.log(total), begin)


def mixtures(texts, model: LanguageModel, penalty: float = 1.0, steps: int = 6) -> np.ndarray:
    """Share of each language (texts x languages); a row of zeros for a text without words."""
    n = len(model.languages)
    bins, begin, words, _ = trigrams(texts)
    out = np.zeros((len(words), n))
    some = np.flatnonzero(words)
    if not n or not len(some):
        return out
    logs = np.stack([np.add.reduceat(model.table[:, i][bins], begin) for i in range(n)])
    logs -= logs.max(axis=0)
    likelihood = np.exp(np.maximum(logs, -20))
    counts = words[some]
    first = np.cumsum(counts) - counts
    share, fit = _em(likelihood, np.full((n, len(some)), 1 / n, np.float32), counts, first, steps)
    price = penalty * np.log(counts + 1)
    best, value = share, fit - n * price
    for left in range(n - 1, 0, -1):
        share = share.copy()
        share[np.where(share > 0, share, np.inf).argmin(axis=0), np.arange(len(some))] = 0
        share = np.where(share.sum(axis=0) > 0, share, best)
        share /= share.sum(axis=0)
        share, fit = _em(likelihood, share.astype(np.float32), counts, first, steps // 2 if left > 1 else 0)
        better = fit - left * price > value
        best, value = np.where(better, share, best), np.where(better, fit - left * price, value)
    out[some] = best.T
    return out


SCHEMA = "lang_pred string, score double, languages array<string>, shares array<double>"


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), **rules) -> DataFrame:
    """``keep`` columns, lang_pred, score (its share of the text), and the chosen languages with their shares, greatest first."""
    sent = send(docs.sparkSession, model)  # BINS numbers per language

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, letter = sent(), re.compile(r"[^\W\d_]").search
        names = np.array([*model.languages, "und"], dtype=object)
        for frame in blocks(frames):
            shares = mixtures(frame["text"], model, **rules)
            known = (shares.sum(axis=1) > 0) & np.fromiter((letter(t) is not None for t in frame["text"]), bool, len(frame))
            shares[~known] = 0
            order = np.argsort(-shares, axis=1, kind="stable")
            top = np.where(known, order[:, 0] if shares.shape[1] else 0, len(names) - 1)
            size = (shares > 0).sum(axis=1)
            yield frame.drop(columns="text").assign(
                lang_pred=names[top],
                score=np.clip(shares.max(axis=1, initial=0), 0, 1),
                languages=[list(names[o[:k]]) for o, k in zip(order, size)],
                shares=[s[o[:k]].tolist() for s, o, k in zip(shares, order, size)],
            )

    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInPandas(run, f"{kept}, {SCHEMA}")
