"""Toxicity: a learned lexicon, found with misspellings, weighed by context.

The lexicon (words and word beginnings that speak for the label) is learned
from a bounded sample of labelled rows. Its trie is intersected with the
Levenshtein automata of its words: sets of (trie node, edits) become the states
of one automaton, which runs over all words of a block at once, letter by letter.
Hits inside quotation marks or after reporting words count apart from the rest;
hits close together count again. A logistic model on these counts gives the score.

Cases: null and empty texts have no hit and get the model's base score; without
labelled rows of both kinds every score is 0; repeated texts count once in
training; equal weights are ordered by term; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlake.llm.blocks import blocks, fetched, send, shared, spans
from loamlake.runtime import cut_lineage

# Reporting words before a hit, in the languages at hand: fixed values.
REPORTING = "said says wrote called quote quoted quoting cited reported dit écrit cité sagte schrieb zitiert dijo escribió citó".split()
FEATURES = ["plain", "misspelled", "quoted", "begun", "dense", "rate", "any_hit"]


class LexiconAutomaton:
    """Deterministic automaton of all words within ``edits`` of a term, and of all words that begin with a stem.

    Terms of fewer than ``fuzzy_from`` letters match exactly. ``delta[state, symbol]``; state 0 is dead, 1 the start.
    """

    def __init__(self, terms: Sequence[str], stems: Sequence[str], edits: int = 1, fuzzy_from: int = 5):
        entries = [*terms, *stems]
        letters = sorted(set("".join(entries)))
        self.symbol = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other letter
        nodes: list[dict[str, int]] = [{}]
        word_at, stem_at, budget = {}, {}, [0]
        for i, entry in enumerate(entries):
            node, left = 0, edits if i < len(terms) and len(entry) >= fuzzy_from else 0
            budget[0] = max(budget[0], left)
            for c in entry:
                if c not in nodes[node]:
                    nodes[node][c] = len(nodes)
                    nodes.append({})
                    budget.append(0)
                node = nodes[node][c]
                budget[node] = max(budget[node], left)
            (word_at if i < len(terms) else stem_at).setdefault(node, i)
        fuzzy = {n: i < len(terms) and len(entries[i]) >= fuzzy_from for n, i in word_at.items()}

        def closed(found: dict[int, int]) -> frozenset:
            """Adds what deletions reach: (node, least edits)."""
            todo = list(found)
            while todo:
                node = todo.pop()
                for child in nodes[node].values():
                    cost = found[node] + 1
                    if cost <= budget[child] and cost < found.get(child, edits + 1):
                        found[child] = cost
                        todo.append(child)
            return frozenset(found.items())

        def step(state: frozenset, c: str | None) -> frozenset:
            found: dict[int, int] = {}

            def reach(node: int, cost: int) -> None:
                if cost <= (budget[node] if cost else edits) and cost < found.get(node, edits + 1):
                    found[node] = cost

            for node, cost in state:
                reach(node, cost + 1)  # an extra letter
                for label, child in nodes[node].items():
                    reach(child, cost + (label != c))
            return closed(found)

        start = closed({0: 0})
        number, todo, rows = {frozenset(): 0, start: 1}, [start], {}
        while todo:
            state = todo.pop()
            row = []
            for c in [None, *letters]:
                to = step(state, c)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows[number[state]] = row
        self.delta = np.zeros((len(number), len(letters) + 1), np.int32)
        self.word = np.full(len(number), -1, np.int32)
        self.distance = np.zeros(len(number), np.int8)
        self.stem = np.full(len(number), -1, np.int32)
        for state, i in number.items():
            if i:
                self.delta[i] = rows[i]
            ends = [(cost, word_at[n]) for n, cost in state if n in word_at and (cost == 0 or fuzzy[n])]
            if ends:
                self.distance[i], self.word[i] = min(ends)
            begun = [stem_at[n] for n, cost in state if n in stem_at and cost == 0]
            if begun:
                self.stem[i] = min(begun)

    def run(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry or -1, edits or -1 for a stem) of each word ``symbols[start:end]``."""
        entry, edits = np.full(len(starts), -1, np.int32), np.zeros(len(starts), np.int8)
        live, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts
        while len(live):
            state = self.delta[state, symbols[at]]
            at = at + 1
            begun = self.stem[state]
            hit = (begun >= 0) & (entry[live] < 0)
            entry[live[hit]], edits[live[hit]] = begun[hit], -1
            over = at == ends[live]
            word = self.word[state]
            whole = over & (word >= 0) & ((entry[live] < 0) | (self.distance[state] == 0))
            entry[live[whole]], edits[live[whole]] = word[whole], self.distance[state][whole]
            more = ~over & (state != 0)
            live, state, at = live[more], state[more], at[more]
        return entry, edits


def learn_lexicon(labelled: DataFrame, most: int = 400, least_docs: int = 3, least_weight: float = 2.0) -> list[tuple[str, bool, float]]:
    """(term, is a stem, weight), best first, from the bounded rows of ``text`` and ``label``.

    Copies and near copies count once: of texts with the same least hash of four
    words in a row only one is used.
    """

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, label in zip(frame["text"], frame["label"]):
                words = re.findall(r"[^\W\d_]+", (text or "").lower())
                sign = min(pd.util.hash_array(np.array(list(map(" ".join, zip(words, words[1:], words[2:], words[3:]))) or ["".join(words)], dtype=object)))
                terms = {w for w in words if len(w) > 2} | {w[:n] + "*" for w in set(words) for n in (4, 5, 6) if len(w) >= n}
                rows.append((int(sign >> np.uint64(1)), int(label), sorted(terms)))
            yield pd.DataFrame(rows, columns=["sign", "label", "terms"])

    sets = labelled.select("text", "label").mapInPandas(prepare, "sign bigint, label int, terms array<string>")
    once = cut_lineage(sets.groupBy("sign", "label").agg(F.first("terms").alias("terms")))
    totals = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return []
    counts = once.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    weight = F.log((F.col("pos") + 0.5) / (totals[1] + 1)) - F.log((F.col("neg") + 0.5) / (totals[0] + 1))
    base, pos, neg = totals[1] / (totals[0] + totals[1]), F.col("pos"), F.col("neg")
    # How much likelier the term's labels are under its own rate than under the common one; it must outweigh the number of terms tried.
    evidence = pos * F.log(pos / (pos + neg) / base) + F.when(neg > 0, neg * F.log(neg / (pos + neg) / (1 - base))).otherwise(0.0)
    counts = cut_lineage(counts.filter(pos + neg >= least_docs))
    tried = max(counts.count(), 1)
    found = counts.withColumn("weight", weight).filter((pos >= least_docs) & (F.col("weight") >= least_weight) & (evidence >= math.log(tried)))
    best = found.orderBy((F.col("pos") * F.col("weight")).desc(), "term").limit(8 * most).collect()  # the lexicon's size is a parameter
    chosen: dict[str, tuple[int, float]] = {}
    for row in best:
        stem, bare = row["term"].endswith("*"), row["term"].rstrip("*")
        if any(bare[:n] + "*" in chosen for n in range(4, len(bare) + 1)):
            continue
        if stem and any(t.rstrip("*").startswith(bare) and row["pos"] <= 1.1 * n for t, (n, _) in chosen.items()):
            continue
        chosen[row["term"]] = (row["pos"], float(row["weight"]))
        if len(chosen) == most:
            break
    return [(t.rstrip("*"), t.endswith("*"), w) for t, (_, w) in chosen.items()]


class Scanner:
    """Counts of one lexicon's hits in texts, apart by context."""

    def __init__(self, lexicon: list[tuple[str, bool, float]], near: int = 40, before: int = 6):
        terms = [x for x in lexicon if not x[1]]
        stems = [x for x in lexicon if x[1]]
        self.near, self.before = near, before
        self.automaton = LexiconAutomaton([*(t for t, _, _ in terms), *REPORTING], [t for t, _, _ in stems])
        self.weight = np.array([*(w for _, _, w in terms), *[0.0] * len(REPORTING), *(w for _, _, w in stems)])
        self.reporting = (np.arange(len(self.weight)) >= len(terms)) & (np.arange(len(self.weight)) < len(terms) + len(REPORTING))

    def features(self, texts) -> np.ndarray:
        """texts x FEATURES."""
        lowered = [t.lower().replace("\0", " ") for t in texts]
        raw = [t.encode("utf-16-le", "surrogatepass") for t in lowered]
        data = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint16)
        size = np.fromiter((len(r) // 2 for r in raw), np.int64, len(raw)) + 1
        first = np.cumsum(size) - size
        letter = shared(("letters",), lambda: np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16))
        symbol = np.zeros(1 << 16, np.int16)
        for c, i in self.automaton.symbol.items():
            symbol[ord(c) & 0xFFFF] = i
        starts, ends = spans(letter[data])
        doc = np.searchsorted(first, starts, "right") - 1
        entry, edits = self.automaton.run(symbol[data], starts, ends)
        at = np.flatnonzero(entry >= 0)
        reporting = self.reporting[entry[at]] & (edits[at] == 0)
        said, at = at[reporting], at[~self.reporting[entry[at]]]
        n = len(raw)
        words = np.bincount(doc, minlength=n)
        out = np.zeros((n, len(FEATURES)))
        if not len(at):
            return out
        # Straight and curved quotation marks, guillemets: an odd number of them since the line began.
        marks = np.cumsum(np.isin(data, [0x22, 0x201C, 0x201D, 0x201E, 0xAB, 0xBB]))
        line = np.maximum.accumulate(np.where(np.isin(data, [0, 0x0A]), np.arange(len(data)), 0))
        quoted = (marks[starts[at]] - marks[line[starts[at]]]) % 2 == 1
        last = np.searchsorted(said, at) - 1
        told = np.zeros(len(at), bool)
        some = last >= 0
        told[some] = (at[some] - said[last[some]] <= self.before) & (doc[at[some]] == doc[said[last[some]]])
        apart = quoted | told
        weight, kind = self.weight[entry[at]], edits[at]
        close = np.zeros(len(at))
        close[1:] = (np.diff(at) <= self.near) & (np.diff(doc[at]) == 0)
        add = lambda mask: np.bincount(doc[at], weights=weight * mask, minlength=n)
        hits = np.bincount(doc[at], weights=~apart, minlength=n)
        out[:, 0], out[:, 1], out[:, 2], out[:, 3] = map(np.log1p, (add(~apart & (kind == 0)), add(~apart & (kind > 0)), add(apart), add(~apart & (kind < 0))))
        out[:, 4] = np.log1p(np.bincount(doc[at], weights=close * ~apart, minlength=n))
        out[:, 5] = np.minimum(100 * hits / np.maximum(words, 20), 20) / 10
        out[:, 6] = np.bincount(doc[at], weights=~apart & (kind <= 0), minlength=n) > 0
        return out


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 0.5, steps: int = 40) -> np.ndarray:
    """Logistic weights, the base last, by Newton's method."""
    x = np.column_stack([features, np.ones(len(features))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + keep * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep)
        w -= np.clip(np.linalg.solve(curve, slope), -5, 5)
    return w


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", train: Column | None = None, train_rows: int = 20_000) -> tuple[Scanner, np.ndarray | None]:
    """Lexicon and logistic weights; ``labels`` has the key and ``toxic``.

    ``train`` says of a label's row whether it may be learned from; at most
    ``train_rows`` of those, the first by a hash of the key, are used.
    """
    spark = docs.sparkSession
    rows = docs.select(key, F.col("text").cast("string").alias("text"))
    chosen = (labels if train is None else labels.filter(train)).select(key, F.col("toxic").cast("int").alias("label"))
    chosen = chosen.filter(f"label IN (0, 1) AND `{key}` IS NOT NULL").groupBy(key).agg(F.max("label").alias("label"))
    chosen = cut_lineage(chosen.orderBy(F.xxhash64(key), key).limit(train_rows), "labels")
    # Bounded: at most train_rows pairs of numbers. Their texts are written once and used twice.
    labelled = cut_lineage(rows.join(F.broadcast(chosen), key).select("text", "label"), "labelled")
    scanner = Scanner(learn_lexicon(labelled))
    sent = send(spark, scanner)  # bounded by the lexicon's size

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = sent()
        for frame in blocks(frames):
            made = pd.DataFrame(scanner.features(frame["text"]), columns=FEATURES, index=frame.index)
            yield pd.concat([frame[["label"]], made], axis=1)

    schema = "label int, " + ", ".join(f"{f} double" for f in FEATURES)
    sample = fetched(labelled.mapInPandas(scan, schema)).sort_values(["label", *FEATURES])  # bounded by train_rows
    known = sample["label"].nunique() == 2
    return scanner, fit(sample[FEATURES].to_numpy(), sample["label"].to_numpy()) if known else None


def with_score(docs: DataFrame, scanner: Scanner, weights: np.ndarray | None, name: str = "_score") -> DataFrame:
    """``docs`` (with ``text``) and the column ``name``, which it must not have, in one pass without a shuffle."""
    sent = send(docs.sparkSession, (scanner, weights))
    kept = [f"_c{i}" for i in range(len(docs.columns))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner, weights = sent()
        for frame in blocks(frames):
            score = np.zeros(len(frame))
            if weights is not None:
                score = 1 / (1 + np.exp(-np.clip(scanner.features(frame["text"]) @ weights[:-1] + weights[-1], -30, 30)))
            yield frame[kept].assign(_score=score)

    renamed = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, kept)], F.col("text").cast("string").alias("text"))
    types = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(kept, docs.schema))
    made = renamed.mapInPandas(run, f"{types}, _score double")
    return made.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, kept)], F.col("_score").alias(name))


def scores(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", **rules) -> DataFrame:
    """``key`` and score of every row of ``docs``; see ``learn``."""
    scored = with_score(docs.select(key, "text"), *learn(docs, labels, key=key, **rules))
    return scored.select(key, F.col("_score").alias("score"))


def keep_clean(docs: DataFrame, labels: DataFrame, *, at: float = 0.5, **rules) -> DataFrame:
    """The rows of ``docs`` whose score is below ``at``; columns of any name are passed on."""
    name = max(["_score", *docs.columns], key=len) + "_"  # longer than every name there is
    return with_score(docs, *learn(docs, labels, **rules), name).filter(F.col(f"`{name}`") < at).drop(name)
