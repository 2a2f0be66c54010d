"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages. A distributed randomised
decomposition of TF-IDF passages (hashed words) gives a latent space; passages
near a benchmark item in it, by cosine, are candidates. The others are candidates too
unless a bound rules them out: a run of passages whose words (and then their order, by the longest
common subsequence) cannot make up the least common part of an item. A candidate is checked by
the longest common subsequence of words and by how much of the item's answer it holds,
which lets paraphrases with changed, missing or added words through to the verdict.
The bounds lose nothing, so the verdict is that of all passages against all items, whatever ``near`` and the sample.

Document frequencies and the space cover all passages and all items. A sample (``sample_rows`` passages, least by hash, at most
``sample_rows`` / 8 of a task) only gives the decomposition of all of them its start, beside random directions.
Every passage of every document is searched against every item, in blocks of texts and ``Batch`` es of items.
The items are the query set and are sent to the tasks: more than ``most_items`` raise an error.

Cases: null and empty texts and those without a word have no passage and no leak; an empty benchmark
leaves all documents clean; equal items tie and the least id is named; repeated rows are judged one by one;
other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlake.llm.blocks import U, blocks, fetched, mix, ramp, send, word_hashes
from loamlake.runtime import cut_lineage, forget

FEATURES = 1 << 13
WORDS = np.zeros(256, bool)
WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def hashed_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text); letters and digits, A-Z lower-cased."""
    words, counts, *_ = word_hashes(texts, WORDS)
    return words, counts


def bins_of(words: np.ndarray) -> np.ndarray:
    return (words >> U(64 - 13)).astype(np.int64)


def strides(counts: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of every stride of ``stride`` words, strides per text)."""
    per = -(-counts // stride)
    begin = np.repeat(np.cumsum(counts) - counts, per) + ramp(per) * stride
    return begin, per


def stride_bins(bins: np.ndarray, sizes: np.ndarray, stride: int) -> np.ndarray:
    """Distinct ones of ``bins``, in which strides of ``sizes`` stand one after another, of every stride."""
    rows = np.full((len(sizes), stride), -1, np.int16)
    rows[np.arange(stride) < sizes[:, None]] = bins
    rows.sort(axis=1)
    new = rows >= 0
    new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
    return rows[new]


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]


@dataclass
class Space:
    """idf and the map of hashed words to latent coordinates."""

    idf: np.ndarray
    basis: np.ndarray  # FEATURES x rank, idf included


def gram_product(rows: list[np.ndarray], q: np.ndarray, idf: np.ndarray, chunk: int = 512) -> np.ndarray:
    """A'A q for the TF-IDF rows A (of length one) of lists of words, a chunk of rows at a time."""
    out = np.zeros(q.shape, np.float32)
    for begin in range(0, len(rows), chunk):
        some = rows[begin : begin + chunk]
        owner = np.repeat(np.arange(len(some)), [len(w) for w in some])
        a = np.bincount(owner * FEATURES + bins_of(np.concatenate(some)), minlength=len(some) * FEATURES).reshape(len(some), FEATURES)
        a = unit(a * idf).astype(np.float32)
        out += a.T @ (a @ q)
    return out


def passage_sums(parts: np.ndarray, doc: np.ndarray, per_passage: int) -> np.ndarray:
    """Of the strides that begin with each, up to ``per_passage`` of a text (``doc``), the sum of ``parts``."""
    out = parts.copy()
    for j in range(1, min(per_passage, len(doc))):
        last = np.flatnonzero(doc[j:] != doc[:-j])  # of a text: they take none from the next
        kept = out[last]
        out[:-j] += parts[j:]
        out[last] = kept
    return out


def passage_squares(bins: np.ndarray, begin: np.ndarray, ends: np.ndarray, length: int, idf: np.ndarray, some: int = 1 << 12) -> np.ndarray:
    """Squared length of the TF-IDF row of every passage bins[begin:end] of at most ``length`` words."""
    weight, out, sizes = np.append(idf**2, 0.0), np.zeros(len(begin)), ends - begin  # bin -1 stands for no word
    windows = np.lib.stride_tricks.sliding_window_view(np.append(bins, np.full(length, -1)).astype(np.int16), length)
    for at in range(0, len(begin), some):
        rows = np.full((len(begin[at : at + some]), length + 1), -2, np.int16)
        words = windows[begin[at : at + some]]
        short = np.flatnonzero(sizes[at : at + some] < length)
        words[short] = np.where(np.arange(length) < sizes[at : at + some][short, None], words[short], -1)
        words.sort(axis=1)
        rows[:, :-1] = words
        total, flat = weight[words].sum(axis=1), rows.ravel()
        same = np.flatnonzero((flat[1:] == flat[:-1]) & (flat[1:] >= 0))
        lag = 1
        while len(same):  # equal words stand side by side: every pair of them counts twice
            total += 2 * np.bincount(same // (length + 1), weight[flat[same]], len(rows))
            lag += 1
            same = same[flat[np.minimum(same + lag, len(flat) - 1)] == flat[same]]
        out[at : at + some] = total
    return out


class Common:
    """Words of runs (``owner``): the ``dense`` commonest bins as a matrix of counts, owner x bin, the others one by one."""

    def __init__(self, bins: np.ndarray, owner: np.ndarray, owners: int, dense: int = 128):
        self.bins = np.argsort(-np.bincount(bins, minlength=FEATURES), kind="stable")[:dense]
        number = np.full(FEATURES, -1, np.int32)
        number[self.bins] = np.arange(dense)
        column = number[bins]
        common = column >= 0
        self.counts = np.bincount(owner[common] * dense + column[common], minlength=owners * dense).reshape(owners, dense).astype(np.float32)
        rest = np.flatnonzero(~common)
        self.rest, self.owner = bins[rest], owner[rest]

    def sums(self, basis: np.ndarray) -> np.ndarray:
        """Of every owner, the sum of the rows of ``basis`` of its words."""
        out = self.counts @ basis[self.bins]
        add_runs(out, self.owner, basis, self.rest)
        return out

    def add_back(self, out: np.ndarray, rows: np.ndarray) -> None:
        """Add the row of a word's owner to its bin, for all words."""
        out[self.bins] += self.counts.T @ rows
        order = np.argsort(self.rest.astype(np.int16), kind="stable")
        add_runs(out, self.rest[order], rows, self.owner[order])


def add_runs(out: np.ndarray, to: np.ndarray, rows: np.ndarray, take: np.ndarray) -> None:
    """Add rows[take] to out[to], in which equal numbers stand side by side: the k-th of every run at a time."""
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)])
    size = np.diff(first, append=len(to))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    total = np.zeros((len(first), rows.shape[1]), np.float32)
    for k in range(int(size[0]) if len(size) else 0):
        held = int(np.searchsorted(-size, -k, "left"))  # runs of more than k
        total[:held] += rows[take[first[:held] + k]]
    out[to[first]] += total


def text_product(bins: np.ndarray, counts: np.ndarray, q: np.ndarray, idf: np.ndarray, stride: int, per_passage: int, out: np.ndarray) -> None:
    """Add ``gram_product`` of all passages of texts, but for the last factor idf, to ``out``; passages share the sums of their strides."""
    begin, per = strides(counts, stride)
    doc = np.repeat(np.arange(len(counts)), per)
    sizes = np.diff(begin, append=len(bins))
    ends = np.minimum(begin + stride * per_passage, np.repeat(np.cumsum(counts), per))
    squares = np.maximum(passage_squares(bins, begin, ends, stride * per_passage, idf), 1e-18)
    words = Common(bins, np.repeat(np.arange(len(begin)), sizes), len(begin))
    parts = words.sums(q)
    rows = passage_sums(parts, doc, per_passage) / squares.astype(np.float32)[:, None]
    words.add_back(out, passage_sums(rows[::-1], doc[::-1], per_passage)[::-1])  # what the passages that hold a stride add to its words


def fit(docs: DataFrame, items: Items, *, stride: int, per_passage: int, rank: int, sample_rows: int, power: int = 2, extra: int = 16) -> Space:
    """Document frequencies of all passages' strides, then the randomised decomposition of all passages and items.

    ``power`` products over the sample and the items give the directions to start with, ``extra`` random ones are put beside them;
    one product over every passage of every text then makes the space (Nystrom's form), whatever the sample missed.
    """
    spark = docs.sparkSession
    per_task = max(1, sample_rows // 8)

    def text_rows(texts: list[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"sign": 0, "words": pd.Series([None] * len(texts), dtype=object), "bin": -2, "n": 0, "text": pd.Series(texts, dtype=object)})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen, size = np.zeros(FEATURES, np.int64), 0, 0
        keys, passages, texts = np.zeros(0, np.int64), [], []
        for frame in blocks(frames, 1 << 18):
            words, counts = hashed_words(frame["text"])
            begin, per = strides(counts, stride)
            if not len(begin):
                continue
            bins = bins_of(words)
            total += np.bincount(stride_bins(bins, np.diff(begin, append=len(words)), stride), minlength=FEATURES)
            held, ends = bins.astype(np.int16).tobytes(), 2 * np.cumsum(counts)
            texts += [held[a:b] for a, b in zip((ends - 2 * counts).tolist(), ends.tolist()) if b > a]
            size += len(held)
            if size > 1 << 21:
                yield text_rows(texts)
                texts, size = [], 0
            seen += len(begin)
            sign = mix(np.add.reduceat(words, begin)).view(np.int64)
            least = np.argsort(sign)[:per_task]
            if len(keys) == per_task:
                least = least[sign[least] < keys[-1]]
            ends = np.minimum(begin + stride * per_passage, np.repeat(np.cumsum(counts), per))
            more = [words[begin[i] : ends[i]].view(np.int64) for i in least]
            keys, passages = np.concatenate([keys, sign[least]]), passages + more
            order = np.argsort(keys, kind="stable")[:per_task]
            keys, passages = keys[order], [passages[i] for i in order]
        yield text_rows(texts)
        yield pd.DataFrame({"sign": keys, "words": pd.Series(passages, dtype=object)}).assign(bin=-1, n=0, text=None)
        bins = np.flatnonzero(total)
        none = pd.Series([None] * (len(bins) + 1), dtype=object)
        yield pd.DataFrame({"sign": 0, "words": none, "bin": [*bins, FEATURES], "n": [*total[bins], seen], "text": none})

    made = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "sign bigint, words array<bigint>, bin int, n bigint, text binary")
    made = cut_lineage(made, "passages")
    counts = fetched(made.filter("bin >= 0").groupBy("bin").agg(F.sum("n").alias("n")))  # FEATURES + 1 numbers
    n = np.zeros(FEATURES + 1)
    n[counts["bin"].to_numpy()] = counts["n"].to_numpy()
    idf = np.log((n[FEATURES] + 1) / (n[:FEATURES] + 1)) + 0.1
    sample = made.filter("bin = -1").dropDuplicates(["sign"]).orderBy("sign").limit(sample_rows).select("words")
    sample = cut_lineage(sample.repartition(8), "sample")  # bounded by sample_rows

    wide, rng = min(rank, FEATURES - extra), np.random.default_rng(11)
    q = rng.standard_normal((FEATURES, wide + extra))
    for _ in range(power):
        q = np.linalg.qr(q)[0].astype(np.float32)
        sent = send(spark, (q, idf))

        def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q, idf = sent()
            out = np.zeros(q.shape, np.float32)
            for frame in frames:
                out += gram_product([np.asarray(w, np.int64).view(U) for w in frame["words"]], q, idf)
            yield pd.DataFrame({"z": [out.tobytes()]})

        z = gram_product(items.words, q, idf).astype(float)
        for r in sample.mapInPandas(multiply, "z binary").toLocalIterator():  # eight of them
            z += np.frombuffer(r["z"], np.float32).reshape(q.shape)
        q = z
    vectors, values, _ = np.linalg.svd(q, full_matrices=False)
    vectors = vectors[:, : min(wide, int((values > 1e-6 * values[0]).sum()))]
    fresh = rng.standard_normal((FEATURES, wide + extra - vectors.shape[1]))
    q = np.linalg.qr(np.hstack([vectors, fresh]))[0].astype(np.float32)
    z = gram_product(items.words, q, idf).astype(float) + whole_product(made.filter("bin = -2").select("text"), q, idf, stride, per_passage)
    forget(made, sample)
    values, vectors = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    sure = values > 1e-6 * values[-1]
    vectors, values, _ = np.linalg.svd(z @ (vectors[:, sure] * values[sure] ** -0.5), full_matrices=False)
    scale = np.maximum(values[:rank] ** 2, 1e-9) ** -0.25  # singular values to the power -1/2: rare directions count more
    return Space(idf, (idf[:, None] * vectors[:, :rank] * scale).astype(np.float32))


def whole_product(texts: DataFrame, q: np.ndarray, idf: np.ndarray, stride: int, per_passage: int, group: int = 16) -> np.ndarray:
    """``gram_product`` of all passages of ``texts``, the bins of their words; tasks' sums are added by ``group`` bins, so the driver gets one table."""
    sent = send(texts.sparkSession, (q, idf))
    schema = "bin int, z binary"

    def rows(total: np.ndarray, bins: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"bin": bins, "z": [total[b : b + group].astype(np.float32).tobytes() for b in bins]})

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, idf = sent()
        basis, total = (idf[:, None] * q).astype(np.float32), np.zeros(q.shape)
        for frame in frames:
            sizes = frame["text"].str.len().to_numpy() // 2
            part = np.cumsum(sizes) >> 17  # about so many words at a time
            for _, some in frame.groupby(part)["text"]:
                out = np.zeros(q.shape, np.float32)
                bins = np.frombuffer(b"".join(some), np.int16).astype(np.int64)
                text_product(bins, some.str.len().to_numpy() // 2, basis, idf, stride, per_passage, out)
                total += out
        yield rows(total * idf[:, None], np.arange(0, FEATURES, group))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(shape), set()
        for frame in frames:
            for b, z in zip(frame["bin"], frame["z"]):
                total[b : b + group] += np.frombuffer(z, np.float32).reshape(-1, shape[1])
            seen.update(frame["bin"].tolist())
        yield rows(total, np.array(sorted(seen), np.int64))

    shape = q.shape
    out = np.zeros(shape)
    for r in fetched(texts.mapInPandas(multiply, schema).repartition("bin").mapInPandas(add, schema)).itertuples():  # FEATURES / group rows
        out[r.bin : r.bin + group] = np.frombuffer(r.z, np.float32).reshape(-1, shape[1])
    return out


def embed(words: np.ndarray, begin: np.ndarray, space: Space) -> np.ndarray:
    """Sums of the latent words from each of ``begin`` to the next."""
    return np.add.reduceat(space.basis[bins_of(words)], begin, axis=0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, np.int32)
    for word in a:
        step = row.copy()
        step[1:] = np.maximum(row[1:], row[:-1] + (b == word))
        row = np.maximum.accumulate(step)
    return int(row[-1])


@dataclass
class Batch:
    """Items of like length, with the places of each word in them as bits."""

    at: np.ndarray  # which items
    sizes: np.ndarray
    vocabulary: np.ndarray  # where its words are among those of all items
    times: np.ndarray  # words x items: how often
    bits: list[np.ndarray]  # words * items, for every 64 places


class Vocabulary:
    """Words of all items, found by their first bits before they are searched: most words of a text are no item's."""

    def __init__(self, items: Items):
        self.words = np.unique(np.concatenate(items.words))
        self.shift = U(64 - min(24, max(8, len(self.words).bit_length() + 4)))
        self.held = np.zeros(1 << (64 - int(self.shift)), bool)
        self.held[self.words >> self.shift] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, number of the word) of those that are an item's."""
        place = np.flatnonzero(self.held[words >> self.shift])
        number = np.minimum(np.searchsorted(self.words, words[place]), len(self.words) - 1)
        same = self.words[number] == words[place]
        return place[same], number[same]


def batched(items: Items, vocabulary: Vocabulary, size: int = 64) -> list[Batch]:
    """All items, ``size`` at a time in order of length."""
    lengths = np.array([len(w) for w in items.words])
    order, out = np.argsort(lengths, kind="stable"), []
    for begin in range(0, len(order), size):
        at = order[begin : begin + size]
        own = np.unique(np.concatenate([items.words[i] for i in at]))
        times = np.zeros((len(own), len(at)), np.float32)
        bits = np.zeros((-(-int(lengths[at].max()) // 64), len(own), len(at)), U)
        for j, i in enumerate(at):
            ids = np.searchsorted(own, items.words[i])
            np.add.at(times, (ids, j), 1)
            place = np.arange(len(ids))
            np.bitwise_or.at(bits, (place // 64, ids, j), U(1) << (place % 64).astype(U))
        out.append(Batch(at, lengths[at], np.searchsorted(vocabulary.words, own), times, [b.ravel() for b in bits]))
    return out


def subsequences(batch: Batch, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, item: np.ndarray, some: int = 1 << 13) -> np.ndarray:
    """``common_subsequence`` of ids[start:end] and an item of the batch, for many pairs: bit-parallel, 64 places of the item at a time."""
    out, row = np.zeros(len(starts), np.int64), ids * len(batch.at)
    order = np.argsort(ends - starts, kind="stable")
    for begin in range(0, len(order), some):
        now = order[begin : begin + some]
        first, sizes, j = starts[now], (ends - starts)[now], item[now]
        state = [np.full(len(now), ~U(0)) for _ in batch.bits]
        for step, ended in enumerate(np.searchsorted(sizes, np.arange(sizes[-1]), "right").tolist()):  # pairs before it have ended
            flat = row[first[ended:] + step] + j[ended:]
            carry = None
            for k, table in enumerate(batch.bits):
                old = state[k][ended:]
                met = old & table[flat]
                new = old + met
                if len(state) > 1:
                    over = new < old
                    if carry is not None:
                        new = new + carry
                        over |= new < carry
                    carry = over.astype(U)
                state[k][ended:] = new | (old - met)
        out[now] = sum(np.bitwise_count(~s).astype(np.int64) for s in state)
    return out


def read_items(benchmark: DataFrame, key: str = "item_id", most_items: int = 100_000) -> Items:
    """The items, bounded by ``most_items``; the answer is the column ``answer`` or else the closing quarter of the words."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col(key).alias("id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).orderBy("id", "text").limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError(f"more than {most_items} benchmark items: search them in parts")
    items = Items([], [], [])
    for r in rows:
        words, _ = hashed_words([r["text"] or ""])
        if len(words):
            own, _ = hashed_words([r["answer"] or ""])
            items.ids.append(r["id"])
            items.words.append(words)
            items.answers.append(own if len(own) else words[-max(3, len(words) // 4) :])
    return items


SCHEMA = "leaked boolean, item_id bigint, n_items int, cosine double, common double, answer double"


def judge(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    stride: int = 16,
    per_passage: int = 3,
    rank: int = 160,
    sample_rows: int = 16_384,
    near: float = 0.55,
    least_common: float = 0.5,
    sure_common: float = 0.75,
    least_answer: float = 0.6,
) -> DataFrame:
    """``docs`` with leaked, the item with the largest common part, how many items leak, and the figures of that item.

    Leaked: ``sure_common`` of an item's words stand in the text in order, or
    ``least_common`` of them with ``least_answer`` of the answer's.
    """
    items = read_items(benchmark)
    kept = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, kept)], F.col("text").cast("string").alias("text"))
    if items.ids:
        space = fit(docs, items, stride=stride, per_passage=per_passage, rank=rank, sample_rows=sample_rows)
        lengths = [len(w) for w in items.words]
        centre = unit(embed(np.concatenate(items.words), np.cumsum(lengths) - lengths, space))
        sent = send(docs.sparkSession, (items, space, centre.astype(np.float32)))  # bounded by most_items

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if items_known:
            items, space, centre = sent()
            vocabulary = Vocabulary(items)
            batches = batched(items, vocabulary)
        for frame in blocks(frames, 1 << 18):
            best = [(False, None, 0, 0.0, 0.0, 0.0)] * len(frame)
            if items_known:
                words, counts = hashed_words(frame["text"])
                for doc, found in candidates(words, counts, items, vocabulary, batches, space, centre, stride, per_passage, near, least_common).items():
                    good = []
                    for item, cosine, share, region in found:
                        answer = common_subsequence(items.answers[item], region) / len(items.answers[item])
                        if share >= sure_common or answer >= least_answer:
                            good.append((share, answer, cosine, -item))
                    if good:
                        share, answer, cosine, item = max(good)
                        best[doc] = (True, items.ids[-item], len({g[3] for g in good}), cosine, share, answer)
            made = pd.DataFrame(best, columns=["leaked", "item_id", "n_items", "cosine", "common", "answer"], index=frame.index)
            made["item_id"] = made["item_id"].astype("Int64")
            yield pd.concat([frame[kept], made], axis=1)

    items_known = bool(items.ids)
    types = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(kept, docs.schema))
    made = plain.mapInPandas(run, f"{types}, {SCHEMA}")
    return made.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, kept)], *[c for c in made.columns if c not in kept])


def candidates(words, counts, items, vocabulary, batches, space, centre, stride, per_passage, near, least_common, run: int = 8) -> dict[int, list]:
    """text -> [(item, cosine, share, words around)] of all passages that hold ``least_common`` of an item's words in order.

    Passages near an item are compared at once; the others in runs of ``run``, which are left out where all words
    around a run hold too few of the item's.
    """
    begin, per = strides(counts, stride)
    out: dict[int, list] = {}
    if not len(begin):
        return out
    parts = Common(bins_of(words), np.repeat(np.arange(len(begin)), np.diff(begin, append=len(words))), len(begin)).sums(space.basis)
    doc = np.repeat(np.arange(len(counts)), per)
    passage = unit(passage_sums(parts, doc, per_passage))
    last = np.cumsum(counts)
    first = last - counts
    rank = ramp(per)
    heads = np.flatnonzero(rank % run == 0)  # runs end with their text
    tails = np.append(heads[1:], len(begin)) - 1
    place, number = vocabulary.find(words)
    id_of = np.full(len(vocabulary.words), -1, np.int64)
    for batch in batches:
        id_of[batch.vocabulary] = np.arange(len(batch.vocabulary))
        ids = id_of[number]
        id_of[batch.vocabulary] = -1
        known = np.zeros(len(words), bool)
        known[place[ids >= 0]] = True
        ids, before = ids[ids >= 0], np.append(0, np.cumsum(known))  # other words are in no common part
        need = np.ceil(least_common * batch.sizes - 1e-9)

        def around(p, q, n):
            return np.maximum(first[doc[p]], begin[p] - n), np.minimum(last[doc[p]], begin[q] + stride * per_passage + n)

        a, b = (before[x] for x in around(heads, tails, int(batch.sizes.max())))
        held = np.zeros((len(heads), len(batch.vocabulary)), np.float32)
        held[np.repeat(np.arange(len(heads)), b - a), ids[np.repeat(a, b - a) + ramp(b - a)]] = 1
        r, j = np.nonzero(held @ batch.times >= need)
        whole = subsequences(batch, ids, a[r], b[r], j) >= need[j]
        r, j = r[whole], j[whole]
        size = tails[r] - heads[r] + 1
        pairs = [(np.repeat(heads[r], size) + ramp(size)) * len(batch.at) + np.repeat(j, size)]
        for block in range(0, len(passage), 8192):
            pairs.append(np.flatnonzero(passage[block : block + 8192] @ centre[batch.at].T >= near) + block * len(batch.at))
        p, j = np.divmod(np.unique(np.concatenate(pairs)), len(batch.at))
        a, b = around(p, p, batch.sizes[j])
        share = subsequences(batch, ids, before[a], before[b], j)
        for k in np.flatnonzero(share >= need[j]).tolist():
            i = int(batch.at[j[k]])
            cosine = float(passage[p[k]] @ centre[i])
            out.setdefault(int(doc[p[k]]), []).append((i, cosine, int(share[k]) / len(items.words[i]), words[a[k] : b[k]]))
    return out
