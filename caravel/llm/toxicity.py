"""Toxic spans and document scores by a linear-chain conditional random field.

No tokens are labelled in the corpus, so document labels become token labels: in a toxic
document, a word is toxic if it, or the beginning it shares with others, stands in clearly
more different contexts of toxic documents than of clean ones (contexts, so that copies of
one document count once). Two-state chains over windows of a text's words learn from these;
forward-backward gives each token's marginal. A document's marginals (their sum, maximum
and mean) are turned into a probability of label 1 by a logistic regression, fitted on
documents that the chain it sees has not learned from.

Only the fit is bounded, by `fit_docs` and `fit_chars`: two tasks see that sample, one for
the chain and one for the regression, and the driver gets the weights alone. Scoring covers
every word of every text, window by window, where the rows are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.llm.shared import rows_per_batch

WORD = re.compile(r"\w+")
BITS = 17
SIZE = 1 << BITS
#: Letters of a word's beginning; shorter words have none of their own.
STEM = 5
#: Words in one chain, and chains that are computed at once.
WINDOW = 256
CHAINS = 1024
FIT_DOCS = 6000
FIT_CHARS = 18_000_000
#: A word or beginning is toxic evidence from so many contexts, so many times likelier
#: than in clean documents.
CONTEXTS, TIMES = 5, 20.0
STEM_CONTEXTS, STEM_TIMES = 20, 8.0
#: Words whose numbers are kept by a worker.
MEMORY = 500_000


class Numbers(dict):
    """word -> numbers in 1..2^BITS-1 of its lower case and of its beginning, as one; 0
    stands for no word and for no beginning.
    """

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        low = word.lower()
        of = lambda x: 1 + zlib.crc32(x.encode()) % (SIZE - 1)
        value = self[word] = of(low) | (of(low[:STEM]) if len(low) > STEM else 0) << BITS
        return value


NUMBERS = Numbers()


def windows(texts: Iterable[str], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers as rows of `width` (0: none), and each row's document."""
    get, rows, owners = NUMBERS.__getitem__, [], []
    for d, text in enumerate(texts):
        found = WORD.findall(text)
        n = -(-len(found) // width)
        if n:
            row = np.zeros(n * width, np.int64)
            row[: len(found)] = np.fromiter(map(get, found), np.int64, len(found))
            rows.append(row.reshape(n, width))
            owners += [d] * n
    return (np.concatenate(rows) if rows else np.zeros((0, width), np.int64)), np.array(owners, np.int64)


@dataclass
class Chain:
    """Log-odds of the state toxic from the word, its beginning, the words beside it and
    the state before.
    """

    word: np.ndarray
    stem: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    moves: np.ndarray  # [from, to], log

    def emissions(self, both: np.ndarray) -> np.ndarray:
        ids, stems = both & (SIZE - 1), both >> BITS
        e = self.word[ids] + self.stem[stems] + self.bias
        e[:, 1:] += self.before[ids[:, :-1]]
        e[:, :-1] += self.after[ids[:, 1:]]
        return e

    def marginals(self, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """P(toxic) of each word (0 where there is none), the forward and backward ratios
        of the two states, and the words' own odds. Empty places at a row's end change
        nothing before them: they carry the backward ratio 1.
        """
        x = np.exp(np.clip(self.emissions(both), -30, 30)).T.copy()
        there = (both != 0).T
        t = np.exp(self.moves)
        ahead, back = np.empty_like(x), np.ones_like(x)
        if len(x):
            ahead[0] = x[0]
        for i in range(1, len(x)):
            r = ahead[i - 1]
            ahead[i] = x[i] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
        for i in range(len(x) - 2, -1, -1):
            r = x[i + 1] * back[i + 1]
            back[i] = np.where(there[i + 1], (t[1, 0] + r * t[1, 1]) / (t[0, 0] + r * t[0, 1]), 1.0)
        odds = ahead * back
        return np.where(there, odds / (1 + odds), 0.0).T, ahead, back, x


class Adam:
    def __init__(self, shape: int | tuple[int, ...], pace: float):
        self.first, self.second, self.pace, self.step = np.zeros(shape), np.zeros(shape), pace, 0

    def __call__(self, gradient: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        return self.pace * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-7)


def fit_chain(both: np.ndarray, truth: np.ndarray, rounds: int = 40, penalty: float = 1e-6) -> Chain:
    """Adam on the likelihood of all chains at once; its gradient is what was seen less
    what the marginals expect. It is summed over `CHAINS` chains at a time, so that the
    memory needed is theirs, not the sample's.
    """
    n = max(1, int((both != 0).sum()))
    rate = (truth.sum() + 1) / (n + 2)
    chain = Chain(*(np.zeros(SIZE) for _ in range(4)), float(np.log(rate / (1 - rate))), np.zeros((2, 2)))
    params = [chain.word, chain.stem, chain.before, chain.after]
    paces, move_pace = [Adam(SIZE, 0.3) for _ in params], Adam((2, 2), 0.05)
    for _ in range(rounds):
        grads, move_gap = [np.zeros(SIZE) for _ in params], np.zeros((2, 2))
        for at in range(0, len(both), CHAINS):
            own, is_toxic = both[at : at + CHAINS], truth[at : at + CHAINS]
            ids, stems = own & (SIZE - 1), own >> BITS
            there = own != 0
            p, ahead, back, x = chain.marginals(own)
            gap = np.where(there, is_toxic - p, 0.0)
            places = [(ids, gap), (stems, gap), (ids[:, :-1], gap[:, 1:]), (ids[:, 1:], gap[:, :-1])]
            for g, (i, w) in zip(grads, places):
                g += np.bincount(i.ravel(), w.ravel(), SIZE)
            t, r, right = np.exp(chain.moves), ahead[:-1], x[1:] * back[1:]
            joint = np.stack([np.full_like(r, t[0, 0]), t[0, 1] * right, t[1, 0] * r, t[1, 1] * r * right])
            pair = there[:, 1:]
            joint = joint / joint.sum(axis=0) * pair.T
            seen = [(pair & (is_toxic[:, :-1] == a) & (is_toxic[:, 1:] == b)).sum() for a in (0, 1) for b in (0, 1)]
            move_gap += np.reshape(seen, (2, 2)) - joint.sum(axis=(1, 2)).reshape(2, 2)
        grads[1][0] = 0.0
        for w, g, pace in zip(params, grads, paces):
            w += pace(g / n - penalty * w)
        chain.moves = chain.moves + move_pace(move_gap / n)
    return chain


def evidence(both: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word number, and each number of a beginning, stands in many more
    contexts of toxic documents.
    """
    ids, there = both & (SIZE - 1), both != 0
    sides = np.pad(ids, ((0, 0), (1, 1)))
    context = (sides[:, :-2] << BITS | sides[:, 2:])[there]
    label = np.broadcast_to(toxic[:, None], both.shape)[there]
    found = []
    for of, contexts, times in ((ids[there], CONTEXTS, TIMES), ((both >> BITS)[there], STEM_CONTEXTS, STEM_TIMES)):
        a, b = (np.bincount(np.unique(of[label == side] << 2 * BITS | context[label == side]) >> 2 * BITS, minlength=SIZE) for side in (True, False))
        ratio = ((a + 0.5) / (a.sum() + 1)) / ((b + 0.5) / (b.sum() + 1))
        found.append((a >= contexts) & (ratio >= times))
    found[1][0] = False
    return found[0], found[1]


def chain_of(texts: list[str], toxic: np.ndarray) -> Chain:
    both, owners = windows(texts)
    of_row = toxic[owners]
    words, stems = evidence(both, of_row)
    truth = (words[both & (SIZE - 1)] | stems[both >> BITS]) & of_row[:, None] & (both != 0)
    return fit_chain(both, truth.astype(np.float32))


@dataclass
class Model:
    chain: Chain | None
    weights: np.ndarray  # of 1, log(1 + sum), maximum and mean of the marginals
    rate: float  # of label 1, the score where there is no chain

    def marks(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, float]]]]:
        """(sum, maximum, mean) of each document's marginals; its words of 0.5 or more."""
        sums, most, n = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        found: list[list[tuple[int, float]]] = [[] for _ in texts]
        if self.chain is not None:
            ids, owners = windows(texts)
            for at in range(0, len(ids), CHAINS):
                own, of = ids[at : at + CHAINS], owners[at : at + CHAINS]
                p = self.chain.marginals(own)[0]
                np.add.at(sums, of, p.sum(axis=1))
                np.maximum.at(most, of, p.max(axis=1))
                np.add.at(n, of, (own != 0).sum(axis=1))
                firsts = at + np.arange(len(own)) - np.searchsorted(owners, of)
                for row, col in zip(*np.nonzero(p >= 0.5)):
                    found[of[row]].append((int(firsts[row]) * WINDOW + int(col), float(p[row, col])))
        return np.stack([np.ones(len(texts)), np.log1p(sums), most, sums / np.maximum(n, 1)], axis=1), found

    def scores(self, marks: np.ndarray) -> np.ndarray:
        if self.chain is None:
            return np.full(len(marks), self.rate)
        return 1 / (1 + np.exp(-np.clip(marks @ self.weights, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    w, total = np.zeros(x.shape[1]), weight.sum()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / total + penalty * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) / total - penalty * w)
    return w


def sampled(docs: DataFrame, labels: DataFrame, usable: Column | None, fit_docs: int, fit_chars: int) -> tuple[DataFrame, float]:
    """text and toxic (boolean) of the documents that are fitted on, and the rate of label 1."""
    truth = labels.filter("doc_id is not null and toxic is not null")
    truth = (truth if usable is None else truth.filter(usable)).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("__toxic"))
    counts = {r["__toxic"]: r["count"] for r in truth.groupBy("__toxic").count().collect()}
    few = min(counts.get(0, 0), counts.get(1, 0), fit_docs // 2)
    share = {k: min(1.0, (few if n == min(counts.values()) else fit_docs - few) / n) for k, n in counts.items()}
    chosen = F.when(F.col("__toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    some = truth.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6 < chosen)
    # `some` has about fit_docs rows at any size of the input
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").filter("text is not null")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    part = min(1.0, fit_chars / max(chars, 1))
    # whole documents at every size: a label holds for its document, not for its pieces
    rows = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1e6 < part)
    return rows.select("text", (F.col("__toxic") == 1).alias("toxic")), counts.get(1, 0) / max(1, sum(counts.values()))


def weights_of(texts: list[str], toxic: np.ndarray, rate: float) -> np.ndarray:
    """The regression's weights: every fourth document, copies of one text together, is kept
    from a chain, and its marks are weighed.
    """
    apart = np.array([zlib.crc32(t.encode()) % 4 == 0 for t in texts])
    weigh = apart if len({*toxic[apart]}) == 2 and len({*toxic[~apart]}) == 2 else np.ones(len(texts), bool)
    learn = ~apart if weigh is apart else weigh
    of = lambda which: [t for t, keep in zip(texts, which) if keep]
    marks, y = Model(chain_of(of(learn), toxic[learn]), np.zeros(4), rate).marks(of(weigh))[0], toxic[weigh]
    # the sample's labels are not as frequent as all
    return fit_logistic(marks, y.astype(float), np.where(y, rate / y.mean(), (1 - rate) / (1 - y.mean())))


FITTED = "job string, word binary, stem binary, before binary, after binary, bias double, moves array<double>, weights array<double>"


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> Model:
    """Fits on about `fit_docs` labelled documents, half of each label as far as there are
    so many, chosen by a hash of doc_id, and of these on whole documents, chosen by another
    hash, of about `fit_chars` characters together.
    `usable` says which rows of `labels` may be learned from. Of repeated labels the larger
    holds; nulls are left out. Without both labels every document gets the rate of label 1.
    """
    rows, rate = sampled(docs, labels, usable, fit_docs, fit_chars)

    def work(key: tuple, sample: pa.Table) -> pa.Table:
        pairs = sorted(zip(sample["text"].to_pylist(), sample["toxic"].to_pylist()))
        texts, toxic = [t for t, _ in pairs], np.array([y for _, y in pairs], bool)
        found: dict = dict.fromkeys(("word", "stem", "before", "after", "bias", "moves", "weights"))
        if not toxic.all() and toxic.any():
            if key[0].as_py() == "weights":
                found["weights"] = weights_of(texts, toxic, rate).tolist()
            else:
                chain = chain_of(texts, toxic)
                found |= {n: getattr(chain, n).astype("<f4").tobytes() for n in ("word", "stem", "before", "after")}
                found |= {"bias": chain.bias, "moves": chain.moves.ravel().tolist()}
        kinds = [pa.string(), *[pa.binary()] * 4, pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array([v], k) for v, k in zip([key[0].as_py(), *found.values()], kinds)], ["job", *found])

    # two groups, each the whole sample, of about fit_chars characters at most
    jobs = rows.withColumn("job", F.explode(F.array(F.lit("chain"), F.lit("weights"))))
    got = {r.job: r for r in jobs.groupBy("job").applyInArrow(work, FITTED).collect()}
    if not got or got["weights"].weights is None:
        return Model(None, np.zeros(4), rate)
    own = got["chain"]
    chain = Chain(*(np.frombuffer(own[n], "<f4") for n in ("word", "stem", "before", "after")), own.bias, np.reshape(own.moves, (2, 2)))
    return Model(chain, np.array(got["weights"].weights), rate)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and spans (start, end in code points, p) of the words at
    0.5 or more, for each row of `docs` (doc_id, text; further columns are left alone) in
    its whole text, repeated rows and null ids too; no rows give none. Null text counts as
    empty; a text without words scores as one without evidence.
    """
    rows_per_batch(docs.sparkSession)
    schema = "doc_id {}, score double, spans array<struct<start:bigint,end:bigint,p:double>>".format(docs.schema["doc_id"].dataType.simpleString())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            marks, found = model.marks(texts)
            spans = []
            for text, words in zip(texts, found):
                at = [m.span() for m in WORD.finditer(text)] if words else []
                spans.append([{"start": at[w][0], "end": at[w][1], "p": p} for w, p in words])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(marks), pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(score, schema)


def without_toxic(docs: DataFrame, model: Model, bound: float) -> DataFrame:
    """The rows of `docs`, whole and in place, whose text scores below `bound`; each row is
    judged by itself, null text as empty.
    """
    rows_per_batch(docs.sparkSession)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, _ = model.marks([t or "" for t in batch.column("text").cast(pa.string()).to_pylist()])
            yield batch.filter(pa.array(model.scores(marks) < bound))

    return docs.mapInArrow(keep, docs.schema)
