"""Toxicity: subword embeddings, averaged and classified by a softmax, trained jointly.

A word is the bag of its hashed character n-grams (3 to 5, with word ends marked) and of
itself; its vector is the mean of theirs, so an unseen misspelling shares most of them. A
segment of a text is the mean of its distinct word vectors, filled up with zeros to ``SEGMENT`` words; a linear softmax over it gives the
logit. A text's logit is the largest of its segments', so one insult in a very long text
counts as much as in a short one. Training takes gradient steps on embeddings and softmax
together: first on every segment of the shorter texts under their text's label, then on
the segment that speaks loudest for each text (for clean texts, that and another one).

Training rows are labelled rows that are not held out, at most ``MAX_PER_CLASS`` of each
class, those with the smallest hash of their id; their whole texts are used. A tenth of
them is set aside to place the threshold, so that a score of 0.7 is where the classes part.
Scoring reads every text once, without a shuffle; per bucket it needs one number (its
embedding times the softmax), 0.5 MB in all.

Null text counts as empty and, like a text without words, gets the score of the bias alone.
Without labelled rows of both classes every score is 0. Several labels of one id count as
toxic if one does. Repeated rows keep their own result rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.llm.common import query, table, text_of

BUCKETS = 1 << 17
DIM = 8
SEGMENT = 24
MAX_PER_CLASS = 4000
CUTOFF = 0.7
EPOCHS = 16
RATE = 0.5
DECAY = 3e-3
LEAST_STEPS = 900
WARM_EPOCHS = 3
MEMO_WORDS = 300_000

_WORD = re.compile(r"\w+")


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    data = f"<{word}>"
    grams = {data[i : i + n] for n in (3, 4, 5) for i in range(len(data) - n + 1)}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in sorted(grams | {data})]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def segments_of(words: list[str]) -> list[list[str]]:
    """The distinct words of each stretch of ``SEGMENT`` words: repeating one adds nothing."""
    return [list(dict.fromkeys(words[i : i + SEGMENT])) for i in range(0, len(words), SEGMENT)]


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x DIM
    softmax: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2
    shift: float = 0.0

    def bucket_logits(self) -> np.ndarray:
        return self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])

    def base_logit(self) -> float:
        return float(self.bias[1] - self.bias[0] - self.shift)


# What scoring needs of a model: one number per bucket, and that of a text without words.
Logits = tuple[np.ndarray, float]


class _Corpus:
    """Texts as numbers of distinct words, words as buckets, both as flat arrays with offsets."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        words, sizes, segments = array("i"), array("q", [0]), array("q", [0])
        buckets, bag_sizes = array("i"), array("i")
        for text in texts:  # one text at a time: only numbers are kept
            spans = segments_of(words_of(text))
            for span in spans:
                for w in span:
                    if w not in number:
                        number[w] = len(number)
                        bag = subwords(w)
                        buckets.extend(bag)
                        bag_sizes.append(len(bag))
                    words.append(number[w])
                sizes.append(len(span))
            segments.append(len(spans))
        self.bag_size = np.array(bag_sizes, np.int32)
        self.bag_at = np.concatenate([[0], np.cumsum(self.bag_size)])
        self.buckets = np.array(buckets, np.int32)
        # segments: where each begins in the words, and which is the first of each text
        self.words = np.array(words, np.int32)
        self.start = np.cumsum(np.array(sizes, np.int64))
        self.first = np.cumsum(np.array(segments, np.int64))

    def segment_logits(self, bucket_logits: np.ndarray) -> np.ndarray:
        word = np.add.reduceat(bucket_logits[self.buckets], self.bag_at[:-1]) / self.bag_size
        return np.add.reduceat(word[self.words], self.start[:-1]) / SEGMENT

    def flat(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of these segments, the weight of each, and where each segment begins."""
        spans = [self.words[self.start[s] : self.start[s + 1]] for s in segments]
        words = np.concatenate(spans)
        sizes = self.bag_size[words]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.bag_at[words] - (ends - sizes), sizes)
        per_word = 1 / (SEGMENT * sizes)
        begins = np.concatenate([[0], np.cumsum([int(self.bag_size[s].sum()) for s in spans])[:-1]])
        return self.buckets[at], np.repeat(per_word, sizes).astype(np.float32), begins


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 1, rate: float = RATE, decay: float = DECAY) -> Model | None:
    """Fit on these texts; None without words in texts of both classes."""
    corpus = _Corpus(texts)
    first = corpus.first
    used = np.flatnonzero(np.diff(first))
    if len(set(toxic[used])) < 2:
        return None
    rng = np.random.default_rng(seed)
    spare = used[rng.permutation(len(used))[: len(used) // 10]]
    fit = np.setdiff1d(used, spare) if len(set(toxic[spare])) == 2 else used
    spare = spare if len(set(toxic[spare])) == 2 else used
    model = Model(
        rng.uniform(-0.5 / DIM, 0.5 / DIM, (BUCKETS, DIM)).astype(np.float32),
        rng.uniform(-0.5, 0.5, (DIM, 2)).astype(np.float32),
        np.zeros(2, np.float32),
    )
    seen_e = np.full((BUCKETS, DIM), 1e-4, np.float32)  # sums of squared gradients
    seen_w, seen_b = np.full((DIM, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    lengths = np.diff(first)

    def loudest(docs: np.ndarray) -> np.ndarray:
        logits = corpus.segment_logits(model.bucket_logits())
        return np.array([first[d] + int(np.argmax(logits[first[d] : first[d + 1]])) for d in docs])

    warm = fit[lengths[fit] <= np.quantile(lengths[fit], 0.6)]
    warm = warm if len(set(toxic[warm])) == 2 else fit
    epochs = max(epochs, LEAST_STEPS * 256 // (2 * len(fit)))
    for epoch in range(epochs):
        if epoch < WARM_EPOCHS:  # every segment under its text's label
            segments = np.concatenate([np.arange(first[d], first[d + 1]) for d in warm])
            labels = np.repeat(toxic[warm], lengths[warm])
        else:
            clean = fit[toxic[fit] == 0]
            segments = np.concatenate([loudest(fit), rng.integers(first[clean], first[clean + 1])])
            labels = np.concatenate([toxic[fit], np.zeros(len(clean), toxic.dtype)])
        order = rng.permutation(len(segments))
        weight = np.where(labels == 1, len(labels) / 2 / max(1, (labels == 1).sum()), len(labels) / 2 / max(1, (labels == 0).sum()))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            buckets, share, begins = corpus.flat(segments[pick])
            hidden = np.add.reduceat(model.embedding[buckets] * share[:, None], begins)
            logits = hidden @ model.softmax + model.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            error = (p * (weight[pick] / len(pick))[:, None]).astype(np.float32)
            back = error @ model.softmax.T
            grad_w, grad_b = hidden.T @ error, error.sum(0)
            sizes = np.diff(np.append(begins, len(buckets)))
            spread = np.repeat(back, sizes, axis=0) * share[:, None]
            grad_e = np.stack([np.bincount(buckets, spread[:, k], BUCKETS) for k in range(DIM)], 1).astype(np.float32)
            for value, grad, seen in ((model.embedding, grad_e, seen_e), (model.softmax, grad_w, seen_w), (model.bias, grad_b, seen_b)):
                seen += grad * grad
                value -= rate * grad / np.sqrt(seen)
            model.embedding *= 1 - decay
    logits = corpus.segment_logits(model.bucket_logits()) + model.base_logit()
    best = np.array([logits[first[d] : first[d + 1]].max() for d in spare])
    model.shift = _parting(best, toxic[spare]) - math.log(CUTOFF / (1 - CUTOFF))
    return model


def _parting(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The logit that parts the classes with the fewest mistakes, in the middle of its gap."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], toxic[order]
    mistakes = np.concatenate([[(y == 0).sum()], (y == 0).sum() + np.cumsum(np.where(y == 1, 1, -1))])
    ends = np.concatenate([[x[0] - 2], x, [x[-1] + 2]])
    best = np.flatnonzero(mistakes == mistakes.min())
    gaps = ends[best + 1] - ends[best]
    k = best[int(np.argmax(gaps))]
    return float((ends[k] + ends[k + 1]) / 2)


def held_out(doc_id: str | Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Logits | None:
    """Train on a bounded sample of labelled rows that are not held out, in one task.

    Only the numbers that scoring needs come back to the driver.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    picked = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most two times max_per_class ids
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            sample = pd.concat(parts).sort_values("doc_id")
            model = train(list(sample["text"]), sample["toxic"].to_numpy(np.int64))
            if model is not None:
                yield pd.DataFrame({"logits": [model.bucket_logits().astype(np.float32).tobytes()], "base": [model.base_logit()]})

    found = rows.repartition(1).mapInPandas(trained, "logits binary, base double").collect()
    return (np.frombuffer(found[0]["logits"], np.float32), found[0]["base"]) if found else None


def _scorer(logits: np.ndarray, base: float):
    """A function from text to score, with a bounded memo of word logits."""
    memo: dict[str, float] = {}

    def scored(text: str | None) -> float:
        words = words_of(text)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            bag = subwords(w)
            memo[w] = float(logits[bag].sum()) / len(bag)
        best = max((sum(map(memo.__getitem__, span)) for span in segments_of(words)), default=0.0) / SEGMENT
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, best + base))))

    return scored


def with_score(docs: DataFrame, model: Logits | None, text: str = "text") -> DataFrame:
    """``docs`` with the column score."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scored = _scorer(*shared.value)
        for batch in texts:
            yield batch.map(scored, na_action=None).astype("float64")

    return docs.withColumn("score", score(text_of(text)))


def toxicity(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    scores = with_score(docs.select("doc_id", "text"), fit(docs, labels, max_per_class))
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
