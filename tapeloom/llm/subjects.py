"""Subject areas of pages: complement naive Bayes, EM over all pages, calibrated posteriors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.layout import boxes, page_lines
from tapeloom.session import cut

BUCKETS = 1 << 16
_BREAK = re.compile(r"\s*[-¬=]$")
_WORD = re.compile(r"[a-zäöüß0-9]+")
_END = re.compile(r"(?<=[a-z0-9äöüß])[.;!?]+")


@dataclass(frozen=True)
class SubjectParams:
    max_labelled: int = 20_000  # pages whose labels are used: those with the smallest hashes of their ids
    rounds: int = 4  # of EM over the labelled pages alone
    iterations: int = 2  # of EM over all pages
    sharpness: float = 4.0  # of the posteriors: complement weights are a fraction of log odds
    smoothing: float = 1.0
    unlabelled: float = 0.1  # what a sentence of EM over all pages weighs against one of a labelled page
    folds: int = 3  # of the labelled pages, each calibrated by a model that has not seen its labels
    window: int = 5  # sentences in a row that make an article
    decide: float = 0.5


class _Features(dict):
    """A word's hashed features: itself, and for long ones its ending; numbers have none."""

    def __missing__(self, w: str) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        h = lambda s: zlib.crc32(s.encode()) % BUCKETS
        self[w] = x = () if w.isdigit() else (h(w), h("~" + w[-3:])) if len(w) >= 8 else (h(w),)
        return x


_FEATURES = _Features()


def sentence_features(lines: list[str]) -> list[list[int]]:
    """The features of each sentence of a page; words broken at line ends are joined where a mark shows it."""
    joined = "".join([_BREAK.sub("", x) if x.endswith(("-", "¬", "=")) else x + " " for x in lines]).lower()
    found = [list(chain.from_iterable([_FEATURES[w] for w in _WORD.findall(s)])) for s in _END.split(joined)]
    return [f for f in found if len(f) >= 3]


def encode_pages(texts: list[str | None], at: tuple) -> tuple[list[bytes], list[bytes]]:
    """Each page as the bytes of its features (uint16) and of its sentences' lengths (uint32)."""
    toks, lens = [], []
    for k, t in enumerate(texts):
        f = sentence_features(page_lines(t, k, at)) if t else []
        toks.append(np.array(list(chain.from_iterable(f)), np.uint16).tobytes())
        lens.append(np.array([len(s) for s in f], np.uint32).tobytes())
    return toks, lens


@dataclass
class Encoded:
    """Pages as flat arrays: features, the sentence's length and page number."""

    tok: np.ndarray
    length: np.ndarray
    page: np.ndarray
    pages: int

    @classmethod
    def of(cls, toks: list[bytes], lens: list[bytes]) -> Encoded:
        count = np.array([len(x) // 4 for x in lens], np.int64)
        return cls(np.frombuffer(b"".join(toks), np.uint16).astype(np.int64), np.frombuffer(b"".join(lens), np.uint32).astype(np.int64), np.repeat(np.arange(len(lens)), count), len(lens))

    def posteriors(self, weights: np.ndarray, sharpness: float) -> np.ndarray:
        """Of each sentence (rows) over the classes."""
        if not len(self.length):
            return np.zeros((0, weights.shape[1]))
        ends = np.cumsum(self.length)
        out = np.empty((len(self.length), weights.shape[1]))
        a = 0
        while a < len(ends):  # about half a million features at once
            base = ends[a] - self.length[a]
            b = max(a + 1, int(np.searchsorted(ends, base + 500_000, "right")))
            out[a:b] = np.add.reduceat(weights[self.tok[base : ends[b - 1]]], ends[a:b] - self.length[a:b] - base, axis=0)
            a = b
        out *= sharpness
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        return out / out.sum(1, keepdims=True)

    def expected(self, post: np.ndarray) -> np.ndarray:
        """Expected feature counts (class, bucket)."""
        rep = np.repeat(np.arange(len(self.length)), self.length)
        return np.stack([np.bincount(self.tok, weights=post[rep, c], minlength=BUCKETS) for c in range(post.shape[1])])

    def only(self, pages: np.ndarray) -> Encoded:
        """The pages of a mask, renumbered."""
        keep = pages[self.page]
        return Encoded(self.tok[np.repeat(keep, self.length)], self.length[keep], (np.cumsum(pages) - 1)[self.page[keep]], int(pages.sum()))

    def evidence(self, post: np.ndarray, subjects: int, window: int) -> np.ndarray:
        """(page, subject, feature): what the calibration sees."""
        conf = np.where(post[:, :subjects] >= 0.5, post[:, :subjects], 0.0)
        n = np.bincount(self.page, minlength=self.pages)
        cnt = np.zeros((self.pages, subjects))
        most = np.zeros((self.pages, subjects))
        if len(conf):
            np.add.at(cnt, self.page, conf)
            sums = np.concatenate([np.zeros((1, subjects)), np.cumsum(conf, 0)])
            first = (np.cumsum(n) - n)[self.page]
            lo = np.maximum(np.arange(len(conf)) - window + 1, first)
            np.maximum.at(most, self.page, sums[1:] - sums[lo])
        share = cnt / np.maximum(n, 1)[:, None]
        return np.stack([np.ones_like(cnt), np.log1p(cnt), most, most**2, share, np.minimum(cnt, 8)], -1)


def complement_weights(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Complement naive Bayes: (bucket, class) weights from each class's complement, the classes brought to equal size."""
    n = counts / np.maximum(counts.sum(1, keepdims=True), 1) * 1e5
    comp = n.sum(0)[None] - n + smoothing
    w = -np.log(comp / comp.sum(1, keepdims=True))
    return np.ascontiguousarray((w - w.mean(0, keepdims=True)).T.astype(np.float32))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1]), x.T @ (y - p) - 0.05 * w)
    return w


@dataclass
class SubjectModel:
    subjects: list[str]
    weights: np.ndarray  # (bucket, class); the classes behind the subjects are held-out passages and no subject
    slopes: np.ndarray
    bias: np.ndarray

    def probabilities(self, pages: Encoded, p: SubjectParams) -> np.ndarray:
        """(page, subject): independent posteriors; 0 for a page without sentences."""
        k = len(self.subjects)
        x = pages.evidence(pages.posteriors(self.weights, p.sharpness), k, p.window)
        out = 1 / (1 + np.exp(-np.clip(x @ self.slopes + self.bias, -30, 30)))
        return np.where(x[..., 1] > 0, out, 0.0)


def _within(pages: Encoded, weights: np.ndarray, allowed: np.ndarray, p: SubjectParams) -> np.ndarray:
    """Posteriors of labelled pages' sentences within their labels."""
    post = pages.posteriors(weights, p.sharpness) * allowed[pages.page]
    post /= np.maximum(post.sum(1, keepdims=True), 1e-9)
    return post


def _labelled_em(pages: Encoded, start: np.ndarray, allowed: np.ndarray, fixed: np.ndarray, p: SubjectParams) -> np.ndarray:
    """Weights from the labelled pages alone."""
    weights = complement_weights(pages.expected(start[pages.page]) + fixed, p.smoothing)
    for _ in range(p.rounds):
        weights = complement_weights(pages.expected(_within(pages, weights, allowed, p)) + fixed, p.smoothing)
    return weights


def _calibrate(subjects: list[str], x: np.ndarray, allowed: np.ndarray, weights: np.ndarray) -> SubjectModel:
    """Slopes shared by the subjects and a bias for each, from the evidence x of pages and their labels."""
    k = len(subjects)
    f = x.shape[-1]
    one = np.broadcast_to(np.eye(k), (len(x), k, k))
    w = _logistic(np.concatenate([x, one], -1).reshape(-1, f + k), allowed.astype(float).reshape(-1))
    return SubjectModel(subjects, weights, w[:f], w[f:])


def _encoded(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks, lens = encode_pages(batch.column(1).to_pylist(), boxes(batch.column(2)))
            yield pa.record_batch([batch.column(0), pa.array(toks, pa.binary()), pa.array(lens, pa.binary())], names=["page_id", "toks", "lens"])

    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, toks binary, lens binary")


def fit_subjects(encoded: DataFrame, labels: DataFrame, subjects: list[str], held_out: list[str], p: SubjectParams) -> SubjectModel:
    """The model from labelled pages (page_id, subject), refined over all encoded pages.

    Sentences are the unit: a page's labels limit what its sentences can be about. In EM every sentence of every page counts
    in each class by its posterior. The posteriors of pages are calibrated on labelled pages whose labels the weights
    behind their evidence have not seen. Labelled are at most max_labelled pages; a null subject says that a page has none. The driver holds the encoded labelled
    pages and the model, both bounded; the expected counts of all pages come as one row per bucket.
    """
    k = len(subjects)
    n = k + 2
    chosen = labels.select("page_id").dropna().distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(p.max_labelled)
    sets = labels.join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    rows = encoded.join(F.broadcast(sets), "page_id").orderBy("page_id").toArrow()
    known = {s: c for c, s in enumerate(subjects)}
    named = [[known[s] for s in x if s in known] for x in rows["subjects"].to_pylist()]
    pages = Encoded.of(rows["toks"].to_pylist(), rows["lens"].to_pylist())
    allowed = np.zeros((pages.pages, n))
    start = np.zeros((pages.pages, n))
    allowed[:, k:] = 1
    for i, x in enumerate(named):
        allowed[i, x] = 1
        start[i, x if x else k + 1] = 1 / max(1, len(x))
    toks, lens = encode_pages(held_out, (np.zeros(len(held_out) + 1, np.int64), *[np.zeros(0, np.int64)] * 3))
    fixed = np.zeros((n, BUCKETS))
    fixed[k] = np.bincount(Encoded.of(toks, lens).tok, minlength=BUCKETS)

    weights = _labelled_em(pages, start, allowed, fixed, p)
    counts = np.zeros((n, BUCKETS))
    sc = encoded.sparkSession.sparkContext
    for _ in range(p.iterations):
        held = sc.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, BUCKETS))
            for batch in batches:
                e = Encoded.of(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                total += e.expected(e.posteriors(held.value, p.sharpness))  # noqa: B023
            at = np.nonzero(total.any(0))[0]
            yield pa.record_batch([pa.array(at.astype(np.int32)), *[pa.array(total[c, at]) for c in range(n)]], names=["bucket", *[f"c{c}" for c in range(n)]])

        parts = encoded.select("toks", "lens").mapInArrow(run, "bucket int, " + ", ".join(f"c{c} double" for c in range(n)))
        sums = parts.groupBy("bucket").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(n)]).toArrow()
        counts = np.zeros((n, BUCKETS))
        at = sums["bucket"].to_numpy()
        for c in range(n):
            counts[c, at] = p.unlabelled * sums[f"c{c}"].to_numpy()
        # the labelled pages once more, within their labels
        weights = complement_weights(counts + pages.expected(_within(pages, weights, allowed, p)) + fixed, p.smoothing)
        held.destroy()

    fold = np.arange(pages.pages) % p.folds
    x = np.zeros((pages.pages, k, 6))
    for f in range(p.folds):
        rest, mine = pages.only(fold != f), pages.only(fold == f)
        w = _labelled_em(rest, start[fold != f], allowed[fold != f], fixed, p)
        w = complement_weights(counts + rest.expected(_within(rest, w, allowed[fold != f], p)) + fixed, p.smoothing)
        x[fold == f] = mine.evidence(mine.posteriors(w, p.sharpness), k, p.window)
    return _calibrate(subjects, x, allowed[:, :k], weights)


def page_subjects(pages: DataFrame, labels: DataFrame, subjects: DataFrame, items: DataFrame, page_id: str = "doc_id", params: SubjectParams = SubjectParams()) -> DataFrame:
    """The subject areas of each page with their posteriors: page_id, subject, posterior (at least `decide`), distinct.

    pages: page_id, text, line_box; labels: page_id, subject (null: none); subjects: the list of areas;
    items: passage and question of the held-out items, which add no area. Null ids and null or empty texts
    have no areas; a page with a null line_box keeps its lines as scanned; labels of unknown areas or
    pages are ignored; without labels no page has an area. Repeated rows of a page give its areas once.

    Plan: the texts are read and cut to hashed features once, in one pass without a shuffle, and kept in
    the shared folder; EM and the last pass read these. Only the labelled sample, bounded by a parameter, and the
    model (buckets x classes) ever reach the driver; the number of areas and held-out items is fixed.
    """
    data = pages.select(F.col(page_id).alias("page_id"), "text", "line_box").where("page_id is not null and text is not null")
    encoded = cut(_encoded(data))
    names = sorted(r[0] for r in subjects.select("subject").dropna().distinct().collect())
    held = [r[0] for r in items.select(F.concat_ws(" ", "passage", "question")).collect()]
    mine = labels.select(F.col(page_id).alias("page_id"), "subject")
    model = fit_subjects(encoded, mine, names, held, params)
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    schema = f"page_id {data.schema['page_id'].dataType.simpleString()}, subject string, posterior double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            prob = m.probabilities(Encoded.of(batch.column(1).to_pylist(), batch.column(2).to_pylist()), params)
            i, c = np.nonzero(prob >= params.decide)
            yield pa.record_batch([batch.column(0).take(pa.array(i)), pa.array([m.subjects[x] for x in c], pa.string()), pa.array(prob[i, c])], names=["page_id", "subject", "posterior"])

    found = encoded.mapInArrow(run, schema).groupBy("page_id", "subject").agg(F.max("posterior").alias("posterior"))
    return found.select(F.col("page_id").alias(page_id), "subject", "posterior")
