"""Evaluation passages inside page texts: CGK embedding, bit-sampling LSH, edit verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.layout import boxes, page_lines

_CODES = np.full(256, 0, np.uint8)
for _i, _c in enumerate("0123456789abcdefghijklmnopqrstuvwxyz"):
    _CODES[ord(_c)] = _i + 1
    _CODES[ord(_c.upper())] = _i + 1
for _c, _base in {"ä": "a", "ö": "o", "ü": "u", "Ä": "a", "Ö": "o", "Ü": "u", "é": "e", "è": "e", "í": "i", "á": "a", "à": "a", "ó": "o", "ú": "u", "ç": "c"}.items():
    _CODES[ord(_c)] = _CODES[ord(_base)]
_TO_CODE = bytes(_CODES)
_DROP = bytes(i for i in range(256) if not _CODES[i])


def squeeze(text: str) -> bytes:
    """Letters and digits as codes 1 to 36 without case, spaces and marks, so that breaks and lost blanks do not count."""
    return text.replace("ſ", "s").encode("latin-1", "replace").replace(b"?", b"").translate(_TO_CODE, _DROP)


@dataclass(frozen=True)
class LeakParams:
    """How much damage is expected and what share of the damaged runs must be found; the hashes follow from it (hashes())."""

    min_words: int = 12
    recall: float = 0.95  # of the runs of run_letters letters with a share `misread` of them wrong
    misread: float = 0.06
    run_letters: int = 66
    steps: int = 64  # of the random walk: about half as many characters
    sampled: int = 7  # positions of the embedding in one hash
    samples: int = 5  # hashes per embedding
    stride: int = 12  # characters between the windows of a page; items have one at each character
    verify: int = 32  # characters of a seed that are verified
    max_edits: int = 5
    anchor: int = 5  # exact match that counts beside a verified seed
    far_anchor: int = 12  # and anywhere on the page, behind an advert or a column's end; at most 12, so that it fits a number
    max_damage: float = 0.14  # edits for each character of a printed run
    loose: float = 1.0  # edits in a word inside a run, or
    loose_share: float = 0.5  # this share of its letters
    gap_edits: int = 2  # between two exact stretches, or
    gap_share: float = 0.6
    item_chunk: int = 2000  # items whose index one worker holds at once; more items take more passes


SEAM = 8  # letters at most between the parts of a run that the page prints in two places
PAD = 80  # beyond the end of each text, code 0


@cache
def hashes(p: LeakParams) -> int:
    """The embeddings of p.samples hashes each that reach p.recall.

    Random texts are misread as said; a run is found if a page window and the item window it came from agree in any hash.
    Windows without errors always agree, so this is about the damaged ones.
    """
    rng = np.random.default_rng(7)
    texts = 600
    share = rng.dirichlet(np.full(26, 1.5))
    item = (rng.choice(26, (texts, p.run_letters + PAD), p=share) + 11).astype(np.uint8)  # behind the run both texts go on in their own way
    pages, origin = [], []
    for t in item:
        out, came = [], []
        for k in range(p.run_letters):
            kind = rng.random() / p.misread
            if kind < 0.15:
                continue
            out.append(rng.integers(11, 37) if kind < 0.85 else t[k])
            came.append(k)
            if 0.85 <= kind < 1:
                out.append(rng.integers(11, 37))
                came.append(k)
        pages.append(np.concatenate([np.array(out, np.uint8), (rng.choice(26, PAD, p=share) + 11).astype(np.uint8)]))
        origin.append(came)
    flat, base = np.concatenate(pages), np.cumsum([0, *map(len, pages)])
    own = [(k, i) for k, came in enumerate(origin) for i in range(k % p.stride, max(1, len(came) - p.verify + 1), p.stride)]
    starts = np.array([base[k] + i for k, i in own], np.int64)
    theirs = np.array([k * item.shape[1] + origin[k][i] for k, i in own], np.int64)
    run = np.array([k for k, _ in own])
    found = np.zeros(texts, bool)
    for e in range(1, 9):
        only = range(e - 1, e)
        for h, g in zip(embed_hashes(flat, starts, p, only), embed_hashes(item.ravel(), theirs, p, only), strict=True):
            found[run[h == g]] = True
        if found.mean() >= p.recall:
            return e
    raise ValueError(f"no eight embeddings reach a recall of {p.recall}: fewer sampled positions or a smaller stride would")


def _tables(p: LeakParams, e: int) -> tuple[np.ndarray, np.ndarray]:
    """The random bits (step, code) of walk e and its sampled steps (sample, step: 0 or 1)."""
    rng = np.random.default_rng((20240917, e))
    chosen = np.zeros((p.samples, p.steps), bool)
    bits = rng.integers(0, 2, (p.steps, 64), dtype=np.int32)
    for s in range(p.samples):
        chosen[s, rng.choice(p.steps, p.sampled, replace=False)] = True
    return bits, chosen


def embed_hashes(flat: np.ndarray, starts: np.ndarray, p: LeakParams, embeddings: range | None = None) -> Iterator[np.ndarray]:
    """For each hash function of the embeddings (all: hashes(p)) the hashes of the windows at starts.

    CGK: a pointer walks over the text; at each step the character under it is put out and the pointer
    moves on or stays by a random bit of (step, character). Two texts at a small edit distance get
    walks that meet again, so that their outputs are at a small Hamming distance; a hash is a sample of positions.
    """
    for e in range(hashes(p)) if embeddings is None else embeddings:
        bits, picks = _tables(p, e)
        ptr = starts.astype(np.int32)
        acc = np.zeros((p.samples, len(starts)), np.uint64)
        for j in range(p.steps):
            c = flat[ptr]
            for s in np.nonzero(picks[:, j])[0]:
                acc[s] *= np.uint64(0x9E3779B97F4A7C15)
                acc[s] += c
            ptr += bits[j][c]
        for s in range(p.samples):
            x = acc[s] ^ (acc[s] >> np.uint64(29))
            yield x * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(32))


def prefix_edits(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Row by row the edit distance of pattern (at most 64 codes) to the closest prefix of text, bit-parallel over all rows."""
    n, m = pattern.shape
    u = np.uint64
    weights = u(1) << np.arange(m, dtype=np.uint64)
    pv, mv = np.full(n, ~u(0)), np.zeros(n, u)
    score = np.full(n, m, np.int32)
    best = score.copy()
    top = u(m - 1)
    one = u(1)
    pack = (m + 7) // 8
    for j in range(text.shape[1]):
        hit = np.packbits(pattern == text[:, j : j + 1], axis=1, bitorder="little")
        eq = np.zeros(n, u)
        for b in range(pack):
            eq |= hit[:, b].astype(u) << u(8 * b)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += ((ph >> top) & one).astype(np.int32) - ((mh >> top) & one).astype(np.int32)
        ph = (ph << one) | one
        mh = mh << one
        pv = mh | ~(xv | ph)
        mv = ph & xv
        np.minimum(best, score, out=best)
    del weights
    return best


def _edits(a: bytes, b: bytes) -> int:
    """Edit distance of two short strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def grams(text: bytes, k: int) -> np.ndarray:
    """Each stretch of k letters as a number."""
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(x) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(37) + x[i : i + n]
    return out


class ItemIndex:
    """Hash tables over the windows of the items, one at each character."""

    def __init__(self, items: list[tuple[int, str]], p: LeakParams):
        self.p = p
        self.ids = [i for i, _ in items]
        self.text: list[bytes] = []
        self.word: list[np.ndarray] = []
        self.grams: list[np.ndarray] = []
        flat, owner, start = [], [], []
        at = 0
        for k, (_, words) in enumerate(items):
            parts = [squeeze(w) for w in words.split()]
            parts = [w for w in parts if w]
            t = b"".join(parts)
            self.text.append(t)
            self.grams.append(grams(t, p.far_anchor))
            self.word.append(np.repeat(np.arange(len(parts)), [len(w) for w in parts]) if parts else np.zeros(0, int))
            flat.append(t + bytes(PAD))
            n = max(0, len(t) - p.verify + 1)
            owner.append(np.full(n, k, np.int32))
            start.append(np.arange(at, at + n, dtype=np.int64))
            at += len(t) + PAD
        self.base = np.cumsum([0, *[len(t) + PAD for t in self.text]])
        self.flat = np.frombuffer(b"".join(flat), np.uint8)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        self.start = np.concatenate(start) if start else np.zeros(0, np.int64)
        self.tables = []
        for h in embed_hashes(self.flat, self.start, p) if len(self.start) else ():
            order = np.argsort(h, kind="stable")
            mask = np.zeros(1 << 22, bool)
            mask[h & np.uint64((1 << 22) - 1)] = True
            self.tables.append((h[order], order, mask))

    def seeds(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of page window and item window whose hashes agree in any table and whose edit distance is small."""
        low = np.uint64((1 << 22) - 1)
        pairs = []
        n = np.int64(max(1, len(self.start)))
        for (hashes, order, mask), h in zip(self.tables, embed_hashes(flat, starts, self.p), strict=False):
            maybe = np.nonzero(mask[h & low])[0]
            if not len(maybe):
                continue
            a, b = np.searchsorted(hashes, h[maybe], "left"), np.searchsorted(hashes, h[maybe], "right")
            count = b - a
            if total := int(count.sum()):
                win = np.repeat(maybe, count)
                pos = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
                pairs.append(win * n + order[pos])
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(pairs))
        win, itm = both // n, both % n
        keep = []
        m = self.p.verify
        for k in range(0, len(win), 50_000):
            w, i = win[k : k + 50_000], itm[k : k + 50_000]
            pattern = self.flat[self.start[i][:, None] + np.arange(m)]
            text = flat[starts[w][:, None] + np.arange(m + self.p.max_edits)]
            keep.append(prefix_edits(pattern, text) <= self.p.max_edits)
        ok = np.concatenate(keep)
        return win[ok], itm[ok]


def _stretches(item: np.ndarray, page: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[int, int, int]]:
    """All maximal stretches of k equal letters or more as (item start, item end, diagonal). item, page: their grams; the page's sorted, with their places."""
    sorted_, place = page
    a, b = np.searchsorted(sorted_, item, "left"), np.searchsorted(sorted_, item, "right")
    count = b - a
    i = np.repeat(np.arange(len(item)), count)
    j = place[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)]
    d = j - i
    order = np.lexsort((i, d))
    d, i = d[order], i[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)]) if len(d) else np.zeros(0, bool)
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(d)]]) - 1 if len(first) else first
    return list(zip(i[first].tolist(), (i[last] + k).tolist(), d[first].tolist(), strict=True))


def printed_run(item: bytes, word: np.ndarray, page: bytes, diagonals: set[int], p: LeakParams, far: list[tuple[int, int, int]] | None = None) -> bool:
    """Whether the page prints min_words of the item's words one after the other.

    Exact matches of `anchor` letters near the diagonals of verified seeds and of longer ones, and those of far_anchor letters anywhere
    on the page (far), cover parts of the item. A gap between two of them counts as printed if the page has as little there and the edit
    distance says it is the same text misread; where the page jumps (an advert of any length, the next column) the parts must
    adjoin in the item, or nearly so if the letters between them are there, and one of them must hold a seed. The edits of a run of min_words may be max_damage of its letters at most; of a word within loose_share of
    its letters, or `loose`, may be wrong, of the first and the last word and of numbers a quarter.
    """
    n = len(item)
    lengths = np.bincount(word)
    m = p.min_words
    if len(lengths) < m:
        return False
    window = lambda x: np.convolve(x, np.ones(m), "valid")
    # a run that passes has so many edits at most; a gap without five equal letters in a row has one in five letters at least
    budget = int(p.max_damage * window(lengths).max())
    longest = p.anchor * (budget + 1)
    if far is None:
        g = grams(page, p.far_anchor)
        order = np.argsort(g, kind="stable")
        far = _stretches(grams(item, p.far_anchor), (g[order], order), p.far_anchor)
    seeded = lambda d: any(abs(d - x) <= budget for x in diagonals)
    solid = [x for x in far if seeded(x[2])]  # item start, item end, diagonal
    # behind an advert the text goes on where a part with a seed ends, and before one it ends where such a part begins
    found = solid + [x for x in far if not seeded(x[2]) and any((x[0] <= e + SEAM < x[1] and x[2] > d) or (x[0] < s - SEAM <= x[1] and x[2] < d) for s, e, d in solid)]
    k = p.anchor
    reach = sorted({d + s for d in diagonals for s in range(-budget, budget + 1)})
    a = np.frombuffer(item, np.uint8)
    b = np.frombuffer(bytes(n + 8) + page + bytes(n + 8), np.uint8)
    shift = np.array([d for d in reach if -n < d < len(page)], np.int64)
    for at in range(0, len(shift), 256):
        some = shift[at : at + 256]
        same = np.zeros((len(some), n + 2), np.int8)
        same[:, 1:-1] = a == b[(n + 8 + some)[:, None] + np.arange(n)]
        step = np.diff(same, axis=1)
        row, s = np.nonzero(step == 1)
        e = np.nonzero(step == -1)[1]
        long = e - s >= k
        found += zip(s[long].tolist(), e[long].tolist(), some[row[long]].tolist(), strict=True)
    if not found:
        return False
    found = sorted(set(found))
    covered = np.zeros(n, bool)
    for s, e, _ in found:
        covered[s:e] = True
    cost = np.where(covered, 0.0, 1.0)
    starts, ends = defaultdict(set), defaultdict(set)
    for s, e, d in found:
        starts[s].add(d)
        ends[e].add(d)
    figures = np.bincount(word, weights=a <= 10) > 0  # texts of one pattern differ in their numbers

    def passes(cost: np.ndarray) -> bool:
        edits_in = np.bincount(word, weights=cost)
        strict = edits_in <= 0.25 * lengths
        full = np.where(figures, strict, edits_in <= np.maximum(p.loose, p.loose_share * lengths))
        damage = window(edits_in) / window(lengths)
        return bool(((window(full) > m - 0.5) & strict[: len(strict) - m + 1] & strict[m - 1 :] & (damage <= p.max_damage)).any())

    edge = np.diff(np.concatenate([[1], covered.astype(np.int8), [1]]))
    gaps = [(s, e) for s, e in zip(np.nonzero(edge == -1)[0].tolist(), np.nonzero(edge == 1)[0].tolist(), strict=True) if s > 0 and e < n and e - s <= longest]
    least = cost.copy()
    for s, e in gaps:
        least[s:e] = ((e - s) // k if e - s >= k else 0) / (e - s)
    if not passes(least):  # not even with the fewest edits that the gaps can have
        return False
    for s, e in gaps:
        near = {(s + d0, e + d1) for d0 in ends[s] for d1 in starts[e] if abs(d1 - d0) <= budget and e + d1 >= s + d0}
        edits = min((_edits(item[s:e], page[i:j]) for i, j in near), default=99)
        if edits > max(p.gap_edits, p.gap_share * (e - s)) and e - s <= SEAM:
            # the page jumps here: some of the letters stand before the jump, the others behind it
            far_ = [(s + d0, e + d1) for d0 in ends[s] for d1 in starts[e] if abs(d1 - d0) > budget]
            edits = min((_edits(item[s : s + x], page[i : i + x]) + _edits(item[s + x : e], page[j - (e - s - x) : j]) for i, j in far_ for x in range(e - s + 1)), default=99)
            edits = edits if edits <= max(1, 0.34 * (e - s)) else 99
        if edits <= max(p.gap_edits, p.gap_share * (e - s)):
            cost[s:e] = min(edits, e - s) / (e - s)
    return passes(cost)


def pages_with_items(texts: list[str], at: tuple, index: ItemIndex) -> Iterator[tuple[int, int]]:
    """(page number in the batch, item id) for each page that prints min_words of an item in a row."""
    p = index.p
    pages = [squeeze("".join(page_lines(t, i, at))) if t else b"" for i, t in enumerate(texts)]
    sizes = np.array([len(s) for s in pages])
    base = np.concatenate([[0], np.cumsum(sizes + PAD)])
    flat = np.frombuffer(b"".join(s + bytes(PAD) for s in pages), np.uint8)
    count = np.maximum(0, (sizes - p.verify // 2 + p.stride - 1) // p.stride)
    total = int(count.sum())
    if not total or not index.tables:
        return
    page = np.repeat(np.arange(len(pages)), count)
    starts = base[page] + (np.arange(total) - np.repeat(np.cumsum(count) - count, count)) * p.stride
    found: dict[tuple[int, int], set[int]] = defaultdict(set)
    for k in range(0, total, 120_000):
        win, itm = index.seeds(flat, starts[k : k + 120_000])
        own = index.owner[itm]
        pg = page[k + win]
        diag = (starts[k + win] - base[pg]) - (index.start[itm] - index.base[own])
        for a, b, d in set(zip(pg.tolist(), own.tolist(), diag.tolist(), strict=True)):
            found[a, b].add(d)
    at_page, gram = -1, None
    for (a, b), diagonals in sorted(found.items()):
        if a != at_page:
            g = grams(pages[a], p.far_anchor)
            order = np.argsort(g, kind="stable")
            at_page, gram = a, (g[order], order)
        if printed_run(index.text[b], index.word[b], pages[a], diagonals, p, _stretches(index.grams[b], gram, p.far_anchor)):
            yield a, index.ids[b]


def leaked_items(pages: DataFrame, items: DataFrame, page_id: str = "doc_id", text: str = "text", line_box: str = "line_box", item_id: str = "item_id", parts: tuple[str, ...] = ("passage", "question"), params: LeakParams = LeakParams()) -> DataFrame:
    """Each page that prints min_words consecutive words of an item, with the item: page_id, item_id, distinct.

    Null or empty texts have no cases; a null or short line_box leaves the lines as scanned; of several
    items with one id each counts; items of under min_words words have no cases. Other columns are ignored.

    Plan: one pass over the pages without a shuffle but the final distinct. The items are held-out test sets,
    which do not grow with the corpus; they go to the workers in chunks of item_chunk items of
    bounded size, one pass a chunk, so nothing broadcast grows.
    """
    held = items.select(item_id, F.concat_ws(" ", *parts).alias("words")).dropna()
    rows = sorted({(r[0], r[1]) for r in held.toLocalIterator()})
    rows = [r for r in rows if len(r[1].split()) >= params.min_words]
    data = pages.select(F.col(page_id).alias("page_id"), F.col(text).alias("text"), F.col(line_box).alias("line_box")).where("page_id is not null and text is not null")

    def scan(chunk: list[tuple[int, str]]):
        key = hash(tuple(chunk))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _INDEX.get((key, params))
            if index is None:
                _INDEX.clear()
                index = _INDEX[key, params] = ItemIndex(chunk, params)
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    b = batch.slice(k, 1000)
                    got = list(pages_with_items(b.column(1).to_pylist(), boxes(b.column(2)), index))
                    ids = b.column(0)
                    yield pa.record_batch([ids.take(pa.array([g[0] for g in got], pa.int64())), pa.array([g[1] for g in got], pa.int64())], names=["page_id", "item_id"])

        return run

    schema = f"page_id {data.schema['page_id'].dataType.simpleString()}, item_id bigint"
    out = None
    for k in range(0, max(1, len(rows)), params.item_chunk):
        part = data.mapInArrow(scan(rows[k : k + params.item_chunk]), schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct().select(F.col("page_id").alias(page_id), F.col("item_id").alias(item_id))


_INDEX: dict = {}
