import random

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm.layout import boxes
from tapeloom.llm.leaks import ItemIndex, LeakParams, _edits, _stretches, embed_hashes, grams, hashes, leaked_items, pages_with_items, prefix_edits, squeeze

WORDS = [a + b + c for a in ("ba", "ko", "li", "mu", "re", "sto") for b in ("nda", "rvi", "lte", "ppo", "cks", "sse") for c in ("n", "ro", "tal", "my", "ched")]
BOX = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:int>>"
SCHEMA = f"doc_id bigint, text string, line_box {BOX}, item_id int, page_id string, words string"


def prose(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def page(r, words, columns=1, joined=False, noise=0.0):
    """Lines of about 30 characters; columns read across; noise misreads letters."""
    lines, line = [], ""
    for w in words:
        if len(line) + len(w) > 30:
            lines.append(line)
            line = ""
        line = (line + " " + w).strip()
    lines.append(line)
    mis = lambda t: "".join(r.choice("xqzj") if c.isalpha() and r.random() < noise else c for c in t)
    lines = [mis(x) for x in lines]
    per = -(-len(lines) // columns)
    grid = [[(c, y, lines[c * per + y]) for c in range(columns) if c * per + y < len(lines)] for y in range(per)]
    if joined:
        rows = [("     ".join(t for *_, t in g), 60, 80 + 20 * y, 60 + 400 * len(g)) for y, g in enumerate(grid)]
    else:
        rows = [(t, 60 + 400 * c, 80 + 20 * y, 60 + 400 * c + 380) for g in grid for c, y, t in g]
    return "\n".join(t for t, *_ in rows), [{"x0": x, "y0": y, "x1": x1, "y1": y + 15, "conf": 90} for _, x, y, x1 in rows]


def run(spark, pages, items, **kw):
    docs = spark.createDataFrame([(i, t, b, 1, "p", "w") for i, t, b in pages], SCHEMA)
    held = spark.createDataFrame([(i, p, q, "e") for i, p, q in items], "item_id bigint, passage string, question string, doc_id string")
    return sorted(tuple(r) for r in leaked_items(docs, held, **kw).collect())


def test_planted_passages_in_every_layout(spark):
    r = random.Random(2)
    items = [(k, " ".join(prose(r, 50)), " ".join(prose(r, 10))) for k in range(1, 9)]
    pages, want = [], []
    for k in range(120):
        body = prose(r, 120)
        item = r.choice(items)
        source = (item[1] + " " + item[2]).split()
        n = r.choice([0, 8, 14, 30, 60])
        at = r.randrange(0, len(source) - n + 1)
        # a different word on each side, so that the run is exactly n words
        text = [*body[:60], "zzzzqqzz", *source[at : at + n], "qqzzqqzz", *body[60:]]
        t, b = page(r, text, *r.choice([(1, False), (2, False), (2, True), (3, True)]), noise=r.choice([0, 0.01]))
        pages.append((k, t, b))
        if n >= 12:
            want.append((k, item[0]))
    got = run(spark, pages, items)
    assert set(got) - set(want) == set()
    assert len(set(got) & set(want)) >= 0.97 * len(want)


def test_nulls_empty_long_and_repeats(spark):
    r = random.Random(4)
    passage = prose(r, 40)
    long = prose(r, 30_000) + passage + prose(r, 30_000)
    items = [(1, " ".join(passage), None), (2, None, "short one"), (3, " ".join(passage), None)]
    pages = [(1, None, None), (None, " ".join(passage), None), (2, "", []), (3, " ".join(passage), None), (3, " ".join(passage), None), (4, " ".join(long), [])]
    assert run(spark, pages, items) == [(3, 1), (3, 3), (4, 1), (4, 3)]
    assert run(spark, [], items) == [] == run(spark, pages, [])


def test_items_in_several_chunks(spark):
    r = random.Random(6)
    items = [(k, " ".join(prose(r, 30)), "") for k in range(7)]
    pages = [(k, p, None) for k, p, _ in items]
    assert run(spark, pages, items, params=LeakParams(item_chunk=2)) == [(k, k) for k in range(7)]


def test_prefix_edits_is_the_edit_distance_to_the_closest_prefix():
    r = np.random.default_rng(0)
    a, b = r.integers(1, 4, (300, 12)).astype(np.uint8), r.integers(1, 4, (300, 16)).astype(np.uint8)
    got = prefix_edits(a, b)
    assert [min(_edits(bytes(x), bytes(y[:k])) for k in range(17)) for x, y in zip(a, b, strict=True)] == got.tolist()


@pytest.mark.parametrize("edits", [1, 2])
def test_hashes_find_edited_windows(edits):
    """Recall of one window with a few edits; a passage has several windows."""
    r = random.Random(8)
    p = LeakParams()
    found, range_ = 0, range(4)
    for _ in range(200):
        text = squeeze("".join(prose(r, 20)))[:80]
        other = bytearray(text)
        for _ in range(edits):
            k = r.randrange(4, 40)
            other[k : k + 1] = r.choice([b"", bytes([r.randrange(1, 36)]), bytes([other[k], r.randrange(1, 36)])])
        flats = [np.frombuffer(bytes(x) + bytes(80), np.uint8) for x in (text, other)]
        hashes = [list(embed_hashes(f, np.zeros(1, np.int64), p, range_)) for f in flats]
        found += any(x[0] == y[0] for x, y in zip(*hashes, strict=True))
    assert found >= (185 if edits == 1 else 150)


def test_as_many_hashes_as_the_recall_needs():
    few, many = hashes(LeakParams(recall=0.8)), hashes(LeakParams(recall=0.97, misread=0.12))
    assert 1 <= few <= many
    assert len(ItemIndex([(1, " ".join(WORDS[:20]))], LeakParams()).tables) == 5 * hashes(LeakParams())
    with pytest.raises(ValueError):
        hashes(LeakParams(recall=0.999, misread=0.4, sampled=20))


def _share(cases, noise, cut, advert, seed=1):
    """Of `cases` pages that print 14 words in a row, how many are found; cut: words before an advert of so many words."""
    r = random.Random(seed)
    items = [(k, " ".join(prose(r, 60))) for k in range(cases)]
    texts = []
    for _, words in items:
        w = words.split()
        at = r.randrange(0, len(w) - 14)
        run_ = w[at : at + 14]
        t = [*prose(r, 60), *run_[:cut], *prose(r, advert), *run_[cut:], *prose(r, 60)]
        texts.append("\n".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() and r.random() < noise else c for c in w) for w in t))
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("x0", "y0", "x1", "y1", "conf")]))
    got = set(pages_with_items(texts, boxes(pa.array([None] * cases, kind)), ItemIndex(items, LeakParams())))
    assert all(a == b for a, b in got)
    return len(got) / cases


@pytest.mark.parametrize(("noise", "cut", "advert", "least"), [(0, 0, 0, 1.0), (0.03, 0, 0, 0.95), (0.06, 0, 0, 0.9), (0, 7, 60, 0.97), (0, 7, 300, 0.97), (0, 10, 110, 0.97), (0, 11, 300, 0.95), (0.03, 10, 110, 0.8)])
def test_recall_of_misread_and_cut_runs(noise, cut, advert, least):
    assert _share(150, noise, cut, advert) >= least


def test_stretches_are_all_equal_runs():
    r = random.Random(3)
    a, b = (bytes(r.choice(range(1, 4)) for _ in range(n)) for n in (60, 90))
    g = grams(b, 4)
    order = np.argsort(g, kind="stable")
    want = set()
    for d in range(-60, 90):
        s = 0
        while s < 60:
            e = s
            while e < 60 and 0 <= e + d < 90 and a[e] == b[e + d]:
                e += 1
            if e - s >= 4:
                want.add((s, e, d))
            s = max(e, s + 1)
    assert set(_stretches(grams(a, 4), (g[order], order), 4)) == want


def test_index_without_items():
    assert ItemIndex([], LeakParams()).tables == []
