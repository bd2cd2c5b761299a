import random

import numpy as np

from tapeloom.llm.subjects import Encoded, SubjectParams, complement_weights, encode_pages, page_subjects

AREAS = {"sea": ["keel", "anchor", "harbour", "rigging", "tide", "pilot"], "farm": ["wheat", "plough", "barn", "ewe", "manure", "hedge"], "court": ["judge", "verdict", "bail", "statute", "jury", "appeal"]}
COMMON = "the of and was near letter programme district yesterday Monday committee said public matter".split()
BOX = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:int>>"


def article(r, area, n):
    return " ".join(" ".join(r.sample(COMMON, 5) + r.sample(AREAS[area], 2) + r.sample(COMMON, 3)) + "." for _ in range(n))


def corpus(r, n):
    out = []
    for k in range(n):
        areas = r.sample(sorted(AREAS), r.choice([0, 1, 1, 2]))
        parts = [article(r, a, r.randint(4, 9)) for a in areas]
        for a in AREAS:  # single passing sentences
            if a not in areas and r.random() < 0.2:
                parts.append(article(r, a, 1))
        if r.random() < 0.1:
            parts.append("According to Klyristorro the wheat and the judge and the keel weighed nothing after all. " * 4)
        r.shuffle(parts)
        out.append((k, " ".join(parts), None, set(areas)))
    return out


def frames(spark, pages, labels):
    docs = spark.createDataFrame([(k, t, b, 1, "x", None) for k, t, b, *_ in pages], f"doc_id bigint, text string, line_box {BOX}, page_id int, subject string, toks binary")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, labelled_by string, page_id int")
    areas = spark.createDataFrame([(a, "") for a in AREAS] + [(None, "")], "subject string, about string")
    items = spark.createDataFrame([(1, "According to Klyristorro the wheat and the judge and the keel weighed nothing after all.", "Why?")], "item_id bigint, passage string, question string")
    return docs, lab, areas, items


def test_held_out_accuracy(spark):
    r = random.Random(3)
    pages = corpus(r, 400)
    labels = [(k, a, "desk", 1) for k, _, _, areas in pages[:120] for a in (sorted(areas) or [None])]
    labels += [(5, "sea", "reader", 1), (9_999, "sea", "desk", 1), (7, "no such area", "desk", 1), (None, "sea", "desk", 1)]
    got = {}
    for x in page_subjects(*frames(spark, pages, labels)).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
        assert 0.5 <= x.posterior <= 1
    tp = fp = fn = 0
    for k, *_, areas in pages[120:]:
        g = got.get(k, set())
        tp, fp, fn = tp + len(g & areas), fp + len(g - areas), fn + len(areas - g)
    assert 2 * tp / (2 * tp + fp + fn) > 0.93


def test_edges(spark):
    r = random.Random(5)
    pages = corpus(r, 60)
    labels = [(k, a, "desk", 1) for k, _, _, areas in pages for a in areas]
    odd = [(100, None, None), (101, "", []), (None, "keel anchor.", None), (102, "x" * 300_000, None), (103, pages[0][1], None), (103, pages[0][1], None)]
    docs, lab, areas, items = frames(spark, pages + odd, labels)
    got = page_subjects(docs, lab, areas, items).collect()
    assert {g.doc_id for g in got} <= {k for k, *_ in pages} | {103}
    assert len({(g.doc_id, g.subject) for g in got}) == len(got)
    assert page_subjects(docs.limit(0), lab, areas, items).count() == 0
    assert page_subjects(docs, lab.limit(0), areas, items).count() == 0


def test_complement_weights_prefer_the_class_of_a_word():
    w = complement_weights(np.array([[9.0, 0.0], [1.0, 8.0], [1.0, 1.0]] + [[0.0, 0.0]] * 0).repeat(1, axis=0), 1.0)
    assert w[0].argmax() == 0 and w[1].argmax() == 1


def test_encoding_keeps_whole_texts():
    texts = ["The wheat was near the barn. Yesterday the judge said so.", None, "", " ".join(["keel anchor tide."] * 5000)]
    toks, lens = encode_pages(texts, (np.zeros(5, np.int64), *[np.zeros(0, np.int64)] * 3))
    e = Encoded.of(toks, lens)
    assert e.pages == 4 and len(e.length) == 5002 and e.length.sum() == len(e.tok)
    post = e.posteriors(np.zeros((1 << 16, 3), np.float32), 4.0)
    assert np.allclose(post, 1 / 3)
    assert e.evidence(post, 2, SubjectParams().window).shape == (4, 2, 6)


def test_only_keeps_the_pages_of_the_mask():
    e = Encoded(np.array([5, 6, 7, 8, 9, 10]), np.array([2, 1, 3]), np.array([0, 1, 2]), 3)
    x = e.only(np.array([True, False, True]))
    assert (x.tok.tolist(), x.length.tolist(), x.page.tolist(), x.pages) == ([5, 6, 8, 9, 10], [2, 3], [0, 1], 2)


def test_every_sentence_counts_in_each_class_by_its_posterior():
    e = Encoded(np.array([5, 6, 6]), np.array([2, 1]), np.array([0, 0]), 1)
    got = e.expected(np.array([[0.25, 0.75], [0.5, 0.5]]))
    assert got[:, 5].tolist() == [0.25, 0.75] and got[:, 6].tolist() == [0.75, 1.25] and got.sum() == 3
