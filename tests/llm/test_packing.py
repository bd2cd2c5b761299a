import os
import random

import numpy as np
import pytest

from tapeloom.llm.packing import TOKENIZER, best_two_fit, encoder, pack_documents

needs_vocabulary = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")


def slow(sizes, capacity):
    """Best-two-fit over a plain list: the sizes of each container."""
    left = sorted(sizes)
    out = []
    while left:
        held, gap = [], capacity
        while fits := [s for s in left if s <= gap]:
            left.remove(fits[-1])
            held.append(fits[-1])
            gap -= fits[-1]
        if gap and left and len(held) > 1:
            room = gap + held[-1]
            pairs = [(left[i] + left[j], left[j], left[i]) for i in range(len(left)) for j in range(i) if left[i] + left[j] <= room]
            if pairs and max(pairs)[0] > held[-1]:
                total, a, b = max(pairs, key=lambda p: (p[0], max(p[1:])))
                left.append(held.pop())
                left.remove(a)
                left.remove(b)
                held += [a, b]
                left.sort()
        out.append(sorted(held))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_against_plain_lists(seed):
    r = random.Random(seed)
    cap = r.choice([10, 30, 64])
    sizes = [r.randint(1, cap if seed % 2 else cap // 2) for _ in range(60)]
    bins = best_two_fit(np.array(sizes), cap)
    got = [sorted(s for s, b in zip(sizes, bins, strict=True) if b == k) for k in range(bins.max() + 1)]
    assert all(sum(g) <= cap for g in got)
    assert [sum(g) for g in got] == [sum(g) for g in slow(sizes, cap)]


def test_the_second_item_helps():
    # greedy takes 6 and 3 of 10; 2 and 2 fill the gap of 4 that 3 left
    bins = best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_edges():
    assert best_two_fit(np.zeros(0, int), 5).tolist() == []
    assert best_two_fit(np.array([5, 5]), 5).tolist() in ([0, 1], [1, 0])


@needs_vocabulary
def test_every_token_has_a_place(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["page", "of", "the", "paper", "Zeitung", "1871"]) for _ in range(r.choice([1, 20, 300, 900, 5000]))) for _ in range(60)]
    rows = [(k, t, 9, "x") for k, t in enumerate(texts)] + [(0, texts[0], 9, "x"), (70, None, 1, ""), (71, "", 1, ""), (None, "a", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, container int, shard string")
    got = pack_documents(docs, capacity=512, shard_items=40).collect()
    used, per = {}, {}
    for g in got:
        used[g.container] = used.get(g.container, 0) + g.n_tokens
        per.setdefault(g.doc_id, []).append((g.part, g.n_tokens))
    enc = encoder(TOKENIZER)
    want = {k: len(enc.encode_ordinary(t)) for k, t in enumerate(texts)}
    assert max(used.values()) <= 512 and set(per) == set(want)
    for k, n in want.items():
        parts = sorted(per[k])
        if k == 0:
            assert sum(m for _, m in parts) == 2 * n
            continue
        assert [p for p, _ in parts] == list(range(len(parts))) and sum(m for _, m in parts) == n
        assert len(parts) == 1 if n <= 512 else all(m == 512 for _, m in parts[:-1])
    unused = len(used) * 512 - sum(used.values())
    assert unused <= 0.03 * sum(used.values()) + 512 * 4


@needs_vocabulary
def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
