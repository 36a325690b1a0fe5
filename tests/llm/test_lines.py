import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetstream.llm import lines
from fleetstream.llm.common import table
from fleetstream.llm.crf import ChainCrf, Sequences
from tests.conftest import SF

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "a", "a b c a b c a b c", "x\n\nx\nx \n  \n", "#### |||| <>\n" * 5, "nbsp joined word here", "word " * 20000, "\n".join(f"line {i % 7} of many" for i in range(9000)), "é漢🎉 ß\r\ny\x0bz\x0cw"]


def plain_base(text):
    words = SPACE.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def random_crf(rnd, features=6, labels=2):
    crf = ChainCrf(features, labels)
    crf.weights, crf.moves, crf.first = rnd.normal(size=(features, labels)), rnd.normal(size=(labels, labels)), rnd.normal(size=labels)
    return crf


def path_score(crf, seq, path):
    out = crf.first[path[0]]
    for t, (f, y) in enumerate(zip(seq, path)):
        out += crf.weights[f, y].sum() + (crf.moves[path[t - 1], y] if t else 0)
    return out


@pytest.mark.parametrize("labels", [2, 3])
def test_viterbi_and_gradient_against_all_paths(labels):
    rnd = np.random.default_rng(2)
    crf = random_crf(rnd, labels=labels)
    seqs = [[list(rnd.choice(6, size=rnd.integers(0, 4), replace=False)) for _ in range(n)] for n in (4, 1, 0, 5, 2)]
    data = Sequences.of(seqs)
    got, at, best_total = crf.decode(data), 0, 0.0
    gold = rnd.integers(0, labels, int(data.lengths.sum()))
    value = 0.0
    for s in seqs:
        if not s:
            continue
        paths = list(itertools.product(range(labels), repeat=len(s)))
        scores = [path_score(crf, s, p) for p in paths]
        assert tuple(got[at : at + len(s)]) == paths[int(np.argmax(scores))]
        value += path_score(crf, s, gold[at : at + len(s)]) - np.logaddexp.reduce(scores)
        at += len(s)
    found, by_weight, by_move, by_first = crf.gradient(data, gold)
    assert found == pytest.approx(value)
    for part, slope in ((crf.weights, by_weight), (crf.moves, by_move), (crf.first, by_first)):
        for i in np.ndindex(part.shape):
            part[i] += 1e-5
            up = crf.gradient(data, gold)[0]
            part[i] -= 2e-5
            down = crf.gradient(data, gold)[0]
            part[i] += 1e-5
            assert slope[i] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_base_counts_of_the_whole_table(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    crf = lines.train(docs, labels)
    rows = lines.label_lines(docs, crf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(texts[r.doc_id])
        assert r.kept == (not r.base_failed and 2 * r.content_words >= r.n_words)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    judged = Counter((marks[r.doc_id], r.kept) for r in rows if r.doc_id in marks and not r.base_failed)
    assert judged[1, True] >= 0.97 * (judged[1, True] + judged[1, False])
    assert judged[0, False] >= 0.8 * (judged[0, False] + judged[0, True])


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(ODD)], "doc_id long, text string, kept boolean")
    crf = lines.train(docs, spark.createDataFrame([(5, 0), (9, 1), (None, 1), (3, None)], "doc_id long, quality int"))
    rows = {r.doc_id: r for r in lines.label_lines(docs.union(docs), crf).collect()}
    for i, t in enumerate(ODD):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(t)
        assert len(r.line_labels) == sum(bool(SPACE.search(x)) for x in (t or "").split("\n"))
    assert not rows[0].kept and rows[9].n_words == 36000
    assert lines.label_lines(docs.limit(0), ChainCrf(lines.FEATURES)).count() == 0
    empty = lines.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert not empty.weights.any()


def test_random_texts_against_plain_counts():
    rnd = random.Random(8)
    for _ in range(300):
        t = "".join(rnd.choice(["a", "b", "é", " ", " ", "\n", "#", "A", "\t", "|", "漢"]) for _ in range(rnd.randint(0, 120)))
        base, features, n = lines.describe(t)
        assert base == plain_base(t)[:5]
        assert len(features) == len(n) and int(n.sum()) == base[0]
        assert not len(n) or (features.min() >= 0 and features.max() < lines.FEATURES)
