"""Document quality by labelling each line as content or boilerplate with a linear-chain conditional random field."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstream.llm.common import bounded_sample
from fleetstream.llm.crf import ChainCrf, Sequences

SYMBOLS = "#*$%&|<>"
#: Labelled documents that the field is fitted on, at most, and steps of them.
FIT_DOCS, FIT_LINES = 3000, 60_000
MIN_WORDS, REPEAT_PERCENT, CONTENT_SHARE = 50, 50, 0.5
BOILERPLATE, CONTENT = 0, 1
WORD, SYMBOL, UPPER, DIGIT, MARK, EXCLAIM = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    """Bits of what each of the first 256 code points is; later ones are parts of words."""
    out = np.full(256, WORD, dtype=np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = 0
    for c in range(256):
        bits = (chr(c) in SYMBOLS, SYMBOL), (chr(c).isupper(), UPPER), (chr(c).isdigit() and c < 128, DIGIT), (chr(c) in ".,;:?", MARK), (chr(c) == "!", EXCLAIM)
        out[c] |= sum(bit for on, bit in bits if on)
    return out


CLASSES = _classes()
KINDS = (SYMBOL, UPPER, DIGIT, MARK, EXCLAIM)
EDGES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7])
SIZES = np.array([1, 2, 4, 8, 16, 32])
VARIETY = np.array([0.2, 0.4, 0.6, 0.8])
BINS = len(EDGES) + 1
FEATURES = len(KINDS) * BINS + (len(SIZES) + 1) * 2 + (len(VARIETY) + 1) + 5
#: Features of a line: bins of the shares of five kinds of characters, words, characters per word, variety of words; repeat, place, close.


def describe(text: str | None) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """Base counts of a text (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), then for each line with a word its features and its number of words."""
    if not text or not (raw := text.encode("utf-8", "surrogatepass")).split():
        return (0, 0, 0 if not text else sum(map(text.count, SYMBOLS)), 0, 0), np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = CLASSES[np.minimum(codes, 255)]
    kinds[codes > 255] = WORD
    words = raw.split()
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        count = Counter(triples)
        on = np.fromiter((count[t] > 1 for t in triples), dtype=bool, count=len(triples))
        cover = np.zeros(len(words), dtype=bool)
        for k in range(3):
            cover[k : k + len(on)] |= on
        repeated = int(cover.sum())
    lines = [(x, w) for x in raw.split(b"\n") if (w := x.split())]
    seen: set[bytes] = set()
    again = []
    for x, _ in lines:
        again.append(x in seen)
        seen.add(x)
    breaks = np.flatnonzero(codes == 10)
    starts, ends = np.r_[0, breaks + 1], np.r_[breaks, len(codes)]
    solid = np.r_[0, np.cumsum(kinds & WORD != 0)]
    mine = solid[ends] - solid[starts]
    keep = mine > 0
    starts, ends, mine = starts[keep], ends[keep], mine[keep]
    n = np.array([len(w) for _, w in lines])
    columns, base = [], 0
    for kind in KINDS:
        total = np.r_[0, np.cumsum(kinds & kind != 0)]
        columns.append(base + np.searchsorted(EDGES, (total[ends] - total[starts]) / mine, side="left"))
        base += BINS
        if kind == SYMBOL:
            n_symbols = int(total[-1])
    for x in (n, mine / n):
        columns.append(base + np.searchsorted(SIZES, x, side="right"))
        base += len(SIZES) + 1
    columns.append(base + np.searchsorted(VARIETY, np.array([len(set(w)) for _, w in lines]) / n, side="right"))
    base += len(VARIETY) + 1
    columns.append(base + np.array(again, dtype=np.int64))
    place = np.zeros(len(n), dtype=np.int64)
    place[-1], place[0] = 1, 2
    columns.append(base + 2 + place)
    return (len(words), int(solid[-1]), n_symbols, int(sum(again)), repeated), np.stack(columns, axis=1), n


def _sequences(features: list[np.ndarray]) -> Sequences:
    lengths = np.array([len(f) for f in features], dtype=np.int64)
    flat = np.concatenate([f.reshape(-1) for f in features if len(f)]) if lengths.sum() else np.zeros(0, np.int64)
    width = len(flat) // max(1, int(lengths.sum()))
    return Sequences(flat, np.repeat(np.arange(int(lengths.sum())), width), lengths)


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS, lines: int = FIT_LINES) -> ChainCrf:
    """A field fitted on lines of at most ``most`` labelled documents (and about ``lines`` lines, in the order of the sample).

    A document's quality mark is taken as the mark of its lines; a line that
    repeats an earlier one is boilerplate in any document. The same number is
    drawn of good and of bad documents.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).dropna()
    drawn = [bounded_sample(marked.filter(F.col("good") == q).distinct(), "doc_id", most // 2) for q in (0, 1)]
    sample = drawn[0].union(drawn[1])  # at most ``most`` rows: safe to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [describe(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f.astype("<i2").tobytes() for _, f, _ in found], pa.binary()), pa.array([len(n) for _, _, n in found], pa.int32())], ["doc_id", "good", "features", "lines"])

    rows = texts.select("doc_id", "text", "good").mapInArrow(features, "doc_id long, good int, features binary, lines int").filter("lines > 0").collect()
    used, data, gold = 0, [], []
    for r in sorted(rows, key=lambda r: (r.lines > 400, hash((r.doc_id, 7)), r.doc_id, r.good)):
        if used + r.lines > lines:
            continue
        used += r.lines
        f = np.frombuffer(r.features, dtype="<i2").astype(np.int64).reshape(r.lines, -1)
        data.append(f)
        gold.append(np.where(f[:, -2] == FEATURES - 4, BOILERPLATE, r.good))  # the last column but one says whether a line repeats another
    return ChainCrf(FEATURES).fit(_sequences(data), np.concatenate(gold)) if data else ChainCrf(FEATURES)


def label_lines(docs: DataFrame, crf: ChainCrf, share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, line_labels, kept: a row per row.

    line_labels: 1 (content) or 0 (boilerplate) for each line that has a word,
    by Viterbi; content_words: words in content lines. kept: the base rules hold
    and content lines have ``share`` of the words or more. Null, empty and
    white-space texts have no words, fail the base and are not kept; long texts
    are taken whole; repeated rows are judged alike; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [describe(t) for t in batch.column(1).to_pylist()]
            marks = crf.decode(_sequences([f for _, f, _ in found]))
            ends = np.cumsum([len(n) for _, _, n in found], dtype=np.int64)
            parts = np.split(marks, ends[:-1]) if len(found) else []
            base = np.array([b for b, _, _ in found], dtype=np.int64).reshape(-1, 5)
            content = np.array([int(n[m == CONTENT].sum()) for (_, _, n), m in zip(found, parts, strict=True)], dtype=np.int64)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])
            kept = ~failed & (content >= share * base[:, 0])
            columns = [batch.column(0), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(content), pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_words", "line_labels", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_words long, line_labels array<int>, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
