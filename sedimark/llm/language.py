"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (1 to 3 code points of the lower-cased text) in ``BUCKETS`` hash buckets for each
language.  The smoothed log-probability matrix is cut into blocks of ``LANGUAGES_AT_ONCE`` languages, 33 MB
each at most; one block is broadcast, several are files in the shared folder that workers map into memory.  A
text is scored in numpy as a sparse vector: the buckets that it has, times the matrix.  The fit uses a bounded
sample of labelled rows (``max_training_rows``): as many of each language, or all of a rarer one, drawn at
random; every whole text is scored.

Edge cases: a null text, or one without any letter, is ``und`` with score 0; rows with null language
aren't learnt from; null ``doc_id`` is held in as crc32 of the empty text, and rows with null or repeated
ids are drawn like others; ties go to the first language in alphabetical order; an empty table, or one
without labels, gives ``und`` for all.  Very long texts are counted in slices.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import cut, filesystem, mix64, release, scratch_path

BUCKETS = 1 << 15
MAX_TRAINING_ROWS = 20_000
#: Languages of one block of the matrix (128 kB each).
LANGUAGES_AT_ONCE = 256
#: Characters whose n-grams are counted at once.
SLICE = 1 << 17
UNKNOWN = "und"


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def ngram_buckets(text: str, lowered: bool = False) -> np.ndarray:
    """Hash buckets of all 1- to 3-grams of the lower-cased code points."""
    codes = np.frombuffer((text if lowered else text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams = [codes]
    if len(codes) > 1:
        grams.append(codes[:-1] << np.uint64(21) | codes[1:] | np.uint64(1 << 63))
    if len(codes) > 2:
        grams.append(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:])
    return (mix64(np.concatenate(grams)) >> np.uint64(49)).astype(np.int32)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that the text has, how often), slice by slice; slices overlap so that no n-gram is lost."""
    if len(text) <= SLICE:
        found = np.bincount(ngram_buckets(text), minlength=BUCKETS)
    else:
        found = np.zeros(BUCKETS, np.int64)
        low = text.lower()
        for first in range(0, len(low), SLICE):
            found += np.bincount(ngram_buckets(low[first : first + SLICE + 2], True), minlength=BUCKETS)
            if rest := low[first + SLICE : first + SLICE + 2]:  # the overlap's own n-grams belong to the next slice
                found -= np.bincount(ngram_buckets(rest, True), minlength=BUCKETS)
    at = np.flatnonzero(found)
    return at, found[at]


def training_sample(rows: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """About ``most`` rows at random, or all if there are fewer; as many for each value of ``by``, or all of a rarer one.

    Each row is drawn by itself, so the bound also holds where a third of all rows are equal.
    """
    if by is None:
        n = rows.count()
        return rows if n <= most else rows.where(F.rand(17) < most / n)
    sizes = cut(rows.groupBy(by).agg(F.count("*").alias("n")), "training-sizes")
    share = most / max(sizes.count(), 1)
    if not sizes.where(F.col("n") > share).limit(1).count():
        return rows
    return rows.join(sizes, by).where(F.rand(17) * F.col("n") < share).select(*rows.columns)


def _counts(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            at, n = ngram_counts(text)
            sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += n
            if len(sums) > LANGUAGES_AT_ONCE:
                yield from _count_rows(sums)
                sums = {}
    yield from _count_rows(sums)


def _count_rows(sums):
    for lang, own in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [own.tobytes()]})


def _add(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in group:
        for raw in batch.column("counts"):
            total += np.frombuffer(raw.as_buffer(), np.int64)
    yield pa.RecordBatch.from_pydict({"lang": [key[0].as_py()], "counts": [total.tobytes()]})


class Model:
    """Languages in alphabetical order and the blocks of their log-probabilities (buckets x languages)."""

    def __init__(self, languages: list[str], first: np.ndarray | None, paths: list[str]):
        self.languages, self.first, self.paths = languages, first, paths

    def blocks(self):
        if self.first is not None:
            yield self.first
        for path in self.paths:
            files, at = filesystem(path)
            with files.open_input_stream(at) as f:
                yield np.load(io.BytesIO(f.read()))


def _matrix(rows) -> np.ndarray:
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in rows], np.float64).reshape(len(rows), BUCKETS) + 0.5
    return np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32))


def fit(rows: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> Model:
    """The model (uniform prior) of (text, lang) rows; the driver holds one block at a time.

    Each partition sends one count vector for each language, and they are summed by language.
    """
    sample = training_sample(rows.select("text", "lang"), max_training_rows, "lang")
    found = sample.mapInArrow(_counts, "lang string, counts binary").groupBy("lang").applyInArrow(_add, "lang string, counts binary")
    found = cut(found, "language-counts")
    names = sorted(r.lang for r in found.select("lang").collect())
    first, paths = None, []
    for k in range(0, len(names), LANGUAGES_AT_ONCE):
        some = names[k : k + LANGUAGES_AT_ONCE]
        block = _matrix(sorted(found.where(F.col("lang").between(some[0], some[-1])).collect(), key=lambda r: r.lang))
        if len(names) <= LANGUAGES_AT_ONCE:
            first = block
            break
        folder = scratch_path(rows.sparkSession, "language-block")
        files, at = filesystem(folder)
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/block.npy") as f:
            raw = io.BytesIO()
            np.save(raw, block)
            f.write(raw.getvalue())
        paths.append(f"{folder}/block.npy")
    release(found)
    return Model(names, first, paths)


def _scores(model: Model, texts: list[str | None]) -> list[np.ndarray | None]:
    """The log-probabilities of each text by language; None for those without a letter."""
    sparse = [ngram_counts(x) if model.languages and x and any(map(str.isalpha, x)) else None for x in texts]
    out = [None if s is None else [] for s in sparse]
    for block in model.blocks():
        for s, parts in zip(sparse, out):
            if s is not None:
                at, n = s
                parts.append(n.astype(np.float64) @ block[at])
    return [None if x is None else np.concatenate(x) for x in out]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Columns of ``docs`` (with doc_id, held_out, text) less text, plus lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        own = shared.value
        for batch in batches:
            names, scores = [], np.zeros(batch.num_rows)
            for i, total in enumerate(_scores(own, batch.column("text").to_pylist())):
                if total is None:
                    names.append(UNKNOWN)
                    continue
                best = int(total.argmax())
                names.append(own.languages[best])
                scores[i] = 1 / np.exp(total - total[best]).sum()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Fit on rows that aren't held out (crc32 of the id mod 3 is not 1), then predict every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 3, 1).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learnt = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return predict(rows, fit(learnt, max_training_rows))
