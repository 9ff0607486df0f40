"""Quality rules: base counts of a document, and the divergence of its histograms from its language's.

Two histograms of a document, of character classes and of common words, are compared with those of
each language by the Jensen-Shannon distance (base 2, so 0 to 1). The references are the sums over all
documents of a language. A document in a language of COMMON_WORDS is compared with all of these that the
corpus holds; one in another language by its character classes alone, with its own language's. Where its
language is null or has no reference, the base rules alone decide. Both passes are scans without a shuffle
of documents.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspan.llm.words import SCAN_BYTES, Words, blocks, word_hash

# Common words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it on with as was be by are this from or at an not have which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo como más o pero sus".split(),
}
SYMBOLS = b"#*$%&|<>"
#: lower, upper, digit, beyond ASCII, white space, sentence marks, symbols, other marks
N_CLASSES = 8
_CLASS = np.full(256, 7)
_CLASS[[*range(97, 123)]], _CLASS[[*range(65, 91)]], _CLASS[[*range(48, 58)]] = 0, 1, 2
_CLASS[192:], _CLASS[128:192] = 3, N_CLASSES
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[[*b".,;:'\"-()"]], _CLASS[[*SYMBOLS]] = 4, 5, 6

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = ", ".join(f"{c} long" for c in COUNTS) + ", class_distance double, word_distance double, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Limits:
    """A document is judged by a histogram from `min_words` words on; beyond a distance it is rejected."""

    min_words: int = 100
    class_distance: float = 0.28
    word_distance: float = 0.28


def _vocabulary() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all common words, and by language (rows) which of them are its own."""
    names = sorted({w for words in COMMON_WORDS.values() for w in words})
    hashes = np.array([word_hash(w) for w in names])
    order = np.argsort(hashes)
    own = np.array([[names[i] in words for i in order] for words in COMMON_WORDS.values()])
    return hashes[order], own


def histograms(block: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By document: counts of character classes, and of common words with all other words last."""
    n = len(block)
    doc = np.repeat(np.arange(n), np.diff(block.doc_bytes))
    classes = np.bincount(doc * (N_CLASSES + 1) + _CLASS[block.data], minlength=n * (N_CLASSES + 1)).reshape(n, -1)[:, :N_CLASSES]
    at = np.searchsorted(vocabulary, block.hashes).clip(max=len(vocabulary) - 1)
    at[vocabulary[at] != block.hashes] = len(vocabulary)
    words = np.bincount(block.doc * (len(vocabulary) + 1) + at, minlength=n * (len(vocabulary) + 1)).reshape(n, -1)
    return classes, words


def _repeated_words(block: Words, size: int) -> np.ndarray:
    """By document: words that lie in a run of `size` words found twice or more in the document."""
    hashes, at = block.windows(size)
    covered = np.zeros(len(block.hashes), bool)
    if len(at):
        keys = hashes ^ (block.doc[at].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for j in range(size):
            covered[at[twice] + j] = True
    return block.per_doc(covered)


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def base_counts(block: Words) -> dict[str, np.ndarray]:
    """The counts of COUNTS, by document."""
    in_word = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((_CLASS[block.data] != 4) & (_CLASS[block.data] != N_CLASSES), out=in_word[1:])
    symbols = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(_CLASS[block.data] == 6, out=symbols[1:])
    raw, cut = block.data.tobytes(), block.doc_bytes
    return {
        "n_words": block.counts,
        "word_chars": np.diff(in_word[cut]),
        "n_symbols": np.diff(symbols[cut]),
        "n_dup_lines": np.array([_duplicate_lines(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.int64),
        "n_repeat_words": _repeated_words(block, 3),
    }


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(-1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of shares along the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        half = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(-1)
        return np.sqrt(np.maximum((half(p) + half(q)) / 2, 0))


def _distances(classes: np.ndarray, words: np.ndarray, langs: np.ndarray, references: dict[str, tuple[list, list]], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By document: distance of either histogram to that language whose worse one is the least.

    In a language without common words the class distance to it alone, and 0 without a reference for the language.
    """
    both = []
    for i, lang in enumerate(COMMON_WORDS):
        if lang in references:
            keep = np.flatnonzero(own[i])
            narrow = lambda x, keep=keep: np.concatenate([x[..., keep], (x.sum(-1) - x[..., keep].sum(-1))[..., None]], -1)
            class_ref, word_ref = (np.asarray(x, float) for x in references[lang])
            both.append((js_distance(_shares(classes), _shares(class_ref)), js_distance(_shares(narrow(words)), _shares(narrow(word_ref)))))
    out = np.zeros((2, len(classes)))
    if both:
        near, far = (np.array([x[k] for x in both]) for k in (0, 1))
        best = np.argmin(np.maximum(near, far), 0)
        at = np.arange(len(classes))
        out[:] = near[best, at], far[best, at]
    for lang in set(langs):
        if lang not in COMMON_WORDS or lang not in references:
            rows = langs == lang
            out[:, rows] = 0
            if lang in references:
                out[0, rows] = js_distance(_shares(classes[rows]), _shares(np.asarray(references[lang][0], float)))
    return out[0], out[1]


def _lang(docs: DataFrame, lang: str) -> Column:
    return (F.col(lang) if lang in docs.columns else F.lit(None)).cast("string").alias("lang")


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[list, list]]:
    """By language, the histograms summed over all documents of it; word counts only for those of COMMON_WORDS.

    A row for each bin of each language of the table reaches the driver. Null languages take no part; a language
    without documents has no reference.
    """
    vocabulary, _ = _vocabulary()
    width = N_CLASSES + len(vocabulary) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = _langs(batch.column(1))
            for block in blocks(batch.column(0), size=SCAN_BYTES):
                rows = np.concatenate(histograms(block, vocabulary), 1)
                for k in set(langs[block.rows]) - {None}:
                    x = rows[langs[block.rows] == k].sum(0)
                    x[N_CLASSES if k not in COMMON_WORDS else width :] = 0
                    total[k] = total.get(k, 0) + x
        found = [(k, j, int(v)) for k, row in total.items() for j, v in enumerate(row) if v]
        if found:
            yield pa.RecordBatch.from_pydict(dict(zip(("lang", "bin", "n"), map(list, zip(*found, strict=True)), strict=True)), pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64())]))

    source = docs.select(F.col(text).cast("string").alias("text"), _lang(docs, lang))
    out: dict[str, np.ndarray] = {}
    for r in source.mapInArrow(sums, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["lang"], np.zeros(width))[r["bin"]] = r["n"]
    return {k: (v[:N_CLASSES].tolist(), v[N_CLASSES:].tolist()) for k, v in out.items()}


def _langs(column: pa.Array) -> np.ndarray:
    return np.array([*column.to_pylist(), None], object)[:-1]


def _verdicts(column: pa.Array, langs: np.ndarray, references: dict, limits: Limits, vocabulary: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray]:
    parts = []
    for block in blocks(column, size=SCAN_BYTES):
        x = base_counts(block)
        x["class_distance"], x["word_distance"] = _distances(*histograms(block, vocabulary), langs[block.rows], references, own)
        parts.append(x)
    x = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (*COUNTS, "class_distance", "word_distance")}
    x["base_failed"] = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
    diverges = (x["n_words"] >= limits.min_words) & ((x["class_distance"] > limits.class_distance) | (x["word_distance"] > limits.word_distance))
    x["kept"] = ~x["base_failed"] & ~diverges
    return x


def quality_verdicts(docs: DataFrame, references: dict[str, tuple[list, list]], limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, the counts of COUNTS, both distances, base_failed and kept, one row for each row of docs.

    A null or empty text has no words and fails the base rules; repeated rows are judged alike. Other
    columns of docs are not read. Without a reference for a row's language, or without a column of languages, only
    the base rules decide.
    """
    vocabulary, own = _vocabulary()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _verdicts(batch.column(1), _langs(batch.column(2)), references, limits, vocabulary, own)
            kinds = {"class_distance": pa.float64(), "word_distance": pa.float64(), "base_failed": pa.bool_(), "kept": pa.bool_()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in x.items())], ["doc_id", *x])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), _lang(docs, lang)).mapInArrow(judge, f"doc_id {kind}, {VERDICT}")


def keep_quality(docs: DataFrame, references: dict[str, tuple[list, list]], limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep; a filter within the scan."""
    vocabulary, own = _vocabulary()
    position, spoken = docs.columns.index(text), docs.columns.index(lang) if lang in docs.columns else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.full(len(batch), None, object) if spoken is None else _langs(batch.column(spoken))
            yield batch.filter(pa.array(_verdicts(batch.column(position), langs, references, limits, vocabulary, own)["kept"], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


