"""Language identification by blended-spectrum string kernels, Nystroem landmarks and kernel ridge.

A text's features are the presence of its letter n-grams of two to four bytes, hashed into DIM
places; the kernel of two texts is the number of shared places over the root of both counts. A
bounded sample of labelled texts is mapped through LANDMARKS texts of it (Nystroem), and one
ridge regression per language against the rest is fitted. Scoring is two products of whole
batches: presence x landmarks, then kernel rows x weights.

Only text and label are learned from. Letters are lower-cased; all that is no letter is one blank.
A null text or one without a letter is `und` with score 0. Equal texts have equal results; the
languages' order settles ties. Long texts are read whole: presence of all their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.textbatch import kept, steps

#: Places of the hashed n-gram space, lengths of n-grams, landmarks, ridge.
DIM, GRAMS, LANDMARKS, RIDGE = 1 << 13, (2, 3, 4), 96, 1e-3
#: Labelled texts of one language that training may draw, and texts per batch product.
PER_LANGUAGE, BATCH = 400, 64
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: The same for Java, whose tables may not know the newest letters yet.
_MAYBE_LETTER = r"[\p{L}\p{Cn}]"
#: Bytes of texts after lower-casing: a-z and all beyond ASCII are letters or parts of letters.
_FOLD = np.zeros(256, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[_FOLD == 0] = 32


def presence(texts: list[str]) -> np.ndarray:
    """0/1 rows: which hashed n-grams each text holds."""
    out = np.zeros((len(texts), DIM), np.float32)
    for row, text in enumerate(texts):
        x = _FOLD[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
        x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))].astype(np.uint32)
        code = x
        for n in range(2, max(GRAMS) + 1):
            if len(code) < 2:
                break
            code = code[:-1] * np.uint32(257) + x[n - 1 :]
            if n in GRAMS:
                out[row, ((code * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 13)] = 1
    return out


def has_letter(text: str | None) -> bool:
    """Whether there is a letter of any script."""
    return bool(text) and _LETTER.search(text) is not None


class Model:
    """Landmark matrix, whitening and one weight vector per language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        """Normalised kernel of presence rows with the landmarks, and a constant."""
        norm = np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None]
        both = (rows @ self.landmarks.T) / norm / np.sqrt(np.maximum(self.landmarks.sum(axis=1), 1))[None, :]
        return np.concatenate([both, np.ones((len(rows), 1), both.dtype)], axis=1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score in 0..1) of texts with letters."""
        margins = self.kernel(presence(texts)).astype(np.float64) @ self.weights
        best = margins.argmax(axis=1)
        power = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
        return [self.languages[i] for i in best], power[np.arange(len(texts)), best] / power.sum(axis=1)


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from (text, language) pairs in a fixed order; none gives a model of no language."""
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return Model([], np.zeros((0, DIM), np.float32), np.zeros((1, 0)))
    rows = np.concatenate([presence([t for t, _ in sample[at : at + BATCH]]) for at in range(0, len(sample), BATCH)])
    groups = [[i for i, (_, lang) in enumerate(sample) if lang == want] for want in languages]
    share = max(1, landmarks // len(languages))
    chosen = [i for g in groups for i in g[:share]]
    model = Model(languages, rows[chosen], np.zeros((len(chosen) + 1, len(languages))))
    k = model.kernel(rows).astype(np.float64)
    core = np.pad(k[chosen][:, :-1], ((0, 1), (0, 1)))
    core[-1, -1] = 1e-3
    # every language weighs the same, however many texts it has
    weight = np.zeros(len(sample))
    for g in groups:
        weight[g] = 1 / len(g)
    target = np.array([[1.0 if lang == want else -1.0 for want in languages] for _, lang in sample])
    left = (k * weight[:, None]).T @ k + ridge * (core + 1e-6 * np.eye(len(core)))
    model.weights = np.linalg.solve(left, (k * weight[:, None]).T @ target)
    return model


def labelled_sample(docs: DataFrame, text: str = "text", label: str = "lang", per_label: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most `per_label` distinct texts of each label, those with the smallest hashes of the text.

    A first pass counts each label's distinct lettered texts (within some percent; few ones exactly
    enough to take them all); the second lets through the share of the hash range that holds about
    four times `per_label` of them, whatever the table's size and its copies, and merges copies
    before the shuffle. So every label with a lettered text is learned.
    """
    lettered = F.col(text).rlike(_MAYBE_LETTER)
    rows = docs.where(F.col(label).isNotNull() & lettered).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    counts = {r["label"]: max(1, r["n"]) for r in rows.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * per_label / n))))
    drawn = rows.withColumn("h", F.xxhash64("text")).where(F.col("h") / float(1 << 64) + 0.5 < F.element_at(share, F.col("label")))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in drawn.groupBy("label", "h").agg(F.first("text").alias("text")).toLocalIterator():
        if has_letter(r["text"]):
            found.setdefault(r["label"], []).append((r["h"], r["text"]))
    return [(t, lang) for lang, mine in sorted(found.items()) for _, t in sorted(mine)[:per_label]]


def predictions(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs` with lang_pred and score; columns of these names are replaced. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.landmarks, model.weights))
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(*own)
    place = own.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language")  # nothing: what another operator kept in this worker goes
        ready = Model(*shared.value)
        for batch in batches:
            for part in steps(batch, text):
                texts = part.column(place).to_pylist()
                known = [i for i, t in enumerate(texts) if ready.languages and has_letter(t)]
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                for at in range(0, len(known), BATCH):
                    some = known[at : at + BATCH]
                    got, score = ready.predict([texts[i] for i in some])
                    for i, lang in zip(some, got):
                        langs[i] = lang
                    scores[some] = score
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*part.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2):
    """Column: whether a document is kept from training, by the CRC-32 of its id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def op5_language(spark, sf_dir: str) -> DataFrame:
    """Predicted languages of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(labelled_sample(docs.where(~held_out())))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predictions(rows, model).select("doc_id", "held_out", "lang_pred", "score")
