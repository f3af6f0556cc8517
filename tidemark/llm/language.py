"""Language identification with presence string kernels, Nyström landmarks and kernel ridge regression.

The kernel of two texts is the number of distinct byte n-grams (orders 1 to 3, blended) that both hold, over the square
root of the product of how many each holds. N-grams that no landmark holds cannot change a kernel value with a landmark,
so the profile of a text is its presence row over the landmarks' n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ORDERS = 3
#: Labelled rows of a language that the driver may read, and how many of them become landmarks.
TRAIN_PER_LANG = 192
LANDMARKS_PER_LANG = 48
RIDGE = 1e-3
#: Texts scored by one matrix product.
BATCH = 64
#: Bytes of text whose n-grams are looked up at a time.
CHUNK = 1 << 20
UNKNOWN = "und"

# A-Z to a-z; ASCII that is no letter to one space; bytes of other characters stay.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_OFFSET = np.cumsum([0, 1 << 8, 1 << 16])


def _codes(data: np.ndarray) -> list[np.ndarray]:
    """Codes of the n-grams of each order that start at each byte."""
    b = _FOLD[data]
    codes = [b]
    for _ in range(1, ORDERS):
        codes.append((codes[-1][:-1] << 8) | b[len(codes) :])
    return [c + np.uint32(o) for c, o in zip(codes, _OFFSET, strict=True)]


def _chunks(data: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(data), CHUNK):
        yield data[at : at + CHUNK + ORDERS - 1]


def profile(text: str) -> np.ndarray:
    """The distinct n-gram codes of a whole text."""
    data = np.frombuffer(text.encode(), np.uint8)
    found = [np.unique(np.concatenate(_codes(x))) for x in _chunks(data)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # sorted n-gram codes of the landmarks
    weights: np.ndarray  # a row for each code, a column for each language


def fit(rows: list[tuple[str, np.ndarray]], ridge: float = RIDGE, per_lang: int = LANDMARKS_PER_LANG) -> Model:
    """One-versus-rest kernel ridge regression on Nyström features of (language, profile) rows."""
    langs = sorted({lang for lang, _ in rows})
    rows = [(lang, p) for lang, p in rows if len(p)]
    landmarks = [p for lang in langs for p in [p for x, p in rows if x == lang][:per_lang]]
    if not landmarks:
        return Model(langs, np.zeros(0, np.uint32), np.zeros((0, len(langs))))
    codes = np.unique(np.concatenate(landmarks))

    def presence(profiles: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(profiles), len(codes)), np.float32)
        for i, p in enumerate(profiles):
            out[i, np.searchsorted(codes, p[np.isin(p, codes)])] = 1
        return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))

    z, profiles = presence(landmarks), [p for _, p in rows]
    y = np.array([[1.0 if lang == c else -1.0 for c in langs] for lang, _ in rows])
    # Languages weigh the same, however many rows each gives.
    share = np.array([1.0 / sum(a == lang for a, _ in rows) for lang, _ in rows])
    share *= len(rows) / share.sum()
    k_zz = (z @ z.T).astype(np.float64)
    k_xz = np.concatenate([presence(profiles[i : i + BATCH]) @ z.T for i in range(0, len(rows), BATCH)]).astype(np.float64)
    values, vectors = np.linalg.eigh(k_zz)
    good = values > 1e-8 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = k_xz @ whiten
    gram = phi.T @ (phi * share[:, None]) + ridge * len(rows) * np.eye(phi.shape[1])
    alpha = whiten @ np.linalg.solve(gram, phi.T @ (y * share[:, None]))
    # (presence @ z.T) @ alpha, with the two factors that no text changes multiplied once.
    return Model(langs, codes, z.T @ alpha.astype(np.float32))


def training_rows(docs: DataFrame, allowed: Column, per_lang: int = TRAIN_PER_LANG) -> list[tuple[str, np.ndarray]]:
    """(lang, profile) of about ``per_lang`` labelled rows of each language, chosen by a hash of the id.

    The profiles are made by the executors; the driver reads distinct n-grams of a bounded number of texts.
    """
    labelled = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    spot = F.xxhash64(F.lit("train"), "doc_id").bitwiseAND((1 << 40) - 1)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, int(min(1.0, per_lang / n) * (1 << 40))).otherwise(limit)

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [profile(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("spot"), pa.array(made, pa.binary())], ["lang", "spot", "p"])

    chosen = labelled.where(spot < limit).select("lang", "text", spot.alias("spot"))
    rows = chosen.limit(2 * per_lang * len(counts)).mapInArrow(profiles, "lang string, spot long, p binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["spot"], bytes(r["p"])))
    return [(r["lang"], np.frombuffer(r["p"], np.uint32)) for r in rows]


class _Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.where = np.full(int(_OFFSET[-1]) + (1 << 24), -1, np.int32)
        self.where[model.codes] = np.arange(len(model.codes), dtype=np.int32)
        self.weights = model.weights.astype(np.float32)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Scores of a few texts for every language: presence rows times weights."""
        rows = np.zeros((len(texts), len(self.model.codes)), np.float32)
        for row, text in zip(rows, texts, strict=True):
            for part in _chunks(np.frombuffer(text, np.uint8)):
                for codes in _codes(part):
                    at = self.where[codes]
                    row[at[at >= 0]] = 1
        size = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        return (rows @ self.weights) / size


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``score`` (in place of any of that name); see `identify`."""
    docs = docs.drop("lang_pred", "score")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows, names = docs.select("*", letter.alias("has_letter")), [*docs.columns, "lang_pred", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model) if len(model.codes) else None
        for b in batches:
            pred, sure = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            at = [i for i, x in enumerate(b.column("has_letter").to_pylist()) if x and scorer]
            texts = b.column("text")
            for i in range(0, len(at), BATCH):
                part = at[i : i + BATCH]
                values = scorer([texts[j].as_buffer() for j in part])
                for j, v in zip(part, values, strict=True):
                    best = int(np.argmax(v))
                    pred[j], sure[j] = model.langs[best], min(1.0, max(0.0, (float(v[best]) + 1) / 2))
            made = [*b.columns[:-1], pa.array(pred), pa.array(sure)]
            yield pa.RecordBatch.from_arrays(made, names)

    return rows.mapInArrow(score, StructType([*docs.schema]).add("lang_pred", "string").add("score", "double"))


def held_out(key: Column | str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3 (null id: false)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text, lang, ...)``.

    The model learns from ``text`` and ``lang`` of rows that are not held out, from about ``per_lang`` rows of each
    language. A prediction sees the whole text and nothing else. Null text, and text without a letter, is ``und`` with
    score 0; so is every row if no row is labelled. Ties go to the first language by code point. Repeated rows each
    give a row; other columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    model = fit(training_rows(docs, ~held_out(), per_lang))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def identified(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """The rows of ``docs`` that get a language: rows that `identify` calls ``und`` go, all columns stay.

    Without a labelled row nothing is learned; then only texts without a letter go.
    """
    model = fit(training_rows(docs.select(F.col("doc_id").cast("long"), "text", "lang"), ~held_out(), per_lang))
    rest = [c for c in docs.columns if c != "text"]
    made = predict(docs.select(F.struct(*rest).alias("kept_row"), "text"), model)
    if not model.langs:
        made = made.withColumn("lang_pred", F.when(F.col("text").rlike(r"\p{L}"), "unlabelled").otherwise(UNKNOWN))
    made = made.where(F.col("lang_pred") != UNKNOWN)
    return made.select(*("text" if c == "text" else F.col(f"kept_row.`{c}`") for c in docs.columns))
