"""Language identification in two steps: the family, then one-versus-one linear SVMs inside the family.

Features are hashed character trigrams of the lower-cased letters, counted over the whole text and scaled to unit
length. The machines are trained here from a bounded sample of labelled rows; a prediction reads the text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Families of ISO 639-1 codes (fixed values). A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: Width of the hashed features.
WIDTH = 1 << 12
#: Rows of each language that train the machines, at most; they are the ones with the least hash of doc_id.
SAMPLE = 250
#: A text whose best score is lower is rejected by the pipeline.
LEAST_SCORE = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: str) -> np.ndarray | None:
    """Unit vector of hashed trigrams of the letters, words set apart; None if the text has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters(code)
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint32(32))
    code = code[np.r_[True, (code[1:] != 32) | (code[:-1] != 32)]]  # one space between words
    code = np.concatenate([np.array([32], np.uint32), code, np.array([32], np.uint32)])
    counts = np.zeros(WIDTH)
    for at in range(0, len(code) - 2, 1 << 20):
        c = code[at : at + (1 << 20) + 2]
        h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
        counts += np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=WIDTH)
    counts = np.sqrt(counts)
    return counts / np.sqrt(counts @ counts)


_LETTER = np.zeros(0x110000, bool)


def _letters(code: np.ndarray) -> np.ndarray:
    if not _LETTER.any():
        _LETTER[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return _LETTER[code]


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 40, c: float = 10.0) -> np.ndarray:
    """A linear SVM with bias (last weight) by dual coordinate descent; y is +1 or -1, classes weigh alike."""
    n = len(x)
    box = np.where(y > 0, c * n / (2 * max(1, (y > 0).sum())), c * n / (2 * max(1, (y < 0).sum())))
    alpha, w, bias, norm = np.zeros(n), np.zeros(x.shape[1]), 0.0, np.einsum("ij,ij->i", x, x) + 1
    rng = np.random.default_rng(1)
    for _ in range(rounds):
        for i in rng.permutation(n):
            new = min(max(alpha[i] - (y[i] * (w @ x[i] + bias) - 1) / norm[i], 0), box[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * x[i]
                bias += step
                alpha[i] = new
    return np.append(w, bias)


class Model:
    """Weights of the family machines (one for each pair of families) and of the pairs inside each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.family = {lang: FAMILY.get(lang, lang) for lang in self.langs}
        self.families = sorted(set(self.family.values()))
        named = np.array(langs)
        of = np.array([self.family[lang] for lang in langs])
        self.pairs, weights = [], []
        for labels, among in [(of, self.families), *((named, [l for l in self.langs if self.family[l] == f]) for f in self.families)]:
            for a, b in combinations(among, 2):
                at = (labels == a) | (labels == b)
                self.pairs.append((a, b))
                weights.append(_train(x[at], np.where(labels[at] == a, 1.0, -1.0)))
        self.index = {p: i for i, p in enumerate(self.pairs)}
        self.weights = np.array(weights).reshape(len(weights), WIDTH + 1).astype(np.float32)

    def _vote(self, among: list[str], margin: np.ndarray) -> tuple[str, float]:
        """The label with most won pairs (then the larger sum of margins), and how sure its closest pair is."""
        if len(among) == 1:
            return among[0], 1.0
        won = {a: [0, 0.0, 9.0] for a in among}
        for a, b in combinations(among, 2):
            m = float(margin[self.index[a, b]])
            for label, sign in ((a, m), (b, -m)):
                won[label][0] += sign > 0
                won[label][1] += sign
                won[label][2] = min(won[label][2], sign)
        best = max(among, key=lambda a: (won[a][0], won[a][1]))
        return best, float(1 / (1 + np.exp(-4 * won[best][2])))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if text else None
        if x is None or not self.langs:
            return "und", 0.0
        margin = self.weights[:, :-1] @ x + self.weights[:, -1] if len(self.pairs) else np.empty(0)
        family, sure = self._vote(self.families, margin)
        lang, sure_too = self._vote([l for l in self.langs if self.family[l] == family], margin)
        return lang, sure * sure_too


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on at most sample rows of each language that are not held out.

    The sample is the rows with the least hash of doc_id and text, so it doesn't depend on how the table is partitioned. Every task
    passes on at most sample rows of a language (the window's limit works before the shuffle), and the driver gets the features of
    the sample only, whatever the corpus. The number of languages is bounded by the label set. Rows whose lang or text is
    null, or without letters, don't train; an empty table gives a model that names no language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("at"), F.col(text_col).alias("body"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    ends = rows.select("lang", "at").withColumn("n", first).where(F.col("n") <= sample).groupBy("lang").agg(F.max("at").alias("last")).collect()
    texts = []
    if ends:
        last = F.create_map(*[F.lit(x) for r in ends for x in (r["lang"], r["last"])])
        few = rows.where(F.col("at") <= F.element_at(last, F.col("lang"))).select("lang", "body", "at").mapInArrow(_sample_features, "lang string, at long, x binary")
        kept = few.withColumn("n", first).where(F.col("n") <= sample).select("lang", "at", "x").collect()  # equal rows may be more than the sample
        texts = [(r["lang"], r["x"]) for r in sorted(kept, key=lambda r: (r["lang"], r["at"]))]
    x = np.array([np.frombuffer(b, np.float32) for _, b in texts]).reshape(len(texts), WIDTH)
    return Model(x, [lang for lang, _ in texts])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "body"):
        got = [(lang, at, x.astype(np.float32).tobytes()) for lang, at, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), map(features, b.column(1).to_pylist())) if x is not None]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], names=["lang", "at", "x"])


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score added: a trained language, or 'und' and 0 where the text is null or has no letter.

    Every row stays, repeated ones too. names are the new columns; columns of docs with these names are replaced. The model's size depends
    on the number of languages only; it travels to the tasks with the function.
    """
    rest = [c for c in docs.columns if c not in names]
    slim = docs.select(*rest)
    schema = T.StructType([*slim.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            got = [model.predict(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*rest, *names])

    return slim.mapInArrow(run, schema)


def op10_langid(docs: DataFrame) -> DataFrame:
    """The rows of query op10."""
    model = fit(docs)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
