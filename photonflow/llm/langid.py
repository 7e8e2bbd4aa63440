"""Language identification: nearest of several clustered TF-IDF n-gram centroids for each language, by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from photonflow.llm.common import byte_rows, cut

#: Hashed features; n-gram orders; centroids of a language.
FEATURES = 2048
ORDERS = (1, 2, 3)
CENTROIDS = 4
#: The classifier is fitted on about so many labelled texts of each language at most; IDF counts take all of them.
SAMPLE = 500
#: Below the cosine that this share of a centroid's own texts exceed, less a margin, a text is too far from it.
NEAR = 0.99
MARGIN = 0.15
CHUNK = 1 << 20
UNKNOWN = "und"


def remainder(id_col: Column, modulus: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def _folded() -> np.ndarray:
    """Each BMP code point's lower-case letter, or a space for what is no letter."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ord(ch.lower()[0])
    return out


LETTERS = _folded()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and feature of all n-grams of the texts, and which texts have a letter. N-grams of two spaces or more don't count."""
    decoded = [t.decode() for t in texts]
    points = np.frombuffer((" " + "  ".join(decoded) + " ").encode("utf-32-le"), np.uint32)
    letters = LETTERS[np.minimum(points, (1 << 16) - 1)]
    far = np.flatnonzero(points >= 1 << 16)
    if len(far):
        kinds, which = np.unique(points[far], return_inverse=True)
        letters[far] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in kinds], np.uint32)[which]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in decoded])
    keep = (letters != 32) | np.concatenate([[True], letters[:-1] != 32]) | np.concatenate([[True], owner[1:] != owner[:-1]])
    letters, owner = letters[keep], owner[keep]
    has = np.zeros(len(texts), bool)
    has[owner[letters != 32]] = True
    who, which = [], []
    with np.errstate(over="ignore"):
        code = np.zeros(len(letters), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            code = (code[: len(letters) - n + 1] + letters[n - 1 :]) * np.uint32(2654435761) if n == 1 else (code[: len(letters) - n + 1] ^ (letters[n - 1 :] + np.uint32(n))) * np.uint32(2246822519)
            if n in ORDERS:
                same = owner[: len(code)] == owner[n - 1 :]
                who.append(owner[: len(code)][same])
                which.append((code[same] >> np.uint32(32 - FEATURES.bit_length() + 1)).astype(np.int32))
    return np.concatenate(who), np.concatenate(which), has


def counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, features) counts, and which texts have a letter."""
    who, which, has = grams(texts)
    flat = np.bincount(who.astype(np.int64) * FEATURES + which, minlength=len(texts) * FEATURES)
    return flat.reshape(len(texts), FEATURES), has


def vectors(table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of log term frequency times IDF."""
    v = np.log1p(table).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        keys: list = []
        texts: list[bytes] = []
        size = 0
        for key, text in byte_rows(batch, "id", "text"):
            keys.append(key)
            texts.append(text or b"")
            size += len(texts[-1])
            if size > CHUNK or len(texts) >= 256:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    language: np.ndarray  # of each centroid
    least: np.ndarray  # the cosine below which a text is too far from a centroid

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, bool]]:
        table, has = counts(texts)
        if not len(self.centroids):
            return [(UNKNOWN, 0.0, True)] * len(texts)
        near = vectors(table, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        cosine = near[np.arange(len(texts)), best]
        return [(self.languages[self.language[b]], min(1.0, max(0.0, float(c))), bool(c < self.least[b])) if h else (UNKNOWN, 0.0, True) for b, c, h in zip(best, cosine, has, strict=True)]


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the farthest-first start. Clusters of under a fiftieth of the rows, or of one, vanish: strays."""
    centres = [v.mean(axis=0)]
    centres[0] /= max(float(np.linalg.norm(centres[0])), 1e-9)
    for _ in range(1, min(k, len(v))):
        centres.append(v[np.max(v @ np.array(centres).T, axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.array([v[own == i].sum(axis=0) for i in range(len(c)) if (own == i).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    sizes = np.bincount((v @ c.T).argmax(axis=1), minlength=len(c))
    return c[sizes >= min(sizes.max(), max(2, len(v) / 50))]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: id, text, lang without nulls. Document frequencies come from all of it, centroids from a bounded sample of each
    language, which is clustered by itself; a few centroids a language reach the driver.

    The sample takes the rows whose hash falls in the lowest share that gives about `sample` texts of a language, so it
    doesn't depend on how rows are laid out.
    """

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for _, texts in chunks(batches):
            total[:FEATURES] += (counts(texts)[0] > 0).sum(axis=0)
            total[FEATURES] += len(texts)
        yield pa.record_batch([pa.array(np.arange(FEATURES + 1)), pa.array(total)], names=["feature", "n"])

    df = np.zeros(FEATURES + 1)
    for r in labelled.select("id", "text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] = r["n"]
    idf = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 1).astype(np.float32)
    # written, so that Spark knows the size of what has a row a language: texts stay where they are while it is small
    shares = cut(labelled.groupBy(F.col("lang").alias("known")).agg((sample / F.count("*")).alias("share")), "shares")
    place = F.xxhash64("id", "lang", "text")
    drawn = labelled.withColumn("place", place).join(shares, F.col("lang") == F.col("known"))
    drawn = drawn.where(F.shiftrightunsigned("place", 11) / float(1 << 53) < F.col("share"))

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                table, has = counts([t or b"" for _, t in byte_rows(part, "id", "text")])
                v = vectors(table, idf).astype(np.float16)
                yield pa.record_batch([part.column("lang"), part.column("place"), pa.array(has), pa.array([x.tobytes() for x in v], pa.binary())], names=["lang", "place", "has", "v"])

    def centre(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        v = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float16).astype(np.float32).reshape(-1, FEATURES)
        c = cluster(v, CENTROIDS)
        near = v @ c.T
        own = near.argmax(axis=1)
        least = [float(np.quantile(near[own == i].max(axis=1), 1 - NEAR)) - MARGIN if (own == i).any() else 0.0 for i in range(len(c))]
        return pa.table({"lang": [rows.column("lang")[0].as_py()] * len(c), "c": pa.array([x.tobytes() for x in c], pa.binary()), "least": least})

    found = drawn.select("id", "lang", "text", "place").mapInArrow(vectorise, "lang string, place long, has boolean, v binary").where("has")
    found = sorted(found.groupBy("lang").applyInArrow(centre, "lang string, c binary, least double").collect())
    names = sorted({r["lang"] for r in found})
    c = np.frombuffer(b"".join(bytes(r["c"]) for r in found), np.float32).reshape(-1, FEATURES)
    number = {n: i for i, n in enumerate(names)}
    return Model(names, idf, c, np.array([number[r["lang"]] for r in found], int), np.array([r["least"] for r in found]))


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: id, lang_pred, score, rejected.

    training: which rows may be learned from; of these, only text and non-null languages are. lang_pred is the language
    of the nearest centroid (of equally near ones, the first by language), or `und` where the text is null or has no letter
    (or nothing was learned); score is the cosine, rejected tells that the text is farther than the centroid's own texts are.
    Equal texts get equal results; an empty table gives no rows; no other column is read. A text is read whole, however
    long, and takes some 30 bytes a character while it is.
    """
    text = F.col(f"`{text_col}`").cast("string")
    labelled = docs.where(training & F.col(f"`{lang_col}`").isNotNull() & text.isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")), sample))
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches):
            found = model.value.predict(texts)
            yield pa.record_batch([pa.array(keys, kind), *(pa.array([r[i] for r in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=["id", "lang_pred", "score", "rejected"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["id"].dataType)
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
