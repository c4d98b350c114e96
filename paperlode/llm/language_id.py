"""Language identification with error-correcting output codes.

Every language has a codeword; a binary classifier over hashed character 1- to 3-grams predicts each
bit. Decoding weighs a bit's loss by how well its classifier did on that language and takes the
nearest codeword; a text whose two nearest codewords are about as near is flagged as ambiguous.

Codewords are exhaustive for up to 7 languages (2^(k-1) - 1 bits) and random dense ones of
ceil(10 log2 k) bits beyond, the best separated of 64 seeded draws.

Defined cases: null text, and text without a letter, is ``und`` with score 0 and not ambiguous; with no
labelled text at all every text is ``und``; with one language every text with a letter is it, with
score 1; rows that repeat an id are predicted each; labels with null text or null language teach
nothing; an empty table gives no rows; other columns are ignored, or carried where carry is set (one
named lang_pred, lang_score or lang_ambiguous is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm.common import held_out_column, slices, table
from paperlode.llm.ngrams import grams

#: Hash buckets for all orders together; orders of n-grams.
BUCKETS, ORDERS = 1 << 12, (1, 2, 3)
#: Labelled texts a language is learned from at most; those with the smallest md5 of their id. Texts of all
#: languages together (16 KB each on the driver), and languages, the commonest ones.
MOST_PER_LANGUAGE, MOST_TEXTS, MOST_LANGUAGES = 500, 10_000, 1000
#: Ambiguous: the second codeword has at least this share of the likelihood of the two nearest.
AMBIGUOUS_SHARE = 0.4
#: Numbers that an array of features or losses has at most, if for one text it has fewer.
FLOATS = 1 << 21
_LETTER = regex.compile(r"\p{L}")


def features(texts: list[str]) -> np.ndarray:
    """Square roots of bucket counts, of length 1."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for owners, begins, hashes in grams(texts, ORDERS):
        for at, h in zip(begins, hashes, strict=True):
            buckets = (h >> np.uint32(20)).astype(np.int64)
            for j, i in enumerate(owners.tolist()):
                out[i] += np.bincount(buckets[at[j] : at[j + 1]], minlength=BUCKETS)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each language, one column a bit."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        columns = np.arange(1, 1 << (k - 1))
        bits = (columns[None, :] >> np.arange(k - 1)[:, None]) & 1
        return np.vstack([np.zeros((1, len(columns)), np.int64), bits]).astype(np.int8) * 2 - 1
    rng, width, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (k, width))
        if (np.abs(code.sum(axis=0)) == k).any():
            continue
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + np.eye(k, dtype=np.int64) * width
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def _loss(self, texts: list[str]) -> np.ndarray:
        """Trust-weighted loss of every text against every codeword."""
        margins = features(texts) @ self.weights + self.bias
        loss = np.log1p(np.exp(-np.clip(self.code[None] * margins[:, None, :], -30, 30)))
        return (loss * self.trust[None]).sum(axis=2)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        if not texts:
            return []
        if not self.languages:
            return [("und", 0.0, False)] * len(texts)
        step = max(1, FLOATS // max(BUCKETS, self.code.size))
        loss = np.concatenate([self._loss(texts[i : i + step]) for i in range(0, len(texts), step)])
        nearness = np.exp(loss.min(axis=1, keepdims=True) - loss)  # 1 for the nearest, so the sum is never 0
        share = nearness / nearness.sum(axis=1, keepdims=True)
        order = np.argsort(-share, axis=1, kind="stable")
        out = []
        for i, text in enumerate(texts):
            if not _LETTER.search(text):
                out.append(("und", 0.0, False))
                continue
            first = share[i, order[i, 0]]
            second = share[i, order[i, 1]] if len(self.languages) > 1 else 0.0
            out.append((self.languages[order[i, 0]], float(min(1.0, first)), bool(second >= AMBIGUOUS_SHARE * (first + second))))
        return out


def fit_codes(x: np.ndarray, labels: list[str], rounds: int = 150, rate: float = 8.0, decay: float = 1e-4) -> CodeModel:
    """Logistic regression for all bits at once by full-batch descent with momentum."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in labels]].astype(np.float32) if labels else np.zeros((0, 1), np.float32)
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    step_w, step_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds if len(languages) > 1 else 0):
        pull = y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(y)
        step_w = 0.9 * step_w + x.T @ pull - decay * w
        step_b = 0.9 * step_b + pull.sum(axis=0)
        w += rate * step_w
        b += rate * step_b
    trust = np.ones(code.shape, np.float32)
    if len(languages) > 1:
        right = ((x @ w + b) * y > 0).astype(np.float32)
        for c, name in enumerate(languages):
            trust[c] = right[[v == name for v in labels]].mean(axis=0)
        trust /= np.maximum(trust.sum(axis=1, keepdims=True), 1e-9)
        trust *= code.shape[1]
    return CodeModel(languages, code, w, b, trust)


def train_language_model(docs: DataFrame, most: int = MOST_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CodeModel:
    """Learns from at most ``most`` texts a language of the documents that aren't held out, and MOST_TEXTS of
    all, so what the driver fits is bounded however many languages there are.

    Those texts have the smallest hashes of their id; a threshold on the hash (from counts by language)
    leaves about twice as many rows to be ranked, however many a language has."""
    rows = docs.filter(~held_out_column(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in counts.collect()}  # MOST_LANGUAGES rows
    if not counts:
        return fit_codes(np.zeros((0, BUCKETS), np.float32), [])
    most = max(1, min(most, MOST_TEXTS // len(counts)))
    u = F.conv(F.substring("h", 1, 13), 16, 10).cast("double") / float(1 << 52)
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, (2 * most + 50) / n)) for k, n in counts.items()], "lang string, share double")
    some = rows.join(F.broadcast(shares), "lang").filter(u < F.col("share"))  # MOST_LANGUAGES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for i in range(0, part.num_rows, FLOATS // BUCKETS):
                    some = part.slice(i, FLOATS // BUCKETS)
                    x = features(some.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], ["lang", "h", "x"])

    from pyspark.sql import Window

    ranked = some.select("lang", "text", "h").mapInArrow(run, "lang string, h string, x binary")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "x"))).filter(F.col("r") <= most)
    found = sorted(((r["lang"], r["h"], bytes(r["x"])) for r in ranked.select("lang", "h", "x").collect()))  # most rows a language
    x = np.stack([np.frombuffer(v, np.float16) for _, _, v in found]).astype(np.float32)
    return fit_codes(x, [k for k, _, _ in found])


def identify(docs: DataFrame, model: CodeModel, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in carry, then lang_pred, lang_score and lang_ambiguous, for every row."""
    carry = [c for c in carry or [] if c not in ("lang_pred", "lang_score", "lang_ambiguous")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = carry.index(text_col) if text_col in carry and dict(docs.dtypes)[text_col] == "string" else -1  # where the text is
    docs = docs.select(*carry, *([F.col(text_col).cast("string").alias("langid_text")] if at < 0 else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col if at >= 0 else "langid_text"):
                texts = [t or "" for t in part.column(at if at >= 0 else part.num_columns - 1).to_pylist()]
                found = shared.value.predict(texts)
                extra = [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *extra], [*carry, "lang_pred", "lang_score", "lang_ambiguous"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields[: len(carry)], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_ambiguous", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train_language_model(docs), carry=["doc_id"])
    return found.select("doc_id", held_out_column().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
