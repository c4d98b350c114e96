"""Embedding and exact vector search; the query vector is one row, so only it is broadcast."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.functions.columns import dot

EMBEDDERS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {}


class NotInstalled(RuntimeError):
    """An optional adapter's library is missing."""


def register_embedder(name: str):
    def add(factory):
        EMBEDDERS[name] = factory
        return factory

    return add


#: Words whose hashes a worker remembers.
MOST_WORDS = 200_000


@register_embedder("hashing")
def _hashing(dim: int = 256):
    """Signed hashes of words and character trigrams, of length 1. Lexical: it claims no meaning.

    A word is hashed once; texts add up the hashes of their different words by how often they have them."""
    import zlib

    number: dict[str, int] = {}
    places: list[np.ndarray] = []
    signs: list[np.ndarray] = []

    def learn(word: str) -> int:
        h = np.array([zlib.crc32(p.encode("utf-8", "replace")) for p in (word, *(f"#{word}#"[j : j + 3] for j in range(len(word))))], np.int64)
        places.append(h % dim)
        signs.append(np.where(h >> 16 & 1, 1.0, -1.0))
        number[word] = len(number)
        return number[word]

    def embed(texts: list[str]) -> np.ndarray:
        if len(number) > MOST_WORDS:
            number.clear()
            places.clear()
            signs.clear()
        words = [(t or "").lower().split() for t in texts]
        known = number.get
        flat = np.fromiter((i if (i := known(w)) is not None else learn(w) for ws in words for w in ws), np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        pairs, counts = np.unique(owner * (len(number) + 1) + flat, return_counts=True)
        owner, which = np.divmod(pairs, len(number) + 1)
        used, which = np.unique(which, return_inverse=True)
        sizes = np.array([len(places[i]) for i in used.tolist()], np.int64)
        starts = np.cumsum(sizes) - sizes
        own = np.repeat(starts[which] - (np.cumsum(sizes[which]) - sizes[which]), sizes[which]) + np.arange(int(sizes[which].sum()))
        at = np.concatenate([np.zeros(0, np.int64), *(places[i] for i in used.tolist())])[own]
        sign = np.concatenate([np.zeros(0), *(signs[i] for i in used.tolist())])[own]
        out = np.bincount(np.repeat(owner, sizes[which]) * dim + at, sign * np.repeat(counts, sizes[which]), len(texts) * dim)
        out = out[: len(texts) * dim].reshape(len(texts), dim).astype(np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return embed


def _library(name: str, module: str):
    """A module that an adapter needs; NotInstalled says which is missing."""
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise NotInstalled(f"the {name} adapter needs {module}") from e


def unit_length(vectors) -> np.ndarray:
    out = np.asarray(vectors, np.float32)
    norms = np.linalg.norm(out, axis=1, keepdims=True) if len(out) else 1
    return out / np.where(norms == 0, 1, norms)


@register_embedder("static")
def _static(model: str = "minishlab/potion-base-8M"):
    held = _library("static", "model2vec").StaticModel.from_pretrained(model)
    return lambda texts: unit_length(held.encode([t or "" for t in texts]))


@register_embedder("sbert")
def _sbert(model: str = "all-MiniLM-L6-v2"):
    held = _library("sbert", "sentence_transformers").SentenceTransformer(model)
    return lambda texts: unit_length(held.encode([t or "" for t in texts], show_progress_bar=False))


#: Services that speak one protocol: model, base URL (None: the library's own), variable that holds the key.
SERVICES = {
    "openai": ("text-embedding-3-small", None, "OPENAI_API_KEY"),
    "deepinfra": ("BAAI/bge-base-en-v1.5", "https://api.deepinfra.com/v1/openai", "DEEPINFRA_API_KEY"),
    "gemini": ("text-embedding-004", "https://generativelanguage.googleapis.com/v1beta/openai/", "GEMINI_API_KEY"),
    "api": (None, None, "EMBEDDING_API_KEY"),
}
#: Texts a request carries.
REQUEST = 96


def _service(name: str):
    @register_embedder(name)
    def factory(model: str | None = None, base_url: str | None = None):
        usual, url, key = SERVICES[name]
        client = _library(name, "openai").OpenAI(api_key=os.environ.get(key), base_url=base_url or os.environ.get("EMBEDDING_BASE_URL" if name == "api" else "") or url)
        wanted = model or usual or os.environ.get("EMBEDDING_MODEL", "")

        def embed(texts: list[str]) -> np.ndarray:
            rows = []
            for s in range(0, len(texts), REQUEST):
                answer = client.embeddings.create(model=wanted, input=[t or " " for t in texts[s : s + REQUEST]])
                rows += [d.embedding for d in sorted(answer.data, key=lambda d: d.index)]
            return unit_length(rows)

        return embed


for _name in SERVICES:
    _service(_name)


@register_embedder("voyage")
def _voyage(model: str = "voyage-3"):
    client = _library("voyage", "voyageai").Client()

    def embed(texts: list[str]) -> np.ndarray:
        return unit_length([v for s in range(0, len(texts), REQUEST) for v in client.embed([t or " " for t in texts[s : s + REQUEST]], model=model).embeddings])

    return embed


def embedder(name: str = "hashing"):
    if name not in EMBEDDERS:
        raise KeyError(f"no embedder {name!r}; there are {sorted(EMBEDDERS)}")
    return EMBEDDERS[name]()


def embed_chunks(chunks: DataFrame, name: str = "hashing", contextual: bool = False) -> DataFrame:
    """chunk_id, embedding. contextual puts the title before the text that is embedded, and only there."""
    embedder(name)  # an adapter that is missing shows here, not on the executors
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.col("text")) if contextual else F.col("text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = embedder(name)
        for f in frames:
            yield pd.DataFrame({"chunk_id": f["chunk_id"], "embedding": list(embed(f["t"].tolist()))})

    return chunks.select("chunk_id", text.alias("t")).mapInPandas(run, "chunk_id string, embedding array<float>")


def nearest(vectors: DataFrame, query: DataFrame, k: int | None = 10, min_score: float | None = None, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """id, score (dot product in double, cosine for unit vectors), best first. query: one row, column q.

    Filters on vectors come before the search, so k rows come back whenever there are as many."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).join(F.broadcast(query.select("q").limit(1)))
    rows = rows.select("id", dot("v", "q").alias("score"))
    if min_score is not None:
        rows = rows.filter(F.col("score") >= min_score)
    return rows if k is None else rows.orderBy(F.desc("score"), "id").limit(k)


def vectors_of(vectors: DataFrame, ids: list, id_col: str = "chunk_id") -> DataFrame:
    """The rows of vectors with the ids asked for, which are broadcast: as many as were asked for."""
    wanted = vectors.sparkSession.createDataFrame([(i,) for i in ids], vectors.select(id_col).schema)
    return vectors.join(F.broadcast(wanted.distinct()), id_col, "left_semi")


#: Centroids that are compared at a time; a block of them is broadcast.
CENTROIDS = 4096


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, score: the centroid (cluster, c) with the largest dot product; ties go to the smallest cluster.

    Centroids are a stated set of queries, compared with all rows in blocks of about CENTROIDS."""
    blocks, parts = max(1, -(-centroids.count() // CENTROIDS)), []
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    for i in range(blocks):
        own = centroids.filter(F.pmod(F.xxhash64("cluster"), F.lit(blocks)) == i)
        parts.append(rows.join(F.broadcast(own)).select("id", F.struct(dot("v", "c").alias("score"), (-F.col("cluster")).alias("minus")).alias("b")))  # a block
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.groupBy("id").agg(F.max("b").alias("b"))
    return best.select("id", (-F.col("b.minus")).alias("cluster"), F.col("b.score").alias("score"))


def quantised(vectors: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """id, codes, scale, lost: an index of every row with 4 bits a dimension, two of them in a byte; lost is
    the length of what the codes leave out of the vector."""

    @F.pandas_udf("codes binary, scale double, lost double")
    def pack(batch: pd.Series) -> pd.DataFrame:
        codes, scales, lost = [], [], []
        for v in batch:
            v = np.asarray(v, np.float64)
            peak = float(np.abs(v).max(initial=0.0))
            code = (np.rint(v / (peak or 1.0) * 7) + 8).astype(np.uint8)  # 1 to 15, 8 for 0
            lost.append(float(np.linalg.norm(v - (code.astype(np.float64) - 8) * (peak / 7))))
            code = np.append(code, np.uint8(8)) if len(code) % 2 else code
            codes.append((code[::2] << 4 | code[1::2]).tobytes())
            scales.append(peak / 7)
        return pd.DataFrame({"codes": codes, "scale": scales, "lost": lost})

    return vectors.select(F.col(id_col).alias("id"), pack(vector_col).alias("p")).select("id", "p.codes", "p.scale", "p.lost")


#: Share of the lengths of two vectors by which sums in another order may differ (far more than they do).
ROUNDING = 1e-9


def quantised_nearest(index: DataFrame, vectors: DataFrame, query: DataFrame, k: int = 10, more: int = 10, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """id, score like nearest(), exactly: the k * more best by codes are scored by their vectors, and so is
    every row that could be as good as the k-th of them: a score differs from that by codes by at most the
    length that was lost, times the query's."""
    q = np.asarray(query.select("q").first()[0], np.float64)  # one row
    length = float(np.linalg.norm(q))

    @F.pandas_udf("rough double, most double")
    def rough(codes: pd.Series, scale: pd.Series, lost: pd.Series) -> pd.DataFrame:
        both = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        code = np.stack([both >> 4, both & 15], axis=2).reshape(len(codes), -1)[:, : len(q)].astype(np.float64) - 8
        by_codes = code @ q * scale.to_numpy()
        own = np.linalg.norm(code, axis=1) * scale.to_numpy() + lost.to_numpy()
        return pd.DataFrame({"rough": by_codes, "most": by_codes + (lost.to_numpy() + ROUNDING * own) * length})

    rows = index.select("id", rough("codes", "scale", "lost").alias("r")).select("id", "r.rough", "r.most")
    best = rows.orderBy(F.desc("rough"), "id").limit(k * more)
    own = vectors.join(F.broadcast(best.select(F.col("id").alias(id_col))), id_col, "left_semi")  # k * more rows
    first = nearest(own, query, k, id_col=id_col, vector_col=vector_col).agg(F.count("score").alias("n"), F.min("score").alias("least")).first()
    able = rows.filter(F.col("most") >= first["least"]) if first["n"] >= k > 0 else rows
    own = vectors.join(able.select(F.col("id").alias(id_col)), id_col, "left_semi")
    return nearest(own, query, k, id_col=id_col, vector_col=vector_col)


RERANKERS: dict[str, Callable] = {}


def _cross_encoder(model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"):
    held = _library("cross-encoder", "sentence_transformers").CrossEncoder(model)
    return lambda query, passages: [float(x) for x in held.predict([(query, p) for p in passages])]


def _overlap():
    """Scores by the share of the query's words that a passage has."""

    def score(query: str, passages: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(p.lower().split())) / max(1, len(words)) for p in passages]

    return score


RERANKERS["cross-encoder"], RERANKERS["overlap"] = _cross_encoder, _overlap


def rerank(hits: DataFrame, query: str, name: str, k: int, text_col: str = "text") -> DataFrame:
    """hits (a pool of a few dozen rows) by a reranker's scores, the best k."""
    if name not in RERANKERS:
        raise KeyError(f"no reranker {name!r}; there are {sorted(RERANKERS)}")
    RERANKERS[name]()  # an adapter that is missing shows here, not on the executors
    factory = RERANKERS[name]

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = factory()
        for texts in batches:
            yield pd.Series(score(query, texts.fillna("").tolist()), dtype="float64")

    return hits.withColumn("score", scored(text_col)).orderBy(F.desc("score"), "chunk_id").limit(k)
