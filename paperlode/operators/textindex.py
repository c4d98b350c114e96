"""Inverted index, BM25 and pattern search over chunks(chunk_id, doc_id, text)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlode.functions.columns import excerpt, flexible_blanks
from paperlode.functions.stemming import stem as stem_word
from paperlode.functions.stemming import stem_column

K1, B = 1.2, 0.75
QUERY_TERM = re.compile(r"[\w'-]+")


def _folded(text):
    """Lower case, without the diacritics of Latin letters."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    marked = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    return F.when(low.rlike(f"[{marked}]"), F.translate(low, marked, "aaaaaaceeeeiiiinooooouuuuyy")).otherwise(low)


def tokens(text):
    """Lower-cased words of letters and digits without diacritics, in order."""
    return F.filter(F.split(_folded(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_terms(query: str) -> list[list[str]]:
    """Terms of a query (all must match); one with a hyphen or apostrophe is a phrase of its parts."""
    fold = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    split = [[w for w in re.split(r"[\W_]+", t.lower().translate(fold)) if w] for t in QUERY_TERM.findall(query)]
    return [t for t in split if t]


#: Postings lie in a folder a CHUNKS_A_FOLDER chunks (MOST_FOLDERS at most) by a hash of the term; a query
#: reads those of its terms.
CHUNKS_A_FOLDER, MOST_FOLDERS = 200_000, 4096


def _folder(term, folders: int):
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def postings(chunks: DataFrame, stem: bool = False, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """term, chunk_id, tf, positions, dl (words of the chunk). Words are counted by chunk first, so a stem is
    made once a word of a chunk."""
    words = chunks.select(F.col(id_col).alias("chunk_id"), tokens(text_col).alias("words")).select("chunk_id", F.size("words").alias("dl"), F.posexplode("words").alias("pos", "term"))
    if not stem:
        return words.groupBy("term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")).select("term", "chunk_id", "tf", "positions", "dl")
    held = words.groupBy("term", "chunk_id", "dl").agg(F.collect_list("pos").alias("spots")).withColumn("term", stem_column("term"))
    held = held.groupBy("term", "chunk_id", "dl").agg(F.sort_array(F.flatten(F.collect_list("spots"))).alias("positions"))
    return held.select("term", "chunk_id", F.size("positions").cast("bigint").alias("tf"), "positions", "dl")


def write_index(chunks: DataFrame, path: str, stem: bool = True, id_col: str = "chunk_id", text_col: str = "text") -> None:
    """The keyword index of chunks below path: postings by folder and term, and one row of the corpus's
    numbers (n, avgdl, folders). Words and chunks are counted from the chunks, so empty ones count."""
    words = F.regexp_count(_folded(text_col), F.lit(r"[\p{L}\p{N}]+"))
    corpus = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(words).alias("avgdl"))
    corpus = corpus.withColumn("folders", F.least(F.lit(MOST_FOLDERS), F.floor(F.col("n") / CHUNKS_A_FOLDER) + 1).cast("int"))
    corpus.coalesce(1).write.parquet(f"{path}/corpus")
    folders = _corpus(chunks.sparkSession, path).first()["folders"]
    rows = postings(chunks, stem, id_col, text_col).withColumn("folder", _folder(F.col("term"), folders))
    # a folder's rows come by ranges of terms, whose bounds prune files and row groups
    rows.repartitionByRange("folder", "term", "chunk_id").sortWithinPartitions("folder", "term", "chunk_id").write.partitionBy("folder").parquet(f"{path}/postings")


def _corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n bigint, avgdl double, folders int").parquet(f"{path}/corpus")  # one row


def indexed_bm25(spark: SparkSession, path: str, query: str, k: int | None = 10, stem: bool = True, among: DataFrame | None = None) -> DataFrame:
    """chunk_id, score like bm25(), of an index written by write_index: only the folders and row groups of
    the query's terms are read. among (chunk_id): chunks that may be found; corpus numbers stay those of all."""
    terms = _stemmed(query_terms(query), stem)
    rows = spark.read.schema("term string, chunk_id string, tf bigint, positions array<int>, dl int, folder int").parquet(f"{path}/postings")
    if not terms:
        return rows.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    words = sorted({w for t in terms for w in t})
    corpus = _corpus(spark, path)
    count = corpus.first()["folders"]
    folders = [r[0] for r in spark.createDataFrame([(w,) for w in words], "term string").select(_folder(F.col("term"), count)).collect()]  # a row a word of the query
    rows = rows.filter(F.col("folder").isin(*folders) & F.col("term").isin(*words))
    spots = lambda w: F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("positions"))))
    held = rows.groupBy("chunk_id").agg(F.max("dl").alias("dl"), *(spots(w).alias(f"w{i}") for i, w in enumerate(words)))
    at = {w: f"w{i}" for i, w in enumerate(words)}
    for i, term in enumerate(terms):
        follows = " AND ".join(["true", *(f"array_contains({at[w]}, p + {j})" for j, w in enumerate(term[1:], 1))])
        held = held.withColumn(f"tf{i}", F.size(F.col(at[term[0]])) if len(term) == 1 else F.expr(f"size(filter({at[term[0]]}, p -> {follows}))"))
    held = held.drop(*at.values())
    df = held.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(terms))))  # one row
    out = _scored(held, df.join(F.broadcast(corpus)), len(terms))
    if among is not None:
        out = out.join(among.select("chunk_id"), "chunk_id", "left_semi")
    return out if k is None else out.orderBy(F.desc("score"), "chunk_id").limit(k)


def _stemmed(terms: list[list[str]], stem: bool) -> list[list[str]]:
    return [[stem_word(w) for w in t] for t in terms] if stem else terms


def _scored(rows: DataFrame, corpus: DataFrame, n_terms: int) -> DataFrame:
    """chunk_id, score of rows(chunk_id, dl, tf0, tf1, ...) that hold every term; corpus: one row n, avgdl, n0, n1, ..."""
    score, match = F.lit(0.0), F.lit(bool(n_terms))
    for i in range(n_terms):
        tf, n = F.col(f"tf{i}").cast("double"), F.col(f"n{i}")
        idf = F.ln((F.col("n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        match = match & (F.col(f"tf{i}") > 0)
    return rows.filter(match).join(F.broadcast(corpus)).select("chunk_id", score.alias("score"))


def bm25(chunks: DataFrame, query: str, k: int | None = 10, stem: bool = False, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """chunk_id, score of the chunks that hold every term, best first (ties by id), without an index.

    One pass counts the query's terms in each chunk; a word that can't become a term of the query by
    stemming is told by its first letters, so only few are stemmed. Corpus numbers are one row."""
    terms = _stemmed(query_terms(query), stem)
    if not terms:
        return chunks.select(F.col(id_col).alias("chunk_id"), F.lit(0.0).alias("score")).limit(0)
    rows = chunks.select(F.col(id_col).alias("chunk_id"), _folded(text_col).alias("folded"))
    rows = rows.withColumn("dl", F.regexp_count("folded", F.lit(r"[\p{L}\p{N}]+")))
    plain = not stem and all(len(t) == 1 for t in terms)  # words can be counted in the text, without arrays of them
    if not plain:
        own = sorted({w for t in terms for w in t})
        words = F.filter(F.split("folded", r"[^\p{L}\p{N}]+"), lambda w: w != "")
        heads = "|".join(re.escape(w[: max(1, len(w) - 1)]) for w in own) or r"\b\B"  # a stem may end in i or e where the word has y or no e
        seen = rows.filter(F.col("folded").rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{heads})")).select("chunk_id", F.posexplode(words).alias("pos", "word")).filter(F.col("word").rlike(f"^(?:{heads})"))
        seen = seen.withColumn("word", stem_column("word") if stem else F.col("word")).filter(F.col("word").isin(*own))
        spots = seen.groupBy("chunk_id").agg(*(F.collect_list(F.when(F.col("word") == w, F.col("pos"))).alias(f"w{i}") for i, w in enumerate(own)))
        rows = rows.drop("folded").join(spots, "chunk_id", "left")
        at = {w: f"w{i}" for i, w in enumerate(own)}
    for i, term in enumerate(terms):
        if plain:
            tf = F.regexp_count("folded", F.lit(rf"(?<![\p{{L}}\p{{N}}]){term[0]}(?![\p{{L}}\p{{N}}])"))
        else:
            follows = " AND ".join(["true", *(f"array_contains({at[w]}, p + {j})" for j, w in enumerate(term[1:], 1))])
            tf = F.coalesce(F.expr(f"size(filter({at[term[0]]}, p -> {follows}))"), F.lit(0))
        rows = rows.withColumn(f"tf{i}", tf)
    held = [F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(terms))]
    corpus = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *held)  # one row
    out = _scored(rows, corpus, len(terms))
    return out if k is None else out.orderBy(F.desc("score"), "chunk_id").limit(k)


def document_frequency(chunks: DataFrame, words: list[str], id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """word, df and the smoothed idf used to weigh sentences, for given words."""
    found = F.array_intersect(tokens(text_col), F.array(*[F.lit(w) for w in words]))
    rows = chunks.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    every = chunks.sparkSession.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    total = chunks.agg(F.count(F.lit(1)).alias("n"))  # one row
    rows = F.broadcast(every).join(rows, "word", "left").withColumn("df", F.coalesce("df", F.lit(0))).join(F.broadcast(total))
    return rows.select("word", "df", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def grep(chunks: DataFrame, pattern: str, k: int | None = 20, doc_col: str = "doc_id", text_col: str = "text", start_col: str | None = None) -> DataFrame:
    """doc_id, char_start, match, snippet, total: texts that match, case aside; blanks match any white space.

    total counts all matching texts in the same scan, whatever k is."""
    spelled = "(?i)" + flexible_blanks(pattern)
    start = F.col(start_col) if start_col else F.lit(0)
    hits = chunks.filter(F.col(text_col).rlike(spelled)).select(F.col(doc_col).cast("string").alias("doc_id"), start.alias("char_start"), F.regexp_extract(text_col, spelled, 0).alias("match"), F.col(text_col).alias("text"))
    hits = hits.withColumn("snippet", excerpt("text", "match")).drop("text")
    total = hits.agg(F.count(F.lit(1)).alias("total"))  # one row
    if k is not None and k > 0:
        hits = hits.orderBy("doc_id", "char_start").limit(k)
    return hits.join(F.broadcast(total))


def rank_fusion(*lists: DataFrame, constant: int = 60, k: int | None = 10) -> DataFrame:
    """Reciprocal rank fusion of lists(id, score): id, score; ties keep the first list's order, then the id."""
    parts = []
    for i, ranked in enumerate(lists):
        place = F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1  # the lists are short: each is a top k
        parts.append(ranked.select("id", (1 / (F.lit(constant) + place)).alias("part"), (F.lit(i * 1_000_000) + place).alias("seen")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("id").agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    fused = fused.orderBy(F.desc(F.round("score", 12)), "seen", "id")
    return (fused.limit(k) if k is not None else fused).select("id", "score")
