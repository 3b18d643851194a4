"""Exact vector search and retrieval with citations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.text import fixed
from ..session import exists, written

OVER_FETCH = 3
QUERY_BLOCK = 16_384  # query vectors sent to the tasks at a time, once over the items for each block
ITEM_BLOCK = 1000  # items a task holds against them at a time
SCORE_CELLS = 1 << 19  # scores a task makes at a time: 4 MB


def dot(a, b) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


RANK_DECIMALS = 9  # scores equal to so many places are ties, which the smaller id wins


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column; a vector of zeros stays so."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    size = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(size == 0, 1, size)


class _Best:
    """The k best items of each of n queries so far, by falling score and rising id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.items = None  # their ids; what has no score yet has none that counts

    def add(self, mine: np.ndarray, q: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Items for the queries ``mine`` with vectors ``q``; scores are made for SCORE_CELLS pairs at a time."""
        step = max(1, SCORE_CELLS // max(len(vectors), 1))
        for at in range(0, len(mine), step):
            self._merge(mine[at : at + step], np.round(q[at : at + step] @ vectors.T, RANK_DECIMALS), ids)

    def _merge(self, mine: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.scores[mine, -1]
        if scores.shape[1] > self.k:  # nothing below the k best of these, or of those held, can stay
            least = np.maximum(least, np.partition(np.where(np.isnan(scores), -np.inf, scores), -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        if not len(row):
            return
        if self.items is None:
            self.items = np.zeros(self.scores.shape, ids.dtype)
        elif self.items.dtype != (wide := np.promote_types(self.items.dtype, ids.dtype)):
            self.items = self.items.astype(wide)
        touched, row = np.unique(row, return_inverse=True)
        held = self.scores[mine[touched]]
        old, place = np.nonzero(np.isfinite(held))
        asker = np.concatenate([old, row])
        score = np.concatenate([held[old, place], scores[touched[row], col]])
        item = np.concatenate([self.items[mine[touched]][old, place], ids[col]])
        order = np.lexsort((-score, asker))
        tied = np.zeros(len(order) + 1, bool)
        tied[1:-1] = (asker[order][1:] == asker[order][:-1]) & (score[order][1:] == score[order][:-1])
        if (some := np.flatnonzero(tied[:-1] | tied[1:])).size:  # ids are compared where they decide
            part = order[some]
            order[some] = part[np.lexsort((item[part], -score[part], asker[part]))]
        asker, score, item = asker[order], score[order], item[order]
        rank = np.arange(len(asker)) - np.searchsorted(asker, asker)
        kept = rank < self.k
        to = mine[touched][asker[kept]], rank[kept]
        self.scores[to], self.items[to] = score[kept], item[kept]

    def rows(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query no, item id, score) of some of the queries."""
        row, place = np.nonzero(np.isfinite(self.scores[start:stop]))
        return row + start, self.items[row + start, place] if len(row) else row, self.scores[row + start, place]


def top_k(queries: DataFrame, items: DataFrame, k: int, decimals: int = 4, same: str | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): the k most similar items of each query, by id on ties.

    The queries, (query_id, vector[, group]), are a stated set: they go to every task in blocks;
    each task keeps k items per query of its own rows, so what is shuffled is k rows per query
    and task.  With ``same`` an item must have the query's value in column ``group``.  Scores are
    ranked in full and rounded to ``decimals`` in the result.  Rows without id or vector are left out.
    """
    spark = items.sparkSession
    cols = ["query_id", "vector"] + (["group"] if same else [])
    asked = queries.select(*cols).where("query_id is not null and vector is not null").orderBy("query_id").toLocalIterator()
    item_cols = ["item_id", "vector"] + (["group"] if same else [])
    slim = items.select(*item_cols).where("item_id is not null and vector is not null")
    q_type, i_type = queries.schema["query_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"query_id {q_type}, item_id {i_type}, score double"
    out, block = None, []

    def search(rows):
        matrix = np.array([r["vector"] for r in rows], np.float64)
        dim = matrix.shape[1]
        size = np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows]), matrix / np.where(size == 0, 1, size), np.array([r["group"] for r in rows]) if same else None))

        def run(batches):
            ids, q, groups = shared.value
            places: dict = {}  # queries of each group, a NULL group has none
            for n, g in enumerate(groups if groups is not None else ()):
                if g is not None:
                    places.setdefault(g, []).append(n)
            best = _Best(len(ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, ITEM_BLOCK):
                    part = batch.slice(at, ITEM_BLOCK)
                    vectors, own = _matrix(part.column(1), dim), np.array(part.column(0).to_pylist())
                    if groups is None:
                        best.add(np.arange(len(ids)), q, vectors, own)
                        continue
                    of_group: dict = {}
                    for n, g in enumerate(part.column(2).to_pylist()):
                        of_group.setdefault(g, []).append(n)
                    for g, rows in of_group.items():
                        if g in places:
                            mine = np.array(places[g])
                            best.add(mine, q[mine], vectors[rows], own[rows])
            for at in range(0, len(ids), ITEM_BLOCK):
                asker, items, scores = best.rows(at, at + ITEM_BLOCK)
                if len(asker):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asker].tolist()), pa.array(items.tolist()), pa.array(scores)], names=["query_id", "item_id", "score"])

        return slim.mapInArrow(run, schema)

    for row in asked:
        block.append(row)
        if len(block) == QUERY_BLOCK:
            out, block = (search(block) if out is None else out.unionAll(search(block))), []
    if block:
        out = search(block) if out is None else out.unionAll(search(block))
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", F.round("score", decimals))


def index_documents(parsed: DataFrame, dim: int = 256, hash_name: str = "blake2b", embed=None) -> DataFrame:
    """(item_id, document_id, source_id, jurisdiction, chunk_index, title, reference_number, text, vector): the chunks of every document.

    ``embed`` maps a text column to a vector column; the hashed bag of words is the default, made in
    the worker that cuts the chunks.
    """
    carried = ("source_id", "jurisdiction", "title", "reference_number")
    schema = "item_id string, document_id string, source_id string, jurisdiction string, chunk_index int, title string, reference_number string, text string"
    hashed = kernels.Hashed(hash_name) if embed is None else None

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, kernels.SLICE):
                part = batch.slice(at, kernels.SLICE)
                cut = [(n, i, text) for n, t in enumerate(part.column(5).to_pylist()) for i, text, _, _ in kernels.chunks(t)]
                if not cut:
                    continue
                ids, row = part.column(0).to_pylist(), pa.array([n for n, _, _ in cut], pa.int64())
                texts = [text for _, _, text in cut]
                source, jurisdiction, title, reference = (part.column(n).take(row) for n in (1, 2, 3, 4))
                names = pa.array([None if ids[n] is None else f"{ids[n]}:{i}" for n, i, _ in cut], pa.string())
                out = [names, part.column(0).take(row), source, jurisdiction, pa.array([i for _, i, _ in cut], pa.int32()), title, reference, pa.array(texts, pa.string())]
                if hashed is not None:
                    vectors = kernels.embeddings(texts, dim, known=hashed)
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(vectors.ravel())))
                yield pa.RecordBatch.from_arrays(out, names=columns)

    rows = parsed.where("clean_text is not null").select("id", *carried, "clean_text")
    columns = [x.split()[0] for x in schema.split(", ")] + (["vector"] if embed is None else [])
    if embed is None:
        return rows.mapInArrow(run, f"{schema}, vector array<double>")
    return rows.mapInArrow(run, schema).withColumn("vector", embed(F.col("text")))


def upsert_index(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Puts chunks into a stored index; a chunk id that is in it already is replaced.

    The table is written to a new version beside the old one, which readers keep until they read anew.
    """
    new = rows.dropDuplicates(["item_id"])
    version = 0
    if exists(spark, f"{path}/version"):
        version = spark.read.parquet(f"{path}/version").first()["version"]
        old = spark.read.parquet(f"{path}/rows-{version}")
        new = old.join(new.select("item_id"), "item_id", "left_anti").unionByName(new)
    new.write.mode("overwrite").parquet(f"{path}/rows-{version + 1}")
    spark.range(1).select(F.lit(version + 1).alias("version")).write.mode("overwrite").parquet(f"{path}/version")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows-{spark.read.parquet(f'{path}/version').first()['version']}")


def search(questions: DataFrame, index: DataFrame, k: int = 5, min_score: float = 0.0, same_jurisdiction: bool = False, source_id: str | None = None, dim: int = 256, hash_name: str = "blake2b", embed=None, documents: DataFrame | None = None) -> DataFrame:
    """(query_id, place, document_id, item_id, score, label, text): the best chunk of each of the k best documents.

    ``questions`` has (query_id, text[, jurisdiction]).  Of the 3k best chunks of a question those
    above the threshold count; so fewer than k documents may come out.  ``documents`` are those
    that ``index`` is made of by ``index_documents``, where it is not stored: then only the chunks
    of documents with a hit are made a second time, to be cited.
    """
    make = embed or (lambda text: kernels.embed_udf(text, dim, hash_name))
    items = index if source_id is None else index.where(F.col("source_id") == source_id)
    asked = questions.select("query_id", make(F.col("text")).alias("vector"), *([F.col("jurisdiction").alias("group")] if same_jurisdiction else []))
    hits = top_k(asked, items.withColumn("group", F.col("jurisdiction")), OVER_FETCH * k, RANK_DECIMALS, "group" if same_jurisdiction else None)
    if documents is not None:
        hits = written(hits, "search-hits")
        found = hits.select(F.regexp_replace("item_id", r":\d+$", "").alias("id")).distinct()
        items = index_documents(documents.join(found, "id", "left_semi"), dim, embed=lambda text: F.lit(None))  # no vectors here
    told = items.select("item_id", "document_id", "title", "reference_number", "jurisdiction", "text")
    rows = best_per_document(hits.join(told, "item_id"), "document_id", k, min_score)
    label = citation_label(F.col("reference_number"), F.col("title"), F.col("document_id"), F.col("jurisdiction"))
    return rows.select("query_id", "place", "document_id", "item_id", F.round("score", 4).alias("score"), label.alias("label"), "text")


def best_per_document(hits: DataFrame, doc: str, k: int, min_score: float = 0.0) -> DataFrame:
    """Of the 3k best hits of each query: above the threshold, the best of each document, the first k."""
    kept = hits.where((F.col("rank") <= OVER_FETCH * k) & (F.lit(min_score <= 0) | (F.col("score") >= min_score)))
    per = Window.partitionBy("query_id", doc).orderBy("rank")
    first = kept.withColumn("n", F.row_number().over(per)).where("n = 1").drop("n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k)


def citation_label(reference, title, doc_id, jurisdiction) -> Column:
    name = F.coalesce(F.nullif(reference, F.lit("")), F.nullif(F.left(title, F.lit(60)), F.lit("")), F.concat(F.lit("doc:"), F.left(doc_id, F.lit(8))))
    return F.concat(name, F.lit(" ["), jurisdiction, F.lit("]"))


def context_block(rows: DataFrame, by: str, place: str, label: str, score: str, text: str) -> DataFrame:
    """(by, context): numbered citations of each query, joined by rules; as many per query as were kept."""
    entry = F.struct(F.col(place).alias("p"), F.concat(F.lit("["), F.col(place), F.lit("] "), F.col(label), F.lit(" (score: "), fixed(score, 3), F.lit(")\n"), F.col(text)).alias("t"))
    listed = F.array_sort(F.collect_list(entry))
    return rows.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n---\n\n").alias("context"))
