"""Ranked search: block-wise postings, synonyms, and top-k that leaves most documents unscored.

Documents are dealt to blocks by a hash of their id, a task each, in which their words are counted:
only texts move. Postings of a term in a block are one row: ids as differences, frequencies and
lengths. A frequent term is thus many rows in many tasks. Scores are BM25.

A word alone gives its k-th best document a score, which is a floor for the k-th score of each query
that asks for it. A task takes a share of the queries through a range of blocks, which it reads from
the index one after the other, and keeps the best k so far, whose last raises the floor. Words whose
largest weights together stay below a query's floor seed no documents, and only those with another
word of the query are scored, with all its words. So the best k of each range are found, and then of
all: the same documents as from all scores. Ties go to the smaller id. There are no more shares and
ranges than tasks of one size, or tasks at work: neither postings nor queries are copied for each pair
of a block and a share.

Defined cases: words are runs of letters and digits in lower case; null and empty texts, queries
without known words, and empty tables find nothing; a null id is left out; of rows that repeat an id
the largest text counts; a word that is given twice in a query counts once, as do its synonyms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship_package
from ..sources.files import opened, shared_folder, shared_uri

K1, B = 1.2, 0.75
BLOCK_DOCUMENTS = 16_384
FIRST_BLOCKS = 64
QUERIES = 50_000
LEAST_SHARE, LEAST_DOCUMENTS = 100, 512  # what is split further only to keep tasks at work
DIGITS = 9  # scores are compared so; sums in another order differ far below


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass
class Index:
    """postings: term, ids, counts, lengths, block, kept in a folder a block; terms: term, documents; n documents in blocks."""

    folder: str
    postings: DataFrame
    terms: DataFrame
    documents: int
    average: float
    blocks: int


def build_index(documents: DataFrame, key: str, text: str, block_documents: int = BLOCK_DOCUMENTS) -> Index:
    """Write the postings of ``documents`` to the shared folder."""
    spark = documents.sparkSession
    named = documents.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    n = named.select("id").distinct().count()
    blocks = max(1, -(-n // block_documents), min(-(-n // LEAST_DOCUMENTS), 2 * spark.sparkContext.defaultParallelism))
    folder = shared_folder(spark, "search")
    placed = named.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartitionById(blocks, F.col("block"))
    sized = placed.groupBy("block", "id").agg(F.max("text").alias("text")).select("block", "id", words(F.col("text")).alias("words"))
    ship_package(spark)
    kind = named.schema["id"].dataType.simpleString()
    lists = sized.mapInArrow(block_lists, f"term string, ids array<{kind}>, counts array<int>, lengths array<int>, block int")
    lists.write.partitionBy("block").parquet(folder)
    postings = spark.read.schema(lists.schema).parquet(folder)
    terms = postings.groupBy("term").agg(F.sum(F.size("counts")).alias("documents"))
    held = postings.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("words")).first().words or 0
    return Index(folder, postings, terms, n, held / n if held else 1.0, blocks)


def block_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the blocks in a partition, from rows of (block, id, words)."""
    blocks: dict[int, list[tuple]] = {}
    for batch in batches:
        for block in np.unique(batch["block"].to_numpy()):
            rows = pa.Table.from_batches([batch]).filter(pc.equal(batch["block"], int(block))).combine_chunks()
            blocks.setdefault(block, []).append(_counted(rows["id"].chunk(0), rows["words"].chunk(0)))
    for block, parts in blocks.items():
        yield from _listed(int(block), parts)


def _counted(ids: pa.Array, texts: pa.ListArray) -> tuple:
    """Different words, and for each that a text holds: the word's number, the text's id, how often, the text's length."""
    coded, lengths = texts.flatten().dictionary_encode(), pc.fill_null(pc.list_value_length(texts), 0).to_numpy()
    many = len(coded.dictionary)
    pairs, counts = np.unique(np.repeat(np.arange(len(ids)) * many, lengths) + coded.indices.to_numpy(), return_counts=True)
    texts_of = pairs // many
    return coded.dictionary, (pairs % many).astype(np.int32), ids.to_numpy()[texts_of], counts.astype(np.int32), lengths[texts_of].astype(np.int32)


def _listed(block: int, parts: list[tuple], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """One row a term, its texts by ascending id."""
    coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    if not len(coded):
        return
    first = np.cumsum([0, *(len(p[0]) for p in parts)])
    numbers = coded.indices.to_numpy()
    terms, ids = np.concatenate([numbers[at + p[1]] for at, p in zip(first, parts)]), np.concatenate([p[2] for p in parts])
    counts, lengths = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
    parts.clear()
    order = np.lexsort((ids, terms))
    ids, counts, lengths = ids[order], counts[order], lengths[order]
    ends = np.cumsum(np.bincount(terms, minlength=len(coded.dictionary)))
    starts = np.concatenate([[0], ends[:-1]])
    gaps = ids.copy()
    gaps[1:] -= ids[:-1]
    gaps[starts] = ids[starts]
    for at in range(0, len(starts), rows):
        low, high = starts[at], ends[min(at + rows, len(ends)) - 1]
        offsets = pa.array(np.append(starts[at : at + rows], high) - low, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[low:high])) for x in (gaps, counts, lengths)]
        yield pa.RecordBatch.from_arrays([coded.dictionary[at : at + rows], *lists, pa.array(np.full(len(offsets) - 1, block, np.int32))], ["term", "ids", "counts", "lengths", "block"])


def weight(count: Column, length: Column, average: float) -> Column:
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / average))


def query_terms(queries: DataFrame, query: str, text: str, synonyms: DataFrame | None) -> DataFrame:
    """(query, term): the words of each query and their synonyms (word, synonym), once each."""
    own = queries.filter(F.col(query).isNotNull()).select(F.col(query).alias("query"), F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
    if synonyms is None:
        return own.distinct()
    both = synonyms.select(F.lower("word").alias("term"), F.lower("synonym").alias("other")).unionByName(synonyms.select(F.lower("synonym").alias("term"), F.lower("word").alias("other")))
    return own.unionByName(own.join(both, "term").select("query", F.col("other").alias("term"))).distinct()


def search(
    index: Index, queries: DataFrame, query: str, text: str, k: int, synonyms: DataFrame | None = None, first_blocks: int = FIRST_BLOCKS, share: int = QUERIES
) -> DataFrame:
    """query, place (from 1), id, score of the best ``k`` documents of each query. Floors come from
    the ``first_blocks`` blocks that hold a word's largest weights; a task takes about ``share`` queries."""
    spark = queries.sparkSession
    asked = query_terms(queries, query, text, synonyms).join(index.terms, "term")
    rarity = F.log(1 + (F.lit(index.documents) - F.col("documents") + 0.5) / (F.col("documents") + 0.5))
    asked = _written(asked.select("query", "term", rarity.alias("rarity")), "search-words")

    weights = F.transform(F.arrays_zip("counts", "lengths"), lambda x: weight(x["counts"], x["lengths"], index.average))
    best = index.postings.select("term", "block", F.slice(F.sort_array(weights, asc=False), 1, k).alias("best")).join(asked.select("term").distinct(), "term", "left_semi")
    turn = F.row_number().over(Window.partitionBy("term").orderBy(F.desc(F.get("best", F.lit(0))), "block"))
    best = best.withColumn("turn", turn).filter(F.col("turn") <= first_blocks).groupBy("term").agg(F.get(F.sort_array(F.flatten(F.collect_list("best")), asc=False), F.lit(k - 1)).alias("kth"))
    rows = asked.join(best, "term").groupBy("query").agg(F.collect_list("term").alias("terms"), F.collect_list("rarity").alias("rarities"), F.coalesce(F.max(F.col("rarity") * F.col("kth")), F.lit(0.0)).alias("floor"))
    rows = _written(rows, "search-queries")

    n, tasks = rows.count(), 2 * spark.sparkContext.defaultParallelism
    shares = max(1, -(-n // share), min(-(-n // LEAST_SHARE), -(-tasks // index.blocks)))
    ranges = min(index.blocks, -(-tasks // shares))
    part = F.pmod(F.xxhash64("query"), F.lit(shares)).cast("int") * ranges
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range")).withColumn("cell", part + F.col("range")).repartitionById(shares * ranges, F.col("cell"))
    average, kind, id_kind = index.average, rows.schema["query"].dataType.simpleString(), index.postings.schema["ids"].dataType.elementType.simpleString()
    folder, blocks = shared_uri(spark, index.folder), index.blocks
    best_of_range = lambda asked: range_best(asked, folder, range(int(asked["range"].iloc[0]), blocks, ranges), k, average)
    ship_package(spark)
    found = cells.groupBy("cell").applyInPandas(best_of_range, f"query {kind}, id {id_kind}, score double")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("score", F.round("score", DIGITS)).withColumn("place", F.row_number().over(by_score))
    return found.filter(F.col("place") <= k).select(F.col("query").alias(query), "place", "id", "score")


def _written(rows: DataFrame, name: str) -> DataFrame:
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


class Block:
    """Postings of a block as arrays: a term's are from ``starts`` to ``ends`` places of documents in ``ids``, and weights, of which ``most`` has the largest."""

    def __init__(self, sizes: np.ndarray, gaps: np.ndarray, counts: np.ndarray, lengths: np.ndarray, average: float):
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        run = np.cumsum(gaps, dtype=gaps.dtype)  # a sum that wraps does so on both sides of the difference
        own = run - np.repeat(run[self.starts] - gaps[self.starts], sizes)
        self.ids, self.at = np.unique(own, return_inverse=True)
        self.weights = weight(counts.astype(float), lengths, average)
        self.most = np.maximum.reduceat(self.weights, self.starts) if len(sizes) else np.zeros(0)
        self.score, self.whole = np.zeros(len(self.ids)), {}

    def dense(self, term: int) -> np.ndarray | None:
        """A frequent word has a weight for each document."""
        if 8 * (self.ends[term] - self.starts[term]) <= len(self.ids):
            return None
        if term not in self.whole:
            s = slice(self.starts[term], self.ends[term])
            self.whole[term] = np.zeros(len(self.ids))
            self.whole[term][self.at[s]] = self.weights[s]
        return self.whole[term]

    def best(self, terms: list[int], rarities: list[float], least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` documents that reach ``least``."""
        own = sorted(((r * self.most[t], r, t) for t, r in zip(terms, rarities)), key=lambda x: -x[0])
        left, seeds = sum(x[0] for x in own), 0
        while seeds < len(own) and left >= least:
            left -= own[seeds][0]
            seeds += 1
        if not seeds:
            return self.ids[:0], self.score[:0]
        score, lists = self.score, []
        for _, r, t in own:
            s = slice(self.starts[t], self.ends[t])
            lists.append((r, self.at[s], self.weights[s], self.dense(t)))
        dense_seed = any(x[3] is not None for x in lists[:seeds])
        for r, at, w, dense in lists[:seeds]:
            if dense is None:
                score[at] += r * w
            else:
                score += r * dense
        some = np.flatnonzero(score) if dense_seed else lists[0][1] if seeds == 1 else np.unique(np.concatenate([x[1] for x in lists[:seeds]]))
        total = score[some]
        score[slice(None) if dense_seed else some] = 0
        for r, at, w, dense in lists[seeds:]:
            if dense is not None:
                total += r * dense[some]
            else:
                score[at] = r * w
                total += score[some]
                score[at] = 0
        total = np.round(total, DIGITS)
        good = np.flatnonzero(total >= least)
        if len(good) > k:
            good = np.flatnonzero(total >= max(least, np.partition(total, -k)[-k]))
            good = good[np.lexsort((some[good], -total[good]))[:k]]
        return self.ids[some[good]], total[good]


def _least(floor: float) -> float:
    return floor * (1 - 1e-9) - 10.0**-DIGITS


def block_best(postings: pd.DataFrame, asked: pd.DataFrame, k: int, average: float) -> pd.DataFrame:
    """query, id, score of the best ``k`` documents of one block, if they reach the query's floor."""
    joined = [np.concatenate(postings[c]) if len(postings) else np.zeros(0, np.int64) for c in ("ids", "counts", "lengths")]
    block, number = Block(postings["ids"].str.len().to_numpy(np.int64), *joined, average), {t: i for i, t in enumerate(postings["term"])}
    found: list[tuple] = []
    for query, terms, rarities, floor in zip(asked["query"], asked["terms"], asked["rarities"], asked["floor"]):
        own = [(number[t], r) for t, r in zip(terms, rarities) if t in number]
        ids, scores = block.best([t for t, _ in own], [r for _, r in own], _least(floor), k)
        found += [(query, i, s) for i, s in zip(ids, scores)]
    return pd.DataFrame(found, columns=["query", "id", "score"])


def range_best(asked: pd.DataFrame, folder: str, blocks: range, k: int, average: float) -> pd.DataFrame:
    """query, id, score of the best ``k`` documents of ``blocks``, if they reach the query's floor."""
    sizes = asked["terms"].str.len().to_numpy()
    ends = np.cumsum(sizes)
    starts, rarities = ends - sizes, np.concatenate(asked["rarities"])
    codes, vocabulary = pd.factorize(np.concatenate(asked["terms"]))
    vocabulary = pa.array(vocabulary, pa.string())
    least = _least(asked["floor"].to_numpy(float))
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for number in blocks:
        terms, block = block_postings(folder, number, vocabulary, average)
        row, most = np.full(len(vocabulary), -1), np.zeros(len(vocabulary))
        row[terms], most[terms] = np.arange(len(terms)), block.most
        reach = np.add.reduceat(rarities * most[codes], starts)
        for q in np.flatnonzero((reach > 0) & (reach >= least)):
            own, rare = row[codes[starts[q] : ends[q]]], rarities[starts[q] : ends[q]]
            ids, scores = block.best(own[own >= 0].tolist(), rare[own >= 0].tolist(), least[q], k)
            if not len(ids):
                continue
            if q in best:
                ids, scores = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], scores])
                first = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[first], scores[first]
            best[q] = ids, scores
            if len(ids) == k:
                least[q] = max(least[q], _least(scores.min()))
    counts = [len(ids) for ids, _ in best.values()]
    columns = [np.concatenate(x) if best else [] for x in ([ids for ids, _ in best.values()], [scores for _, scores in best.values()])]
    return pd.DataFrame({"query": asked["query"].iloc[np.repeat(np.array([*best], int), counts)].array, "id": columns[0], "score": columns[1]})


def block_postings(folder: str, number: int, vocabulary: pa.Array, average: float) -> tuple[np.ndarray, Block]:
    """A block's terms, as numbers in ``vocabulary``, and their postings. A block that no document fell into has no folder."""
    store, path = opened(f"{folder}/block={number}")
    files = [x.path for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.path.endswith(".parquet")]
    kind = pa.schema({"term": pa.string(), "ids": pa.list_(pa.int64()), "counts": pa.list_(pa.int32()), "lengths": pa.list_(pa.int32())})
    tables = [pq.ParquetFile(store.open_input_file(x)).read(columns=kind.names) for x in files]
    table = pa.concat_tables(tables) if tables else kind.empty_table()
    at = pc.index_in(table["term"], value_set=vocabulary).combine_chunks()
    table = table.filter(pc.is_valid(at))
    lists = [table[c].combine_chunks() for c in kind.names[1:]]
    return pc.drop_null(at).to_numpy(), Block(pc.list_value_length(lists[0]).to_numpy().astype(np.int64), *(x.flatten().to_numpy() for x in lists), average)
