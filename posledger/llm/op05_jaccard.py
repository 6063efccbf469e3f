"""Operator 5, n-gram Jaccard join by prefixes under several global orders.

Two sets whose Jaccard similarity reaches t share a token among the first n - ceil(t*n) + 1 of each,
under any order of all tokens. Three orders are used, and a pair is verified only if it passes all:

1. by hash: the block exchange tells which prefix tokens two different sets have; a set without one is out;
2. rarest first, by token counts over all sets that are left (exact counts on a fine log scale), ties by
   a second hash; a prefix of tokens that no other set has takes the set out;
3. rarest first with ties by a third hash.

Equal sets are one class throughout. Sets that meet in prefix tokens of orders 2 and 3 form
candidate groups (components; a star per token, so a token with n sets gives n edges). A group of up to ``group`` sets is
a cell; a larger one is dealt into cells of about ``chunk`` sets by bands of size, two bands apart of which can't link, and
by hash. Cells that can link are compared pair by pair of cells: two sets must share prefix tokens of both orders and fit in
size before their overlap is counted, ``pivots`` sets against the other cell at a time. What is told of a pair of cells is per
set the number of documents that it links with, and a forest of the links: every link is verified and counted, no row is made for it.

Sets are known by 64-bit hashes of their shingles. Null and empty texts have no shingles and link with
nothing; rows with equal ids are documents of their own; a null id is never the least unless all of a
component's are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import kernels as K
from .shared import components, saved, spread_join

U = np.uint64
ROWS = "doc_id long, key long, block long, n_shingles long, node long"
SETS = "node long, n long, tokens binary, second array<long>, third array<long>"
LABELS = "node long, root long"
NUMBER = 80
GROUP, PIVOTS, CHUNK = 512, 256, 512
TOLD = "node long, root long, links long"


class _Sets:
    """Shingle sets of a block's documents: per row the document and a token; ``n`` and ``node`` per document."""

    def __init__(self, texts: list, size: int):
        self.doc, self.token = K.shingle_sets(K.Words(texts, lower=True), size)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.n = np.diff(self.first)
        sums = np.concatenate([[U(0)], np.cumsum(K.mix(self.token ^ U(0xA24BAED4963EE407)), dtype=U)])
        self.node = K.mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.n.astype(U)).view(np.int64)

    def prefix(self, number: int, rank: np.ndarray | None = None, hashes: np.ndarray | None = None) -> np.ndarray:
        """Rows in each document's prefix, with tokens in order of rank and hash (as they stand: by token)."""
        order = np.arange(len(self.doc)) if rank is None else np.lexsort((hashes, rank, self.doc))
        place = np.arange(len(self.doc)) - self.first[self.doc]
        span = self.n - -(-number * self.n // 100) + 1
        return order[place < span[self.doc]]


def _owned(table: pa.Table, owners: pa.Table) -> list:
    """The texts of the documents that stand for a class in this block, in the order of their keys."""
    mine = set(owners["key"].drop_null().to_pylist())
    texts, chosen = B.texts_of(table), {}
    for key, text in zip(table["key"].to_pylist(), texts):
        if key in mine:
            chosen[key] = text
    return [chosen[k] for k in sorted(chosen)]


def _rows(docs: DataFrame, size: int) -> DataFrame:
    def read(table):
        s = _Sets(B.texts_of(table), size)
        node = pa.array(s.node, pa.int64(), mask=s.n == 0)
        return pa.table({"doc_id": table["doc_id"], "key": table["key"], "block": table["block"], "n_shingles": s.n.astype(np.int64), "node": node})

    return docs.groupBy("block").applyInArrow(read, ROWS)


def _candidates(docs: DataFrame, owners: DataFrame, bits: int, size: int, number: int) -> DataFrame:
    """SETS of the classes that pass the three orders' filters."""

    def split(told):
        stage = told["stage"].to_numpy()
        return {k: told.filter(pa.array(stage == k)) for k in (0, 1, 2)}

    def first(table, told):
        """Order 1: prefixes by hash."""
        s = _Sets(_owned(table, told), size)
        distinct, count, where = K.compact(s.token[s.prefix(number)])
        return s, distinct, count, where

    def left(table, told):
        """Sets with a prefix token, in order 1, that another set has too."""
        s, distinct, _, where = first(table, told[0])
        shared = B.answers(told[1], bits, distinct)[where]
        live = np.zeros(len(s.n), bool)
        live[s.doc[s.prefix(number)[shared]]] = True
        rows = live[s.doc]
        return s, live, rows, K.compact(s.token[rows])

    def send_first(table, told):
        _, distinct, count, _ = first(table, told)
        return B.send(B.number(table) if table.num_rows else 0, bits, distinct, (count > 1).astype(np.uint8))

    def send_all(table, told):
        _, _, _, (distinct, count, _) = left(table, split(told))
        return B.send(B.number(table) if table.num_rows else 0, bits, distinct, count.astype("<u4").view(np.uint8).reshape(-1, 4))

    def tally(table):
        """Counts of tokens as eighths of powers of two; 0 is a token of one set only."""
        hashes, extra, bounds = B.gathered(table)
        where = np.unique(hashes, return_inverse=True)[1]
        n = np.bincount(where, weights=extra.view("<u4"))[where]
        return B.reply(table, np.minimum(255, np.ceil(8 * np.log2(n))).astype(np.uint8), bounds, pack=False)

    def finish(table, told):
        told = split(told)
        s, live, rows, (distinct, _, where) = left(table, told)
        rank = np.zeros(len(s.token), np.uint8)
        rank[rows] = B.answers(told[2], bits, distinct, np.uint8)[where]
        rank[~rows] = 0
        marks = []
        for salt in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F):
            mark = np.zeros(len(s.token), bool)
            mark[s.prefix(number, rank, K.mix(s.token ^ U(salt)))] = True
            marks.append(mark & (rank > 0) & rows)
        out = {"node": [], "n": [], "tokens": [], "second": [], "third": []}
        for d in np.flatnonzero(live).tolist():
            a, b = s.first[d], s.first[d + 1]
            two, three = (s.token[a:b][m[a:b]] for m in marks)
            if len(two) and len(three):
                for name, value in zip(out, (s.node[d], b - a, s.token[a:b].tobytes(), two.view(np.int64), three.view(np.int64))):
                    out[name].append(value)
        return pa.table(
            {
                "node": pa.array(out["node"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "tokens": pa.array(out["tokens"], pa.binary()),
                "second": pa.array(out["second"], pa.list_(pa.int64())), "third": pa.array(out["third"], pa.list_(pa.int64())),
            }
        )

    mine = owners.select("block", "key", F.lit(None).cast("int").alias("p"), F.lit(None).cast("binary").alias("answer"), F.lit(0).alias("stage"))
    tell = lambda df, k: df.select("block", F.lit(None).cast("long").alias("key"), "p", "answer", F.lit(k).alias("stage"))
    one = tell(B.repeated(B.meet(docs, mine, send_first, B.SENT)), 1)
    two = tell(B.meet(docs, mine.unionByName(one), send_all, B.SENT).groupBy("p").applyInArrow(tally, B.ANSWER), 2)
    return B.meet(docs, mine.unionByName(one).unionByName(two), finish, SETS)


def _bits(arrays: list, vocabulary: np.ndarray) -> np.ndarray:
    """A bit per token of the vocabulary that each array has, as rows of 64-bit words."""
    out = np.zeros((len(arrays), 8 * max(1, -(-len(vocabulary) // 64))), np.uint8)
    for k, x in enumerate(arrays):
        at = np.searchsorted(vocabulary, x)
        at = np.minimum(at, len(vocabulary) - 1) if len(vocabulary) else at[:0]
        at = at[vocabulary[at] == x[: len(at)]] if len(at) else at
        np.bitwise_or.at(out[k], at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view(U)


def _columns(table: pa.Table) -> tuple:
    tokens = [np.frombuffer(x.as_buffer(), U) for x in table["tokens"]]
    lists = [[np.sort(np.asarray(x, np.int64)) for x in table[c].to_pylist()] for c in ("second", "third")]
    return tokens, *lists


def _shared(columns: list) -> np.ndarray:
    every, count = np.unique(np.concatenate(columns) if columns else np.zeros(0, U), return_counts=True)
    return every[count > 1]


def _links(a: tuple, b: tuple, number: int):
    """Per set of ``a``, the mask of the sets of ``b`` that reach the similarity. The filters' prefixes come first."""
    sizes = [np.array([len(x) for x in side[0]], np.int64) for side in (a, b)]
    packed = []
    for k in range(3):
        words = _shared([np.unique(np.concatenate(side[k])) for side in (a, b) if side[k]] if a is not b else a[k])
        packed.append((_bits(a[k], words), _bits(b[k], words) if a is not b else None))
    packed = [(x, x if y is None else y) for x, y in packed]
    for i in range(len(a[0])):
        n = sizes[0][i]
        can = (100 * np.minimum(n, sizes[1]) >= number * np.maximum(n, sizes[1]))
        for left, right in packed[1:]:
            at = np.flatnonzero(can)
            can[at] = (right[at] & left[i]).any(1)
        at = np.flatnonzero(can)
        common = np.bitwise_count(packed[0][1][at] & packed[0][0][i]).sum(1, dtype=np.int64)
        can[at] = 100 * common >= number * (n + sizes[1][at] - common)
        yield can


def _compare(number: int, pivots: int):
    """All links between the sets of two cells, or of one with itself: per linked set its links, and the least of its tree."""

    def solve(table: pa.Table) -> pa.Table:
        second = table["other"].to_numpy(zero_copy_only=False).astype(bool)
        one = table["a"][0].as_py() == table["b"][0].as_py()
        sides = [table] if one else [table.filter(pa.array(~second)), table.filter(pa.array(second))]
        columns = [_columns(x) for x in sides]
        nodes = np.concatenate([x["node"].to_numpy() for x in sides])
        copies = [x["copies"].to_numpy() for x in sides]
        shift = 0 if one else sides[0].num_rows
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for s in range(0, sides[0].num_rows, pivots):
            some = columns[0] if one and sides[0].num_rows <= pivots else tuple(x[s : s + pivots] for x in columns[0])
            for i, linked in enumerate(_links(some, columns[-1], number), s):
                if one:
                    linked[i] = False
                at = np.flatnonzero(linked)
                if len(at):
                    links[i] += copies[-1][at].sum()
                    if not one:
                        links[at + shift] += copies[0][i]
                    trees = np.unique(root[np.append(at + shift, i)])
                    if len(trees) > 1:
                        root[np.isin(root, trees)] = trees[0]
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, root, nodes)
        told = np.flatnonzero(links)
        return pa.table({"node": nodes[told], "root": least[root[told]], "links": links[told]})

    return solve


def _cells(sets: DataFrame, number: int, group: int, chunk: int) -> DataFrame:
    """From (node, n, cls, m), without the sets' tokens, a row (node, cls, a, b, other) per pair of cells that a set is compared in."""
    # a little wider than the similarity, so that rounding never puts sets that fit two bands apart
    band = F.floor(F.log("n") / F.lit(float(np.log(100.01 / number))))
    banded = sets.withColumn("band", F.when(F.col("m") <= group, F.lit(0).cast("long")).otherwise(band)).withColumn("_band", F.concat_ws(":", "cls", "band"))
    banded = saved(banded)
    bands = banded.groupBy("_band", "cls", "band").agg(F.max("m").alias("m"), F.count("*").alias("k"))
    bands = saved(bands.withColumn("pieces", F.when(F.col("m") <= group, F.lit(1)).otherwise(F.ceil(F.col("k") / chunk)).cast("int")).drop("m", "k"))
    cell = lambda band, piece: F.concat_ws(":", band, piece)
    each = bands.select("cls", "band", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    other = each.select("cls", F.col("band").alias("band2"), F.col("piece").alias("piece2"))
    near = ((F.col("band2") == F.col("band")) & (F.col("piece2") >= F.col("piece"))) | (F.col("band2") == F.col("band") + 1)
    pairs = each.join(other, "cls").where(near).select("cls", cell("band", "piece").alias("a"), cell("band2", "piece2").alias("b"))
    sides = pairs.select("cls", F.col("a").alias("cell"), "a", "b", F.lit(False).alias("other"))
    sides = sides.unionByName(pairs.where("a <> b").select("cls", F.col("b").alias("cell"), "a", "b", F.lit(True).alias("other")))
    placed = spread_join(banded, bands.select("_band", "pieces"), "_band", "node")
    placed = placed.select("node", "cls", cell("band", F.pmod(F.xxhash64("node"), F.col("pieces"))).alias("cell"))
    return placed.join(sides, ["cls", "cell"]).select("node", "cls", "a", "b", "other")


def _stars(sets: DataFrame, column: str, *keys: str) -> DataFrame:
    """Edges between the sets that have a token of ``column`` in common, a star per token."""
    each = sets.select("node", *keys, F.explode(column).alias("token"))
    least = each.groupBy("token", *keys).agg(F.min("node").alias("b"))
    return each.join(least, ["token", *keys]).select(F.col("node").alias("a"), "b")


def classes(docs: DataFrame, size: int = 5, number: int = NUMBER, group: int = GROUP, pivots: int = PIVOTS, chunk: int = CHUNK):
    """Rows of the documents (ROWS), and a row per shingle set: its documents, links to others, the least of its component."""
    plan = B.layout(docs)
    blocked = B.blocked(docs, plan).withColumn("key", F.xxhash64("text"))
    rows = saved(_rows(blocked, size))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("key"))).alias("least")
    own = saved(rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("block", "key")).alias("o"), F.count("*").alias("copies"), least))
    sets = saved(_candidates(blocked, own.select("o.block", "o.key"), plan.bits, size, number))
    second = components(_stars(sets, "second"))
    light = sets.select("node", "n", "third").join(second, "node", "left").withColumn("cls", F.coalesce("root", "node")).drop("root")
    third = components(_stars(light, "third", "cls"))
    light = light.drop("cls", "third").join(third, "node", "left").withColumn("cls", F.coalesce("root", "node")).drop("root")
    light = saved(light)
    light = spread_join(light, light.groupBy("cls").agg(F.count("*").alias("m")).where("m > 1"), "cls", "node")
    dealt = _cells(light, number, group, chunk).join(own.select("node", "copies"), "node")
    told = saved(sets.join(dealt, "node").groupBy("cls", "a", "b").applyInArrow(_compare(number, pivots), TOLD))
    root = components(told.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = own.join(root, "node", "left").join(links, "node", "left")
    others = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return rows, saved(nodes.select("node", F.coalesce("root", "node").alias("comp"), others.alias("n_links"), "least"))


def near_duplicates(docs: DataFrame, size: int = 5, number: int = NUMBER, **sizes) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents that a document links with) and ``first`` on one row of each component."""
    rows, nodes = classes(docs, size, number, **sizes)
    least = nodes.groupBy("comp").agg(F.min("least").alias("first"))
    placed = spread_join(nodes.drop("least"), least, "comp", "node").select("node", "n_links", "first")
    placed = spread_join(rows, placed, "node", "doc_id", "left")
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("key"))
    alone = F.col("node").isNull()
    return placed.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "key", (alone | (order == F.col("first"))).alias("first"),
    )


def jaccard_components(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each component left, with all their columns; texts without words all stay."""
    first = near_duplicates(docs).where("first")
    first = first.select(F.col("doc_id").alias("_nd_id"), F.col("key").alias("_nd_key"), (F.col("n_shingles") > 0).alias("_nd_one")).distinct()
    keyed = docs.withColumn("_nd_text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    held = keyed.join(first, F.col("doc_id").eqNullSafe(F.col("_nd_id")) & (F.col("_nd_text") == F.col("_nd_key")))
    turn = F.row_number().over(Window.partitionBy("_nd_text", "doc_id").orderBy(F.lit(1)))
    return held.withColumn("_nd_turn", turn).where("_nd_turn = 1 OR NOT _nd_one").select(*[F.col(c) for c in docs.columns])
