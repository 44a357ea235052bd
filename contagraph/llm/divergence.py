"""Source divergence audit: how far the word frequencies of a language's sources lie apart, and which words mark a source.

The kept terms of a language are dealt into blocks. A block is a dense int64 matrix of groups by terms; all pairs of its
rows are compared by broadcasting, which gives a partial pair matrix, and each group keeps a heap of its best terms. Partial
matrices are summed and heaps merged. Languages with many sources are cut into tiles of groups as well, and tiles meet in
pairs, so a task holds no more than two tiles of one block.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contagraph.llm.common import col, short_batches, stash, table

MIN_DOCS, TOP = 10, 10
#: Cells of a dense tile, groups of a tile, and counts that a task holds before it passes them on.
CELLS, GROUPS, HELD = 500_000, 256, 200_000
#: Letters in lower case, every byte of a code point beyond ASCII as it is, and blanks for all else.
_TERM_BYTES = bytes(b if b > 127 else b | 32 if 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it): partial counts, to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[tuple, Counter] = defaultdict(Counter)
        holds: defaultdict[tuple, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lg, src), found in counts.items():
                terms = list(found)
                have = holds[lg, src]
                for i in range(0, len(terms), 50_000):
                    some = terms[i : i + 50_000]
                    columns = [pa.array([lg] * len(some), pa.string()), pa.array([src] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([found[t] for t in some], pa.int64()), pa.array([have[t] for t in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            counts.clear()
            holds.clear()

        for batch in batches:
            for body, lg, src in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = Counter(body.as_py().translate(_TERM_BYTES).split(b" "))
                found.pop(b"", None)
                counts[lg, src].update(found)
                holds[lg, src].update(found.keys())
            if sum(map(len, counts.values())) > HELD:
                yield from out()
        yield from out()

    some = lambda c: F.coalesce(col(c), F.lit(""))
    read = docs.select(some(text).cast("binary").alias("text"), some(lang).alias("lang"), some(source).alias("source"))
    return short_batches(read).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * count / total), exact by long division for totals below 9e15."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _blocks(cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """For each block: partial sums (a, b, null, f) of pairs of groups a < b, over `seen` terms that either tile holds, and (a, null, term, f) of its best terms."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, ti, tj = key
        head, body = rows[rows["term"].isna()], rows[rows["term"].notna()]
        head = head.drop_duplicates("g").sort_values("g")
        ids, kept = head["g"].to_numpy(), int(head["kept"].iloc[0])
        terms, at = np.unique(body["term"].to_numpy(str), return_inverse=True) if len(body) else (np.array([], str), np.array([], np.int64))
        count = np.zeros((len(ids), len(terms)), np.int64)
        count[np.searchsorted(ids, body["g"].to_numpy()), at] = body["n"].to_numpy()
        p = share(count + 2, (head["total"].to_numpy() + 2 * kept)[:, None]) if len(terms) else count
        tile = ids // GROUPS
        left, right = np.flatnonzero(tile == ti), np.flatnonzero(tile == tj)
        a, b, f, words = [], [], [], []
        for i in left:
            others = right[ids[right] > ids[i]] if ti == tj else right
            a += [ids[i]] * len(others)
            b += ids[others].tolist()
            f += apart(p[i][None, :], p[others]).sum(axis=1).tolist()
        words += [None] * len(f)
        if ti == tj and len(terms):
            everywhere = np.zeros(len(terms), np.int64)
            everywhere[at] = body["everywhere"].to_numpy()
            q = share(everywhere + 2, int(head["lang_total"].iloc[0]) + 2 * kept)
            for i in left:
                marks = np.flatnonzero((count[i] > 0) & (p[i] > q))
                best = heapq.nsmallest(top, zip((-apart(p[i, marks], q[marks])).tolist(), (t.encode() for t in terms[marks]), strict=True))
                a += [ids[i]] * len(best)
                b += [None] * len(best)
                f += [-v for v, _ in best]
                words += [t.decode() for _, t in best]
        return pd.DataFrame({"lang": pd.Series([key[0]] * len(a), dtype=object), "a": a, "b": pd.array(b, "Int64"), "term": pd.Series(words, dtype=object), "f": f, "seen": [len(terms)] * len(a)})

    deal = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    first = (F.col("g") / GROUPS).cast("int")
    # a tile of groups meets itself and every other one
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, first), F.greatest(t, first))).cast("array<struct<i:int,j:int>>")
    shape = ["lang", "g", "total", "lang_total", "kept"]
    body = cells.select(*shape, "term", "n", "everywhere", deal.alias("block"), F.explode(meets).alias("m"))
    none = F.lit(None)
    head = groups.select(*shape, none.cast("string").alias("term"), none.cast("long").alias("n"), none.cast("long").alias("everywhere"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), meets.alias("m")).withColumn("m", F.explode("m"))
    tiles = body.unionByName(head).select("*", F.col("m.i").alias("ti"), F.col("m.j").alias("tj")).drop("m")
    return tiles.groupBy("lang", "block", "ti", "tj").applyInPandas(run, "lang string, a int, b int, term string, f long, seen long")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: of each source of a language its distance from every other one, and its marks.

    A term is a run of ASCII letters, in lower case, and of code points beyond ASCII; a language keeps those that min_docs
    of its rows hold. With count occurrences in a group of N kept ones, of V kept terms, a term's weight there is
    p = 1 + floor(10**9 * (count + 2) / (N + 2 V)); two weights are floor((p - q)**2 / (p + q)) apart. Part `pair` sums that
    over the kept terms, for every other source; part `term` has the `top` terms of the source that lie furthest above the
    language's own weight. Ranks go by value, largest first, ties by item in UTF-8 order.

    Null texts, languages and sources count as "". Every row is a document of its own, repeated ones too. Groups without
    kept terms have the weights of zero counts; a language without any has distances of 0 and no marks. A lone source has no
    pair. An empty table gives no row. Texts may be of any length. Other columns aren't read, whatever their names.
    """
    some = lambda c: F.coalesce(col(c), F.lit(""))
    # one shuffle by language and term serves the sum of each source, and the term's own sums
    counts = term_counts(docs, text, lang, source).repartition(F.col("lang"), F.col("term")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    kept = counts.select("lang", "source", "term", "n", F.sum("docs").over(whole).alias("docs"), F.sum("n").over(whole).alias("everywhere"))
    kept = stash(kept.where(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")
    vocabulary = kept.groupBy("lang").agg(F.count_distinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    pairs = docs.select(some(lang).alias("lang"), some(source).alias("source")).distinct()
    none = F.lit(0).cast("long")
    groups = pairs.join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g"), F.count("*").over(Window.partitionBy("lang")).alias("size"), *[F.coalesce(c, none).alias(c) for c in ("total", "kept", "lang_total")])
    wide = F.least(F.col("size"), F.lit(2 * GROUPS))
    groups = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") * wide / CELLS)).cast("int")).withColumn("tiles", F.ceil(F.col("size") / GROUPS).cast("int"))
    groups = stash(groups.drop("size"), "divergence-groups")
    found = stash(_blocks(kept.join(groups, ["lang", "source"]), groups, top), "divergence-tiles")
    unused = F.expr("1 + 2000000000 div greatest(total + 2 * kept, 1)")  # the weight of a count of 0
    name = groups.select("lang", F.col("g").alias("a"), "source")
    zero = lambda g, p: groups.select("lang", F.col("g").alias(g), unused.alias(p), "kept")
    summed = found.where(F.col("term").isNull()).groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), F.sum("seen").alias("seen"))
    # terms that neither of two tiles holds have the same distance each
    summed = summed.join(zero("a", "p"), ["lang", "a"]).join(zero("b", "q").drop("kept"), ["lang", "b"])
    summed = summed.select("lang", "a", "b", (F.col("f") + (F.col("kept") - F.col("seen")) * F.expr("(p - q) * (p - q) div (p + q)")).alias("value"))
    both = summed.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s")).select("lang", "value", "s.a", "s.b")
    other = name.select("lang", F.col("a").alias("b"), F.col("source").alias("item"))
    pair = both.join(name, ["lang", "a"]).join(other, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    mark = found.where(F.col("term").isNotNull()).join(name, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("f").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(mark).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10),
counts AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(l.total, 0) AS lang_total, coalesce(s.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l ON g.lang = l.lang
  LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL) s ON g.lang = s.lang AND g.source = s.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) AS p,
    1 + 1000000000 * (k.n + 2) // (g.lang_total + 2 * g.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN
    (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
     FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM part)
WHERE part = 'pair' OR rank <= 10
"""
