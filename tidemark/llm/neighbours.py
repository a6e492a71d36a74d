"""Near-duplicate vectors by NN-descent.

A neighbour graph with lists of ``K`` starts from sorted runs of random
hyperplane codes and is refined by joins of neighbours' neighbours until few new
links appear. Lists full of links grow and never shrink, and a link once found
stays even outside the list. Links give components. Vectors whose list may lack
links are compared with all rows of other components, block by block,
and inside components the links are counted in blocks. A sample of vectors is
compared with all rows to audit recall; below ``RECALL`` the search runs again
with more tables, and in the end all rows are compared.

Equal directions are one class with a multiplicity, so copies cost nothing.
Lists, runs and blocks are bounded; no group is gathered whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_dealt, stage
from tidemark.llm.graph import components

THRESHOLD, K, MOST_K = 0.9, 10, 40
#: Sorted runs of the first graph, how many places ahead a vector is compared in each, and least rounds.
TABLES, REACH, ROUNDS = 10, 12, 3
#: Rounds go on, up to these, while the links found grow by more than this part.
MOST_ROUNDS, GROWTH = 10, 0.001
#: Members of a block when vectors are compared with all rows.
SEARCH_BLOCK = 4096
#: Vectors of the audit, the recall it asks for, and members of a block when links are counted.
AUDIT, RECALL, BLOCK = 256, 0.95, 512
#: How far below the threshold a neighbour makes a vector likely to have links.
NEAR = 0.05


def unit_vectors(batches):
    """(vec_id, embedding) -> (vec_id, unit): double bytes of length one, null where a vector links with nothing."""
    for b in batches:
        out = []
        for v in b.column(1).to_pylist():
            u = None
            if v and None not in v:
                x = np.array(v, dtype=np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top
                    u = (x / np.sqrt(x @ x) + 0.0).tobytes()
            out.append(u)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def _matrix(units: list[bytes], kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype=kind).reshape(len(units), -1)


def _best(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, keep: int):
    """Of each row of ``sims`` the ``keep`` largest entries, as edges."""
    k = min(keep, sims.shape[1])
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    s = np.take_along_axis(sims, at, 1)
    a, b = np.repeat(ids, k), others[at].ravel()
    ok = (a != b) & (s.ravel() > -2)
    return a[ok], b[ok], s.ravel()[ok]


def first_graph(nodes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(c, dim, small) -> edges (a, b, s) of vectors near each other in sorted runs of hyperplane codes."""

    def codes(frames):
        for f in frames:
            for dim, g in f.groupby("dim"):
                x = _matrix(g["small"].tolist(), np.float32)
                rng = np.random.default_rng([seed, int(dim)])
                for t in range(tables):
                    r = rng.normal(size=(int(dim), bits + 1)).astype(np.float32)
                    p = x @ r
                    code = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pd.DataFrame({"run": t, "dim": dim, "code": code, "along": p[:, bits], "c": g["c"].to_numpy(), "small": g["small"].to_numpy()})

    def runs(frames):
        ids, units, tags = [], [], []
        for f in frames:
            ids += f["c"].tolist()
            units += f["small"].tolist()
            tags += list(zip(f["run"], f["dim"]))
            at = 0
            while at < len(ids):
                end = at
                while end < len(ids) and tags[end] == tags[at] and end - at < 4096:
                    end += 1
                c, x = np.array(ids[at:end]), _matrix(units[at:end], np.float32)
                n = len(c)
                near = np.full((n, 2 * REACH), -3.0, dtype=np.float32)
                who = np.zeros((n, 2 * REACH), dtype=np.int64)
                for d in range(1, min(REACH, n - 1) + 1):
                    s = np.einsum("ij,ij->i", x[:-d], x[d:])
                    near[:-d, d - 1], who[:-d, d - 1] = s, c[d:]
                    near[d:, REACH + d - 1], who[d:, REACH + d - 1] = s, c[:-d]
                k = min(4, near.shape[1])
                best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                s = np.take_along_axis(near, best, 1).ravel()
                a, b = np.repeat(c, k), np.take_along_axis(who, best, 1).ravel()
                ok = (s > -2) & (a != b)
                yield pd.DataFrame({"a": a[ok], "b": b[ok], "s": s[ok]})
                at = end
            ids, units, tags = ids[-REACH:], units[-REACH:], tags[-REACH:]

    coded = nodes.select("c", "dim", "small").mapInPandas(codes, "run int, dim int, code long, along float, c long, small binary")
    return coded.repartitionByRange("run", "dim", "code", "along").sortWithinPartitions("run", "dim", "code", "along").mapInPandas(runs, "a long, b long, s float")


def _top(edges: DataFrame, threshold: float, width: DataFrame | None, now: int) -> DataFrame:
    """The best ``k`` neighbours of each vector (a, b, s, rank, k), and all links found; ``width`` (a, k) names those with longer lists.

    ``born`` tells in which round an edge entered its list.
    """
    one = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("born").alias("born"))
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    ranked = one.withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumn("k", F.lit(K)) if width is None else ranked.join(width, "a", "left").fillna({"k": K})
    inside = F.col("rank") <= F.col("k")
    kept = ranked.where(inside | (F.col("s") >= threshold - 1e-4))
    return kept.withColumn("born", F.when(inside, F.coalesce("born", F.lit(now))))


def _found(edges: DataFrame) -> DataFrame:
    """Edges that are in no list yet."""
    return edges.select("a", "b", "s", F.lit(None).cast("int").alias("born"))


def _local_join(batches):
    """Lists (ids, news, units) -> edges of all pairs in them but those of two old neighbours, which have met before."""
    for batch in batches:
        for ids, news, units in zip(*(batch.column(i).to_pylist() for i in range(3))):
            c, first, place = np.unique(np.array(ids), return_index=True, return_inverse=True)
            old = np.bincount(place, np.array(news, dtype=float)) == 0
            x = _matrix([units[i] for i in first], np.float32)
            s = x @ x.T
            s[np.ix_(old, old)] = -3.0
            np.fill_diagonal(s, -3.0)
            a, b, v = _best(c, c, s, 6)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(v)], names=["a", "b", "s"])


def descend(graph: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """One round: every vector compares its neighbours, and those it is a neighbour of, with each other.

    Pairs without a neighbour that is new since the last round have met before,
    so lists without one are not joined with their vectors at all.
    """
    graph = graph.where("rank <= k")
    order = Window.partitionBy("b").orderBy(F.desc("s"), "a")
    back = graph.withColumn("r", F.row_number().over(order)).where(F.col("r") <= K).select(F.col("b").alias("a"), F.col("a").alias("b"), "born")
    around = graph.select("a", "b", "born").union(back)
    lists = around.groupBy("a").agg(F.collect_set(F.struct("b", (F.col("born") == now).alias("new"))).alias("m")).where(F.exists("m", lambda m: m["new"]))
    met = lists.select("a", F.explode("m").alias("m")).select("a", "m.b", "m.new").join(nodes.select(F.col("c").alias("b"), "dim", "small"), "b")
    groups = met.groupBy("a", "dim").agg(F.collect_list("b").alias("ids"), F.collect_list("new").alias("news"), F.collect_list("small").alias("units")).where(F.size("ids") > 1)
    return groups.select("ids", "news", "units").mapInArrow(_local_join, "a long, b long, s float")


def _widths(graph: DataFrame, threshold: float) -> DataFrame:
    """Lists longer than ``K``: a list full of links is doubled, no list gets shorter."""
    lists = graph.groupBy("a").agg(F.count_if(F.col("s") >= threshold - 1e-4).alias("n"), F.max("k").alias("k"))
    grown = F.when(F.col("n") >= F.col("k"), F.least(F.lit(MOST_K), 2 * F.col("k"))).otherwise(F.col("k")).cast("int")
    return lists.select("a", grown.alias("k")).where(F.col("k") > K)


def bridges(nodes: DataFrame, comp: DataFrame, queries: DataFrame, threshold: float, block: int = SEARCH_BLOCK) -> DataFrame:
    """Links (u, v) of ``queries`` (c) with rows of other components, by comparing them with all rows.

    Each pair of blocks gives one link for each pair of components that it joins.
    """
    labelled = nodes.select("c", "unit").join(comp, "c", "left").select("c", "unit", F.coalesce("component", "c").alias("label"))
    asked = labelled.join(queries, "c", "left_semi")
    lefts, rights = (max(1, -(-x.count() // block)) for x in (queries, nodes))
    deal = lambda n: F.pmod(F.xxhash64("c"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("c", "unit", "label", F.lit(True).alias("asks"), deal(lefts).alias("l"), spread(rights).alias("r"))
    right = labelled.select("c", "unit", "label", F.lit(False).alias("asks"), spread(lefts).alias("l"), deal(rights).alias("r"))

    def compare(f):
        out = []
        for _, g in f.groupby(f["unit"].str.len()):
            a, b = g[g["asks"]], g[~g["asks"]]
            if not len(a) or not len(b):
                continue
            y, ids, labels = _matrix(b["unit"].tolist()), b["c"].to_numpy(), b["label"].to_numpy()
            for at in range(0, len(a), 512):
                part = a.iloc[at : at + 512]
                i, j = np.nonzero((_matrix(part["unit"].tolist()) @ y.T >= threshold) & (part["label"].to_numpy()[:, None] != labels))
                found = pd.DataFrame({"u": part["c"].to_numpy()[i], "v": ids[j], "lu": part["label"].to_numpy()[i], "lv": labels[j]})
                out.append(found.drop_duplicates(["lu", "lv"]))
        return pd.concat(out).drop_duplicates(["lu", "lv"])[["u", "v"]] if out else pd.DataFrame({"u": [], "v": []})

    return left.union(right).groupBy("l", "r").applyInPandas(compare, "u long, v long")


def _verify(batches):
    """(a, b, ua, ub) -> (a, b, cos) in double precision."""
    for b in batches:
        if b.num_rows:
            cos = [float(np.frombuffer(p) @ np.frombuffer(q)) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cos)], names=["u", "v", "cos"])


def count_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(component, c, unit, m) -> (c, links): rows at the threshold in the same component, itself not counted.

    Components are split into blocks by hash; each pair of blocks is one task
    row group of bounded size, and only counts leave it.
    """
    size = stage(members.groupBy("component").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")))
    put = join_dealt(members, size, ["component"], "c").withColumn("mine", F.pmod(F.xxhash64("c", F.lit(1)), F.col("blocks")).cast("int"))
    pairs = put.select("component", "c", "unit", "m", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "component", "c", "unit", "m", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine"
    )

    def count(key, f):
        lo, hi = key[1], key[2]
        dims = f["unit"].str.len()
        out = []
        for _, g in f.groupby(dims):
            left = g if lo == hi else g[g["mine"] == lo]
            right = g if lo == hi else g[g["mine"] == hi]
            if len(left) and len(right):
                near = _matrix(left["unit"].tolist()) @ _matrix(right["unit"].tolist()).T >= threshold
                out.append(pd.DataFrame({"c": left["c"].to_numpy(), "links": near @ right["m"].to_numpy()}))
                if lo != hi:
                    out.append(pd.DataFrame({"c": right["c"].to_numpy(), "links": near.T @ left["m"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"c": [], "links": []})

    parts = pairs.groupBy("component", "lo", "hi").applyInPandas(count, "c long, links long")
    return parts.groupBy("c").agg(F.sum("links").alias("links"))


def _true_links(nodes: DataFrame, sample: list, threshold: float) -> DataFrame:
    """(sample's c, true links): the bounded sample against all rows, in blocks."""
    ids = np.array([r["c"] for r in sample])
    by_dim = {d: (ids[[len(r["unit"]) == d for r in sample]], _matrix([r["unit"] for r in sample if len(r["unit"]) == d])) for d in {len(r["unit"]) for r in sample}}

    def run(frames):
        total = dict.fromkeys(ids.tolist(), 0)
        for f in frames:
            for d, g in f.groupby(f["unit"].str.len()):
                if d in by_dim:
                    near = (by_dim[d][1] @ _matrix(g["unit"].tolist()).T >= threshold) @ g["m"].to_numpy()
                    for c, n in zip(by_dim[d][0].tolist(), near.tolist()):
                        total[c] += n
        yield pd.DataFrame({"c": list(total), "truth": list(total.values())})

    return nodes.select("unit", "m").mapInPandas(run, "c long, truth long").groupBy("c").agg(F.sum("truth").alias("truth"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, seed: int = 7) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding; other columns are ignored):
    vec_id, n_links (other rows at the threshold), component_id (smallest
    vec_id reachable), kept (vec_id = component_id) and audit_recall (the least
    of the audits; null if none of the audited vectors has a link).

    Vectors that are null, empty or zero, or hold null or non-finite components,
    link with nothing, nor do vectors of different lengths with each other.
    Repeated rows and copies link with each other. Rows with a null vec_id link
    like any other but never name a component; alone they have none. An empty
    table gives an empty one.
    """
    spark = vectors.sparkSession
    units = stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(unit_vectors, "vec_id long, unit binary"))
    rows = units.withColumn("c", F.xxhash64("unit")).withColumn("check", F.crc32("unit"))

    def narrow(batches):
        for b in batches:
            small = [np.frombuffer(u).astype(np.float32).tobytes() for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(small, pa.binary())], names=["c", "unit", "dim", "m", "low", "small"])

    nodes = stage(
        rows.where("unit is not null")
        .groupBy("c")
        .agg(
            F.when(F.min("check") == F.max("check"), F.first("unit")).otherwise(F.raise_error(F.lit("two vectors share a 64-bit hash"))).alias("unit"),
            F.count("*").alias("m"),
            F.min("vec_id").alias("low"),
        )
        .select("c", "unit", (F.length("unit") / 8).cast("int").alias("dim"), "m", "low")
        .mapInArrow(narrow, "c long, unit binary, dim int, m long, low long, small binary")
    )
    n = nodes.count()
    bits = int(min(40, max(1, np.ceil(np.log2(max(2, n) / 8)))))
    spread = nodes.orderBy(F.xxhash64("c", F.lit(seed))).limit(AUDIT).select("c", "unit").collect()
    truth_of_spread = stage(_true_links(nodes, spread, threshold))

    def settled(links, graph):
        comp = stage(components(links).withColumnRenamed("id", "c"))
        counted = stage(count_links(comp.join(nodes.select("c", "unit", "m"), "c"), threshold))
        # Few vectors have links, so the audit also takes some that have a near one.
        near = graph.where(F.col("s") >= threshold - NEAR).select(F.col("a").alias("c")).distinct()
        likely = near.join(nodes, "c").orderBy(F.xxhash64("c", F.lit(seed))).limit(AUDIT).select("c", "unit").collect()
        recalls = []
        for truth in (truth_of_spread, _true_links(nodes, likely, threshold)):
            each = truth.join(counted, "c", "left").join(nodes.select("c", "m"), "c").select((F.col("truth") - 1).alias("t"), (F.coalesce("links", "m") - 1).alias("f"))
            got = each.agg(F.sum("t").alias("t"), F.sum("f").alias("f"), F.avg(F.try_divide("f", "t")).alias("each")).first()
            # A large component must not hide vectors of small ones: recall is asked of links and of vectors.
            recalls += [got["f"] / got["t"], got["each"]] if got["t"] else []
        return comp, counted, min(recalls, default=None), min(recalls, default=1.0) >= RECALL

    graph, now = None, 0
    for attempt in range(3):
        new = _found(first_graph(nodes, bits, TABLES << attempt, seed + attempt))
        wide = None if graph is None else _widths(graph, threshold)
        graph = stage(_top(new if graph is None else new.union(graph.select("a", "b", "s", "born")), threshold, wide, now))
        before = 0
        for i in range(MOST_ROUNDS):
            met = _found(descend(graph, nodes, now))
            now += 1
            graph = stage(_top(met.union(graph.select("a", "b", "s", "born")), threshold, _widths(graph, threshold), now))
            found = graph.where(F.col("s") >= threshold - 1e-4).count()
            if i + 1 >= ROUNDS and found - before <= GROWTH * found:
                break
            before = found
        now += 1
        close = graph.where(F.col("s") >= threshold - 1e-4).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        one, two = nodes.select(F.col("c").alias("u"), F.col("unit").alias("pu")), nodes.select(F.col("c").alias("v"), F.col("unit").alias("pv"))
        links = stage(close.join(one, "u").join(two, "v").select("u", "v", "pu", "pv").mapInArrow(_verify, "u long, v long, cos double").where(F.col("cos") >= threshold).select("u", "v"))
        comp, counted, recall, enough = settled(links, graph)
        # Lists without an entry below the threshold, and those that lack links counted in the component, are searched whole.
        ends = links.union(links.select("v", "u")).toDF("c", "o")
        have = ends.join(nodes.select(F.col("c").alias("o"), "m"), "o").groupBy("c").agg(F.sum("m").alias("have"))
        lack = counted.join(have, "c").join(nodes.select("c", "m"), "c").where(F.col("links") - F.col("m") > F.col("have")).select("c")
        full = graph.groupBy(F.col("a").alias("c")).agg(F.min("s").alias("low")).where(F.col("low") >= threshold - 1e-4).select("c")
        queries = stage(full.union(lack).distinct())
        if not queries.isEmpty():
            more = stage(bridges(nodes, comp, queries, threshold))
            if not more.isEmpty():
                comp, counted, recall, enough = settled(links.union(more), graph)
        if enough:
            break
    else:
        comp, counted, recall, _ = settled(links.union(bridges(nodes, comp, nodes.select("c"), threshold)), graph)

    named = nodes.select("c", "m", "low").join(comp, "c", "left").withColumn("root", F.coalesce("component", "c"))
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"))
    result = named.join(ids, "root").join(counted, "c", "left").select("c", (F.coalesce("links", "m") - 1).alias("n_links"), "component_id")
    linked = rows.where("unit is not null").select("vec_id", "c").join(result, "c").select("vec_id", "n_links", "component_id")
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall).cast("double").alias("audit_recall")
    )
