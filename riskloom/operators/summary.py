"""Counts over findings, and clusters of similar matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.functions import severity
from riskloom.functions.durable import durable
from riskloom.functions.ranking import top_n


def summary_by(findings: DataFrame, keys: list[str] = ("severity", "category", "confidence_band", "source", "vuln_type")) -> DataFrame:
    """(project, dimension, value, n) for every key at once with grouping sets."""
    conf = F.coalesce("confidence", F.lit(0.7)) if "confidence" in findings.columns else F.lit(0.7)
    df = findings.withColumn("confidence_band", F.when(conf >= 0.8, "high").when(conf >= 0.5, "medium").otherwise("low"))
    keys = [k for k in keys if k in df.columns]
    df = df.select("project", *[F.coalesce(F.col(k).cast("string"), F.lit("other")).alias(k) for k in keys])
    sets = df.groupingSets([[F.col("project"), F.col(k)] for k in keys], "project", *keys).agg(
        F.count("*").alias("n"), *[F.grouping(k).alias(f"_{k}") for k in keys])
    dim = F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in keys])
    return sets.select("project", dim.alias("dimension"), F.coalesce(*keys).alias("value"), "n")


def project_summary(files: DataFrame, findings: DataFrame, approximate: bool = False) -> DataFrame:
    """Per project: files, files with findings, and findings by severity. `approximate` counts files by sketch."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    f = files.groupBy("project").agg(F.count("*").alias("total_files"))
    g = findings.groupBy("project").agg(distinct("file").alias("files_with_findings"), F.count("*").alias("total_findings"), *[
        F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("critical", "high", "medium", "low")])
    return f.join(g, "project", "left").na.fill(0)


def rule_fp_rate(verdicts: DataFrame) -> DataFrame:
    """verdicts(rule_id, is_fp) to the share of false positives per rule."""
    return verdicts.groupBy("rule_id").agg(F.count("*").alias("total"), F.count(F.when(F.col("is_fp"), 1)).alias("false_positives"),
                                           F.avg(F.col("is_fp").cast("double")).alias("fp_rate"))


#: A segment that more texts of a rule share is hot and is not met on; spare segments a text may be cut into for that; texts of a rule
#: in one block of the greedy run; texts without a choice of segments that the join may still carry.
HOT, SPARE, BLOCK_TEXTS, MOST_HOT_TEXTS = 64, (0, 1, 2, 3, 4, 6, 8), 64, 1_024


def _segments(texts_: DataFrame, threshold: float) -> DataFrame:
    """(rule_id, text, n, k, spare, at, seg): every text cut into k + 1 + spare equal segments, for each number of spare segments it is long
    enough for; k edits are allowed to a text of its length that is the shorter of a pair."""
    n = F.length("text")
    t = texts_.select("rule_id", "text").where(n > 0).distinct().withColumn("n", n)
    t = t.withColumn("k", F.floor(F.col("n") * F.lit(1.0 / threshold - 1.0) + F.lit(1e-9)).cast("int"))
    cuts = t.withColumn("spare", F.explode(F.array(*map(F.lit, SPARE)))).withColumn("m", F.col("k") + 1 + F.col("spare"))
    cuts = cuts.where((F.col("spare") == 0) | (2 * F.col("m") <= F.col("n"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    start = F.floor(F.col("i") * F.col("n") / F.col("m")).cast("int")
    stop = F.floor((F.col("i") + 1) * F.col("n") / F.col("m")).cast("int")
    return cuts.select("rule_id", "text", "n", "k", "spare", start.alias("at"), F.substring("text", start + 1, stop - start).alias("seg"))


def segment_index(texts_: DataFrame, threshold: float, hot: int = HOT) -> DataFrame:
    """(rule_id, r, rn, rk, at, seg, rare): the segments on which a text is met by longer ones.

    With `spare` more segments than the edits can touch, `spare` + 1 stay whole, so up to `spare` hot segments can be left out: one that is
    rare stays whole. Each text takes the least number of spare segments that outdoes its hot ones. A text of which no cut does
    keeps all segments (`rare` is false).
    """
    segs = _segments(texts_, threshold)
    common = segs.groupBy("rule_id", "spare", "seg").agg(F.count("*").alias("_df")).where(F.col("_df") > hot).select("rule_id", "spare", "seg", F.lit(1).alias("_hot"))
    marked = segs.join(common, ["rule_id", "spare", "seg"], "left")
    listed = F.collect_list(F.when(F.col("_hot").isNull(), F.struct("at", "seg")))
    every = F.collect_list(F.when(F.col("spare") == 0, F.struct("at", "seg")))
    cuts = marked.groupBy("rule_id", "text", "n", "k", "spare").agg(F.count("_hot").alias("_n"), listed.alias("rare"), every.alias("all"))
    fits = F.col("_n") <= F.col("spare")
    best = cuts.groupBy("rule_id", "text", "n", "k").agg(F.min_by(F.when(fits, F.col("rare")), F.when(fits, F.col("spare"))).alias("rare"), F.max_by("all", -F.col("spare")).alias("all"))
    took = best.select("rule_id", F.col("text").alias("r"), F.col("n").alias("rn"), F.col("k").alias("rk"), F.col("rare").isNotNull().alias("rare"), F.explode(F.coalesce("rare", "all")).alias("s"))
    return took.select("rule_id", "r", "rn", "rk", "s.at", "s.seg", "rare")


def candidate_pairs(texts_: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """(rule_id, r, s, sn): texts that hold a segment of a text that is not longer, at nearly the same place."""
    t = texts_.select("rule_id", "text").where(F.length("text") > 0).distinct().withColumn("n", F.length("text"))
    sizes = index.select(F.length("seg").alias("size")).distinct()
    # segment sizes are a handful of small numbers; probing texts emit their pieces of just those sizes
    grams = t.join(F.broadcast(sizes), F.col("size") <= F.col("n")).select("rule_id", F.col("text").alias("s"), F.col("n").alias("sn"), "size", F.explode(
        F.sequence(F.lit(0), F.col("n") - F.col("size"))).alias("pos"))
    pieces = grams.select("rule_id", "s", "sn", "pos", F.substring("s", F.col("pos") + 1, F.col("size")).alias("seg"))
    return pieces.join(index, ["rule_id", "seg"]).where(
        (F.col("sn") >= F.col("rn")) & (F.col("rn") >= F.ceil(F.col("sn") * threshold - 1e-9)) & (F.abs(F.col("pos") - F.col("at")) <= F.col("rk"))
        & (F.col("r") != F.col("s"))).select("rule_id", "r", "s", "sn").distinct()


def _alike(a: str, b: str, threshold: float) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.lit(1.0) - F.levenshtein(a, b) / longest >= threshold - 1e-12


def similar_pairs(texts_: DataFrame, threshold: float = 0.8, hot: int = HOT, index: DataFrame | None = None) -> DataFrame:
    """Pairs (rule_id, a, b) of distinct texts with edit similarity of at least `threshold`.

    The shorter text r of a similar pair is within k <= (1/threshold - 1) * len(r) edits, so of k + 1 + x segments of r at least x + 1 occur
    unchanged in the longer text, shifted by at most k. Texts meet on such a segment (equi-join), but never on one that more
    than `hot` texts of the rule share; then length, shift and edit distance decide. Nothing is compared all to all.
    """
    index = segment_index(texts_, threshold, hot) if index is None else index
    ok = candidate_pairs(texts_, index, threshold).where(_alike("r", "s", threshold))
    return ok.select("rule_id", F.col("r").alias("a"), F.col("s").alias("b")).union(ok.select("rule_id", "s", "r")).distinct()


def _first_block(free: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """One step of the greedy run: the first texts of each rule as a block. ((rule_id, text, leader) of all that are settled now, the rest).

    The block is settled within itself (at most 64 texts a rule); its leaders, a bounded number for each rule, then take what is
    similar to them. Pairs among the taken are never listed, so a family of similar texts of any size costs one pass."""
    block = durable(top_n(free, BLOCK_TEXTS, ["ord", "text"], by=["rule_id"]).select("rule_id", "text", "ord"))
    other = block.select("rule_id", F.col("text").alias("b"), F.col("ord").alias("ob"))
    met = block.withColumnRenamed("text", "a").join(other, "rule_id").where((F.struct("ord", "a") > F.struct("ob", "b")) & _alike("a", "b", threshold))
    near = met.groupBy("rule_id", F.col("a").alias("text")).agg(F.sort_array(F.collect_list(F.struct(F.col("ob").alias("o"), F.col("b").alias("t")))).alias("near"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        leads, out = set(), []
        for row in pdf.sort_values("at").itertuples(index=False):
            first = next((t["t"] for t in ([] if row.near is None else row.near) if t["t"] in leads), row.text)
            if first == row.text:
                leads.add(row.text)
            out.append((row.rule_id, row.text, first))
        return pd.DataFrame(out, columns=["rule_id", "text", "leader"])

    place = W.partitionBy("rule_id").orderBy("ord", "text")
    placed = block.withColumn("at", F.row_number().over(place)).join(near, ["rule_id", "text"], "left").select("rule_id", "text", "at", F.transform("near", lambda x: F.struct(x["t"].alias("t"))).alias("near"))
    kind = block.schema["rule_id"].dataType.simpleString()
    done = durable(placed.groupBy("rule_id").applyInPandas(settle, f"rule_id {kind}, text string, leader string"))
    leaders = block.join(done.where("text = leader").select("rule_id", "text"), ["rule_id", "text"]).select("rule_id", F.col("text").alias("l"), F.col("ord").alias("lo"))
    rest = free.join(done.select("rule_id", "text"), ["rule_id", "text"], "left_anti")
    taken = rest.select("rule_id", "text").join(F.broadcast(leaders), "rule_id").where(_alike("text", "l", threshold)).groupBy("rule_id", "text").agg(F.min_by("l", F.struct("lo", "l")).alias("leader"))
    taken = durable(taken)
    return done.unionByName(taken), durable(rest.join(taken, ["rule_id", "text"], "left_anti"))


def cluster_similar(findings: DataFrame, threshold: float = 0.8, order: list[str] = ("file", "line"), hot: int = HOT,
                    most_hot: int = MOST_HOT_TEXTS) -> DataFrame:
    """Greedy clusters per rule: (rule_id, text, leader, rows).

    In order, the first free text leads and takes every later similar one that is still free. That is
    the first maximal independent set of the similarity graph in this order, found in rounds: a text
    whose earlier neighbours are all taken leads, a text next to an earlier leader is taken. In the end
    each taken text goes to its first leader. Equal texts are one node, so a text that fills a third of
    the data is a single row here. Rounds are checkpointed.

    While many texts share all of their segments and the first of them take many others (families of similar texts), the run goes
    block by block instead, which lists no pairs; the result is the same. Null matches count as empty; empty texts are similar to nothing.
    """
    nodes = findings.select("rule_id", F.coalesce("match", F.lit("")).alias("text"), *order).groupBy("rule_id", "text").agg(
        F.min(F.struct(*order)).alias("ord"), F.count("*").alias("rows"))
    whole = nodes = durable(nodes)
    settled = None
    while True:
        index = durable(segment_index(nodes, threshold, hot))
        if index.where("NOT rare").select("rule_id", "r").distinct().count() <= most_hot:
            break
        done, rest = _first_block(nodes, threshold)
        settled = done if settled is None else settled.unionByName(done)
        nodes, index = rest, None
        if done.count() < 2 * done.where("leader = text").count():  # no large family leads any more
            break
    index = durable(segment_index(nodes, threshold, hot)) if index is None else index
    pairs = similar_pairs(nodes, threshold, hot, index)
    o = nodes.select("rule_id", "text", F.struct("ord", "text").alias("o"))
    # links to earlier texts only
    edges = (pairs.join(o.select("rule_id", F.col("text").alias("a"), F.col("o").alias("oa")), ["rule_id", "a"])
             .join(o.select("rule_id", F.col("text").alias("b"), F.col("o").alias("ob")), ["rule_id", "b"]).where(F.col("ob") < F.col("oa")))
    edges = durable(edges.select("rule_id", "a", "b", "ob"))
    state = nodes.select("rule_id", "text", F.lit(None).cast("boolean").alias("leads"))
    while True:
        known = state.select("rule_id", F.col("text").alias("b"), F.col("leads").alias("bl"))
        seen = edges.join(known, ["rule_id", "b"]).groupBy("rule_id", F.col("a").alias("text")).agg(
            F.bool_or(F.col("bl").isNull()).alias("waits"), F.bool_or(F.coalesce("bl", F.lit(False))).alias("taken"))
        nxt = state.join(seen, ["rule_id", "text"], "left")
        leads = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("taken", F.lit(False)), False).when(
            ~F.coalesce("waits", F.lit(False)), True)
        state = durable(nxt.select("rule_id", "text", leads.alias("leads")))
        if state.where(F.col("leads").isNull()).limit(1).count() == 0:
            break
    lead = state.where("leads").select("rule_id", F.col("text").alias("b"))
    first = edges.join(lead, ["rule_id", "b"]).groupBy("rule_id", F.col("a").alias("text")).agg(F.min_by("b", "ob").alias("near"))
    out = nodes.join(state, ["rule_id", "text"]).join(first, ["rule_id", "text"], "left")
    out = out.select("rule_id", "text", F.when(F.col("leads"), F.col("text")).otherwise(F.col("near")).alias("leader"), "rows")
    return out if settled is None else out.unionByName(settled.join(whole.select("rule_id", "text", "rows"), ["rule_id", "text"]).select("rule_id", "text", "leader", "rows"))


def similar_clusters(findings: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Clusters of more than one finding: leader, size. Empty matches are similar to nothing."""
    c = cluster_similar(findings.where(F.coalesce("match", F.lit("")) != ""), threshold)
    return c.groupBy("rule_id", "leader").agg(F.sum("rows").alias("members"), F.count("*").alias("texts")).where(F.col("members") > 1)
