"""Search operators (Q-1 .. Q-14) over a whole table of probes at once.

A probe is (probe_id, file_id, line, col[, new_name]).  Every search is one
logical plan: point lookup (binned range join) -> name join against the index ->
scope predicates and BM25 score evaluated inside the joined row -> per-probe
top-k with ``row_number`` (planned as a partial ``WindowGroupLimit`` before the
shuffle, so a probe with a very common name ships only k rows per task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.kinds import highlight_kind, symbol_kind
from ..functions.paths import absolute_path
from ..functions.text import prefix_match
from .ranges import range_join
from .skew import BROADCAST_MAX_ROWS, broadcast_if_small, salted_join, shuffled
from .stats import ScoreStats
from ..session import PACKED, materialize, stage_path, stages, tidy
from ..sinks.index import bucket_of

DEFAULT_ROOT = "/workspace"
# A join key of the index is salted into parts of this many rows; tests lower it to
# exercise the salted path.
SALT_MIN_ROWS = 100_000
# Names of a search that are pushed to the scan of the group tables.
FEW_NAMES = 200
# Scores that are equal to this many digits are ties.
SCORE_DIGITS = 9
# Probes that meet a group of buckets of the index at once.
LOOKUP_ROWS = 1_000_000
_U = ["seq", "name", "node_type", "category", "scope_path", "class_scope", "start_col",
      "end_col", "path_parts", "user_space"]


def of_files(symbols: DataFrame, files: DataFrame, buckets: int | None) -> DataFrame:
    """The part of a bucketed index that the files (file_id) of a search can be in: only
    their buckets are read, in these only row groups in their range of ids, and of these only
    rows of the files, when the list of these is checked small."""
    if buckets is None or "bucket" not in symbols.columns:
        return symbols
    own = files.groupBy(bucket_of("file_id", buckets).alias("bucket")).agg(
        F.min("file_id").alias("low"), F.max("file_id").alias("high")).collect()  # <= buckets rows
    own = [r for r in own if r["low"] is not None]
    if not own:
        return symbols.limit(0)
    if len(own) < buckets:
        symbols = symbols.filter(F.col("bucket").isin(sorted(r["bucket"] for r in own)))
    symbols = symbols.filter(F.col("file_id").between(min(r["low"] for r in own), max(r["high"] for r in own)))
    # rows of other files go before anything is shuffled
    few, small = broadcast_if_small(files.select("file_id").distinct())
    return symbols.join(few, "file_id", "left_semi") if small else symbols


def of_names(table: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """A table cut to the names of a search, if these are few: a filter that reaches the scan."""
    few = names.select(F.col(names.columns[0]).alias("n")).distinct().limit(FEW_NAMES + 1).collect()
    return table if len(few) > FEW_NAMES else table.filter(F.col(column).isin([r["n"] for r in few]))


def point_lookup(probes: DataFrame, symbols: DataFrame, usage_only: bool, block: int = 256,
                 buckets: int | None = None) -> DataFrame:
    """Q-1 (usages only) / Q-2 (any category): the one symbol on the probe's line
    whose span covers the column, ends included (FN-5).  Ties: narrowest span,
    then start column, then emission order.  Probes without a hit are dropped.
    ``buckets``: of an index that has its ``bucket`` column."""
    # the probe table is written once and broadcast when its size is checked small; a larger
    # one meets an index with buckets by groups of buckets, each with the probes of its files,
    # and only without buckets both sides are shuffled
    probes = materialize(probes, "probes", lean=True)
    symbols = of_files(symbols, probes, buckets)
    few, small = broadcast_if_small(probes)
    if small or buckets is None or "bucket" not in symbols.columns:
        return _looked_up(few, symbols, usage_only, block)
    spark, found = probes.sparkSession, stage_path(probes.sparkSession, "looked-up")
    for low, high in _bucket_groups(probes, buckets):
        own, _ = broadcast_if_small(probes.filter(bucket_of("file_id", buckets).between(low, high)))
        with tidy(spark, always=True):
            _looked_up(own, symbols.filter(F.col("bucket").between(low, high)), usage_only, block).write.mode("append").option(
                "compression", PACKED).parquet(found)
    return spark.read.parquet(found)


def _bucket_groups(probes: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """First and last bucket of groups with about ``LOOKUP_ROWS`` probes each, or of one bucket with more."""
    counts = probes.groupBy(bucket_of("file_id", buckets).alias("b")).count().filter("b IS NOT NULL").collect()  # <= buckets rows
    groups, held = [], 0
    for b, n in sorted(map(tuple, counts)):
        if groups and held + n <= LOOKUP_ROWS:
            groups[-1], held = (groups[-1][0], b), held + n
        else:
            groups, held = groups + [(b, b)], n
    return groups


def _looked_up(probes: DataFrame, symbols: DataFrame, usage_only: bool, block: int) -> DataFrame:
    s = symbols.filter(F.col("category") == "usage") if usage_only else symbols
    s = s.select("file_id", "line", *[F.col(c).alias("u_" + c) for c in _U])
    j = range_join(probes, s, ["file_id", "line"], "col", "u_start_col", "u_end_col", block=block)
    w = Window.partitionBy("probe_id").orderBy(
        F.col("u_end_col") - F.col("u_start_col"), F.col("u_start_col"), F.col("u_seq"))
    return j.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def _clause(term: Column, required: bool, boost: float) -> Column:
    return F.struct(term.alias("term"), F.lit(required).alias("required"), F.lit(boost).alias("boost"))


def definition_clauses() -> Column:
    """Scope clauses of definition search by the usage type (exact rules)."""
    t, cs, sp = F.col("u_node_type"), F.col("u_class_scope"), F.col("u_scope_path")
    req = lambda arr, boost=1.0: F.transform(arr, lambda x: _clause(x, True, boost))
    opt = lambda arr: F.transform(arr, lambda x: _clause(x, False, 1.0))
    return (F.when(t == "Const", F.concat(req(cs), opt(sp)))
            .when(t.isin(rules.LOCAL_SCOPE_TYPES), req(sp))
            .when((t == "Send") & (F.size(cs) > 0), req(cs, rules.RECEIVER_SCOPE_BOOST))
            .otherwise(opt(sp)))


def reference_clauses() -> Column:
    t, sp = F.col("u_node_type"), F.col("u_scope_path")
    return F.when(t.isin(rules.LOCAL_SCOPE_TYPES),
                  F.transform(sp, lambda x: _clause(x, True, 1.0))) \
        .otherwise(F.transform(sp, lambda x: _clause(x, False, 1.0)))


def _weighted_clauses(u: DataFrame, clauses: Column, stats: ScoreStats) -> DataFrame:
    """Attach ``w = boost * idf(term)`` to each clause of each probe.  Only the few
    clause terms of the probes are exploded and joined to the term table."""
    c = u.select("probe_id", F.posexplode(clauses).alias("_pos", "_c"))
    terms = stats.terms.filter(F.col("field") == "scope").select(
        F.col("term").alias("_term"), F.col("idf").alias("_idf"))
    # the clause side grows with the probes, the term table with the whole index.
    # When the clause terms are checked few, the term table is first cut down by a
    # broadcast semi-join (streamed, not shuffled); the left join that keeps
    # unknown terms (weight 0, still required) then joins two small sides.
    wanted, small = broadcast_if_small(c.select(F.col("_c.term").alias("_term")).distinct())
    if small:
        terms = terms.join(wanted, "_term", "left_semi")
    c = c.join(terms, F.col("_c.term") == F.col("_term"), "left")
    w = F.col("_c.boost") * F.coalesce(F.col("_idf"), F.lit(0.0))
    return (c.groupBy("probe_id")
            .agg(F.array_sort(F.collect_list(F.struct(
                F.col("_pos").alias("pos"), F.col("_c.term").alias("term"),
                F.col("_c.required").alias("required"), w.alias("w")))).alias("clauses")))


def _allowed_types(spark: SparkSession, u: DataFrame, directions: list[str], stats: ScoreStats) -> DataFrame:
    """Adds ``allowed``: node type a candidate may have -> (multiplicity, type_idf).

    One map per probe type is built from the rule table (at most 27 rows, so the
    broadcast has a fixed bound); a type allowed by both maps counts twice.  The
    probe side stays one row per probe instead of one per allowed type."""
    tr = rules.type_rules(spark).filter(F.col("direction").isin(directions))
    tr = tr.groupBy("probe_type", "match_type").agg(F.count(F.lit(1)).alias("multiplicity"))
    types = stats.terms.filter(F.col("field") == "node_type").select(
        F.col("term").alias("match_type"), F.col("idf").alias("type_idf"))
    tr = tr.join(F.broadcast(types), "match_type", "left")
    maps = tr.groupBy("probe_type").agg(F.map_from_entries(F.collect_list(F.struct(
        "match_type", F.struct("multiplicity", "type_idf")))).alias("allowed"))
    return u.join(F.broadcast(maps), u["u_node_type"] == maps["probe_type"], "inner").drop("probe_type")


def _type_weights(df: DataFrame) -> DataFrame:
    """Keep candidates whose node type the probe allows; attach its weights."""
    a = F.col("allowed")[F.col("node_type")]
    return (df.filter(a.isNotNull())
            .withColumn("multiplicity", a["multiplicity"]).withColumn("type_idf", a["type_idf"]))


def _score(stats: ScoreStats) -> Column:
    matched = F.filter("clauses", lambda c: F.array_contains(F.col("scope_path"), c["term"]))
    scope_sum = F.aggregate(matched, F.lit(0.0), lambda acc, c: acc + c["w"])
    return (F.col("multiplicity") * F.coalesce(F.col("type_idf"), F.lit(0.0))
            + stats.length_norm(F.size("scope_path")) * scope_sum)


def _required_ok() -> Column:
    return F.forall("clauses", lambda c: (~c["required"]) | F.array_contains(F.col("scope_path"), c["term"]))


def _top_k(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("probe_id").orderBy(
        F.col("score").desc(), F.col("file_id"), F.col("line"), F.col("start_col"), F.col("seq"))
    # filter on the plain row_number (so Spark plans a WindowGroupLimit), then
    # widen it to BIGINT like SQL engines report ranks
    return (df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
            .withColumn("rank", F.col("_rn").cast("bigint")).drop("_rn"))


def _candidates(spark, probe_side: DataFrame, index: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Join the probe side to the index on ``keys`` (probe column, index column).

    The probe side is written once, and broadcast when its rows and bytes are checked to
    be few; otherwise both sides shuffle and hot index keys are salted (J-2 skew)."""
    probe_side = materialize(probe_side, "probe-side", lean=True)
    ps, small = broadcast_if_small(probe_side, BROADCAST_MAX_ROWS)
    if small:
        cond = None
        for pc, ic in keys:
            c = ps[pc] == index[ic]
            cond = c if cond is None else cond & c
        return ps.join(index, cond, "inner")
    renamed = probe_side
    for pc, ic in keys:
        renamed = renamed.withColumnRenamed(pc, ic)
    out = salted_join(index, renamed, [ic for _, ic in keys], "inner", min_rows=SALT_MIN_ROWS)
    for pc, ic in keys:
        out = out.withColumn(pc, F.col(ic))
    return out


def scope_key(col: str = "scope_path") -> Column:
    """Exact string key of a scope path (size-prefixed, so [] and [''] differ)."""
    return F.concat(F.size(col).cast("string"), F.lit(":"), F.array_join(col, "\u0001"))


GROUP_KEYS = ["name", "node_type", "scope_key"]
_TIES = ["file_id", "line", "start_col", "seq"]


def first_members(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group in tie order (a partial ``WindowGroupLimit``
    runs before the shuffle)."""
    tie = Window.partitionBy(*GROUP_KEYS).orderBy(*_TIES)
    return rows.withColumn("_m", F.row_number().over(tie)).filter(F.col("_m") <= limit).drop("_m")


def scope_groups(index: DataFrame, category: str | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """Index pre-aggregated for cross-file search: (name, node_type, scope_key) groups
    with their member count and first member, and each group's first ``limit`` members in
    tie order.  Computed once per index version and stored beside it."""
    idx = index.filter(F.col("category") == category) if category else index
    idx = idx.withColumn("scope_key", scope_key())
    groups = idx.groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("n"), F.first("scope_path").alias("scope_path"),
                                          F.min(F.struct(*_TIES)).alias("first"))
    return groups, first_members(idx.drop("scope_path"), limit)


def part_of(name: str, parts: int) -> Column:
    """Part of a table of ``group_members`` that holds the groups of a name."""
    return F.pmod(F.xxhash64(name, F.lit("part")), F.lit(parts)).cast("int")


def write_members(index: DataFrame, category: str, limit: int, path: str, parts: int) -> None:
    """``group_members`` in ``parts`` by name, one after another: a large index then has the shuffle files of
    one part on disk only.  Every file is in order of the name."""
    for part in range(parts):
        own = index if parts == 1 else index.filter(part_of("name", parts) == part)
        with tidy(index.sparkSession, always=True):
            group_members(own, category, limit).withColumn("part", F.lit(part)).write.mode("append").option(
                "compression", PACKED).partitionBy("part").parquet(path)


def group_members(index: DataFrame, category: str, limit: int) -> DataFrame:
    """``scope_groups`` as one table, from one shuffle: the first ``limit`` members of each group
    with what a hit shows of them; the first one has the group's scope path and its number of
    members, ``limit`` at most: a search for up to ``limit`` hits goes no further than that."""
    own = ["name", "node_type", "scope_path"]
    tie = Window.partitionBy(*own).orderBy(*_TIES)
    rows = (index.filter(F.col("category") == category).select(*own, *_TIES, "end_col", "path_parts", "user_space")
            .withColumn("m", F.row_number().over(tie)).filter(F.col("m") <= limit)
            .withColumn("n", F.count(F.lit(1)).over(tie.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    first = lambda c: F.when(F.col("m") == 1, F.col(c)).alias(c)
    return rows.select("name", "node_type", scope_key().alias("scope_key"), "m", first("n"), first("scope_path"),
                       *_TIES, "end_col", "path_parts", "user_space")


def groups_of(members: DataFrame) -> DataFrame:
    """The groups of a table of ``group_members``."""
    return members.filter("m = 1").select("part", *GROUP_KEYS, "n", "scope_path", F.struct(*_TIES).alias("first"))


def _probe_side(spark: SparkSession, u: DataFrame, stats: ScoreStats, clauses: Column,
                directions: list[str]) -> tuple[DataFrame, list[str]]:
    """One row per probe: name, allowed-type map and weighted clauses."""
    wc = _weighted_clauses(u, clauses, stats)
    probe_side = _allowed_types(spark, u, directions, stats).join(shuffled(wc), "probe_id", "left") \
        .withColumn("clauses", F.coalesce("clauses", F.array().cast(
            "array<struct<pos:int,term:string,required:boolean,w:double>>")))
    extra = [c for c in probe_side.columns if c.startswith("p_") and c != "p_file_id"]
    return probe_side.select(
        "probe_id", F.col("file_id").alias("p_file_id"), "u_name", "allowed", "clauses", *extra), extra


def _search_grouped(spark: SparkSession, u: DataFrame, index: DataFrame, stats: ScoreStats,
                    clauses: Column, directions: list[str], category: str | None, limit: int,
                    groups: tuple[DataFrame, DataFrame, int] | None = None) -> DataFrame:
    """Cross-file search, scored by *scope group* instead of by symbol.

    A candidate's score and its required-scope test depend only on its node type
    and scope path.  Probes are joined to the groups of ``scope_groups`` (a common
    name collapses to a handful of groups, which removes the name skew), scored
    once per group, and only groups that can still reach the top ``limit`` are
    kept: those with fewer than ``limit`` candidates scoring strictly higher.  Each
    kept group expands to its stored first ``limit`` members.  The result equals
    ranking every (probe, symbol) pair.
    """
    probe_side, extra = _probe_side(spark, u, stats, clauses, directions)
    grp, members, built, *split = groups if groups is not None else (*scope_groups(index, category, limit), limit)
    parts = split[0] if split else 1
    if limit > built:
        raise ValueError(f"the stored groups keep {built} members, fewer than the {limit} asked for")
    grp, members = of_names(grp, u.select("u_name")), of_names(members, u.select("u_name"))
    if parts == 1:
        return _grouped_hits(spark, probe_side, extra, grp, members, stats, limit)
    # part by part, so that the disk holds the shuffle files of one part only
    probe_side, found = materialize(probe_side, "probe-side", lean=True), stage_path(spark, "grouped-hits")
    for part in range(parts):
        own = probe_side.filter(part_of("u_name", parts) == part)
        with stages(spark), tidy(spark):
            _grouped_hits(spark, own, extra, grp.filter(F.col("part") == part), members.filter(F.col("part") == part), stats,
                          limit).write.mode("append").option("compression", PACKED).parquet(found)
    return spark.read.parquet(found)


def _grouped_hits(spark: SparkSession, probe_side: DataFrame, extra: list[str], grp: DataFrame, members: DataFrame,
                  stats: ScoreStats, limit: int) -> DataFrame:
    pg = _type_weights(_candidates(spark, probe_side, grp, [("u_name", "name")]))
    pg = pg.filter(_required_ok()).withColumn("score", F.round(_score(stats), SCORE_DIGITS))
    # a group behind ``limit`` others, by score and first member, has as many symbols before
    # it: each task keeps that many groups of a probe before the shuffle
    best = Window.partitionBy("probe_id").orderBy(F.col("score").desc(), "first")
    pg = pg.select("probe_id", "score", "n", "first", *extra, *GROUP_KEYS).withColumn(
        "_rn", F.row_number().over(best)).filter(F.col("_rn") <= limit).drop("_rn", "first")
    by_score = Window.partitionBy("probe_id").orderBy(F.col("score").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("probe_id", "score")
    pg = pg.withColumn("_higher", F.sum("n").over(by_score) - F.sum("n").over(same)) \
        .filter(F.col("_higher") < limit)
    pg = pg.select("probe_id", "score", *extra, *GROUP_KEYS)
    members = members.drop("m", "n", "scope_path", "part")
    pg = materialize(pg, "probe-groups", lean=True)
    # members of groups that no probe reaches go before they are shuffled
    kept, few = broadcast_if_small(pg.select(*GROUP_KEYS).distinct())
    if few:
        members = members.join(kept, GROUP_KEYS, "left_semi")
    cand = pg.join(shuffled(members), GROUP_KEYS, "inner")
    return _top_k(cand, limit)


def _search_same_file(spark: SparkSession, u: DataFrame, index: DataFrame, stats: ScoreStats,
                      clauses: Column, directions: list[str], category: str | None, limit: int,
                      buckets: int | None = None) -> DataFrame:
    """Same-file search: candidates share the probe's file, so the pairs per probe
    are bounded by the file's occurrences of one name; they are joined directly
    (the probe side is broadcast after a size check) and scored in the row."""
    probe_side, _ = _probe_side(spark, u, stats, clauses, directions)
    idx = of_files(index.filter(F.col("category") == category) if category else index, u, buckets)
    keys = [("p_file_id", "file_id"), ("u_name", "name")]
    cand = _type_weights(_candidates(spark, probe_side, idx, keys))
    cand = cand.filter(_required_ok()).withColumn("score", F.round(_score(stats), SCORE_DIGITS))
    return _top_k(cand, limit)


def find_definitions(spark: SparkSession, probes: DataFrame, index: DataFrame, stats: ScoreStats,
                     limit: int = rules.DEFINITION_LIMIT,
                     groups: tuple[DataFrame, DataFrame, int] | None = None, buckets: int | None = None) -> DataFrame:
    """Q-3: assignments with the probe's name, a compatible type and the scope rule of
    the usage type; BM25 score; top ``limit`` per probe.  ``groups`` are the stored
    ``scope_groups(index, 'assignment', limit)`` of the index version, if any, with the
    limit that they were built with, and the parts of ``write_members``; ``buckets`` as in ``point_lookup``."""
    u = point_lookup(probes, index, usage_only=True, buckets=buckets)
    # the answer depends on the symbol under the cursor only by these columns, so probes
    # that agree in them are searched once and share the hits
    same = ["u_name", "u_node_type", "u_class_scope", "u_scope_path"]
    u = materialize(u.withColumn("_lead", F.xxhash64(F.to_json(F.struct(*same)))), "lookup", lean=True)
    lead = u.groupBy("_lead", *same).agg(F.min("probe_id").alias("probe_id"))
    leads = materialize(u.join(shuffled(lead.select("probe_id")), "probe_id", "left_semi"), "lookup-leads", lean=True)
    hits = _search_grouped(spark, leads, index, stats, definition_clauses(), ["usage"], "assignment",
                           limit, groups)
    to = lead.select("_lead", *same, F.col("probe_id").alias("_of"))
    members = materialize(u.select("probe_id", "_lead", *same).join(shuffled(to), ["_lead", *same]).select("probe_id", "_of"),
                          "lookup-members", lean=True)
    return hits.withColumnRenamed("probe_id", "_of").join(shuffled(members), "_of").drop("_of")


def find_references(spark: SparkSession, probes: DataFrame, index: DataFrame, stats: ScoreStats,
                    limit: int = rules.REFERENCE_LIMIT, buckets: int | None = None) -> DataFrame:
    """Q-4: symbols of the probed file with the same name, a type allowed by either
    map (counted per map) and the scope rule; top ``limit`` per probe."""
    u = materialize(point_lookup(probes, index, usage_only=False, buckets=buckets), "lookup", lean=True)
    u = u.withColumn("p_new_name", F.col("new_name")) if "new_name" in probes.columns else u
    return _search_same_file(spark, u, index, stats, reference_clauses(), ["usage", "assignment"], None, limit, buckets)


def locations(hits: DataFrame, root: str = DEFAULT_ROOT) -> DataFrame:
    """FN-4 + FN-10: absolute path and a range on one line."""
    return hits.select("probe_id", "rank", absolute_path("path_parts", "user_space", root).alias("path"),
                       F.col("line").alias("start_line"), "start_col", F.col("line").alias("end_line"), "end_col")


def highlights(refs: DataFrame) -> DataFrame:
    """Q-5: references as ranges with READ / WRITE kind."""
    return refs.select("probe_id", "rank", "line", "start_col", "end_col",
                       highlight_kind("category").alias("kind"))


def rename_edits(refs: DataFrame, root: str = DEFAULT_ROOT) -> DataFrame:
    """Q-7 (flat): one replace edit per reference, with the probe's new name."""
    return refs.select("probe_id", "rank", absolute_path("path_parts", "user_space", root).alias("path"),
                       "line", "start_col", "end_col", F.col("p_new_name").alias("new_text"))


def rename_edits_by_file(edits: DataFrame) -> DataFrame:
    """Q-7 (grouped): edits of one probe grouped under their file (AGG-3).  A group
    holds at most the reference limit (100) edits."""
    e = F.array_sort(F.collect_list(F.struct("line", "start_col", "end_col", "new_text")))
    return (edits.groupBy("probe_id", "path")
            .agg(F.count(F.lit(1)).alias("n_edits"), e.alias("_e"))
            .select("probe_id", "path", "n_edits",
                    F.array_join(F.transform("_e", lambda x: F.concat_ws(
                        ":", x["line"].cast("string"), x["start_col"].cast("string"),
                        x["end_col"].cast("string"), x["new_text"])), ";").alias("edits")))


def workspace_symbols(index: DataFrame, stats: ScoreStats, pattern: str, root: str = DEFAULT_ROOT,
                      limit: int = rules.WORKSPACE_LIMIT) -> DataFrame:
    """Q-8 + Q-14: user-space symbols of the listed types whose name matches the
    prefix pattern; only the type term varies the score (rarer types first); top
    ``limit`` overall (``TakeOrderedAndProject``)."""
    types = stats.terms.filter(F.col("field") == "node_type").select(
        F.col("term").alias("node_type"), F.col("idf").alias("type_idf"))
    hits = (index.filter(F.col("user_space") & F.col("node_type").isin(rules.WORKSPACE_SYMBOL_TYPES)
                         & prefix_match("name", pattern))
            .join(F.broadcast(types), "node_type", "left")
            .withColumn("score", F.round(F.col("type_idf"), SCORE_DIGITS)))
    w = Window.orderBy(F.col("score").desc(), "file_id", "line", "start_col", "seq")
    top = hits.orderBy(F.col("score").desc(), "file_id", "line", "start_col", "seq").limit(limit)
    return top.withColumn("rank", F.row_number().over(w).cast("bigint")).select(
        "rank", "name", symbol_kind("node_type").alias("kind"),
        absolute_path("path_parts", F.lit(True), root).alias("path"),
        F.col("line").alias("start_line"), "start_col", F.col("line").alias("end_line"), "end_col", F.round("score", 6).alias("score"))
