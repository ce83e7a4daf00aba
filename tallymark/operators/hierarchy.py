"""Category trees, dependency graphs, name matching, upserts and snapshots.

Paths of a tree double in every round; a graph is walked layer by layer. A round
is one equi join whose result is written to the checkpoint folder, so that plans
stay flat and a lost executor costs one round, not the walk.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.joins import dimension, look_up_in
from tallymark.operators.shape import row_digests, rows_from
from tallymark.operators.windows import first_per_key
from tallymark.session import cut_lineage, stored

# --- trees -----------------------------------------------------------------


def category_tree(categories: DataFrame, approved_only: bool = False, separator: str = " > ") -> DataFrame:
    """Level, path of names and path of ids of every category reachable from a root.

    Paths grow upwards and double in a round: every open path is put behind the
    path of the node above its top, so a tree of depth d takes about log2(d)
    rounds, each one equi join and one stored table.

    A node never occurs twice on its own path, so cyclic parents end instead
    of looping; nodes inside a cycle have no root and are left out.
    """
    rows = categories.where(F.col("approved")) if approved_only else categories
    started = stored(
        rows.select(
            "id",
            "parent_id",
            "type",
            "name",
            F.col("parent_id").alias("above"),
            F.col("name").alias("path"),
            F.array("id").alias("path_ids"),
        )
    )
    complete, growing = [started.where("above IS NULL")], started.where("above IS NOT NULL")
    while not growing.isEmpty():
        upper = reduce(DataFrame.union, [*complete, growing]).select(
            F.col("id").alias("__id"), F.col("above").alias("__above"), F.col("path").alias("__path"), F.col("path_ids").alias("__ids")
        )
        grown = stored(
            growing.join(upper, F.col("above") == F.col("__id"))
            .where(~F.arrays_overlap("path_ids", "__ids"))
            .select(
                "id",
                "parent_id",
                "type",
                "name",
                F.col("__above").alias("above"),
                F.concat("__path", F.lit(separator), "path").alias("path"),
                F.concat("__ids", "path_ids").alias("path_ids"),
            )
        )
        complete.append(grown.where("above IS NULL"))
        growing = grown.where("above IS NOT NULL")
    return reduce(DataFrame.union, complete).select(
        "id", "parent_id", "type", "name", F.size("path_ids").alias("level"), "path", "path_ids"
    )


def tree_search(tree: DataFrame, text: str) -> DataFrame:
    """Nodes to show for a search: matches and their ancestors; a match without matches below it shows its whole subtree."""
    hits = tree.where(F.lower("name").contains(text.lower()))
    above = hits.select(F.explode("path_ids").alias("id")).distinct()
    strictly_above = hits.select(
        F.explode(F.slice("path_ids", F.lit(1), F.size("path_ids") - 1)).alias("id")
    ).distinct()
    lowest = hits.select("id").join(strictly_above, "id", "left_anti")
    below = (
        tree.select(F.col("id").alias("node"), F.explode("path_ids").alias("id"))
        .join(lowest, "id", "left_semi")
        .select(F.col("node").alias("id"))
    )
    return tree.join(above.union(below).distinct(), "id", "left_semi")


def job_counts_by_level(jobs: DataFrame, levels: Sequence[str], defaults: Sequence[str]) -> DataFrame:
    """Jobs per prefix of the level columns; ``depth`` tells how many levels a row keeps."""
    named = jobs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(d)).alias(c) for c, d in zip(levels, defaults)])
    counted = named.rollup(*levels).agg(
        F.count(F.lit(1)).alias("jobs"),
        *[F.grouping(c).alias(f"__g{i}") for i, c in enumerate(levels)],
    )
    rolled = reduce(lambda a, b: a + b, [F.col(f"__g{i}").cast("int") for i in range(len(levels))])
    return counted.select(*levels, "jobs", (F.lit(len(levels)) - rolled).alias("depth"))


def with_category_names(jobs: DataFrame, categories: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Name of each category id column: (id column, result column); the dimension is prepared once for all of them."""
    names, named = stored(dimension(categories, "id", ["name"])), jobs
    for id_column, result in columns:
        named = look_up_in(named, names, id_column, {"name": result})
    return named


# --- dependency graph ------------------------------------------------------


def execution_layers(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """Topological layer of each job, from 0. Jobs that never become free (cycles, unknown dependencies) share the last layer.

    Dependencies are counted once per job, and each edge carries the number of
    its job, so that no round joins the table of these numbers, which would be
    sent to the driver and back in every round. A round follows only the edges of
    the jobs that just became free, and writes these counts and no others.
    """
    names = jobs.select("job_id").distinct()
    known = stored(
        edges.select("job_id", "depends_on").where("depends_on is not null").distinct().join(names, "job_id", "left_semi")
    )
    total = known.groupBy("job_id").agg(F.count(F.lit(1)).alias("needed"))
    links = stored(known.join(total, "job_id"))
    frontier = stored(names.join(links, "job_id", "left_anti"))
    partly: DataFrame | None = None
    layers: list[DataFrame] = []
    while not frontier.isEmpty():
        layers.append(frontier.withColumn("layer", F.lit(len(layers))))
        freed = frontier.select(F.col("job_id").alias("depends_on"))
        met = links.join(freed, "depends_on").groupBy("job_id", "needed").agg(F.count(F.lit(1)).alias("met"))
        if partly is not None:
            met = partly.union(met).groupBy("job_id", "needed").agg(F.sum("met").alias("met"))
        state = stored(met.withColumn("free", F.col("met") == F.col("needed")))
        frontier, partly = state.where("free").select("job_id"), state.where("NOT free").select("job_id", "needed", "met")
    if not layers:
        return names.withColumn("layer", F.lit(0))
    placed = reduce(DataFrame.union, layers)
    rest = names.join(placed.select("job_id"), "job_id", "left_anti").withColumn("layer", F.lit(len(layers)))
    return placed.union(rest)


def blocked_jobs(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """Per job the number of dependencies, how many are completed, and whether it is blocked."""
    state = jobs.select(F.col("job_id").alias("depends_on"), F.col("status").alias("__status"))
    counted = (
        edges.select("job_id", "depends_on")
        .distinct()
        .join(state, "depends_on", "left")
        .groupBy("job_id")
        .agg(
            F.count(F.lit(1)).alias("dependencies"),
            F.count_if(F.col("__status") == "completed").alias("completed_dependencies"),
        )
    )
    none = F.lit(0).cast("long")
    return jobs.join(counted, "job_id", "left").select(
        "job_id",
        "status",
        F.coalesce("dependencies", none).alias("dependencies"),
        F.coalesce("completed_dependencies", none).alias("completed_dependencies"),
        (F.coalesce("dependencies", none) > F.coalesce("completed_dependencies", none)).alias("blocked"),
    )


# --- names -----------------------------------------------------------------

# Names that stand for "no category".
NO_NAMES = ("", "unknown", "n/a", "none")


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of so many characters, found in one walk over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


_GRAM = 3


def _contained(short: DataFrame, needle: str, long: DataFrame, text: str, shortest: int) -> DataFrame:
    """``type``, needle and text of all pairs in which the needle, of at least so many characters, lies in the text.

    The grams of the texts are an inverted index. A needle is looked up by its
    rarest gram alone, and what that yields is verified; needles shorter than a
    gram are grams of their own length.
    """
    found = []
    for size in range(min(shortest, _GRAM), _GRAM + 1):
        wanted = F.length(needle) >= shortest
        wanted = wanted & (F.length(needle) >= size if size == _GRAM else F.length(needle) == size)
        index = long.select("type", text, F.explode(_grams(F.col(text), size)).alias("gram"))
        often = index.groupBy("type", "gram").agg(F.count(F.lit(1)).alias("n"))
        rarest = (
            short.where(wanted)
            .select("type", needle, F.explode(_grams(F.col(needle), size)).alias("gram"))
            .join(often, ["type", "gram"], "left")
            .groupBy("type", needle)
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
            .where("g.n > 0")
            .select("type", needle, F.col("g.gram").alias("gram"))
        )
        found.append(index.join(rarest, ["type", "gram"]).where(F.col(text).contains(F.col(needle))).select("type", needle, text))
    return reduce(DataFrame.union, found)


def match_categories(names: DataFrame, categories: DataFrame) -> DataFrame:
    """Best category per (type, name): equal first, then the longest that contains the name or is contained
    in it, then the smaller name; names shorter than three letters only match when equal.

    Containment is found through an index of three-letter grams (``_contained``),
    so the work is linear in the length of a name. Names are reduced to distinct
    ones, and categories of one spelling to the first identifier, before they
    meet; the best of a name's matches is chosen in the tasks that find them.
    """
    wanted = (
        names.select("type", F.lower(F.trim("name")).alias("wanted"))
        .where(~F.col("wanted").isin(*NO_NAMES))
        .distinct()
    )
    known = (
        categories.select("type", F.lower("name").alias("known"), F.struct(F.col("id").alias("category_id"), F.col("name").alias("category")).alias("c"))
        .groupBy("type", "known")
        .agg(F.min("c").alias("c"))
    )
    spelled = known.select("type", "known")
    in_name = _contained(spelled, "known", wanted, "wanted", 1).where((F.length("wanted") >= 3) | (F.col("known") == F.col("wanted")))
    in_category = _contained(wanted, "wanted", spelled, "known", 3)
    pairs = in_name.select("type", "wanted", "known").union(in_category.select("type", "wanted", "known"))
    best = pairs.groupBy("type", "wanted").agg(
        F.min(F.struct((F.col("known") != F.col("wanted")).alias("inexact"), (-F.length("known")).alias("shorter"), "known")).alias("b")
    )
    chosen = best.select("type", "wanted", F.col("b.inexact").alias("inexact"), F.col("b.known").alias("known")).join(known, ["type", "known"])
    return wanted.join(chosen, ["type", "wanted"], "left").select(
        "type",
        F.col("wanted").alias("name"),
        F.col("c.category_id").alias("category_id"),
        F.col("c.category").alias("category"),
        (~F.col("inexact")).alias("exact"),
    )


def suggestions(proposals: DataFrame) -> DataFrame:
    """Distinct proposing jobs and first and last time per (type, name in lower case).

    The jobs themselves stay rows (see ``suggesting_jobs``): a popular name
    would otherwise gather its jobs in one array.
    """
    per_job = (
        proposals.groupBy("type", F.lower("name").alias("name"), "job_path")
        .agg(F.min("suggested_at").alias("first"), F.max("suggested_at").alias("last"))
    )
    return per_job.groupBy("type", "name").agg(
        F.count("job_path").alias("occurrence_count"),
        F.min("first").alias("first_suggested_at"),
        F.max("last").alias("last_suggested_at"),
    )


def suggesting_jobs(proposals: DataFrame) -> DataFrame:
    return proposals.select("type", F.lower("name").alias("name"), "job_path").distinct()


def pending_suggestions(table: DataFrame, n: int = 50, kind: str | None = None) -> DataFrame:
    rows = table.where(F.col("status") == "pending")
    if kind is not None:
        rows = rows.where(F.col("type") == kind)
    return rows.orderBy(F.desc("occurrence_count"), F.desc("last_suggested_at"), "type", "name").limit(n)


def review(table: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions after a review: decisions hold ``id, decision (approved|rejected), reviewed_by, reviewed_at``.

    Only pending suggestions change.
    """
    chosen = first_per_key(
        decisions.select("id", "reviewed_at", "decision", "reviewed_by"), ["id"], ["reviewed_at"], descending=True
    ).withColumnsRenamed({"reviewed_at": "__at", "decision": "__decision", "reviewed_by": "__by"})
    taken = (F.col("status") == "pending") & F.col("__decision").isNotNull()
    return (
        table.drop("reviewed_by", "reviewed_at")
        .join(chosen, "id", "left")
        .withColumns(
            {
                "reviewed_by": F.when(taken, F.col("__by")),
                "reviewed_at": F.when(taken, F.col("__at")),
                "status": F.when(taken, F.col("__decision")).otherwise(F.col("status")),
            }
        )
        .drop("__at", "__decision", "__by")
    )


def categories_after(categories: DataFrame, reviewed: DataFrame, id_offset: int) -> DataFrame:
    """Categories plus one for every approved suggestion that does not exist yet under its type and name."""
    known = categories.select("type", F.lower("name").alias("__name")).distinct()
    fresh = (
        reviewed.where(F.col("status") == "approved")
        .withColumn("__name", F.lower("name"))
        .join(known, ["type", "__name"], "left_anti")
    )
    return categories.select("id", "parent_id", "type", "name").unionByName(
        fresh.select(
            (F.col("id") + F.lit(id_offset)).alias("id"), F.lit(None).cast("long").alias("parent_id"), "type", "name"
        )
    )


# --- upserts and snapshots -------------------------------------------------


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Current rows with the changes applied: per key the row with the greatest ``order``; changes win ties."""
    marked = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return first_per_key(marked, keys, [order, "__new"], descending=True).drop("__new")


def merge_into(target: str, changes: DataFrame, keys: Sequence[str]) -> None:
    """The same for a table whose format supports MERGE. ``changes`` has one row per key."""
    condition = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    changes.alias("s").mergeInto(f"{target} AS t", condition).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def change_history(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Added, removed and changed keys of two snapshots, one row per changed column with old and new value.

    An added or removed key whose columns are all NULL is one row without a column name.
    Keys and row digests are compared first; whole rows cross the shuffle only for
    keys that were added, removed or changed. Of repeated keys the smallest row counts.
    """
    named = [F.col(f"`{k}`") for k in keys]
    both = before.select(*named, *[F.col(f"`{c}`").cast("string").alias(f"__v{i}") for i, c in enumerate(columns)], F.lit(True).alias("old")).union(
        after.select(*named, *[F.col(f"`{c}`").cast("string") for c in columns], F.lit(False))
    )
    one, two = row_digests([f"__v{i}" for i in range(len(columns))])
    seen = both.select(*named, one.alias("__1"), two.alias("__2"), "old").groupBy(*named).agg(
        F.bool_or("old").alias("was"),
        F.bool_or(~F.col("old")).alias("stays"),
        ((F.min("__1") == F.max("__1")) & (F.min("__2") == F.max("__2"))).alias("alike"),
    )
    touched = seen.where(~(F.col("was") & F.col("stays") & F.col("alike"))).select(*[k.alias(f"__k{i}") for i, k in enumerate(named)])
    same_key = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(named)])
    packed = F.struct(*[F.col(f"__v{i}").alias(c) for i, c in enumerate(columns)])
    rows = both.select(*named, packed.alias("r"), "old").join(touched, same_key, "left_semi")
    paired = rows.groupBy(*named).agg(
        F.min(F.when(F.col("old"), F.col("r"))).alias("a"),
        F.min(F.when(~F.col("old"), F.col("r"))).alias("b"),
        F.bool_or("old").alias("was"),
        F.bool_or(~F.col("old")).alias("stays"),
    )
    kind = F.when(~F.col("was"), "added").when(~F.col("stays"), "removed").otherwise("changed")
    listed = [
        {
            "change": kind,
            "column_name": F.lit(c),
            "previous_value": F.col("a")[c],
            "new_value": F.col("b")[c],
        }
        for c in columns
    ]
    empty = reduce(lambda a, b: a & b, [F.col(s)[c].isNull() for s in ("a", "b") for c in columns])
    bare = empty & ~(F.col("was") & F.col("stays"))
    nothing = F.lit(None).cast("string")
    listed.append({"change": F.when(bare, kind), "column_name": nothing, "previous_value": nothing, "new_value": nothing})
    return rows_from(paired, listed, keep=list(keys)).where(
        ~F.col("previous_value").eqNullSafe(F.col("new_value")) | (F.col("column_name").isNull() & F.col("change").isNotNull())
    )
