"""Registered queries on category trees, dependency graphs, names and snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallymark.operators import hierarchy as g
from tallymark.plans.fixtures import fixture, read, with_fixtures
from tallymark.plans.registry import query

_TREE = """
    tree AS (
        SELECT id, parent_id, type, name, 1 AS level, name AS path, [id] AS path_ids
        FROM categories WHERE parent_id IS NULL
        UNION ALL
        SELECT c.id, c.parent_id, c.type, c.name, t.level + 1, t.path || ' > ' || c.name, list_append(t.path_ids, c.id)
        FROM categories c JOIN tree t ON c.parent_id = t.id)"""


def _tree(spark, sf_dir):
    return g.category_tree(fixture(spark, sf_dir, "categories"))


@query(
    "tree_paths",
    with_fixtures("SELECT id, parent_id, type, name, level, path FROM tree", _TREE, recursive=True),
)
def tree_paths(spark, sf_dir):
    return _tree(spark, sf_dir).drop("path_ids")


@query(
    "tree_search",
    with_fixtures(
        """
        SELECT DISTINCT t.id, t.name FROM tree t
        WHERE EXISTS (SELECT 1 FROM hits h WHERE list_contains(h.path_ids, t.id))
           OR EXISTS (SELECT 1 FROM hits h WHERE list_contains(t.path_ids, h.id) AND NOT EXISTS (
                SELECT 1 FROM hits k WHERE k.id <> h.id AND list_contains(k.path_ids, h.id)))""",
        _TREE,
        "hits AS (SELECT * FROM tree WHERE contains(lower(name), 'ia'))",
        recursive=True,
    ),
)
def tree_search(spark, sf_dir):
    return g.tree_search(_tree(spark, sf_dir), "IA").select("id", "name")


@query(
    "tree_rollup",
    with_fixtures(
        """
        SELECT domain, module, grp, count(*) AS jobs,
               CAST(3 - grouping(domain) - grouping(module) - grouping(grp) AS INT) AS depth
        FROM (SELECT coalesce(d.name, 'Unclassified') AS domain, coalesce(m.name, 'Unknown Module') AS module,
                     coalesce(k.name, 'Unknown Group') AS grp
              FROM classified j LEFT JOIN categories d ON d.id = j.domain_id LEFT JOIN categories m ON m.id = j.module_id
              LEFT JOIN categories k ON k.id = j.group_id) x
        GROUP BY ROLLUP (domain, module, grp)"""
    ),
)
def tree_rollup(spark, sf_dir):
    return g.job_counts_by_level(
        _named(spark, sf_dir), ["domain", "module", "grp"], ["Unclassified", "Unknown Module", "Unknown Group"]
    )


def _named(spark, sf_dir):
    return g.with_category_names(
        fixture(spark, sf_dir, "classified"),
        fixture(spark, sf_dir, "categories"),
        [("domain_id", "domain"), ("module_id", "module"), ("group_id", "grp")],
    )


@query(
    "lookup_three",
    with_fixtures(
        """
        SELECT job_id, d.name AS domain, m.name AS module, k.name AS grp FROM classified j
        LEFT JOIN categories d ON d.id = j.domain_id LEFT JOIN categories m ON m.id = j.module_id
        LEFT JOIN categories k ON k.id = j.group_id"""
    ),
)
def lookup_three(spark, sf_dir):
    return _named(spark, sf_dir).select("job_id", "domain", "module", "grp")


@query(
    "layers",
    with_fixtures(
        "SELECT job_id, CAST(max(d) AS INT) AS layer FROM walk GROUP BY job_id",
        """walk AS (
            SELECT p_partkey AS job_id, 0 AS d FROM part WHERE p_partkey NOT IN (SELECT job_id FROM edges)
            UNION ALL SELECT e.job_id, w.d + 1 FROM edges e JOIN walk w ON e.depends_on = w.job_id)""",
        recursive=True,
    ),
)
def layers(spark, sf_dir):
    jobs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("job_id"))
    return g.execution_layers(jobs, fixture(spark, sf_dir, "edges"))


@query(
    "blocked_jobs",
    with_fixtures(
        """
        SELECT j.job_id, j.status, coalesce(c.n, 0) AS dependencies, coalesce(c.done, 0) AS completed_dependencies,
               coalesce(c.n, 0) > coalesce(c.done, 0) AS blocked
        FROM jobs j LEFT JOIN (SELECT e.job_id, count(*) AS n, count(*) FILTER (WHERE s.status = 'completed') AS done
                               FROM edges e LEFT JOIN jobs s ON s.job_id = e.depends_on GROUP BY e.job_id) c
        ON c.job_id = j.job_id""",
        "jobs AS (SELECT p_partkey AS job_id, CASE WHEN p_size % 2 = 0 THEN 'completed' ELSE 'pending' END AS status FROM part)",
    ),
)
def blocked_jobs(spark, sf_dir):
    jobs = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("job_id"), F.when(F.col("p_size") % 2 == 0, "completed").otherwise("pending").alias("status")
    )
    return g.blocked_jobs(jobs, fixture(spark, sf_dir, "edges"))


@query(
    "fuzzy_match",
    with_fixtures(
        """
        SELECT type, name, category_id, category, exact FROM (
            SELECT w.type, w.name, c.id AS category_id, c.name AS category, lower(c.name) = w.name AS exact,
                   row_number() OVER (PARTITION BY w.type, w.name
                       ORDER BY lower(c.name) <> w.name, -length(c.name), lower(c.name), c.id) AS rn
            FROM (SELECT DISTINCT type, lower(trim(name)) AS name FROM names
                  WHERE lower(trim(name)) NOT IN ('', 'unknown', 'n/a', 'none')) w
            LEFT JOIN categories c ON c.type = w.type AND (lower(c.name) = w.name OR (length(w.name) >= 3
                 AND (contains(lower(c.name), w.name) OR contains(w.name, lower(c.name)))))
        ) x WHERE rn = 1"""
    ),
)
def fuzzy_match(spark, sf_dir):
    return g.match_categories(fixture(spark, sf_dir, "names"), fixture(spark, sf_dir, "categories"))


@query(
    "suggestions",
    with_fixtures(
        "SELECT type, lower(name) AS name, count(DISTINCT job_path) AS occurrence_count,"
        " min(suggested_at) AS first_suggested_at, max(suggested_at) AS last_suggested_at FROM proposals GROUP BY 1, 2"
    ),
)
def suggestions(spark, sf_dir):
    return g.suggestions(fixture(spark, sf_dir, "proposals"))


@query(
    "suggesting_jobs",
    with_fixtures("SELECT DISTINCT type, lower(name) AS name, job_path FROM proposals"),
)
def suggesting_jobs(spark, sf_dir):
    return g.suggesting_jobs(fixture(spark, sf_dir, "proposals"))


_REVIEWED = """
    SELECT s_suppkey AS id, 'module' AS type, s_name AS name,
           CASE WHEN s_suppkey % 4 = 1 THEN 'done' WHEN s_suppkey % 3 = 0 THEN 'approved'
                WHEN s_suppkey % 3 = 1 THEN 'rejected' ELSE 'pending' END AS status
    FROM supplier"""


def _review(spark, sf_dir):
    supplier = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    table = supplier.select(
        key.alias("id"),
        F.lit("module").alias("type"),
        F.col("s_name").alias("name"),
        F.when(key % 4 == 1, "done").otherwise("pending").alias("status"),
        F.lit(None).cast("string").alias("reviewed_by"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
    )
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    decisions = supplier.where(key % 3 < 2).select(
        key.alias("id"),
        F.when(key % 3 == 0, "approved").otherwise("rejected").alias("decision"),
        F.lit("lead").alias("reviewed_by"),
        at.alias("reviewed_at"),
    )
    return g.review(table, decisions)


@query("suggestion_review", f"SELECT id, status, CASE WHEN status IN ('approved', 'rejected') THEN 'lead' END AS reviewed_by FROM ({_REVIEWED}) r")
def suggestion_review(spark, sf_dir):
    return _review(spark, sf_dir).select("id", "status", "reviewed_by")


@query(
    "categories_after_review",
    with_fixtures(
        "SELECT id, parent_id, type, name FROM categories UNION ALL"
        f" SELECT id + 5000000, NULL, type, name FROM ({_REVIEWED}) r WHERE status = 'approved'"
    ),
)
def categories_after_review(spark, sf_dir):
    return g.categories_after(fixture(spark, sf_dir, "categories"), _review(spark, sf_dir), 5_000_000)


@query(
    "upsert_latest",
    """
    SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS segment FROM customer
    UNION ALL SELECT s_suppkey + 100000000, 'new' FROM supplier""",
)
def upsert_latest(spark, sf_dir):
    current = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("version")
    )
    changed = current.where("id % 3 = 0").select("id", F.lit("changed").alias("segment"), F.lit(1).alias("version"))
    stale = current.where("id % 5 = 0").select("id", F.lit("stale").alias("segment"), F.lit(0).alias("version"))
    fresh = read(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 100_000_000).alias("id"), F.lit("new").alias("segment"), F.lit(1).alias("version")
    )
    return g.upsert(current, changed.union(stale).union(fresh), ["id"], "version").select("id", "segment")


@query(
    "snapshot_history",
    with_fixtures(
        " UNION ALL ".join(
            f"""
            SELECT coalesce(g.id, o.id) AS id, CASE WHEN g.id IS NULL THEN 'added' WHEN o.id IS NULL THEN 'removed'
                   ELSE 'changed' END AS change, '{c}' AS column_name, CAST(g.{c} AS VARCHAR) AS previous_value,
                   CAST(o.{c} AS VARCHAR) AS new_value
            FROM golden g FULL JOIN output o ON g.id = o.id
            WHERE CAST(g.{c} AS VARCHAR) IS DISTINCT FROM CAST(o.{c} AS VARCHAR)"""
            for c in ("o_orderstatus", "amount", "o_orderpriority")
        )
    ),
)
def snapshot_history(spark, sf_dir):
    return g.change_history(
        fixture(spark, sf_dir, "golden"), fixture(spark, sf_dir, "output"), ["id"], ["o_orderstatus", "amount", "o_orderpriority"]
    )


@query(
    "suggestions_pending",
    with_fixtures(
        """
        SELECT type, name, occurrence_count FROM (
            SELECT type, lower(name) AS name, count(DISTINCT job_path) AS occurrence_count, max(suggested_at) AS m
            FROM proposals GROUP BY 1, 2) x
        ORDER BY occurrence_count DESC, m DESC, type, name LIMIT 10"""
    ),
)
def suggestions_pending(spark, sf_dir):
    table = g.suggestions(fixture(spark, sf_dir, "proposals")).withColumn("status", F.lit("pending"))
    return g.pending_suggestions(table, 10).select("type", "name", "occurrence_count")
