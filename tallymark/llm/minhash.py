"""Near-duplicate detection by MinHash banding, checked links and connected components.

Each text is the set of its distinct runs of k words (A-Z folded).  Texts of
equal sets form a class; one member stands for the class.  The minima of many
universal hashes are cut into bands; classes that agree on a band are
candidates.  Candidates whose signatures agree far too rarely are put aside,
and the rest is confirmed on the full sets.  First each class is compared with
that head of its buckets with which it shares the most; then, where the components found so far still
differ, with the other heads; then members of a bucket that are still in
different components with each other: one by one in small buckets, in blocks
whose full sets are intersected at once, and from which only links come out,
in large ones.  So no link that a bucket shows is lost, and pairs inside a
component are not made.

With 64 bands of 8 rows a pair of similarity 0.8 shares no bucket with
probability 8e-6.  Signatures are put aside below an agreement that is five
standard deviations under 0.8.  Pairs far below 0.8 that share a bucket by
chance grow with the square of the corpus; more rows per band thin them out.

Defined cases: a text with fewer than k words is one run; a text without words
has an empty set and no links.  A null identifier takes no part in links.
Texts of any length are hashed whole.  Rows that share an identifier but not
the text are told apart; a component is named by the smallest identifier of its
rows, so ties need no rule.  Repeated rows get equal answers.  An empty table
gives an empty result.  Columns other than the two named ones are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.components import connected_components, merged
from tallymark.llm.words import fold, hash_many, hash_words, mix, shingles
from tallymark.session import gathered, stored

BANDS, ROWS = 64, 8
_HASHES = BANDS * ROWS
_DRAW = np.random.default_rng(1997)
_A = _DRAW.integers(0, 1 << 63, size=_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 1 << 64, size=_HASHES, dtype=np.uint64)
#: Values hashed at a time, so that the arrays stay in cache.
_STRIP = 1 << 15
SIMILARITY = 80
#: Standard deviations under the similarity at which a signature rules a pair out: once in three million pairs at 0.8.
DEVIATIONS = 5
#: Members up to which a bucket's open members are paired one by one; those of larger buckets meet in blocks.
PAIRED = 64
_BLOCK_ROWS, _BLOCK_BYTES = 512, 8 << 20


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minimum of each universal hash over each set, one row per set (none empty)."""
    out = np.empty((len(sets), _HASHES), dtype=np.uint32)
    at = 0
    while at < len(sets):
        stop, size = at, 0
        while stop < len(sets) and (stop == at or size + len(sets[stop]) <= _STRIP):
            size += len(sets[stop])
            stop += 1
        values = np.concatenate(sets[at:stop])
        begin = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : stop - 1]]))).astype(np.int64)
        room = np.empty_like(values)
        for i in range(_HASHES):
            np.multiply(values, _A[i], out=room)
            room += _B[i]
            out[at:stop, i] = np.minimum.reduceat(room, begin) >> np.uint64(32)
        at = stop
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, version, n, set_a, set_b, bands, sketch`` per row: a number of its own, hash of the text, set size, a 128-bit digest of the set, band keys, low signature bytes."""

    def sign(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            words, begin = hash_many([fold(t) for t in batch.column(1).to_pylist()])
            sets = [shingles(words[begin[i] : begin[i + 1]], k) for i in range(batch.num_rows)]
            size = np.array([len(s) for s in sets], dtype=np.int64)
            filled = np.flatnonzero(size)
            bands = [None] * len(sets)
            sketch = [None] * len(sets)
            digest = np.zeros((len(sets), 2), dtype=np.uint64)
            if len(filled):
                low = minima([sets[i] for i in filled])
                keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(filled), BANDS)).copy()
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r::ROWS])
                keys = _signed(keys)
                for at, i in enumerate(filled):
                    # Sets of under four runs are only similar enough when they are equal.
                    bands[i] = keys[at] if size[i] >= 4 else None
                    sketch[i] = (low[at] & 0xFF).astype(np.uint8).tobytes()
                    digest[i] = mix(sets[i]).sum(), mix(sets[i] ^ np.uint64(0x5555555555555555)).sum()
            first, row = row, row + batch.num_rows
            yield pa.record_batch(
                [
                    pa.array(np.arange(first, row, dtype=np.int64)),
                    batch.column(0),
                    batch.column(2),
                    pa.array(size),
                    pa.array(_signed(digest[:, 0].copy())),
                    pa.array(_signed(digest[:, 1].copy())),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketch, pa.binary()),
                ],
                names=["row", "id", "version", "n", "set_a", "set_b", "bands", "sketch"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(sign, f"row long, id {kind}, version long, n long, set_a long, set_b long, bands array<long>, sketch binary")


def _plausible(pairs: DataFrame, members: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose set sizes and signatures do not rule the similarity out."""
    share = similarity / 100
    least = (share - DEVIATIONS * (share * (1 - share) / _HASHES) ** 0.5) * _HASHES
    one = members.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = members.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    fits = F.lit(100) * F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")
    joined = pairs.join(one, "a").join(two, "b").where(fits).select("a", "b", "s_a", "s_b")

    def agree(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            s, t = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, _HASHES) for i in (2, 3))
            ok = pa.array((s == t).sum(axis=1) >= least)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(ok)

    return gathered(joined).mapInArrow(agree, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """Pairs whose full sets are similar enough. ``texts`` has one row ``node, text`` per member."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("t_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("t_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "t_a", "t_b")

    def confirm(batches):
        seen: dict[str, np.ndarray] = {}

        def set_of(text):
            found = seen.get(text)
            if found is None:
                if len(seen) >= 256:
                    seen.clear()
                found = seen[text] = shingles(hash_words(fold(text)), k)
            return found

        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = set_of(x), set_of(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= similarity * (len(s) + len(t) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return gathered(joined).mapInArrow(confirm, "a long, b long")


def _compared(open_rows: pa.Table, rows: pa.Table, k: int, similarity: int) -> pa.Table:
    """For each open row one link to each other component of which ``rows`` has a similar enough member."""
    sets = [shingles(hash_words(fold(t)), k) for t in rows.column("text").to_pylist()]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    node, component = rows.column("node").to_numpy(), rows.column("component").to_numpy()
    a, b = [], []
    for one, own, text in zip(*(open_rows.column(f"open_{c}").to_pylist() for c in ("node", "component", "text")), strict=True):
        mine = shingles(hash_words(fold(text)), k)
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        held = np.zeros(len(known), dtype=np.int64)
        held[at[known[at] == mine]] = 1
        both = np.add.reduceat(held[place], begin)
        near = np.flatnonzero((100 * both >= similarity * (size + len(mine) - both)) & (component != own))
        _, first = np.unique(component[near], return_index=True)
        a += [one] * len(first)
        b += node[near[first]].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_blocks(rows: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """Links ``a, b`` between the components of large buckets; ``rows`` are their members ``key, node, component``.

    Large buckets that share members form a group, so that a pair of many
    common buckets is compared once.  The members outside a group's largest
    component meet all its members, block by block; only links leave a task.
    """
    heads = rows.groupBy("key").agg(F.min("node").alias("a"))
    edges = rows.join(heads, "key").select("a", F.col("node").alias("b"))
    group = stored(gathered(connected_components(edges))).withColumnRenamed("component", "group")
    members = stored(rows.select("node", "component").distinct().join(group, "node").join(texts, "node"))
    sizes = members.groupBy("group", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    # The largest component of a group, by rows and then by its name, in fixed-width columns.
    most = sizes.groupBy("group").agg(F.max("rows").alias("most"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    main = sizes.join(most.select("group", "most"), "group").where(F.col("rows") == F.col("most")).groupBy("group").agg(F.min("component").alias("main"))
    others = sizes.join(main, "group").where(F.col("component") != F.col("main")).groupBy("group").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))

    def parts(table: DataFrame, name: str) -> DataFrame:
        return table.select("group", F.ceil(F.greatest(F.col("rows") / _BLOCK_ROWS, F.col("bytes") / _BLOCK_BYTES)).cast("int").alias(name))

    plan = stored(parts(most, "blocks").join(parts(others, "open_blocks"), "group").join(main, "group"))
    placed = members.join(plan, "group")
    hashed = F.xxhash64("node")
    open_rows = placed.where(F.col("component") != F.col("main")).select(
        F.col("group").alias("of"),
        *[F.col(c).alias(f"open_{c}") for c in ("node", "component", "text")],
        F.pmod(hashed, F.col("open_blocks")).cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"),
    )
    every = placed.select(
        "group", "node", "component", "text", F.explode(F.sequence(F.lit(0), F.col("open_blocks") - 1)).alias("x"), F.pmod(hashed, F.col("blocks")).cast("int").alias("y")
    )

    def compare(one, two):
        if one.num_rows and two.num_rows:
            return _compared(one, two, k, similarity)
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    cells = open_rows.groupBy("of", "x", "y").cogroup(every.groupBy("group", "x", "y"))
    return cells.applyInArrow(compare, "a long, b long")


def near_groups(
    docs: DataFrame, k: int = 5, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_shingles, component_id, kept, version`` per row (``version`` is the text's hash): groups linked by a similarity of ``similarity`` percent or more."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(signatures(plain, k, "id", "text"))
    # A class is known by the number of one of its rows, never by an identifier, which several texts may have.
    classes = stored(gathered(signed.where("n > 0").groupBy("n", "set_a", "set_b").agg(F.min("id").alias("rep"), F.min("row").alias("node"))))
    large = classes.where("n >= 4 and rep is not null").select(F.col("node").alias("row"))
    members = signed.join(large, "row", "left_semi").withColumnRenamed("row", "node")
    buckets = members.select("node", F.explode("bands").alias("key"))
    heads = buckets.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(buckets.join(heads, "key"))
    # Texts and signatures of the members that share a bucket are fetched once. The texts are too many for a broadcast at
    # any size that matters, so the plan is the same at every size.
    met = shared.select("node").distinct()
    sketches = stored(members.select("node", "id", "version", "n", "sketch").join(met, "node", "left_semi"))
    named = sketches.select("node", F.col("id").alias("m_id"), F.col("version").alias("m_version")).hint("merge")
    same = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("version") == F.col("m_version"))
    texts = stored(plain.withColumn("version", F.xxhash64("text")).join(named, same).select("node", "text").dropDuplicates(["node"]))

    def linked(pairs: DataFrame) -> DataFrame:
        return stored(_confirmed(stored(_plausible(pairs, sketches, similarity)), texts, k, similarity))

    def placed(rows: DataFrame, found: DataFrame, column: str, name: str) -> DataFrame:
        known = found.select(F.col("node").alias("at"), F.col("component").alias(name))
        return rows.join(known, F.col(column) == F.col("at"), "left").drop("at").withColumn(name, F.coalesce(name, column))

    pairs = stored(gathered(shared.where("node <> a").groupBy("a", "node").agg(F.count(F.lit(1)).alias("times"))))
    most = pairs.groupBy("node").agg(F.max("times").alias("times"))
    nearest = stored(gathered(pairs.join(most, ["node", "times"]).groupBy("node").agg(F.min("a").alias("a"))))
    found = stored(gathered(connected_components(linked(nearest.select("a", F.col("node").alias("b"))))))

    # Then all other heads that are in another component.
    apart = placed(placed(pairs, found, "node", "of_node"), found, "a", "of_a").where("of_node <> of_a").select("node", "a")
    apart = stored(gathered(apart.join(nearest, ["node", "a"], "left_anti")))
    if not apart.isEmpty():
        more = linked(apart.select("a", F.col("node").alias("b")))
        if not more.isEmpty():
            found = merged(found, more)

    # Members of one bucket that are not in one component have not been compared unless one is the bucket's head.
    lone = placed(shared, found, "node", "component")
    open_keys = lone.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    rest = stored(
        gathered(
            lone.where("node <> a")
            .join(open_keys.select("key"), "key", "left_semi")
            .join(sketches.select("node", "n"), "node")
            .select("key", "node", "component", "n", "size")
        )
    )
    few = rest.where(F.col("size") <= PAIRED)
    other = few.select(F.col("key").alias("k"), F.col("node").alias("b"), F.col("component").alias("other"), F.col("n").alias("n_b"))
    fits = F.lit(100) * F.least("n", "n_b") >= F.lit(similarity) * F.greatest("n", "n_b")
    apart = (F.col("key") == F.col("k")) & (F.col("node") < F.col("b")) & (F.col("component") != F.col("other")) & fits
    more = linked(few.join(other, apart).select(F.col("node").alias("a"), "b").distinct())
    many = rest.where(F.col("size") > PAIRED)
    if not many.isEmpty():
        more = more.union(stored(_in_blocks(many, texts, k, similarity)))
    if not more.isEmpty():
        found = merged(found, more)

    # A component is named by its smallest identifier.
    inside = classes.join(found.withColumnRenamed("component", "of"), "node", "left").withColumn("of", F.coalesce("of", "node"))
    names = inside.groupBy("of").agg(F.min("rep").alias("component_id"))
    named = inside.join(names, "of").select("n", "set_a", "set_b", "component_id")
    return (
        signed.select("id", "version", "n", "set_a", "set_b")
        .join(named, ["n", "set_a", "set_b"], "left")
        .withColumn("component_id", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")))
        .select("id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "version")
    )
