"""Grouping of spelling variants with an index of variable-length grams.

Words are the runs of letters of all texts.  Two words are near if one inserted,
deleted or replaced letter turns one into the other.

The gram dictionary starts with all grams of two letters; a gram that occurs
more than ``frequent`` times is too common to tell words apart and is extended
by its next letter, up to six.  A word is decomposed into one gram per letter:
the shortest at that place that is not too common.  Which gram that is depends
on its own letters only, so an edit affects those grams that cover its place
and no others.  The largest number of grams that cover one place is the word's
bound of affected grams: a near word shares all but so many of its grams.

Lists of words per gram are therefore merged for the rarest of a word's grams
only, one more than its bound; a near pair meets in one of them.  A gram that an
edit leaves alone lies to its left or right: then everything up to the gram's
end, or from its beginning, is the same in both words.  The lists are kept by
that whole part, and candidates are verified by their edit distance.  A list of
more than ``list_rows`` words is cut further: of what the words do not have in
common, the edit leaves the first or the last half alone.

Defined cases: a null text has no words, a null identifier counts as empty.
Repeated rows are counted each.  Texts and words may be of any length.  Of near
words with equally many occurrences the first in code-point order is the form.
An empty table gives an empty result.  Columns other than the two named ones
are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.words import mix
from tallymark.session import stored

LETTERS = r"[A-Za-zÀ-ÿ]+"
SHORTEST, LONGEST = 2, 6
#: Occurrences above which a gram is extended; at least so many, and so large a part of all places that the common grams stay few.
FREQUENT, _PLACES = 64, 1 << 18
#: Words of a list that are compared with each other directly.
LIST_ROWS = 256
_END = 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged_words(docs: DataFrame, least_length: int, one_in: int, id_col: str, text_col: str) -> DataFrame:
    """``word`` per run of letters in lower case (A-Z only); of one in ``one_in`` runs one letter, by its checksum, is deleted."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(name.alias("name"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("run"))
    long = runs.where(F.char_length("run") >= least_length).select("name", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = long.withColumn("h", F.crc32(F.concat("name", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_length)


class Letters:
    """Words one after another, each closed by an end mark, as one array of Latin-1 letters."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.size = np.array([len(r) for r in raw], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(r + bytes([_END]) for r in raw), dtype=np.uint8)
        self.begin = np.concatenate(([0], np.cumsum(self.size + 1)))[:-1].astype(np.int64)
        self.word = np.repeat(np.arange(len(raw)), self.size)
        # One gram starts at each letter; the end mark counts as a letter that it may hold.
        self.start = np.arange(len(self.word)) + self.word
        self.room = self.begin[self.word] + self.size[self.word] + 1 - self.start

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The grams of so many letters as numbers, and which starts have one."""
        some = np.flatnonzero(self.room >= size)
        packed = np.zeros(len(some), dtype=np.int64)
        for i in range(size):
            packed = (packed << 8) | self.flat[self.start[some] + i]
        return packed, some


class Dictionary:
    """The common grams, sorted, with the number of their occurrences."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.gram, self.count = grams[order], counts[order]

    def common(self, packed: np.ndarray) -> np.ndarray:
        """Occurrences of common grams; 0 for all others."""
        if len(self.gram) == 0:
            return np.zeros(len(packed), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.gram, packed), len(self.gram) - 1)
        return np.where(self.gram[at] == packed, self.count[at], 0)

    def decompose(self, letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram, size and occurrences (0 if not common) of the gram at each letter."""
        gram, _ = letters.grams(SHORTEST)
        size = np.full(len(gram), SHORTEST, dtype=np.int64)
        count = self.common(gram)
        for q in range(SHORTEST + 1, LONGEST + 1):
            longer, some = letters.grams(q)
            grown = (size[some] == q - 1) & (count[some] > 0)
            at = some[grown]
            gram[at], size[at] = longer[grown], q
            count[at] = self.common(gram[at])
        return gram, size, count


def affected(letters: Letters, size: np.ndarray) -> np.ndarray:
    """Per word the largest number of grams that cover one letter or the end mark."""
    change = np.zeros(len(letters.flat) + 1, dtype=np.int64)
    np.add.at(change, letters.start, 1)
    np.add.at(change, letters.start + size, -1)
    return np.maximum.reduceat(np.cumsum(change)[:-1], letters.begin) if len(letters.begin) else np.zeros(0, dtype=np.int64)


def _dictionary(words: DataFrame, frequent: int) -> Dictionary:
    def count(batches):
        for batch in batches:
            letters = Letters(batch.column(0).to_pylist())
            for q in range(SHORTEST, LONGEST + 1):
                gram, n = np.unique(letters.grams(q)[0], return_counts=True)
                yield pa.record_batch([pa.array(gram), pa.array(n.astype(np.int64))], names=["gram", "n"])

    counts = stored(words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    places = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    # Fewer than places / least grams of each size are common, so at most 5 * 2**18 of them come to the driver.
    least = max(frequent, places // _PLACES)
    found = counts.where(F.col("n") > least).toArrow()
    return Dictionary(found.column("gram").to_numpy().astype(np.int64), found.column("n").to_numpy().astype(np.int64))


def _listed(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """``list, word, n, from_start, cut`` for the lists of each word: those of the shared part before ``cut``, or after it."""
    common = words.sparkSession.sparkContext.broadcast((dictionary.gram, dictionary.count))

    def index(batches):
        known = Dictionary(*common.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            letters = Letters(texts)
            gram, size, count = known.decompose(letters)
            bound = affected(letters, size)
            order = np.lexsort((letters.start, mix(gram.astype(np.uint64)), count, letters.word))
            first = np.concatenate(([0], np.cumsum(letters.size)))[:-1]
            taken = order[np.arange(len(order)) - first[letters.word] <= bound[letters.word]]
            word = letters.word[taken]
            begin = letters.start[taken] - letters.begin[word]
            end = begin + size[taken]
            left = end <= letters.size[word]
            rows = np.concatenate((word[left], word))
            cut = np.concatenate((end[left], begin))
            side = np.arange(len(rows)) < left.sum()
            shared = [texts[w][:c] if s else texts[w][c:] for w, c, s in zip(rows.tolist(), cut.tolist(), side.tolist(), strict=True)]
            some = pa.array(rows)
            yield pa.record_batch(
                [pa.array(shared, pa.string()), batch.column(0).take(some), batch.column(1).take(some), pa.array(side), pa.array(cut.astype(np.int32))],
                names=["shared", "word", "n", "from_start", "cut"],
            )

    found = words.select("word", "n").mapInArrow(index, "shared string, word string, n long, from_start boolean, cut int")
    # Lists are known by a hash of what they share; a collision only adds candidates.
    return found.select(F.xxhash64("from_start", "shared").alias("list"), "word", "n", "from_start", "cut")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of lists of two and more words, with the number of their list's rows."""
    sizes = stored(rows.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    return rows.join(sizes, "list")


def _halves(rows: DataFrame) -> DataFrame:
    """The rows of long lists in the shorter lists of one half of the part that they do not share."""
    rest = F.when(F.col("from_start"), F.expr("substring(word, cut + 1)")).otherwise(F.expr("substring(word, 1, cut)"))
    size = F.char_length("rest")
    keys = []
    for shorter in (size, size - 1):  # the length of the shorter of two near words
        half = F.floor(shorter / 2).cast("int")
        keys.append(F.xxhash64("list", shorter, F.lit("first"), F.substring(F.col("rest"), F.lit(1), half)))
        keys.append(F.xxhash64("list", shorter, F.lit("last"), F.substring(F.col("rest"), size - (shorter - half) + 1, size)))
    return rows.withColumn("rest", rest).select(F.explode(F.array(*keys)).alias("list"), "word", "n")


def near_pairs(words: DataFrame, frequent: int = FREQUENT, list_rows: int = LIST_ROWS) -> DataFrame:
    """``a, n_a, b, n_b``, each pair once: the words ``word, n`` that exactly one edit tells apart."""
    lists = stored(_sized(stored(_listed(words, _dictionary(words, frequent)))))
    short = lists.where(F.col("rows") <= list_rows).select("list", "word", "n")
    halves = _sized(_halves(lists.where(F.col("rows") > list_rows))).select("list", "word", "n")
    every = stored(short.union(halves))
    one, two = every.select("list", F.col("word").alias("a"), F.col("n").alias("n_a")), every.select(F.col("list").alias("other"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    fits = (F.col("list") == F.col("other")) & (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1)
    pairs = one.join(two, fits).where(F.levenshtein("a", "b", 1) == 1)
    return pairs.select("a", "n_a", "b", "n_b").distinct()


def _roots(forms: DataFrame, hops: int) -> DataFrame:
    """``word, root``: the last of the chain of forms, found by doubling the step."""
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(hops + 1)) if hops else 0):
        ahead = reached.select(F.col("word").alias("at"), F.col("root").alias("further"))
        reached = stored(reached.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root")))
    return reached


def group_variants(
    docs: DataFrame,
    least_length: int = 7,
    least_count: int = 2,
    times: int = 10,
    one_in: int = 31,
    frequent: int = FREQUENT,
    list_rows: int = LIST_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per distinct word of at least ``least_length`` letters and ``least_count`` occurrences.

    The form is the near word of most occurrences, if these are ``times`` the
    word's own; the root is the last of the chain of forms.
    """
    if least_length < LONGEST + 1:
        raise ValueError(f"words of fewer than {LONGEST + 1} letters may share no gram")
    words = stored(damaged_words(docs, least_length, one_in, id_col, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))
    pairs = stored(near_pairs(words, frequent, list_rows))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_near")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n_near"))
    )
    # Most occurrences first, then code-point order: the least of (-n, word).
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("less"), F.col("near"))).alias("best"))
    known = words.join(best, "word", "left")
    enough = _enough(F.col("best.less"), F.col("n"), times)
    rows = stored(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    most = words.agg(F.max("n")).first()[0] or 0
    hops = int(math.log(most / least_count, times)) + 1 if times > 1 and most > least_count else 0
    roots = _roots(rows.where("form is not null"), hops)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _enough(less: Column, n: Column, times: int) -> Column:
    return less.isNotNull() & (-less >= n * times)
