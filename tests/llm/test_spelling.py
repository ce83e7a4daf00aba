"""Variants agree with comparing all words; the lists lose no near pair."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallymark.llm import queries as q
from tallymark.llm.spelling import Dictionary, Letters, affected, group_variants, near_pairs
from tests import oracle

SF = "/root/testdata/sf0.001"


def fold(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    rows = {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = others[0][1] if others and -others[0][0] >= 10 * n else None
        rows[w] = (form, n, len(others), words[form] if form else None)
    out = set()
    for w, (form, *rest) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.add((w, form, root, *rest))
    return out


def found(df, **options):
    rows = group_variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def test_query_agrees_with_its_sql(spark):
    name = "op13_spelling_variants"
    df = q.QUERIES[name](spark, SF)
    cur = oracle.duck(SF).execute(q.ORACLES[name])
    names = [d[0] for d in cur.description]
    got = Counter(map(tuple, df.select(*names).collect()))
    assert got and got == Counter(cur.fetchall())


@pytest.mark.parametrize("frequent,list_rows", [(64, 256), (2, 3), (0, 2), (10**6, 2)])
def test_odd_rows(spark, frequent, list_rows):
    rng = random.Random(4)
    base = ["international", "nationality", "rational", "aaaaaaaa", "abababab", "ÉÀÿ×÷éèàç", "x" * 300]
    text = []
    for _ in range(900):
        word = rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(word) + 1)
            word = word[:at] + rng.choice(["", "a", "b", "é"]) + word[at + rng.choice([0, 1]) :]
        text.append(word)
    rows = [(i, " ".join(text[i::6])) for i in range(6)] + [(6, None), (7, ""), (8, "International INTERNATIONAL, rational; naïveté Ünïcode1Ünïcode"), (8, "International INTERNATIONAL"), (None, "Ünïcode rational rational")]
    df = spark.createDataFrame([(*r, "w", 1, 2, 3) for r in rows], "doc_id long, text string, word string, n int, list long, shared int").repartition(3)
    assert found(df, frequent=frequent, list_rows=list_rows) == brute(rows)


def test_chains_of_forms(spark):
    words = {"abcdefghij": 2, "abcdefghi": 25, "abcdefgh": 300, "abcdefg": 3100}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    rows = [(1, text)]
    want = brute(rows)
    assert {w: root for w, _, root, *_ in want if w in words} == dict.fromkeys(words, "abcdefg")
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_near_words_share_all_but_the_bound():
    rng = random.Random(7)
    letters = "aab"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 14))) for _ in range(400)]
    grams = Counter()
    for size in range(2, 7):
        grams.update(Letters(words).grams(size)[0].tolist())
    common = {g: n for g, n in grams.items() if n > 30}
    known = Dictionary(np.array(list(common), dtype=np.int64), np.array(list(common.values()), dtype=np.int64))
    for word in words:
        at = rng.randrange(len(word) + 1)
        other = word[:at] + rng.choice(["", "a", "b", "c"]) + word[at + rng.choice([0, 1]) :]
        if not near(word, other):
            continue
        sets = []
        for text in (word, other):
            one = Letters([text])
            gram, size, _ = known.decompose(one)
            assert size.max() <= 6 and len(gram) == len(text)
            sets.append((Counter(gram.tolist()), len(gram) - int(affected(one, size)[0])))
        assert (sets[0][0] & sets[1][0]).total() >= max(sets[0][1], sets[1][1], 1)


def test_a_long_list_is_cut(spark):
    """Thousands of words with one beginning: the lists stay short, no pair is lost."""
    rng = random.Random(2)
    words = {"beginning" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(3000)}
    some = sorted(words)[::30]
    words |= {w[:-1] for w in some} | {w[:10] + "q" + w[11:] for w in some}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(r["a"], r["b"]) for r in near_pairs(df, list_rows=64).collect()}
    rest = {}
    for w in words:
        for i in range(len(w)):
            rest.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    want = {(a, b) for group in rest.values() for a in group for b in group if a < b and near(a, b)}
    want |= {tuple(sorted((w, r))) for (_, r), group in rest.items() for w in group if r in words}
    assert got == want


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == set()
