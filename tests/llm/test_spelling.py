import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callmill.llm import spelling

from . import plain


def found_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(plain.LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = found_words(rows)
    form, n_near = {}, {}
    for w in n:
        close = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        n_near[w] = len(close)
        form[w] = close[0] if close and n[close[0]] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], n_near[w], form[w], n[form[w]] if form[w] else None, root)
    return out


def got(docs):
    rows = spelling.variants(docs).collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def noisy(rng, letters, n_words, length):
    base = ["".join(rng.choices(letters, k=rng.randint(*length))) for _ in range(n_words)]
    out = []
    for w in base:
        out += [w] * rng.choice([2, 30, 300])
        for _ in range(rng.randint(0, 12)):
            i, how = rng.randrange(len(w)), rng.randrange(3)
            v = w[:i] + ("" if how == 0 else rng.choice(letters)) + w[i + (how < 2) :]
            out += [v] * rng.choice([1, 2, 3, 25])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, letters, length", [(1, "ab", (7, 9)), (2, "abcdefghéß×", (7, 12)), (3, "abAÉé", (62, 67)), (4, "ab", (63, 66))])
def test_variants_against_all_pairs(spark, seed, letters, length):
    rng = random.Random(seed)
    words = noisy(rng, letters, 40, length)
    rows = [(i, rng.choice([" ", ", ", "\n", "1"]).join(words[i::50])) for i in range(50)]
    want = plain_variants(rows)
    assert got(plain.docs(spark, rows)) == want
    assert any(v[2] for v in want.values()) and sum(v[1] for v in want.values()) > 50


def test_roots_follow_forms_to_the_end(spark):
    chain = [("aaaaaaaaa" + "b" * i + "c" * (8 - i), 2 * 10**i) for i in range(4)]
    # an id under which no letter is taken out
    doc_id = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w, _ in chain))
    found = got(plain.docs(spark, [(doc_id, " ".join(" ".join([w] * n) for w, n in chain))]))
    assert [found[w][2] for w, _ in chain] == [w for w, _ in chain[1:]] + [None]
    assert {v[4] for v in found.values()} == {chain[-1][0]}


def test_hashes_of_deletions():
    rng = random.Random(5)
    for _ in range(200):
        w = "".join(rng.choices("abcé", k=rng.randint(1, 12)))
        own = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        assert len(set(spelling.deletion_hashes(w).tolist())) == len(own)
    a, b = "x" * 70 + "y" + "z" * 70, "x" * 70 + "q" + "z" * 70
    assert set(spelling.deletion_hashes(a)) & set(spelling.deletion_hashes(b))
    assert set(spelling.deletion_hashes(a)) & set(spelling.deletion_hashes(a[:30] + a[31:]))


def test_edges(spark):
    assert got(plain.docs(spark, [])) == {}
    rows = [(None, None), (None, "spelling spelling"), (1, ""), (1, "spelling"), (1, "spelling"), (2, "short")]
    assert got(plain.docs(spark, rows)) == plain_variants(rows)
    long = "ab" * 2_000
    rows = [(3, long), (4, long), (5, long + "c"), (6, long + "c"), (7, long[:50] + "é" + long[51:]), (8, "words and " + long[:50] + "é" + long[51:])]
    assert got(plain.docs(spark, rows)) == plain_variants(rows)
    clash = plain.docs(spark, [(1, "spelling spelling"), (2, "spellings spellings")])
    for name in ("word", "n", "key", "form", "root", "id", "run"):
        clash = clash.withColumn(name, F.lit("old"))
    assert got(clash) == plain_variants([(1, "spelling spelling"), (2, "spellings spellings")])
    renamed = plain.docs(spark, [(1, "spelling spelling")]).toDF("a", "b", "lang", "source", "n_chars")
    assert spelling.variants(renamed, "a", "b").count() == len(plain_variants([(1, "spelling spelling")]))
