"""Spelling variants against brute force, and their defined cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

from feedlake.llm import variants
from feedlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def counted(docs):
    n = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def grouped(n):
    """(word -> form, root, n, n_near, form_n); near words meet where one deletion makes them
    equal, or two deletions at one place."""
    cells = defaultdict(set)
    for w in n:
        cells["=", w].add(w)
        for i in range(len(w)):
            cells["=", w[:i] + w[i + 1:]].add(w)
            cells[i, w[:i], w[i + 1:]].add(w)
    near = defaultdict(set)
    for key, ws in cells.items():
        for a in ws:
            for b in ws:
                if a != b and (key[0] != "=" or abs(len(a) - len(b)) == 1):
                    near[a].add(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = grouped(counted(docs))
    assert found(QUERIES["op12_variants"](spark, SF)) == want
    assert any(v[0] for v in want.values())


def test_dense_vocabulary(spark):
    """Few letters, so that runs of a letter and words with many near words abound."""
    rng = random.Random(2)
    n = {}
    while len(n) < 900:
        n["".join(rng.choice("abé") for _ in range(rng.randint(5, 9)))] = rng.randint(3, 400)
    n |= {"aaaaa": 700, "aaaaaa": 90, "aaaaaaa": 30, "aaaaaaaa": 11, "x" * 3000: 3, "x" * 3001: 9, "x" * 2999 + "y": 20}
    got = variants.group(spark.createDataFrame(sorted(n.items()), "word string, n long"))
    assert found(got) == grouped(n)


def test_acceptor_is_minimal_and_composition_whole():
    rng = random.Random(4)
    strings = sorted({"".join(rng.choice("abc") for _ in range(rng.choice((4, 5)))) for _ in range(150)})
    acceptor = variants.Acceptor(strings)
    languages = set()

    def language(state):
        return frozenset([""] if acceptor.final[state] else []) | {
            c + s for c, t in acceptor.arcs[state].items() for s in language(t)}
    for state in range(len(acceptor.arcs)):
        languages.add(language(state))
    assert language(acceptor.start) == set(strings) and len(languages) == len(acceptor.arcs)
    short, longer = [s for s in strings if len(s) == 4], [s for s in strings if len(s) == 5]
    want = {(a, b) for a in short for b in short if a < b and sum(x != y for x, y in zip(a, b)) == 1}
    want |= {(a, b) for a in short for b in longer if any(b[:i] + b[i + 1:] == a for i in range(5))}
    assert set(variants.near_pairs(acceptor, 4)) == want


def test_defined_cases(spark):
    text = " ".join(["Colour colour COLOUR colour colour colour color color color"] * 1)
    docs = [(1, text), (2, None), (3, ""), (None, "Étude étude"), (1, text), (4, "word " * 2),
            (5, "z" * 5000 + " " + "z" * 5000 + " " + "z" * 5000), (6, "a1b2 \n\t --")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'w' AS word", "1 AS n", "2 AS length", "3 AS id", "4 AS run")
    got = found(variants.group(variants.vocabulary(variants.words(df))))
    assert got == grouped({"colour": 12, "color": 6, "z" * 5000: 3}) and got["color"][:2] == ("colour", "colour")
    assert found(variants.group(variants.vocabulary(variants.words(df, drop_every=97)))) == grouped(counted(docs))
    assert variants.group(variants.vocabulary(variants.words(df.limit(0)))).count() == 0


def test_roots_of_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)]
    got = {r["word"]: r["root"] for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w37" for i in range(37)}
