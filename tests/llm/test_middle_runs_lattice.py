"""Fill-in-middle, periodic runs and lattice near-dedup against plain loops, and on odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterline.llm import fill_in_middle as fm
from meterline.llm import lattice_dedup as ld
from meterline.llm import queries
from meterline.llm.periodic_runs import find_runs, runs

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in middle


def brute_fim(doc_id, text, percent=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def odd_texts():
    r = random.Random(4)
    line = lambda: "".join(r.choice("abc äß漢😀\t\r\x0b\x85 ") for _ in range(r.randrange(40)))
    long = "\n".join(line() for _ in range(60_000))
    out = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "no line end " * 3000, "with <P> in it\nx", "<M>", "<p>\n<Q>", long, long + "\n", "\n" * 50_000, "é" * 30_000, long[:5000] * 4]
    return out + ["\n".join(line() for _ in range(r.randrange(30))) + r.choice(["", "\n"]) for _ in range(60)]


def test_fill_in_middle_equals_plain_loops(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a\nb\nc"), (5, "again\nthe same id\n"), (5, "again\nthe same id\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit("clash")).withColumn("output", F.lit(1)).withColumn("draws", F.lit(1))
    for more in ({}, {"percent": 40, "spm_percent": 20}):
        made = fm.fill_in_middle(docs, ["doc_id", "text", "output"], **more).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
        assert len(made) == len(rows)
        for x in made:
            assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == brute_fim(x.row.doc_id, x.row.text, more.get("percent", 100), more.get("spm_percent", 50))
            assert x.back == (x.row.text or "")
    assert fm.fill_in_middle(docs.limit(0), ["doc_id"]).count() == 0


def test_other_sentinels(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb.\nc|\nd\n") for i in range(30)] + [(99, "has [.*] in it\n")], "doc_id bigint, text string")
    marks = ("[.*]", "(?:", "a|b$")
    made = fm.fill_in_middle(docs, ["doc_id", "text"], sentinels=marks).withColumn("back", fm.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(x.back == x.row.text for x in made) and {x.form for x in made if x.row.doc_id == 99} == {"plain"} and len({x.form for x in made}) == 3


def test_chunks_depend_on_content_and_are_compared():
    r = random.Random(1)
    passage = bytes(r.randrange(256) for _ in range(40_000))

    def cut(text):
        ends = fm.chunk_ends(fm.rolling(np.frombuffer(text, np.uint8)))
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    one, two = cut(b"x" * 777 + passage), cut(b"another beginning" * 99 + passage)
    assert b"".join(one) == b"x" * 777 + passage and len(set(one) & set(two)) >= len(one) - 4 > 5
    assert max(map(len, cut(b"\0" * 100_000))) <= fm.MOST and cut(b"") == []
    memo = fm.Memo(most=3 * fm.MOST)
    for chunk in one + one + two:
        assert memo.summary(chunk) == (chunk.count(b"\n"), sum(c & 0xC0 != 0x80 for c in chunk)) and memo.held <= memo.most
    memo = fm.Memo()
    memo.known[zlib.crc32(b"real\n"), 5] = b"fake\n", (7, 7)  # another chunk of the same checksum
    assert memo.summary(b"real\n") == (1, 5)
    direct = np.array([sum(int(fm._GEAR[b]) << (31 - k) for k, b in enumerate(passage[i - 31 : i + 1])) % (1 << 64) for i in (31, 500)], np.uint64)
    assert (fm.rolling(np.frombuffer(passage, np.uint8))[[31, 500]] == direct).all()


# --- periodic runs


def brute_runs(s, exponent=2, least=2):
    n, found = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((a, size, q) for (a, size), q in found.items())


def brute_found(text, exponent=4, least=6):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    got = sorted(brute_runs(words, exponent, least), key=lambda x: (x[0], x[2]))
    gone = {i for a, n, q in got for i in range(a + q, a + n)}
    return got, " ".join(w for i, w in enumerate(words) if i not in gone), len(words)


def test_runs_equal_plain_loops():
    r = random.Random(2)
    for _ in range(800):
        letters = r.choice([1, 2, 3, 5])
        s = [r.randrange(letters) for _ in range(r.randrange(60))]
        if s and r.random() < 0.4:
            a, p = r.randrange(len(s)), 1 + r.randrange(8)
            s = [s[i] if i < a else s[min(a + (i - a) % p, len(s) - 1)] for i in range(len(s))]
        for exponent, least in ((2, 2), (4, 6)):
            assert sorted(map(tuple, runs(np.array(s, np.int64), exponent, least).tolist())) == brute_runs(s, exponent, least)


def test_many_documents_in_one_step_and_odd_texts(spark):
    r = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 6), (5, "a " * 5), (6, "a b a b a b a b"), (7, "x y " * 3 + "z"), (8, "a b c " * 30_000), (9, "w\x85é\xa0 " * 9), (9, "w\x85é\xa0 " * 9), (None, "A a A a A a A a A")]
    rows += [(100 + i, " ".join(r.choice(["ab", "cd", "ef"]) for _ in range(r.randrange(80))) + r.choice(["", " go on" * r.randrange(9)])) for i in range(300)]
    rows += [(500, " ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(150_000)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(3)).coalesce(2)
    got = find_runs(docs, ["doc_id", "text", "runs"]).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.row.doc_id not in (8, 500):
            assert ([tuple(y) for y in x.runs], x.collapsed, x.n_words) == brute_found(x.row.text)
    long = {x.row.doc_id: x for x in got}
    assert [tuple(y) for y in long[8].runs] == [(0, 90_000, 3)] and long[8].collapsed == "a b c" and long[500].n_words == 150_000
    assert find_runs(docs.limit(0), ["doc_id"]).count() == 0


def test_periodic_runs_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            continue
        found, collapsed, _ = brute_found(" ".join(words))
        planted += h % 10 == 0 and bool(found)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        x = got[d.doc_id]
        assert (x.n_runs, x.start, x.length, x.period) == (len(found), *best) and x.exponent_milli == (best[0] is not None and 1000 * best[1] // best[2] or None)
        assert (x.runs_sha256, x.collapsed_sha256) == (sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(collapsed))
    assert planted > 5


# --- lattice near-dedup


def test_shortest_vectors_and_decoding():
    v = ld.shortest_vectors()
    assert len({tuple(x) for x in v}) == 240 and ((v**2).sum(axis=1) == 2).all()
    y = np.random.default_rng(1).normal(0, 2, (2000, 8))
    p = ld.nearest_e8(y)
    doubled = (2 * p).astype(int)
    assert (doubled == 2 * p).all() and (p.sum(axis=1) % 2 == 0).all() and ((doubled % 2).sum(axis=1) % 8 == 0).all()  # points of the lattice
    own = ((y - p) ** 2).sum(axis=1)
    assert own.max() <= 1 + 1e-9 and all((((y - (p + s)) ** 2).sum(axis=1) >= own - 1e-9).all() for s in v)  # no neighbour is nearer; none beyond the covering radius


def brute_components(rows, cosine=0.9):
    """By row: links, component, kept. Also the linked pairs."""
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / max(np.abs(v)) if k else None for k, (_, v) in zip(ok, rows)]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    n = len(rows)
    links = {(i, j) for i in range(n) for j in range(n) if i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine}
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    number = [sum(1 for j in range(n) if (i, j) in links) for i in range(n)]
    component = [least.get(find(i)) if ok[i] else rows[i][0] for i in range(n)]
    return [(rows[i][0], number[i], component[i], component[i] is None or rows[i][0] == component[i]) for i in range(n)]


def near(rng, v, cosine):
    other = rng.standard_normal(len(v))
    unit = v / np.linalg.norm(v)
    other -= (other @ unit) * unit
    return cosine * unit + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def as_set(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_lattice_equals_brute_force_on_families_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = [rng.standard_normal(32) for _ in range(12)]
    rows = [(i, b.tolist()) for i, b in enumerate(base)]
    rows += [(100 + i, near(rng, base[i % 5], 0.97 + 0.02 * rng.random()).tolist()) for i in range(60)]
    rows += [(200 + i, base[7].tolist()) for i in range(40)] + [(7, base[7].tolist()), (7, base[8].tolist()), (None, base[9].tolist()), (None, (base[9] * 3).tolist()), (301, (base[9] * 1e200).tolist()), (302, (base[9] * 1e-200).tolist())]
    rows += [(400, None), (401, []), (402, [0.0] * 32), (403, [1.0, None] + [0.0] * 30), (404, [float("nan")] + [1.0] * 31), (405, [float("inf")] * 32), (400, None), (None, None), (410, [1.0, 2.0]), (411, [2.0, 4.0]), (412, [1.0]), (413, [-1.0]), (414, [3.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("node", F.lit("clash")).withColumn("n_links", F.lit(1))
    want = as_set(brute_components(rows))
    for tile in (ld.TILE, 8):  # whole cells, and cells cut into many tiles
        assert as_set(ld.lattice_components(table, tile=tile).collect()) == want
    assert ld.lattice_components(table.limit(0)).count() == 0 and ld.lattice_components(table.where("vec_id > 399 and vec_id < 406")).count() == 7


def test_recall_at_the_threshold_and_no_false_link(spark):
    rng = np.random.default_rng(9)
    rows, pairs = [], 600
    for i in range(pairs):
        v = rng.standard_normal(64)
        rows += [(2 * i, v.tolist()), (2 * i + 1, near(rng, v, 0.901 if i % 2 else 0.95).tolist())]
    rows += [(5000 + i, near(rng, np.array(rows[2 * i][1]), 0.89).tolist()) for i in range(200)]
    got = {r.vec_id: r for r in ld.lattice_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    want = {r[0]: r for r in brute_components(rows)}
    assert all(got[i].n_links <= want[i][1] and got[i].component_id >= want[i][2] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.96 * sum(r[1] for r in want.values())


def test_a_pair_counts_once_whatever_tables_it_meets_in():
    rng = np.random.default_rng(2)
    v = rng.standard_normal(16)
    x = np.array([near(rng, v, 0.985) for _ in range(60)])
    own, probed = ld.cells(x, 0.9, 3, 1, 4)
    tiles, seen = ld.Tiles(0.9, 3, 1, 4), {}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for t in range(3):
        for key in np.unique(np.concatenate((own[:, t], probed[:, t].ravel()))):
            rows = np.flatnonzero((own[:, t] == key) | (probed[:, t] == key).any(axis=1))
            home = own[rows, t] == key
            n = len(rows)
            i, j = tiles.linked(x[rows], np.array([n]), home, np.zeros(n, int), np.zeros(n, bool))
            if len(i):
                new = tiles.first(i, j, x[rows], rows, home, np.full(n, t))
                for a, b in zip(rows[i[new]], rows[j[new]]):
                    seen[a, b] = seen.get((a, b), 0) + 1
    assert set(seen.values()) == {1}
    meets = lambda a, b: any(own[a, t] == own[b, t] or own[a, t] in probed[b, t] or own[b, t] in probed[a, t] for t in range(3))
    assert set(seen) == {(a, b) for a in range(60) for b in range(a + 1, 60) if unit[a] @ unit[b] >= 0.9 and meets(a, b)}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_lattice_query_finds_all_links_of_the_given_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    m = np.array([v for _, v in rows], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = {i: int(n) - 1 for (i, _), n in zip(rows, (m @ m.T >= 0.9).sum(axis=1))}
    got = {r.vec_id: r.n_links for r in queries.op12_lattice_dedup(spark, f"/root/testdata/{sf}").collect()}
    assert got == want


def test_joined_words_and_arrow_slices():
    texts = pa.array(["skip", None, " one  two ", "", "three"]).slice(1)
    from meterline.llm.bytewords import NOT_SPACE, words_of
    from meterline.llm.periodic_runs import _joined

    w = words_of(texts, NOT_SPACE, lower=False)
    assert _joined(w, np.ones(3, bool)).to_pylist() == ["", "one two", "", "three"] and _joined(w, np.array([False, True, False])).to_pylist() == ["", "two", "", ""]
