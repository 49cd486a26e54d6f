"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterline.llm import decontaminate as dc
from meterline.llm import jaccard_join as jj
from meterline.llm import line_dedup as ld
from meterline.llm import secret_scan as ss
from meterline.llm import token_output as to
from meterline.llm.bytewords import ALNUM, NOT_SPACE, words_of
from meterline.llm.components import connected_components
from meterline.llm.language_id import LanguageModel, fit_language, predict_language
from meterline.llm.mixing import mix_sources
from meterline.llm.quality import fit_quality, score_quality

ODD = [None, "", " ", "\n", "a", "Ünïcode wörds ÄÖ straße", "a\x00b  c\td", "x " * 3000, "...", "٣ 漢字 🙂"]


def docs(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, v in more.items():
        df = df.withColumn(k, F.lit(v))
    return df


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("classes, pattern", [(NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_equal_the_pattern(classes, pattern):
    w = words_of(pa.array(ODD, pa.string()), classes)
    for d, t in enumerate(ODD):
        got = [w.data[w.start[i] : w.end[i]].tobytes().decode() for i in range(w.first[d], w.first[d + 1])]
        assert got == re.findall(pattern, lower(t))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 4)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_components(texts, k=5):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(comp[i], comp[j])
            if comp[i] != m or comp[j] != m:
                comp[i] = comp[j] = m
                changed = True
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, comp))]


def near_copies(seed, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([3, 8, 20, 60, 200]))] for _ in range(25)]
    shared = [r.choice(vocabulary) for _ in range(30)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.3:
            w += shared
        out.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    return out


@pytest.mark.parametrize("tile", [2048, 4])
def test_jaccard_components(spark, monkeypatch, tile):
    monkeypatch.setattr(jj, "TILE", tile)  # the small one splits tiles and clusters
    texts = near_copies(tile) + ODD
    got = sorted(tuple(r) for r in jj.jaccard_components(docs(spark, texts, n_shingles="clash", component_id=1)).collect())
    assert got == brute_components(texts)


def test_jaccard_edges(spark):
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "z y x")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jj.jaccard_components(df).collect())
    assert got == [(-1, 1, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7)]


def test_overlap_bound_is_a_bound():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 2**63, r.integers(1, 80)).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([b, a[: r.integers(0, len(a) + 1)]]))
        bound = jj.overlap_bound(jj.bitmap(a, 128)[None], np.array([len(a)]), jj.bitmap(b, 128), len(b))[0]
        assert bound >= len(np.intersect1d(a, b)) == jj._common(a, b)


def brute_hits(texts, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for name, item in items:
            x = words(item)
            size = min(n, len(x))
            for i in range(len(x) - size + 1) if x else []:
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == x[i : i + size]:
                        hit |= set(range(p, p + size))
                        found.add(str(name))
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontaminate(spark, block):
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(r.choice([1, 2, 5, 13, 14, 40])))) for i in range(12)] + [(12, None), (13, "!!"), (14, ""), (9, "Repeated Words repeated words")]
    texts = [f"Intro, {a[1]}! outro {b[1]}" if r.random() < 0.7 else f"{a[1][: len(a[1]) // 2]} x" for a, b in zip(r.choices(items[:12], k=40), r.choices(items[:12], k=40))] + ODD
    texts += [texts[0], texts[0], ("filler word, " * 60_000) + items[0][1] + (" more of it" * 60_000)]  # repeated, and long
    found = dc.decontaminate(docs(spark, texts, items="clash", row=1), spark.createDataFrame(items, "item_id int, text string"), index_windows=block)
    got = sorted((x.row.doc_id, x.n_words, x.n_hit, list(x["items"]), x.contaminated) for x in found.collect())
    assert got == brute_hits(texts, items)
    empty = dc.decontaminate(docs(spark, ["a b"]), spark.createDataFrame([], "item_id int, text string")).collect()
    assert [(x.n_words, x.n_hit, x.contaminated) for x in empty] == [(2, 0, False)]
    assert dc.decontaminate(docs(spark, []), spark.createDataFrame(items, "item_id int, text string"), index_windows=block).count() == 0


def brute_lines(rows, least=10):
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    r = random.Random(2)
    pool = ["short", "  A shared licence line ", "a shared Licence line", "ÄÖÜÄÖÜÄÖÜÄ", "äöüäöüäöüä", "ÄÖÜÄÖÜÄÖÜ", "", "漢字漢字漢字漢字漢字", "x\x1c" * 6] + [f"line number {i} of the pool" for i in range(30)]
    rows = [(i, "\n".join(r.choices(pool, k=r.randrange(1, 9)))) for i in range(80)] + [(100 + i, t) for i, t in enumerate(ODD)]
    for batches, fan in ((4, 2), (7, 2), (1, 2)):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1))
        got = sorted((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in ld.dedup_lines(df, batches=batches, fan_out=fan).collect())
        assert got == brute_lines(rows)
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    odd = spark.createDataFrame([(None, "a line of some length"), (3, "a line of some length"), (3, "a line of some length"), (4, "a line of some length")], "doc_id bigint, text string")
    assert sorted((x.doc_id or -1, x.n_dropped) for x in ld.dedup_lines(odd).collect()) == [(-1, 0), (3, 0), (3, 0), (4, 1)]


def test_secrets(spark):
    r = random.Random(4)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [f'é token = "{x}" end' for x in hexes] + [f"AKIA{''.join(r.choice('ABCDEFGHIJ0123456789') for _ in range(16))} x" for _ in range(40)]
    texts += ["password: short", "PassWd=abc: secret=abcdefgh", "AKIA123", "api_key = 'a.b/c+d='", "thisisaverylongwordwithoutdigits andanotherverylongword", *ODD, f"key was {hexes[0][:38].upper()} here"]
    df = docs(spark, texts, spans=1)
    model = ss.fit_secrets(df)
    got = {x.row.doc_id: [(s.kind, s.start, s.end) for s in x.spans] for x in ss.scan_secrets(df, model).collect()}
    base = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        t = t or ""
        want = [("assign", m.start(), m.end()) for m in base.finditer(t) if len(m[2]) >= 6] + [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [s for s in got[i] if s[0] in ss.KINDS] == sorted(want, key=lambda s: (s[1], ss.KINDS.index(s[0])))
    assert got[104] == []  # long plain words are no secrets
    assert set(model.formats) == {"assign", "access", "hex"} and len(model.formats["hex"].moves) < 200
    assert model.kind_of(hexes[1]) and not model.kind_of("abcabcabcabcabcabcabc")


def test_inference_learns_the_format():
    words = [ss.classes("AB" + "12" * n) for n in range(1, 9) for _ in range(20)]
    a = ss.infer(words)
    floor = -9.0
    assert len(a.moves) < 10
    assert a.score(ss.classes("AB121212"), floor) > a.score(ss.classes("abAB12"), floor) > a.score(ss.classes("zz/zz/zz"), floor)


def test_tokens(spark, tmp_path):
    texts = ODD + ["The quick  brown fox", " lead", "trail ", "a\n\nb", "it's we'll x.\nNew, (line)", "many words " * 400] + near_copies(1, 60)
    rows = [(900 - i, t) for i, t in enumerate(texts)] + [(5, "twice"), (5, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit(1))
    out = to.token_output(df, path=str(tmp_path / "t"), group=500).collect()
    encoder = to.Encoder(to.vocabulary(), most=40)  # forgets most of the time
    for _ in range(2):
        got, sizes = encoder(pa.array([t or "" for t in texts]))
        assert [x.tolist() for x in np.split(got, np.cumsum(sizes)[:-1])] == [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = encoder.library.encode(t or "", add_special_tokens=False).ids + [0]
        raw = np.array(raw, "<u4").tobytes()
        want.append((i, at, len(raw) // 4, zlib.crc32(raw), raw))
        at += len(raw) // 4
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in out) == [(s, i, n, c, raw) for i, s, n, c, raw in want]
    assert to.token_output(df.limit(0), path=str(tmp_path / "e")).count() == 0


def test_mixing(spark):
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)), r.choices(["a", "b", "c", "d", None], [50, 20, 10, 5, 5])[0]) for i in range(2000)] + [(5000, None, "z"), (5001, "", "z"), (5001, "", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    out = mix_sources(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    total, left = 1.5 * sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1, 5, 2, 1, 5]))
    target = {}
    while left:  # water filling, round by round
        budget = total - sum(target.values())
        full = [s for s in left if budget * left[s] / sum(left.values()) >= 2 * sizes[s]]
        for s in full or list(left):
            target[s] = 2 * sizes[s] if full else budget * left[s] / sum(left.values())
        left = {s: w for s, w in left.items() if s not in target}
    taken = {}
    for x in out:
        assert abs(x.target - target[x.source]) < 1e-6 * total and x.source_size == sizes[x.source] and x.taken <= 2 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - target[s]) <= 80 for s in sizes) and sum(taken.values()) <= total
    assert sorted((x.doc_id, x.taken) for x in out) == sorted((x.doc_id, x.taken) for x in mix_sources(df.repartition(7)).collect())
    assert mix_sources(df.limit(0)).count() == 0


def test_language(spark):
    r = random.Random(1)
    word = {"xx": lambda: "".join(r.choice(["th", "er", "on", "an", "re"]) for _ in range(3)), "yy": lambda: "".join(r.choice(["ção", "os", "que", "lhe"]) for _ in range(3))}
    rows = [(i, " ".join(word[lang]() for _ in range(30)), lang) for i in range(200) for lang in [r.choice(["xx", "yy"])]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit(1))
    model = fit_language(df)
    got = predict_language(df, model, keep=("doc_id", "lang")).collect()
    assert sum(x.lang_pred == x.row.lang for x in got) > 195 and all(0 <= x.score <= 1 for x in got)
    odd = {x.row.doc_id: (x.lang_pred, x.score) for x in predict_language(docs(spark, ODD + ["x" * 2_000_000]), model).collect()}
    assert [odd[i][0] == "und" for i in range(5)] == [True, True, True, True, False] and odd[8] == ("und", 0.0) and odd[len(ODD)][0] in ("xx", "yy")
    assert [x.lang_pred for x in predict_language(docs(spark, ["a b"]), fit_language(df.where("lang = 'none'"))).collect()] == ["und"]
    assert isinstance(fit_language(df.limit(0)), LanguageModel)


def test_quality(spark):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["the", "river", "was", "calm", "and", "old."]) for _ in range(40))
    bad = lambda: " ".join(r.choice(["BUY!!", "NOW$$$", "CLICK###", "free%%%"]) for _ in range(40))
    y = [int(r.random() < 0.7) for _ in range(400)]
    df = docs(spark, [good() if v else bad() for v in y], score=3)
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)] + [(None, 1, 0), (3, None, 0), (99999, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = fit_quality(df, labels)
    got = {x.row.doc_id: x.score for x in score_quality(df, model).collect()}
    assert sum((got[i] >= 0.7) == bool(v) for i, v in enumerate(y)) > 390
    odd = score_quality(docs(spark, ODD), model).collect()
    assert all(0 <= x.score <= 1 for x in odd)
    assert {x.score for x in score_quality(df, fit_quality(df, labels.limit(0))).collect()} == {0.5}
    assert {x.score for x in score_quality(df, fit_quality(df, labels.where("quality = 1"))).collect()} == {1.0}


def test_items_digest():
    assert dc.digest(["1", "10"]) == hashlib.sha256(b"1,10").hexdigest()
