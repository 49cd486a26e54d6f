"""Every operator on very long texts, repeated rows, ties, nulls, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import decontaminate as dc
from meterline.llm import html_extract as he
from meterline.llm import jaccard_join as jj
from meterline.llm import token_output as to
from meterline.llm.language_id import FEATURES, LanguageModel, fit_language, predict_language
from meterline.llm.line_dedup import dedup_lines
from meterline.llm.mixing import mix_sources
from meterline.llm.quality import fit_quality, score_quality

WORDS = ["river", "flood", "sand", "bed", "stone", "delta", "bank", "water", "rain", "snow"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


LONG = prose(0, 200_000)  # about 1.6 MB


def table(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


def test_language(spark):
    r = random.Random(1)
    word = lambda letters: "".join(r.choice(letters) for _ in range(6))
    text = lambda letters, n=30: " ".join(word(letters) for _ in range(n))
    rows = [(i, text("abcdefg" if i % 2 else "nopqrst"), "xx" if i % 2 else "yy") for i in range(80)] + [(500, None, "xx"), (501, "", "yy"), (502, "12 .,", None), (None, text("abcdefg"), "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))
    model = fit_language(docs)
    odd = [(1, None), (2, ""), (3, "12 ., !"), (4, text("abcdefg", 200_000)), (5, text("nopqrst")), (5, rows[0][1]), (5, rows[0][1]), (None, rows[1][1]), (6, "zzz " * 10)]
    got = [(x.row.doc_id, x.lang_pred, x.score) for x in predict_language(table(spark, odd, lang_pred="clash"), model).collect()]
    by = sorted((i or -1, p) for i, p, _ in got)
    assert by[:4] == [(-1, "xx"), (1, "und"), (2, "und"), (3, "und")] and (4, "xx") in by and by.count((5, "yy")) == 3 and len(by) == 9
    assert all(0 <= s <= 1 for _, _, s in got)
    none = fit_language(docs.limit(0))
    assert {(x.lang_pred, x.score) for x in predict_language(docs, none).collect()} == {("und", 0.0)} and predict_language(docs.limit(0), model).count() == 0


def test_languages_equally_likely(spark):
    """The first by name, with the score that they share."""
    for names in (["aa", "bb", "cc"], ["bb", "cc"]):
        model = LanguageModel(names, np.zeros((FEATURES, len(names))), np.ones(FEATURES))
        got = [(x.lang_pred, x.score) for x in predict_language(table(spark, [(1, "some words"), (2, LONG), (3, "")]), model).collect()]
        assert sorted(got) == sorted([(names[0], pytest.approx(1 / len(names)))] * 2 + [("und", 0.0)])


def test_token_files_of_very_long_texts(spark, tmp_path):
    """Texts beyond a step and a group, without any white space too; equal and null ids; null and empty texts."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(to.vocabulary())
    r = random.Random(7)
    mixed = " ".join(r.choice(["straße", "naïve", "水と石", "end.", "x,y", "\u00a0", "tab\t", "a\n\nb"]) for _ in range(450_000))
    assert len(mixed.encode()) > to.STEP
    rows = [(None, "no id"), (1, None), (2, mixed), (3, ""), (3, LONG), (3, LONG), (4, "水" * 50_000), (5, "tail")]
    got = to.token_output(table(spark, rows, start="clash", ids=1), path=str(tmp_path / "t"), group=100_000).orderBy("start").collect()
    assert [x.doc_id for x in got] == [None, 1, 2, 3, 3, 3, 4, 5]
    start = 0
    for x, (_, text) in zip(got, rows):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert bytes(x.ids) == want and x.n_tokens == len(want) // 4 and x.start == start and x.ids_crc32 == zlib.crc32(want)
        start += x.n_tokens


def test_jaccard(spark):
    rows = [(3, LONG), (2, LONG + " tail"), (7, LONG.replace("river1 ", "x ", 3)), (9, prose(5, 300)), (9, prose(5, 300)), (11, ""), (12, None)]
    got = sorted((x.doc_id, x.component_id) for x in jj.jaccard_components(table(spark, rows, n_shingles="clash", set_id=1)).collect())
    assert got == [(2, 2), (3, 2), (7, 2), (9, 9), (9, 9), (11, 11), (12, 12)]


def test_a_family_of_near_copies_spread_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(jj, "TILE", 16)
    r = random.Random(3)
    base = prose(1, 60).split()

    def near(i):
        own = list(base)
        own[i % 60] = f"edit{i}"
        return " ".join(own)

    chain, link = [], prose(2, 40).split()
    for i in range(30):  # each like the next, the first unlike the last
        link = [*link[1:], f"next{i}"]
        chain.append(" ".join(link))
    rows = [(i, near(i)) for i in range(150)] + [(1000 + i, t) for i, t in enumerate(chain)] + [(2000 + i, " ".join(base[:30]) + " " + prose(50 + i, 60)) for i in range(20)]
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in jj.jaccard_components(table(spark, rows)).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    want = {i: i for i in sets}
    ids, changed = sorted(sets), True
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(want[a], want[b])
            changed |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    assert got == want


def test_lines(spark):
    lines = [f"a line of its own {i}" for i in range(60_000)]
    rows = [(2, "\n".join(lines)), (1, "a shared line, first\n" + lines[5]), (3, "  A Shared Line, FIRST \nshort\n" + lines[7] + "\nshort"), (3, "short"), (4, None), (5, ""), (6, "short")]
    got = {(x.doc_id, x.n_lines): x for x in dedup_lines(table(spark, rows, n_dropped="clash", key=2)).collect()}
    assert got[2, 60_000].n_dropped == 1 and got[2, 60_000].text == "\n".join(x for x in lines if x != lines[5])
    assert got[3, 4].n_dropped == 2 and got[3, 4].text == "short\nshort" and got[1, 2].n_dropped == 0
    assert got[4, 1].n_dropped == got[5, 1].n_dropped == 0 and len(got) == 7
    assert dedup_lines(table(spark, rows).limit(0)).count() == 0


def test_quality(spark):
    rows = [(i, prose(i, 40) if i % 2 else "!!! BUY $$$ NOW !!! " * 8) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] * 2 + [(None, 1), (3, None)], "doc_id bigint, quality int").withColumn("text", F.lit("clash"))
    docs = table(spark, rows + rows[:10], score="clash")
    model = fit_quality(docs, labels)
    odd = [(1, None), (2, ""), (3, LONG), (4, rows[1][1]), (4, rows[1][1]), (None, rows[0][1]), (5, "\n\t ")]
    got = [(x.row.doc_id, x.score) for x in score_quality(table(spark, odd, vectors=1), model).collect()]
    assert len(got) == 7 and all(0 <= s <= 1 for _, s in got)
    by = {}
    for i, s in got:
        by.setdefault(i, set()).add(round(s, 9))
    assert by[1] == by[2] == by[5] and len(by[4]) == 1 and min(by[4]) > 0.5 > max(by[None])
    none = fit_quality(docs.limit(0), labels)
    assert score_quality(docs.limit(0), none).count() == 0
    assert {x.score for x in score_quality(docs, fit_quality(docs, labels.limit(0))).collect()} == {0.5}


def test_mixing(spark):
    rows = [(1, LONG, "a"), (2, None, "a"), (3, "", None), (4, "w w w", "b"), (4, "w w w", "b"), (4, "w", "b"), (None, "w " * 10, None), (5, "w " * 400, "b")] + [(100 + i, "w " * 50, "a") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash")).withColumn("ends", F.lit(1))
    got = mix_sources(docs).collect()
    assert len(got) == len(rows) and {x.size for x in got if x.doc_id == 1} == {200_000}
    assert all(x.taken <= 2 * x.size and x.copies in (0, 1, 2) for x in got)
    for s in ("b", None):
        mine = [x for x in got if x.source == s]
        assert sum(x.taken for x in mine) <= mine[0].target + max(x.size for x in mine)
    assert sorted((x.doc_id or 0, x.size, x.taken) for x in mix_sources(docs).collect()) == sorted((x.doc_id or 0, x.size, x.taken) for x in got)
    assert mix_sources(docs.limit(0)).count() == 0


def test_contamination(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(1, LONG + " " + item), (2, item.upper()), (2, item.upper()), (3, None), (4, ""), (None, item)]
    bench = spark.createDataFrame([("x", item), ("x", item), ("y", item), (None, ""), ("z", None)], "item_id string, text string").withColumn("doc_id", F.lit(9))
    for windows in (dc.INDEX_WINDOWS, 2):
        got = sorted((x.row.doc_id or 0, x.n_words, x.n_hit, tuple(x["items"]), x.contaminated) for x in dc.decontaminate(table(spark, rows, hits=1, tkey="clash"), bench, index_windows=windows).collect())
        assert got == [(0, 20, 20, ("x", "y"), True), (1, 200_020, 20, ("x", "y"), False), (2, 20, 20, ("x", "y"), True), (2, 20, 20, ("x", "y"), True), (3, 0, 0, (), False), (4, 0, 0, (), False)]


def test_pages(spark):
    body = "".join(f"<p>Paragraph {i} of a long article, which says one thing after another, and ends.</p>" for i in range(8000))
    page = f"<html><body><nav><a href=1>Home</a></nav><article><h1>A title</h1>{body}</article><footer>All rights reserved.</footer></body></html>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "u", "<p>"), (3, "u", "&#x41;&amp;<br>b")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_blocks", F.lit(1))
    got = [(x.row.page_id, x.text) for x in he.extract_text(df, he.fit_blocks(df)).collect()]
    long = [t for i, t in got if i == 1]
    assert len(long) == 2 and long[0] == long[1] and long[0].count("\n") == 8000 and "Home" not in long[0] and "rights" not in long[0]
    assert dict(got)[2] == "" and dict(got)[None] == "" and len(got) == 5
    assert hashlib.sha256(long[0].encode()).hexdigest() and isinstance(np.float64(1), float)


@pytest.mark.parametrize("operator", ["language", "pages"])
def test_nothing_at_all(spark, operator):
    if operator == "language":
        assert fit_language(spark.createDataFrame([], "doc_id bigint, text string, lang string")).languages == []
    else:
        assert np.array_equal(he.fit_blocks(spark.createDataFrame([], "page_id bigint, html string")), he.PRIOR)
