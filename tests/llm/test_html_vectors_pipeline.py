"""HTML extraction, nearest neighbours, range coding, the pipeline, and the registry without this subpackage."""

import itertools
import os
import random
import re
import shutil
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import html_extract as he
from meterline.llm import nearest, rans

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x:1}}</style><script>var a="</p><article>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="ad banner">Buy this now. Really, now.</div>
<article><h1>A &amp; B title</h1><p>First   paragraph with <b>bold</b> text, and&nbsp;more words.<br>Second line of it.<p>Unclosed paragraph, which is followed by others.
<div class="share-tools"><a href=x>Share</a></div><p>{extra}</p><!-- no --><form><label>Mail</label><input></form></article>
<aside>Related things to read.</aside><section id="comments"><p>I liked this article, it was good to read.</p></section><footer>&copy; 2024 Somebody, all rights reserved.</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE.format(extra="The last one ends here.")), (2, "u", None), (3, "u", ""), (4, "u", PAGE.format(extra="cut off")[:700]), (5, "u", "plain text only, without any tag at all; it is a sentence."), (5, "u", "<<<>>> & &lt;"), (6, "u", "<p>" * 3000 + "deep text in many paragraphs, " * 50)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = [(x.row.page_id, x.text) for x in he.extract_text(df, he.fit_blocks(df)).collect()]
    by = dict(got)
    assert by[1] == "A & B title\nFirst paragraph with bold text, and more words. Second line of it.\nUnclosed paragraph, which is followed by others.\nThe last one ends here."
    assert by[2] == by[3] == "" and by[4].startswith("A & B title\nFirst paragraph") and len(got) == 7 and "deep text" in by[6]
    assert ("u", 5, "plain text only, without any tag at all; it is a sentence.") in [("u", i, t) for i, t in got]
    assert he.extract_text(df.limit(0), he.fit_blocks(df.limit(0))).count() == 0


SENTENCES = "The river changed its bed again in that year, and the old bridge stood in a meadow. Nobody had seen it coming, though the signs were there for all to read. "
LOST = [
    "".join(f"<div>{SENTENCES * 4}</div>" for _ in range(5)),
    f"<table><tr><td>{SENTENCES * 6}</td></tr></table>",
    SENTENCES * 5,
    "<br>".join([SENTENCES * 2] * 4),
]


def test_no_page_is_lost_by_the_fit(spark):
    """Pages of another make than those that the weights come from."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = he.fit_blocks(pages)
    assert len(weights) == he.FEATURES + 2
    for page in LOST:
        assert he.extracted(f"<html><body>{page}</body></html>", weights) == he.content(f"<html><body>{page}</body></html>", he.PRIOR) == [b.text for b in he.blocks_of(page)] != []
    menu = "<ul>" + "".join(f"<li><a href={i}>Entry {i}</a>" for i in range(9)) + "</ul>"
    assert he.extracted(f"<body>{menu}{LOST[0]}{menu}</body>", weights) == [b.text for b in he.blocks_of(LOST[0])]
    assert he.extracted("plain text only, without any tag at all; it is a sentence.", weights) == ["plain text only, without any tag at all; it is a sentence."]


def test_edges_change_pages(spark):
    """Short lines inside a long text, and a lone sentence among links: cuts without edges label them wrongly."""
    weights = he.fit_blocks(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    r = random.Random(8)
    changed = right = 0
    for i in range(60):
        body = [SENTENCES * r.randrange(1, 3) if r.random() < 0.7 else r.choice(["Yes", "He said no", "1985", "Then what"]) for _ in range(12)]
        prose = "p" if i % 2 else "div"  # the weights know the text of one kind of page, PRIOR that of the other
        page = f"<body><div>{''.join(f'<div><a href={k}>Link {k}</a></div>' for k in range(6))}</div><div>{''.join(f'<{prose}>{t}</{prose}>' if len(t) > 20 else f'<div>{t}</div>' for t in body)}</div></body>"
        want = [" ".join(t.split()) for t in body]
        cut, alone = he.extracted(page, weights), he.extracted(page, np.append(weights[: he.FEATURES], [0.0, 0.0]))
        changed += cut != alone
        right += sum(t in cut for t in want) - sum(t in alone for t in want)
    assert changed >= 30 and right > 30


@pytest.mark.parametrize("page", [f"<main><article>{SENTENCES}</article><div class='comments'><article>A reader wrote this, and meant it.</article></div></main>", f"<article><p>{SENTENCES}</p></article><div id='comments'><article><p>A reader wrote this, and meant it.</p></article></div>"])
def test_comments_after_an_article(page):
    assert he.content(f"<body>{page}</body>", he.PRIOR) == [SENTENCES.strip()]


@pytest.mark.parametrize("piece", ["<svg>", "<svg><path d=1/>", "<object><button>", "<textarea>", "<svg><svg></svg><object>x", "<template><b>", "<title>a<iframe>", "<div></section>", "<svg><g></x>"])
def test_malformed_pages_are_read_in_linear_time(piece):
    began = time.process_time()
    he.blocks_of(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 6  # a second on an idle machine; it was hours


def _without_names(html):
    return re.sub(r'class="[^"]*"|id="[^"]*"', "", re.sub(r"<(/?)(nav|article|footer|main|aside|header|section)\b", r"<\1div", html))


def test_costs_and_edges_decide():
    page = PAGE.format(extra="The last one ends here.")
    found = he.content(page, he.PRIOR)
    assert len(found) == 4 and he.content(page, 0 * he.PRIOR) == []
    # no landmark and no name: the text alone, and neighbours
    assert found[1:] == [x for x in he.content(_without_names(page), he.PRIOR) if x in found[1:]]
    # a block whose own log-odds say boilerplate is content among content, by its edges alone
    long = "A long sentence of the article, which has many words and ends here. " * 3
    odd = f"<div><p>{long}</p><div>odd bit</div><p>{long}</p></div>"
    own = he.features(he.blocks_of(odd)) @ he.PRIOR
    assert own[0] > 0 > own[1] > -1.5 and own[2] > 0
    assert len(he.content(odd, he.PRIOR, 3.0, 3.0)) == 3 and len(he.content(odd, he.PRIOR, 0.0, 0.0)) == 2
    assert len(he.content(odd, he.PRIOR)) == 3


def test_fitted_costs_need_no_landmarks(spark):
    rows = [(i, "u", PAGE.format(extra=f"The last one, number {i}, ends here as a sentence.")) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    w = he.fit_blocks(df)
    for _, _, html in rows[:5]:
        clean, bare = he.content(html, w), he.content(_without_names(html), w)
        assert len(clean) == 4 and bare[:3] == clean[:3] and len(bare) <= 6  # the fourth stands between a share box and a form


@pytest.mark.parametrize("seed", range(40))
def test_minimum_cut_is_minimal(seed):
    r = random.Random(seed)
    n = r.randrange(1, 9)
    source, sink = [r.choice([0, 1, 2, 5]) + 0.0 for _ in range(n)], [r.choice([0, 1, 2, 5]) + 0.0 for _ in range(n)]
    edges = {(i, j): float(r.choice([0, 1, 2])) for i in range(n) for j in range(i) if r.random() < 0.6}
    cost = lambda side: sum(b if s else a for s, a, b in zip(side, source, sink)) + sum(c for (i, j), c in edges.items() if side[i] != side[j])
    assert abs(cost(he.minimum_cut(source, sink, edges)) - min(cost(s) for s in itertools.product([False, True], repeat=n))) < 1e-6


@pytest.mark.parametrize("n", [1, 255, 256, 257, 65_536, 65_537, 200_000])
def test_range_coding(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), 50_000).astype(np.uint32)
    table = rans.Table.of(ids)
    blocks = rans.encode(ids, table)
    again = rans.Table.from_bytes(table.to_bytes())
    assert np.array_equal(rans.decode(blocks, again), ids)
    assert np.array_equal(rans.decode(blocks[-1:], again), ids[(len(blocks) - 1) * rans.BLOCK :])  # blocks are independent
    if n > 1000:
        assert sum(map(len, blocks)) < 2 * n
        broken = bytearray(blocks[0])
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            rans.decode([bytes(broken)], again)
    assert zlib.crc32(b"") == 0


def brute_nearest(rows, step, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v)) and len(v) == 16]
    out = []
    for i, v in good:
        if i % step == 0:
            best = sorted(((-(w * v).sum(), j) for j, w in good if j != i))[:k]
            out += [(i, n + 1, j) for n, (_, j) in enumerate(best)]
    return out


def test_nearest(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(16).astype(np.float32).tolist()) for i in range(600)]
    for i in range(30, 90):
        rows[i] = (i, rows[29][1])  # many equal vectors: ties
    rows += [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0] * 3), (780, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(0))
    want = brute_nearest(rows, 20, 20)
    for blocks in ((2048, 8192), (7, 100)):
        got = nearest.search(df, F.col("vec_id") % 20 == 0, query_block=blocks[0], row_block=blocks[1]).collect()
        found = {(x.query_id, x.vec_id) for x in got}
        assert len(got) == len(want) and len(found & {(i, j) for i, _, j in want}) >= 0.97 * len(want)
        assert sorted(x["rank"] for x in got if x.query_id == 40) == list(range(1, 21))
    few = nearest.search(df.where("vec_id < 4"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [x.vec_id for x in few] == [j for _, _, j in brute_nearest(rows[:4], 20, 20)]
    assert nearest.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_estimates_stay_inside_their_bounds():
    r = np.random.default_rng(0)
    v, q = r.standard_normal((2000, 64)), r.standard_normal((20, 64))
    center, turn = v.mean(axis=0), nearest.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    guess, error = nearest.estimate(q, center, turn, *nearest.encode(v, center, turn), 3.5)
    assert (np.abs(guess - q @ v.T) <= error).mean() > 0.998


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    from .test_text_operators import brute_components, brute_hits

    r = random.Random(6)
    item = " ".join(f"q{i}" for i in range(20))
    texts = [" ".join(r.choice(["the", "of", "and"]) + str(r.randrange(50)) for _ in range(40)) for _ in range(60)]
    texts += [texts[0], texts[1] + " tail", item + " and a bit more", None, "12 34", ""]
    rows = [(i, t, "en" if t else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    alive = set(range(len(texts)))
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        ids = {x.doc_id for x in docs.collect()}
        if name == "language_id":
            alive = {i for i in alive if texts[i] and any(c.isalpha() for c in texts[i])}
        elif name == "jaccard_join":
            keep = sorted(alive)
            alive = {keep[i] for i, _, c in brute_components([texts[i] for i in keep]) if c == i}
        elif name == "decontamination":
            alive = {i for i in alive if not brute_hits([texts[i]], [(1, item)])[0][4]}
        else:
            assert ids <= alive
            continue
        assert ids == alive, name
    out = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(out) == docs.count() and {x.doc_id for x in out} == ids
    assert len(cp.run(spark, str(tmp_path)).collect()) == len(out)


def test_stages_with_clashing_columns_and_empty_tables(spark, tmp_path):
    """Columns named like those that stages make come through; an empty table stays empty."""
    import corpus_pipeline as cp

    words = lambda i: " ".join(f"word{i}x{k} of the text" for k in range(40))
    rows = [(1, words(1), "en", "web", 9), (2, words(2), "en", "web", 9), (2, words(1) + " more", "en", "news", 9), (3, words(3), "en", None, 9), (3, words(3), "en", None, 9), (None, words(4), "en", "web", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    odd = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))) for c in ("copy", "copies", "key", "taken_size", "taken_doc_id", "hash", "size", "other_columns", "n", "a", "component_id")})
    for stage in (cp.near_duplicates, cp.mixing):
        plain, got = stage(spark, docs, ""), stage(spark, odd, "")
        assert got.columns == odd.columns and plain.columns == docs.columns
        assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, plain.collect()))
        assert all(r["copy"] == f"copy-{'x' if r.doc_id is None else r.doc_id}" for r in got.collect()) and got.count()
        assert stage(spark, odd.limit(0), "").count() == 0


def test_rest_works_without_this_subpackage(tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(top, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q), list(q); assert set(e.oracle_sql()) <= set(q)"
    code += """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
spark.createDataFrame([('view', 1.0), ('view', 3.0)], 'event_type string, value double').write.parquet('t/events.parquet')
assert [tuple(r) for r in q['min_max'](spark, 't').collect()] == [('view', 1.0, 3.0)]"""
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": str(tmp_path / "r")}).returncode == 0
