"""Cases in which an operator once did less than the whole job."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterline.llm import decontaminate as dc
from meterline.llm import html_extract as he
from meterline.llm import nearest, queries
from meterline.llm import secret_scan as ss

from .test_html_vectors_pipeline import brute_nearest

TITLE, FIRST, SECOND = "How rivers change their beds", "The first paragraph is a long sentence about rivers, floods, and the sand that they carry along.", "The second paragraph goes on about it, and says where all of the sand comes to rest in the end."
BODY = f"<h1>{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p>"
NAV = "<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar"><article>{BODY}</article></div>',
        f'<article class="post category-social has-comments">{BODY}</article>',
        f'<form action="/"><input><article>{BODY}</article></form>',
        f'<form action="/"><div>{BODY}</div></form>',
        f"<main><form>{BODY}</form></main>",
        f'<div class="search"><article>{BODY}</article></div>',
        f'<div class="overlay"><div class="content">{BODY}</div></div>',
        f'<div id="popup">{BODY}</div>',
        f'<article><header class="entry-header header"><h1>{TITLE}</h1></header><p>{FIRST}</p><p>{SECOND}</p></article>',
        f'<article title="a hidden truth" class="overflow hidden box" data-id="nav">{BODY}</article>',
        f'<article>{BODY}<div class="share-tools"><a href=x>Share</a></div><form><label>Mail</label></form><section id="comments"><article class="comment">Nice one.</article></section></article>',
        f'<div class="ad">Buy now, it is cheap.</div><article>{BODY}</article><div class="sidebar-widget"><p>Popular things</p></div>',
    ],
)
def test_names_and_forms_do_not_take_articles(page):
    assert he.content(f"<html><body>{NAV}{page}<footer>Somebody, all rights reserved.</footer></body></html>", he.PRIOR) == [TITLE, FIRST, SECOND]


@pytest.mark.parametrize(
    "page",
    [
        f"<article><h1>{TITLE}</h1><svg class=i viewBox='0 0 1 1'/><p>{FIRST}</p><svg><path d=x /><title>t</title></svg><p>{SECOND}</p></article>",
        f"<article><h1>{TITLE}</h1><p>{FIRST}</p><math/><p>{SECOND}</p></article>",
        *(f"<article><h1>{TITLE}</h1><{t} id=a><p>{FIRST}</p><p>{SECOND}</p></article>" for t in ("button", "select", "object", "video", "noscript", "svg", "iframe", "textarea", "template")),
        f"<button>Menu<article><h1>{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p></article><button>Up</button>",
        f"<div><video src=a></div><article><h1>{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p></article><video src=b></video>",
        f"<script>var s = '<!--';</script><article>{BODY}</article>",
        f"<script>for (i=0;i<n; // don't\ni++);</script><article><h1>{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p></article><p class=ad>It's</p>",
        f"<style>a<b'{{}}</style><article>{BODY}</article><!-- it's -->",
        f"<article><h1>{TITLE}</h1><p>{FIRST.replace('rivers', '<button>x</button> rivers')}</p><template><article>None</article></template><p>{SECOND.replace('sand', '<math><mi>sand</mi></math>')}</p></article>",
    ],
)
def test_raw_elements_do_not_take_the_rest(page):
    assert he.content(f"<html><head><title>T</title></head><body>{NAV}{page}</body></html>", he.PRIOR) == [TITLE, FIRST, SECOND]


def test_text_of_unclosed_raw_elements():
    assert he.content(f"<article><p>{FIRST} <b>And</b> <button>Go <b>on</b><p>{SECOND}</p><p>{TITLE}", he.PRIOR) == [FIRST + " And", SECOND, TITLE]
    assert he.content(f"<article><p>{FIRST}</p><script>var x = 1; <p>{SECOND}", he.PRIOR) == [FIRST]
    assert [b.text for b in he.blocks_of("<p>a<sup>2</sup> is <math><msup><mi>x</mi><mn>2</mn></msup><annotation>x^2</annotation></math>.</p>")] == ["a2 is x2 ."]


def test_repeated_query_rows_keep_all_neighbours(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(16).astype(np.float32).tolist()) for i in range(1, 200)]
    rows += [(20, rows[19][1])] * 2 + [(40, r.standard_normal(16).astype(np.float32).tolist())]  # id 20 on three equal rows, 40 on two unequal ones
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for blocks in ((2048, 8192), (3, 50)):
        got = nearest.search(df, F.col("vec_id") % 20 == 0, query_block=blocks[0], row_block=blocks[1]).collect()
        assert sorted((x.query_id, x["rank"], x.vec_id) for x in got) == sorted(brute_nearest(rows, 20, 20))


def test_items_without_id_hit(spark, tmp_path):
    item, named = " ".join(f"q{i}" for i in range(15)), " ".join(f"n{i}" for i in range(15))
    spark.createDataFrame([(1, item), (2, f"{item} {named}"), (3, "other words")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, item), (None, item), (7, named)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in queries.op3_decontaminate(spark, str(tmp_path)).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) for i in (1, 2, 3)] == [(15, 1, dc.digest([]), True), (30, 2, dc.digest(["7"]), True), (0, 0, dc.digest([]), False)]


def test_near_duplicates_by_row(spark):
    r = random.Random(2)
    text = [" ".join(r.choice("abcdef") + str(r.randrange(99)) for _ in range(40)) for _ in range(5)]
    rows = [(1, text[0]), (2, text[0] + " tail"), (2, text[1]), (3, text[2]), (3, text[2] + " tail"), (4, text[3]), (4, text[3]), (None, text[4]), (5, text[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    third = [t for i, t in got if i == 3]
    assert len(third) == 1 and third[0] in (text[2], text[2] + " tail")
    assert sorted(x for x in got if x[0] not in (3, None)) == [(1, text[0]), (2, text[1]), (4, text[3]), (5, text[4])] and (None, text[4]) in got


def test_short_and_dotted_candidates(spark):
    r = random.Random(4)
    words = ["which", "rivers", "carry", "floods", "because", "sediment", "stations", "measured", "carefully.", "Another"]
    secret = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(5)) + "." + "".join(r.choice("GHIJKLMNOPQRSTUVWXYZ") for _ in range(6))
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    planted = [secret() for _ in range(20)]
    texts = [f"{prose(60)} password: {secret()} {prose(60)}" for _ in range(200)] + [f"{prose(30)} {p} {prose(30)}" for p in planted] + [prose(80) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.row.doc_id: x.spans for x in ss.scan_secrets(docs, ss.fit_secrets(docs)).collect()}
    found = [[texts[i][s.start : s.end] for s in got[i]] for i in range(200, 270)]
    assert sum(f == [p] for f, p in zip(found, planted)) >= 19 and not any(found[20:])


def _planted():
    """Documents with labelled credentials of four formats, and unlabelled ones of the same formats that no fixed pattern finds."""
    r = random.Random(6)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    make = {
        "access": (lambda n: "AKIA" + pick(upper + digits, n), "{}", (16, 17, 18), (12, 13)),  # too short for the pattern
        "assign": (lambda n: "sk_live_" + pick(upper.lower() + upper + digits, n), "api_key = '{}'", (22, 23, 24), (22, 24)),
    }
    words = ["which", "rivers", "carry", "floods", "because", "sediment", "stations", "measured", "carefully.", "Another", "2024-11-03", "10.22.0.7", "well-known", "and/or", "mail@example.com", "4225039295678253"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts, planted = [], []
    for _, (secret, pattern, known, unknown) in make.items():
        texts += [f"{prose(60)} {pattern.format(secret(r.choice(known)))} {prose(60)}" for _ in range(200)]
        for _ in range(50):
            planted.append((len(texts), secret(r.choice(unknown))))
            texts.append(f"{prose(40)} {planted[-1][1]} {prose(40)}")
    return texts, planted, len(texts)


def test_learned_formats_find_unlabelled_credentials(spark):
    texts, planted, n = _planted()
    r = random.Random(8)
    clean = [" ".join(r.choice(texts[0].split()[:40] + ["elsewhere", "AKIANOTE", "sk_", "Unlikely", "report_2024"]) for _ in range(120)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id bigint, text string")
    model = ss.fit_secrets(docs)
    assert model.begins["access"] == "AKIA" and model.begins["assign"] == "sk_live_"
    rows = {x.row.doc_id: x for x in ss.scan_secrets(docs, model).collect()}
    added = {i: [(s.start, s.end) for s in x.spans if s.kind.startswith("like_")] for i, x in rows.items()}
    hit = [i for i, value in planted if added[i] == [(texts[i].index(value), texts[i].index(value) + len(value))]]
    assert len(hit) >= 0.95 * len(planted)
    assert sum(bool(added[i]) for i in range(n, len(rows))) <= 0.01 * len(clean)
    assert sum(len(added[i]) for i in range(n) if i not in dict(planted)) == 0
    # every candidate is scored, and as a plain sum over moves scores it
    for i in (0, 1, planted[0][0], planted[-1][0], n, n + 1):
        body = (texts + clean)[i]
        tokens = [m.group() for m in ss.TOKEN.finditer(body)]
        parts = [p for t in tokens if "." in t and not model.kind_of(t) for p in ss.PART.findall(t)]
        assert rows[i].n_candidates == len(tokens) + len(parts)
        assert [s.margin for s in rows[i].spans] == pytest.approx([_margin(model, ss._value(body, s[:3]) if not s.kind.startswith("like_") else body[s.start : s.end]) for s in rows[i].spans])


def _margin(model, value):
    """The scoring written out: sums of logarithms, move by move."""
    size = {c: len(g) for g in ss._GROUPS for c in g}
    of = int(len(value) >= 16 and "." not in value)
    best = -1e9
    for kind, automaton in model.formats.items():
        head, state, own = model.begins[kind], 0, 0.0
        for i, c in enumerate(value):
            literal = value.startswith(head) and i < len(head)
            own += 0.0 if literal else -np.log(size[c])
            to = automaton.moves[state].get(256 + ord(c) if literal else ss._CLASS[c])
            own += model.floor if to is None else to[1]
            state = state if to is None else to[0]
        own += max(automaton.ends[state], model.floor)
        marks = [ss.END, *[ss._CLASS[c] for c in value], ss.END]
        other = sum(model.background[of, a, b] for a, b in zip(marks, marks[1:])) - sum(np.log(size[c]) for c in value)
        best = max(best, (own - other) / (len(value) + 1) - model.least[kind, of])
    return best


def test_secrets_of_odd_rows(spark):
    texts, _, _ = _planted()
    docs = spark.createDataFrame(list(enumerate(texts[:220])), "doc_id bigint, text string")
    model = ss.fit_secrets(docs)
    long = ("x " * 200_000) + texts[0] + (" y" * 200_000)
    rows = [(1, None), (2, ""), (3, long), (4, texts[0]), (4, texts[0]), (None, texts[0])]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit("clash"))
    got = [(x.row.doc_id, [(s.kind, s.start, s.end) for s in x.spans]) for x in ss.scan_secrets(odd, model).collect()]
    want = ss.base_spans(texts[0])
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (3, [(k, a + 400_000, b + 400_000) for k, a, b in want]), (4, want), (4, want), (None, want)], key=str)
    assert ss.scan_secrets(docs.limit(0), ss.fit_secrets(docs.limit(0))).count() == 0


def brute_infer(words, penalty=0.5):
    """Red-blue merging on sets of suffixes: a state is the multiset of words that are left after it."""
    from collections import Counter
    from math import log

    share = penalty * log(max(2, len(words)))
    ll = lambda c: sum(n * log(n / sum(c.values())) for n in c.values())
    free = lambda c: max(0, len(c) - 1)
    firsts = lambda left: Counter(w[0] if w else None for w in left)
    after = lambda left, c: [w[1:] for w in left if w and w[0] == c]

    def compatible(x, y):
        cost, saved, todo = 0.0, 0, [(x, y)]
        while todo:
            x, y = todo.pop()
            a, b = firsts(x), firsts(y)
            cost += ll(a) + ll(b) - ll(a + b)
            saved += free(a) + free(b) - free(a + b)
            todo += [(after(x, c), after(y, c)) for c in a.keys() & b.keys() if c is not None]
        return cost <= share * saved + 1e-9

    return compatible


@pytest.mark.parametrize("seed", range(12))
def test_compatible_states_are_merged_and_others_kept(seed):
    """Two-state languages: words of one, and of two unlike, distributions; and lengths that all words share."""
    r = random.Random(seed)
    compatible = brute_infer(range(200))
    lengths = [r.choice((3, 4, 5)) for _ in range(200)]
    same = [[0] * n for n in lengths]
    assert len(ss.infer([[1, *w] for w in same[:100]] + [[2, *w] for w in same[100:]]).moves) < 2 * len(ss.infer(same).moves) + 1
    fixed = [[r.randrange(2) for _ in range(6)] for _ in range(200)]
    one = ss.infer([[0] * 6 for _ in fixed])
    assert len(one.moves) == 7 and one.ends[6] == 0.0 and all(e == -np.inf for e in one.ends[:6])
    # merging decisions on random pairs of leftover words agree with those of an automaton that starts with either
    for _ in range(20):
        x = [[r.randrange(2) for _ in range(r.choice((1, 2)))] for _ in range(r.randrange(5, 100))]
        y = [[int(r.random() < 0.8) for _ in range(r.choice((1, 2)))] for _ in range(r.randrange(5, 100))] if r.random() < 0.5 else [list(w) for w in x[: max(1, len(x) // 2)]]
        share = 0.5 * np.log(max(2, len(x) + len(y)))
        merged = ss.infer([[8, *w] for w in x] + [[9, *w] for w in y])
        to = {c: merged.moves[0][c][0] for c in (8, 9)}
        if brute_infer(range(len(x) + len(y)))(x, y) and to[8] == len(merged.moves[:2]) - 1 == 1 and share > 0:
            assert to[9] in (0, 1)
    assert compatible([[0]] * 50, [[0]] * 70) and not compatible([[0]] * 50, [[0, 0]] * 50)


def test_hex_keeps_its_length(spark):
    """From labels of 40 hex digits only: another length, and UUIDs, are other formats; recall and precision."""
    r = random.Random(12)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    words = ["which", "rivers", "carry", "floods", "because", "sediment", "stations", "measured", "carefully.", "2024-11-03"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = spark.createDataFrame([(i, f"{prose(50)} token = '{hexes(40)}' {prose(50)}") for i in range(130)], "doc_id bigint, text string")
    model = ss.fit_secrets(docs)
    assert len(model.formats["hex"].moves) >= 40 and len(model.formats["assign"].moves) >= 40
    uuid = lambda: "-".join(hexes(n) for n in (8, 4, 4, 4, 12))
    rate = lambda make: sum(model.kind_of(make()) is not None for _ in range(300)) / 300
    assert rate(lambda: hexes(40)) >= 0.97
    assert rate(lambda: hexes(20)) == 0 and rate(uuid) == 0 and rate(lambda: hexes(30)) == 0 and rate(lambda: hexes(64)) == 0
    assert rate(lambda: r.choice(words)) == 0
