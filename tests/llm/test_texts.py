"""Language, mixing, chat, HTML, licences, and the pipeline."""

import hashlib
import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import difference, oracle
from tests.llm.helpers import SF, docs_frame, simhash
from tidemark.llm import chat, html_text, language, licences, mixing, queries


@pytest.mark.parametrize("name", sorted(queries.statements()))
def test_matches_sql(spark, name):
    assert difference(queries.registered()[name](spark, SF), oracle(SF), queries.statements()[name]) == ""


# Language

def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_teach_nothing(spark):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.held_out for r in language.identify(docs).collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in got.items())
    changed = docs.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang")))
    assert language.identify(docs).exceptAll(language.identify(changed)).isEmpty()


def test_language_edge_rows(spark):
    base = [(i, "the and of that with this from", "en") for i in range(9)] + [(20 + i, "der die das und nicht ein mit", "de") for i in range(9)]
    odd = [(50, None, "en"), (51, "", "en"), (52, "12 34 !?", "de"), (53, "der " * 50_000, None), (54, "the and", None), (54, "the and", None), (None, "die das", None)]
    df = docs_frame(spark, base + odd, extra=True)
    got = defaultdict(list)
    for r in language.identify(df).collect():
        got[r.doc_id].append((r.lang_pred, r.score > 0))
    assert [got[i] for i in (50, 51, 52)] == [[("und", False)]] * 3
    assert got[53] == [("de", True)] and got[54] == [("en", True)] * 2 and got[None] == [("de", True)]
    kept = language.identified(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes and kept.count() == len(base) + len(odd) - 3
    assert language.identify(docs_frame(spark, [])).collect() == []
    unlabelled = docs_frame(spark, [(1, "words", None), (2, "--", None)])
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
    assert [r.doc_id for r in language.identified(unlabelled).collect()] == [1]


def test_kernel_scores_equal_the_direct_formula():
    texts = [("en", "the cat sat"), ("en", "that hat"), ("de", "die katze sass"), ("de", "der hut")]
    model = language.fit([(c, language.profile(t)) for c, t in texts])
    codes = set(model.codes.tolist())
    got = language._Scorer(model)([b"the hut"])[0]
    mine = sorted(codes & set(language.profile("the hut").tolist()))
    direct = model.weights[np.searchsorted(model.codes, mine)].sum(axis=0) / np.sqrt(len(mine))
    assert np.allclose(got, direct, atol=1e-5)


# Mixing

def level(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Targets by repeated resharing, sizes in order of their sources."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    whole, capped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = whole - sum(cap * sizes[i] for i in capped)
        total = sum(w[i] for i in free)
        target = [cap * s if i in capped else left * w[i] / total for i, s in enumerate(sizes)]
        above = {i for i in free if target[i] > cap * sizes[i]}
        if not above:
            return target
        capped |= above


def test_mix_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.taken_words(docs, block_docs=16, shard_blocks=4).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len((r.text or "").encode().split()) and 0 <= r.taken <= 2 * r["size"]
        by[r.source].append(r)
    sources = sorted(by)
    want = level([sum(r["size"] for r in by[s]) for s in sources])
    for s, t in zip(sources, want, strict=True):
        assert {round(r.target, 6) for r in by[s]} == {round(t, 6)} and {r.source_size for r in by[s]} == {sum(r["size"] for r in by[s])}
        # Documents are whole, so the last one decides how near the target is.
        assert abs(sum(r.taken for r in by[s]) - t) <= max(r["size"] for r in by[s]) / 2 + 1
        assert {r.taken % max(1, r["size"]) for r in by[s]} == {0}
    again = mixing.taken_words(docs.repartition(5), block_docs=16, shard_blocks=4)
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in rows)


def test_mix_rows_are_the_taken_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs, block_docs=8, shard_blocks=2).collect()}
    out = mixing.mixed(docs, with_shard=True, block_docs=8, shard_blocks=2).collect()
    words = Counter()
    for r in out:
        words[r.doc_id] += len((r.text or "").encode().split())
    assert all(words[d] == t for d, t in taken.items())
    assert len({r.shard for r in out}) > 4 and len({(r.shard, r.place) for r in out}) == len(out)


@pytest.mark.parametrize("shards", [1, 2, 8])
def test_splitting_tree_keeps_quotas(spark, shards):
    quotas = {1: 400, 2: 7, 3: 0, 4: 93, 5: 1}
    df = spark.createDataFrame(list(quotas.items()), "source_no long, quota long")
    rows = mixing.shard_quotas(df, shards).collect()
    by_source, by_shard = Counter(), Counter()
    for r in sorted(rows, key=lambda r: r.shard):
        assert r.quota >= 0 and r.before == by_source[r.source_no]
        by_source[r.source_no] += r.quota
        by_shard[r.shard] += r.quota
    assert all(by_source[s] == q for s, q in quotas.items())
    assert max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == shards


def test_hypergeometric_draws(spark):
    from math import comb

    good, total, drawn, n = 30, 50, 20, 4000
    df = spark.range(n).selectExpr("cast(30 as long) a", "cast(50 as long) b", "cast(20 as long) c", "(id + 0.5D) / 4000 u")
    got = Counter(r.k for r in df.select(mixing._hypergeometric(*(F.col(x) for x in "abcu")).alias("k")).collect())
    for k in range(21):
        p = comb(good, k) * comb(total - good, drawn - k) / comb(total, drawn)
        assert abs(got[k] / n - p) <= 2 / n


def test_mix_edge_rows(spark):
    rows = [(1, "a b c", "en", "x"), (2, None, "en", "x"), (3, "", "en", None), (4, "w " * 9000, "en", None), (5, "q r", "en", "y"), (5, "q r", "en", "y"), (None, "z", "en", "z")]
    df = docs_frame(spark, rows, extra=True)
    got = mixing.taken_words(df).collect()
    sizes = {"x": 3, "y": 4, "z": 1, None: 9000}
    want = dict(zip(["x", "y", "z", None], level(list(sizes.values())), strict=True))
    assert len(got) == 7 and sum(r.taken for r in got) == pytest.approx(sum(want.values()), abs=9000 / 2 + 3)
    assert all(r.taken <= 2 * r["size"] for r in got)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sum(len(r.text.split()) for r in out.collect() if r.text) == sum(r.taken for r in got)
    assert mixing.taken_words(docs_frame(spark, [])).collect() == [] and mixing.mixed(docs_frame(spark, [])).collect() == []
    assert [r.taken for r in mixing.taken_words(docs_frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]


@pytest.mark.parametrize("rows", [[(7, "a b c")] * 300, [(i, "a b c") for i in range(60)], [(1, "a b c")] * 40 + [(1, "a b c", "en", None)] * 30])
def test_mix_with_empty_blocks_and_repeated_rows(spark, rows):
    options = {"share": 2.0, "block_docs": 256 if len(rows) == 300 else 1}
    df = docs_frame(spark, rows)
    assert [r.taken for r in mixing.taken_words(df, **options).collect()] == [6] * len(rows)
    out = mixing.mixed(df, with_shard=True, **options).collect()
    assert Counter(r.source for r in out) == Counter(r.source for r in df.collect() * 2)
    assert len({(r.source, r.shard, r.place) for r in out}) == len(out)
    mix = mixing.Mix(df, **options)
    assert mix.placed(mix.sized).groupBy("source_no", "block").count().agg(F.max("count")).first()[0] < max(10, len(rows) * 0.7)


def test_mix_cuts_no_text_and_ends_nearest_to_the_target(spark):
    docs = docs_frame(spark, [(i, f"line {i}\n\n" + "w  " * (i % 40), "en", "xyz"[i % 3]) for i in range(400)])
    whole = {r.doc_id: tuple(r) for r in docs.collect()}
    out = mixing.mixed(docs, block_docs=8, shard_blocks=4).collect()
    assert all(tuple(r) == whole[r.doc_id] for r in out)
    rows = mixing.taken_words(docs, block_docs=8, shard_blocks=4).join(docs.select("doc_id", "source"), "doc_id").collect()
    for s in "xyz":
        mine = [r for r in rows if r.source == s]
        off = abs(sum(r.taken for r in mine) - mine[0].target)
        assert off <= max(r["size"] for r in mine) / 2 + 1
    for n, want in ((1, 0), (2, 3), (9, 9)):  # one document of 3 n words, and a target of n: nearer to it or to nothing
        one = docs_frame(spark, [(1, "a " * 3 * (3 if n == 9 else 1))])
        assert mixing.taken_words(one, share=n / (9 if n == 9 else 3)).first().taken == want


def test_mix_stage_shuffles_shards(spark):
    docs = docs_frame(spark, [(i, "a b c" + " d" * (i % 5), "en", "xyz"[i % 3]) for i in range(90)])
    want = [r.doc_id for r in sorted(mixing.mixed(docs, with_shard=True).collect(), key=lambda r: (r.shard, r.place))]
    out = corpus_pipeline.mix_sources(spark, docs, SF)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == want != sorted(want)


# Chat

CHAT = "conv_id long, turn long, role string, text string"


def chat_digest(rows):
    out = {}
    for conv, turns in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r or "", t or "") for _, _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_edge_rows(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "tool <s>", odd + "\\"), (1, 3, None, None), (1, 4, "assistant", None), (1, 5, "", "\\\\<s>\\"), (1, 6, "system", "<<SYS>> é"), (1, 6, "assistant", "é\n\U0001f600")]
    rows += [(2, 0, "assistant", "x" * 100_000), (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 0, "assistant", "no id")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} <s>") for i in range(25_000)]
    df = spark.createDataFrame(rows, CHAT).withColumn("segment", F.lit("x")).withColumn("part", F.lit("y"))
    segments = chat.formatted(df.repartition(7))
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(segments).collect()}
    assert {k: v[:4] for k, v in got.items()} == chat_digest(rows)
    text = defaultdict(str)
    for r in segments.orderBy("conv_id", "segment").collect():
        text[r.conv_id] += r.text
    assert {k: len(v) for k, v in text.items()} == {k: v[4] for k, v in got.items()}
    assert chat.digests(chat.formatted(spark.createDataFrame([], CHAT))).collect() == []


@pytest.mark.parametrize("text", ["", "\\", "<s>", "\\<s>", "\\\\</s>\\", "<<s>>", "[[INST]]", " </s>", "<</SYS>> <<SYS>>", "é[/INST]"])
def test_chat_escapes_are_reversible(text):
    raw = text.encode()
    assert chat.unescape(chat.escape(raw)) == raw
    for role, (a, b) in chat.TEMPLATE.items():
        one = a.encode() + chat.escape(raw) + b.encode()
        assert chat.parse(one * 2) == [(role.encode(), raw)] * 2


# HTML

LONG = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen words and more."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("<div", ""), ("<!-- only", ""), ("<p> \n </p>", ""), (f"<p>{LONG}</p>", LONG),
        (f"<nav><a>x</a></nav><article><h1>A &amp; B</h1><p>fo<b>o</b>  bar<br>baz<p>{LONG}<script>x</script></article><footer>{LONG}</footer>", f"A & B foo bar baz {LONG}"),
        (f"<header><h1>Site</h1></header><main><article><h1>T</h1><p>{LONG}</p><table><tr><td>a<td>b</table><ul><li>x<li>y</ul><section id='comments'><p>{LONG}</p></section></article><aside><p>{LONG}</p></aside></main>", f"T {LONG} a b x y"),
        (f"<div class='cookie-notice'>{LONG}</div><article><p>{LONG}<form><input><label>Mail</label></form><div class='ad'>buy</div><p>x &lt;b&gt; 1 < 2&nbsp;y</article><p>{LONG}", f"{LONG} x <b> 1 < 2 y"),
        (f"<div class='header'><a>x</a></div><div class='post'><h1>Head</h1><p>{LONG}</p><p>Short</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div>", f"Head {LONG} Short {LONG}"),
        (f"<article><p>{LONG}</p>" + f"<p>{LONG}</p>" * 3000 + "</article>", " ".join([LONG] * 3001)),
        ("<article><p>cut &am", "cut &am"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page, html_text.trained()) == want


def test_main_text_of_a_deep_page():
    deep = "<div>" * 2500 + f"<nav><p>Menu {LONG}</p></nav>" + "</div>" * 2500
    assert html_text.main_text(f"<article><p>{LONG}</p>{deep}<p>End {LONG}</p></article>", html_text.trained()) == f"{LONG} End {LONG}"


class Reference(HTMLParser):
    """An independent reading of well-formed pages: paragraphs, headings and cells that are not inside anything unwanted."""

    LEAF = {"p", "h1", "h2", "h3", "li", "td", "blockquote"}

    def __init__(self, unwanted):
        super().__init__(convert_charrefs=True)
        self.unwanted, self.stack, self.blocks = unwanted, [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        bad = tag in ("script", "style", "nav", "footer", "aside", "form", "header") or (attrs.get("class") or "") in self.unwanted
        self.stack.append((tag, bad or bool(self.stack and self.stack[-1][1])))
        if tag in self.LEAF:
            self.blocks.append([self.stack[-1][1], ""])

    def handle_endtag(self, tag):
        while self.stack and self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if self.blocks and any(t in self.LEAF for t, _ in self.stack):
            self.blocks[-1][1] += data

    def text(self):
        return " ".join(" ".join(t.split()) for bad, t in self.blocks if not bad and t.split())


def held_out_page(seed, article):
    """A page from a template that the labelled table does not have."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "ne", "tu", "ras", "vel") for b in ("n", "rin", "da", "post", "ing", "s")]

    def words(lo, hi):
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(lo, hi)))

    def linked(n):
        return "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(n))

    body = []
    for _ in range(rng.randint(4, 12)):
        kind = rng.random()
        if kind < 0.6:
            body.append(f"<p>{words(12, 70)}</p>")
        elif kind < 0.75:
            body.append(f"<p>{words(1, 5)}.</p>")
        elif kind < 0.85:
            body.append(f"<h2>{words(2, 7)}</h2>")
        else:
            body.append("<ul>" + "".join(f"<li>{words(3, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
    body.insert(0, f"<p>{words(25, 60)}</p>")
    if rng.random() < 0.5:
        body.insert(rng.randint(1, len(body)), f'<div class="ad">{words(5, 40)}</div>')
    if rng.random() < 0.5:
        body.append(f'<section class="comments"><p>{words(5, 40)}</p><p>{words(1, 9)}</p></section>')
    rng.random()
    box = "article" if article else "div"
    top = f"<nav><ul>{linked(rng.randint(3, 8))}</ul></nav>" + rng.choice(["", f"<header><p>{words(2, 30)}</p></header>"])
    side = rng.choice(["", f'<aside><p>{words(10, 60)}</p></aside>', f'<div class="sidebar"><p>{words(10, 60)}</p></div>'])
    end = rng.choice(["", f"<footer><p>{words(3, 40)}</p></footer>"])
    return f"<html><body>{top}<{box}>{''.join(body)}</{box}>{side}{end}</body></html>"


@pytest.mark.parametrize("article", [True, False])
def test_held_out_pages_against_another_parser(article):
    tree, right, total = html_text.trained(), 0, 0
    for seed in range(150):
        page = held_out_page(seed, article)
        reference = Reference({"ad", "comments", "sidebar"})
        reference.feed(page)
        want, got = reference.text().split(), html_text.main_text(page, tree).split()
        same = sum((Counter(want) & Counter(got)).values())
        right, total = right + 2 * same, total + len(want) + len(got)
        assert not article or got == want
    assert right / total > 0.98


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<div><p>{LONG}</p><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>", f"{LONG} {LONG} Short. {LONG}"),
        (f"<div><p>{LONG}</p><ul><li>x one<li>y two</ul><p>{LONG}</p></div>", f"{LONG} x one y two {LONG}"),
        (f'<article><p>{LONG}</p></article><div class="user-feedback"><p>{LONG}</p></div>', LONG),
        (f'<article><p>{LONG}</p><div class="user-feedback"><p>{LONG}</p></div></article>', LONG),
        (f'<article><p>{LONG}</p><p class="related-work">{LONG}</p><p class="legal-matters">x</p></article>', f"{LONG} {LONG} x"),
    ],
)
def test_names_and_places(page, want):
    assert html_text.main_text(page, html_text.trained()) == want


@pytest.mark.parametrize("bad", ["<a ", '<a "> " ', "<div class='", "<", "<!--", "<script>", "<p ", '<a href="x>', "</", "&", "<table><tr><td>"])
def test_broken_markup_takes_time_in_proportion(bad):
    page = f"<p>{LONG}</p>" + bad * (500_000 // len(bad)) + '"'
    start = time.perf_counter()
    blocks = html_text.blocks_of(page)
    assert time.perf_counter() - start < 10 and blocks[0].text == LONG


def test_pages(spark):
    rows = queries.op10_main_text(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r.n_chars == len(r.text) > 0 for r in rows)
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (1, "u", None, "x")], "page_id long, url string, html string, text string")
    out = html_text.extracted(df)
    assert out.columns == ["page_id", "url", "text"] and out.count() == 2
    assert html_text.extracted(df.limit(0)).collect() == []


# Licences

APACHE = next(t for name, t in licences.TEMPLATES if name == "apache-2.0" and "in compliance" in t)
MIT = next(t for name, t in licences.TEMPLATES if name == "mit" and t.endswith("without restriction."))
MORE = MIT[:-1] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"


def dice(a, b):
    a, b = set(licences.bigrams_of(a)), set(licences.bigrams_of(b))
    return round(2 * len(a & b) / (len(a) + len(b)), 9)


def test_licences_against_brute_force(spark):
    text = APACHE
    rows = [(1, "x\n" + text.upper() + "\nmit"), (2, "Released under the MIT License"), (2, "released  UNDER: the mit license!"), (3, None), (4, ""), (5, "Released under the MIT License. " * 40), (6, text.replace("except", "but")), (None, "Licensed under CC BY-NC 4.0."), (7, "z " * 50_000)]

    def best(line):
        pairs = set(licences.bigrams_of(line))
        found = []
        for i, ((name, t), key) in enumerate(zip(licences.TEMPLATES, licences.KEYS, strict=True)):
            mine = set(licences.bigrams_of(t))
            dice = 2 * len(pairs & mine) / (len(pairs) + len(mine))
            if dice >= licences.MIN_DICE and all(b in pairs for part in key.split("|") for b in licences.bigrams_of(part)):
                found.append((-dice, i, name))
        return min(found, default=None)

    want = defaultdict(list)
    for d, t in rows:
        want[d] += [b for b in map(best, (t or "").split("\n")) if b]
    want = sorted((str(d), len(b), min(b)[2], round(-min(b)[0], 9)) for d, b in want.items() if b)
    got = licences.scan(docs_frame(spark, rows, extra=True)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.licence, r.score) for r in got) == want and len(want) >= 5
    assert licences.scan(docs_frame(spark, [])).collect() == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("x\n" + MIT[:60] + "\n# " + MIT[60:130] + "\n * " + MIT[130:] + "\nint main", [(1, 3, "mit", 1.0)]),
        (MORE, [(0, 0, "mit", max(dice(MORE, t) for name, t in licences.TEMPLATES if name == "mit"))]),
        ("// Licensed under the MIT License. See LICENSE in the project root for license information.", [(0, 0, "mit", 1.0)]),
        ("a b c Released under\nthe MIT License d e f g Released under the MIT\n\nLicense", [(0, 1, "mit", 1.0), (1, 3, "mit", 1.0)]),
        ("w " * 5000 + "licensed under\r\nCC BY-NC 4.0 " + "w " * 5000, [(0, 1, "cc-by-nc-4.0", 1.0)]),
        ("Released under the MIT License.\nand more", [(0, 0, "mit", 1.0)]),
        ("under the terms of the license, permission is granted to any person", []),
    ],
)
def test_licence_notices_in_runs_of_words(spark, text, want):
    got = licences.notices(docs_frame(spark, [(1, text)])).collect()
    assert sorted((r.line, r.last_line, r.licence, round(r.score, 9)) for r in got) == want


NOTICES = {
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "gpl-3.0": "// This work is licensed under the GNU General Public License, version 3.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.",
    "apache-2.0": "# SPDX-License-Identifier: Apache-2.0",
    "mit-0": "# SPDX-License-Identifier: MIT-0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-sa-4.0": "This page is licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    None: "Licensed under the GNU General Public License, version 4.",
    "": "GNU General Public License, version 2.",
}


def test_versions_and_variants_are_told_apart(spark):
    rows = [(i, "int main\n" + text + "\nreturn") for i, text in enumerate(NOTICES.values())]
    names = [name or None for name in NOTICES]
    start = len(rows)
    for name, text in licences.TEMPLATES:  # each text finds its own licence, whatever others resemble it
        rows.append((len(rows), text))
        names.append(name)
    got = defaultdict(set)
    for r in licences.scan(docs_frame(spark, rows)).collect():
        got[r.doc_id].add(r.licence)
    assert len({n for n in names if n}) >= 30
    assert [got[i] for i in range(len(rows))] == [{n} if n else set() for n in names], start
    bsd = next(t for name, t in licences.TEMPLATES if name == "bsd-3-clause" and len(t) > 300)
    two = next(t for name, t in licences.TEMPLATES if name == "bsd-2-clause" and len(t) > 300)
    found = {r.doc_id: r.licence for r in licences.scan(docs_frame(spark, [(1, bsd.replace(". ", ".\n")), (2, two.replace(". ", ".\n")), (3, bsd[:140])])).collect()}
    assert found == {1: "bsd-3-clause", 2: "bsd-2-clause"}


def test_every_licence_of_a_document(spark):
    apache, mit, nc = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    rows = [(1, f"{apache}\nx\n{nc}\n{apache}"), (1, mit), (None, mit), (None, nc)]
    got = licences.scan(docs_frame(spark, rows)).collect()
    want = [("1", "apache-2.0", 2), ("1", "cc-by-nc-4.0", 1), ("1", "mit", 1), ("None", "cc-by-nc-4.0", 1), ("None", "mit", 1)]
    assert sorted((str(r.doc_id), r.licence, r.n_lines) for r in got) == want and all(r.score == 1.0 for r in got)


# Pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, ident), (_, near), (_, passages), (_, mix), (_, sample) = corpus_pipeline.STAGES
    a = ident(spark, docs, SF)
    assert a.columns == docs.columns and a.count() == docs.where("text rlike '[^\\\\W\\\\d_]'").count()
    b = near(spark, a, SF)
    assert b.columns == docs.columns
    kept = b.collect()
    prints = [simhash(r.text) for r in kept]
    assert all((x ^ y).bit_count() > 3 for i, x in enumerate(prints) for y in prints[:i])
    c = passages(spark, b, SF)
    assert c.columns == docs.columns and c.count() == len(kept)
    d = mix(spark, c, SF)
    assert d.columns == docs.columns
    e = sample(spark, d, SF)
    assert e.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "ids", "rank"} <= set(out.columns) and out.count() > 200


def test_pipeline_of_an_empty_table(spark):
    df = docs_frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    assert df.collect() == []
