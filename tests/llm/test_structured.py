"""HTML extraction, decontamination, packing, sharding, chat formatting, the Jaccard join and the pipeline."""

import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_inputs import AWKWARD, LONG, PROSE, documents, rows, with_clashes
from pyspark.sql import functions as F

from sitehex.llm import chat, components, decontamination, html_text, ngram_join, packing, queries, secret_scan, sharding
from sitehex.llm.common import read
from sitehex.plans import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf, name):
    assert compare.difference(queries.QUERIES[name](spark, sf), compare.duck(sf), queries.ORACLES[name]) is None


# HTML


def plain_article(source):
    """The article of a test page by patterns alone: headline and paragraphs."""
    inner = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_pages_against_patterns(spark, sf):
    pages = read(spark, sf, "pages")
    expected = {r.page_id: plain_article(r.html) for r in pages.collect()}
    got = html_text.main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == expected
    assert all(r.n_chars == len(r.text) for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="page header-2">
<header><a href=/>Home</a></header><div id="top-nav">Menu</div><div class="cookie-banner">We use cookies</div>
<div class=box><div class=promo2>Follow us on all channels</div></div>
<div class="content"><h1>Title &amp; {n}</h1><p>First&nbsp;para <b>{n}</b><br>line two<p>Second \n para {n} &lt;x&gt;</p>
<ul><li>one {n}<li>two</ul><!-- gone --><script>var a="<p>no</p>"</script></div>
<form><p>Search</p></form><aside>Side</aside><section id=comments><p>Nice!</p></section><footer>&copy; me</footer></body></html>"""


def page_rows(spark, sources, host="h.example"):
    return spark.createDataFrame(
        [(i, f"http://{host}/{i}", s) for i, s in enumerate(sources)], "page_id bigint, url string, html string"
    )


def test_site_tree_removes_shared_branches(spark):
    got = html_text.main_text(page_rows(spark, [PAGE.format(n=i) for i in range(12)])).orderBy("page_id").collect()
    for i, r in enumerate(got):
        assert r.text == f"Title & {i}\n\nFirst para {i} line two\n\nSecond para {i} <x>\n\none {i}\n\ntwo"
    tree = html_text.site_tree(page_rows(spark, [PAGE.format(n=i) for i in range(12)])).where("pages = 12").collect()
    assert {round(r.importance, 3) for r in tree} >= {0.0, 1.0}


BARE = """<html><body><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul>
<table><tr><td>Prices of today</td><td>Rates</td></tr></table><p>All rights reserved</p>
<div class=text><h1>Title {n}</h1><p>Text {n}</p><p>More {n}</p><ul><li>item {n}</ul></div></body></html>"""


def test_site_tree_without_article(spark):
    """No name tells the menu, the frame and the notice, only that all pages share them."""
    got = html_text.main_text(page_rows(spark, [BARE.format(n=i) for i in range(12)])).orderBy("page_id").collect()
    assert [r.text for r in got] == [f"Title {i}\n\nText {i}\n\nMore {i}\n\nitem {i}" for i in range(12)]


def test_site_tree_has_no_least_number_of_pages(spark):
    """The more pages share a branch, the less it is believed in; nothing turns at a count of its own."""
    rows = [(h * 100 + i, f"http://h{h}.example/{i}", BARE.format(n=i)) for h in range(2, 9) for i in range(h)]
    tree = html_text.site_tree(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    shared = tree.groupBy("site").agg(F.min("belief").alias("b"), F.min("importance").alias("i")).orderBy("site").collect()
    assert [round(r.b, 9) for r in shared] == [round(1.5 / (h + 1.5), 9) for h in range(2, 9)]
    assert all(abs(r.i) < 1e-12 for r in shared)


def test_site_tree_against_brute_force(spark, sf):
    """Entropies, shrinkage and the branches' maxima again, page by page in plain Python."""
    rows = [(r.url, r.html) for r in read(spark, sf, "pages").collect() if r.html]
    rows += [(f"http://bare.example/{i}", BARE.format(n=i // 2)) for i in range(9)] + [("http://one.example", PAGE.format(n=1))]
    seen, kinds = {}, {}
    for url, source in rows:
        for path, shape, text, kind in html_text.Page(source).nodes():
            key = (html_text.host_of(url), path)
            seen.setdefault(key, []).append((shape, text))
            kinds[key] = kind
    beliefs, ends = {}, {}
    for (site, path), found in seen.items():
        m = len(found)
        log_m = max(math.log(m), 1e-9)
        shapes, said = Counter(x for x, _ in found), Counter(x for _, x in found if x)
        look = 1 - sum(k * math.log(k) for k in shapes.values()) / (m * log_m)
        content = 1 - sum(math.log(k) for k in said.values()) / len(said) / log_m if said else 0
        own = (m * max(look, content) + 1.5 * (kinds[site, path] != html_text.DOUBTFUL)) / (m + 1.5)
        ends[site, path[-1]] = m, kinds[site, path]
        for node in path:
            beliefs[site, node] = max(own, beliefs.get((site, node), -1))
    tree = html_text.site_tree(spark.createDataFrame(rows, "url string, html string")).collect()
    assert {(r.site, r.node): (r.pages, r.kind, round(r.belief, 9)) for r in tree} == {
        k: (*ends[k], round(b, 9)) for k, b in beliefs.items()
    }


NAMED = """<div class="page has-sidebar" id="content-and-comments"><article><div class="post-header"><h1>Title {n}</h1></div>
<div class="header"><p>By author {n}</p></div><div class="masthead">The Daily</div><p title="the hidden gem">Gem {n}</p>
<p data-id="ad-7" data-role="alert">Data {n}</p><p class="social-history">Social {n}</p><div class="ad-box-2">Buy {n}</div>
<p hidden>No {n}</p><section class="comment-list"><p>Nice {n}</p></section></article><div class="site-footer">Foot {n}</div></div>"""


@pytest.mark.parametrize("count", [1, 12])
def test_names_are_read_whole_and_doubtful_ones_left_to_entropy(spark, count):
    got = html_text.main_text(page_rows(spark, [NAMED.format(n=i) for i in range(count)])).orderBy("page_id").collect()
    for i, r in enumerate(got):
        blocks = [f"Title {i}", f"By author {i}", "The Daily", f"Gem {i}", f"Data {i}", f"Social {i}"]
        assert r.text == "\n\n".join(b for b in blocks if count == 1 or b != "The Daily")


@pytest.mark.parametrize("part", ['<p title="', "<b>x</i>", "<b><h1>", "<!", "<a", "<p><button><h1>", "<i><div><b>x</i>"])
def test_broken_markup_is_read_in_linear_time(part):
    start = time.process_time()
    html_text.Page(part * (400_000 // len(part))).nodes()
    assert time.process_time() - start < 15


def test_pages_awkward_rows(spark):
    sources = [None, "", "just text", "<p>open <b>never closed", "<article>a<article>b", "<", "<a href='", "x<!--", "<script>x", "</p></div>t"]
    sources += ["<div>" * 2000 + "deep" + "</div>" * 2000, "<p>" + LONG + "</p>"]
    pages = page_rows(spark, sources).withColumn("url", F.when(F.col("page_id") % 2 == 0, F.col("url")))
    got = {r.page_id: r.text for r in html_text.main_text(with_clashes(pages.union(pages))).collect()}
    assert got[0] == got[1] == "" and got[2] == "just text" and got[3] == "open never closed" and got[4] == "a\n\nb"
    assert got[7] == "x" and got[8] == "" and got[9] == "t" and got[10] == "deep" and got[11] == LONG
    assert html_text.main_text(pages.limit(0)).collect() == []


# Decontamination


def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_against_the_full_table():
    r = random.Random(1)
    for _ in range(60):
        a = np.array(r.choices(range(6), k=r.randint(1, 14)), np.uint64)
        b = np.array(r.choices(range(6), k=r.randint(1, 30)), np.uint64)
        best = slow_align(a, b)
        assert decontamination.align(a, b) == decontamination.align(a, b, need=best) == best
        assert decontamination.align(a, b, need=best + 1) <= best <= 2 * decontamination.common_words(a, b)


def test_leaks_against_alignment_of_everything(spark, sf):
    docs, items = read(spark, sf, "documents").where("n_chars < 1500"), read(spark, sf, "benchmark")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, items).collect()}
    hashes = decontamination.Words()
    words = {r.doc_id: decontamination.word_hashes(r.text, hashes) for r in docs.collect()}
    expected = {}
    for r in items.collect():
        own = decontamination.word_hashes(r.text, hashes)
        for d, w in words.items():
            score = decontamination.align(own, w) / (2 * len(own))
            if score >= 0.5:
                expected[d, r.item_id] = score
    assert expected and got == pytest.approx(expected)


def edited_copies(text):
    words = text.split()
    return [
        " ".join("changed" if i % 5 == 2 else w for i, w in enumerate(words)),
        " ".join(w for i, w in enumerate(words) if i % 6),
        text.upper().replace(" ", "  ,"),
    ]


def test_edited_copies_are_found_in_blocks(spark, sf):
    items = read(spark, sf, "benchmark")
    own = [r for r in items.collect() if len(r.text.split()) >= 20][:10]
    filler = PROSE * 3
    texts = [(1000 * r.item_id + k, f"{filler} {t} {filler}", None, None, 0) for r in own for k, t in enumerate(edited_copies(r.text))]
    docs = documents(spark, texts + AWKWARD)
    for block in (20_000, 7):
        found = decontamination.contaminated(docs, items, block_items=block).collect()
        assert {t[0] for t in texts} <= {r.doc_id for r in found if r.doc_id // 1000 == r.item_id}
    kept = decontamination.keep_clean(with_clashes(docs), items, block_items=7)
    assert rows(kept, "doc_id", "text", "n") == rows(with_clashes(documents(spark)), "doc_id", "text", "n")


@pytest.mark.parametrize("copies", (4, 1000))
def test_equal_edits_are_found_however_many(spark, copies):
    """Every fifth word is replaced, so the trigrams that are left are the most frequent ones of the item."""
    item = " ".join(f"term{i}" for i in range(40))
    edited = " ".join("changed" if i % 5 == 2 else w for i, w in enumerate(item.split()))
    texts = [(k, f"filler {k} before {item if k < 2 else edited} and {k} after", None, None, 0) for k in range(copies + 2)]
    docs, items = documents(spark, texts), spark.createDataFrame([(1, item)], "item_id bigint, text string")
    score = {r.doc_id: r.score for r in decontamination.contaminated(docs, items).collect()}
    assert score == pytest.approx({k: 1.0 if k < 2 else 0.7 for k in range(copies + 2)})
    assert decontamination.keep_clean(docs, items).count() == 0


def leaks_of(texts, items, rare=decontamination.RARE):
    matcher = decontamination.Matcher(decontamination.seeds_of_items(items, rare), 0.5)
    return [matcher.matches(decontamination.word_hashes(t, decontamination.Words())) for t in texts]


def test_phrases_of_many_items_are_read_on():
    """Each seed is held by few items or as long as a seed may be, and the items are told apart all the same."""
    phrase = "which of the following statements is right about"
    items = [(i, f"{phrase} " + " ".join(f"thing{i}of{j}" for j in range(24))) for i in range(60)]
    seeds = decontamination.seeds_of_items(items)
    held = [len(set(seeds.item[np.searchsorted(seeds.bounds, seeds.places[a:b], side="right") - 1]))
            for a, b in zip(seeds.first, seeds.first[1:])]
    short = decontamination.grams_of(decontamination.word_hashes(phrase, decontamination.Words()))
    assert seeds.open[np.searchsorted(seeds.grams, decontamination.mix(short))].all()
    assert sum(h > decontamination.RARE for h in held) == 1  # the whole phrase, a quarter of the item
    edited = " ".join("other" if i % 5 == 4 else w for i, w in enumerate(items[7][1].split()))
    found = leaks_of([f"{PROSE} {items[3][1]}", f"{PROSE} {edited}", f"{PROSE} {phrase} nothing {PROSE}"], items)
    assert [[m[0] for m in f] for f in found] == [[3], [7], []]


def test_passages_of_long_items_and_long_texts():
    words = [f"w{i}" for i in range(256)]
    items = [(1, " ".join(words)), (2, " ".join(f"v{i}" for i in range(1000)))]
    filler = " ".join(f"f{i % 83}" for i in range(9000))
    part, short = " ".join(words[90:190]), " ".join(words[90:135])
    straddling = " ".join(f"v{i}" for i in range(206, 306))
    found = leaks_of([f"{filler} {part} {filler}", f"{filler} {short} {filler}", f"{filler} {straddling} {filler}"], items)
    assert [[m[0] for m in f] for f in found] == [[0], [], [1]]
    assert found[0][0][1] == pytest.approx(100 / 256)
    for at in range(3500, 5000, 113):  # wherever the stretches of a long text meet
        text = filler.split()[:at] + words + filler.split()
        assert leaks_of([" ".join(text)], items)[0][0][:2] == (0, 1.0)


def test_decontamination_awkward_rows(spark, sf):
    items = spark.createDataFrame(
        [(1, None), (2, ""), (3, "two words"), (4, PROSE), (5, PROSE), (None, PROSE), (6, LONG)], "item_id bigint, text string"
    )
    found = decontamination.contaminated(with_clashes(documents(spark)), with_clashes(items)).collect()
    assert Counter(r.item_id for r in found if r.doc_id == 2) == {4: 2, 5: 2, None: 2}
    assert [r.score for r in found if r.doc_id == 6] == [1.0]
    assert {r.doc_id for r in found} == {1, 2, 6, 7}
    assert decontamination.contaminated(documents(spark, []), items).collect() == []
    assert decontamination.contaminated(documents(spark), items.limit(0)).collect() == []


# Packing


def test_pieces_rebuild_every_document(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = read(spark, sf, "documents").where("doc_id % 7 = 0").unionByName(documents(spark).where("doc_id is not null"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter(
        (r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect()
    )
    pieces = packing.pack(docs).withColumn("crc", F.crc32("ids")).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and {p.offset for p in pieces} == {0}
    assert all(p.length & (p.length - 1) == 0 and p.length <= 4096 and 1 << p.bucket == p.length for p in pieces)
    assert all(zlib.crc32(p.ids) == p.crc and len(p.ids) == 4 * p.length for p in pieces)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for d, own in by_doc.items():
        copies = sum(n for (e, _), n in expected.items() if e == d)
        assert sum(p.length for p in own) == sum(len(ids) // 4 * n for (e, ids), n in expected.items() if e == d)
        if copies == 1:
            joined = b"".join(bytes(p.ids) for p in sorted(own, key=lambda p: p.start))
            assert (d, joined) in expected and own[0].doc_tokens == len(joined) // 4


def test_cut_is_a_power_of_two_decomposition():
    for n in (1, 2, 3, 4095, 4096, 4097, 10_000):
        cut = packing.cut(n, 4096)
        assert [s for s, _ in cut] == [sum(k for _, k in cut[:i]) for i in range(len(cut))]
        assert sum(k for _, k in cut) == n and all(k & (k - 1) == 0 for _, k in cut)
        assert len(cut) == n // 4096 + (n % 4096).bit_count()


def test_packing_awkward_rows(spark):
    special = [(1, "a <|endoftext|> b c\x1cd é", None, None, 0), (2, "X" * 100_000, None, None, 0)]
    chunks = packing.Chunks(None)
    for _, t, *_ in special:
        whole = chunks.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(chunks.encode(t), "<u4").tolist() == whole
    assert packing.pack(documents(spark, [])).collect() == []
    got = packing.pack(with_clashes(documents(spark))).where("doc_id = 3").collect()
    assert [(p.start, p.length, p.doc_tokens, bytes(p.ids)) for p in got] == [(0, 1, 1, b"\x02\0\0\0")]


# Sharding


def test_shards_match_the_mixture(spark, sf):
    docs = read(spark, sf, "documents")
    got = sharding.shard(docs, shards=8).collect()
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    sources = Counter(r.source for r in got)
    for source, n in sources.items():
        held = Counter(r.shard for r in got if r.source == source)
        assert all(abs(held[s] - n / 8) <= 2 for s in range(8))


def test_shards_awkward_rows(spark):
    got = sharding.shard(with_clashes(documents(spark))).collect()
    assert len(got) == len(AWKWARD) and len({r.shard for r in got}) == len(AWKWARD) and {r.slot for r in got} == {0}
    assert [(r.size, r.text_crc32) for r in got if r.doc_id == 3] == [(16, 0)]
    assert sharding.shard(documents(spark, [])).collect() == []


# Chat


def test_chat_plan_is_native(spark, sf):
    for name in ("op7_chat_preferences", "op9_sharding"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_prefix_is_rendered_once(spark):
    say = lambda *turns: [(r, t) for r, t in turns]
    pairs = [
        (1, say(("user", "q"), ("assistant", "good")), say(("user", "q"), ("assistant", "bad"))),
        (2, say(("user", "q")), say(("user", "q"), ("assistant", "x"))),
        (3, say(("user", "q")), say(("user", "q"))),
        (4, None, say(("user", "p"))),
        (None, [], []),
    ]
    turn = "array<struct<role:string,text:string>>"
    got = chat.format_pairs(spark.createDataFrame(pairs, f"pair_id bigint, chosen {turn}, rejected {turn}")).collect()
    by = {r.pair_id: r for r in got}
    assert by[1].prompt == "<|user|>\nq<|end|>\n" and by[1].chosen == "<|assistant|>\ngood<|end|>\n"
    assert [tuple(p) for p in by[1].rejected_parts] == [("assistant", 25, True)]
    assert by[2].prompt_turns == 1 and by[2].chosen == "" and by[2].rejected.startswith("<|assistant|>")
    assert (by[3].prompt_turns, by[3].chosen, by[3].rejected) == (1, "", "")
    assert (by[4].prompt, by[4].chosen, by[4].rejected) == ("", "", "<|user|>\np<|end|>\n")
    assert (by[None].prompt_turns, by[None].prompt) == (0, "")


def test_chat_awkward_rows(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (1, None, None, "z"), (2, 0, "assistant", LONG),
             (None, 0, "user", "lost"), (5, 3, "user", "")]
    frame = with_clashes(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.pair_id: r for r in chat.format_pairs(chat.pairs_from_conversations(frame)).collect()}
    assert set(got) == {1, 2, 5}
    assert LONG in got[1].rejected and got[2].rejected == "" and got[5].prompt_turns == 1
    assert chat.format_pairs(chat.pairs_from_conversations(frame.limit(0))).collect() == []


# Jaccard join


def brute_groups(pairs):
    """(id, size, smallest id of the component) of texts, comparing all of them."""
    sets = []
    for _, text in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    near = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                near[i].add(j)
    out = []
    for i, a in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((pairs[i][0], len(a), min((pairs[j][0] for j in seen if pairs[j][0] is not None), default=None)))
    return sorted(out, key=repr)


def chained_corpus(seed=3):
    """A base text, copies at every distance from it, chains of copies, and passages shared by strangers."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    base, shared = [word() for _ in range(120)], [word() for _ in range(40)]
    texts = []
    for k in range(120):
        copy = list(base)
        for _ in range(k % 9):
            copy[r.randrange(120)] = word()
        texts.append(copy)
    chain = list(base)
    for _ in range(40):
        chain = list(chain)
        chain[r.randrange(120)] = word()
        texts.append(chain)
    for k in range(90):
        texts.append(shared[: 20 + k % 20] + [word() for _ in range(k % 25)])
    r.shuffle(texts)
    return [(i, " ".join(t), None, None, 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("above,most", [(32, 1 << 18), (3, 1 << 18), (3, 5), (10_000, 1)])
def test_groups_against_brute_force(spark, above, most, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", min(above, 32))
    texts = chained_corpus()
    got = ngram_join.jaccard_groups(documents(spark, texts), above=above, most=most)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_groups([t[:2] for t in texts])


def test_groups_awkward_rows(spark):
    got = ngram_join.jaccard_groups(with_clashes(documents(spark)))
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_groups([r[:2] for r in AWKWARD])
    assert ngram_join.jaccard_groups(documents(spark, [])).collect() == []
    kept = ngram_join.keep_one_per_group(with_clashes(documents(spark)))
    assert kept.columns == with_clashes(documents(spark)).columns
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 2, 8: 1, 9: 1}
    assert {r.row_id for r in kept.collect()} == {"own row_id"}


def test_one_row_of_every_group_stays(spark):
    other = PROSE + " and the dog"
    texts = [(7, PROSE, "en", "a", 1)] * 50 + [(7, other, "en", "b", 2)] * 3 + [(9, PROSE, "en", "c", 3)]
    no_id = " ".join(f"plain{i}" for i in range(60))
    texts += [(None, no_id + x, None, None, 4) for x in ("", "", " more", " less")] + [(3, "", "en", None, 0)] * 2
    kept = ngram_join.keep_one_per_group(with_clashes(documents(spark, texts))).collect()
    assert Counter(r.doc_id for r in kept) == {7: 1, None: 1, 3: 2}
    assert all(r.row_id == "own row_id" for r in kept)
    assert ngram_join.keep_one_per_group(documents(spark, [])).collect() == []


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(5)
    for n, m, common in ((50, 60, 40), (500, 300, 250), (9000, 8000, 7000), (3, 90, 1)):
        h = r.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = np.unique(h[:n]), np.unique(np.concatenate([h[:common], h[n : n + m - common]]))
        bound = ngram_join.differing_bits(ngram_join.parity_bits(a), ngram_join.parity_bits(b))
        assert bound <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))


def test_components(spark):
    r = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    got = dict(tuple(x) for x in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for node in got:
        seen, todo = {node}, [node]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[node] == min(seen)
    assert set(got) == {n for a, b in links for n in (a, b) if a != b}


# Pipeline


def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "packing"]
    docs = read(spark, sf, "documents")
    columns, kept = docs.columns, [docs]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, kept[-1], sf).persist()
        assert out.columns == columns
        kept.append(out)
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] > ids[1] > ids[2] > ids[3] and ids[3] == ids[4]
    texts = [(r.doc_id, r.text) for r in kept[1].collect()]
    assert ids[2] == {c for _, _, c in brute_groups(texts)}
    leaks = {r.doc_id for r in decontamination.contaminated(kept[2], read(spark, sf, "benchmark")).collect()}
    assert ids[3] == ids[2] - leaks
    before, after = ({r.doc_id: r for r in k.collect()} for k in kept[3:5])
    changed = {d for d in after if after[d].text != before[d].text}
    # The smallest tables may hold no secret after the earlier stages.
    assert {d for d, r in before.items() if secret_scan.base_spans(r.text)} <= changed
    assert all(re.search("<(assign|hex|access|markov)>", after[d].text) for d in changed)
    assert all(r.n_chars == len(r.text) for r in after.values())
    pieces = P.STAGES[-1][1](spark, kept[4], sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids[4]


def test_pipeline_awkward_rows(spark, sf):
    import corpus_pipeline as P

    for frame in (with_clashes(documents(spark)), documents(spark, [])):
        kept = frame
        for _, stage in P.STAGES[:-1]:
            kept = stage(spark, kept, sf)
            assert kept.columns == frame.columns
        pieces = P.STAGES[-1][1](spark, kept, sf)
        assert pieces.count() >= kept.count()
