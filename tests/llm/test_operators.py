"""The operators against brute force, on odd rows, hot groups, and tables without rows."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from xml.etree import ElementTree

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import decontamination, exact, language, minhash, mixing, scoring, sharding, simple8b, tokens, urls
from tarnlake.llm.components import components
from tarnlake.llm.html import main_text
from tarnlake.llm.extraction import main_texts
from tarnlake.session import work_path

SPACE = re.compile("[\x20\x09-\x0d]")


def words(text):
    return [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


# sharding


def check_shards(rows, shards):
    by = defaultdict(list)
    groups = defaultdict(set)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        groups[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len(s) == 1 for s in groups.values())
    assert set(by) <= set(range(shards))


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        used, room = 1, middle
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def test_shards_of_odd_rows(odd, empty):
    rows = sharding.shard_documents(odd, 4).collect()
    assert len(rows) == odd.count()
    check_shards(rows, 4)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["size"] == 16 and by_id[4]["text_crc32"] == 0 and by_id[4]["shard"] == by_id[5]["shard"]
    assert sharding.shard_documents(empty).collect() == []


def test_shards_are_minimax(documents):
    rows = sharding.shard_documents(documents, 7).collect()
    check_shards(rows, 7)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    groups = defaultdict(int)
    for i, t in texts.items():
        groups[hashlib.sha256(t.encode()).digest()] += len(t.encode()) + 16
    sizes = [groups[k] for k in sorted(groups)]
    largest = max(Counter(r["shard"] for r in rows for _ in range(r["size"])).values())
    assert largest == smallest_capacity(sizes, 7) or largest <= smallest_capacity(sizes, 7)


@pytest.mark.parametrize("shards", [1, 2, 5, 17])
def test_cut_points_by_brute_force(spark, shards):
    random = np.random.default_rng(shards)
    for most in (1, 50, 100_000):
        sizes = random.integers(1, most + 1, 400).tolist() + [most * 30]
        starts = np.cumsum([0, *sizes[:-1]]).tolist()
        frame = spark.createDataFrame([(s,) for s in starts], "at long")
        capacity, cuts = sharding.cut_points(frame, sum(sizes), shards)
        assert capacity == smallest_capacity(sizes, shards)
        edges = [0, *cuts, sum(sizes)]
        assert set(edges) <= {*starts, sum(sizes)}
        assert edges == sorted(edges) and max(b - a for a, b in zip(edges, edges[1:])) <= capacity


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_written_shards_hold_every_row_once(spark, odd, documents, shards):
    """Repeated and missing ids; copies lie together; shards as the assignment has them."""
    docs = odd.unionByName(documents.limit(60), allowMissingColumns=True).withColumn("shard", F.lit("old"))
    path = work_path(spark, "shards")
    sharding.write_shards(docs, path, shards)
    rows = spark.read.parquet(path)
    columns = [c for c in docs.columns if c != "shard"]
    quoted = [f"`{c}`" for c in columns]
    assert Counter(map(tuple, rows.select(quoted).collect())) == Counter(map(tuple, docs.select(quoted).collect()))
    want = Counter((r["doc_id"], r["shard"]) for r in sharding.shard_documents(docs, shards).collect())
    assert Counter((r["doc_id"], r["shard"]) for r in rows.collect()) == want
    sharding.write_shards(docs.limit(0), work_path(spark, "none"), shards)


# tokens


@pytest.mark.parametrize("seed", range(5))
def test_simple8b_round_trip(seed):
    random = np.random.default_rng(seed)
    lengths = [0, 1, *random.integers(0, 300, 20).tolist(), 0]
    parts = [random.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) >> np.uint64(random.integers(0, 64)) for n in lengths]
    ends = np.cumsum(lengths)
    packed, many, escapes = simple8b.encode(np.concatenate(parts), ends)
    ids, starts = simple8b.decode(packed, escapes)
    at = np.cumsum(many) - many
    for k, part in enumerate(parts):
        assert (ids[starts[at[k]] : starts[at[k]] + len(part)] == part).all()


def test_lower_case_changes_no_token():
    """Letters with combining marks, special tokens in other letter cases, and odd capitals."""
    from tokenizers import Tokenizer

    file = str(public_tokenizers.path("word_bpe_49k.json"))
    whole, encoder = Tokenizer.from_file(file), tokens.Encoder(open(file, encoding="utf-8").read())
    assert encoder.simple
    marks, letters = "\u0300\u0307\u030a\u0331\u0338\u0345", "HIWYTAJKhiwytajk\u212a\u0130\u00df\u1e9e\u01c5"
    texts = [f"{a}{m} x{a}{m}y, {a}." for a in letters for m in marks]
    texts += ["<|EndOfText|> A", "A<|endoftext|>B", "<|ENDOFTEXT|>", "HELLO World. IT'S DON'T (X1) \u00c9COLE", "A\u00adB", "\ufb01N"]
    for t in texts:
        assert np.frombuffer(encoder.text(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_are_those_of_whole_texts(spark, odd, documents, name):
    from tokenizers import Tokenizer

    file = str(public_tokenizers.path(name))
    whole = Tokenizer.from_file(file)
    docs = odd.select("doc_id", "text").unionByName(documents.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    path = work_path(spark, "tokens")
    tokens.write_tokens(docs, path, file, end_id=7, parts=5)
    rows = tokens.document_index(spark, path).orderBy("start").collect()
    want = Counter()
    for r in docs.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [7]
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows[:-1]]).tolist()


def test_no_tokens(spark, empty):
    path = work_path(spark, "tokens")
    tokens.write_tokens(empty, path, str(public_tokenizers.path("word_bpe_49k.json")))
    assert tokens.document_index(spark, path).collect() == []


# extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1 class="logo">Site</h1></header><nav><a href=/>Home</a></nav>
<form id="page"><main><article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>
 paragraph&nbsp;with a <a href="x>y">link</a>, long enough to matter.<p>Second one &lt;here&gt;<br>goes on and on and on.
<div class="ad">Buy!</div><ul><li>one<li>two</ul><script>if (a < b) document.write("</p>")</script>
<!-- note --><p>No.</p></article></main></form><aside>Side text that is quite long, really long, longer than the rest.</aside>
<div class="cookie-notice">We use cookies and this is a very long text about them.</div>
<section id="comments"><p>A reader comments at length on what was written above, again and again.</p></section>
<footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    want = ["Head & line", "First bold paragraph with a link, long enough to matter.", "Second one <here> goes on and on and on.", "one", "two", "No."]
    assert main_text(PAGE) == "\n".join(want)
    text = "A paragraph that has a fair number of words in it, as text has."
    body = f"<p>{text}</p>" * 4
    menu = "<div>" + "<a href=/a>Link text</a> " * 12 + "</div>"
    assert main_text(f"<body>{menu}<div><div>{body}</div></div>{menu}") == "\n".join([text] * 4)
    assert main_text("") == main_text("<script>x</script>") == ""
    assert main_text("just text") == "just text"


@pytest.mark.parametrize(
    "around",
    [
        "<form id=aspnetForm><input name=q><div id=content>{}</div><button>Send</button></form>",
        "<div class='content has-sidebar'>{}<div class=sidebar>Beside it.</div></div>",
        "<div class=widget-content><fieldset>{}</fieldset></div>",
        "<section id=search-results><form><div class='post comments-open'><h1></h1>{}<div id=comments>I agree.</div></div></form></section>",
        "<div role=search>{}</div>",
        "<main class='has-ads related'>{}</main>",
        "<p>You are here</p><div class='post with-comments'>{}</div>",
    ],
)
def test_main_text_in_what_is_named_like_a_part(around):
    text = "A paragraph that has a fair number of words in it, as text has."
    menu = "<div class=menu>" + "<a href=/a>Link text</a> " * 12 + "</div>"
    page = "<body><nav><a href=/>Home</a></nav>" + menu + around + "<footer>Imprint</footer></body>"
    found = main_text(page.format(f"<p>{text}</p>" * 4)).split("\n")
    assert [f for f in found if f != "You are here"] == [text] * 4


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("part", ["section id=comments", "div class=ad", "div class=cookie-notice"])
def test_long_parts_beside_a_short_text_stay_out(tag, part):
    text = "A paragraph that has a fair number of words in it, as text has."
    said = f"<{part}>" + "<p>Something else is said at length beside what was written above, again.</p>" * 9 + f"</{part.split()[0]}>"
    assert main_text(f"<body><{tag}><p>{text}</p><p>{text}</p></{tag}>{said}</body>") == text + "\n" + text


@pytest.mark.parametrize(
    "part",
    [
        "<p class='related'>{}</p>", "<p id='search-algorithms'>{}</p>", "<h2 id='social-sharing'>{}</h2>",
        "<section id='banner-history'><p>{}</p></section>", "<div class='form-of-government'>{}</div>",
        "<p><math><mi>{}</mi></math></p>", "<div class='has-ads'><p id=comment>{}</p></div>", "<td class='notice'>{}</td>",
    ],
)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_parts_of_an_article_stay_for_what_they_are_about(tag, part):
    text = "A paragraph that has a fair number of words in it, as text has."
    said = "What this part of the article says is kept with all that is beside it."
    assert main_text(f"<body><{tag}><p>{text}</p>{part.format(said)}<p>{text}</p></{tag}></body>") == "\n".join([text, said, text])


@pytest.mark.parametrize(
    "name",
    ["ad", "ad-slot", "google_ads", "ad300x250", "sidebar", "left-sidebar", "user-comments", "comment-list", "related-posts", "shareButtons",
     "cookie-banner", "site-footer", "breadcrumb", "newsletter-signup-box", "sponsored-content", "nav-main"],
)
def test_parts_named_as_such_go(name):
    text = "A paragraph that has a fair number of words in it, as text has."
    page = "<body><article><p>{0}</p><div {1}><p>Gone.</p></div><p>{0}</p></article></body>"
    assert main_text(page.format(text, f"class='x {name}'")) == main_text(page.format(text, f"id={name}")) == f"{text}\n{text}"


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "x", "<b></i>" * 50_000, "<x-y>" * 100_000 + "x", "<ul>" + "<li><b>" * 50_000 + "x", "<nav>" + "<article>" * 50_000,
     "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<title>" * 50_000, "<article class=ad>" * 50_000 + "x", "<form>" * 50_000 + "x", "<a '" * 50_000],
)
def test_main_text_is_linear_in_depth(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 15


def brute_main_text(page):
    """By the definition: densities and sums of every element of a well-formed page, subtrees that reach the threshold."""
    body = ElementTree.fromstring(page)
    inline = {"a", "b", "span"}
    up = {c: e for e in body.iter() for c in e}

    def size(e, links_only=False, inside=False):
        inside = inside or e.tag == "a"
        own = [e.text, *(c.tail for c in e)]
        n = sum(len("".join((t or "").split())) for t in own) if inside or not links_only else 0
        return n + sum(size(c, links_only, inside) for c in e)

    within = lambda e: any(a.tag == "a" for a in ancestors(e))

    def ancestors(e):
        while e in up:
            e = up[e]
            yield e

    total, links = size(body), size(body, True)

    def density(e):
        c, lc = size(e), size(e, True, within(e))
        if not c:
            return 0.0
        t, lt = max(1, sum(1 for _ in e.iter()) - 1), max(1, sum(x.tag == "a" for x in e.iter()) - (e.tag == "a"))
        base = math.log(c / max(1, c - lc) * lc + links / max(1, total) * c + math.e)
        ratio = c / max(1, lc) * t / lt
        adjust = math.log(ratio) / math.log(base) if base > 1.0000001 else 1.0 + math.log(max(ratio, 1.0))
        return c / t * max(adjust, 0.0)

    densities = {e: density(e) for e in body.iter()}
    sums = {e: sum(densities[c] for c in e if c.tag not in inline) for e in body.iter() if e.tag not in inline}
    best = lambda e: max((x for x in e.iter() if x in sums), key=lambda x: sums[x])
    chosen = best(body)
    limit = min([densities[chosen], *(densities[a] for a in ancestors(chosen))])
    marked, todo = set(), [body]
    while todo:
        e = todo.pop()
        if densities[e] >= limit and size(e):
            marked.add(best(e))
            todo += [c for c in e if c in sums]
    blocks, block = [], []

    def walk(e, kept):
        kept = kept or e in marked
        edge = e.tag not in inline
        if edge:
            blocks.append(block.copy())
            block.clear()
        block.append((e.text or "") if kept else "")
        for c in e:
            walk(c, kept)
            block.append((c.tail or "") if kept else "")
        if edge:
            blocks.append(block.copy())
            block.clear()

    walk(body, False)
    found = [" ".join("".join(b).split()) for b in blocks]
    return "\n".join(f for f in found if f)


@pytest.mark.parametrize("seed", range(60))
def test_main_text_by_the_definition(seed):
    random = np.random.default_rng(seed)

    def element(depth):
        tag = random.choice(["div", "div", "p", "section", "a", "b", "span"]) if depth else "body"
        if tag in ("p", "a", "b", "span"):
            inner = text() if tag != "p" else text() + "".join(f"<{t}>{text()}</{t}>{text()}" for t in random.choice(["a", "b"], random.integers(0, 3)))
        else:
            inner = "".join(text() + element(depth + 1) for _ in range(random.integers(1, 5))) if depth < 5 else text()
        return f"<{tag}>{inner}</{tag}>"

    def text():
        return " ".join(f"w{random.integers(0, 999)}" for _ in range(random.choice([0, 1, 3, 20])))

    page = element(0)
    assert main_text(page) == brute_main_text(page)


def test_main_texts_rows(spark):
    rows = [(1, None, None, "a"), (1, "u", "", "b"), (2, "u", PAGE, "c"), (2, "u", PAGE, "c"), (None, "u", "<p>x" * 20000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = main_texts(pages.withColumn("a.b", F.lit(1)))
    assert found.columns == ["page_id", "url", "a.b", "text", "n_chars"]
    got = {(r["page_id"], r["url"]): r for r in found.collect()}
    assert got[1, None]["text"] == "" and got[2, "u"]["text"].startswith("Head") and got[None, "u"]["n_chars"] == 39999
    assert main_texts(pages.select("html")).count() == 5 and main_texts(pages.limit(0)).collect() == []


# scoring


@pytest.mark.parametrize("frequent", [scoring.FREQUENT, 5, 0])
def test_base_scores(odd, frequent):
    docs = odd.withColumn("held_out", F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False)))
    model, table = scoring.train(docs.filter("NOT held_out"), frequent=frequent)
    counts, known = Counter(), docs.collect()
    for r in known:
        if not r["held_out"]:
            counts.update([*words(r["text"]), " "])
    total = sum(counts.values())
    want = Counter()
    for r in known:
        own = [*words(r["text"]), " "]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in own)
        want[r["doc_id"], r["held_out"], len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)] += 1
    rows = scoring.scored(docs, model, table).collect()
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)


def test_scores_by_counting(odd, documents, monkeypatch):
    """The documented smoothing on exact counts of words and pairs, quantised as documented, by a filter so large that there
    are no false hits; by the usual one the scores are near."""
    monkeypatch.setattr(scoring, "BITS_PER_NGRAM", 128)
    docs = odd.unionByName(documents.limit(80), allowMissingColumns=True).withColumn("held_out", F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False)))
    model, table = scoring.train(docs.filter("NOT held_out"))
    word, pair, rows = Counter(), Counter(), docs.collect()
    tokens = lambda r: [*words(r["text"]), " "]
    for r in rows:
        if not r["held_out"]:
            own = tokens(r)
            word.update(own)
            pair.update(zip([" ", *own], own))
    total = sum(word.values()) + 0.5 * (len(word) + 1)

    def level(c):
        low = 2 ** math.floor(math.log2(c)) if c else 0
        return 0.0 if not c else 1.0 if low == 1 else low * 1.5

    want = Counter()
    for r in rows:
        score, before = 0.0, " "
        for t in tokens(r):
            v, own = level(word[before]), (level(word[t]) + 0.5) / total
            score += math.log10(min((min(level(pair[before, t]), v) + scoring.MIXED_IN * own) / (v + scoring.MIXED_IN), 1.0))
            before = t
        want[r["doc_id"], round(score, 6)] += 1
    got = Counter((r["doc_id"], round(r["score"], 6)) for r in scoring.scored(docs, model, table).collect())
    assert got == want
    monkeypatch.setattr(scoring, "BITS_PER_NGRAM", 8)
    model, table = scoring.train(docs.filter("NOT held_out"))
    usual = sorted((r["doc_id"] or 0, r["score"], r["n_tokens"]) for r in scoring.scored(docs, model, table).collect())
    for (_, score, n), (_, other) in zip(usual, sorted((i or 0, s) for i, s in got.elements())):
        assert abs(score - other) <= 0.02 * abs(other) + 0.5 and n > 0


def test_score_without_training(odd, empty):
    model, table = scoring.train(empty)
    rows = scoring.scored(odd.withColumn("held_out", F.lit(True)), model, table).collect()
    assert {r["base_score"] for r in rows} == {0.0} and {r["n_known"] for r in rows} == {0}


def test_filter_holds_all_counts(spark):
    docs = spark.createDataFrame([(" ".join(["a"] * 40 + ["b c"] * 9 + [f"w{i}" for i in range(500)]),)], "text string")
    model, _ = scoring.train(docs)
    seen = scoring.tokens_of(docs.first()[0].encode())
    different, counts = np.unique(seen, return_counts=True)
    levels = model.filter.levels(different)
    assert (levels >= scoring.level_of(counts)).all()  # never too low
    assert (levels == scoring.level_of(counts)).mean() > 0.98
    unseen = scoring.hashes_of([b"x%d" % i for i in range(1000)])
    assert (model.filter.levels(unseen) > 0).mean() < 0.05


@pytest.mark.parametrize("together", [scoring.TOGETHER, 50])
def test_scores_do_not_change_when_the_filter_is_no_broadcast(odd, documents, monkeypatch, together):
    monkeypatch.setattr(scoring, "RANGE_BLOCKS", 2)
    monkeypatch.setattr(scoring, "TOGETHER", together)
    docs = odd.select("doc_id", "text").unionByName(documents.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    docs = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False)))
    rows = []
    for bits in (scoring.LIMIT_BITS, 18):
        model, table = scoring.train(docs.filter("NOT held_out"), limit_bits=bits)
        assert (model.filter is None) == (bits == 18) and model.total > 2
        rows.append(sorted(map(str, scoring.scored(docs, model, table).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == docs.count()


def test_pairs_beat_words_on_held_out_text(spark):
    text = "to be or not to be that is the question whether it is nobler in the mind to suffer"
    docs = spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")
    docs = docs.withColumn("held_out", F.col("doc_id") == 3)
    model, table = scoring.train(docs.filter("NOT held_out"))
    row = scoring.scored(docs, model, table).filter("held_out").first()
    assert row["score"] > row["base_score"]


# near duplicates


def brute_components(docs, percent=85):
    sets, ids = [], []
    for r in docs.collect():
        w = words(r["text"])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        ids.append(r["doc_id"])
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    first = {}
    for a, i in enumerate(ids):
        if sets[a] and i is not None:
            first[find(a)] = min(first.get(find(a), i), i)
    return Counter((ids[a], len(sets[a]), first.get(find(a)) if sets[a] else ids[a]) for a in range(len(ids)))


def test_near_duplicates(odd, empty, documents):
    for docs in (odd, documents):
        rows = minhash.near_duplicates(docs).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == brute_components(docs)
        assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in rows)
    assert minhash.near_duplicates(empty).collect() == []
    assert minhash.deduplicated(odd).columns == odd.columns
    assert sorted(r[0] or 0 for r in minhash.deduplicated(odd).select("doc_id").collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10, 11]


@pytest.mark.parametrize("bits", [24, 4])
def test_each_component_keeps_one_row(spark, monkeypatch, bits):
    monkeypatch.setattr(minhash, "TABLE_BITS", bits)
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    near, longer = one + " end", one + " with an end"
    rows = [
        (1, one, "x"), (1, two, "y"),  # two texts under one id
        (2, near, "x"), (2, three, "x"),  # a near copy under the id of a kept row
        (None, two, "x"), (None, "d e f g h", "x"), (None, "d e f g h", "x"),  # copies without an id
        (3, "k l m n o", "x"), (3, "k l m n o", "x"),  # equal rows
        (1, longer, "x"), (4, "", "x"), (4, None, "x"), (None, None, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(3)
    got = Counter(map(tuple, minhash.deduplicated(docs).collect()))
    want = [(1, longer, "x"), (1, two, "y"), (2, three, "x"), (None, "d e f g h", "x"), (3, "k l m n o", "x"), *rows[-3:]]
    assert got == Counter(want)


def test_large_family_of_near_copies(spark, monkeypatch):
    """Copies that are near to some of each other only, in buckets dealt out to slices and salts."""
    monkeypatch.setattr(minhash, "HELD", 8)
    monkeypatch.setattr(minhash, "PASSING", 16)
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for at in random.integers(0, 120, random.integers(1, 5)):
            text[at] = f"v{random.integers(0, 40)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(docs)


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


def test_min_max_estimates_similarity():
    random = np.random.default_rng(3)
    values = random.integers(0, 1 << 62, 3000).astype(np.uint64)
    factors = minhash._multipliers(500)
    a, b = (minhash.signature(minhash.mixed(v), factors) for v in (values[:2000], values[1000:]))
    assert abs((a == b).mean() - 1 / 3) < 0.07


# decontamination


def brute_hits(docs, items):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    cut = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for r in items.collect():
        w = cut(r["text"])
        n = min(10, len(w))
        windows += [(r["item_id"], tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = Counter()
    for r in docs.collect():
        w, hit, found = cut(r["text"]), set(), set()
        for item, window in windows:
            n = len(window)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit.update(range(i, i + n))
                    found |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[r["doc_id"], len(w), len(hit), len(found), digest, bool(hit)] += 1
    return out


@pytest.mark.parametrize("limit", [decontamination.LIMIT, 40])
def test_decontamination(odd, empty, items, limit):
    found = decontamination.report(decontamination.hits(odd, items, limit=limit))
    assert Counter(map(tuple, found.collect())) == brute_hits(odd, items)
    clean = decontamination.decontaminated(odd, items, limit=limit)
    assert clean.columns == odd.columns and clean.count() == sum(n for r, n in brute_hits(odd, items).items() if not r[-1])
    cut = decontamination.decontaminated(odd, items, remove="spans", limit=limit)
    assert cut.count() == odd.count() and cut.filter("doc_id = 4").first()["text"] is None
    assert cut.filter("doc_id = 11").first()["text"] == " three"
    assert decontamination.hits(empty, items, limit=limit).collect() == []
    assert not decontamination.report(decontamination.hits(odd, items.limit(0))).filter("contaminated").count()


def test_spans_do_not_depend_on_the_parts_of_the_benchmark(spark):
    """Passages that overlap, and words that would become neighbours when others go."""
    words = [f"w{i}" for i in range(60)]
    passages = [(i, " ".join(words[at : at + 10])) for i, at in enumerate(range(0, 40, 5))]
    passages += [(20, "x1 x2 x3 x4"), (21, " ".join(words[3:13])), (22, "y1 y2")]
    texts = [" ".join(words), "x1 x2 y1 y2 x3 x4 stays", "a " + " ".join(words[7:33]) + " z", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(passages, "item_id long, text string")
    cut = lambda limit: {r[0]: r[1] for r in decontamination.decontaminated(docs, items, remove="spans", limit=limit).collect()}
    whole = cut(decontamination.LIMIT)
    assert whole[1].split() == "x1 x2 x3 x4 stays".split() and whole[4] is None
    assert cut(100) == whole == cut(60)


# language


def brute_bayes(rows, text, bits):
    """Multinomial naive Bayes by counting n-grams one by one; the n-grams are those of the docstring."""

    def grams(t):
        clean = f" {' '.join(re.sub(r'[^a-zäöüßéèçñ]+', ' ', t.lower()).split())} "
        for n in language.ORDERS:
            for i in range(len(clean) - n + 1):
                h = n
                for c in clean[i : i + n]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % (1 << 64)
                    h ^= h >> 29
                yield (h * 0xBF58476D1CE4E5B9 % (1 << 64)) >> (64 - bits)

    counts, texts = defaultdict(Counter), Counter()
    for t, lang in rows:
        texts[lang] += 1
        counts[lang].update(grams(t))
    scores = {}
    for lang in counts:
        total = sum(counts[lang].values()) + language.SMOOTHING * (1 << bits)
        scores[lang] = math.log(texts[lang] / sum(texts.values())) + sum(
            math.log((counts[lang][b] + language.SMOOTHING) / total) for b in grams(text)
        )
    best = max(scores, key=lambda x: (scores[x], -ord(x[0])))
    return best, 1 / sum(math.exp(s - scores[best]) for s in scores.values())


def test_language_by_counting(spark):
    rows = [("the cat and the dog, the end", "en"), ("the hat of the man", "en"), ("der Hund und die Katze", "de"), ("die Tür", "de"), ("le chat et la porte", "fr")]
    model = language.train(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    for text in ("the dog", "die Katze und der Hut", "la porte du chat", "xyz", "Tür 12 hat", "a"):
        lang, score = model.predict(text)
        want = brute_bayes(rows, text, model.bits)
        assert lang == want[0] and score == pytest.approx(want[1], rel=1e-9)


# language


def test_language(odd, empty, documents):
    model = language.train(documents.filter(~language.held_out(F.col("doc_id"), 4, 2)))
    found = language.identify(documents, model)
    right = found.filter(language.held_out(F.col("doc_id"), 4, 2)).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] > 0.9
    rows = {r["doc_id"]: r for r in language.identify(odd.withColumn("score", F.lit("x")), model).collect()}
    assert [rows[i]["lang_pred"] for i in (4, 5, 6, 8)] == ["und"] * 4
    assert rows[7]["lang_pred"] == "de" and 0 <= rows[7]["score"] <= 1
    assert language.accepted(odd, model).columns == odd.columns
    nothing = language.train(empty)
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(empty, model).collect() == []


def test_buckets_of_slices_are_those_of_the_whole(monkeypatch):
    text = "Ein längerer Text, der in Stücke geteilt wird. " * 9
    whole = np.sort(np.concatenate(list(language.buckets(text, 12))))
    monkeypatch.setattr(language, "SLICE", 50)
    assert (np.sort(np.concatenate(list(language.buckets(text, 12)))) == whole).all()


# url rules


def test_url_rules(spark):
    rules = [
        ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
        ("block", "example.com", "/en/a/"), ("allow", "example.com", "/en/a/b"), ("block", "b.c.net", ""), (None, "x", "/"), ("block", "com", "/"),
    ]
    hosts = ["com", "example.com", "WWW.Example.com", "a.example.com", "xexample.com", "b.c.net", "z.b.c.net", "c.net", "net", "x", ""]
    paths = ["", "/", "/en", "/en/", "/en/a/", "/en/a/b", "/en/a/c?x=/en/a/b", "/es/#top", "?q", "/en/\n\U0010fffe"]
    made = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    made += [(None, None), (1, "mailto:x"), (1, ""), (2, "a://b://c.com/d"), (2, "a://b://c.com/d")]
    pages = spark.createDataFrame(made, "page_id long, url string").withColumn("rule", F.lit("old"))
    got = urls.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), salts=3)

    def want(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if v and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    assert Counter((r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()) == Counter((u, *want(u)) for _, u in made)
    none = urls.judge_urls(pages, urls.rule_frame(spark, []))
    assert {(r["rule"], r["verdict"]) for r in none.collect()} == {(None, "allow")}
    assert urls.judge_urls(pages.limit(0), urls.rule_frame(spark, urls.RULES)).collect() == []


# mixing


def test_mix(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    assert sorted(map(tuple, mixing.mix(odd.repartition(1)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    targets = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    assert abs(sum(t for _, t in targets.values()) - sum(s for s, _ in targets.values())) < 1e-6
    assert all(t <= 3 * s + 1e-6 for s, t in targets.values())
    assert mixing.mix(empty).collect() == []
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["copies"] for r in rows if r["size"])


def test_targets_by_rounds_of_resharing(spark):
    random = np.random.default_rng(2)
    for _ in range(3):
        sizes = {f"s{i:02}": int(n) for i, n in enumerate(random.integers(0, 1000, 12))}
        frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
        names, left, open_, want = sorted(sizes), float(sum(sizes.values())), set(sizes), {}
        weight = {n: mixing.WEIGHTS[i % 3] for i, n in enumerate(names)}
        while open_:
            total = sum(weight[n] for n in open_)
            full = {n for n in open_ if left * weight[n] / total > 3 * sizes[n]}
            for n in full or open_:
                want[n] = 3.0 * sizes[n] if full else left * weight[n] / total
            left -= sum(want[n] for n in full)
            open_ = open_ - full if full else set()
        assert got == pytest.approx(want)


def test_mix_of_a_hot_source(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 50 as int)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 20)) AS source")
    rows = mixing.mix(docs).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= max(2, 0.01 * r["target"]) for r in rows)


@pytest.mark.parametrize("swept", [1, 7, urls.SWEPT])
def test_urls_keep_every_column_and_host_size(spark, swept):
    """Columns with the names used inside, and rule hosts of any number of urls."""
    rows = [(i, f"http://{'www.' * (i % 2)}example.{'com' if i % 3 else 'net'}/{'en' if i % 5 else 'fr'}/{i}", i * 2, "b") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, _row long, box string").withColumnRenamed("box", "row")
    found = urls.judge_urls(pages, urls.rule_frame(spark, urls.RULES), swept=swept)
    assert found.columns == ["page_id", "url", "_row", "row", "host", "path", "rule", "verdict"]
    for r in found.collect():
        host, path = r["host"], r["path"]
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (r["_row"], r["row"]) == (2 * r["page_id"], "b") and (r["rule"], r["verdict"]) == want


def test_windows_of_a_large_benchmark_are_built_fast():
    """8 MB of items, many with a shared passage: built in seconds, sent small, and found as by brute force."""
    random = np.random.default_rng(1)
    vocabulary = [f"w{i}x{'y' * (i % 5)}" for i in range(5000)]
    shared = " ".join(vocabulary[:12])
    items = [(str(k), " ".join([*random.choice(vocabulary, 50), shared if k % 3 == 0 else "end"]).encode()) for k in range(20_000)]
    began = time.process_time()
    windows = decontamination.Windows(items, decontamination.WINDOW)
    assert time.process_time() - began < 5 * 3
    text = ["a", *items[7][1].decode().split()[5:25], "b", *vocabulary[1:11], "c"]
    spans, found = windows.find([w.encode() for w in text])
    assert spans == [(1, 21), (22, 32)] and found == {"7", *(str(k) for k in range(0, 20_000, 3))}


# exact duplicates


@pytest.mark.parametrize("block", [4, exact.BLOCK])
def test_exact_duplicates(odd, empty, documents, block):
    for docs in (odd, documents):
        groups = defaultdict(list)
        for r in docs.collect():
            groups[SPACE.sub("", r["text"] or "")].append((-len(r["text"] or ""), math.inf if r["doc_id"] is None else r["doc_id"]))
        want = Counter()
        for text, members in groups.items():
            best = min(members)
            for k, m in enumerate(sorted(members)):
                ids = [None if x[1] == math.inf else x[1] for x in (m, best)]
                want[(*ids, len(members), k == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
        assert Counter(map(tuple, exact.exact_duplicates(docs, block).collect())) == want
    assert exact.exact_duplicates(empty, block).collect() == []


@pytest.mark.parametrize("few", [1, exact.FEW])
def test_one_row_of_each_text_stays(spark, odd, empty, monkeypatch, few):
    """Texts that share an id or have none; a large group; the longest text and then the smallest id stays."""
    monkeypatch.setattr(exact, "FEW", few)
    rows = [(1, "a b", "x"), (1, "c", "x"), (None, "d", "x"), (None, "e f", "x"), (None, "ef", "x"), (1, "ab", "y"), (2, "a  b", "z"), (1, "c", "x")]
    rows += [(100 + i, "the  same" if i in (7, 9) else "the same", "h") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(3)
    got = sorted((r[0] or 0, r[1], r[2]) for r in exact.without_duplicates(docs).collect())
    assert got == [(0, "d", "x"), (0, "e f", "x"), (1, "c", "x"), (2, "a  b", "z"), (107, "the  same", "h")]
    kept = exact.without_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == exact.exact_duplicates(odd).filter("kept").count() == 9
    assert exact.without_duplicates(empty).collect() == []


def test_naming_splits_a_hot_value(spark):
    rows = spark.range(5000).selectExpr("id AS row", "cast(if(id % 3 > 0, 'hot', concat('v', id % 700)) AS binary) AS value")
    named = exact.named(rows.repartition(7), ["value"], ["row"]).collect()
    by_name = defaultdict(set)
    for r in named:
        by_name[r["name"]].add("hot" if r["row"] % 3 else f"v{r['row'] % 700}")
    values = sorted({v for s in by_name.values() for v in s})
    assert [by_name[i] for i in range(len(values))] == [{v} for v in values]
