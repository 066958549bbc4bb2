"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tabspark.llm import decontaminate, html_text, langid, line_dedup, near_dedup, nearest, pieces, pii, queries, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node int, start int, items string, h string, n int"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus() -> list[tuple]:
    draw = random.Random(11)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ü", "st"]

    def word():
        return "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))

    def text(n):
        return " ".join(draw.choice(["\n", "", "", "", "", "."]).join([word(), ""]) for _ in range(n))

    base = [text(draw.choice([1, 3, 4, 9, 40, 150, 300])) for _ in range(25)]
    shared = [text(70).replace("\n", "") for _ in range(4)]
    out = [None, "", " ", "\n\n", "a", "Ä", "1234567", "z" * 900, "ab " * 400, "x" * 70_000, base[0], base[0], text(9_000)]
    for _ in range(90):
        t = draw.choice(base)
        for _ in range(draw.choice([0, 0, 1, 2, 5])):
            p = draw.randint(0, len(t))
            t = t[:p] + draw.choice([word(), " ", "\n" + draw.choice(shared) + "\n", ""]) + t[p + draw.randint(0, 3) :]
        out.append(t)
    rows = [(i, t, draw.choice(["en", "fr", None]), "s", None, "r", i, None, "x", None, 3) for i, t in enumerate(out)]
    return rows + [rows[20], rows[20], (None, base[5], None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    """Sets of the rows' other values per doc_id."""
    out = defaultdict(set)
    for r in df.collect():
        out[r[0]].add(tuple(r)[1:])
    return out


def expected(values):
    out = defaultdict(set)
    for r, v in zip(corpus(), values):
        out[r[0]].add(v)
    return out


# --- 1 -----------------------------------------------------------------------
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == 2 and 13 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == 3 and 9 <= len(digits) <= 15)
            ):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    draw = random.Random(3)
    bits = ["@", ".", "a", "b-c", " ", "1", "23", "255", "256", "+4", "(", ")", "-", "é", "\n", "4111 1111 1111 1111", "a.b@c.de", "10.0.0.255", "+1 (555) 123-4567"]
    for _ in range(4000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_texts_without_white_space_are_quick():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 100_000, "a@" * 50_000, "+" * 100_000):
        pii.nodes(text)


def test_skip_edges_join_distant_repeats(spark):
    good = "call +1 (555) 123-4567 now"
    rows = [(i, f"{good} " + "word " * 40 + "again 15551234567 please") for i in range(40)] + [(99, None), (100, ""), (101, "id 15559999999")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    for fitted in (model.spans(rows[0][1]), model.spans("+1 (555) 123-4567 " + "word " * 40 + "15551234567, " + "word " * 40 + "15551234567")):
        assert fitted[1] and {k for k, _, _ in fitted[1]} == {3}
    assert model.skip > 1 and model.spans("id 15559999999") == ([], [])
    strong = pii.SkipChain(np.zeros((pii.FEATURES, pii.LABELS)), 0.0, 4.0)
    base, added = strong.spans(rows[0][1])
    assert base == [(3, 5, 22)] and [rows[0][1][a:b] for _, a, b in added] == ["15551234567"] and added[0][0] == 3
    assert strong.spans("id 15559999999") == ([], [])
    out = {r.doc_id: r.pii for r in pii.find_pii(docs, strong).collect()}
    assert out[0].n_phone == 1 and out[0].n_added == 1 and out[0].spans.startswith("phone:5:22,phone:")
    assert out[0].base_sha256 == sha("phone:5:22") and out[99].base_sha256 == out[100].base_sha256 == sha("") and out[99].spans == ""


def test_fitted_field_adds_planted_repeats(spark, small_dir):
    """Weights learnt from the given documents: repeats of a span in another form are found, numbers alone and other repeats are not."""
    model = pii.fit(queries.table(spark, small_dir, "documents"))
    gap = " word" * 30 + " "
    for kind, base, again in (
        (3, "+44 20 7946 0958", ["442079460958", "442079460958"]),
        (3, "+44 20 7946 0958", ["442079460958"] * 100),
        (3, "+1 (555) 123-4567", ["555-123-4567", "(555) 123-4567", "15551234567"]),
        (1, "97.51.17.173", ["975117173"]),
        (0, "jan.novak@mail7.example.com", ["jan.novak@mail7", "Jan.Novak@mail7"]),
    ):
        text = base + gap + gap.join(again) + gap
        found, added = model.spans(text)
        assert [(k, text[a:b]) for k, a, b in found] == [(kind, base)]
        assert sorted((k, text[a:b]) for k, a, b in added) == sorted((kind, x) for x in again), base
        assert model.spans(gap + gap.join(again) + gap) == ([], [])
    assert model.spans("call +44 20 7946 0958" + gap + "441234567890" + gap + "4556737586899850")[1] == []


@pytest.mark.parametrize("repeats", [1, 3, 100])
def test_every_repeat_of_a_base_span_is_added(repeats):
    text = "call +1 (555) 123-4567 now" + (" word" * 20 + " again 15551234567 please") * repeats
    even = pii.SkipChain(np.zeros((pii.FEATURES, pii.LABELS)), 0.0, 4.0)
    base, added = even.spans(text)
    assert base == [(3, 5, 22)] and len(added) == repeats and {(k, text[a:b]) for k, a, b in added} == {(3, "15551234567")}
    assert even.spans("again 15551234567 please " * repeats) == ([], [])


def test_spokes_stand_for_the_pair_weight():
    for weight in (0.0, 0.7, 4.0):
        unary = np.random.default_rng(5).normal(size=(2, pii.LABELS))
        pair = pii.propagate(unary, np.array([[0, 1]]), np.array([weight]))
        star = pii.propagate(np.concatenate([unary, np.zeros((1, pii.LABELS))]), np.array([[0, 2], [1, 2]]), np.array([pii.spoke(weight)] * 2))
        assert np.allclose(pair, star[:2], atol=1e-3)


def test_loopy_marginals_match_enumeration():
    draw = np.random.default_rng(4)
    unary = draw.normal(size=(3, pii.LABELS))
    pairs, weight = np.array([[0, 1], [1, 2]]), np.array([1.3, 0.4])
    total = np.zeros((3, pii.LABELS))
    for y in np.ndindex(pii.LABELS, pii.LABELS, pii.LABELS):
        p = np.exp(sum(unary[i, k] for i, k in enumerate(y)) + sum(w * (y[a] == y[b]) for (a, b), w in zip(pairs, weight)))
        for i, k in enumerate(y):
            total[i, k] += p
    assert np.allclose(pii.propagate(unary, pairs, weight), total / total.sum(axis=1, keepdims=True), atol=1e-3)


# --- 2 -----------------------------------------------------------------------
def repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes() if b else b""
        yield len(b), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), sha(kept)


@pytest.mark.parametrize("length", [200, 60])
def test_repeated_bytes(docs, length):
    assert by_id(suffix_dedup.remove_repeats(docs, length=length)) == expected(repeats([r[1] for r in corpus()], length))


def test_repeated_bytes_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    texts = [r[1] for r in corpus()][10:60]
    for length in (60, 200):
        whole = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
        for data in whole:
            starts = [s for start, count, *_ in suffix_dedup.bundles(data, length) for a, c in zip(start, count) for s in range(a, a + c)]
            assert starts == list(range(len(data) - length + 1))


# --- 3 -----------------------------------------------------------------------
def test_decontamination(spark, docs):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or "")) for r in corpus()]
    items = [(1, corpus()[40][1][:200].upper()), (20, " ".join(words[30][:30])), (3, "Ed"), (4, None), (5, ""), (None, " ".join(words[50][:12])), (3, "Ed"), (7, " ".join(words[30][2:5]))]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, words string")
    grams = []
    for item, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        n = min(10, len(w))
        grams += [(item, w[i : i + n]) for i in range(len(w) - n + 1) if n]
    want = []
    for w in words:
        hit, found = set(), set()
        for item, g in grams:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    found |= {str(item)} if item is not None else set()
        want.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    out = decontaminate.contamination(docs, bench)
    assert by_id(out) == expected(want) and out.count() == docs.count()
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not x[4] for x in want)


def test_large_benchmarks_are_broadcast_in_parts(spark, docs, monkeypatch):
    bench = docs.where("doc_id between 20 and 60").select(F.col("doc_id").alias("item_id"), "text")
    whole = by_id(decontaminate.contamination(docs, bench))
    monkeypatch.setattr(decontaminate, "BOUND", 100)
    assert by_id(decontaminate.contamination(docs, bench)) == whole


# --- 4 -----------------------------------------------------------------------
def test_hosts_paths_and_rules(spark):
    urls = [
        (1, "https://WWW.Example.com/en/1?x=/no"), (2, "http://example.com/en/2#a"), (3, "http://shop.net/es/3"), (4, "http://shop.net/de/3"),
        (5, None), (6, "no scheme"), (7, "http://com"), (8, "ftp://a.com?q/r"), (9, "http://notexample.com/en/"), (10, "x://y://z.com/p"), (11, "://"), (11, "://"),
    ]
    out = {r.page_id: r for r in url_filter.with_rules(spark.createDataFrame(urls, "page_id long, url string"), queries.RULES).collect()}
    assert (out[1].host, out[1].path, out[1].rule, out[1].rule_verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (out[2].host, out[2].path, out[2].rule, out[2].rule_verdict) == ("example.com", "/en/2", "example.com/en/", "block")
    assert out[3].rule == "net/es/" and out[4].rule is None and out[7].rule is None and out[7].path == ""
    assert (out[5].host, out[5].path, out[6].host) == ("", "", "") and (out[8].host, out[8].path) == ("a.com", "")
    assert out[9].rule == "com/" and out[10].host == "y:" and out[10].path == "//z.com/p" and out[11].host == ""


def test_segmentation_takes_the_likeliest_split():
    counts = {"the": 50, "there": 5, "rain": 20, "in": 30, "train": 9, "a": 40}
    words = url_filter.Words(counts)

    def best(name):
        if not name:
            return 0.0, ()
        return min((words.cost.get(name[:i], words.unknown(i)) + best(name[i:])[0], (name[:i], *best(name[i:])[1])) for i in range(1, len(name) + 1))

    for name in ("therain", "thetrain", "inthetrain", "xyz", "thereisrain"):
        cost = sum(words.cost.get(w, words.unknown(len(w))) for w in words.split(name))
        assert cost == pytest.approx(best(name)[0]) and "".join(words.split(name)) == name
    assert words.split("thetrain") == ("the", "train")


def test_no_title_word_is_dropped(spark):
    draw = random.Random(7)
    common = {"".join(draw.choice("bcdfgh") for _ in range(8)) for _ in range(52_000)}
    long = "verylongwordofthirtyletters" * 2
    rows = [(1, "http://quietlake.net/es/1", f"<title>{' '.join([*common, *common])}</title>"), (2, f"http://{long}quiet.net", f"<title>Quiet lake {long}</title>")]
    pages = spark.createDataFrame([*rows, (3, None, None)], "page_id long, url string, html string")
    words = url_filter.title_words(pages)
    assert len(common) > 50_000 and words.total == pytest.approx(np.log(2 * len(common) + 4))
    assert words.split("quietlake") == ("quiet", "lake") and words.split(long + "quiet") == (long, "quiet")
    assert set(words.cost) == {"quiet", "lake", long}
    assert words.split("x" * 200) == ("x" * 200,)


def test_url_verdicts_learn_from_rules(spark):
    rows = [(i, f"http://{h}.net/{p}/{i}", "<title>good bad shop news</title>") for i, (h, p) in enumerate([("goodnews", "es"), ("badshop", "fr")] * 5)]
    rows += [(20, "http://goodshop.com/en/1", None), (21, "http://goodnews.com/de/1", ""), (30, "http://badshop.org/fr/3", ""), (31, "http://goodnews.org/de/1", ""), (32, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    ruled = url_filter.with_rules(pages, queries.RULES)
    model = url_filter.train(ruled.withColumn("verdict", F.col("rule_verdict")), url_filter.title_words(pages))
    assert model.words.split("goodnews") == ("good", "news")
    out = {r.page_id: r.verdict for r in url_filter.judge(ruled, model).collect()}
    assert out[20] == "allow" and out[0] == "block" and out[30] == "block" and out[32] in ("allow", "block")
    none = url_filter.train(ruled.where("1 = 0").withColumn("verdict", F.lit("allow")), url_filter.title_words(pages.where("1 = 0")))
    assert {r.verdict for r in url_filter.judge(ruled.where("rule is null"), none).collect()} == {"allow"}


# --- 5 -----------------------------------------------------------------------
def groups_by_force(rows, size, percent):
    sets = []
    for _, t, *_ in rows:
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())) if x]
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(len(s), least.get(find(i)), r[0] == least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize(("size", "steps"), [(4, 2), (5, 2), (4, 0), (4, 1)])
def test_near_duplicates(docs, monkeypatch, size, steps):
    monkeypatch.setattr(near_dedup, "PIVOT_STEPS", steps)
    out = near_dedup.groups(docs, size=size).drop("text_hash")
    assert by_id(out) == expected(groups_by_force(corpus(), size, 80))


def test_near_duplicates_of_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPLIT", 8)
    draw = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(draw.randint(0, 9)):
            at = draw.randrange(len(words))
            words[at : at + draw.randint(0, 2)] = [f"x{draw.randrange(4)}"] * draw.randint(0, 2)
        rows.append((i, " ".join(words)))
    out = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash")
    want = {(r[0], *v) for r, v in zip(rows, groups_by_force(rows, 4, 80))}
    assert {tuple(r) for r in out.collect()} == want


def test_words_of_one_pattern_hash_apart():
    """A Thue-Morse word and its complement hash alike under any polynomial modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    for size in (64, 1024, 4096):
        one, two = ("".join(pair[b] for b in bits[:size]) for pair in ("ab", "ba"))
        a, b, c = near_dedup.word_hashes(f"{one} {two}  {one.upper()}")
        assert a != b and a == c
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(50_000)]
    assert len(set(near_dedup.word_hashes(" ".join(words)).tolist())) == len(words)


def test_near_copies_apart_from_a_hub_are_bounded(spark, monkeypatch):
    """Copies of a text that is not there, most pairs of them below the similarity: no link is lost, few pairs are compared."""
    monkeypatch.setattr(near_dedup, "MEET", 16)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(draw.randint(2, 8)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words[: draw.choice([150, 150, 140, 128])])))
    compared, plain = [], near_dedup.compare
    monkeypatch.setattr(near_dedup, "compare", lambda pairs, *a, **k: (compared.append(pairs.count()), plain(pairs, *a, **k))[1])
    out = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_hash")
    want = {(r[0], *v) for r, v in zip(rows, groups_by_force(rows, 4, 80))}
    assert {tuple(r) for r in out.collect()} == want
    assert sum(compared[1:]) < len(rows) * 5


def test_super_min_hash_estimates_similarity():
    draw = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        x = draw.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = x[:250], x[50:]
        same = (near_dedup.super_min_hash(a) == near_dedup.super_min_hash(b)).mean()
        errors.append(same - 200 / 300)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    one = near_dedup.super_min_hash(np.array([5], dtype=np.uint64))
    assert sorted((one >> np.uint64(40)).tolist()) == list(range(near_dedup.SLOTS))


def test_sets_are_packed_without_loss():
    x = np.unique(np.random.default_rng(1).integers(0, 2**48, 1000, dtype=np.uint64))
    assert (near_dedup.unpack(near_dedup.pack(x)) == x).all()


# --- 6 -----------------------------------------------------------------------
def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class=top><p>Logo</p></header>
    <nav><ul><li>Menu</ul></nav><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One   <b>bold</b><br>two<p>Three &lt;x&gt;
    <div class="cookie-notice"><p>Accept</p></div><script>var x="</p>";</script><!-- <p>no</p> --><form><p>Mail</p></form><p>A &eacute; 3 < 4</p>
    <section id="comments"><p>First!</p></section></article><aside>More</aside><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\nOne bold two\nThree <x>\nA é 3 < 4"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == ""
    assert html_text.main_text("plain words") == "plain words"
    assert html_text.main_text("<article><p>x</article><p>y") == "x"
    long = "<p>" + "word " * 60 + "</p>"
    assert html_text.main_text(f"<div>a</div><nav>n</nav><hr>{long}<p>b</p>{long}") .count("\n") >= 2
    assert html_text.main_text("<article>" + "<p>q</p>" * 20_000 + "</article>").count("q") == 20_000
    html_text.main_text("<" * 50_000 + "<a" * 50_000 + "<!--" * 20_000)


def test_main_text_by_density():
    part = "Many words of the article stand in this line and in no link at all, so that it weighs enough."
    links = "<ul>" + "".join(f"<li><a href=/{i}>Place {i}</a></li>" for i in range(5)) + "</ul>"
    page = f"""<body><div class=links>{links}</div>
    <div class='content has-sidebar'><h1><a href=/>Title</a></h1><p>{part}</p><p><a href=/x>whole link</a></p><p>{part}</p>
    <div class=cookie-notice><p>a</p><p>b</p><p>c</p></div><p>The end.</p></div>
    <div class=grid>{links}</div><table><tr><td><a href=/t>T</a> | <a href=/u>U</a></td></tr></table>

    <div><div><p>Made by us</p></div></div></body>"""
    assert html_text.main_text(page) == f"Title\n{part}\nwhole link\n{part}\nThe end."
    article = f"<main><article><header class='entry-header'><h1>T</h1></header><p>{part}</p><div class=grid>{links}</div><section><p>End.</p></section></article></main>"
    assert html_text.main_text(article) == f"T\n{part}\nEnd."
    assert html_text.main_text(f"<article>{links}</article>").count("Place") == 5
    assert html_text.marked("class=site-footer") and html_text.marked("id='Cookie_Notice'") and not html_text.marked("class='entry-header has-sidebar'")


def test_pages_keep_their_columns(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").withColumn("lines", F.lit(1))
    out = html_text.extract_text(pages)
    assert out.columns == [*pages.columns, "text"]
    for r in out.limit(50).collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        import html as H

        blocks = [" ".join(H.unescape(re.sub("<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


# --- 7 -----------------------------------------------------------------------
def deduped_lines(rows, min_words):
    """Deletes every run of lines with enough words that also occurs at an earlier place, judging all runs of all lengths."""
    plain = [[" ".join(re.sub(r"[\x09-\x0D\x20]+", " ", x).strip(" ").split(" ")) for x in (t or "").split("\n")] for _, t, *_ in rows]
    first, wins = {}, []
    for d, (r, lines) in enumerate(zip(rows, plain)):
        full = [i for i, x in enumerate(lines) if x]
        for k in range(len(full)):
            n, content = 0, 0
            for e in range(k, len(full)):
                n += len(lines[full[e]].split(" "))
                content = hash((content, lines[full[e]]))
                if n >= min_words:
                    at = (-1 if r[0] is None else r[0], r[1], k)
                    wins.append((d, content, at, full[k : e + 1]))
                    first[content] = min(first.get(content, at), at)
    gone = defaultdict(set)
    for d, content, at, where in wins:
        if at > first[content]:
            gone[d].update(where)
    out = []
    for d, r in enumerate(rows):
        lines = (r[1] or "").split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone[d])
        out.append((len(lines) if r[1] is not None else 0, len(gone[d]), kept if gone[d] else r[1]))
    return out


@pytest.mark.parametrize("min_words", [50, 10, 1])
def test_lines(docs, min_words):
    out = line_dedup.dedup_lines(docs, min_words=min_words, into="found")
    assert out.columns == [*docs.columns, "found"] and out.count() == docs.count()
    assert by_id(out.select("doc_id", "found.*")) == expected(deduped_lines(corpus(), min_words))


def test_repeated_runs_go_whole(spark):
    """Runs end where the texts part, also if what follows the last full window is short, or is shared with a later place only."""
    long, short, brief = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("long", 60), ("short", 40), ("brief", 3)))
    texts = [f"{long}\n{short}", f"{long}\n{short}\nend", f"{long}\n{brief}", f"begin\n{long}\n\n{brief}\n{short}", f"{short}\n{long}", f"{short}\n{long}\n{short}", f"{short}\n{brief}"]
    rows = list(enumerate(texts))
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.lines.kept for r in out.collect()}
    assert got == {0: texts[0], 1: "end", 2: brief, 3: f"begin\n\n{short}", 4: short, 5: "", 6: texts[6]}
    assert [got[i] for i, _ in rows] == [x[2] for x in deduped_lines(rows, 50)]


# --- 8 -----------------------------------------------------------------------
@pytest.mark.parametrize("cell", [16_384, 100])
def test_neighbours(spark, monkeypatch, cell):
    monkeypatch.setattr(nearest, "CELL", cell)
    monkeypatch.setattr(nearest, "QUERIES", max(10, cell // 10))
    draw = np.random.default_rng(8)
    x = (draw.normal(size=(40, 16))[draw.integers(0, 40, 1500)] + 0.3 * draw.normal(size=(1500, 16))).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(3, [float(v) for v in x[3]])]
    rows += [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [float("inf")] + [1.0] * 15), (5100, [None] + [1.0] * 15), (None, [1.0] * 16)]
    vectors = spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<float>, cell string")
    out = nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)
    got = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    y, hits = x.astype(np.float64), 0
    assert sorted(got) == list(range(0, 1500, 20))
    for q, found in got.items():
        score = (y * y[q]).cumsum(axis=1)[:, -1]
        assert all(s == score[v] for v, s in found)
        best = [v for v in np.lexsort((np.arange(1500), -score)) if v != q][:20]
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hits += len({v for v, _ in found} & set(best))
    assert hits >= 0.95 * 20 * len(got)


def test_few_candidates(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest.nearest(vectors, vectors.where("vec_id = 0"), 20).collect()] == [(0, 1, 1, 1.0)]


# --- 9 -----------------------------------------------------------------------
def test_pieces_equal_the_library(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    extra = ["  a  b ", " ", "   ", "a▁b ▁ c", "\n x\t\r\n", "日本 𐍈 \u3000 z", "<s> </s> <unk> <0x0A>", "x\0y", "a" * 5000, "ﬁ Ⅳ é"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    for r in pieces.encode(pieces.round_trip(both, queries.model_path()), queries.model_path()).collect():
        ids = library.encode(r.text or "")
        assert r.ids == ids and r.pieces.n_tokens == len(ids)
        assert r.pieces.ids_sha256 == sha(",".join(map(str, ids))) and r.pieces.decoded_sha256 == sha(library.decode(ids) if ids else "")
    back = pieces.decode(pieces.encode(more, queries.model_path()), queries.model_path())
    assert all(r.decoded == library.decode(library.encode(r.text)) for r in back.collect())


def test_the_chunk_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "MAX_CHUNKS", 50)
    with open(queries.model_path(), "rb") as file:
        table = pieces.ChunkTable(file.read())
    for i in range(40):
        text = " ".join(f"w{i}x{j}" for j in range(20))
        assert [int(k) for k in table.lookup(text)[0].split(",")] == table.library.encode(text)
        assert len(table.rows) <= 50


# --- 10 ----------------------------------------------------------------------
def test_languages(spark, docs, small_dir):
    out = queries.op10_langid(spark, small_dir)
    truth = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "lang")
    held = out.join(truth, "doc_id").where("held_out AND lang IS NOT NULL")
    assert held.count() > 20 and held.where("lang = lang_pred").count() >= 0.95 * held.count()
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.collect())
    model = langid.train(docs)
    judged = {r.doc_id: r.language for r in langid.identify(docs, model).where("doc_id < 10").collect()}
    assert all(judged[i].lang_pred == "und" and judged[i].score == 0 for i in (0, 1, 2, 3, 6)) and judged[5].lang_pred in ("en", "fr")


def test_long_texts_are_judged_by_all_blocks(monkeypatch):
    text = "ab cd é " * 300
    whole = Counter(np.concatenate(list(langid.buckets(text))).tolist())
    monkeypatch.setattr(langid, "BLOCK", 97)
    assert Counter(np.concatenate(list(langid.buckets(text))).tolist()) == whole


# --- all ---------------------------------------------------------------------
def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert pii.find_pii(empty, pii.fit(empty)).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.decontaminate(empty, bench).count() == 0
    assert near_dedup.groups(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert pieces.round_trip(empty, queries.model_path()).count() == 0
    assert langid.identify(empty, langid.train(empty)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(vectors, vectors, 20).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_text(pages).count() == 0
    ruled = url_filter.with_rules(pages, queries.RULES)
    assert url_filter.judge(ruled, url_filter.train(ruled.withColumn("verdict", F.col("rule_verdict")), url_filter.title_words(pages))).count() == 0


def test_all_null_texts(spark):
    nothing = spark.createDataFrame([(i, None) for i in range(5)], "doc_id long, text string")
    assert {tuple(r)[1:] for r in suffix_dedup.remove_repeats(nothing).collect()} == {(0, 0, 0, sha(""))}
    assert near_dedup.groups(nothing).where("kept AND n_shingles = 0 AND component_id = doc_id").count() == 5
    assert line_dedup.dedup_lines(nothing).where("lines.n_lines = 0 AND lines.kept IS NULL").count() == 5


def test_all_texts_pass_when_no_language_is_known(spark, docs):
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.language(spark, unknown, "")
    assert out.columns == unknown.columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, unknown.collect()))


def test_pipeline_equals_brute_force(spark, docs, tmp_path):
    """Stage by stage on the difficult rows: each stage's output is held against plain Python over its own input."""
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    item = " ".join(next(r[1] for r in corpus()[13:] if len((r[1] or "").split()) > 120).split()[20:60])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return {tuple(w[i : i + 10]) for i in range(len(w) - 9)}

    def language(rows):
        model = langid.train(docs.where(~langid.held_out()))
        return [r for r in rows if model.judge(r[1])[0] != "und" and model.judge(r[1])[1] >= 0.5]

    def lines(rows):
        out = []
        for r, (_, n, kept) in zip(rows, deduped_lines(rows, 50)):
            if not n or kept.split():
                out.append((r[0], kept, *r[2:4], len(kept) if n else r[4], *r[5:]))
        return out

    def near(rows):
        return [r for r, g in zip(rows, groups_by_force(rows, 5, 80)) if g[2]]

    def clean(rows):
        return [r for r in rows if not grams(r[1]) & grams(item)]

    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())

    def encoded(rows):
        ids = [library.encode(r[1]) for r in rows]
        return [(r[0], len(x), sha(",".join(map(str, x))), sha(library.decode(x) if x else "")) for r, x in zip(rows, ids)]

    kept, sizes = spark.read.parquet(f"{folder}/documents.parquet"), []
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (language, lines, near, clean, encoded)):
        before = [tuple(r) for r in kept.collect()]
        out = stage(spark, kept, folder)
        got = [tuple(r) for r in out.collect()]
        assert Counter(got) == Counter(plain(before)), name
        sizes.append(len(got))
        kept = spark.createDataFrame(got, out.schema)
    assert len(set(sizes[:4])) == 4 and sizes[3] > 5
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(got)
