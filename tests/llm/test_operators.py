"""The text operators on small tables: results against brute force, and nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from orbitlake.llm import chat, decontaminate, html, lm, neardup, pieces, quality, topk, toxicity, warc

DOCS = "doc_id long, text string, score double, rep long, k int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, 2) for i, t in rows], DOCS)


def prose(seed, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(200)) for _ in range(n))


EDGE = [(None, "a b c d e f g"), (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (5, "é▁ü \U0001f600 x"), (6, "word " * 3000)]


def best_path(word: str, table: dict, unknown: float, longest: int) -> list[int]:
    """Brute force, Viterbi in a loop: ids, and -1 - code point for an unknown character. Of equal ways, the one whose last piece is longest."""
    best, back = [0.0], [(0, 0)]
    for end in range(1, len(word) + 1):
        top = None
        for n in range(min(longest, end), 0, -1):
            hit = table.get(word[end - n : end])
            if hit is None and n == 1:
                hit = (-1 - ord(word[end - 1]), unknown)
            if hit is not None and (top is None or best[end - n] + hit[1] > top[0]):
                top = (best[end - n] + hit[1], n, hit[0])
        best.append(top[0]), back.append(top[1:])
    out, end = [], len(word)
    while end:
        n, i = back[end]
        out.append(i)
        end -= n
    return out[::-1]


def test_chat_round_trip(spark):
    nasty = "\\### Assistant: </turn> ok </part> ##### \\0 \\1 # #"
    rows = [(1, 0, "user", nasty), (1, 1, "user", None), (1, 2, "assistant", nasty), (1, 3, "assistant", "b<"), (2, 0, "a: b:", ":x"), (2, 0, "User", ""), (3, None, None, None), (None, 1, "user", "x"), (2, 0, "User", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {r["conv_id"]: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(b, c) for _, b, c in own]
    assert got[1]["blocks"] == 2 and got[1]["formatted"].count("### User: ") == 1
    d = {r["conv_id"]: r for r in chat.chat_digests(df).collect()}
    said = nasty + "b<"
    assert (d[1]["loss_chars"], d[1]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_pieces_match_a_loop_and_round_trip(spark):
    rows = [*EDGE, (7, prose(1, 50)), (8, "x" * 700), (9, "  two  spaces \n")]
    table, of_byte, _, unknown = pieces.pieces()
    longest = max(map(len, table))
    got = Counter((r["doc_id"], tuple(r["ids"]), r["round_trip"]) for r in pieces.encode(docs(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        ids = tuple(x for w in pieces.split_words(t or "") for x in pieces._spread(best_path(w, table, unknown, longest), of_byte))
        want[i, ids, pieces.decode(ids) == (t or "")] += 1
    assert got == want
    assert pieces.encode(docs(spark, rows).limit(0)).count() == 0


def test_decontamination_against_sets(spark):
    item, short = prose(2, 30), "three word item"
    rows = [(1, prose(3, 900) + " " + item.upper() + " " + prose(4, 900)), (2, prose(5, 400)), (3, short), (4, short + " and more words here"), (5, " ".join(item.split()[:20])), *EDGE]
    items = [(10, item), (11, short), (12, None), (13, ""), (10, item)]
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in decontaminate.contaminations(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {}
    for d, t in rows:
        for i, x in {(10, item), (11, short)}:
            if 100 * len(grams(t) & grams(x)) >= 75 * len(grams(x)):
                want[d, i] = (len(grams(x)), len(grams(t) & grams(x)))
    assert got == want and (1, 10) in got
    assert decontaminate.contaminations(docs(spark, rows).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_top_k_against_all_products(spark):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 0.2 + i % 7) for _ in range(12)]) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [(600, None), (601, [None] * 12), (602, [math.inf] * 12), (603, [1.0] * 3), (None, [1.0] * 12), (604, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = [(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_long_vectors(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 10.0 ** (i % 9 * (1 if i % 4 else 4))) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, rows[8][1]) for i in range(9)] + [(500, [1e306] * 6), (501, [-1e306] * 6), (502, [300.0] + [0.0] * 5), (503, [2.0**60, 0.5] + [0.0] * 4), (550, [2.0**60, 0.75] + [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in topk.top_k(df, df.where("vec_id % 50 < 4"), 5).collect()]
    whole = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 50 < 4):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k, i, -s if -(2**63) <= -s < 2**63 else None) for k, (s, i) in enumerate(best, 1)]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(w[3] is None for w in want)
    small = df.where("vec_id in (1, 2, 502)")
    assert Counter(x["query_id"] for x in topk.top_k(small, small, 5).collect()) == {1: 2, 2: 2, 502: 2}


def test_warc_parse_and_audit(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, None), (2, None, None), (None, "http://b", "x"), (600, "http://c", "y"), (601, "http://d", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, file long")
    kept = [r for r in rows if r[0] != 600]
    bad = [(i, u, "Z" if h == "z" else h) for i, u, h in kept] + [(900, "http://e", "extra")]
    out = warc.fixity(df, spark.createDataFrame(bad, "page_id long, url string, html string")).collect()
    assert Counter((r["page_id"], r["state"]) for r in out) == Counter({(1, "intact"): 1, (2, "intact"): 2, (None, "intact"): 1, (600, "missing"): 1, (601, "corrupt"): 1, (900, "extra"): 1})
    text = df.where("page_id = 1").select(warc.record(df["url"], df["page_id"], df["html"])).first()[0].encode()
    parsed = list(warc.parse_warc(text * 2 + b"WARC/1.1\r\nbroken"))
    assert [(p["uri"], p["body"].decode(), p["length"]) for p in parsed] == [("http://a", "<p>é</p>", len(text))] * 2
    assert warc.fixity(df.limit(0), df.limit(0)).count() == 0


def test_lm_counts_and_gain(spark):
    base = [(i, prose(i % 40, 60)) for i in range(120)]
    rows = [*base, *EDGE]
    fold = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7
    toks = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for i, t in rows if fold(i) != 2 for w in toks(t))
    n, v = sum(c.values()), len(c)
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.scores(docs(spark, rows)).collect())
    want = Counter((i, fold(i) == 2, len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for i, t in rows)
    assert got == want
    out = [r for r in lm.scores(docs(spark, base)).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert lm.scores(docs(spark, rows).limit(0)).count() == 0


def _labelled(spark, good, bad, label):
    rows = [(i, good(i)) for i in range(0, 300)] + [(i, bad(i)) for i in range(300, 420)]
    labels = [(i, int((i >= 300) == (label == "toxic"))) for i in range(420)] + [(None, 1), (1, None)]
    return docs(spark, rows), spark.createDataFrame([(i, y, "clash") for i, y in labels], f"doc_id long, {label} int, text string")


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, label):
    if label == "quality":
        score, bad = quality.quality_scores, lambda i: prose(i, 40).upper().replace(" ", "!! ")
    else:
        score, bad = toxicity.toxicity_scores, lambda i: prose(i, 30) + " scumbag idiotic moronic " + prose(i + 1, 30)
    d, labels = _labelled(spark, lambda i: prose(i, 60).capitalize() + ".", bad, label)
    out = score(d.unionByName(docs(spark, EDGE)), labels).collect()
    assert len(out) == 420 + len(EDGE) and all(0 <= r["score"] <= 1 for r in out)
    one = [r for r in out if r["held_out"] and r["doc_id"] is not None and 10 <= r["doc_id"] < 420]
    right = [r["predicted"] == int((r["doc_id"] >= 300) == (label == "toxic")) for r in one]
    assert len(right) > 50 and sum(right) / len(right) > 0.95
    assert score(d.limit(0), labels.limit(0)).count() == 0
    assert score(d.limit(3), labels.limit(0)).count() == 3


def test_html_main_text(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header>Top</header><nav><ul><li><a href=x>Menu</a></li></ul></nav>'
        '<div class="ad">Buy now, it is the best of all and you will like it.</div><aside>Side</aside><article><h1>Head &amp; line</h1>'
        "<p>It was the best of times, it was the worst of times,\n it was the age of wisdom &lt; folly.<p>Short end.</p><form>mail <input></form></article>"
        '<section id="comments"><p>It is the opinion of a reader that this was not at all good.</p></section><footer>&copy; x</footer></body></html>'
    )
    want = "Head & line It was the best of times, it was the worst of times, it was the age of wisdom < folly. Short end."
    rows = [(1, "u", page), (2, None, None), (3, "", ""), (None, "v", "no < markup at all"), (4, "w", "<div><a href=x>Only</a> <a>links</a></div>"), (1, "u", page), (5, "x", "<p" * 5000), (6, "y", "<!--" * 2000)]
    out = html.extract_pages(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")).collect()
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in out)
    assert got[1, want, len(want)] == 2 and got[2, "", 0] == 1 and got[4, "", 0] == 1 and len(out) == len(rows)
    long = "This is the text of a page that has no article element, but it is long enough and it has the words that all texts have. " * 3
    plain = html.main_text(f"<body><div><a>Home</a> | <a>News</a></div><p>{long}</p><div><a>About</a> <a>us</a></div></body>")
    assert plain == long.strip()


def test_toxicity_learns_nothing_from_held_out_or_repeated_labels(spark):
    d, labels = _labelled(spark, lambda i: prose(i, 60), lambda i: prose(i, 30) + (" scumbag idiotic moronic " if i % 3 else " ") + prose(i + 1, 30), "toxic")
    held = [i for i in range(420) if zlib.crc32(str(i).encode()) % 5 == 0]
    more = spark.createDataFrame([(i, 1, "x") for i in held * 20] + [(i, 1, "x") for i in range(300, 420) for _ in range(9)], labels.schema)
    assert toxicity.fit(d, labels).curve == pytest.approx(toxicity.fit(d, labels.unionByName(more)).curve, abs=1e-6)


SAID = "This is the text of the article, and it has the words that all of the texts have, so that it is found by them."


def test_html_closes_what_is_left_open():
    for item, around in (("<li><a href=x>Menu</a>", "ul"), ("<dt>a<dd>b", "dl"), ("<tr><td>a<td>b", "table"), ("<p><b>x<br>", "div"), ("<x-y>x", "div")):
        page = f"<nav><{around}>{item * 400}</{around}></nav><article>{f'<p><b>{SAID}<br>' * 300}</article><p>{SAID} Not this.</p>"
        assert html.main_text(page) == " ".join([SAID] * 300), item
    assert html.main_text(f"<article><p title=\"{'a > b ' * 5000}\">{SAID}</p></article>") == SAID
    assert html.main_text(f"<article><p title=it's>{SAID}</p><p>It's so, and that is all that there is to be said of it.</p></article>").startswith(SAID)
    # a list inside an item stays inside, and so does a table inside a cell
    assert html.main_text(f"<article><ul><li>a<ul class=nav><li>no<li>no</ul><li>{SAID}</ul></article>") == "a " + SAID
    assert html.main_text(f"<nav><table><tr><td><table><tr><td>no</table><td>no</table></nav><p>{SAID}</p>") == SAID


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'href="/hidden-gems"', 'href="?id=ad"', 'data-id="share"', 'class="has-sidebar"', 'id="legal-news"', "title='class=ad'", 'class="post-header"', "data-hidden"])
def test_html_marks_are_whole_words_of_their_attributes(attributes):
    assert html.main_text(f"<body><div {attributes}><p>{SAID}</p></div></body>") == SAID
    assert html.main_text(f"<article><p>{SAID} <a {attributes}>Link</a> end.</p></article>") == SAID + " Link end."


def test_html_words_leave_no_article_out():
    no = f"<div class='x Ad'><p>{SAID} No.</p></div><p HIDDEN>{SAID} No.</p><p aria-hidden=true>{SAID} No.</p>"
    comments = f"<section id=comments><article><p>{SAID} No.</p></article></section>"
    for name in ("article", "main"):
        assert html.main_text(f"<body><div class=sidebar><div id='widget'>{no}<{name}>{no}<p>{SAID}</p>{comments}</{name}></div></div></body>") == SAID
    assert html.main_text(f"<body>{no}<p>{SAID}</p></body>") == SAID


def test_near_duplicates_against_sets(spark):
    r, rows = random.Random(3), []
    for g in range(12):
        words = prose(100 + g, 80).split()
        for k in range(6):
            w = list(words)
            for _ in range(k):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows) * 3, " ".join(w)))
    passage = prose(999, 60)
    rows += [(1000 + i, passage + " " + prose(2000 + i, 40)) for i in range(60)]
    rows += [(3000 + i, passage.upper()) for i in range(5)] + EDGE
    got = neardup.near_duplicates(docs(spark, rows)).collect()

    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                up[top(x)] = top(y)
    groups = {}
    for x, (i, _) in enumerate(rows):
        if sets[x]:
            groups.setdefault(top(x), []).append(i)
    want = Counter()
    for x, (i, _) in enumerate(rows):
        ids = [j for j in groups[top(x)] if j is not None] if sets[x] else [i]
        c = min(ids) if ids and ids[0] is not None else None
        want[i, len(sets[x]), c, i == c] += 1
    assert Counter((g["doc_id"], g["n_shingles"], g["component_id"], g["kept"]) for g in got) == want
    assert neardup.near_duplicates(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("part", [1, 2, 37, 1 << 20])
def test_indexed_words_are_the_words_of_a_loop(monkeypatch, part):
    monkeypatch.setattr(pieces, "PART", part)
    texts = ["", None, "  ", " a  b ", "it is 12,345.67%%% (no)", "日本語 😀▁▁ ▁", "a  " + "b" * 50 + "  c", "it is", "x" * 400]
    distinct, _, index, counts = pieces.indexed_words(texts)
    assert [distinct[i] for i in index.tolist()] == [w for t in texts for w in pieces.split_words(t)]
    assert counts.tolist() == [len(pieces.split_words(t)) for t in texts]
    assert len(set(distinct)) == len(distinct)


def test_cuts_take_nothing_from_the_best_score():
    table, _, _, unknown = pieces.pieces()
    longest, scores = max(map(len, table)), {i: s for i, s in table.values()}
    for text in ("it is 12,345.67%%% (no)", "chocolat-noir, l'été!", "日本語 😀 x"):
        whole = pieces.SPACE + text.replace(" ", pieces.SPACE)
        score = lambda ids: sum(scores.get(i, unknown) for i in ids)
        cut = [i for w in pieces.split_words(text) for i in best_path(w, table, unknown, longest)]
        assert abs(score(cut) - score(best_path(whole, table, unknown, longest))) < 1e-9


def test_long_words_go_through_the_lattice(spark):
    """Words beyond one segment and one chunk of the fold, against the loop."""
    table, of_byte, _, unknown = pieces.pieces()
    longest = max(map(len, table))
    r = random.Random(5)
    texts = ["a" * 5000, "".join(r.choice("abcdefgh") for _ in range(5000)), "x" * 257, "ab" * 128, "\U0001f600" * 300 + "é" * 300]
    got = {r["doc_id"]: r for r in pieces.encode(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i]["round_trip"]
        want = [x for w in pieces.split_words(t) for x in pieces._spread(best_path(w, table, unknown, longest), of_byte)]
        assert got[i]["ids"] == want
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.encode(docs(spark, list(enumerate(texts))))).collect()}
    assert back == dict(enumerate(texts))


def test_top_k_of_shared_ids(spark):
    """Rows that share an id are candidates and queries of their own; a repeated query has its twin among its best."""
    r = random.Random(3)
    rows = [(i % 40 + 30, [r.uniform(-1, 1) for _ in range(4)]) for i in range(90)] + [(50, [0.5, 0.25, 0.0, 1.0])] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(tuple(x) for x in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = Counter()
    for a, (q, v) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(whole) if b != a)[:5]
            want.update((q, k, i, -s) for k, (s, i) in enumerate(best, 1))
    assert got == want


def test_damaged_copy_is_told_from_the_intact_one(spark):
    """Of two records of one page one is damaged, whatever the order of digests; equal copies go missing one by one."""
    rows = [(5, "u", f"body {i}") for i in range(2)] + [(9, "u", "same")] * 3 + [(None, "u", "x"), (None, "u", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in range(6):
        bad = [(5, "u", "body 0"), (5, "u", f"body 1 broken {n}"), (9, "u", "same"), (9, "u", "same"), (None, "u", "x")]
        out = warc.fixity(df, spark.createDataFrame(bad, "page_id long, url string, html string")).collect()
        assert Counter((r["page_id"], r["state"]) for r in out) == Counter({(5, "intact"): 1, (5, "corrupt"): 1, (9, "intact"): 2, (9, "missing"): 1, (None, "intact"): 1, (None, "missing"): 1})


def test_decontamination_of_odd_tables(spark):
    schema = "item_id long, text string, n long, shingle string"
    empty = spark.createDataFrame([], schema)
    assert decontaminate.contaminations(docs(spark, EDGE), empty).count() == 0
    items = [(i, prose(700 + i, 8 * 2**i)) for i in range(6)]
    item = spark.createDataFrame([(*r, 1, "clash") for r in items], schema)
    long_text = prose(1, 30_000) + " " + " ".join(t for _, t in items) + " " + prose(2, 30_000)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs(spark, [(1, long_text), (2, prose(3, 400)), (None, items[3][1])]), item).collect()}
    assert got == {(1, i) for i in range(6)} | {(None, 3)}


def test_maximal_segments():
    """The linear scan against the definition, and in linear time."""
    import time

    def brute(xs, lo, hi):
        # the best segment of the widest sum, then the same left and right of it
        best, at = 0.0, None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += xs[b]
                if total > best + 1e-9:
                    best, at = total, (a, b + 1)
        if at is None:
            return []
        return brute(xs, lo, at[0]) + [at] + brute(xs, at[1], hi)

    r = random.Random(4)
    for _ in range(200):
        xs = [r.choice([-3, -2, -1, -1, 1, 2]) + r.random() / 7 for _ in range(r.randrange(25))]
        got = toxicity.maximal_segments(xs)
        assert [(a, b) for _, a, b in got] == brute(xs, 0, len(xs))
        assert all(abs(s - sum(xs[a:b])) < 1e-9 for s, a, b in got)
    seconds = []
    for n in (200_000, 800_000):
        xs = [1.0 if i % 3 == 0 else -0.6 for i in range(n)]
        began = time.perf_counter()
        toxicity.maximal_segments(xs)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 12 * max(seconds[0], 0.01)


def test_lm_scores_by_brute_force(spark):
    """The score with weights learnt by EM over held-out counts, all in a loop."""
    rows = [(i, prose(i, 20 + i % 30, "to be or not that is the question whether".split())) for i in range(120)] + [(None, None), (500, "unheard of"), (501, "")]
    part = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7
    said = [(i, (t or "").split() + ["</s>"]) for i, t in rows]
    pairs = lambda w: list(zip(["<s>", *w[:-1]], w))

    def counts(keep):
        own = [w for i, w in said if keep(part(i))]
        one = Counter(x for w in own for x in w)
        return one, Counter(p for w in own for p in pairs(w)), Counter(u for w in own for u, _ in pairs(w))

    bucket = lambda c: c.bit_length()

    def estimates(u, w, one, two, context, n, v):
        return (two[u, w] / context[u] if context[u] else 0.0, one[w] / n, 1 / (v + 1))

    all_, kept = counts(lambda r: r != 2), counts(lambda r: r not in (2, 3))
    v, n_kept, n = len(all_[0]), sum(kept[0].values()), sum(all_[0].values())
    held = [(bucket(kept[2][u]), estimates(u, w, *kept, n_kept, v)) for i, ws in said if part(i) == 3 for u, w in pairs(ws)]
    weights = {b: (0.0, 0.5, 0.5) if b == 0 else (1 / 3,) * 3 for b, _ in held}
    before = -math.inf
    for _ in range(lm.ROUNDS):
        sums, fit = {b: [0.0] * 4 for b in weights}, 0.0
        for b, p in held:
            mix = sum(x * y for x, y in zip(weights[b], p))
            fit += math.log(mix) / len(held)
            for k in range(3):
                sums[b][k] += weights[b][k] * p[k] / mix
            sums[b][3] += 1
        weights = {b: tuple(x / s[3] for x in s[:3]) for b, s in sums.items()}
        if fit - before < lm.GAIN:
            break
        before = fit
    weights = {b: tuple((1 - lm.FLOOR) * x + lm.FLOOR * y for x, y in zip(w, (0, 0.5, 0.5) if b == 0 else (1 / 3,) * 3)) for b, w in weights.items()}
    got = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in lm.scores(docs(spark, rows)).collect())
    want = Counter()
    for i, ws in said:
        total = sum(math.log10(sum(x * y for x, y in zip(lm.weight_of(weights, bucket(all_[2][u])), estimates(u, w, *all_, n, v)))) for u, w in pairs(ws))
        want[i, len(ws), round(total, 6)] += 1
    assert got == want


def test_memory_of_two_blocks(monkeypatch):
    """Near copies of one long text have nearly all shingles in common: what their comparison holds at once is bounded."""
    r = np.random.default_rng(5)
    base = r.integers(-(1 << 62), 1 << 62, 8000)
    sets = []
    for _ in range(40):
        own = base.copy()
        own[r.integers(0, 8000, 400)] = r.integers(-(1 << 62), 1 << 62, 400)
        sets.append(np.unique(own))
    tracemalloc.start()
    both = neardup._overlaps(sets, sets[:39])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    for i, j in ((0, 0), (3, 38), (39, 7), (20, 21)):
        assert both[i, j] == len(np.intersect1d(sets[i], sets[j]))
    few = [s[:60] for s in sets]
    whole = neardup._overlaps(few, few)
    monkeypatch.setattr(neardup, "PAIRS", 7)
    assert (neardup._overlaps(few, few) == whole).all() and whole[0, 0] == 60
    assert not neardup._overlaps([sets[0][:5]], [sets[0][5:9]]).any()


def test_lists_are_merged_in_blocks(spark, monkeypatch):
    """Without pivots and in blocks of eight, every link comes from counting collisions in block pairs."""
    monkeypatch.setattr(neardup, "PIVOTS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "HOT", 4)
    r = random.Random(9)
    rows = []
    for g in range(6):
        base = prose(8000 + g, 120).split()
        for k in range(9):
            own = list(base)
            for at in r.sample(range(120), r.randrange(0, 5)):
                own[at] = f"new{g}{k}{at}"
            rows.append((100 * g + k, " ".join(own)))
    shared = prose(9999, 60)
    rows += [(1000 + i, shared + " " + prose(9000 + i, 60)) for i in range(30)]
    sets = {i: {tuple(t.lower().split()[a : a + 5]) for a in range(len(t.split()) - 4)} for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    for links in (neardup.LOCAL_LINKS, -1):
        monkeypatch.setattr(neardup, "LOCAL_LINKS", links)
        got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs(spark, rows)).collect()}
        assert got == {i: top(i) for i in sets} and len(set(got.values())) < len(got)


def test_pieces_survive_other_cores_between_the_readings(spark, tmp_path):
    """Executors that come or go change how files would be split; the second reading makes the same blocks."""
    rows = [(i, prose(i, 300)) for i in range(240)]
    docs(spark, rows).repartition(12, "doc_id").write.parquet(str(tmp_path / "d"))
    names = ("spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.unset(names[2])
        spark.conf.set(names[0], "0")
        spark.conf.set(names[1], "4")
        out = pieces.encode(spark.read.parquet(str(tmp_path / "d")))
        spark.conf.set(names[1], "12")
        got = {r["doc_id"]: r for r in out.collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
    assert len(got) == 240 and all(r["round_trip"] for r in got.values())
    assert all(pieces.decode(got[i]["ids"]) == t for i, t in rows)
