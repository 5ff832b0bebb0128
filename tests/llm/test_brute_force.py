"""Whole results against plain versions that share no code with the operators."""

import collections
import math
import random
import zlib

import numpy as np

from sparktrace.llm import chat_format, html_extract, lm_score, lsa_decontaminate, toxicity


def texts(seed, n, vocabulary, low, high):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(50_000)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))) for i in range(n)]


def test_lm_score_against_brute_force(spark):
    """Counts, deleted estimates and expectation-maximisation without rounding: scores may differ by what the tally of the operator rounds."""
    rows = [*texts(1, 150, 400, 0, 120), (500, None), (501, ""), (None, "w1 w2"), (502, "W1 w2")]
    split = {i: [*(t or "").lower().split(), "</s>"] for i, t in rows}
    learn = [i for i in split if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = collections.Counter(), collections.Counter()
    for i in learn:
        one.update(split[i])
        two.update(zip(["</s>", *split[i]], split[i], strict=False))
    n, v = sum(one.values()), len(one)
    bucket = lambda c: math.frexp(max(c, 0))[1]
    held = collections.defaultdict(list)
    for i in learn:
        for u, w in zip(["</s>", *split[i]], split[i], strict=False):
            held[bucket(one[u] - 1)].append(((two[u, w] - 1) / max(one[u] - 1, 1), (one[w] - 1) / (n - 1), 1 / (v + 1)))

    def weights(parts):
        p, w = np.array(parts), np.array([0.4, 0.4, 0.2])
        for _ in range(60):
            share = p * w
            w = (share / share.sum(1, keepdims=True)).mean(0)
        return w

    every = weights([x for xs in held.values() for x in xs])
    by = {b: weights(xs) for b, xs in held.items()}
    want = {}
    for i, tokens in split.items():
        want[i] = sum(math.log10(float(np.dot(by.get(bucket(one[u]), every), (two[u, w] / max(one[u], 1), one[w] / n, 1 / (v + 1))))) for u, w in zip(["</s>", *tokens], tokens, strict=False))
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys() and {i for i, r in got.items() if r.held_out} == set(split) - set(learn)
    assert all(abs(got[i].score - want[i]) < 0.01 * abs(want[i]) + 0.02 for i in want)
    assert abs(sum(r.score for r in got.values()) / sum(want.values()) - 1) < 0.003


def test_leaks_against_all_pairs(spark):
    """Every passage of every document against every item: what is found is a leak, and nine tenths of all leaks are found."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfgklmnprstv" for b in ("ano", "eri", "ilu", "onda", "ust", "eka")]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    items = [text(rng.randint(10, 60)) for _ in range(15)]
    docs = []
    for i in range(150):
        body = text(rng.randint(30, 300))
        if i % 2 == 0:
            share = rng.choice([0, 0.1, 0.2, 0.3])
            passage = [rng.choice(words) if rng.random() < share else w for w in items[rng.randrange(15)]]
            at = rng.randrange(len(body))
            body[at:at] = passage
        docs.append((i, body))
    size, step = lsa_decontaminate.SIZE, lsa_decontaminate.STEP

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    want = set()
    for i, body in docs:
        for k, item in enumerate(items):
            tail = item[-min(8, max(3, len(item) // 4)) :]
            for a in range(0, len(body), step):
                around = body[max(0, a - len(item)) : a + size + len(item)]
                there = set(around)
                if sum(w in there for w in item) >= 0.6 * len(item) and common(item, around) >= 0.6 * len(item) and common(tail, around) >= 0.5 * len(tail):
                    want.add((i, k))
                    break
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in lsa_decontaminate.leaks(spark.createDataFrame([(i, " ".join(b)) for i, b in docs], "doc_id long, text string"), bench).collect()}
    assert got <= want and len(want) > 60 and len(got) >= 0.9 * len(want)


PROSE = ["The river had risen overnight and the bridge was closed to all but the boldest of the farmers.", "By noon the mayor came out to see it, with half the council behind, and nobody knew what to say.", "It took three days for the water to go down again, and a month to find all of the sheep."]


def test_main_text_without_article(spark):
    """A page of plain divisions: prose stays, menus, adverts, forms, comments and scripts go."""
    page = f"""<html><head><title>t</title><style>p {{}}</style><script>var a = "no";</script></head><body>
      <div class="menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/a">About us</a></li></ul></div>
      <div id="content"><h1>Flood in the valley</h1>{"".join(f"<p>{p}</p>" for p in PROSE)}</div>
      <div class="sidebar ad"><a href="/buy">Buy now</a></div><form><input name="q"><button>Search</button></form>
      <div class="comments"><div class="comment">first!!</div></div><div class="footer">Copyright 2024 <a href="/t">Terms</a></div></body></html>"""
    rows = [(1, "u", page), (2, "u", page), (None, None, None), (3, "u", ""), (4, "u", "no tags & <b>"), (5, "u", page.replace(PROSE[0], " ".join(PROSE * 3000)))]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 text", "2 n_chars")).collect()}
    assert all(p in got[1].text for p in PROSE) and got[1].text == got[2].text
    assert not any(x in got[1].text for x in ("About us", "Buy now", "Search", "first!!", "Terms", "var a"))
    assert got[None].text == got[3].text == "" and got[5].n_chars > 500_000 and got[5].text.endswith(PROSE[2])


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    turns = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, None, None, None)]
    got = {r.conv_id: r for r in chat_format.digest(chat_format.examples(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").selectExpr("*", "1 example", "'x' parts"))).collect()}
    assert got[1].loss_chars == 2 * len(long) and got[1].n_turns == 3 and got[2].n_turns == 1
    docs = spark.createDataFrame([(1, long + " idiot"), (2, long + " idiot"), (3, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, marks).collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    bench = spark.createDataFrame([(7, " ".join(f"w{i % 977}" for i in range(900, 960)))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in lsa_decontaminate.leaks(docs, bench).collect()} == {(1, 7), (2, 7)}
