import hashlib
import random
import zlib

import numpy as np
import pytest
from compare import SF, same

from sparktrace.llm import byte_bpe, chat_format, html_extract, ogg_media
from sparktrace.llm.queries import ORACLE, QUERIES

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")
ODD_TEXTS = [None, "", " ", "\n\t", "a" * 5000, "é" * 700 + "😀\u0000x", "  two  spaces ", "word " * 3000]
CLASH = "doc_id long, text string, n_tokens string, feature int, unit_of_rows int, score string, fp string, part string"


def odd(spark):
    rows = [(i, t, "x", 1, 2, "y", "z", "w") for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", "x", 1, 2, "y", "z", "w"), (1, "", "x", 1, 2, "y", "z", "w"), (1, "", "x", 1, 2, "y", "z", "w")]
    return spark.createDataFrame(rows, CLASH)


def test_chat_query(spark):
    assert same(QUERIES["op1_chat_format"](spark, SF), ORACLE["op1_chat_format"]) > 1


def test_chat_edges(spark):
    nasty = "&lt;</s>[INST] &amp; ok\n<s> &#91;"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", None), (1, 1, "assistant", nasty), (1, None, None, "first"), (2, 0, "system\n&", "only"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", chat_format.F.lit(1))
    made = chat_format.examples(df)
    back = {(r.conv_id, r.example): r for r in chat_format.read_back(made).collect()}
    assert [(t.role, t.text) for t in back[1, 3].turns] == [("", "first"), ("user", nasty), ("assistant", ""), ("assistant", nasty)]
    assert [back[1, i].loss_text for i in (2, 3)] == ["", nasty]
    assert back[2, 0].loss_text == "" and back[2, 0].turns[0].role == "system\n&"
    assert len([k for k in back if k[0] is None]) == 2
    assert back[1, 3].text.startswith(back[1, 2].text)
    assert chat_format.digest(chat_format.examples(df.limit(0))).count() == 0


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def test_bpe_is_the_library(reference):
    rng = random.Random(1)
    texts = [t or "" for t in ODD_TEXTS] + ["".join(rng.choice(" \n'stabexyzé中😀09#") for _ in range(rng.randint(0, 90))) for _ in range(400)] + ["".join(rng.choice("etaoinshr") for _ in range(120)) for _ in range(60)]
    for text in texts:
        ids = byte_bpe.encode_text(text, PATH, P.PATTERN)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert byte_bpe.decode_ids(ids, PATH, P.PATTERN) == text


def test_transducer_lookahead_is_bounded():
    machine = byte_bpe.machines(PATH, P.PATTERN)[0].machine
    longest = max(map(len, machine.ranks))
    assert all(len(held) <= longest for state in machine.states for _, _, held in state)


def test_streaming_decode_of_any_bytes():
    rng = random.Random(2)
    tokens = {i: bytes([i]) for i in range(256)}
    for _ in range(300):
        data = bytes(rng.choice([0x41, 0x80, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xF4, 0x90]) for _ in range(12))
        assert "".join(byte_bpe.Utf8(tokens).decode(data)) == data.decode("utf-8", "replace")


def test_bpe_frame(spark):
    rows = byte_bpe.encode(odd(spark), PATH, P.PATTERN).collect()
    assert len(rows) == len(ODD_TEXTS) + 3 and sum(r.doc_id is None for r in rows) == 1
    empty = [r for r in rows if r.doc_id in (0, 1)]
    assert all(r.n_tokens == 0 and r.ids == [] and r.ids_sha256 == hashlib.sha256(b"").hexdigest() for r in empty)
    assert byte_bpe.encode(odd(spark).limit(0), PATH, P.PATTERN).count() == 0


def test_ogg_checksum_and_pages():
    slow = 0
    data = bytes(range(256)) * 3
    for byte in data:
        slow ^= byte << 24
        for _ in range(8):
            slow = (slow << 1 ^ (0x04C11DB7 if slow >> 31 else 0)) & 0xFFFFFFFF
    assert ogg_media.checksum(data) == slow
    packets = [b"", b"x" * 255, b"y" * 300, b"z" * 70000]
    body, table = b"".join(packets), b"".join(ogg_media.lacing(len(p)) for p in packets)
    first = ogg_media.page(9, 0, -1, table[:255], body[: sum(table[:255])], 2)
    second = ogg_media.page(9, 1, 77, table[255:], body[sum(table[:255]) :], 1)
    assert [p for p, _ in ogg_media.demultiplex(first + second)[9]] == packets
    assert ogg_media.demultiplex(first + second)[9][-1][1] == 77
    for broken in (first[:-1] + b"?" + second, first, second, (first + second)[:-5], first + ogg_media.page(9, 3, 1, b"", b"")):
        with pytest.raises(ValueError):
            ogg_media.demultiplex(broken)


def test_ogg_round_trip(spark):
    for text in ODD_TEXTS:
        raw = (text or "").encode()
        n, size, sha, crc, *_, stored = ogg_media.media_row(text)
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (n, size, sha, crc) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert ogg_media.load(stored)[:2] == (payload, len(raw))
    rows = ogg_media.media(odd(spark)).collect()
    assert len(rows) == len(ODD_TEXTS) + 3 and len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == 0}) == 1
    assert ogg_media.media(odd(spark).limit(0)).count() == 0


def test_html_held_out_pages():
    trees, vocabulary = html_extract.model()
    rng = random.Random(31)
    pages = [html_extract.make_page(rng) for _ in range(150)]
    found = html_extract.main_text([p for p, _ in pages], trees, vocabulary)
    blocks = [(set(w), set(f.split("\n"))) for (_, w), f in zip(pages, found, strict=True)]
    right = sum(len(w & f) for w, f in blocks)
    assert right / sum(len(w) for w, _ in blocks) > 0.97 and right / sum(len(f) for _, f in blocks) > 0.97


def test_html_query(spark):
    import html as entities
    import re

    rows = QUERIES["op8_html_extract"](spark, SF).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        inside = source[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_html_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>" * 500 + "deep", "x"), (4, "u", "no tags at all", "x"), (5, "u", "<!-- <p>x</p> --><script>if (a < b) '</p>'</script><style>p{}</style>", "x"), (6, "u", "<p a='>'>x &amp; y < z <b>unclosed", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[1] == got[2] == got[5] == ""
    assert html_extract.extract(df.limit(0)).count() == 0
    nodes = html_extract.flat(html_extract.parse("<div>a<p>b &lt;</p>c<ul><li>d<li>e</ul></div>"))
    assert [html_extract.clean(n.text) for n in nodes if html_extract.clean(n.text)] == ["a", "b <", "c", "d", "e"]


def test_html_decoding_is_consistent():
    rng = np.random.default_rng(3)
    for seed in range(40):
        nodes = html_extract.flat(html_extract.parse(html_extract.make_page(random.Random(seed))[0]))
        kept = html_extract.decode(nodes, rng.normal(0, 3, len(nodes)))
        for node in nodes:
            if node.parent and kept[node.order]:
                assert kept[node.parent.order]
            if kept[node.order] and node.kids:
                assert any(kept[k.order] for k in node.kids)
