"""Packing, chat formatting, quality rules and html, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from arrayloom.llm import chat, html, layouts, packing, quality, registry

SF = "/root/testdata/sf0.001"
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("length", StringType())])
TEXTS = [
    None, "", " ", "one", "a b c a b c a b c", "x " * 3000 + "end", "line\nline\n\nline \n  line", "The same.\nThe same.\nOther!",
    "#### **** |||| <<<< >>>>", "A B   c", "tab\there  two  spaces \n mixed \t end ", "<|endoftext|> said", "é" * 70 + " ü", "don't I'll  we've",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOCS)


def encode_all(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def check_packing(rows, texts, capacity=2048):
    ids = encode_all(texts)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        got = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in got)) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] > 0
    for doc, x in enumerate(ids):
        at = 0
        for start, n in sorted(pieces[doc]):
            assert start == at
            at += n
        assert at == len(x)
    padded = 0
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120)
    texts = [*TEXTS, *[r["text"] for r in docs.collect()]]
    assert check_packing(packing.pack(frame(spark, texts)).collect(), texts) == 0
    assert check_packing(packing.pack(frame(spark, texts), capacity=64).collect(), texts, 64) == 0


def test_packing_empty_and_repeated(spark):
    assert packing.pack(frame(spark, [])).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert packing.pack(same).count() >= 2


def test_packer_places_by_sum_of_squares():
    p = packing.SumOfSquaresPacker(10, 0)
    best = lambda n: min(
        (sum(v * v for k, v in enumerate(after(p.levels, h, n)) if 0 < k < 10), -h) for h in range(0, 11 - n) if h == 0 or p.levels[h]
    )

    def after(levels, h, n):
        x = list(levels)
        if h:
            x[h] -= 1
        x[h + n] += 1
        return x

    import random

    r = random.Random(3)
    for k in range(400):
        n = r.randint(1, 9)
        assert -p.level_for(n) == best(n)[1]
        p.add(k, b"\1\0\0\0" * n)
    few = packing.SumOfSquaresPacker(10, 0, max_open=5)
    for k in range(50):
        few.add(k, b"\1\0\0\0" * 6)
    assert few.n_open <= 5
    few.flush()
    assert sum(r[2] for r in few.rows) == 300


def test_packer_leaves_few_windows_to_the_last_step():
    import random

    for n_docs in (1000, 4000):
        r, p = random.Random(n_docs), packing.SumOfSquaresPacker(2048, 0)
        for k in range(n_docs):
            p.add(k, b"\1\0\0\0" * min(int(r.lognormvariate(5.5, 1.2)) + 1, 20_000))
        placed = p.next_id
        p.flush()
        assert p.next_id - placed < 0.05 * p.next_id
        of = defaultdict(list)
        for x in p.rows:
            of[x[5]].append((x[6], x[2]))
        filled = [sum(n for _, n in w) for w in of.values()]
        assert all(n == 2048 or n & (n - 1) == 0 for n in filled)
        for w in of.values():
            at = 0
            for offset, n in sorted(w):
                assert offset == at
                at += n


def test_both_tokenizers_give_the_same_ids(monkeypatch):
    """Whichever library a text goes to, by its length."""
    texts = [t or "" for t in TEXTS] + ["word " * 3000, "\n\n  \t x" * 500, "é日本語 абв " * 400, "a" * 5000, "1234567890" * 300]
    e = packing.TextEncoder()
    fast = [e.encode(t) for t in texts]
    monkeypatch.setattr(packing, "FAST_CHARS", -1)
    assert e.fast is not None and [e.encode(t) for t in texts] == fast


def turns_of(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def check_chat(out, rows):
    want = turns_of(rows)
    assert len(out) == len(want)
    for r in out:
        turns = want[r["conv_id"]]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_round_trip(spark):
    hard = ["", None, "</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "<s", "s>", "[", "<", "\\", "<|role|>x<|says|>", "a\nb", "[[INST]]", "$1 \\1", "😀 é", "/INST]"]
    rows = [(k, t, r, x) for k, x in enumerate(hard) for t, r in enumerate(("system", "user", "assistant"))]
    rows += [(100, 0, "user", "q"), (100, 0, "user", "q"), (101, 0, None, "x"), (102, 0, "to<|says|>ol", "y"), (102, 1, "assistant", "z")]
    rows += [(None, 5, "user", "n"), (None, 6, "assistant", "m" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    check_chat(chat.digest(chat.format_conversations(df)).collect(), rows)
    states = {r["conv_id"]: (r["valid"], r["bad_turn"]) for r in chat.format_conversations(df).collect()}
    assert states[0] == (True, None) and states[100] == (False, 1) and states[101] == (False, 0)
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_query(spark):
    t = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in t.collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    check_chat(registry.op9_chat_formatting(spark, SF).collect(), rows)


def brute_counts(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [*TEXTS, "w " * 40_000, *[r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]]
    out = quality.score(frame(spark, texts)).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.BASE) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def test_quality_model_separates_labels(spark):
    out = quality.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.withColumnRenamed("quality", "p").join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_posterior_column_matches_model(spark):
    m = quality.VoteModel(["a", "b"]).fit([((1, 1), 70), ((-1, 1), 5), ((-1, -1), 20), ((0, 0), 5)])
    df = spark.createDataFrame([(1, 1), (-1, 1), (-1, -1), (0, 0), (1, 0)], "a int, b int")
    for r in df.select("a", "b", m.column({"a": F.col("a"), "b": F.col("b")}).alias("p")).collect():
        assert math.isclose(r["p"], m.posterior((r["a"], r["b"])), rel_tol=1e-9)
    assert m.posterior((1, 1)) > 0.9 > 0.5 > m.posterior((-1, -1))


def test_quality_keep_good(spark):
    docs = frame(spark, TEXTS)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.score(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>one<br>two\n three<p>four <b>bold</b></article><footer>c</footer>", "T & U one two three four bold"),
        ('<article><p>a<div class="ad-box">buy</div><p>b<aside>x<article>y</article></aside></article><div>tail text</div>', "a b"),
        ('<header><h1>Site</h1></header><article><header><h1>Own</h1></header><p>x &lt;b&gt; &#233;</p><script>var a="</p>";</script></article><section id="comments"><article>no</article></section>', "Own x <b> é"),
        ('<div class="cookie notice">We use</div><main><p>' + "word " * 30 + '</p></main><div class="side-bar"><p>' + "other " * 40 + "</p></div>", " ".join(["word"] * 30)),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>1 < 2 and 3 > 2</p><p>end<p cla", "1 < 2 and 3 > 2 end"),
    ],
)
def test_html(page, text):
    assert html.main_text(page, html.default_tree()) == text


def test_html_query(spark):
    out = {r["page_id"]: r for r in registry.op7_html_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(out) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", p["html"], re.S)
        import html as h

        want = " ".join(h.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inner[1]).replace("<b>", "").replace("</b>", "")).split())
        assert out[p["page_id"]]["text"] == want and out[p["page_id"]]["n_chars"] == len(want)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(empty).count() == 0


def block_f1(tree, pages):
    """Of main text, by blocks."""
    hit = said = true = 0
    for page in pages:
        found = html.blocks(page)
        for (text, _), got in zip(found, html.is_main([r for _, r in found], tree), strict=True):
            want = layouts.is_main(text)
            hit, said, true = hit + (want and got), said + got, true + want
    return 2 * hit / (said + true)


def test_tree_on_held_out_layouts():
    """Every layout without <article> in turn is left out of the training and tested on other pages."""
    scores = {}
    for kind in layouts.LAYOUTS:
        if kind[0] != "article":
            rest = tuple(x for x in layouts.LAYOUTS if x[0] != kind[0])
            tree = html.DecisionTree(html.training(kinds=rest))
            scores[kind] = block_f1(tree, layouts.pages(99, 30, (kind,)))
    assert min(scores.values()) >= 0.9 and sum(scores.values()) / len(scores) >= 0.95, scores


def test_tree_looks_at_neighbours():
    used = set()

    def walk(node):
        if isinstance(node, tuple):
            used.add(html.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(html.default_tree().root)
    assert used & {"words_before", "words_after"} and used & {"links_before", "links_after"}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>Yes.</p>", "Yes."),
        ("<h1>Title here</h1><p>" + "word " * 40 + "</p><p>Short para.</p><p>" + "other " * 30 + "</p><p>Yes.</p>", "Title here " + " ".join(["word"] * 40) + " Short para. " + " ".join(["other"] * 30) + " Yes."),
        ('<article><p>' + "word " * 20 + '</p><div class="teaser">a lead of five words</div><p class="copyright-law">on the law of copies</p></article>', " ".join(["word"] * 20) + " a lead of five words on the law of copies"),
        ('<article><p>' + "word " * 20 + '</p></article><div class="user-notes"><p>' + "nice " * 20 + "</p></div>", " ".join(["word"] * 20)),
        ("<div>This site tracks you with small files for its own ends.</div><ul><li><a href=/>a</a></li><li><a href=/>b</a></li></ul><div><h1>Title</h1><p>" + "word " * 60 + "</p><p>" + "next " * 40 + "</p></div>", "Title " + " ".join(["word"] * 60 + ["next"] * 40)),
    ],
)
def test_html_without_marks(page, text):
    assert html.main_text(page, html.default_tree()) == text


def test_html_odd_rows(spark):
    rows = [(1, "u", "<article><p>a b</p></article>", "x", 1)] * 2 + [(None, None, None, None, None), (2, None, "", "y", 2), (3, "v", "<p>" + "w " * 200_000, "z", 3)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in out) == [(0, "", 0), (1, "u", 3), (1, "u", 3), (2, "", 0), (3, "v", 399_999)]
