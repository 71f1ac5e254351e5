"""Near-duplicates, passages, lines and decontamination, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.llm import decontaminate, graph, lines, minhash, passages
from arrayloom.llm.common import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, node string, row int, label double, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", None, 1, 0.5, 2) for i, t in rows], SCHEMA)


def prose(r, n, words=2000):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def edited(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


class Union:
    def __init__(self, nodes):
        self.up = {x: x for x in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute_classes(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    of_set = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            of_set[x].append(i)
    u, counts = Union(range(len(rows))), defaultdict(int)
    for held in of_set.values():
        for a in held:
            for b in held:
                if a < b:
                    counts[a, b] += 1
    for (a, b), c in counts.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            u.join(a, b)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[u.find(i)].append(d)
    return [(d, len(sets[i]), min(low[u.find(i)])) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_a_large_family(spark, monkeypatch, k, percent):
    monkeypatch.setattr(graph, "SHORT", 4)
    monkeypatch.setattr(graph, "BLOCK", 16)
    r = random.Random(5)
    base, shared = prose(r, 120), prose(r, 60)
    rows = [(i, edited(r, base, r.randrange(1, 9))) for i in range(90)]
    rows += [(200 + i, prose(r, 50) + " " + shared) for i in range(40)]
    rows += [(300 + i, t) for i, t in enumerate(["", None, " \t\n", "one", "ONE", "two words", "Two  Words", prose(r, 30_000), "a b c", "a b c"])]
    rows += [(400 + i, t) for i, (_, t) in enumerate(rows[:20])]
    rows = [(i, t) for i, t in rows if i != 7]
    out = minhash.near_duplicates(frame(spark, rows), shingle=k, percent=percent).collect()
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in out)
    assert got == sorted(brute_classes(rows, k, percent))
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in out)


def test_near_duplicates_query_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    out = minhash.near_duplicates(docs, shingle=3, percent=85).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in out) == sorted(brute_classes(rows, 3, 85))


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u"), (None, "a b c d e f"), (3, "a b c d e f")]
    out = minhash.near_duplicates(frame(spark, rows), shingle=3, percent=85).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0, x["kept"]) for x in out) == [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (3, 1, False)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    kept = minhash.keep_one(frame(spark, rows), shingle=3)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").replace(" double", "").split(", ")
    assert sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 1, 1, 1]


def test_components(spark, monkeypatch):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(60)]
    u = Union({x for e in edges for x in e})
    for e in edges:
        u.join(*e)
    df = spark.createDataFrame(edges, "a long, b long")
    want = {x: u.find(x) for x in u.up if any(x in e and e[0] != e[1] for e in edges)}
    for small, native in ((200_000, False), (200_000, True), (10, True)):
        monkeypatch.setattr(graph, "SMALL_GRAPH", small)
        assert {x["node"]: x["label"] for x in graph.components(df, Scratch(spark, "t"), native).collect()} == want
    assert graph.components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_passages_found(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHORT", 4)
    monkeypatch.setattr(graph, "BLOCK", 8)
    r = random.Random(2)
    p = [prose(r, 70, 10**6) for _ in range(3)]
    rows = [(i, f"{prose(r, 40, 10**6)} {p[i % 3]} {prose(r, 200, 10**6)}") for i in range(60)]
    rows += [(100 + i, prose(r, 300, 10**6)) for i in range(20)]
    rows += [(200, edited(r, p[0], 1) + " " + prose(r, 30, 10**6)), (201, p[0][: len(p[0]) // 2]), (202, ""), (203, None), (204, prose(r, 30, 10**6) + " " + p[1].upper())]
    out = passages.repeated_passages(frame(spark, rows)).collect()
    of = defaultdict(set)
    for x in out:
        of[x["class_id"]].add(x["doc_id"])
        assert x["n_words"] >= 50
    want = [set(range(0, 60, 3)) | {200}, set(range(1, 60, 3)) | {204}, set(range(2, 60, 3))]
    assert sorted(map(sorted, of.values())) == sorted(map(sorted, want))
    one = next(x for x in out if x["doc_id"] == 3)
    assert (one["start"], one["n_words"]) == (40, 70)
    assert passages.repeated_passages(frame(spark, [])).count() == 0


def test_compact_windows_by_brute_force():
    import numpy as np

    r = np.random.default_rng(3)
    for hashes in (r.integers(1, 1 << 62, 300, dtype=np.uint64), r.integers(1, 12, 300, dtype=np.uint64)):
        at = np.array([0, 0, 90, 100, 300])
        for t in (5, 30):
            got = set(zip(*[x.tolist() for x in passages.compact_windows(hashes, at, t)], strict=True))
            want = set()
            for a, b in zip(at[:-1], at[1:], strict=True):
                for c in range(a, b):
                    lo = c
                    while lo > a and hashes[lo - 1] > hashes[c]:
                        lo -= 1
                    hi = c
                    while hi + 1 < b and hashes[hi + 1] >= hashes[c]:
                        hi += 1
                    if hi - lo + 1 >= t:
                        want.add((int(lo), int(c), int(hi)))
            assert got == want


def test_lines_exact_and_fuzzy(spark):
    r = random.Random(4)
    long = prose(r, 60, 10**6)
    text = "The quick brown fox jumps over the lazy dog again"
    rows = [
        (1, f"{text}\nshort line\n{long}"),
        (2, f"{text.upper()}!!\nshort line\nunique words one two three four"),
        (3, long.replace(" ", "  ") + f"\nkept\n{text}\n{text}"),
        (4, ""),
        (5, None),
        (6, "\n\n"),
        (7, long + " extra"),
        (8, f"{text} and then it sleeps for a very long while in the sun"),
    ]
    out = {x["doc_id"]: x for x in lines.dedup_lines(frame(spark, rows)).collect()}
    assert out[1]["text"] == rows[0][1] and out[1]["__n_gone"] == 0
    assert out[2]["text"] == "short line\nunique words one two three four"
    assert out[3]["text"] == "kept" and out[3]["__n_gone"] == 3 and out[3]["__n_lines"] == 4
    assert (out[4]["text"], out[5]["text"], out[6]["text"]) == ("", None, "\n\n")
    assert out[8]["text"] == rows[7][1]
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_lines_odd_columns_and_scripts(spark):
    """Clashing names, repeated rows, ties, a null id, unspaced scripts, long lines and equal words."""
    r = random.Random(6)
    long = prose(r, 4000, 10**6)
    rows = [
        (3, "东京是日本的首都人口众多\n短"),
        (4, "东京是日本的首都人口众多。\n短"),
        (5, long),
        (6, long.replace("w1", "v1", 3)),
        (7, prose(r, 4000, 10**6)),
        (None, "the first place of this line is here"),
        (8, "The FIRST place, of this line is here."),
        (8, "The FIRST place, of this line is here."),
        (9, "same same same same same same"),
        (10, "same same same same same same"),
    ]
    df = spark.createDataFrame([(i, t, "k", 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, row string, gone int, d int, __n_lines int, h int")
    out = lines.dedup_lines(df)
    assert set(out.columns) == set(df.columns) | {"__n_gone"}
    got = sorted((x["doc_id"] or 0, x["text"], x["__n_lines"], x["__n_gone"]) for x in out.collect())
    assert [(i, n, g) for i, _, n, g in got] == [(0, 1, 0), (3, 2, 0), (4, 2, 1), (5, 1, 0), (6, 1, 1), (7, 1, 0), (8, 1, 1), (8, 1, 1), (9, 1, 0), (10, 1, 1)]
    assert got[2][1] == "短" and got[7][1] == ""


def near_texts(a, b):
    most = int(max(len(a), len(b)) * 0.2)
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1] <= most


def test_decontamination_planted(spark):
    r = random.Random(8)
    items = [(i, prose(r, n, 10**6).capitalize() + ".") for i, n in enumerate([15, 22, 40, 57, 57, 3])] + [(90, ""), (91, None), (92, "word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    changed = items[3][1].split()
    changed[0] = "altered"
    rows = [(i, f"{prose(r, 100, 10**6)} {items[i][1].upper()} {prose(r, 80, 10**6)}") for i in range(6)]
    rows += [(10, prose(r, 500, 10**6)), (11, None), (12, ""), (13, "see " + " ".join(changed)), (14, items[2][1][: len(items[2][1]) // 2]), (15, prose(r, 20, 10**6) + " WORD! " + items[4][1] + items[4][1])]
    out = decontaminate.find(frame(spark, rows), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in out} == {(i, i) for i in range(6)} | {(13, 3), (15, 92), (15, 4)}
    assert all(abs(x["start"] - 100) == 0 and x["similarity"] == 1.0 and x["distance"] == 0 for x in out if x["doc_id"] < 5)
    clean = decontaminate.keep_clean(frame(spark, rows), bench)
    assert sorted(x["doc_id"] for x in clean.collect()) == [10, 11, 12, 14] and clean.schema == frame(spark, rows).schema
    assert decontaminate.find(frame(spark, []), bench).count() == 0
    assert decontaminate.find(frame(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_by_all_windows(spark):
    """No window within the radius is missed by the block tables."""
    import numpy as np

    r = random.Random(9)
    items = [(i, prose(r, 30, 10**6)) for i in range(40)]
    index = decontaminate.ItemIndex(items)
    prints = np.array([int(s) ^ sum(1 << b for b in r.sample(range(64), k)) for s in index.sign for k in (0, 3, 11, 12, 20)], np.uint64)
    got = {(w, i) for w, i, _ in index.near(prints, 30)}
    want = {(w, i) for w, x in enumerate(prints.tolist()) for i, y in enumerate(index.sign.tolist()) if bin(x ^ y).count("1") <= decontaminate.RADIUS}
    assert got == want and len(want) >= 120


def test_lines_by_edit_similarity_of_all_pairs(spark):
    """Changed words and typing errors in lines of 8 to 40 words, against all pairs."""
    r = random.Random(12)
    rows = []
    for n in (8, 10, 20, 40):
        for _ in range(15):
            base = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(n))
            w = base.split(" ")
            w[r.randrange(n)] = "other"
            c = list(base)
            for _ in range(max(1, n // 10)):
                c[r.randrange(len(c))] = "z"
            rows += [base, " ".join(w), "".join(c), " ".join(w[: n // 2] + ["more"] + w[n // 2 :])]
    rows = list(enumerate(rows))
    u, pairs = Union(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a - a % 4, a):  # lines of other bases are far
            if near_texts(rows[a][1], rows[b][1]):
                pairs += 1
                u.join(a, b)
    want = {a for a, _ in rows if u.find(a) != a}
    got = {x["doc_id"] for x in lines.dedup_lines(frame(spark, rows)).collect() if x["__n_gone"]}
    assert pairs > 200 and got <= want
    assert len(got) >= 0.98 * len(want)


def test_decontamination_by_similarity():
    """Documents shorter than an item, and windows of every item's size, by similarity alone."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(13)
    items = [(i, prose(r, 15 + i % 45, 10**6)) for i in range(90)]
    index = decontaminate.ItemIndex(items)

    def counts(words):
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        h, sizes, _ = index.hasher.sized_words(raw, np.array([0, len(raw)]))
        return decontaminate.weighted(h, sizes)

    docs, want = [], set()
    for i, text in items:
        w = text.split(" ")
        mine = [w[less:] for less in (1, 2, 3)]
        for changed in range(1, 6):
            x = [f"y{r.randrange(10**6)}" for _ in range(changed)] + w[changed:]
            mine.append(prose(r, 30, 10**6).split(" ") + x + prose(r, 30, 10**6).split(" "))
        for d in mine:
            windows = [d[k : k + len(w)] for k in range(max(1, len(d) - len(w) + 1))]
            if any(decontaminate.similarity(counts(x), counts(w)) >= 0.8 for x in windows):
                want.add((len(docs), i))
            docs.append(d)
    got = {(d, i) for d, best in index.scan(pa.array([" ".join(d) for d in docs]), 80) for i in best}
    assert got == want and len(want) > 300


def test_passages_agree_at_any_shift():
    """Insertions, deletions and swapped halves, against all window pairs as multisets."""
    from collections import Counter

    import numpy as np

    def tokens(words):
        return np.array([hash(tuple(words[i : i + 5])) & 0xFFFFFFFF for i in range(len(words) - 4)], np.uint32)

    r, t = random.Random(14), 46
    for n in (50, 60, 75, 130):
        w = prose(r, n, 10**6).split(" ")
        mid = n // 2
        for x, found in (
            (w[:mid] + ["new"] + w[mid:], True),
            (w[:mid] + w[mid + 1 :] + ["end"], True),
            (w[mid:] + w[:mid], None),
            (w[:mid] + prose(r, 60, 10**6).split(" ") + w[mid:], None),
            (w[:10] * 6, None),
        ):
            a, b = tokens(w), tokens(x)
            near = [
                (i, j)
                for i in range(len(a) - t + 1)
                for j in range(len(b) - t + 1)
                if 180 * (Counter(a[i : i + t].tolist()) & Counter(b[j : j + t].tolist())).total() >= 160 * t
            ]
            got = passages.agree(a, b, t, 80)
            assert bool(got) == bool(near)
            assert not found or got
            if n == 130 and len(x) == n + 60:  # both halves, at their two shifts
                assert {g[2] - g[0] for g in got} == {0, 60}


def test_passages_miss_risk():
    from math import comb

    need = passages.least_matches(80, passages.HASHES, passages.RISK)
    assert sum(comb(passages.HASHES, k) * 0.8**k * 0.2 ** (passages.HASHES - k) for k in range(need)) <= 0.002


def test_decontamination_of_a_very_long_text(spark):
    """Items at both ends of a text of three million words."""
    r = random.Random(15)
    items = [(0, prose(r, 40, 10**6)), (1, prose(r, 40, 10**6))]
    filler = prose(r, 1000, 10**6)
    text = items[0][1] + " " + " ".join([filler] * 3000) + " " + items[1][1]
    rows = [(1, text), (2, filler), (3, ""), (4, None)]
    out = decontaminate.find(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x["doc_id"], x["item_id"], x["start"]) for x in out) == [(1, 0, 0), (1, 1, 3_000_040)]


def test_decontamination_query_by_all_windows(spark):
    """The query's rows on the smallest tables, against the exact similarity of every window of an item's size."""
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.ItemIndex(items)
    from arrayloom.llm import registry

    got = {(x["doc_id"], x["item_id"]) for x in registry.op5_simhash_decontamination(spark, SF).collect()}
    want = set()
    for d in docs:
        raw = np.frombuffer((d["text"] or "").lower().encode(), np.uint8)
        h, sizes, _ = index.hasher.sized_words(raw, np.array([0, len(raw)]))
        shingles_of = {x for x, _ in decontaminate.weighted(h, sizes)} if len(h) else set()
        for k, item in enumerate(index.ids):
            n = int(index.n[k])
            # without a shingle in common the similarity is zero
            if not shingles_of & {x for x, _ in index.counts[k]}:
                continue
            windows = [(h, sizes)] if len(h) < n else [(h[i : i + n], sizes[i : i + n]) for i in range(len(h) - n + 1)]
            if any(decontaminate.similarity(decontaminate.weighted(*w), index.counts[k]) >= 0.8 for w in windows):
                want.add((d["doc_id"], item))
    assert got == want and want


def test_passages_query_by_all_pairs_of_documents(spark):
    """The query's documents on the smallest tables, against every pair of documents compared whole."""
    import numpy as np

    from arrayloom.llm import registry
    from arrayloom.llm.decontaminate import PUNCTUATION
    from arrayloom.llm.wordhash import ByteRules, WordHasher

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    hasher, tokens = WordHasher(ByteRules(drop=PUNCTUATION)), {}
    for d in docs:
        raw = np.frombuffer((d["text"] or "").lower().encode(), np.uint8)
        s, _ = passages.tokens_of(hasher, raw, np.array([0, len(raw)]))
        tokens[d["doc_id"]] = s.astype(np.uint32)
    sets = {i: set(s.tolist()) for i, s in tokens.items()}
    want = set()
    for a in tokens:
        for b in tokens:
            if a < b and len(sets[a] & sets[b]) >= 20 and passages.agree(tokens[a], tokens[b], 46, 80):
                want |= {a, b}
    got = {x["doc_id"] for x in registry.op2_compact_windows(spark, SF).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 20


def test_lines_of_documents_by_all_pairs(spark):
    """The lines of up to 200 characters of the smallest tables that go, against all pairs by edit similarity."""
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    body = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").where("text is not null")
    short = lines.split_lines(body, 5).where(F.length("t") <= 200)
    rows = short.select("doc_id", "row", "line", "t").collect()
    texts = sorted({x["t"] for x in rows})
    con = duckdb.connect()
    con.execute("CREATE TABLE x AS SELECT unnest(range(len($t))) AS i, unnest($t) AS t", {"t": texts})
    near = con.execute(
        "SELECT a.i, b.i FROM x a JOIN x b ON a.i < b.i AND abs(length(a.t) - length(b.t)) <= greatest(length(a.t), length(b.t)) // 5 "
        "WHERE levenshtein(a.t, b.t) <= greatest(length(a.t), length(b.t)) // 5"
    ).fetchall()
    u = Union(range(len(texts)))
    for a, b in near:
        u.join(a, b)
    first, at = {}, {t: u.find(i) for i, t in enumerate(texts)}
    for x in rows:
        k = at[x["t"]]
        first[k] = min(first.get(k, (x["doc_id"], x["row"], x["line"])), (x["doc_id"], x["row"], x["line"]))
    want = {(x["row"], x["line"]) for x in rows if first[at[x["t"]]] != (x["doc_id"], x["row"], x["line"])}
    own = spark.createDataFrame([(x["doc_id"], x["row"], x["t"]) for x in rows], "doc_id long, row long, text string")
    by_line = own.groupBy("doc_id", "row").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    made = {x["row"]: x["text"].split("\n") for x in by_line.collect()}
    gone = {(x["row"], made[x["row"]][k]) for x in lines.decide(by_line, Scratch(spark, "t"), 5, 80).collect() for k in x["gone"]}
    said = {(x["row"], x["t"]) for x in rows if (x["row"], x["line"]) in want}
    assert len(gone & said) >= 0.97 * len(said) and len(gone - said) <= 0.03 * len(said) and len(said) > 20


def test_lines_of_any_length_by_edit_similarity(spark):
    """Long lines with an error in every third word are alike; their words in another order aren't, nor does length matter."""
    r = random.Random(17)
    for n in (300, 3000):
        w = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n)]
        typed = [x[:3] + "0" + x[4:] if i % 3 == 0 else x for i, x in enumerate(w)]
        turned = w[n // 2 :] + w[: n // 2]
        pairs = [(" ".join(w), " ".join(typed), True), (" ".join(w), " ".join(turned), False), (" ".join(w), " ".join(w[1:]), True)]
        df = spark.createDataFrame(pairs, "a string, b string, want boolean")
        assert all(x["want"] == x["got"] for x in df.select("want", lines.similar(F.col("a"), F.col("b"), 80).alias("got")).collect())


def test_lines_alike_with_few_common_words(spark, monkeypatch):
    """Lines of few common words that share a band are linked if their characters are alike, in lists of two, short and long ones."""
    monkeypatch.setattr(graph, "SHORT", 4)
    r = random.Random(18)
    for size in (2, 12):
        rare = " ".join(f"zq{i}" for i in range(4))
        word = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(16)] for _ in range(size // 2)]
        rows = [f"{rare} {' '.join(w)}" for w in word] + [f"{rare} {' '.join(x[:4] + '7' + x[5:] for x in w)}" for w in word]
        texts = [x.split(" ") for x in rows]
        one = {tuple(t) for t in texts}
        assert len(one) == size and all(len(set(a) & set(b)) / len(set(a) | set(b)) < 0.4 for a in texts for b in texts if a != b)
        monkeypatch.setattr(lines, "distinct_lines", _with_one_band(lines.distinct_lines) if size == 2 else lines.distinct_lines)
        got = {x["doc_id"] for x in lines.dedup_lines(frame(spark, list(enumerate(rows)))).collect() if x["__n_gone"]}
        assert got == set(range(size // 2, size))


def test_families_of_lines_are_compared_by_representatives(spark, monkeypatch):
    """Two families of near copies in one list take comparisons in proportion to their members; a line near to one member alone is linked."""
    r = random.Random(20)

    def word(n=9):
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    rows = []
    for _ in range(2):
        base = [word() for _ in range(40)]
        rows += [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(40)]
    # six words from a member of the second family, and more than 20 % from all that differ in a seventh
    far = rows[-1].split(" ")
    rows.append(" ".join([word() if i in range(5, 12) else x for i, x in enumerate(far)]))
    monkeypatch.setattr(lines, "distinct_lines", _with_one_band(lines.distinct_lines))
    n, save = [], Scratch.save

    def counted(self, df, name="t"):
        table = save(self, df, name)
        if name == "pairs":
            n.append(table.count())
        return table

    monkeypatch.setattr(Scratch, "save", counted)
    got = {x["doc_id"] for x in lines.dedup_lines(frame(spark, list(enumerate(rows)))).collect() if x["__n_gone"]}
    assert got == set(range(1, 81)) - {40}
    assert 80 <= sum(n) <= 4 * len(rows)


def test_passages_travel_to_few_blocks(spark, monkeypatch):
    """Runs of one cluster aren't copied for many small blocks, and the blocks' size doesn't change the result."""
    monkeypatch.setattr(graph, "SHORT", 2)
    monkeypatch.setattr(graph, "BLOCK", 8)
    r = random.Random(19)
    core = [prose(r, 34, 10**6) for _ in range(2)]
    rows = [f"{prose(r, 30, 10**6)} {core[i % 2]} {prose(r, 30, 10**6)}" for i in range(50)]
    rows += [edited(r, x, 2) for x in rows[:4]]
    seen, made = [], passages.verify_blocks

    def recorded(blocks, nodes, t, percent):
        seen.extend(blocks.collect())
        return made(blocks, nodes, t, percent)

    monkeypatch.setattr(passages, "verify_blocks", recorded)

    def result():
        return sorted((x["doc_id"], x["class_doc"]) for x in passages.repeated_passages(frame(spark, list(enumerate(rows)))).collect())

    large = result()
    nodes = {x["node"] for x in seen}
    assert len(nodes) > 16 and len(seen) <= 2 * len(nodes)
    seen.clear()
    monkeypatch.setattr(passages, "LARGER", 1)
    assert large == result() and len(large) >= 8
    assert len(seen) > 2 * len(nodes)


def test_lists_that_overlap_in_a_chain_arent_compared_as_a_whole(spark, monkeypatch):
    """Long lists of one leader are a cluster; members of one list meet in a block, and each travels to few."""
    monkeypatch.setattr(graph, "BLOCK", 16)
    lists = [range(20 * k, 20 * k + 30) for k in range(12)]
    postings = spark.createDataFrame([(k, x) for k, members in enumerate(lists) for x in members], "key long, node long")
    sizes = spark.createDataFrame([(x, 1) for x in range(250)], "node long, size long")
    met = []

    def none(rows):
        return spark.createDataFrame([], "a long, b long")

    def blocks(rows):
        met.extend(rows.collect())
        return none(rows)

    graph.link_lists(postings, sizes, none, blocks, Scratch(spark, "t"), merge="leader").count()
    assert 0 < len(met) <= 12 * 30 * 2 * 2
    inside: dict[tuple, list] = {}
    for x in met:
        inside.setdefault((x["cluster"], x["x"], x["y"]), []).append((x["head"], x["node"], x["label"]))
    pairs = {frozenset((a, b)) for rows in inside.values() for h, a, la in rows if h for g, b, lb in rows if not g and la != lb}
    for members in lists:
        assert all(frozenset((a, b)) in pairs for a in members[1:] for b in members[1:] if a < b)


def test_windows_are_made_once(spark, monkeypatch):
    r = random.Random(23)
    core = prose(r, 60, 10**6)
    rows = frame(spark, [(i, f"{prose(r, 40, 10**6)} {core if i % 2 else ''} {prose(r, 40, 10**6)}") for i in range(20)])
    counts, made = [], passages.windows

    def counted(texts, functions, t):
        n = spark.sparkContext.accumulator(0)
        counts.append(n)

        def count(batches):
            for b in batches:
                n.add(b.num_rows)
                yield b

        w = made(texts, functions, t)
        return w.mapInArrow(count, w.schema)

    monkeypatch.setattr(passages, "windows", counted)
    assert len(passages.repeated_passages(rows).collect()) == 10
    t = 50 - passages.K + 1
    first = passages.HASHES - passages.least_matches(80, passages.HASHES, passages.RISK) + 1
    assert counts[0].value == made(rows.select(F.col("doc_id").alias("row"), "text"), range(first), t).count()


def test_blocks_compare_only_rows_with_enough_common_tokens_side_by_side():
    r = np.random.default_rng(5)
    t, percent = 46, 80
    need = -(-2 * percent * t // (100 + percent))
    base = r.integers(0, 1 << 32, 400, dtype=np.uint32)
    tokens = [base]
    for k in range(60):
        other = r.integers(0, 1 << 32, 400, dtype=np.uint32)
        if k % 3 == 0:  # common tokens all over, but nowhere enough of them
            other[::4] = base[::4]
        elif k % 3 == 1:
            lo, at = r.integers(0, 350, 2)
            other[at : at + 50] = base[lo : lo + 50]
            other[r.integers(0, 400, k // 4)] = 7
        tokens.append(other)
    firsts, rest = np.arange(4), np.arange(len(tokens))
    found = {(i, j) for i, _, js in passages.block_pairs(tokens, firsts, rest, np.arange(len(tokens)), t, need) for j in js.tolist()}
    linked = {(i, j) for i in range(4) for j in range(len(tokens)) if i != j and passages.agree(tokens[i], tokens[j], t, percent)}
    spread = [j for j in range(1, len(tokens), 3) if len(np.intersect1d(base, tokens[j])) >= need]
    assert linked and linked <= found
    assert len(spread) == 20 and not any((0, j) in found for j in spread)


def _with_one_band(made):
    """The distinct lines as if all shared one band, and no other."""
    return lambda rows, weights: made(rows, weights).withColumn("keys", F.array(F.lit(1).cast("long")))
