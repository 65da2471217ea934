"""The corpus operators against brute force, on fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from perfloom.llm import ann, decontaminate, gsaca, html_text, line_dedup, near_dup, packing, pii, quality, queries, suffix_dedup, token_count
from perfloom.llm.components import components

DATA = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside or give.
CLASHES = ["key", "line", "gone", "n_lines", "n_removed", "score", "email", "term", "kept", "n_bytes", "spans", "u1", "h1", "c", "pos", "x", "component_id", "n_tokens", "label"]


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in CLASHES})


def odd_rows(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(40)) for _ in range(5)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = word()
        text = " ".join(w)
        rows.append((i, text if rng.random() < 0.7 else "\n".join(text[k : k + 50] for k in range(0, len(text), 50))))
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one two"), (504, "one two"), (505, "One\ntwo"), (506, "long " * 40_000), (507, "x" * 30_000), (None, base[0]), (508, base[0]), (508, base[0])]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def test_components_are_those_of_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, None), (1000, 1001), (1001, 1002), (1003, 1002)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if v is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


def _shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _components(rows):
    """(set size, smallest doc_id reachable) by doc_id, of rows whose ids are their own."""
    found = {i: _shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in found}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(found)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(found[a] & found[b])
            if both and 100 * both >= 75 * (len(found[a]) + len(found[b]) - both):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(found[i]), find(i)) for i in ids}


def test_near_duplicates(spark, odd, empty):
    rows = odd_rows()
    want = _components(rows)
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_mixed_buckets(spark):
    """Texts from one template that share too little to be linked, groups of near copies among them, and a hot group of copies."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    template = [word() for _ in range(75)]
    rows = []
    for g in range(60):
        own = [word() for _ in range(28)]
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            t = template + own
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    rows += [(1000 + i, " ".join(template)) for i in range(150)] + [(2000 + i, "") for i in range(100)]
    want = _components(rows)
    assert len({c for _, c in want.values()}) > 40
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_bayesian_bounds_follow_the_posterior():
    for n, least in near_dup.least_matches(128, 16, 0.75, 1e-6):
        from math import comb

        chance = lambda m, n=n: sum(comb(n + 1, j) * 0.75**j * 0.25 ** (n + 1 - j) for j in range(m + 1))
        assert chance(least) >= 1e-6 and (least == 0 or chance(least - 1) < 1e-6)


_BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    return True


def test_personal_data(spark, empty):
    rng = random.Random(5)
    bits = ["1", "2", "23", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é😀", "4111 1111 1111 1111", "10.0.0.1", "x@y.z", "_", "%", "\n", "+1 (743) 555-3824"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(900, None), (901, ""), (902, "1." * 2000 + "a." * 3000 + "@" + "b." * 3000 + "c"), (None, "m@n.op")]
    got = pii.find_personal_data(documents(spark, rows)).select("doc_id", "text", pii.written(pii.KINDS).alias("w"), "sanitised").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.w == ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in _BASE.items() for m in re.finditer(p, r.text or "") if _passes(k, m[0]))
    assert pii.find_personal_data(empty).count() == 0


def test_revealing_terms(spark):
    rows = [(i, f"Agent Zerubbabel keeps {i} cats at sam@x.org.\nplain words here {i}\nwords again {i}") for i in range(20)] + [(100, "words plain zerubbabel"), (101, "keeps words")]
    got = {r.doc_id: r for r in pii.find_personal_data(documents(spark, rows), generalise=0.75, remove=0.99).select("doc_id", "sanitised", pii.written(("term",)).alias("w")).collect()}
    assert "Zerubbabel" not in got[3].sanitised and "sam@x.org" not in got[3].sanitised and "[email]" in got[3].sanitised and "plain words here 3" in got[3].sanitised
    assert got[100].sanitised == "words plain zerubbabel" and got[100].w == ""
    # Copies of one document lend a term no support.
    copies = [(i, "Unique Person at p@q.rs") for i in range(10)] + [(20 + i, f"other line {i}") for i in range(30)]
    assert {r.w for r in pii.find_personal_data(documents(spark, copies)).select(pii.written(("term",)).alias("w")).collect()} == {""}


def test_terms_of_an_entity_in_one_line(spark):
    rows = [(0, "Call Quintessa about the common words of q@x.org now"), (1, "Somebody elsewhere")] + [(10 + i, f"call about the common words {i}") for i in range(3000)]
    got = {r.doc_id: r for r in pii.find_personal_data(documents(spark, rows)).where("doc_id < 3010").select("doc_id", "sanitised", pii.written(("term",)).alias("w")).collect()}
    assert got[0].sanitised == "Call [term] about the common words of [email] [term]" and got[0].w == "term:5:14,term:49:52"
    assert all(r.w == "" for k, r in got.items() if k)


def _distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edit_automaton_and_filters(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a = "".join(rng.choice("aé😀") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.random()
            if k < 0.33 and b:
                b.pop(rng.randrange(len(b)))
            elif k < 0.66:
                b.insert(rng.randint(0, len(b)), rng.choice("aé😀"))
            elif b:
                b[rng.randrange(len(b))] = rng.choice("aé😀")
        rows.append((i, a, "".join(b)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    for tau in (1, 2, 3):
        near = {r.i: r for r in df.withColumn("p", line_dedup.letter_counts("a")).withColumn("q", line_dedup.letter_counts("b")).select("i", line_dedup.within_edits("a", "b", tau).alias("w"), line_dedup.may_be_within("a", "b", tau).alias("m"), line_dedup.counts_agree("p", "q", tau).alias("c")).collect()}
        cut = {r.i: r.w for r in line_dedup.trimmed(df, "a", "b").checkpoint().select("i", line_dedup.within_edits("a", "b", tau).alias("w")).collect()}
        for i, a, b in rows:
            want = _distance(a, b) <= tau
            assert near[i].w == want == cut[i]
            assert not want or (near[i].m and near[i].c)


def _lines_left(rows):
    """The texts, by doc_id, without lines that equal or are near an earlier one; doc_ids must not repeat."""
    seen, used, want = [], set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None)):
        kept = []
        for x in t.split("\n"):
            if len(x) >= line_dedup.EXACT_CHARS:
                near = x not in used and len(x) >= line_dedup.NEAR_CHARS and any(abs(len(y) - len(x)) <= 2 and _distance(x, y) <= 2 for y in seen if len(y) >= line_dedup.NEAR_CHARS)
                first = x not in used
                used.add(x)
                if first:
                    seen.append(x)
                if not first or near:
                    continue
            kept.append(x)
        want[i] = "\n".join(kept)
    return want


def test_line_dedup(spark, empty):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(28, 60))) for _ in range(12)]
    rows = []
    for i in range(40):
        out = []
        for _ in range(rng.randint(1, 6)):
            x = list(rng.choice([*base, "short", "---", "exactly twelve"]))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                x[rng.randrange(len(x))] = rng.choice("abcxyz")
            out.append("".join(x))
        rows.append((i, "\n".join(out)))
    rows += [(100, None), (101, ""), (102, base[0] + "\n" + base[0]), (None, base[1]), (103, "y" * 50_000)]
    want = _lines_left(rows)
    # A line near an earlier one goes wherever it stands; so do its own copies.
    got = line_dedup.dedup_lines(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (base[1] if r.doc_id is None else want.get(r.doc_id)), r.doc_id
    assert line_dedup.dedup_lines(empty).count() == 0


def test_decontamination(spark, odd, empty):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(12, 40))))) for i in range(20)] + [(90, None), (91, ""), (92, "two words")]
    rows, want = [], set()
    for i, t in items[:20]:
        w = t.split()
        for e in range(int(decontaminate.EDITS * len(w)) + 1):
            x = list(w)
            for k in rng.choice(len(x), e, replace=False):
                x[k] = "changed"
            rows.append((len(rows), " ".join([*rng.choice(words, 30), *x, *rng.choice(words, 30)]).upper()))
            want.add((rows[-1][0], i))
    clean = [(1000 + i, " ".join(rng.choice(words, 80))) for i in range(40)] + [(2000, None), (2001, ""), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, rows + clean), bench).collect()}
    assert (None, 0) in got and len(want - got) <= 0.05 * len(want) and not {d for d, _ in got - want} - {None}
    assert decontaminate.leaks(documents(spark, rows + clean), bench, item_block=5).count() == len(got)
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0
    left = {r.doc_id for r in decontaminate.decontaminate(documents(spark, rows + clean), bench).collect()}
    assert {d for d, _ in clean} <= left


def _least_edits(item, words):
    """The fewest edits between an item and any run of words of a text."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("kind", ["change", "insert", "delete", "mix"])
def test_recall_of_edited_items(kind):
    rng = random.Random(kind)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [[word() for _ in range(rng.randint(7, 60))] for _ in range(120)]
    found = decontaminate.Items([(i, " ".join(t).encode()) for i, t in enumerate(items)])
    for rate in (0.05, 0.1, 0.15):
        want, docs = set(), []
        for i, t in enumerate(items):
            x = list(t)
            for _ in range(int(rate * len(t) + 1e-9)):
                k = rng.choice(["change", "insert", "delete"]) if kind == "mix" else kind
                if k == "insert":
                    x.insert(rng.randint(0, len(x)), word())
                elif k == "delete":
                    x.pop(rng.randrange(len(x)))
                else:
                    x[rng.randrange(len(x))] = word()
            text = [word() for _ in range(20)] + x + [word() for _ in range(20)]
            docs.append((i, decontaminate.sequences([" ".join(text).encode()])[0]))
            if (d := _least_edits(t, text)) <= decontaminate.EDITS * len(t):
                want.add((i, i, d))
        got = list(found.find(iter(docs)))
        assert len({(d, i) for d, i, *_ in got}) == len(got)
        # What is found has its true distance, and little is missed.
        assert {(d, i) for d, i, *_ in got} <= {(d, i) for d, i, _ in want}
        right = {(d, i, e) for d, i, _, _, e in got}
        assert len(want) > 100 and len(right & want) >= decontaminate.RECALL * len(want), (kind, rate, len(right & want), len(want))


def test_short_and_unspaced_items(spark):
    bench = spark.createDataFrame([(1, "Alpha"), (2, "beta gamma"), (3, "one two three"), (4, "\u6771\u4eac\u90fd\u306e\u4eba\u53e3\u306f\u4f55\u4eba\u3067\u3059\u304b"), (5, "..."), (6, None)], "item_id long, text string")
    rows = [(1, "x ALPHA, y"), (2, "alphabet beta-gamma"), (3, "One, two; three! alpha alpha"), (4, "\u5148\u6708\u6771\u4eac\u90fd\u306e\u4eba\u53e3\u306f\u4f55\u4eba\u3067\u3057\u305f\u304b"), (5, "beta, x gamma one two")]
    got = {(r.doc_id, r.item_id, r.n_edits) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (3, 1, 0)}
    # 13 characters allow one edit; this one has it.
    more = decontaminate.leaks(documents(spark, [(4, rows[3][1].replace("\u3057\u305f", "\u3059"))]), bench).collect()
    assert [(r.doc_id, r.item_id, r.n_edits) for r in more] == [(4, 4, 0)]


def test_a_text_of_many_items_is_searched_in_parts(monkeypatch):
    rng = random.Random(0)
    items = [[f"w{rng.randrange(900)}" for _ in range(20)] for _ in range(30)]
    found = decontaminate.Items([(i, " ".join(t).encode()) for i, t in enumerate(items)])
    w = decontaminate.sequences([" ".join(x for _ in range(40) for t in items for x in t).encode()])[0]
    whole = sorted(found.find(iter([("a", w), ("b", w[:50]), ("c", w[:900])])))
    monkeypatch.setattr(decontaminate, "WINDOWS", 64)
    assert sorted(found.find(iter([("a", w), ("b", w[:50]), ("c", w[:900])]))) == whole
    assert {(d, i) for d, i, *_ in whole} >= {("a", i) for i in range(30)} and all(s == 20 * i for d, i, s, _, e in whole if d == "a" and e == 0)


def test_quality(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels.where(quality.fold() != 1))
    scored = quality.score(docs, model).join(labels, "doc_id").where(quality.fold() == 1).select("score", "quality").collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in scored)
    assert right / len(scored) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect()) and quality.score(empty, model).count() == 0
    assert quality.score(odd, quality.train(odd, labels.limit(0))).first()["score"] == 0.5
    few = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert quality.score(odd, quality.train(odd, few)).first()["score"] > 0.99


def test_scores_are_sums_of_table_cells():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality.fit(x, y, bins=12, pairs=4)
    assert {m.pairs[0][0], m.pairs[0][1]} == {0, 1}
    new = rng.normal(size=(300, 6))
    place = lambda edges, v: sum(e <= v for e in edges)
    for row, got in zip(new, m.score(new), strict=True):
        f = m.base + sum(m.tables[j][place(m.edges[j], row[j])] for j in range(6))
        f += sum(t[place(m.coarse[a], row[a]), place(m.coarse[b], row[b])] for a, b, t in m.pairs)
        assert abs(got - 1 / (1 + np.exp(-f))) < 1e-9
    right = (m.score(new) >= 0.5) == ((new[:, 0] > 0) ^ (new[:, 1] > 0.3))
    assert right.mean() > 0.93


def test_features_by_their_definitions():
    texts = ["The quick, brown Fox! 42 % jumps.\nIt jumps.\nIt jumps.\n", "", "a|b #x", "\u00e9\u00e9 \u65e5\u672c " * 30]
    got = quality.features([t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        raw, v = t.encode(), dict(zip(quality.FEATURES, row, strict=True))
        w = re.findall(rb"[^\x20\x09-\x0d]+", raw)
        solid = sum(map(len, w))
        letters = sum(chr(c).isalpha() or c >= 128 for c in raw)
        assert np.isclose(v["log_bytes"], np.log1p(len(raw))) and np.isclose(v["digits"], sum(48 <= c <= 57 for c in raw) / max(1, solid))
        assert np.isclose(v["upper"], sum(65 <= c <= 90 for c in raw) / max(1, letters)) and np.isclose(v["bars"], raw.count(b"|") / max(1, solid))
        assert np.isclose(v["mean_word"], solid / max(1, len(w))) and np.isclose(v["distinct_words"], len({x.lower() for x in w}) / max(1, len(w)))
        assert np.isclose(v["distinct_shingles"], len(_shingles(t)) / max(1, len(w) - 4)) and np.isclose(v["log_lines"], np.log1p(sum(bool(x.strip()) for x in raw.split(b"\n"))))
        p = np.array([raw.count(bytes([c])) for c in set(raw)]) / max(1, len(raw))
        assert np.isclose(v["entropy"], -(p * np.log2(p)).sum())


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(400):
        x = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 50))] + [0]
        assert gsaca.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])
    for _ in range(100):
        part = [rng.randint(1, 5) for _ in range(rng.randint(1, 9))]
        x = (part * 40)[: rng.randint(1, 200)] + [0]
        assert gsaca.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_arrays_take_linear_time():
    rng = random.Random(4)
    for many in ([1], [1, 2], list(range(1, 5_000))):
        took = []
        for n in (50_000, 100_000):
            x = [rng.choice(many) for _ in range(n)] + [0]
            began = time.time()
            assert len(set(gsaca.suffix_array(x))) == n + 1
            took.append(time.time() - began)
        assert took[1] < 4 * took[0] + 0.5, took


@pytest.mark.parametrize("most", [20_000, 2])
def test_suffix_dedup(spark, empty, most):
    rng = random.Random(2)
    base = ["".join(rng.choice("ab cé") for _ in range(600)) for _ in range(6)]
    rows = []
    for i in range(80):
        t = ""
        for _ in range(rng.randint(0, 5)):
            a = rng.randrange(500)
            t += rng.choice(base)[a : a + rng.randint(1, 450)] + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 20)))
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "x" * 1000), (203, "xy" * 700), (204, "x" * 199), (205, "z" * 200), (None, base[0]), (206, base[0]), (206, base[0])]
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    want = Counter()
    for (i, _), t in zip(rows, raw, strict=True):
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        want[i, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest(), len(t), int(gone.sum()), sum(k for k, _ in groupby(gone.tolist()))] += 1
    got = suffix_dedup.remove_repeats(documents(spark, rows), most_contexts=most).select("doc_id", F.sha2("kept", 256).alias("h"), "n_bytes", "n_removed", "n_spans").collect()
    assert Counter(map(tuple, got)) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_html_blocks_and_text(spark):
    page = '<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>first\n  line<br><p>Second &eacute;<!-- no --> one.</p></article><div id="comments"><p>I disagree</p></div><footer>&copy; us</footer></body></html>'
    assert [b.text for b in html_text.blocks(page)] == ["Home", "Buy", "A & B", "first line", "Second é one.", "I disagree", "© us"]
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "just text"), (5, "u", "<p>" * 3000 + "<b <i"), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == ["A & B\n\nfirst line\n\nSecond é one."] * 2
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""] and html_text.extract(df.limit(0)).count() == 0


def test_embedded_elements_keep_their_text_and_the_page():
    page = "<article><p>Let <math><mi>x</mi></math> be <svg/>odd.</p><object><p>No plugin.</p></object><noscript><p>Plain.</p></noscript><video src=v><p>After.</p></article><p>End</p><script>no()</script>"
    assert [b.text for b in html_text.blocks(page)] == ["Let x be odd.", "No plugin.", "Plain.", "After.", "End"]


def test_pages_of_a_megabyte_are_read_in_linear_time():
    net = html_text.train([(html_text.blocks(p), y) for p, y in html_text.generated(40)])
    for page, n in (("<div>a" * 170_000, 170_000), ("<p>" + "<b>x</b> " * 110_000, 1), ("<h1>a" * 170_000, 170_000), ("<div>" * 90_000 + "</span>" * 70_000 + "z", 1), ("<a " * 340_000, 1), ("<!-- a > b", 0), ("x <!doctype", 1)):
        began = time.time()
        found = html_text.blocks(page)
        assert len(found) == n and time.time() - began < 10, page[:20]
        if n == 170_000:
            assert found[-1].path.depth == n
            texts = html_text.main_texts([page, "<article><p>Some words.</p></article>"], net)
            assert len(texts) == 2 and time.time() - began < 60


def test_paths_add_up_as_their_tokens_do():
    pages = [html_text.blocks(p) for p, _ in html_text.generated(20)] + [html_text.blocks("<div><p>a<p>b</div>c")]
    f = html_text.Features(pages)
    table = np.random.default_rng(1).normal(size=(html_text.PATH_BUCKETS, 3)).astype(np.float32)
    every = [b for p in pages for b in p]

    def tokens(path):
        return [] if path is None else [*tokens(path.above), *path.tokens]

    want = np.array([table[tokens(b.path)].sum(0) if b.path else np.zeros(3) for b in every])
    assert np.allclose(f.path_sums(table)[f.path], want, atol=1e-4)
    d = np.random.default_rng(2).normal(size=(len(every), 3)).astype(np.float32)
    by_path = np.zeros((len(f.above), 3), np.float32)
    np.add.at(by_path, f.path, d)
    grown = np.zeros_like(table)
    for b, x in zip(every, d, strict=True):
        np.add.at(grown, tokens(b.path), x)
    assert np.allclose(f.path_gradient(by_path), grown, atol=1e-3)


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    told = right = 0
    for r in pages.collect():
        found = html_text.blocks(r.html or "")
        if (y := html_text.told(found)) is not None:
            told += 1
            right += got[r.page_id] == "\n\n".join(b.text for b, k in zip(found, y, strict=True) if k)
    assert told and right >= 0.99 * told, (right, told)


def test_labeller_on_unseen_pages():
    learn = [(html_text.blocks(p), y) for p, y in html_text.generated(300)]
    net = html_text.train(learn)
    tests = [(html_text.blocks(p), y) for p, y in html_text.generated(150, seed=77)]
    assert all(len(b) == len(y) for b, y in tests)
    got = net.scores(html_text.Features([b for b, _ in tests])) >= 0.5
    assert (got == np.array([v for _, y in tests for v in y], bool)).mean() > 0.97


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = odd_rows() + [(700, "a <|endoftext|> b"), (701, "日本語 テスト\u0085x y"), (702, " " * 3000 + "x")]
    got = packing.pack(documents(spark, rows)).collect()
    by = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        n = sum(r.length for r in pieces)
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    docs = {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
    for i, pieces in docs.items():
        copies = sum(n for (j, _), n in want.items() if j == i)
        ids = next(x for (j, x) in want if j == i)
        assert sum(r.length for r in pieces) == copies * len(ids) and all(tuple(r.ids) == ids[r.start : r.start + r.length] and r.doc_tokens == len(ids) for r in pieces)
    total = sum(r.length for r in got)
    assert padding < 0.02 * total and packing.pack(empty).count() == 0
    assert packing.cut(2048 * 2 + 1024 + 65) == [2048, 2048, 1024, 64, 1]


def test_both_libraries_give_the_same_ids(spark):
    """The faster library takes plain texts only; on these it must not differ from the one that counts."""
    t = packing.tokens("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    rng = random.Random(12)
    bits = ["'s", "'ll", "'RE", "  ", " ", "\n", "\n\n", "\t", "\r\n", "don't", "A1b2", "123456", "...", "--", "#$%", "\u00e9", "\u00df", "\u0178", "\u017f", "\u00c0\u00e0", "\u00d7", "\u00f7", "<|endoftext|>", "<|end", "|>", "_x_", "word", " word", "x" * 50, "=" * 70]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    plain = [x for x in texts if not packing._PLAIN.search(x.encode())]
    assert len(plain) > 0.9 * len(texts)
    for x, e in zip(plain, t.library.encode_batch_fast(plain, add_special_tokens=False), strict=True):
        assert t.ids(x.encode()).tolist() == e.ids, x


def test_token_counts(spark, odd, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(8)
    bits = ["'s", "'", "'re", "l", "don't", "IT'S", "12", "3", "!?", "..", "é", "À", "ß", "ñandú", "日本", "<|endoftext|>", "<|x", "\x1c", "\u0085", " ", " ", "\n", "supercalifragilistic", "İ", "é", "×", "a" * 600]
    rows = odd_rows() + [(2000 + i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for most in (token_count.MAX_STATES, 50):
        got = token_count.count_tokens(documents(spark, rows), max_states=most).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_count.count_tokens(empty).count() == 0


def test_all_scripts_are_compiled(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t, rng = token_count.Transducer(path), random.Random(11)
    blocks = [(0x3B1, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x620, 0x669), (0x904, 0x96F), (0xE01, 0xE3A), (0x300, 0x320), (0x1E00, 0x1EFF), (0x2010, 0x2040), (0x2150, 0x2189), (0x3001, 0x30FF), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x1F600, 0x1F640), (0x1D400, 0x1D4FF)]
    texts = ["".join("".join(chr(rng.randint(*rng.choice(blocks))) for _ in range(rng.randint(1, 8))) + rng.choice(["", " ", "it's", "'ll", "12", "!?", "\u00c9t", "\n", "\u2003"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    want = [len(e) for e in t.library.encode_batch_fast(texts, add_special_tokens=False)]
    few = token_count.Transducer(path, 3_000)
    assert few.counts([x.encode() for x in texts]).tolist() == want

    library = token_count.Transducer._by_library

    def none(self, words):
        assert not words, words
        return []

    monkeypatch.setattr(token_count.Transducer, "_by_library", none)
    assert t.counts([x.encode() for x in texts]).tolist() == want
    # Where many words are beyond the limit, the next block starts with no states and compiles its own.
    monkeypatch.setattr(token_count.Transducer, "_by_library", library)
    few._forget()
    monkeypatch.setattr(token_count, "BLOCK", 400)
    grown = []
    for x, n in zip(texts, want, strict=True):
        assert few.counts([x.encode()]).tolist() == [n]
        grown.append(len(few.keys))
    assert max(grown) <= 3_000 and any(b < a for a, b in zip(grown, grown[1:]))


def test_long_texts_without_white_space():
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = ["a" * 30_001, "ab" * 20_000 + "c" + "abc" * 9_000, "".join(rng.choice(words) for _ in range(20_000)), "x " * 700 + "".join(rng.choice(words) for _ in range(9_000)) + "'s 12" + "q" * 5_000]
    texts.append("\u00e9t\u00e9 \u65e5\u672c " * 3_000 + texts[1])
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    for most in (token_count.MAX_STATES, 60):
        t = token_count.Transducer(path, most)
        assert t.counts([x.encode() for x in texts]).tolist() == want
    # Twice the length takes about twice the time.
    t, took = token_count.Transducer(path), []
    few = ["".join(rng.choice(words[:40]) for _ in range(20))]
    for n in (20_000, 40_000):
        x = "".join(rng.choice(few) for _ in range(n)).encode()
        t.counts([x[:100_000]])
        began = time.time()
        t.counts([x])
        took.append(time.time() - began)
    assert len(x) > 4_000_000 and took[1] < 4 * took[0] + 1, took


def test_words_that_end_with_a_chunk():
    import public_tokenizers

    t = token_count.transducer(public_tokenizers.path("word_bpe_49k.json"))
    texts = [head * k + "a" * (n - k * len(head)) + tail for n in (*range(505, 516), 1023, 1024, 1025) for head, k in (("", 0), ("x ", 200), ("\u65e5 ", 60)) for tail in ("", " b", "'s b", "'ll", "!! b")]
    want = [len(e) for e in t.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [int(t.counts([x.encode()])[0]) for x in texts] == want and t.counts([x.encode() for x in texts]).tolist() == want


def test_long_texts_are_counted_in_parts(monkeypatch):
    import public_tokenizers

    t = token_count.transducer(public_tokenizers.path("word_bpe_49k.json"))
    text = ("It's \u00e9t\u00e9,\tfar\nand wide12 " * 500 + "b" * 3_000 + "\x0b end").encode()
    whole = t.counts([text])[0]
    monkeypatch.setattr(token_count, "BLOCK", 1_000)
    assert t.counts([text, b"a b"]).tolist() == [whole, 2] and b"".join(token_count._parts(text)) == text


def test_nearest_neighbours(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in ann.nearest_neighbours(df, "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, []).append(r)
    rows = df.select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        best = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        mine = sorted(got[ids[q]], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1)) and all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(mine, mine[1:], strict=False))
        exact = dict(zip(ids.tolist(), s.tolist(), strict=True))
        assert all(abs(r.score - exact[r.vec_id]) < 1e-12 for r in mine)
        hit += len({r.vec_id for r in mine} & set(ids[best].tolist()))
        total += len(best)
    assert hit / total >= 0.9


def test_nearest_neighbours_among_near_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 64))
    x[::3] = x[0] + rng.normal(size=(4_000, 64)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[::20] @ x.T
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    recall = np.mean([len(got[20 * i] & set(b.tolist())) / 20 for i, b in enumerate(best)])
    assert recall >= 0.97, recall


def test_no_candidate_of_a_list_is_cut():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=16) + rng.normal(size=(3_000, 16)) * 1e-4, rng.normal(size=(500, 16))])
    ix = ann.Index(x, 4, 4)
    at, codes = ix.encode(x)
    for a in np.unique(at):
        part, q = x[at == a], x[::500]
        want = np.sort(q @ part.T, axis=1)[:, ::-1][:, :21]
        floor = np.full(len(q), -np.inf)
        for i, rows, sc in ann.best_in_list(ix, int(a), codes[at == a], part, q, ix.tables(q), floor, 21, 64):
            assert len(set(rows.tolist())) == len(rows) and np.allclose(np.sort(sc)[::-1][:21], want[i], rtol=0, atol=1e-12)


def test_nearest_neighbours_with_ties_and_bad_vectors(spark):
    v = np.random.default_rng(0).normal(size=(60, 8))
    rows = [(i, v[0].tolist()) for i in range(60)] + [(1, v[0].tolist())] * 25 + [(100 + i, v[i].tolist()) for i in range(1, 40)] + [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [1.0]), (380, [None] * 8), (None, v[1].tolist()), (40, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).withColumn("query", F.lit(1))
    got = ann.nearest_neighbours(df, "vec_id % 20 = 0").collect()
    assert {r.query_id for r in got} == {0, 20, 40, 100 + 20}
    # Fewer classes than a query reads lists for: the search is exact, so that each row can be told.
    every = [(i, np.array(x)) for i, x in dict((i, x) for i, x in rows if i is not None and x and len(x) == 8 and None not in x and any(x) and x[0] == x[0]).items()]
    for q in (0, 20, 40, 120):
        mine = dict(every)[q]
        want = sorted(((-float(mine @ x), i) for i, x in every if i != q))[:20]
        near = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in near] == [i for _, i in want] and np.allclose([r.score for r in near], [-s for s, _ in want])
    assert ann.nearest_neighbours(df.limit(0), "vec_id % 20 = 0").count() == 0 and ann.nearest_neighbours(df.where("vec_id = 20"), "true").count() == 0


def test_personal_data_equals_its_sql(spark):
    """Base spans and the terms at the shipped thresholds, against brute force in SQL."""
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = queries.QUERIES["op2_personal_data"](spark, DATA)
    want = c.sql(queries.ORACLES["op2_personal_data"])
    assert any("term:" in r[want.columns.index("spans")] for r in want.fetchall())
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_registered_queries_and_pipeline(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).checkpoint()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.run(spark, DATA)
    assert pieces.agg(F.sum("length")).first()[0] == corpus_pipeline.packing(spark, docs, DATA).agg(F.sum("length")).first()[0]


def test_pipeline_stages_on_odd_rows(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    base = dict(odd_rows())[0]
    more = [(600, "before it stands " + item + " and after"), (3, "x " + item), (610, base), (611, base), (611, "quite another text of eleven words that nothing else is like"), (611, base), (620, item)]
    rows = odd_rows() + more
    clash = {c: F.lit(7) for c in (*CLASHES, "text_hash", "__id", "__gone", "__hash", "item_id", "length", "offset", "ids")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "cast(length(text) as long) n_chars").withColumns({c: v for c, v in clash.items() if not c.startswith("__")})
    stage = dict(corpus_pipeline.STAGES)
    held = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    out = stage["quality classifier"](spark, docs, DATA)
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet").where(quality.fold() != 1))
    scores = model.score(quality.features([(t or "").encode() for _, t in rows]))
    assert out.columns == docs.columns and held(out) == Counter(r for r, x in zip(rows, scores, strict=True) if x >= 0.5)
    assert {r.score for r in out.collect()} <= {7}

    single = [(i, t) for i, t in rows if i is None or sum(j == i for j, _ in rows) == 1]
    lines = docs.join(spark.createDataFrame([(i,) for i, _ in single if i is not None], "doc_id long"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    out = stage["line dedup"](spark, lines, DATA)
    left = _lines_left(single)
    want = [(i, t if i is None or t is None else left[i]) for i, t in single]
    want = [(i, t) for (i, t), (_, old) in zip(want, single, strict=True) if t == old or t.strip(" \n\t\r\f\v")]
    assert out.columns == docs.columns and held(out) == Counter(want)
    assert all(r.n_chars == len(r.text or "") and r.n_lines == 7 and r.n_removed == 7 for r in out.collect())

    out = stage["MinHash near-dedup"](spark, docs, DATA)
    # Each different text of a doc_id is judged by itself: those whose component begins with another document go.
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    gone = set()
    for i, t in rows:
        others = [(j, u) for j, us in texts.items() for u in us if j is not None and j != i]
        if i is not None and _components([(i, t), *((k + 10_000, u) for k, (j, u) in enumerate(others) if j < i)])[i][0]:
            mine = _shingles(t)
            if any(mine and 100 * len(mine & _shingles(u)) >= 75 * len(mine | _shingles(u)) for j, u in others if j < i):
                gone.add((i, t))
    assert out.columns == docs.columns
    kept = held(out)
    assert not gone & set(kept) and kept[611, more[4][1]] == 1 and kept[611, base] == 0 and kept[610, base] == 0
    assert all(kept[r] == n for r, n in Counter(rows).items() if r[0] is None or not _shingles(r[1]))
    assert {r for r in set(rows) - set(kept)} == {(r.doc_id, t) for r, t in ((r, t) for r in near_dup.near_duplicates(docs).where("not kept").collect() for t in texts[r.doc_id] if _hash(spark, t) == r.text_hash)}

    out = stage["benchmark decontamination"](spark, docs, DATA)
    assert out.columns == docs.columns and held(out) == Counter(r for r in rows if r[0] not in (3, 600, 620))

    out = stage["packing"](spark, docs, DATA)
    by = Counter()
    for r in out.collect():
        by[r.doc_id] += r.length
    assert by[500] == 1 and by[501] == 1 and sum(by.values()) == sum(len(packing.tokens("byte_bpe_50k.json", None).ids((t or "").encode())) + 1 for _, t in rows)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), DATA).count() == 0, name


def _hash(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(near_dup.text_hash()).first()[0]
